"""Quality rules whose thresholds follow each language and source.

One pass measures every text. KLL quantile sketches of the measures, built
per language and source and merged per language and over all, give each group
its thresholds; rows join their group's thresholds and are filtered.

A measure's threshold is median + SPREADS * max(upper quartile - median,
slack), so it moves with what is usual in its group, and the slack keeps a
group of equal rows from rejecting its ordinary neighbours. Groups of any size
are treated alike: a group of n rows takes its own threshold with weight n and
its language's with weight PRIOR_ROWS; a language leans on all rows in the
same way, and these on PRIOR, the thresholds without any rows.
Rows that fail the base rule are not sketched.

Edge cases: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; doc_id may be null or repeat,
every row comes back; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .durable import durable

SPREADS = 4.0
PRIOR_ROWS = 100
KLL_K = 400
#: Measures that may be too high: expression over the counts, slack, and the threshold where no rows are known.
MEASURES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / n_words", 0.03, 0.15),
    "shouts": ("n_marks / n_words", 0.05, 0.3),
    "capitals": ("n_capitals / word_chars", 0.05, 0.4),
    "dup_lines": ("n_dup_lines / n_lines", 0.125, 0.5),
    "repeats": ("n_repeat_words / n_words", 0.125, 0.5),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")
STATS = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK, _CAPITAL = _table(b"#*$%&|<>"), _table(b"!?"), _table(bytes(range(65, 91)))
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def _later_copies(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where an earlier entry of the same row has the same key."""
    order = np.lexsort((np.arange(len(keys)), keys, rows))
    k, r = keys[order], rows[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    return out


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row."""
    rows = len(offs) - 1
    by_byte = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    s, e, first = T.words(data, offs)
    out = {
        "n_words": np.diff(first),
        "word_chars": by_byte(~T.IS_SPACE[data] & _STARTS_CHAR[data]),
        "n_symbols": by_byte(_SYMBOL[data]),
        "n_marks": by_byte(_MARK[data]),
        "n_capitals": by_byte(_CAPITAL[data]),
    }
    # Lines: from a row's start or after a \n, up to the next \n or the row's end.
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    row_of = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offs, breaks, side="right") - 1]), kind="stable")
    stop = np.append(start[1:] - 1, len(data))
    last = np.append(row_of[1:] != row_of[:-1], True)
    stop[last] = offs[1:][row_of[last]]
    wordy = np.searchsorted(s, stop) > np.searchsorted(s, start)
    keys = T.mix(T.hash_ranges(data, start[wordy], stop[wordy]))
    dup = _later_copies(keys, row_of[wordy])
    out["n_lines"] = np.bincount(row_of, minlength=rows)
    out["n_dup_lines"] = np.bincount(row_of[wordy][dup], minlength=rows)
    # Words in three-word windows that their row has twice or more.
    at, of = T.starts_within(first, 3)
    w = T.windows(T.mix(T.hash_ranges(data, s, e)), 3)
    keys = T.mix(w[at] + T.mix(of.astype(np.uint64) + np.uint64(1))) if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    mask = T.covered(at[twice], 3, int(first[-1]))
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(mask)])[first])
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = T.as_bytes(batch.column(3))
        for a, b in T.pieces(offs):
            got = measure(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", "lang", "source", *COUNTS])


def quality_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(_measured, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def thresholds(stats: DataFrame) -> DataFrame:
    """lang, source and a threshold for each of MEASURES, from merged sketches."""
    usable = stats.filter(~base_failed()).select("lang", "source", *(F.expr(e).cast("double").alias(m) for m, (e, _, _) in MEASURES.items()))
    sketches = usable.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, F.lit(KLL_K)).alias(m) for m in MEASURES))
    merged = lambda *by: sketches.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m).alias(m) for m in MEASURES))
    limit = lambda m, slack: F.kll_sketch_get_quantile_double(m, F.lit(0.5)) + SPREADS * F.greatest(F.kll_sketch_get_quantile_double(m, F.lit(0.75)) - F.kll_sketch_get_quantile_double(m, F.lit(0.5)), F.lit(slack))
    limits = lambda df, name: df.select(*(c for c in df.columns if c in ("lang", "source")), F.struct("n", *(limit(m, slack).alias(m) for m, (_, slack, _) in MEASURES.items())).alias(name))
    lean = lambda own, on: F.struct(*(((own["n"] * own[m] + PRIOR_ROWS * on[m]) / (own["n"] + PRIOR_ROWS)).alias(m) for m in MEASURES))
    own, lang = limits(sketches, "own"), limits(merged("lang"), "by_lang").withColumnRenamed("lang", "lang_")
    found = limits(merged().filter("n > 0"), "by_all").first()
    rows, over_all = (found.by_all["n"], found.by_all) if found else (0, None)
    by_all = F.struct(*(F.lit((rows * (over_all[m] if over_all else 0.0) + PRIOR_ROWS * prior) / (rows + PRIOR_ROWS)).alias(m) for m, (_, _, prior) in MEASURES.items()))
    joined = own.join(lang, own["lang"].eqNullSafe(lang["lang_"]), "left")
    return joined.select("lang", "source", lean(F.col("own"), lean(F.col("by_lang"), by_all)).alias("limits"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, limits (null where all rows of a group fail the base rule), kept."""
    stats = durable(quality_stats(docs))
    limits = thresholds(stats).withColumnsRenamed({"lang": "lang_", "source": "source_"})
    joined = stats.join(limits, stats["lang"].eqNullSafe(limits["lang_"]) & stats["source"].eqNullSafe(limits["source_"]), "left").drop("lang_", "source_")
    over = F.lit(False)
    for m, (e, _, _) in MEASURES.items():
        over = over | F.coalesce(F.expr(f"try_divide({e.replace(' / ', ', ')})") > F.col("limits")[m], F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)
