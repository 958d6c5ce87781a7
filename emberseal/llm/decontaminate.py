"""Benchmark decontamination by canonical templates.

Native: a text's words lose their case and outer punctuation; numbers, names
and units become typed placeholders. Fingerprints of every `window` words, as they are
and in canonical form, come
from doubling (pairs, pairs of pairs, ...), are exploded and hash-joined with
those of the benchmark; the words of windows that meet are then compared. A
window equal word for word is a leak, whatever its words. One that
equals only as a template, so with other numbers, names or units in its slots,
is a leak if the slots are consistent: what stands once or more often in the
benchmark's slots stands for one and the same thing in the document's.

Windows met as templates need `literals` words that are no placeholders. An
item of fewer than `window` words is searched word for word, as one whole
sequence: a very short one may be a common phrase and is reported all the same.

Edge cases: null and empty texts have no windows; rows that share a doc_id are
one document; null doc_ids are one document, returned as null; an empty
documents or benchmark table gives no findings; other columns are not looked
at. The benchmark's windows are broadcast only if there are at most
BROADCAST_ROWS of them; otherwise Spark joins by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .rowkeys import id_or_null, keyed

BROADCAST_ROWS = 200_000
BLANK = r"[\x20\x09-\x0D]+"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
# Units that count as such right after a number.
UNITS = ("%", "mm", "cm", "m", "km", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hours", "days", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "usd", "eur", "$", "€")
EDGE = "\"'()[]{}.,;:!?“”„‘’«»¿¡"


def _parts(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), BLANK)


def _words(parts: Column, value) -> Column:
    """value(canonical word, word) of all parts that are more than punctuation; value makes strings or structs.

    Lambdas compute what they name each time, so the parts are trimmed by a
    transform of their own, and comparisons stand for substrings.
    """
    digit_first = lambda x: (x >= "0") & (x < ":")

    def word(bare: Column, before: Column) -> Column:
        low = F.lower(bare)
        capital = (bare != low) & (F.substring(bare, 1, 1) != F.substring(low, 1, 1)) & before.isNotNull() & ~F.substring(before, -1, 1).isin(".", "!", "?", ":")
        unit = digit_first(before) & low.isin(*UNITS)
        return F.when(bare != "", value(F.when(digit_first(bare), NUMBER).when(unit, UNIT).when(capital, NAME).otherwise(low), low))

    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.array_compact(F.zip_with(F.transform(parts, lambda x: F.btrim(x, F.lit(EDGE))), before, word))


def _both(parts: Column) -> Column:
    return _words(parts, lambda c, r: F.struct(c.alias("c"), r.alias("r")))


def _windows(rows: DataFrame, window: int, lengths: list[int]) -> DataFrame:
    """rows (with `words` of _both) exploded into place, n, slots and t; drops words.

    t is the fingerprint of n words from place on: of the words themselves
    (slots: 0) and, if n is `window`, of their canonical form where it differs
    (slots: 1). n is `window` or one of the shorter `lengths`.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    # The generators keep each step as a column, or the lambdas above it would compute it twice.
    out = rows.withColumn("p", F.explode(F.array(F.transform("words", lambda w: F.struct(F.xxhash64(w["c"]).alias("c"), F.xxhash64(w["r"]).alias("r")))))).drop("words")
    others = [c for c in out.columns if c != "p"]
    step, kept = 1, set()
    while step < window:
        if any(n & step for n in lengths):
            out = out.withColumn(f"r{step}", F.explode(F.array(F.transform("p", lambda x: x["r"]))))
            kept.add(step)
        count = F.greatest(F.size("p") - step, F.lit(0))
        pairs = F.zip_with(F.slice("p", F.lit(1), count), F.slice("p", F.lit(step + 1), count), lambda a, b: F.struct(F.xxhash64(a["c"], b["c"]).alias("c"), F.xxhash64(a["r"], b["r"]).alias("r")))
        out = out.withColumn("p", F.explode(F.array(pairs)))
        step *= 2
    whole = out.select(*others, F.posexplode("p").alias("place", "x"))
    both = whole.select(*others, "place", F.lit(window).alias("n"), F.posexplode(F.when(F.col("x.c") == F.col("x.r"), F.array("x.r")).otherwise(F.array("x.r", "x.c"))).alias("slots", "t"))
    if not lengths:
        return both
    short = []
    for n in lengths:
        powers = [k for k in sorted(kept, reverse=True) if n & k]
        runs, at = F.col(f"r{powers[0]}"), powers[0]
        for k in powers[1:]:
            count = F.greatest(F.size(f"r{k}") - at, F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), count), F.slice(f"r{k}", F.lit(at + 1), count), lambda a, b: F.xxhash64(a, b))
            at += k
        short.append(F.transform(runs, lambda t, i: F.struct(i.alias("place"), F.lit(n).alias("n"), F.lit(0).alias("slots"), t.alias("t"))))  # noqa: B023
    return both.unionByName(out.select(*others, F.explode(F.concat(*short)).alias("x")).select(*others, "x.place", "x.n", "x.slots", "x.t"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 5) -> DataFrame:
    """One row per contaminated document: doc_id, n_windows, n_templates, item_ids (sorted).

    n_windows counts its places that match word for word, n_templates those
    that match with other, consistent slots.
    """
    rows = keyed(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    items = durable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), _both(_parts(text)).alias("theirs")).filter(F.size("theirs") > 0).withColumn("item", F.xxhash64("item_id", "theirs")).dropDuplicates(["item"]))
    lengths = sorted(r.n for r in items.select(F.size("theirs").alias("n")).filter(F.col("n") < window).distinct().collect())
    held = _windows(items.select("item", "theirs", F.col("theirs").alias("words")), window, lengths).filter(F.col("n") == F.least(F.size("theirs"), F.lit(window)))
    literal = F.size(F.filter(F.slice("theirs", F.col("place") + 1, F.col("n")), lambda w: ~w["c"].isin(NUMBER, NAME, UNIT)))
    held = held.select("t", "item", F.col("place").alias("item_place"), "n", "slots", literal.alias("literal"))
    plain = held.filter("slots = 0").dropDuplicates(["t", "item"])
    known = durable(plain.unionByName(held.filter((F.col("slots") == 1) & (F.col("literal") >= literals))).drop("slots", "literal"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    cut = rows.select("doc_id", "text_hash", F.explode(F.array(_parts(F.col("text")))).alias("parts"))
    found = _windows(cut.select("doc_id", "text_hash", _both(F.col("parts")).alias("words")), window, lengths).select("doc_id", "text_hash", "place", "t")
    hits = durable(found.join(F.broadcast(known) if small else known, "t").select("doc_id", "text_hash", "place", "item", "item_place", "n").distinct())
    texts = rows.join(hits.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    own = texts.select("doc_id", "text_hash", _both(_parts(F.col("text"))).alias("own"))
    both = hits.join(own, ["doc_id", "text_hash"]).withColumn("own", F.slice("own", F.col("place") + 1, F.col("n")))
    both = both.join(items.select("item", "item_id", "theirs"), "item").withColumn("theirs", F.slice("theirs", F.col("item_place") + 1, F.col("n")))
    slots = F.filter(F.zip_with("own", "theirs", lambda a, b: F.struct(b["c"].alias("c"), b["r"].alias("from"), a["r"].alias("to"))), lambda s: s["c"].isin(NUMBER, NAME, UNIT))
    told = both.select("doc_id", "place", "item_id", (F.transform("own", lambda w: w["r"]) == F.transform("theirs", lambda w: w["r"])).alias("verbatim"), (F.transform("own", lambda w: w["c"]) == F.transform("theirs", lambda w: w["c"])).alias("equal"), F.array_distinct(slots).alias("slots"))
    fits = told.filter(F.col("verbatim") | (F.col("equal") & (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["c"], s["from"])))))))
    places = fits.groupBy("doc_id", "place").agg(F.max("verbatim").alias("verbatim"), F.collect_set("item_id").alias("ids"))
    out = places.groupBy("doc_id").agg(F.count_if("verbatim").alias("n_windows"), F.count_if(~F.col("verbatim")).alias("n_templates"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    return out.select(id_or_null(), "n_windows", "n_templates", "item_ids")
