"""Substring dedup: windows of n words that began in an earlier document go.

Rabin-Karp fingerprints of every window are listed by block and counted over
all blocks in shards (see blocks.py); repeated windows merge into maximal
removal intervals.

Edge cases: a null text has no words; a null doc_id sorts before every other
and comes back as null; rows that share a doc_id are one document for the
question which came first, and each comes back as its own row; documents of
fewer than n words keep all; an empty table gives no rows. Other columns of
the input are not looked at, whatever their names. Fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textnum as T

OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept_text string"


def _window_keys(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of a block's windows, the row of each, and words by row."""
    data, offs = T.as_bytes(text)
    keys, rows, counts = [], [], []
    for a, b in T.pieces(offs):
        h, _, _, first = T.word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        at, row = T.starts_within(first, n)
        keys.append(T.windows(h, n)[at])
        rows.append(row + a)
        counts.append(np.diff(first))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(keys, np.uint64), join(rows, np.int64), join(counts, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and whether each occurs more than once."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys))) > 1


def _list(n: int, shards: int):
    def listed(table: pa.Table) -> pa.Table:
        block, _, text = B.block_rows(table)
        return B.shard_rows(block, _distinct(_window_keys(text, n)[0])[0], shards)

    return listed


def _seen_earlier(table: pa.Table) -> pa.Table:
    """For each block's list: which keys an earlier block lists too."""
    shard = table.column("shard")[0].as_py()
    got = list(B.packed_rows(table))
    keys = [B.unplanes(p, n) for _, n, p in got]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")  # merges sorted runs; earlier blocks stand first
    every = every[order]
    again = np.zeros(len(every), bool)
    again[order[1:]] = every[1:] == every[:-1]
    cuts = np.cumsum([0, *map(len, keys)])
    return B.marks_table([(b, shard, 1, again[cuts[i] : cuts[i + 1]]) for i, (b, _, _) in enumerate(got)])


def _cut(n: int, shards: int, digest: bool):
    def cut(left: pa.Table, marks: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        _, ids, text = B.block_rows(left)
        keys, rows, counts = _window_keys(text, n)
        distinct, repeated = _distinct(keys)
        earlier = B.read_marks(marks, 1, distinct, shards)
        told = earlier | repeated
        suspects, from_before = distinct[told], earlier[told]
        gone = np.zeros(len(keys), bool)
        if len(suspects):
            at = np.minimum(np.searchsorted(suspects, keys), len(suspects) - 1)
            hit = np.flatnonzero(suspects[at] == keys)
            at = at[hit]
            least = np.full(len(suspects), len(ids), np.int64)
            np.minimum.at(least, at, rows[hit])  # rows are in doc_id order
            gone[hit] = from_before[at] | (ids[rows[hit]] > ids[least[at]])
        first = np.concatenate([[0], np.cumsum(counts)])
        start, _ = T.starts_within(first, n)
        mask = T.covered(start[gone], n, int(first[-1]))
        sums = np.concatenate([[0], np.cumsum(mask)])
        removed = sums[first[1:]] - sums[first[:-1]]
        rises = mask.copy()
        rises[1:] &= ~mask[:-1]
        heads = first[:-1][counts > 0]
        rises[heads] = mask[heads]
        risen = np.concatenate([[0], np.cumsum(rises)])
        kept = []
        for i, t in enumerate(text.to_pylist()):
            w = t.encode().split()  # bytes.split cuts at exactly the six separators
            if removed[i]:
                w = [w[j] for j in np.flatnonzero(~mask[first[i] : first[i + 1]])]
            joined = b" ".join(w)
            kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(risen[first[1:]] - risen[first[:-1]], pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return cut


def substring_dedup(docs: DataFrame, n: int = 13, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs), kept_text.

    With `digest`, kept_text holds the SHA-256 of the kept words instead, so
    that texts need not travel back.
    """
    blocks = B.blocked(docs)
    shards = blocks.shards(6)
    listed = blocks.frame.groupBy("block").applyInArrow(_list(n, shards), B.PACKED)
    marks = listed.groupBy("shard").applyInArrow(_seen_earlier, B.MARKS)
    out = blocks.frame.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut(n, shards, digest), OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != B.NO_ID, F.col("doc_id")))


# The query's rows by DuckDB, with n = 13.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), w AS (
  SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), g AS (
  SELECT r, doc_id, i, string_agg(word, ' ') OVER s AS words, count(*) OVER s AS n
  FROM w WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), f AS (
  SELECT words, min(doc_id) AS first FROM g WHERE n = 13 GROUP BY words
), h AS (
  SELECT g.r, g.i FROM g JOIN f ON g.words = f.words WHERE g.n = 13 AND f.first < g.doc_id
), c AS (
  SELECT w.r, w.i, w.word, count(h.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM w LEFT JOIN h ON w.r = h.r AND w.i = h.i
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM c
)
SELECT d.doc_id, count(e.word) AS n_words, count(*) FILTER (e.gone) AS n_removed,
       sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (NOT e.gone), '')) AS kept_sha256,
       count(*) FILTER (e.opens) AS n_spans
FROM d LEFT JOIN e ON d.r = e.r GROUP BY d.r, d.doc_id
"""
