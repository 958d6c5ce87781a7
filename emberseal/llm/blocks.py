"""Documents in blocks by doc_id, and fingerprint shards over all blocks.

Both duplicate-span operators work in the same rounds:

1. `blocked` deals the texts out once, into blocks of consecutive doc_ids.
2. A block lists the distinct fingerprints it holds; `shard_rows` cuts the
   sorted list at shard borders and packs each cut as one binary value (byte
   planes, so that the sorted high bytes compress in the shuffle).
3. A shard sees one packed list per block, whatever the number of copies, so
   a hot fingerprint costs one entry per block. It answers with a bitmap for
   each block.
4. The block, dealt out by the same exchange, reads its bitmaps.

No row leaves a block twice and nothing is gathered on the driver but one row
of totals and the block borders, at most MAX_BLOCKS of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)
BLOCK_BYTES, MAX_BLOCK_BYTES, MAX_BLOCKS = 4 << 20, 64 << 20, 1_000_000
PACKED = "shard int, block int, n int, packed binary"
MARKS = "block int, shard int, round int, marks binary"


@dataclass(frozen=True)
class Blocks:
    """frame: doc_id (null: NO_ID), text, block; dealt out by block."""

    frame: DataFrame
    total_bytes: int

    def shards(self, bytes_per_key: float, keys: int = 1 << 21) -> int:
        return max(1, math.ceil(self.total_bytes / bytes_per_key / keys))


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Blocks of consecutive doc_ids, about `block_bytes` of text each.

    Rows that share a doc_id share a block. The block size grows with the
    square root of the input beyond 4 GB, up to MAX_BLOCK_BYTES, so that
    blocks and shards both stay few; there are at most MAX_BLOCKS.
    """
    # One shape for all uses, so that Spark deals the texts out only once.
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    block_bytes = max(block_bytes, min(MAX_BLOCK_BYTES, int(math.sqrt(total) * 64)), total // MAX_BLOCKS)
    n = max(1, math.ceil(total / block_bytes))
    borders: list[int] = []
    if n > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q")).first()["q"]
        borders = sorted(set(cuts))
    frame = rows.withColumn("block", _number(docs, borders)(F.col("doc_id"))).repartition(max(1, math.ceil(n / 4)), "block")
    return Blocks(frame, total)


def _number(docs: DataFrame, borders: list[int]):
    """The number of borders below an id. They are broadcast (8 MB at most), so the plan holds none of them."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(borders, np.int64))

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy()).astype(np.int32))

    return number


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, n: int, dtype: type = np.uint64) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(dtype)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Monotone in the key."""
    return (((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def shard_rows(block: int, keys: np.ndarray, shards: int, *more: np.ndarray) -> pa.Table:
    """keys are sorted; `more` travels along. One row for each shard met."""
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    used = [i for i in range(shards) if cuts[i] < cuts[i + 1]]
    packed = [b"".join(planes(np.ascontiguousarray(x[cuts[i] : cuts[i + 1]])) for x in (keys, *more)) for i in used]
    return pa.table({"shard": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), "n": pa.array([int(cuts[i + 1] - cuts[i]) for i in used], pa.int32()), "packed": pa.array(packed, pa.binary())})


def packed_rows(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """(block, n, packed) in block order."""
    blocks, n, packed = (table.column(c).to_pylist() for c in ("block", "n", "packed"))
    for i in sorted(range(len(blocks)), key=blocks.__getitem__):
        yield blocks[i], n[i], packed[i]


def marks_table(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.Table:
    """(block, shard, round, bits) to rows of MARKS; all-zero bitmaps are left out."""
    rows = [r for r in rows if r[3].any()]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "shard": pa.array([r[1] for r in rows], pa.int32()), "round": pa.array([r[2] for r in rows], pa.int32()), "marks": pa.array([np.packbits(r[3]).tobytes() for r in rows], pa.binary())})


def read_marks(table: pa.Table, round_: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The bitmap over the block's sorted keys."""
    out = np.zeros(len(keys), bool)
    cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
    for shard, r, marks in zip(*(table.column(c).to_pylist() for c in ("shard", "round", "marks")), strict=True):
        if r == round_:
            a, b = cuts[shard], cuts[shard + 1]
            out[a:b] = np.unpackbits(np.frombuffer(marks, np.uint8), count=int(b - a)).astype(bool)
    return out


def block_rows(table: pa.Table) -> tuple[int, np.ndarray, pa.ChunkedArray]:
    """Number, doc_ids and texts of one block, ordered by (doc_id, text)."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table.column("block")[0].as_py(), table.column("doc_id").to_numpy(), table.column("text")
