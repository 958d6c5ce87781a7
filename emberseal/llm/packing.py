"""Order-preserving packing by dynamic programming over cut points.

Documents go in doc_id order into partitions; each partition tokenizes its
texts into one stream and cuts it into sequences of at most `size` ids. Cuts
lie after documents (free), after sentences or lines (`sentence_cost`), and,
where no such place comes for `size` ids, inside (`inner_cost`). A plan costs
its padding plus these penalties plus `sequence_cost` for each sequence; a
sequence that is full or a power of two long has no padding. Since padding is
size + p[j] - p[i] for a sequence from cut j to cut i, the best j within reach
is the front of a monotone queue over f[j] + p[j].

A stream is solved in blocks of `block` ids, the last sequence of a block
going on into the next, so memory doesn't grow with the partition; only a
document's own ids are held whole.

Edge cases: a null or empty text is one piece with the closing id alone; null
doc_ids come first and come back as null; rows that share a doc_id are packed
one by one, ordered by text; a text longer than a sequence takes several; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Packing:
    size: int = 1024
    sentence_cost: int = 4
    inner_cost: int = 64
    sequence_cost: int = 16
    block: int = 1 << 19
    partition_bytes: int = 24 << 20
    end_id: int = 0


@dataclass(frozen=True)
class TokenizerFiles:
    """tokenizer: a file of the tokenizers library. ranks, pattern: the same
    vocabulary for tiktoken, which gives the same ids several times faster;
    texts with a special token's string always go to the former."""

    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None


@lru_cache(maxsize=2)
def _encoder(files: TokenizerFiles):
    """texts -> lists of ids, and a table of ids that end a sentence or line."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(files.tokenizer)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    if files.ranks and files.pattern:
        import tiktoken

        with open(files.ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(texts: list[str]) -> list[list[int]]:
            return [slow.encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast(t) for t in texts]
    else:

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]

    shown = slow.decode_batch([[i] for i in range(slow.get_vocab_size())])
    ends = np.array([s.rstrip("\"')]”»").endswith((".", "!", "?", "…", "。")) or "\n" in s for s in shown])
    return encode, ends


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, rules: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts, 0 first and len(ids) last, and the penalty of each."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[1:][ends[ids]] = rules.sentence_cost
    cost[doc_ends] = 0
    cost[[0, len(ids)]] = 0
    at = np.flatnonzero(cost >= 0)
    far = np.flatnonzero(np.diff(at) > rules.size)
    if len(far):
        step = max(1, rules.size // 16)
        for a, b in zip(at[far], at[far + 1], strict=True):
            cost[a + step : b : step] = rules.inner_cost
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, rules: Packing) -> list[int]:
    """Positions of the cheapest plan's cuts, both ends included."""
    size, each = rules.size, rules.sequence_cost
    p, c = at.tolist(), cost.tolist()
    where = {x: i for i, x in enumerate(p)}
    short = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    f, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    key = [p[0]] + [0] * (len(p) - 1)
    for i in range(1, len(p)):
        x = p[i]
        while p[queue[0]] < x - size:
            queue.popleft()
        j = queue[0]
        best = key[j] + size - x
        for n in short:
            k = where.get(x - n)
            if k is not None and f[k] < best:
                best, j = f[k], k
        f[i], back[i] = best + c[i] + each, j
        key[i] = k = f[i] + x
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    cuts, i = [p[-1]], len(p) - 1
    while i:
        i = back[i]
        cuts.append(p[i])
    return cuts[::-1]


class _Stream:
    """Documents in, pieces out."""

    def __init__(self, ends: np.ndarray, rules: Packing, first_sequence: int) -> None:
        self.ends, self.rules, self.sequence = ends, rules, first_sequence
        self.docs: deque[list] = deque()  # [doc_id, ids, ids already out]
        self.held = 0

    def add(self, doc_id: int, ids: list[int]) -> None:
        self.docs.append([doc_id, np.array([*ids, self.rules.end_id], np.uint32), 0])
        self.held += len(ids) + 1

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        parts = [ids[done:] for _, ids, done in self.docs]
        ids = np.concatenate(parts)
        cuts = best_cuts(*cut_points(ids, np.cumsum([len(x) for x in parts]), self.ends, self.rules), self.rules)
        if not last:
            cuts = cuts[:-1]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            while offset < b - a:
                doc = self.docs[0]
                n = min(len(doc[1]) - doc[2], b - a - offset)
                own = doc[1][doc[2] : doc[2] + n]
                out.append((doc[0], doc[2], n, zlib.crc32(own.astype("<u4").tobytes()), len(doc[1]), self.sequence, offset))
                offset += n
                doc[2] += n
                if doc[2] == len(doc[1]):
                    self.docs.popleft()
            self.sequence += 1
        self.held -= cuts[-1]
        return out


def _packed(files: TokenizerFiles, rules: Packing):
    names = [c.split()[0] for c in PIECES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = _encoder(files)
        context = TaskContext.get()
        stream = _Stream(ends, rules, (context.partitionId() if context else 0) << 40)
        for b in batches:
            ids, text = b.column(0).to_pylist(), b.column(1)
            for at in range(0, len(ids), 64):
                for doc_id, tokens in zip(ids[at : at + 64], encode(text.slice(at, 64).to_pylist()), strict=True):
                    stream.add(doc_id, tokens)
                    if stream.held >= rules.block and (rows := stream.flush(False)):
                        yield batch(rows)
        if rows := stream.flush(True):
            yield batch(rows)

    return packed


def pack(docs: DataFrame, files: TokenizerFiles, rules: Packing | None = None) -> DataFrame:
    """One row per piece: see PIECES."""
    rules = rules or Packing()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    # At most 50,000 partitions, so that the last, shorter sequences of partitions stay few.
    n = max(1, min(50_000, -(-total // rules.partition_bytes)))
    # The hash of the text splits a doc_id that many rows share.
    dealt = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    out = dealt.mapInArrow(_packed(files, rules), PIECES)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
