"""Suffix-array dedup of bytes by a logarithmic family of indexes.

A byte is removed if it lies in a `width`-byte string that also starts
earlier: in a document with a smaller doc_id, or before it in the same one.

An entry for every byte of the corpus costs far more than its long matches are
worth, so the suffix arrays are sparse. Among the `gram`-byte strings inside a
`width`-byte string, the one with the least fingerprint (leftmost if equal) is
its anchor; equal strings have equal anchors at equal places. Consecutive
starts with one anchor make a run; the suffix at a run's first start, up to the
end of its last string, holds all of its strings.

1. Blocks of documents list the fingerprints of their anchors and of the runs'
   bytes, and shards over all blocks tell which runs an earlier block holds too
   (equal in both, 128 bits: they go whole) and which anchors have two or more
   different runs. Only the first of equal runs goes on, so what the next step
   ships grows with the different surroundings of anchors, not with copies.
2. The suffixes of those runs go to their anchor's shard. There each block
   is a batch: its suffixes are sorted by their bytes, and the suffix array is
   merge-scanned against all levels of the index. The common prefix with its
   neighbours there tells how many leading strings of a run were seen; suffixes
   that were not seen whole become a new level, and levels of equal size merge,
   so n batches keep at most log2(n) levels.
3. Strings may also be shared between suffixes that differ. So, for anchors
   with two or more suffixes, a suffix array of all their strings is scanned.

Steps 2 and 3 compare bytes. An anchor with HOT or more suffixes, as on the
border of a passage that half of the documents hold, would gather them all in
one shard, so its strings are dealt by their own fingerprints (128 bits)
instead of step 2, and only those are compared. So are those of an anchor with
more than HOT / 64 different runs in one block, which lists them as one.

`SuffixStore` keeps the family on disk, so that a later batch of documents is
scanned against those before it.

Edge cases: a null text is empty; a null doc_id sorts before every other and
comes back as null; rows that share a doc_id follow each other ordered by
text, and an equal later row counts as later; texts under `width` bytes keep
all; a long text is worked on in pieces; removed bytes may leave text that is
no UTF-8, so the operator returns binary; other columns are not looked at; an
empty table gives no rows, and one without repeats comes back whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from . import textnum as T

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
PIECE_BYTES = 1 << 20
#: Anchors in a shard of step 1, and runs in one of step 2 if all of them repeat.
SHARD_KEYS, SHARD_RUNS = 1 << 19, 1 << 17
#: Strings that are sorted at a time in step 3.
SCAN_STRINGS = 1 << 17
HOT = 1 << 14
# Fixed value: stands for the contents of a key that has too many in a block.
CROWDED = np.uint64(0)
#: Of a store's packed keys: 2 holds contents.
FORM = 2
_PLACE_BITS = 24  # a piece has fewer bytes


def common_prefix(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two byte matrices, at most `most`."""
    differ = a != b
    at = differ.argmax(1)
    return np.minimum(np.where(differ[np.arange(len(at)), at], at, a.shape[1]), most)


class LevelIndex:
    """Suffix arrays whose sizes fall geometrically.

    A suffix is a row of `wide` bytes, padded with zeros, and one more byte:
    how many strings of `width` bytes start in it. Rows are in byte order.
    """

    def __init__(self, width: int, wide: int) -> None:
        self.width, self.wide = width, wide
        self.levels: list[tuple[np.ndarray, ...]] = []

    def bytes_of(self, rows: np.ndarray) -> np.ndarray:
        return rows.view(np.uint8).reshape(-1, self.wide + 1)

    def add(self, rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """Scans a sorted batch of distinct suffixes against the levels; returns how many leading strings of each were there."""
        own = self.bytes_of(rows)
        count = own[:, -1].astype(np.int64)
        found = np.zeros(len(rows), np.int64)
        for level in self.levels:
            there, at = self.bytes_of(level[0]), np.searchsorted(level[0], rows)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(there) - 1)):
                long = common_prefix(own[:, :-1], there[near, :-1], np.minimum(count, there[near, -1]) + self.width - 1)
                found = np.maximum(found, long - self.width + 1)
        fresh = found < count
        new = tuple(x[fresh] for x in (rows, *more))
        while len(new[0]) and self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            new = self._merged(self.levels.pop(), new)
        if len(new[0]):
            self.levels.append(new)
        return found

    def all(self) -> tuple[np.ndarray, ...] | None:
        while len(self.levels) > 1:
            small = self.levels.pop()
            self.levels.append(self._merged(self.levels.pop(), small))
        return self.levels[0] if self.levels else None

    @staticmethod
    def _merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")  # finds the two sorted parts and merges them
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def _pieces(offs: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last byte number, and row borders from the first on. A long row comes in pieces that share width - 1 bytes."""
    for a, b in T.pieces(offs, PIECE_BYTES):
        base, stop = int(offs[a]), int(offs[b])
        if stop - base <= 2 * PIECE_BYTES:
            yield base, stop, offs[a : b + 1] - base
        else:
            for at in range(base, stop - width + 1, PIECE_BYTES):
                end = min(at + PIECE_BYTES + width - 1, stop)
                yield at, end, np.array([0, end - at])


class Runs:
    """The runs of a block in text order.

    start: number of the first string's first byte; count: strings in the run;
    key: fingerprint of the anchor; content: of all bytes spanned.
    """

    def __init__(self, text: pa.Array, width: int, gram: int) -> None:
        self.raw, self.offs = T.as_bytes(text)
        self.width = width
        got: list[list[np.ndarray]] = [[], [], [], []]
        for base, stop, rows in _pieces(self.offs, width):
            if stop - base < width:
                continue
            prefix = T.prefix_hash(self.raw[base:stop])
            places = stop - base - width + 1
            grams = T.mix((prefix[gram:] - prefix[:-gram]) * T.powers(len(prefix))[1][: len(prefix) - gram])
            least = _sliding_min((grams & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(grams)).astype(np.uint64), width - gram + 1)
            anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
            holds = np.diff(rows) >= width
            steps = np.zeros(places + 1, np.int32)
            np.add.at(steps, rows[:-1][holds], 1)
            np.add.at(steps, rows[1:][holds] - width + 1, -1)
            ok = np.cumsum(steps[:-1]) > 0
            head = ok.copy()
            head[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
            head[rows[:-1][holds]] = True
            s = np.flatnonzero(head)
            tail = ok.copy()
            tail[:-1] &= head[1:] | ~ok[1:]
            e = np.flatnonzero(tail)
            content = T.mix(T.range_hash(prefix, s, e + width) ^ T.mix((e - s + 1).astype(np.uint64)))
            # Least fingerprints crowd at zero; mixed anew, they are spread over all shards.
            for x, y in zip(got, (s + base, e - s + 1, T.mix(grams[anchor[s]] ^ np.uint64(T.BASE)), content), strict=True):
                x.append(y)
        self.start, self.count, self.key, self.content = (_join(x, t) for x, t in zip(got, (np.int64, np.int64, np.uint64, np.uint64), strict=True))
        order = np.lexsort((self.content, self.key))
        k, c = self.key[order], self.content[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        first = order[new]
        #: First runs of distinct contents, by key and then by place.
        self.first = first[np.lexsort((first, self.key[first]))]

    def entries(self, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys and a content of each, and the entry of each of `first`. A key of more than `crowd` contents has one entry, CROWDED."""
        keys, content = self.key[self.first], np.maximum(self.content[self.first], CROWDED + np.uint64(1))
        _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        many = counts[number] > crowd
        own = ~many
        own[1:] |= number[1:] != number[:-1]
        own[:1] = True
        return keys[own], np.where(many, CROWDED, content)[own], np.cumsum(own) - 1

    def suffixes(self, runs: np.ndarray, wide: int) -> tuple[bytes, np.ndarray]:
        """The bytes of these runs end to end, and where each begins (and the end)."""
        size = self.count[runs] + self.width - 1
        parts, padded = [], np.concatenate([self.raw, np.zeros(wide, np.uint8)])
        for i in range(0, len(runs), 1 << 16):
            rows = sliding_window_view(padded, wide)[self.start[runs[i : i + (1 << 16)]]]
            parts.append(rows[np.arange(wide) < size[i : i + (1 << 16), None]])
        return _join(parts, np.uint8).tobytes(), np.concatenate([[0], np.cumsum(size)])

    def strings(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all strings of these runs, in text order, and their fingerprints in two parts."""
        runs, half = np.sort(runs), self.width // 3
        s, n = self.start[runs], self.count[runs]
        out: list[list[np.ndarray]] = [[], [], []]
        for base, stop, _ in _pieces(self.offs, self.width):
            i, j = np.searchsorted(s, [base, max(base, stop - self.width + 1)])
            if i < j:
                at, prefix = _starts(s[i:j], n[i:j]) - base, T.prefix_hash(self.raw[base:stop])
                whole, left = T.range_hash(prefix, at, at + self.width), T.range_hash(prefix, at, at + half)
                for x, y in zip(out, (at + base, T.mix(whole), T.mix(T.mix(left) * np.uint64(T.BASE) + T.range_hash(prefix, at + half, at + self.width))), strict=True):
                    x.append(y)
        return _join(out[0], np.int64), _join(out[1], np.uint64), _join(out[2], np.uint64)


def _join(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _starts(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each, end to end."""
    before = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(first - before[:-1], count) + np.arange(before[-1])


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first of each distinct pair, ordered by (hi, lo), and the rank of each pair."""
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


class Plan:
    """What the steps share: widths and numbers of shards.

    `hot` is the number of suffixes from which a key is hot. Blocks from `new`
    on are judged, against each other and against those before.
    """

    def __init__(self, width: int, gram: int, total_bytes: int, hot: int = HOT, shards: tuple[int, int] | None = None, new: int = 0) -> None:
        if not 0 < gram <= width or width - gram >= 255:
            raise ValueError("gram must be from width - 254 to width")
        runs = total_bytes / max(1.0, (width - gram) / 2)
        self.width, self.gram, self.wide, self.hot, self.new = width, gram, 2 * width - gram, hot, new
        self.crowd = max(1, hot // 64)
        self.shards, self.shards_2 = shards or (int(runs // SHARD_KEYS) + 1, int(runs // SHARD_RUNS) + 1)

    def list_keys(self, table: pa.Table) -> pa.Table:
        """Step 1, block: its keys, and the contents of their runs."""
        block, _, text = B.block_rows(table)
        keys, content, _ = Runs(text, self.width, self.gram).entries(self.crowd)
        return B.shard_rows(block, keys, self.shards, content)

    def scan_keys(self, table: pa.Table) -> pa.Table:
        """Step 1, shard: first ones of the contents of keys with two or more (1) or `hot` or more (2), if a new block adds to them; contents of an earlier block (5)."""
        shard, got = table.column("shard")[0].as_py(), list(B.packed_rows(table))
        keys, content = (np.concatenate([B.unplanes(p[skip * n :], n) for _, n, p in got]) for skip in (0, 8))
        order = np.lexsort((content, keys))  # stable: earlier blocks stand first
        keys, content = keys[order], content[order]
        opens = np.ones(len(keys), bool)
        opens[1:] = keys[1:] != keys[:-1]
        crowded = content == CROWDED
        first = opens | crowded
        first[1:] |= content[1:] != content[:-1]
        number = np.cumsum(opens) - 1
        fresh = np.repeat([b >= self.new for b, _, _ in got], [n for _, n, _ in got])[order]
        total = np.bincount(number, weights=np.where(crowded, self.hot, first)) * (np.bincount(number, weights=first & fresh) > 0)
        cuts = np.cumsum([0, *(n for _, n, _ in got)])
        told = []
        for r, mark in ((1, first & (total[number] >= 2)), (2, first & (total[number] >= self.hot)), (5, ~first & fresh)):
            back = np.zeros(len(order), bool)
            back[order] = mark
            told += [(b, shard, r, back[i:j]) for (b, _, _), i, j in zip(got, cuts, cuts[1:], strict=False)]
        return B.marks_table(told)

    def told(self, text: pa.Array, marks: pa.Table) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
        """The block's runs; those of `first` that step 2 compares, those whose strings are dealt one by one, and those of an earlier block."""
        runs = Runs(text, self.width, self.gram)
        keys, _, number = runs.entries(self.crowd)
        shared, hot, seen = (B.read_marks(marks, r, keys, self.shards)[number] for r in (1, 2, 5))
        return runs, runs.first[shared & ~hot], runs.first[hot], runs.first[seen]

    def list_suffixes(self, left: pa.Table, marks: pa.Table) -> pa.Table:
        """Step 2, block: its suffixes, and strings of hot keys, for shards beyond the others."""
        if not left.num_rows or not marks.num_rows:
            return B.shard_rows(0, np.zeros(0, np.uint64), 1)
        block, _, text = B.block_rows(left)
        runs, cold, hot, _ = self.told(text, marks)
        raw, at = runs.suffixes(cold, self.wide)
        cuts = np.searchsorted(B.shard_of(runs.key[cold], self.shards_2), np.arange(self.shards_2 + 1))
        used = [i for i in range(self.shards_2) if cuts[i] < cuts[i + 1]]
        packed = [B.planes(runs.key[cold[a:b]]) + runs.count[cold[a:b]].astype(np.uint8).tobytes() + raw[at[a] : at[b]] for a, b in ((cuts[i], cuts[i + 1]) for i in used)]
        rows = pa.table({"shard": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), "n": pa.array([int(cuts[i + 1] - cuts[i]) for i in used], pa.int32()), "packed": pa.array(packed, pa.binary())})
        if not len(hot):
            return rows
        _, hi, lo = runs.strings(hot)
        one, _ = _distinct(hi, lo)
        strings = B.shard_rows(block, hi[one], self.shards_2, lo[one])
        return pa.concat_tables([rows, strings.set_column(0, "shard", pa.array(strings.column("shard").to_numpy() + self.shards_2, pa.int32()))])

    def scan(self, table: pa.Table) -> pa.Table:
        shard, got = table.column("shard")[0].as_py(), list(B.packed_rows(table))
        return self._scan_strings(shard, got) if shard >= self.shards_2 else self._scan_suffixes(shard, got)

    def _scan_strings(self, shard: int, got: list[tuple[int, int, bytes]]) -> pa.Table:
        """Which strings an earlier block lists too (4)."""
        hi, lo = (np.concatenate([B.unplanes(p[skip * n :], n) for _, n, p in got]) for skip in (0, 8))
        order = np.lexsort((lo, hi))  # stable: earlier blocks stand first
        again = np.zeros(len(hi), bool)
        again[order[1:]] = (hi[order][1:] == hi[order][:-1]) & (lo[order][1:] == lo[order][:-1])
        cuts = np.cumsum([0, *(n for _, n, _ in got)])
        return B.marks_table([(b, shard - self.shards_2, 4, again[i:j]) for (b, _, _), i, j in zip(got, cuts, cuts[1:], strict=False)])

    def _scan_suffixes(self, shard: int, got: list[tuple[int, int, bytes]]) -> pa.Table:
        """Which strings of the suffixes stand earlier (3): a bit for each, in the order listed."""
        index, done, cuts, gone = LevelIndex(self.width, self.wide), 0, [0], []
        for _, n, packed in got:
            key, count = B.unplanes(packed, n), np.frombuffer(packed, np.uint8, n, 8 * n)
            rows = np.zeros((n, self.wide + 1), np.uint8)
            rows[:, :-1][np.arange(self.wide) < count[:, None] + np.int64(self.width - 1)] = np.frombuffer(packed, np.uint8, offset=9 * n)
            rows[:, -1] = count
            rows = rows.reshape(-1).view(f"S{self.wide + 1}")
            order = np.argsort(rows, kind="stable")
            place = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            found = index.add(rows[order], key[order], place[:-1][order] + done)
            bits = np.zeros(place[-1], bool)
            bits[_starts(place[:-1][order], found)] = True
            gone.append(bits)
            done += int(place[-1])
            cuts.append(done)
        told = np.concatenate(gone)
        told[self._shared(index)] = True
        return B.marks_table([(b, shard, 3, told[i:j]) for (b, _, _), i, j in zip(got, cuts, cuts[1:], strict=False)])

    def _shared(self, index: LevelIndex) -> np.ndarray:
        """Places of strings that stand earlier in another suffix with the same anchor."""
        rows, key, place = index.all()
        order = np.lexsort((place, key))
        k = key[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        same[:-1] |= same[1:]
        order, k, out = order[same], k[same], []
        count = index.bytes_of(rows)[order, -1].astype(np.int64)
        ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))  # a key's suffixes stay together
        total, i = np.concatenate([[0], np.cumsum(count)]), 0
        while i < len(k):
            j = int(ends[max(np.searchsorted(total[ends], total[i] + SCAN_STRINGS, side="right") - 1, np.searchsorted(ends, i, side="right"))])
            flat = index.bytes_of(rows[order[i:j]]).reshape(-1)
            at = _starts(np.arange(j - i) * (self.wide + 1), count[i:j])
            strings = sliding_window_view(flat, self.width)[at].reshape(-1).view(f"S{self.width}")
            by = np.argsort(strings, kind="stable")
            again = strings[by][1:] == strings[by][:-1]
            out.append(_starts(place[order[i:j]], count[i:j])[by[1:][again]])
            i = j
        return _join(out, np.int64)

    def gone(self, text: pa.Array, marks: pa.Table) -> tuple[Runs, np.ndarray]:
        """The block's runs, and which of its bytes go."""
        runs, cold, hot, seen = self.told(text, marks)
        size = len(runs.raw)
        bits, count = np.zeros(int(runs.count[cold].sum()), bool), runs.count[cold]
        place = np.concatenate([[0], np.cumsum(count)])
        cuts = place[np.searchsorted(B.shard_of(runs.key[cold], self.shards_2), np.arange(self.shards_2 + 1))]
        for shard, r, packed in zip(*(marks.column(c).to_pylist() for c in ("shard", "round", "marks")), strict=True):
            if r == 3:
                a, b = cuts[shard], cuts[shard + 1]
                bits[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(b - a)).astype(bool)
        starts = [_starts(runs.start[cold], count)[bits]]
        if len(hot):
            at, hi, lo = runs.strings(hot)
            one, rank = _distinct(hi, lo)
            again = np.ones(len(at), bool)
            again[one] = B.read_marks(marks, 4, hi[one], self.shards_2)
            starts.append(at[again | B.read_marks(marks, 4, hi[one], self.shards_2)[rank]])
        later = np.ones(len(runs.start), bool)
        later[runs.first] = False
        later[seen] = True
        starts, whole = np.concatenate(starts), np.flatnonzero(later)
        steps = np.bincount(starts, minlength=size + 1).astype(np.int32)
        steps -= np.bincount(starts + self.width, minlength=size + 1).astype(np.int32)
        steps += np.bincount(runs.start[whole], minlength=size + 1).astype(np.int32)
        steps -= np.bincount(runs.start[whole] + runs.count[whole] + self.width - 1, minlength=size + 1).astype(np.int32)
        return runs, np.cumsum(steps[:-1]) > 0


def _cut(plan: Plan, digest: bool):
    def cut(left: pa.Table, marks: pa.Table) -> pa.Table:
        ids = np.zeros(0, np.int64)
        n, removed, spans, kept = ids, ids, ids, []
        if left.num_rows:
            _, ids, text = B.block_rows(left)
            runs, mask = plan.gone(text, marks)
            offs = runs.offs
            sums = np.concatenate([[0], np.cumsum(mask)])
            n, removed = np.diff(offs), sums[offs[1:]] - sums[offs[:-1]]
            rises = mask.copy()
            rises[1:] &= ~mask[:-1]
            heads = offs[:-1][n > 0]
            rises[heads] = mask[heads]
            risen = np.concatenate([[0], np.cumsum(rises)])
            spans = risen[offs[1:]] - risen[offs[:-1]]
            for i in range(len(ids)):
                own = runs.raw[offs[i] : offs[i + 1]]
                own = (own[~mask[offs[i] : offs[i + 1]]] if removed[i] else own).tobytes()
                kept.append(hashlib.sha256(own).hexdigest().encode() if digest else own)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return cut


def _removed(frame: DataFrame, keys: DataFrame, new: DataFrame, plan: Plan, digest: bool, only_marked: bool = False) -> DataFrame:
    """Spark counts the arguments of a method with self, hence the lambdas. frame: all blocks; keys: what list_keys gives for them; new: the blocks to cut."""
    marks_1 = keys.groupBy("shard").applyInArrow(lambda t: plan.scan_keys(t), B.MARKS)
    if only_marked:
        frame = frame.join(marks_1.select("block").distinct(), "block", "left_semi")
    suffixes = frame.select("doc_id", "text", "block").groupBy("block").cogroup(marks_1.groupBy("block")).applyInArrow(lambda t, m: plan.list_suffixes(t, m), B.PACKED)
    marks = marks_1.unionByName(suffixes.groupBy("shard").applyInArrow(lambda t: plan.scan(t), B.MARKS))
    out = new.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_cut(plan, digest), OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != B.NO_ID, F.col("doc_id")))


def suffix_dedup(docs: DataFrame, width: int = 100, gram: int = 50, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    With `digest`, kept holds the hexadecimal SHA-256 of the kept bytes.
    `gram` under `width` sets how dense the anchors lie: about one in
    (width - gram) / 2 bytes.
    """
    blocks = B.blocked(docs)
    plan = Plan(width, gram, blocks.total_bytes, hot)
    keys = blocks.frame.groupBy("block").applyInArrow(lambda t: plan.list_keys(t), B.PACKED)
    return _removed(blocks.frame, keys, blocks.frame, plan, digest)


class SuffixStore:
    """The family on disk: each batch of documents is deduplicated against those before it.

    A level is a folder of texts by block and of their packed keys by shard.
    A batch becomes a level; levels merge as long as the last is less than
    twice as large as the one after it, so n batches keep at most log2(n) of
    them. Only blocks that share an anchor with the batch are read again. A
    manifest names the levels that count; one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, width: int = 100, gram: int = 50, shards: int = 64, hot: int = HOT) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        self.version = max((int(x.removeprefix("manifest-")) for x in names if x.startswith("manifest-")), default=0)
        rules = {"form": FORM, "width": width, "gram": gram, "shards": shards}
        self.state = json.loads(spark.read.text(f"{self.folder}/manifest-{self.version:06d}").first()[0]) if self.version else rules | {"next": 0, "levels": []}
        if {k: self.state.get(k) for k in rules} != rules:
            raise ValueError("the store was made with other widths or shards, or in an older form")
        self.hot = hot

    def _read(self, level: dict, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{level['name']}/{what}")

    def _write(self, name: str, texts: DataFrame, keys: DataFrame, size: int) -> dict:
        texts.write.parquet(f"{self.folder}/{name}/texts")
        level = {"name": name, "bytes": size}
        (keys or self._listed(self._read(level, "texts"))).repartitionByRange("shard", "block").sortWithinPartitions("shard", "block").write.parquet(f"{self.folder}/{name}/keys")
        return level

    def _listed(self, texts: DataFrame) -> DataFrame:
        plan = self._plan(0)
        return texts.groupBy("block").applyInArrow(lambda t: plan.list_keys(t), B.PACKED)

    def _plan(self, new: int) -> Plan:
        x = self.state
        return Plan(x["width"], x["gram"], 0, self.hot, (x["shards"], x["shards"]), new)

    def add(self, docs: DataFrame, digest: bool = False) -> DataFrame:
        """suffix_dedup's rows for docs, all of whose documents come after those of earlier batches."""
        first, levels, blocks = self.state["next"], list(self.state["levels"]), B.blocked(docs)
        level = self._write(f"batch-{self.version + 1:06d}", blocks.frame.withColumn("block", (F.col("block") + first).cast("int")), None, blocks.total_bytes)
        new, old = self._read(level, "texts"), [self._read(x, "texts") for x in levels]
        keys = reduce(DataFrame.unionByName, [self._read(x, "keys") for x in [*levels, level]])
        top = new.agg(F.max("block")).first()[0]
        levels.append(level)
        while len(levels) > 1 and levels[-2]["bytes"] < 2 * levels[-1]["bytes"]:
            b, a = levels.pop(), levels.pop()
            both = [self._read(a, k).unionByName(self._read(b, k)) for k in ("texts", "keys")]
            levels.append(self._write(f"merged-{self.version + 1:06d}-{len(levels)}", *both, a["bytes"] + b["bytes"]))
        plan = self._plan(first)
        self.version += 1
        self.state = self.state | {"next": first if top is None else top + 1, "levels": levels}
        self.spark.createDataFrame([(json.dumps(self.state),)], "m string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version:06d}")
        return _removed(reduce(DataFrame.unionByName, [*old, new]), keys, new, plan, digest, only_marked=bool(old))


# The query's rows by DuckDB, with width = 100. Pieces of 1000 starts keep substring() short.
SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), k AS (
  SELECT r, doc_id, unnest(range(0, length(h) // 2, 1000)) AS base, h FROM d
), p AS (
  SELECT r, doc_id, base, substring(h, 2 * base + 1, 2198) AS part FROM k
), o AS (
  SELECT r, doc_id, base, part, unnest(range(0, least(1000, length(part) // 2))) AS i FROM p
), b AS (
  SELECT r, doc_id, base + i AS i, substring(part, 2 * i + 1, 2) AS byte, substring(part, 2 * i + 1, 200) AS s FROM o
), f AS (
  SELECT r, i, byte, length(s) = 200 AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS hit FROM b
), c AS (
  SELECT r, i, byte, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS opens FROM c
)
SELECT d.doc_id, count(e.byte) AS n_bytes, count(*) FILTER (e.gone) AS n_removed, count(*) FILTER (e.opens) AS n_spans,
       sha256(unhex(coalesce(string_agg(e.byte, '' ORDER BY e.i) FILTER (NOT e.gone), ''))) AS kept_sha256
FROM d LEFT JOIN e ON d.r = e.r GROUP BY d.r, d.doc_id
"""
