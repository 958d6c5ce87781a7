"""Steps of the suffix index on blocks of made texts, against every string looked up; then through Spark."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from emberseal.llm import blocks as B
from emberseal.llm import suffix_dedup as S


def texts(seed, n=40):
    """Made texts that share passages at odd places; some are copies, short, empty or hold NUL and long letters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé\0") for _ in range(r.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(k) for k in (15, 25, 40, 60)] + ["ab" * 90, "x" * 300]
    out = []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append(r.choice(out))
        elif kind < 0.25:
            out.append(prose(r.randint(0, 3)))
        else:
            parts = [prose(r.randint(0, 12)) + r.choice(shared)[r.randint(0, 20) :] for _ in range(r.randint(1, 4))]
            out.append(" ".join(parts))
    return out


def brute(all_texts, width=100):
    """Spans of every text in bytes."""
    seen, out = set(), []
    for t in all_texts:
        b = t.encode()
        cut = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in seen:
                cut[p : p + width] = True
            seen.add(s)
        out.append(cut)
    return out


def stepped(blocks, plan, lists=None):
    """The plan's steps as Spark would run them."""
    table = lambda i, ts: pa.table({"doc_id": pa.array(range(len(ts)), pa.int64()), "text": ts, "block": pa.array([i] * len(ts), pa.int32())})

    def by(tables, column):
        groups = defaultdict(list)
        for t in tables:
            for row in t.to_pylist():
                groups[row[column]].append(row)
        return {k: pa.Table.from_pylist(v, schema=tables[0].schema) for k, v in groups.items()}

    frames = {i: table(i, ts) for i, ts in enumerate(blocks)}
    none = pa.table({"block": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "round": pa.array([], pa.int32()), "marks": pa.array([], pa.binary())})
    marks = [none, *(plan.scan_keys(t) for t in by([plan.list_keys(f) for f in frames.values()], "shard").values())]
    told = by(marks, "block")
    suffixes = [plan.list_suffixes(f, told.get(i, none)) for i, f in frames.items()]
    marks += [plan.scan(t) for t in by(suffixes, "shard").values()]
    told = by(marks, "block")
    out = []
    for i, f in frames.items():
        runs, mask = plan.gone(f.column("text"), told.get(i, none))
        out += np.split(mask, runs.offs[1:-1])
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("hot,shards,piece", [(1 << 14, None, 1 << 20), (3, (40, 40), 1 << 20), (1 << 14, (3, 5), 150), (2, (1, 1), 97)])
def test_against_every_string(monkeypatch, seed, hot, shards, piece):
    monkeypatch.setattr(S, "PIECE_BYTES", piece)
    monkeypatch.setattr(S, "SCAN_STRINGS", 60)
    every = texts(seed)
    blocks = [sorted(every[i : i + 9]) for i in range(0, len(every), 9)]
    got = stepped(blocks, S.Plan(100, 50, sum(len(t.encode()) for t in every), hot, shards))
    for t, a, b in zip([t for x in blocks for t in x], got, brute([t for x in blocks for t in x]), strict=True):
        assert (a == b).all(), t


def test_levels_hold_each_suffix_once_and_in_order():
    index, rng, wide = S.LevelIndex(4, 6), np.random.default_rng(1), 6
    for _ in range(20):
        rows = np.unique(rng.integers(97, 100, (30, wide), np.uint8), axis=0)
        rows = np.concatenate([rows, np.full((len(rows), 1), 3, np.uint8)], 1).reshape(-1).view("S7")
        index.add(rows, np.arange(len(rows)))
        sizes = [len(x[0]) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
        assert all((np.sort(x[0]) == x[0]).all() for x in index.levels)
    rows = index.all()[0]
    assert len(np.unique(rows)) == len(rows)
    near = np.array([b"aaaabb\3"], "S7")
    assert index.add(near, np.zeros(1, int))[0] <= 3


def rows(spark, *texts_):
    return spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")


def kept(df):
    return {r.doc_id: bytes(r.kept).decode() for r in df.collect()}


LONG = " ".join(f"word{i}" for i in range(60))


def test_tables_of_one_kind(spark):
    assert kept(S.suffix_dedup(rows(spark, LONG))) == {0: LONG}
    assert kept(S.suffix_dedup(rows(spark, LONG, LONG, LONG))) == {0: LONG, 1: "", 2: ""}
    r = random.Random(5)
    apart = ["".join(r.choice("abcdefgh") for _ in range(300)) for _ in range(4)]
    assert kept(S.suffix_dedup(rows(spark, *apart))) == dict(enumerate(apart))
    assert kept(S.suffix_dedup(rows(spark, None, "", "short"))) == {0: "", 1: "", 2: "short"}


def test_long_text_and_many_blocks(spark, monkeypatch):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh ") for _ in range(3_000_000))
    d = rows(spark, "first " + long[1_048_000:1_049_200] + " end", long, long[:5_000] + "own")
    monkeypatch.setattr(B, "BLOCK_BYTES", 1 << 19)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.suffix_dedup(d, digest=True).collect()}
    without = long[:1_048_000] + long[1_049_200:]
    assert got[1] == (3_000_000, 1200, 1, hashlib.sha256(without.encode()).hexdigest().encode())
    assert got[2][:3] == (5_003, 5_000, 1)


@pytest.mark.parametrize("seed", [2])
def test_batches_against_a_stored_index(spark, tmp_path, seed):
    every, folder = texts(seed, 35), str(tmp_path / "store")
    want = [bytes(np.frombuffer(t.encode(), np.uint8)[~cut]) for t, cut in zip(every, brute(every), strict=True)]
    got, sizes = {}, []
    for i in range(0, 35, 7):
        store = S.SuffixStore(spark, folder, shards=5)  # read anew each time
        batch = spark.createDataFrame([(100 - i + k, t) for k, t in enumerate(every[i : i + 7])], "doc_id long, text string")
        got |= {i + r.doc_id - 100 + i: bytes(r.kept) for r in store.add(batch).collect()}
        sizes.append([x["bytes"] for x in store.state["levels"]])
    assert [got[i] for i in range(35)] == want
    assert all(a >= 2 * b for x in sizes for a, b in zip(x, x[1:], strict=False)) and max(map(len, sizes)) > 1
    assert S.SuffixStore(spark, folder, shards=5).add(batch.limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.SuffixStore(spark, folder, shards=6)


def test_copies_in_other_blocks_ship_no_suffixes():
    """What a block lists after step 1 grows with different texts: copies of them in 12 blocks add nothing."""
    r = random.Random(8)
    prose = ["".join(r.choice("abcdefgh ") for _ in range(2_000)) for _ in range(6)]
    mixed = [prose[0][:700] + prose[1][300:900], prose[2][50:400] + prose[3][:500]]
    blocks, shipped = [prose, mixed, *([*prose, *mixed] for _ in range(10))], []

    class Told(S.Plan):
        def list_suffixes(self, left, marks):
            out = super().list_suffixes(left, marks)
            shipped.append(sum(map(len, out.column("packed").to_pylist())))
            return out

    got = stepped(blocks, Told(100, 50, sum(len(t) for b in blocks for t in b)))
    assert all((a == b).all() for a, b in zip(got, brute([t for b in blocks for t in b]), strict=True))
    assert shipped[0] > 0 and shipped[1] > 0 and not any(shipped[2:])


def test_a_key_crowded_in_one_block():
    """More than hot / 64 surroundings of an anchor in a block, others of it in blocks before and after."""
    r = random.Random(4)
    passage, own = "".join(r.choice("abcdefgh") for _ in range(130)), lambda: "".join(r.choice("abcdefgh ") for _ in range(60))
    few = [own() + passage + own() for _ in range(2)]
    blocks = [[*few, own() * 3], [*few, *(own() + passage + own() for _ in range(8))], [few[0], own() + passage + own()], [own() + passage + own() for _ in range(8)]]
    blocks = [sorted(b) for b in blocks]
    got = stepped(blocks, S.Plan(100, 50, 20_000, 256))
    assert all((a == b).all() for a, b in zip(got, brute([t for b in blocks for t in b]), strict=True))
