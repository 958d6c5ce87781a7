"""Each query's rows over a whole small table against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest

from emberseal.llm import queries as Q

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"select doc_id, text from '{D}/documents.parquet' order by doc_id").fetchall()
    assert len({i for i, _ in rows}) == len(rows)
    return {i: t or "" for i, t in rows}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(spark, name, *columns):
    return {r[0]: tuple(r)[1:] for r in Q.queries()[name](spark, D).select("doc_id", *columns).collect()}


def test_op1(spark, texts):
    words = {i: WORD.findall(t) for i, t in texts.items()}
    first = {}
    for i, w in words.items():
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want[i] = (len(w), len(gone), sha(" ".join(x for q, x in enumerate(w) if q not in gone)))
    assert rows(spark, "op1_substring_dedup", "n_words", "n_removed", "kept_sha256") == want


def test_op2(spark, texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(str(Q.tokenizer_files().tokenizer))
    ids = {i: [*made.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in Q.op2_packing(spark, D).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for i, all_ids in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(all_ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in all_ids[at : at + r.length]))
            at += r.length
        assert at == len(all_ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_op3(spark, texts):
    got = rows(spark, "op3_toxicity", "held_out", "score", "predicted")
    assert got.keys() == texts.keys()
    for i, (held, score, predicted) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == int(score >= 0.5)


def test_op4(spark, texts):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    want = {}
    for i, t in texts.items():
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        want[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert rows(spark, "op4_line_dedup", "n_lines", "n_dropped", "kept_sha256") == want


def test_op5(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[p : p + 3]) for p in range(max(len(w) - 2, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    assert rows(spark, "op5_near_dedup", "n_shingles", "component_id", "kept") == want


def test_op6(spark, texts):
    seen, want = set(), {}
    for i, t in texts.items():
        b, end, spans, kept, cut = t.encode(), 0, 0, [], bytearray(len(t.encode()))
        for p in range(len(b) - 99):
            s = hashlib.blake2b(b[p : p + 100], digest_size=16).digest()
            if s in seen:
                spans += p > end or not end
                cut[max(p, end) : p + 100] = b"\1" * (p + 100 - max(p, end))
                end = p + 100
            seen.add(s)
        kept = bytes(x for x, c in zip(b, cut) if not c)
        want[i] = (len(b), len(b) - len(kept), spans, sha(kept))
    assert rows(spark, "op6_suffix_dedup", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op9(spark, texts):
    want = {}
    for i, t in texts.items():
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        threes = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        again = len({q for p in range(len(w) - 2) if threes[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)})
        want[i] = (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), dup, again, len(w) < 50 or 100 * again > 50 * len(w))
    got = rows(spark, "op9_quality_rules", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {i: r[:-1] for i, r in got.items()} == want
    assert not any(r[-1] for r in got.values() if r[-2])


# The base patterns, the group that is measured, its least length.
BASE = {
    "assign": (r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def test_op10(spark, texts):
    got = rows(spark, "op10_secret_scan", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        found = [(m.start(), n, kind, m.end()) for n, (kind, (p, g, least)) in enumerate(BASE.items()) for m in re.finditer(p, t) if len(m[g]) >= least]
        listed = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
        assert got[i][:4] == (*(sum(f[2] == k for f in found) for k in BASE), sha(",".join(listed)))
        assert [s for s in got[i][4].split(",") if s and not s.startswith("entropy")] == listed


def test_op8_finds_passages(spark, texts):
    """Documents that hold eight words of a benchmark item in a row, cases and outer punctuation apart."""
    edge = "\"'()[]{}.,;:!?“”„‘’«»¿¡"
    words = lambda t: [w for w in (x.strip(edge).lower() for x in WORD.findall(t)) if w]
    items = [words(t or "") for (t,) in duckdb.sql(f"select text from '{D}/benchmark.parquet'").fetchall()]
    digits = re.compile("[0-9]")
    windows = {tuple(w[p : p + 8]) for w in items for p in range(len(w) - 7)}
    plain = {w for w in windows if not any(digits.match(x) for x in w)}
    hit = lambda t, known: any(tuple(w[p : p + 8]) in known for w in [words(t)] for p in range(len(w) - 7))
    got = rows(spark, "op8_decontaminate", "n_windows")
    assert {i for i, r in got.items() if r[0]} <= {i for i, t in texts.items() if hit(t, windows)}
    found_plain = {i for i, t in texts.items() if hit(t, plain)}
    assert found_plain and found_plain <= got.keys()


def test_pipeline(spark, texts):
    import corpus_pipeline as P

    docs, before = spark.read.parquet(f"{D}/documents.parquet"), set(texts)
    for name, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, D).toPandas(), docs.schema)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= before and len(now) == docs.count(), name
        before = now
    want = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in P.packed(spark, docs, D).collect()}
    got = P.run(spark, D)
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in got.collect()} == want
