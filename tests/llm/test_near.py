"""Links of groups whose members are alike, against all pairs; band rows and estimates."""

import random
from itertools import combinations

import numpy as np
import pytest

from emberseal.llm import near_dedup as N


def edited(seed, groups=3, size=70, words=90):
    """Groups of texts with some words changed; in the first, few are as near as the threshold asks."""
    r, out = random.Random(seed), []
    for g, most in zip(range(groups), (6, 3, 1), strict=True):
        base = [f"g{g}w{r.randrange(500)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0 if g else 2, most)):
                w[r.randrange(words)] = f"n{r.randrange(4)}"
            out.append(" ".join(w))
    r.shuffle(out)
    return out


def brute(texts, n, percent):
    sets = [{tuple(t.split()[p : p + n]) for p in range(len(t.split()) - n + 1)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed,percent", [(1, 85), (2, 80)])
def test_groups(spark, monkeypatch, seed, percent):
    monkeypatch.setattr(N, "BLOCK", 16)
    texts = edited(seed)
    want = brute(texts, 3, percent)
    assert 3 < len(set(want)) < 100
    got = {r.doc_id: r.component_id for r in N.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, percent).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_blocks_find_every_link():
    """The second round's task, on texts of which some link and most do not."""
    import pyarrow as pa

    texts = edited(4)
    sets = [set(x.tolist()) for x in N.shingle_sets(*N.T.as_bytes(pa.array(texts)), 3)]
    rows = [{"doc_id": i, "c": i, "rest": i % 2 == 0, "text": t, "centre": 0, "i": 0, "j": 0} for i, t in enumerate(texts)]
    out = N._across(3, 85)(pa.Table.from_pylist(rows)).to_pylist()
    want = {(a, b) for a in range(0, len(texts), 2) for b in range(1, len(texts), 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in out} == want and want


def test_bands_follow_the_threshold():
    assert [N.band_rows(p) for p in (85, 80, 50)] == [5, 4, 2]
    with pytest.raises(ValueError):
        N.band_rows(5)


def test_estimates_are_near_and_short_ones_too():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.85, 1.0):
        gaps = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)
            own = lambda: np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 400 - len(both), dtype=np.uint64)]) * np.uint64(2))  # noqa: E731, B023
            a, b = own(), own()
            ra, rb = N.registers(a)[None], N.registers(b)[None]
            size = (np.array([len(a)]), np.array([len(b)]))
            true = len(both) / (len(a) + len(b) - len(both))
            gaps.append([N.estimate(ra, rb, size)[0][0] - true, N.estimate(N.short(ra), N.short(rb), size)[0][0] - true])
        assert np.abs(np.mean(gaps, 0)).max() < 0.03 and np.abs(gaps).max() < 0.2
