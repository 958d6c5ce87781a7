"""Packing against the exhaustive optimum, thresholds against whole sorted lists, held-out toxicity."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np

from emberseal.llm import packing as P
from emberseal.llm import quality_rules as R
from emberseal.llm import queries as Q


def test_cheapest_plan():
    r, rules = random.Random(6), P.Packing(size=256)
    padding = lambda n: 0 if n & (n - 1) == 0 else rules.size - n
    for _ in range(200):
        at, cost = [0], [0]
        for _ in range(r.randint(1, 60)):
            at.append(at[-1] + r.randint(1, r.choice((8, 64, 256))))
            cost.append(r.choice((0, rules.sentence_cost, rules.inner_cost)))
        cost[-1] = 0
        step = lambda j, i: padding(at[i] - at[j]) + cost[i] + rules.sequence_cost  # noqa: E731, B023
        best = [0] + [math.inf] * (len(at) - 1)
        for i in range(1, len(at)):
            best[i] = min(best[j] + step(j, i) for j in range(i) if at[i] - at[j] <= rules.size)
        cuts = [at.index(x) for x in P.best_cuts(np.array(at), np.array(cost), rules)]
        assert cuts[0] == 0 and cuts[-1] == len(at) - 1
        assert all(at[b] - at[a] <= rules.size for a, b in zip(cuts, cuts[1:], strict=False))
        assert sum(step(a, b) for a, b in zip(cuts, cuts[1:], strict=False)) == best[-1]


def test_thresholds(spark):
    r, rows = random.Random(8), []
    for lang, source, n in (("en", "a", 300), ("en", "b", 40), ("de", "a", 3), (None, "a", 60), ("fr", None, 1)):
        rows += [(i, lang, source, *(60 + r.randrange(200), 300 + r.randrange(900), r.randrange(9), r.randrange(4), r.randrange(30), 4 + r.randrange(20), r.randrange(9), r.randrange(40))) for i in range(n)]
    rows.append((0, "en", "c", 10, 50, 0, 0, 0, 1, 0, 0))  # fails the base rule
    got = {(x.lang, x.source): x.limits.asDict() for x in R.thresholds(spark.createDataFrame(rows, R.STATS)).collect()}
    names = ("doc_id", "lang", "source", *R.COUNTS)
    values = defaultdict(lambda: defaultdict(list))
    for row in rows[:-1]:
        d = dict(zip(names, row, strict=True))
        for m, (e, _, _) in R.MEASURES.items():
            a, b = e.split(" / ")
            for group in (("own", d["lang"], d["source"]), ("lang", d["lang"]), ("all",)):
                values[group][m].append(d[a] / d[b])

    def limit(x, slack):
        q = lambda f: sorted(x)[math.ceil(f * len(x)) - 1]
        return q(0.5) + R.SPREADS * max(q(0.75) - q(0.5), slack)

    assert got.keys() == {g[1:] for g in values if g[0] == "own"}
    for (lang, source), limits in got.items():
        for m, (_, slack, prior) in R.MEASURES.items():
            want = prior
            for group in (("all",), ("lang", lang), ("own", lang, source)):
                x = values[group][m]
                want = (len(x) * limit(x, slack) + R.PRIOR_ROWS * want) / (len(x) + R.PRIOR_ROWS)
            assert abs(limits[m] - want) < 0.02, (lang, source, m)


def test_no_rows_lean_on_the_prior(spark):
    stats = spark.createDataFrame([(1, "en", "a", 10, 50, 0, 0, 0, 1, 0, 0)], R.STATS)
    assert R.thresholds(stats).count() == 0
    assert R.thresholds(stats.limit(0)).count() == 0


def test_held_out_toxicity(spark):
    d = "/root/testdata/sf0.01"
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet' where toxic in (0, 1)").fetchall())
    rows = [(r.score, toxic[r.doc_id], r.flagged) for r in Q.op3_toxicity(spark, d).collect() if r.held_out and r.doc_id in toxic]
    bad, good = [s for s, t, _ in rows if t], [s for s, t, _ in rows if not t]
    auc = sum((x > y) + 0.5 * (x == y) for x in bad for y in good) / (len(bad) * len(good))
    assert auc > 0.75, auc
