"""Entropy spans against plain Python; long runs take time in proportion."""

import math
import random
import re
import string
import time
from collections import Counter

from emberseal.llm import secret_scan as S

LETTERS, DIGITS = string.ascii_letters, string.digits


def entropy(x, window=20):
    bits = lambda w: -sum(c / window * math.log2(c / window) for c in Counter(w).values())
    return max(bits(x[i : i + window]) for i in range(len(x) - window + 1))


def expected(text):
    rules, out = S.EntropyRules(), []
    base = [m.span() for m in re.finditer(r"[0-9a-f]{24,}", text)]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        x = m[0]
        least = next(b for p, b in rules.classes if re.search(p, x))
        if not any(re.search(p, x) for p in rules.allow) and entropy(x) >= least and not any(a < m.end() and z > m.start() for a, z in base):
            out.append(m.span())
    return out


def test_entropy_spans(spark):
    r = random.Random(4)
    made = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    kinds = (LETTERS, LETTERS + DIGITS, DIGITS, "0123456789abcdef", "ABCDEF0123456789", LETTERS + DIGITS + "+/_=-", "ab", "abcdefgh")
    texts = [" é\n".join([made(r.choice(kinds), r.randint(15, 60)) for _ in range(r.randint(0, 12))] + ["internationalizationwordsonly", "/usr/local/lib/python3/site-packages", "getElementByIdentifierName", "A-very-long-title-of-2024-words"]) for _ in range(150)]
    got = {x.doc_id: [tuple(s) for s in x.entropy] for x in S.secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 300


def test_letters_alone_are_found(spark):
    key = "kQpLmXvRtZwBnYcHsJdFgTqW"
    words = ["internationalizationwordsonly", "INTERNATIONALIZATIONWORDSONLY", "Words-Joined-By-Signs-Here", "abstractSingletonProxyFactoryBean", "path/to/some/file/name/2024/07"]
    d = spark.createDataFrame([(0, f"key {key} end"), *((i + 1, w) for i, w in enumerate(words))], "doc_id long, text string")
    assert {x.doc_id: len(x.entropy) for x in S.secret_scan(d).collect()} == {0: 1, **{i + 1: 0 for i in range(len(words))}}


def test_long_runs(spark):
    n = 1_000_000
    runs = ["abcdefgh" * (n // 8), "=" * n, "a-" * (n // 2), "ab" * (n // 2), "-" * n + "1", "\n".join("%064x" % (i * 2**200 + i) for i in range(n // 65))]
    d = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string").repartition(1)
    began = time.time()
    got = {x.doc_id: x for x in S.secret_scan(d).collect()}
    assert time.time() - began < 30
    assert [len(got[i].entropy) for i in range(6)] == [0] * 6 and len(got[5].hex) == n // 65
