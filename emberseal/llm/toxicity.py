"""Toxicity by a convolutional text classifier trained in numpy.

Words are lower-cased runs of letters and digits. A word's embedding is the
sum of those of two hashes, of the word and of its first PREFIX bytes, so that
inflected forms share one. Hashes that fewer than `min_rows` training rows
hold have the zero embedding, which is that of unseen words. Filters of
several widths slide over the whole text; each keeps its highest response; a
logistic layer makes the score. Training uses a bounded sample of labelled
rows (`Training.max_rows` of each class with texts of at most `max_chars`, the
ones whose hashed id comes first), Adam, and a held-back part of that sample
to stop early, to calibrate the score and to set one threshold for each
language. The model has at most `max_vocabulary` rows (4 MB), so it is
broadcast.

A score depends on nothing but the text. Thresholds by language only make
`flagged`.

Edge cases: a null or empty text gets the score of a text without words; rows
with a null doc_id are never trained on; rows that share a doc_id each get
their own score; null or unknown languages take the common threshold; without
labels of both classes every score is the share of toxic labels (0 if none);
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T

PADS = 3
PREFIX = 4
#: Everything in ASCII but letters and digits parts words.
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Training:
    max_rows: int = 4000
    max_chars: int = 40_000
    max_vocabulary: int = 1 << 16
    min_rows: int = 3
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 16
    dim: int = 16
    epochs: int = 12
    batch: int = 32
    rate: float = 0.01
    held_back: float = 0.2
    seed: int = 7


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    embedding: np.ndarray  # a row for each
    filters: dict[int, np.ndarray]  # width -> (width, dim, filters)
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    common: float = 0.5
    by_lang: dict[str, float] | None = None


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their starts (words x 2), and the first word of each row."""
    lower = T.LOWER[data]
    s, e, first = T.words(lower, offs, _PARTS)
    prefix = T.prefix_hash(lower)
    return np.stack([T.mix(T.range_hash(prefix, s, e)), T.mix(~T.range_hash(prefix, s, np.minimum(s + PREFIX, e)))], 1), first


def rows_of(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Embedding rows of the hashes; len(vocabulary) for unknown ones."""
    if not len(vocabulary):
        return np.zeros(hashes.shape, np.int32)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary)).astype(np.int32)


def _padded(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with PADS empty words after each row; start and end of each row's places."""
    n = np.diff(first)
    out = np.full((len(ids) + PADS * len(n), 2), pad, np.int32)
    rows = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(ids)) + PADS * rows] = ids
    start = first[:-1] + PADS * np.arange(len(n))
    return out, start, start + np.maximum(n, 1)


def _pooled(out: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.maximum.reduceat(out, np.stack([start, end], 1).reshape(-1), axis=0)[::2]


class Scorer:
    """Filter responses by word are tabled once, so a text costs lookups and sums."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.tables = {w: [np.vstack([model.embedding @ f, np.zeros((1, f.shape[1]), np.float32)]) for f in filters] for w, filters in model.filters.items()}

    def features(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        padded, start, end = _padded(ids, first, len(self.model.vocabulary))
        word, stem = np.ascontiguousarray(padded[:, 0]), np.ascontiguousarray(padded[:, 1])
        pooled = []
        for w, tables in self.tables.items():
            out = tables[0][word] + tables[0][stem]
            for o in range(1, w):
                out[:-o] += tables[o][word[o:]]
                out[:-o] += tables[o][stem[o:]]
            pooled.append(_pooled(out, start, end))
        return np.maximum(np.concatenate(pooled, 1) + self.model.bias, 0)

    def raw(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.features(ids, first) @ self.model.dense + self.model.offset

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = self.raw(ids, first).astype(float) * self.model.slope + self.model.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _step(model: Model, ids: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted log loss over one batch."""
    padded, start, end = _padded(ids, first, len(model.vocabulary))
    table = np.vstack([model.embedding, np.zeros((1, model.embedding.shape[1]), np.float32)])
    x = table[padded[:, 0]] + table[padded[:, 1]]
    pooled, places = [], {}
    for w, filters in model.filters.items():
        out = x @ filters[0]
        for o in range(1, w):
            out[:-o] += x[o:] @ filters[o]
        best = _pooled(out, start, end)
        where = np.empty(best.shape, np.int64)
        for i, (a, b) in enumerate(zip(start, end, strict=True)):
            where[i] = a + out[a:b].argmax(0)
        pooled.append(best)
        places[w] = where
    h = np.concatenate(pooled, 1) + model.bias
    live = h > 0
    z = np.where(live, h, 0) @ model.dense + model.offset
    dz = (weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / weight.sum()).astype(np.float32)
    dh = np.where(live, dz[:, None] * model.dense, 0).astype(np.float32)
    grads = {"dense": np.where(live, h, 0).T @ dz, "offset": np.array(dz.sum()), "bias": dh.sum(0)}
    de = np.zeros_like(table)
    k = 0
    for w, filters in model.filters.items():
        n = filters.shape[2]
        d, where = dh[:, k : k + n], places[w]
        g = np.zeros_like(filters)
        for o in range(w):
            g[o] = np.einsum("rfd,rf->df", x[where + o], d)
            share = (d[:, :, None] * filters[o].T[None]).reshape(-1, filters.shape[1])
            for side in (0, 1):
                np.add.at(de, padded[where + o, side].reshape(-1), share)
        grads[f"f{w}"] = g
        k += n
    grads["embedding"] = de[:-1]
    return grads


def train(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], rules: Training) -> Model:
    """texts: hashes (words x 2) of each labelled row."""
    rng = np.random.default_rng(rules.seed)
    share = float(y.mean()) if len(y) else 0.0
    shape = len(rules.widths) * rules.filters
    seen, held_by = np.unique(np.concatenate([np.unique(t) for t in texts] or [np.zeros(0, np.uint64)]), return_counts=True)
    if len(seen) > rules.max_vocabulary:
        rules_min = max(rules.min_rows, int(np.partition(held_by, -rules.max_vocabulary)[-rules.max_vocabulary]) + 1)
    else:
        rules_min = rules.min_rows
    vocabulary = seen[held_by >= rules_min]
    texts = [rows_of(vocabulary, t) for t in texts]
    model = Model(
        vocabulary,
        rng.normal(0, 0.05, (len(vocabulary), rules.dim)).astype(np.float32),
        {w: rng.normal(0, 0.5 / np.sqrt(w), (w, rules.dim, rules.filters)).astype(np.float32) for w in rules.widths},
        np.zeros(shape, np.float32),
        rng.normal(0, 0.1, shape).astype(np.float32),
        0.0,
        by_lang={},
    )
    if not 0 < share < 1:
        model.dense[:] = 0
        model.shift = float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0)
        return model
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    held[order[: max(1, int(len(y) * rules.held_back))]] = True
    fit = np.flatnonzero(~held)
    flat = lambda rows: (np.concatenate([texts[i] for i in rows] or [np.zeros((0, 2), np.int32)]), np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])]).astype(np.int64))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    state: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    best, kept, steps = np.inf, None, 0
    arrays = lambda: {"embedding": model.embedding, "dense": model.dense, "bias": model.bias, **{f"f{w}": f for w, f in model.filters.items()}}
    test = np.flatnonzero(held)
    parts = [test[i : i + 128] for i in range(0, len(test), 128)]
    epochs = max(rules.epochs, min(60, 12_000 // max(1, len(fit))))
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), rules.batch):
            rows = fit[i : i + rules.batch]
            grads = _step(model, *flat(rows), y[rows], weight[rows])
            steps += 1
            for name, a in arrays().items():
                g = grads[name]
                m, v = state.setdefault(name, (np.zeros_like(a), np.zeros_like(a)))
                if name == "embedding":  # only the rows that were seen
                    seen = np.flatnonzero(g.any(1))
                    m[seen] = 0.9 * m[seen] + 0.1 * g[seen]
                    v[seen] = 0.99 * v[seen] + 0.01 * g[seen] ** 2
                    a[seen] -= rules.rate * m[seen] / (np.sqrt(v[seen]) + 1e-8)
                else:
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    a -= rules.rate * m / (np.sqrt(v) + 1e-8)
            model.offset -= rules.rate * float(grads["offset"])
        scorer = Scorer(model)
        z = np.concatenate([scorer.raw(*flat(p)) for p in parts])
        loss = float(np.sum(weight[test] * np.logaddexp(0, np.where(y[test] == 1, -z, z))) / weight[test].sum())
        if loss < best:
            best, kept = loss, ({k: a.copy() for k, a in arrays().items()}, model.offset)
    saved, model.offset = kept
    model.embedding, model.dense, model.bias = saved["embedding"], saved["dense"], saved["bias"]
    model.filters = {w: saved[f"f{w}"] for w in rules.widths}
    scorer = Scorer(model)
    z = np.concatenate([scorer.raw(*flat(p)) for p in parts]).astype(float)
    _calibrate(model, z, y[test].astype(float), weight[test].astype(float))
    scores = 1 / (1 + np.exp(-np.clip(z * model.slope + model.shift, -40, 40)))
    model.common = _threshold(scores, y[test])
    tongues = np.array([x or "" for x in langs], object)[test]
    for x in sorted(set(tongues)):
        own = tongues == x
        if x and (y[test][own] == 1).sum() >= 20 and (y[test][own] == 0).sum() >= 20:
            model.by_lang[x] = _threshold(scores[own], y[test][own])
    return model


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Platt scaling by Newton steps, towards smoothed labels."""
    t = np.where(y == 1, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        r, s = weight * (p - t), weight * p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(r * z).sum(), r.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    if a > 0:
        model.slope, model.shift = float(a), float(b)


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 score, midway to the next score below it."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order] == 1)
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + max(1, hit[-1]))
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k])


def in_training(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = T.as_bytes(batch.column("text"))
        hashes, first = token_hashes(data, offs)
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array([hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["lang", "toxic", "ids"])


def fit(docs: DataFrame, labels: DataFrame, rules: Training | None = None) -> Model:
    rules = rules or Training()
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & in_training(F.col("doc_id"))).dropDuplicates(["doc_id"])
    each = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.max_rows) for c in (0, 1)]
    chosen = each[0].unionByName(each[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.length("text") <= rules.max_chars)
    # 2 * max_rows ids and labels: a bounded side.
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "lang", "toxic", "text")
    got = rows.orderBy("doc_id").select("lang", "toxic", "text").mapInArrow(_listed, "lang string, toxic int, ids binary").toArrow()
    ids = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in got.column("ids").to_pylist()]
    return train(ids, np.array(got.column("toxic").to_pylist(), np.int64), got.column("lang").to_pylist(), rules)


def toxicity(docs: DataFrame, labels: DataFrame, rules: Training | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), flagged (score >= its language's threshold)."""
    model = fit(docs, labels, rules)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        own, common = shared.value.by_lang or {}, shared.value.common
        for batch in batches:
            data, offs = T.as_bytes(batch.column(2))
            for a, b in T.pieces(offs, 1 << 20):
                hashes, first = token_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                score = scorer.score(rows_of(shared.value.vocabulary, hashes), first)
                limit = np.array([own.get(x, common) for x in batch.column(1).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(score >= limit)], names=["doc_id", "score", "predicted", "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, score double, predicted int, flagged boolean")
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "flagged")
