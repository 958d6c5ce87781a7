"""Empty and clashing side tables, one very long text, and the pipeline's stages on odd rows."""

import pytest

import corpus_pipeline as P
from emberseal.llm import queries as Q
from emberseal.llm.decontaminate import decontaminate
from emberseal.llm.license_scan import license_scan
from emberseal.llm.line_dedup import line_dedup
from emberseal.llm.near_dedup import near_dedup
from emberseal.llm.packing import pack
from emberseal.llm.quality_rules import quality_rules
from emberseal.llm.secret_scan import secret_scan
from emberseal.llm.substring_dedup import substring_dedup
from emberseal.llm.suffix_dedup import suffix_dedup
from emberseal.llm.toxicity import toxicity

PASSAGE = " ".join(f"p{i}" for i in range(30))
LONG = " ".join(f"w{i}" for i in range(150_000)) + " " + PASSAGE
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(1, LONG, "en", "web", 9), (2, LONG, None, "web", 9), (3, "short " + PASSAGE, "en", None, 9), (4, None, None, None, None), (None, "", "de", "web", 0), (5, "Released under the MIT License.\ntoken = abcdef123456", "en", "web", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    """The benchmark with columns named like those used inside."""
    names = "item_id long, text string, doc_id long, text_hash long, place int, n int, slots int, t long, item long, theirs string, p string, words string, lang string"
    return spark.createDataFrame([(7, PASSAGE, 1, 1, 1, 1, 1, 1, 1, "x", "x", "x", "en")], names)


def test_empty_sides(spark, docs, items):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontaminate(docs, items.limit(0)).count() == 0
    got = toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and {r.score for r in got} == {got[0].score} and 0 <= got[0].score <= 1
    one_class = spark.createDataFrame([(1, 1, 1)], labels.schema)
    assert toxicity(docs, one_class).count() == len(ROWS)


def test_clashing_sides(spark, docs, items):
    assert {r.doc_id: (list(r.item_ids), r.n_windows) for r in decontaminate(docs, items).collect()} == {1: ([7], 23), 2: ([7], 23), 3: ([7], 23)}
    labels = spark.createDataFrame([(3, 1, 1, "x", "y", 0.5, True), (5, 0, 0, "x", "y", 0.5, True)], "doc_id long, quality int, toxic int, text string, lang string, score double, held_out boolean")
    assert toxicity(docs, labels).count() == len(ROWS)


def test_one_long_text(docs, items):
    n = len(ROWS)
    words = len(LONG.split())
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(docs).collect()}[2] == (words, words)
    tokens = {}
    for r in pack(docs, Q.tokenizer_files()).collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens[1] == tokens[2] > words
    assert {r.doc_id: r.n_dropped for r in line_dedup(docs, 20, 2).collect()}[1] == 1
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs).collect()}
    assert near[2] == (near[1][0], 1) and near[1][0] == words - 4
    assert {r.doc_id: r.n_removed for r in suffix_dedup(docs).collect()}[2] == len(LONG)
    assert {r.doc_id: r.n_words for r in quality_rules(docs).collect()}[1] == words
    assert secret_scan(docs).count() == n and license_scan(docs).filter("family = 'mit'").count() == 1


def test_stages_on_odd_rows(spark, docs, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert P.packed(spark, empty, "").count() == 0
    assert sorted(r.doc_id for r in P.quality(spark, docs, "").collect()) in ([1], [1, 2], [2], [])
    left = [r.doc_id for r in P.decontaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == [4, 5, None]
    pieces = P.packed(spark, docs.filter("doc_id is null or doc_id > 2"), "").collect()
    assert {(r.doc_id, r.doc_tokens) for r in pieces if r.doc_id in (4, None)} == {(4, 1), (None, 1)}
