"""Nulls, empty and repeated rows, clashing columns and empty tables, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

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

LONG = " ".join(f"word{i}" for i in range(200))
ROWS = [(1, LONG), (2, LONG), (2, LONG), (3, None), (None, LONG), (4, ""), (5, "a\n" * 50), (6, "Licensed under the Apache License, Version 2.0."), (7, "token = abcdef123456"), (8, LONG + " more")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, c long, n long, band long, far double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, 1, 1, 1, 1, 1, 1.0) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(20, 40))), (2, None), (3, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")


OPS = {
    "substring": (lambda d, i, l: substring_dedup(d), 10),
    "packing": (lambda d, i, l: pack(d, Q.tokenizer_files()).select("doc_id", "start").filter("start = 0"), 10),
    "toxicity": (lambda d, i, l: toxicity(d, l), 10),
    "lines": (lambda d, i, l: line_dedup(d), 10),
    "near": (lambda d, i, l: near_dedup(d), 10),
    "suffix": (lambda d, i, l: suffix_dedup(d), 10),
    "license": (lambda d, i, l: license_scan(d), 1),
    "decontaminate": (lambda d, i, l: decontaminate(d, i), 4),
    "quality": (lambda d, i, l: quality_rules(d), 10),
    "secrets": (lambda d, i, l: secret_scan(d), 10),
}


@pytest.mark.parametrize("name", OPS)
def test_edges(docs, items, labels, name):
    run, rows = OPS[name]
    assert run(docs, items, labels).count() == rows


@pytest.mark.parametrize("name", OPS)
def test_empty(docs, items, labels, name):
    assert OPS[name][0](docs.limit(0), items, labels).count() == 0


def test_substring_counts(docs):
    got = {(r.doc_id, r.n_removed) for r in substring_dedup(docs).collect()}
    # The null id comes first, so every later copy goes whole.
    assert {(None, 0), (1, 200), (2, 200), (3, 0), (8, 200)} <= got


def test_near_groups(docs):
    got = {r.doc_id: r.component_id for r in near_dedup(docs, 3, 85).collect()}
    assert got[1] is None and got[8] is None and got[5] == 5


def test_lines_keep_last(spark):
    line = "  The same long line of text  "
    d = spark.createDataFrame([(i, line + "\nown " + str(i)) for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup(d).collect()}
    assert got[0] == "own 0" and got[3] == line + "\nown 3"


def test_entropy_span(spark):
    d = spark.createDataFrame([(1, "key kP9x2LmQ7vR4tZ8wB3nY6c end"), (2, "internationalizationwordsonly")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.entropy] for r in secret_scan(d).collect()}
    assert got == {1: [(4, 26)], 2: []}


def test_changed_slots(spark):
    item = spark.createDataFrame([(1, "if the train with 40 seats leaves at 9 and the bus with 40 seats follows it")], "item_id long, text string")
    same = "if the train with 70 seats leaves at 5 and the bus with 70 seats follows it"
    d = spark.createDataFrame([(1, same), (2, "nothing of the kind stands in this text at all today")], "doc_id long, text string")
    got = decontaminate(d, item).collect()
    assert [r.doc_id for r in got] == [1] and got[0].n_templates > 0


def leaks(spark, items, texts, **options):
    """doc_id to item_ids of the texts that hold the items."""
    item = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: list(r.item_ids) for r in decontaminate(d, item, **options).collect()}


def test_verbatim_items_of_few_literals_or_words(spark):
    items = ["Compute 12 + 7 * 3 - 45 / 9 + 81 - 6 * 2 = ?", "Which Old River Flows Through The Great Green Valley Of Kings", "What is the capital of Australia?", "one two three", "  ", "to be"]
    texts = [f"Some words before. {items[0]} And after", f"Read this: {items[1]}", f"so. {items[2]} Canberra", "Compute 13 + 8 * 4 - 46 / 8 + 82 - 7 * 3 = ?", "What is the capital city of Australia?", "One, two, three to go", "one two four three"]
    assert leaks(spark, items, texts) == {0: [0], 1: [1], 2: [2], 5: [3]}
    assert leaks(spark, ["a b c d e f g", "x y z u v w"], ["1 a b c d e f g", "1 x y z u v w 2", "a b c d e f x"]) == {0: [0], 1: [1]}


def test_verbatim_whatever_the_capitals(spark):
    german = "Die Mutter kauft am Montag frische Brötchen und der Vater holt am Dienstag Milch aus dem Laden im Dorf"
    items = [german, "Where do the small grey birds sleep tonight"]
    texts = [german.lower(), f"he asked me, {items[1]}", f"and {items[1].lower()} he said", german.upper().replace("MILCH", "SAFT").replace("MONTAG", "SONNTAG")]
    assert leaks(spark, items, texts) == {0: [0], 1: [1], 2: [1], 3: [0]}


def test_suffix_round_trip(spark):
    t = LONG.encode()
    d = spark.createDataFrame([(1, LONG), (2, "x" + LONG + "y")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup(d).collect()}
    assert got == {1: t, 2: b"xy"}
    assert hashlib.sha256(got[1]).hexdigest() == {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup(d, digest=True).collect()}[1]


def test_quality_null(docs):
    got = quality_rules(docs).filter(F.col("doc_id") == 3).first()
    assert got.base_failed and not got.kept and got.n_words == 0


def test_line_of_most_documents(spark):
    """A line in so many documents that its rows are salted."""
    from emberseal.llm.line_dedup import SALTS, line_dedup

    hot, n = "this line is in nearly all the documents", 5 * SALTS
    rows = [(i, f"{hot}\nown line of document number {i}" if i % 7 else f"own line of document number {i}") for i in range(n)]
    got = {r.doc_id: r.kept_text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    last = max(i for i in range(n) if i % 7)
    assert got == {i: text if i == last else f"own line of document number {i}" for i, text in rows}


PROSE = "the boat left the small harbour before noon and nobody on the quay looked up from the nets they were mending while gulls cried over it".split()


def amid(notice, n):
    """The notice after and before n words of prose, in one line."""
    around = " ".join(PROSE[i % len(PROSE)] for i in range(n))
    return f"{around} {notice} {around}"


def test_notices_amid_long_lines(spark):
    # None is word for word an entry of TEMPLATES.
    notices = {"mit": "The sources may be used under the MIT licence.", "apache": "You can use this library under the Apache License 2.0.", "lgpl": "this program is licensed under the GNU Lesser General Public License"}
    rows = [(f, n, amid(t, n)) for f, t in notices.items() for n in (20, 100, 200, 3000)]
    d = spark.createDataFrame([(i, "first line\n" + t) for i, (_, _, t) in enumerate(rows)] + [(99, amid("they asked for permission to enter", 200))], "doc_id long, text string")
    got = {r.doc_id: (r.paragraph, r.family) for r in license_scan(d).filter("family <> 'unknown'").collect()}
    assert got == {i: (1, f) for i, (f, _, _) in enumerate(rows)}


def test_notices_of_all_languages_and_unknown_ones(spark):
    want = {
        "The code is GPLv3.": "gpl", "Distributed under the terms of the GNU GPL v2 or later.": "gpl", "Released under CC0 1.0 Universal.": "public_domain", "MIT-Lizenz": "mit",
        "Lizenziert unter Apache 2.0": "apache", "Ce logiciel est sous licence MIT": "mit", "Distribuido bajo la licencia MIT": "mit", "ISC License": "unknown",
        "The driver lost the licence after a long trial": "unknown", "xlicensey": "unknown", "no such word here": None,
    }
    d = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(d).collect()}
    assert {i: got[i].family if i in got else None for i in range(len(want))} == dict(enumerate(want.values()))
    assert all(r.similarity == 0 and not r.confirmed and 0 <= r.probability <= 1 for r in got.values() if r.family == "unknown")
