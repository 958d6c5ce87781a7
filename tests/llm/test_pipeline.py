"""Stages of the pipeline on small tables with nulls and repeated rows."""

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, id long"
LINE = "the same long line stands in all of these texts"
LONG = " ".join(f"word{i}" for i in range(80))


def table(spark, *rows):
    return spark.createDataFrame([(i, t, "en", None, 5, "x", 1) for i, t in rows], SCHEMA)


def told(df):
    assert tuple(df.columns) == P.COLUMNS
    return sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)


def test_lines(spark):
    d = table(spark, (1, LINE + "\nown"), (2, LINE), (3, LINE), (4, None), (5, ""), (None, "rest\n" + LINE), (6, "a"), (6, "a"))
    want = [(1, "own", 3), (3, LINE, 5), (4, None, 5), (5, "", 5), (None, "rest", 4), (6, "a", 5), (6, "a", 5)]
    assert told(P.lines(spark, d, "")) == sorted(want, key=str)


def test_near(spark):
    d = table(spark, (1, LONG), (1, LONG), (2, LONG + " more"), (3, None), (4, "a b"), (4, "a"))
    assert told(P.near(spark, d, "")) == sorted([(1, LONG, 5), (3, None, 5), (4, "a", 5)], key=str)
    assert told(P.near(spark, d.limit(0), "")) == []


def test_rows_without_id_are_documents_of_their_own(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    passage = "where did the old grey ship go when the war was over"
    d = table(spark, (None, a), (None, a), (None, b), (None, c + " " + passage), (1, a + " more"), (2, b + " more"), (3, "own " + c[::-1]), (None, None))
    kept = {(i, t) for i, t, _ in told(P.near(spark, d, ""))}
    assert kept == {(None, a), (None, b), (None, c + " " + passage), (3, "own " + c[::-1]), (None, None)}
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = told(P.decontaminated(spark, d, str(tmp_path)))
    assert len(clean) == 7 and not any(t and passage in t for _, t, _ in clean)
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = P.quality(spark, whole, "").orderBy("doc_id").first().text
    rules = table(spark, (None, good), (None, "x"), (7, good), (7, "y"))
    assert [(i, t) for i, t, _ in told(P.quality(spark, rules, ""))] == [(7, good), (None, good)]
