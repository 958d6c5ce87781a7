"""A training corpus from `documents`: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir); docs has the columns of `documents`.
All but the last return these columns, for the documents they keep.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberseal.llm.decontaminate import decontaminate
from emberseal.llm.line_dedup import line_dedup
from emberseal.llm.near_dedup import near_dedup
from emberseal.llm.packing import pack
from emberseal.llm.quality_rules import quality_rules
from emberseal.llm.queries import tokenizer_files
from emberseal.llm.rowkeys import NO_ID, with_own_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; rows equal in doc_id and text stay or go together."""
    kept = quality_rules(docs.withColumn("doc_id", _key())).groupBy("doc_id").agg(F.bool_and("kept").alias("kept")).filter("kept").select("doc_id")
    return _only(docs, kept, "left_semi")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; n_chars counts anew. Texts that lose all their words go.

    Texts that lose no line come back as they are, nulls included.
    """
    rest = ("lang", "source", "n_chars")
    cut = line_dedup(docs.select(*COLUMNS, F.col("text").isNull().alias("no_text")), carry=(*rest, "no_text"))
    changed = F.col("n_dropped") > 0
    kept = cut.filter(~changed | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.when(~F.col("no_text"), F.col("kept_text")).alias("text")
    size = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return kept.select("doc_id", text, "lang", "source", size)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id; of rows that share a doc_id, the least by text and other columns.

    Of rows without a doc_id, only those of equal text are one document.
    """
    rows, _ = with_own_ids(docs, F.struct(*COLUMNS).alias("r"))
    kept = near_dedup(rows.select("doc_id", "text")).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"))
    # One partitioning by key serves the join and the aggregation.
    least = rows.select(F.col("doc_id").alias("key"), "r").join(kept, "key", "left_semi").groupBy("key").agg(F.min("r").alias("r"))
    return least.select("r.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; rows equal in doc_id and text stay or go together."""
    leaks = decontaminate(docs.withColumn("doc_id", _key()), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id")
    return _only(docs, leaks, "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_files())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", decontaminated), ("packing", packed)]
ORACLE_SQL = None


def _key() -> Column:
    """Equal for rows of equal doc_id and text; it has 64 bits, as other fingerprints."""
    return F.xxhash64("doc_id", "text")


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose _key() is (left_semi) or is not (left_anti) among ids."""
    ids = ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"))
    return docs.select(*COLUMNS).join(ids, _key() == F.col("id"), how)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each but the last is written as Parquet and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
