"""Keys that rows keep through a join, for tables whose doc_id may be null or repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable

NO_ID = -(1 << 63)


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id (null: NO_ID), text (null: empty), text_hash and the columns of `more`.

    Rows equal in doc_id and text_hash have the same text, so what is found
    for one holds for the others. Columns not asked for are dropped, so that
    none can clash with the names used here.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *more)


def with_own_ids(docs: DataFrame, *more: str | Column) -> tuple[DataFrame, int]:
    """keyed(docs, *more), in which each text of null doc_ids has a doc_id of its own, below all others; and the last of these.

    Without null doc_ids the last is NO_ID.
    """
    rows = keyed(docs, *more)
    if docs.filter(F.col("doc_id").isNull()).select("doc_id").isEmpty():
        return rows, NO_ID
    none = keyed(docs.filter(F.col("doc_id").isNull()), *more)
    hashes = none.select("text_hash").distinct().repartitionByRange("text_hash").sortWithinPartitions("text_hash")
    own = durable(hashes.select("text_hash", (F.lit(NO_ID + 1) + F.monotonically_increasing_id()).alias("own")))
    last = own.agg(F.max("own")).first()[0]
    named = keyed(docs.filter(F.col("doc_id").isNotNull()), *more)
    least = named.agg(F.min("doc_id")).first()[0]
    if least is not None and least <= last:
        raise ValueError("doc_ids near the least long leave no room for rows without one")
    return named.unionByName(none.join(own, "text_hash").withColumn("doc_id", F.col("own")).select(*named.columns)), last


def id_or_null(name: str = "doc_id", last: int = NO_ID) -> Column:
    return F.when(F.col(name) > last, F.col(name)).alias(name)
