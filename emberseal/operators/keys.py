"""Data keys: minted at random, stored wrapped, counted, rotated and destroyed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crypto import open_bytes, seal_bytes
from ..functions.formats import key_aad
from ..sources.stored import stored

KEYS = "tenant string, subject string, version int, wrapped_key binary, state string, encryption_count long"


def secret_row(spark: SparkSession, name: str, secret: bytes) -> DataFrame:
    """A secret as a one-row table."""
    return spark.createDataFrame([(bytearray(secret),)], f"{name} binary")


def with_secret(df: DataFrame, name: str, secret: bytes) -> DataFrame:
    return df.join(F.broadcast(secret_row(df.sparkSession, name, secret)), how="cross")  # one row


def _random(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([os.urandom(32) for _ in range(b.num_rows)], pa.binary())], names=[*b.schema.names, "data_key"])


def drawn(new: DataFrame, master: bytes) -> DataFrame:
    """Rows of KEYS for (tenant, subject, version): random keys, wrapped. Each run draws others, so write before use."""
    keyed = new.select("tenant", "subject", "version").mapInArrow(_random, "tenant string, subject string, version int, data_key binary")
    return with_secret(keyed, "master", master).select("tenant", "subject", "version", seal_bytes(F.col("data_key"), F.col("master"), key_aad(F.col("tenant"), F.col("subject"), F.col("version"))).alias("wrapped_key"), F.lit("ACTIVE").alias("state"), F.lit(0).cast("long").alias("encryption_count"))


def missing(subjects: DataFrame, *known: DataFrame | None) -> DataFrame:
    """Version 1 of each (tenant, subject) that no known table has."""
    new = subjects.select("tenant", "subject").distinct()
    for table in known:
        if table is not None:
            new = new.join(table.select("tenant", "subject").distinct(), ["tenant", "subject"], "left_anti")
    return new.withColumn("version", F.lit(1))


def mint(subjects: DataFrame, keys: DataFrame | None, erased: DataFrame | None, master: bytes) -> DataFrame:
    """Version 1 for every (tenant, subject) without a key; erased subjects never get one.

    The result is written before use, so no later run makes other keys.
    """
    made = stored(drawn(missing(subjects, keys, erased), master))
    return made if keys is None else keys.unionByName(made)


def active(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("state") == "ACTIVE")


def opened_key(wrapped: Column, master: Column, version: Column) -> Column:
    """The plain data key of a row's tenant and subject; only for columns that no exchange, cache or file sees."""
    return open_bytes(wrapped, master, key_aad(F.col("tenant"), F.col("subject"), version))


def over_limit(used: DataFrame, adding: DataFrame, limit: int) -> DataFrame:
    """Subjects (tenant, subject, n) whose current key would seal more than `limit` values with what adding (n) brings."""
    both = used.select("tenant", "subject", "n").unionByName(adding.select("tenant", "subject", "n"))
    return both.groupBy("tenant", "subject").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)


def current(keys: DataFrame) -> DataFrame:
    """The highest version of each subject."""
    return keys.groupBy("tenant", "subject").agg(F.max("version").alias("version"))


def destroy(keys: DataFrame, subjects: DataFrame) -> DataFrame:
    return keys.join(subjects.select("tenant", "subject").distinct(), ["tenant", "subject"], "left_anti")


def version_for(order: Column, limit: int) -> Column:
    """Version by use: a key serves `limit` values, the next version the values after."""
    place = F.row_number().over(Window.partitionBy("tenant", "subject").orderBy(order))
    return (F.floor((place - 1) / F.lit(limit)) + 1).cast("int")
