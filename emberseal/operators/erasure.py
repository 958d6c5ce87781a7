"""Erasing subjects in batches: what a request does, and what must hold afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SealError
from ..functions.formats import parsed
from .seal import SealSpec, mismatch

MAX_RETENTION_DAYS = 36_500


def requested(requests: DataFrame, keys: DataFrame, erased: DataFrame) -> DataFrame:
    """Per requested (tenant, subject): keys_destroyed, already_erased (no keys left, and a tombstone)."""
    owned = keys.groupBy("tenant", "subject").agg(F.count("*").alias("n"))
    stones = erased.select("tenant", "subject").distinct().withColumn("stone", F.lit(True))
    told = requests.select("tenant", "subject").distinct().join(owned, ["tenant", "subject"], "left").join(stones, ["tenant", "subject"], "left")
    return told.select("tenant", "subject", F.coalesce("n", F.lit(0)).cast("long").alias("keys_destroyed"), (F.col("n").isNull() & F.col("stone").isNotNull()).alias("already_erased"))


def buried(erased: DataFrame, subjects: DataFrame) -> DataFrame:
    """Tombstones with those of subjects added; none twice."""
    new = subjects.select("tenant", "subject").distinct().join(erased, ["tenant", "subject"], "left_anti")
    return erased.select("tenant", "subject").unionByName(new)


def clear_index(df: DataFrame, index: str, subjects: DataFrame) -> DataFrame:
    """df (tenant, subject, index) without the index values of these subjects."""
    gone = subjects.select("tenant", "subject").distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, ["tenant", "subject"], "left").withColumn(index, F.when(F.col("_gone").isNull(), F.col(index))).drop("_gone")


def residue(df: DataFrame, index: str, subjects: DataFrame) -> DataFrame:
    """Per subject: index values left under its own tenant (refuse if any) and under another or none (warn)."""
    asked = subjects.select(F.col("tenant").alias("own"), "subject").distinct()
    held = df.filter(F.col(index).isNotNull()).groupBy("tenant", "subject").agg(F.count("*").alias("n"))
    both = asked.join(held, "subject", "left")
    at_home = F.col("tenant").eqNullSafe(F.col("own"))
    return both.groupBy(F.col("own").alias("tenant"), "subject").agg(F.coalesce(F.sum(F.when(at_home, F.col("n"))), F.lit(0)).alias("residual"), F.coalesce(F.sum(F.when(~at_home, F.col("n"))), F.lit(0)).alias("elsewhere"))


def unsettled(stored: DataFrame, spec: SealSpec) -> DataFrame:
    """Rows and fields whose stored header names another tenant, subject or row than the row's own, read back after a write."""
    rows = spec.owned(stored)
    named = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("v")) for f in spec.fields))
    each = rows.select(spec.id_column, "tenant", "subject", "row", F.explode(named).alias("x")).filter(F.col("x.v").isNotNull())
    told = each.select(spec.id_column, F.col("x.field").alias("field"), mismatch(parsed(F.col("x.v")), F.col("tenant"), F.col("subject"), F.col("row")).alias("state"))
    return told.filter(F.col("state") != "OK")


def moved(stored: DataFrame, rows: DataFrame, spec: SealSpec) -> DataFrame:
    """Ids of rows that an update must not touch: not there, or with a stored header of another tenant, subject or row."""
    new = spec.owned(rows).select(spec.id_column, "tenant", "subject", "row")
    named = F.array(*(F.col(f"`{f}`") for f in spec.fields))
    old = stored.select(spec.id_column, F.filter(named, lambda v: v.isNotNull()).alias("_values"))
    both = new.join(old, spec.id_column, "left")
    state = lambda v: mismatch(parsed(v), F.col("tenant"), F.col("subject"), F.col("row"))
    return both.filter(F.col("_values").isNull() | F.exists("_values", lambda v: state(v) != "OK")).select(spec.id_column)


def clear_date(at: Column, days: int) -> Column:
    """When the last backup that holds the keys is gone."""
    if not 0 <= days <= MAX_RETENTION_DAYS:
        raise SealError("SHRED-CONFIG-001", "retention must be from 0 to 36500 days")
    return F.timestamp_micros(F.unix_micros(at) + F.lit(days * 86_400_000_000))
