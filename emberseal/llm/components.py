"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def components(edges: DataFrame) -> DataFrame:
    """v, c for every vertex of edges(a, b): c is the least vertex it is joined with.

    A vertex sends its label along its edges; sums are combined on the map
    side, so a hub costs a row per task, and joins on a hub's key can be split.
    Each round is written to the checkpoint folder. Labels stay by vertex, so
    that a round needs two exchanges; every third round, labels also jump to
    their label's label, so that chains shrink fast.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    rounds = 0
    while True:
        rounds += 1
        sent = both.join(labels.withColumnRenamed("v", "b"), "b").select(F.col("a").alias("v"), "c", F.lit(None).cast("long").alias("old"))
        new = labels.withColumn("old", F.col("c")).unionByName(sent).groupBy("v").agg(F.min("c").alias("c"), F.max("old").alias("old"))
        if rounds % 3 == 0:
            up = labels.select(F.col("v").alias("p"), F.col("c").alias("pc"))
            new = new.join(up, F.col("c") == F.col("p"), "left").select("v", F.least("c", F.coalesce("pc", "c")).alias("c"), "old")
        new = durable(new)
        labels = new.select("v", "c")
        if new.filter("c <> old").isEmpty():
            return labels
