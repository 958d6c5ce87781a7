"""Cutting lineage with files that every executor can read again."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the folder that the cluster names.

    Only a local session without such a folder gets one of its own. Spark
    hands a checkpoint the size it guessed for its plan, for joins the product
    of both sides. In a loop that number has twice as many digits after every
    round until planning takes minutes, so guesses and inferred constraints
    are left out here; the partitioning stays known. Shuffle files that led to
    the checkpoint go once the driver collects its garbage, which it is asked
    to do, as loops would fill the disks before it comes to that by itself.
    """
    session = df.sparkSession
    context = session.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = session.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    made = df.checkpoint()._jdf.queryExecution().analyzed()
    sql, none = session._jvm.org.apache.spark.sql, session._jvm.scala.Option.empty()
    plan = sql.execution.LogicalRDD(made.output(), made.rdd(), made.outputPartitioning(), made.outputOrdering(), False, none, session._jsparkSession, none, none)
    del df
    gc.collect()
    session._jvm.System.gc()
    return DataFrame(sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)
