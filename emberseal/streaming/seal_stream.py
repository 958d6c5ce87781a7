"""Sealing a stream by micro-batches that may run again without other effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import keys as key_ops
from ..operators.seal import SealSpec, seal


def seal_stream(stream: DataFrame, spec: SealSpec, master: bytes, out: str, keys_path: str, checkpoint: str, erased: DataFrame | None = None) -> StreamingQuery:
    """Starts sealing what has arrived: rows to out/batch=<id>, new wrapped keys to keys_path. One writer only.

    Keys are written before the rows they seal. A batch that runs again finds
    them there and replaces its own rows. A row of an erased subject fails the
    batch. Only keys of a batch's subjects are unwrapped.
    """
    spec.check(stream)
    stream.sparkSession.createDataFrame([], key_ops.KEYS).write.mode("append").parquet(keys_path)

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        subjects = spec.owned(rows).select("tenant", "subject").distinct()
        known = spark.read.schema(key_ops.KEYS).parquet(keys_path)
        new = subjects.join(known.select("tenant", "subject"), ["tenant", "subject"], "left_anti")
        key_ops.mint(new, None, erased, master).write.mode("append").parquet(keys_path)
        held = spark.read.schema(key_ops.KEYS).parquet(keys_path).join(subjects, ["tenant", "subject"], "left_semi")
        seal(rows, spec, held, master).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
