import pytest
from pyspark.errors import StreamingQueryException

from emberseal.operators.keys import KEYS
from emberseal.operators.seal import SealSpec, open_columns
from emberseal.streaming.seal_stream import seal_stream

MASTER = bytes(range(32))
SPEC = SealSpec("events", "event_id", "'t'", "concat('user-', user_id)", ("props",))
SCHEMA = "event_id long, user_id long, props string"


def start(spark, tmp_path, erased=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return seal_stream(stream, SPEC, MASTER, *(str(tmp_path / x) for x in ("out", "keys", "checkpoint")), erased)


def arrive(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stream_round_trip(spark, tmp_path):
    first, second = [(1, 1, '{"a":1}'), (2, 2, None)], [(3, 1, "x"), (4, 3, "")]
    for rows in (first, second):
        arrive(spark, tmp_path, rows)
        start(spark, tmp_path).awaitTermination()
    keys = spark.read.schema(KEYS).parquet(str(tmp_path / "keys"))
    assert sorted(r.subject for r in keys.collect()) == ["user-1", "user-2", "user-3"]
    sealed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert dict(sealed.dtypes)["props"] == "binary"
    assert sorted(tuple(r) for r in open_columns(sealed, SPEC, keys, MASTER, {}).collect()) == first + second


def test_stream_refuses_erased(spark, tmp_path):
    arrive(spark, tmp_path, [(1, 1, "x")])
    erased = spark.createDataFrame([("t", "user-1")], "tenant string, subject string")
    with pytest.raises(StreamingQueryException, match="SHRED-ERASED-001"):
        start(spark, tmp_path, erased).awaitTermination()
