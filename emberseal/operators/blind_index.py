"""Blind indexes: truncated keyed hashes of normalised values, by tenant."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import SealError
from ..functions.crypto import hkdf, hmac_hex, pads, part

MAX_TENANTS = 100_000


def tenant_pads(spark: SparkSession, secret: bytes, tenants: list[str]) -> DataFrame:
    if len(secret) < 32:
        raise SealError("SHRED-CONFIG-001", "the index secret has fewer than 32 bytes")
    rows = [(t, *map(bytearray, pads(hkdf(secret, b"sh/blind-index/v1|" + t.encode())))) for t in tenants]
    return spark.createDataFrame(rows, "tenant string, ipad binary, opad binary")


# What counts as white space at the ends, after NFKC.
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u1680\u2028\u2029"


@F.pandas_udf(StringType())
def _compatible(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t).strip(WHITE).lower(), na_action="ignore")


def normalised(x: Column, kind: str = "string") -> Column:
    """Text in NFKC, stripped and in lower case; dates as ISO, decimals without trailing zeros, bytes as hex.

    Only text beyond ASCII reaches Python.
    """
    if kind == "binary":
        return F.lower(F.hex(x))
    if kind.startswith("decimal"):
        return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    if kind != "string":
        return x.cast("string")
    plain = F.octet_length(x) == F.length(x)
    return F.when(plain, F.lower(F.btrim(x, F.lit(WHITE)))).otherwise(_compatible(F.when(~plain, x)))


def blind_index(df: DataFrame, secret: bytes, entity: str, field: str, bits: int = 64) -> DataFrame:
    """df (with tenant) and `<field>_bidx`."""
    if bits % 8 or not 32 <= bits <= 256:
        raise SealError("SHRED-CONFIG-001", "bits must be a multiple of 8 from 32 to 256")
    tenants = [r.tenant for r in df.select("tenant").distinct().limit(MAX_TENANTS + 1).collect()]
    if len(tenants) > MAX_TENANTS:
        raise SealError("SHRED-CONFIG-001", "too many tenants for one pass")
    material = F.encode(F.concat(F.lit("sh-bi1"), *map(part, (F.lit("n1"), F.lit(entity), F.lit(field), normalised(F.col(field), dict(df.dtypes)[field])))), "UTF-8")
    mac = F.when(F.col(field).isNotNull(), F.substring(F.unhex(hmac_hex(F.col("ipad"), F.col("opad"), material)), 1, bits // 8))
    return df.join(F.broadcast(tenant_pads(df.sparkSession, secret, tenants)), "tenant", "left").withColumn(f"{field}_bidx", mac).drop("ipad", "opad")
