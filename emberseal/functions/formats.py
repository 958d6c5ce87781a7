"""Row ids, bound texts and the stored form of a sealed value, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .crypto import part

# Fixed values of the stored form.
MAGIC, LAYOUT, ALGORITHM = "SH1", 2, 1
IDENTIFIER = r"^[A-Za-z0-9\-_.:@+]{1,255}$"


def int32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 8, "0"))


def row_id(x: Column, kind: str) -> Column:
    """Tag and canonical bytes: long, uuid, string or binary."""
    if kind == "long":
        return F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(x.cast("bigint")), 16, "0")))
    if kind == "uuid":
        return F.unhex(F.concat(F.lit("02"), F.replace(x, F.lit("-"), F.lit(""))))
    if kind == "string":
        return F.concat(F.unhex(F.lit("03")), F.encode(x, "UTF-8"))
    return F.concat(F.unhex(F.lit("04")), x)


def value_aad(tenant: Column, subject: Column, row: Column, entity: Column, field: Column, version: Column) -> Column:
    texts = (F.lit(str(LAYOUT)), F.lit(str(ALGORITHM)), tenant, subject, F.lower(F.hex(row)), entity, field, version.cast("string"))
    return F.concat(F.lit("sh1"), *map(part, texts))


def key_aad(tenant: Column, subject: Column, version: Column) -> Column:
    return F.concat(F.lit("sh1"), *map(part, (F.lit(str(LAYOUT)), F.lit("wrap"), tenant, subject, version.cast("string"))))


def stored_value(version: Column, tenant: Column, subject: Column, row: Column, sealed: Column) -> Column:
    """Header, nonce, length, then ciphertext and tag."""
    byte = lambda x: F.unhex(F.lpad(F.hex(F.octet_length(x)), 2, "0"))
    head = [F.lit(MAGIC.encode()), F.lit(bytes([LAYOUT, ALGORITHM])), int32(version), byte(tenant), F.encode(tenant, "UTF-8"), byte(subject), F.encode(subject, "UTF-8"), byte(row), row]
    return F.concat(*head, F.substring(sealed, 1, 12), int32(F.octet_length(sealed) - 12), F.substr(sealed, F.lit(13)))


def parsed(stored: Column) -> Column:
    """Struct of version, tenant, subject, row, sealed and ok (strictly well-formed)."""
    cut = lambda a, n: F.substr(stored, a, n)
    number = lambda a, n: F.conv(F.hex(cut(a, F.lit(n))), 16, 10).cast("int")
    zero = lambda x: F.coalesce(x, F.lit(0))
    t = zero(number(F.lit(10), 1))
    s = zero(number(F.lit(11) + t, 1))
    r = zero(number(F.lit(12) + t + s, 1))
    after = F.lit(13) + t + s + r
    n = number(after + 12, 4)
    tenant, subject, row = F.decode(cut(F.lit(11), t), "UTF-8"), F.decode(cut(F.lit(12) + t, s), "UTF-8"), cut(F.lit(13) + t + s, r)
    version = number(F.lit(6), 4)
    sealed = F.concat(cut(after, F.lit(12)), cut(after + 16, zero(n)))
    ok = (F.hex(cut(F.lit(1), F.lit(5))) == F.hex(F.lit(MAGIC.encode() + bytes([LAYOUT, ALGORITHM])))) & (version >= 1) & (t > 0) & (s > 0) & (r > 0) & (n >= 16) & (F.octet_length(stored) == after + 15 + n)
    return F.struct(version.alias("version"), tenant.alias("tenant"), subject.alias("subject"), row.alias("row"), sealed.alias("sealed"), F.coalesce(ok, F.lit(False)).alias("ok"))
