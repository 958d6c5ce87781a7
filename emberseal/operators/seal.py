"""Sealing and opening columns of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SealError
from ..functions.crypto import open_bytes, seal_bytes
from ..functions.formats import IDENTIFIER, parsed, row_id, stored_value, value_aad
from .keys import active, current, opened_key, with_secret

OWNER = ["tenant", "subject"]
# Fixed value of the stored form.
ERASED = "[erased]"


@dataclass(frozen=True)
class SealSpec:
    """Which columns of an entity are sealed, and whose they are."""

    entity: str
    id_column: str
    tenant: str  # SQL expressions over the row
    subject: str
    fields: tuple[str, ...]
    id_kind: str = "long"

    def check(self, df: DataFrame) -> None:
        names = [c.lower() for c in df.columns]
        if len(set(names)) < len(names):
            raise SealError("SHRED-CONFIG-001", "columns differ only by case")
        missing = [c for c in (self.id_column, *self.fields) if c not in df.columns]
        if missing:
            raise SealError("SHRED-READ-UNSCOPED", "the table lacks the row's id or a sealed column")
        if self.id_column in self.fields:
            raise SealError("SHRED-CONFIG-001", "the id cannot be sealed")

    def owned(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"tenant": F.expr(self.tenant), "subject": F.expr(self.subject), "row": row_id(F.col(f"`{self.id_column}`"), self.id_kind)})


def violations(df: DataFrame, column: Column) -> DataFrame:
    """Rows whose identifier is null or not well-formed."""
    return df.filter(~F.coalesce(column.rlike(IDENTIFIER), F.lit(False)))


def to_bytes(df: DataFrame, field: str) -> Column:
    x = F.col(f"`{field}`")
    return x if dict(df.dtypes)[field] == "binary" else F.encode(x.cast("string"), "UTF-8")


def markers(df: DataFrame, spec: SealSpec) -> DataFrame:
    """Rows that seal() refuses: a sealed text that is the marker of erased values itself."""
    texts = [f for f in spec.fields if dict(df.dtypes)[f] == "string"]
    said = F.lit(False)
    for f in texts:
        said = said | F.coalesce(F.col(f"`{f}`") == ERASED, F.lit(False))
    return df.filter(said)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once: the generator keeps the optimizer from copying its expression."""
    return df.withColumn(name, F.explode(F.array(value)))


def seal(df: DataFrame, spec: SealSpec, keys: DataFrame, master: bytes) -> DataFrame:
    """The table with its sealed columns in stored form; nulls stay null. Subjects need a key (mint).

    Keys are wrapped while rows are dealt out, and unwrapped where they meet
    their rows. Each value is encrypted once, so its nonce, text and tag belong
    together. A value that reads like the marker of erased ones is refused.
    """
    spec.check(df)
    latest = active(keys).join(current(keys), OWNER + ["version"]).select(*OWNER, F.col("version").alias("_version"), F.col("wrapped_key").alias("_wrapped"))
    joined = with_secret(spec.owned(df).join(latest, OWNER, "left"), "_master", master)
    joined = _once(joined, "_key", opened_key(F.col("_wrapped"), F.col("_master"), F.col("_version"))).drop("_wrapped", "_master")
    kinds = dict(df.dtypes)
    for f in spec.fields:
        aad = value_aad(F.col("tenant"), F.col("subject"), F.col("row"), F.lit(spec.entity), F.lit(f), F.col("_version"))
        plain = to_bytes(df, f)
        refused = F.when(F.col("_key").isNull(), F.raise_error(F.lit("SHRED-ERASED-001: a subject has no key")).cast("binary"))
        if kinds[f] == "string":
            refused = refused.when(F.col(f"`{f}`") == ERASED, F.raise_error(F.lit("SHRED-ERASED-001: a value is the marker of erased ones")).cast("binary"))
        joined = _once(joined, "_sealed", F.when(plain.isNotNull(), F.coalesce(refused, seal_bytes(plain, F.col("_key"), aad))))
        value = stored_value(F.col("_version"), F.col("tenant"), F.col("subject"), F.col("row"), F.col("_sealed"))
        joined = joined.withColumn(f, F.when(F.col("_sealed").isNotNull(), value)).drop("_sealed")
    return joined.select(*df.columns)


def open_columns(df: DataFrame, spec: SealSpec, keys: DataFrame, master: bytes, types: dict[str, str], policy: str = "SENTINEL") -> DataFrame:
    """Opened columns. A value whose header names another tenant, subject or row raises; destroyed keys follow the policy.

    One join brings a row the wrapped keys of all versions of its subject, for
    all fields. All fields of a row are verified before any of them shows.
    """
    spec.check(df)
    if policy not in ("SENTINEL", "NULL", "EXCEPTION"):
        raise SealError("SHRED-CONFIG-001", "unknown policy")
    held = active(keys).groupBy(*OWNER).agg(F.map_from_entries(F.collect_list(F.struct("version", "wrapped_key"))).alias("_keys"))
    out = with_secret(spec.owned(df).join(held, OWNER, "left"), "_master", master)
    wrong = F.lit(None).cast("string")
    for i, f in enumerate(spec.fields):
        there = F.col(f"`{f}`").isNotNull()
        out = _once(out, f"_h{i}", parsed(F.col(f"`{f}`")))
        h = F.col(f"_h{i}")
        out = _once(out, f"_k{i}", opened_key(F.try_element_at("_keys", h["version"]), F.col("_master"), h["version"]))
        aad = value_aad(F.col("tenant"), F.col("subject"), F.col("row"), F.lit(spec.entity), F.lit(f), h["version"])
        out = _once(out, f"_p{i}", open_bytes(h["sealed"], F.col(f"_k{i}"), aad))
        state = mismatch(h, F.col("tenant"), F.col("subject"), F.col("row"))
        wrong = F.coalesce(wrong, F.when(there & (state != "OK"), state), F.when(there & F.col(f"_k{i}").isNotNull() & F.col(f"_p{i}").isNull(), F.lit("SHRED-DECRYPT-001")))
    out = _once(out, "_wrong", wrong)
    for i, f in enumerate(spec.fields):
        kind, plain = types.get(f, "string"), F.col(f"_p{i}")
        text = F.decode(plain, "UTF-8")
        value = plain if kind == "binary" else text if kind == "string" else text.cast(kind)
        gone = {"SENTINEL": F.lit(ERASED).cast("string") if kind == "string" else F.lit(None), "NULL": F.lit(None), "EXCEPTION": F.raise_error(F.lit("SHRED-KEY-DESTROYED: the key is destroyed"))}[policy].cast(kind)
        out = out.withColumn(f, F.when(F.col("_wrong").isNotNull(), F.raise_error(F.col("_wrong")).cast(kind)).when(F.col(f"`{f}`").isNull(), F.lit(None).cast(kind)).when(F.col(f"_k{i}").isNull(), gone).otherwise(value))
    return out.select(*df.columns)


def mismatch(header: Column, tenant: Column, subject: Column, row: Column) -> Column:
    """The code of what is wrong between a value's header and its row, else OK."""
    return F.when(~header["ok"], "SHRED-FORMAT-001").when((header["tenant"] != tenant) | (header["subject"] != subject), "SHRED-SUBJECT-MISMATCH").when(header["row"] != row, "SHRED-ROW-MISMATCH").otherwise("OK")
