"""The proof chain of erasures: each record's hash covers the one before."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import hkdf, hmac_hex, pads, part
from .keys import with_secret

# Fixed values of the chain's form: without and with keys.
GENESIS, UNKEYED, VERSIONS = "0" * 64, "none", ("sh1", "sh2h")
FIELDS = ("key_id", "ts", "tenant", "subject_pseudonym", "requested_by", "reason", "keys_destroyed", "entity_count", "field_count", "blind_index_cleared", "outcome", "hook_material", "backup_clear_at")


def instant(t: Column) -> Column:
    """ISO text with 0, 3 or 6 fraction digits and Z, of a UTC session's timestamp."""
    micros = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    digits = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), digits, F.lit("Z"))


def canonical(version: str = "sh1") -> Column:
    return F.concat(F.lit(version), *(part(F.col(f).cast("string")) for f in FIELDS))


def linked(canonical_: Column, prev: Column, ipad: Column | None = None, opad: Column | None = None) -> Column:
    """A record's hash; with pads it is keyed."""
    material = F.concat(canonical_, F.lit("|"), F.length(prev).cast("string"), F.lit(":"), prev)
    return F.sha2(material, 256) if ipad is None else hmac_hex(ipad, opad, F.encode(material, "UTF-8"))


def _with_pads(records: DataFrame, keyring: dict[str, bytes] | None) -> DataFrame:
    """records with the pads of their key_id; null where the keyring lacks it. The keyring is the caller's, a few rows."""
    if keyring is None:
        return records.withColumns({"ipad": F.lit(None).cast("binary"), "opad": F.lit(None).cast("binary")})
    rows = [(k, *map(bytearray, pads(secret))) for k, secret in keyring.items() if k != UNKEYED]
    table = records.sparkSession.createDataFrame(rows, "key_id string, ipad binary, opad binary")
    return records.join(F.broadcast(table), "key_id", "left")


def _link(head: str, keyed: bool):
    """linked() in plain Python over rows in seq order; it holds one hash, so a long trail needs no more memory than a short one."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = head
        for b in batches:
            before, after_ = [], []
            for text, ipad, opad in zip(*(b.column(c).to_pylist() for c in ("_c", "ipad", "opad")), strict=True):
                before.append(prev)
                if prev is None or keyed and ipad is None:  # a key that the ring lacks: no hash from here on
                    prev = None
                else:
                    material = f"{text}|{len(prev)}:{prev}".encode()
                    prev = sha256(opad + sha256(ipad + material).digest()).hexdigest() if keyed else sha256(material).hexdigest()
                after_.append(prev)
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.array(before, pa.string()), pa.array(after_, pa.string())], names=["seq", "prev_hash", "hash"])

    return link


def append(records: DataFrame, keyring: dict[str, bytes] | None = None, head: str = GENESIS) -> DataFrame:
    """Records (seq, a long without nulls, and FIELDS) with prev_hash and hash, the first after head.

    Each hash covers the one before, so one task links them: it reads the
    records sorted by seq (the sort spills) and is linear in their number.
    """
    keyed = keyring is not None
    rows = _with_pads(records, keyring).select("seq", canonical(VERSIONS[keyed]).alias("_c"), "ipad", "opad")
    links = rows.repartition(1).sortWithinPartitions("seq").mapInArrow(_link(head, keyed), "seq long, prev_hash string, hash string")
    return records.join(links, "seq")


def verify(trail: DataFrame, head: str | None, count: int, keyring: dict[str, bytes] | None = None) -> DataFrame:
    """One row: status (EMPTY, INTACT, INTACT_UNKEYED, BROKEN, ANCHOR_MISMATCH, NO_ANCHOR), broken_at.

    head and count are the anchor's; head None: there is none. With a keyring
    the trail must be keyed, each record under a key of the ring.

    A row carries its predecessor's hash, so every hash is checked in parallel,
    and each row meets its predecessor by seq - 1; no task sees the whole trail.
    A seq that is missing, null or there twice breaks the chain.
    """
    keyed = keyring is not None
    rows = _with_pads(trail, keyring)
    stranger = F.col("ipad").isNull() if keyed else ~F.col("key_id").eqNullSafe(F.lit(UNKEYED))
    right = linked(canonical(VERSIONS[keyed]), F.col("prev_hash"), *((F.col("ipad"), F.col("opad")) if keyed else ()))
    own = rows.select("seq", "hash", "prev_hash", (stranger | ~F.col("hash").eqNullSafe(right)).alias("bad"))
    one = own.groupBy("seq").agg(F.max("hash").alias("hash"), F.max("prev_hash").alias("prev_hash"), (F.bool_or("bad") | (F.count("*") > 1) | F.col("seq").isNull()).alias("bad"), F.count("*").alias("rows"))
    linked_to = one.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    told = one.join(linked_to, "seq", "left").withColumn("bad", F.col("bad") | ~F.col("prev_hash").eqNullSafe(F.coalesce("before", F.lit(GENESIS))))
    sums = told.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.min(F.when(F.col("bad"), F.coalesce("seq", F.lit(0)))).alias("broken_at"), F.max_by("hash", "seq").alias("last"))
    if head is None:
        return sums.select(F.when(F.col("n") == 0, "EMPTY").otherwise("NO_ANCHOR").alias("status"), F.lit(None).cast("long").alias("broken_at"))
    other = (F.col("n") != count) | (F.coalesce("last", F.lit(GENESIS)) != head)
    status = F.when(F.col("broken_at").isNotNull(), "BROKEN").when(other, "ANCHOR_MISMATCH").when(F.col("n") == 0, "EMPTY").otherwise("INTACT" if keyed else "INTACT_UNKEYED")
    return sums.select(status.alias("status"), "broken_at")


def after(trail: DataFrame, seq: int, limit: int) -> DataFrame:
    """A page of the trail: at most `limit` (1 to 1000) records beyond seq."""
    return trail.filter(F.col("seq") > seq).orderBy("seq").limit(min(max(limit, 1), 1000))


def latest(trail: DataFrame) -> DataFrame:
    """Each subject's record with the highest seq."""
    return trail.groupBy("tenant", "subject_pseudonym").agg(F.max_by(F.struct(*trail.columns), "seq").alias("r")).select("r.*")


def hook_material(hooks: Column) -> Column:
    """Canonical text of an array of (hook, succeeded, detail)."""
    return F.array_join(F.transform(hooks, lambda h: F.concat(part(h["hook"]), part(h["succeeded"].cast("string")), part(h["detail"]))), "")


def outstanding(trail: DataFrame) -> DataFrame:
    """Hooks (of hook_outcomes) that each subject's latest record names as not succeeded."""
    named = latest(trail).select("tenant", "subject_pseudonym", "seq", F.explode("hook_outcomes").alias("h"))
    return named.filter(~F.col("h.succeeded")).select("tenant", "subject_pseudonym", "seq", F.col("h.hook").alias("hook"), F.col("h.detail").alias("detail"))


def pseudonym(df: DataFrame, secret: bytes) -> DataFrame:
    """df (tenant, subject) with subject_pseudonym."""
    ipad, opad = pads(hkdf(secret, b"sh/subject-pseudonym/v1"))
    material = F.encode(F.concat(F.lit("sh-pseudo1"), part(F.col("tenant")), part(F.col("subject"))), "UTF-8")
    both = with_secret(with_secret(df, "ipad", ipad), "opad", opad)
    return both.withColumn("subject_pseudonym", hmac_hex(F.col("ipad"), F.col("opad"), material)).drop("ipad", "opad")
