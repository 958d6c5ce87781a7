"""One query per operator over the test tables, with DuckDB SQL for the same rows.

Secrets here are fixed and synthetic.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.crypto import hkdf, pads
from ..operators import chain, keys
from ..operators.blind_index import blind_index
from ..operators.seal import SealSpec, mismatch, open_columns, seal, violations
from ..sources.stored import stored

MASTER, INDEX, PEPPER = (hashlib.sha256(f"synthetic {x} secret".encode()).digest() for x in ("master", "index", "pepper"))
SPEC = SealSpec("customer", "c_custkey", "concat('nation-', c_nationkey)", "concat('cust-', c_custkey)", ("c_name", "c_acctbal"))
TYPES = {"c_acctbal": "decimal(18,2)"}
OWNER = "'nation-' || c_nationkey AS tenant, 'cust-' || c_custkey AS subject"
GONE = 3  # the nation whose customers are erased


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))


def _owners(df: DataFrame) -> DataFrame:
    return SPEC.owned(df).select("tenant", "subject", "c_custkey", "c_name", "c_nationkey", "row")


def _sealed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = _customers(spark, d)
    minted = keys.mint(_owners(c), None, None, MASTER)
    return stored(seal(c, SPEC, minted, MASTER)), minted


def seal_open_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    sealed, k = _sealed(spark, d)
    return open_columns(sealed, SPEC, k, MASTER, TYPES).select("c_custkey", "c_name")


def open_decimal(spark: SparkSession, d: str) -> DataFrame:
    sealed, k = _sealed(spark, d)
    return open_columns(sealed, SPEC, k, MASTER, TYPES).select("c_custkey", F.col("c_acctbal").cast("string").alias("balance"))


def seal_header_fields(spark: SparkSession, d: str) -> DataFrame:
    h = _sealed(spark, d)[0].select("c_custkey", formats.parsed(F.col("c_name")).alias("h"))
    return h.select("c_custkey", "h.tenant", "h.subject", F.lower(F.hex("h.row")).alias("row_hex"), F.col("h.version").cast("long").alias("version"), "h.ok")


def _erased(spark: SparkSession, d: str, policy: str) -> DataFrame:
    sealed, k = _sealed(spark, d)
    gone = _owners(_customers(spark, d)).filter(F.col("c_nationkey") == GONE)
    return open_columns(sealed, SPEC, keys.destroy(k, gone), MASTER, TYPES, policy).select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("balance"))


def erased_sentinel(spark: SparkSession, d: str) -> DataFrame:
    return _erased(spark, d, "SENTINEL")


def erased_null(spark: SparkSession, d: str) -> DataFrame:
    return _erased(spark, d, "NULL")


def erase_preserves_joins(spark: SparkSession, d: str) -> DataFrame:
    left = _erased(spark, d, "NULL").join(spark.read.parquet(f"{d}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey"))
    return left.groupBy("c_custkey").agg(F.count("*").alias("n_orders"))


def rowid_encode(spark: SparkSession, d: str) -> DataFrame:
    return _owners(_customers(spark, d)).select("c_custkey", F.lower(F.hex("row")).alias("row_hex"))


def value_aad(spark: SparkSession, d: str) -> DataFrame:
    o = _owners(_customers(spark, d))
    return o.select("c_custkey", formats.value_aad(F.col("tenant"), F.col("subject"), F.col("row"), F.lit("customer"), F.lit("c_name"), F.lit(1)).alias("aad"))


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return blind_index(_owners(_customers(spark, d)), INDEX, "customer", "c_name")


def blind_index_value(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).select("c_custkey", F.lower(F.hex("c_name_bidx")).alias("bidx"))


def blind_index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Customers asked for by name, found through the index and compared again after opening."""
    sealed, k = _sealed(spark, d)
    ask = _indexed(spark, d).filter(F.col("c_custkey") % 10 == 0).select("tenant", "c_name_bidx", F.col("c_name").alias("asked")).distinct()
    hits = _indexed(spark, d).select("tenant", "c_name_bidx", "c_custkey").join(ask, ["tenant", "c_name_bidx"])
    opened = open_columns(sealed, SPEC, k, MASTER, TYPES).select("c_custkey", "c_name")
    return hits.join(opened, "c_custkey").filter(F.col("c_name") == F.col("asked")).select("c_custkey", "c_name").distinct()


def index_residual_after_clear(spark: SparkSession, d: str) -> DataFrame:
    cleared = _indexed(spark, d).withColumn("c_name_bidx", F.when(F.col("c_nationkey") != GONE, F.col("c_name_bidx")))
    return cleared.groupBy("tenant").agg(F.count("c_name_bidx").alias("residual"))


def pseudonym(spark: SparkSession, d: str) -> DataFrame:
    return chain.pseudonym(_owners(_customers(spark, d)), PEPPER).select("c_custkey", "subject_pseudonym")


def current_key_version(spark: SparkSession, d: str) -> DataFrame:
    uses = _uses(spark, d)
    return keys.current(uses).select("tenant", "subject", F.col("version").cast("long").alias("version"))


def _uses(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("t").alias("tenant"), F.concat(F.lit("cust-"), "o_custkey").alias("subject"), "o_orderkey")
    return o.withColumn("version", keys.version_for(F.col("o_orderkey"), 4))


def key_rotation_versions(spark: SparkSession, d: str) -> DataFrame:
    return _uses(spark, d).select("o_orderkey", F.col("version").cast("long").alias("version"))


def key_usage(spark: SparkSession, d: str) -> DataFrame:
    return _uses(spark, d).groupBy("subject", F.col("version").cast("long").alias("version")).agg(F.count("*").alias("encryption_count"))


def tombstone_blocks_mint(spark: SparkSession, d: str) -> DataFrame:
    o = _owners(_customers(spark, d))
    return keys.mint(o, None, o.filter(F.col("c_nationkey") == GONE), MASTER).select("tenant", "subject", F.col("version").cast("long").alias("version"))


def identifier_violations(spark: SparkSession, d: str) -> DataFrame:
    return violations(_customers(spark, d), F.col("c_name")).select("c_custkey")


def read_mismatch_classify(spark: SparkSession, d: str) -> DataFrame:
    """Each third customer carries the value of the one before."""
    sealed = _sealed(spark, d)[0].select("c_custkey", "c_nationkey", "c_name")
    moved = sealed.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_name").alias("other"))
    rows = SPEC.owned(sealed.join(moved, "c_custkey", "left")).withColumn("v", F.when(F.col("c_custkey") % 3 == 0, F.coalesce("other", "c_name")).otherwise(F.col("c_name")))
    return rows.select("c_custkey", mismatch(formats.parsed(F.col("v")), F.col("tenant"), F.col("subject"), F.col("row")).alias("state"))


def _trail(spark: SparkSession, d: str) -> DataFrame:
    """One record for each customer, as for a subject that was erased; seq has no gaps, as c_custkey has none."""
    n = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("long").alias("k"))
    when = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("k") * 1_500_120)
    rows = n.select((F.col("k") + 1).alias("seq"), F.lit("none").alias("key_id"), chain.instant(when).alias("ts"), F.lit("t").alias("tenant"), F.concat(F.lit("p"), "k").alias("subject_pseudonym"), F.lit("officer").alias("requested_by"), F.lit(None).cast("string").alias("reason"), F.lit(1).alias("keys_destroyed"), F.lit(1).alias("entity_count"), F.lit(2).alias("field_count"), F.lit(0).alias("blind_index_cleared"), F.lit("COMPLETE").alias("outcome"), F.lit("").alias("hook_material"), F.lit("2026-01-01T00:00:00Z").alias("backup_clear_at"))
    return stored(chain.append(rows))


def chain_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _trail(spark, d).select("seq", "ts", "prev_hash", "hash")


def _verified(spark: SparkSession, d: str, change=lambda t: t) -> DataFrame:
    t = _trail(spark, d)
    end = t.agg(F.max_by("hash", "seq").alias("head"), F.count("*").alias("n")).first()  # the anchor
    return chain.verify(change(t), end["head"], end["n"])


def chain_verify_intact(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d)


def chain_verify_broken_at(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d, lambda t: t.withColumn("outcome", F.when(F.col("seq") == 7, "PARTIAL").otherwise(F.col("outcome"))))


def chain_anchor_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d, lambda t: t.filter(F.col("seq") < 20))


ALL = (seal_open_roundtrip, open_decimal, seal_header_fields, erased_sentinel, erased_null, erase_preserves_joins, rowid_encode, value_aad, blind_index_value, blind_index_lookup, index_residual_after_clear, pseudonym, current_key_version, key_rotation_versions, key_usage, tombstone_blocks_mint, identifier_violations, read_mismatch_classify, chain_hashes, chain_verify_intact, chain_verify_broken_at, chain_anchor_mismatch)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _mac(ipad: str, opad: str, message: str) -> str:
    return f"sha256(unhex({opad}) || unhex(sha256(unhex({ipad}) || encode({message}))))"


def _lp(x: str) -> str:
    return f"'|' || strlen({x}) || ':' || {x}"


def oracle_sql() -> dict[str, str]:
    row = "'01' || printf('%016x', c_custkey)"
    tenants = ", ".join("('nation-{}', '{}', '{}')".format(n, *(p.hex() for p in pads(hkdf(INDEX, f"sh/blind-index/v1|nation-{n}".encode())))) for n in range(25))
    pi, po = (p.hex() for p in pads(hkdf(PEPPER, b"sh/subject-pseudonym/v1")))
    name = "lower(trim(c_name))"
    own = f"(SELECT *, {OWNER} FROM customer)"
    bal = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)"
    uses = "(SELECT o_orderkey, 't' AS tenant, 'cust-' || o_custkey AS subject, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 + 1 AS version FROM orders)"
    body = "'sh1|4:none' || '|' || strlen(ts) || ':' || ts || '|1:t' || '|' || strlen(p) || ':' || p || '|7:officer|-|1:1|1:1|1:2|1:0|8:COMPLETE|0:|20:2026-01-01T00:00:00Z'"
    text = "strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us = 0 THEN '' WHEN us % 1000 = 0 THEN '.' || lpad(CAST(us // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(us AS VARCHAR), 6, '0') END || 'Z'"
    state = "SELECT '{}' AS status, CAST({} AS BIGINT) AS broken_at"
    return {
        "seal_open_roundtrip": "SELECT c_custkey, c_name FROM customer",
        "open_decimal": f"SELECT c_custkey, {bal} AS balance FROM customer",
        "seal_header_fields": f"SELECT c_custkey, {OWNER}, {row} AS row_hex, CAST(1 AS BIGINT) AS version, true AS ok FROM customer",
        "erased_sentinel": f"SELECT c_custkey, CASE WHEN c_nationkey = {GONE} THEN '[erased]' ELSE c_name END AS c_name, CASE WHEN c_nationkey <> {GONE} THEN {bal} END AS balance FROM customer",
        "erased_null": f"SELECT c_custkey, CASE WHEN c_nationkey <> {GONE} THEN c_name END AS c_name, CASE WHEN c_nationkey <> {GONE} THEN {bal} END AS balance FROM customer",
        "erase_preserves_joins": "SELECT c_custkey, count(*) AS n_orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
        "rowid_encode": f"SELECT c_custkey, {row} AS row_hex FROM customer",
        "value_aad": f"SELECT c_custkey, 'sh1|1:2|1:1' || {_lp('tenant')} || {_lp('subject')} || '|18:' || {row} || '|8:customer|6:c_name|1:1' AS aad FROM {own}",
        "blind_index_value": f"SELECT c_custkey, substr({_mac('ipad', 'opad', f"'sh-bi1|2:n1|8:customer|6:c_name' || {_lp(name)}")}, 1, 16) AS bidx FROM {own} JOIN (VALUES {tenants}) k(tenant, ipad, opad) USING (tenant)",
        "blind_index_lookup": f"SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN customer a ON c.c_name = a.c_name AND c.c_nationkey = a.c_nationkey WHERE a.c_custkey % 10 = 0",
        "index_residual_after_clear": f"SELECT tenant, count(*) FILTER (c_nationkey <> {GONE}) AS residual FROM {own} GROUP BY tenant",
        "pseudonym": f"SELECT c_custkey, {_mac(f"'{pi}'", f"'{po}'", f"'sh-pseudo1' || {_lp('tenant')} || {_lp('subject')}")} AS subject_pseudonym FROM {own}",
        "current_key_version": f"SELECT tenant, subject, max(version) AS version FROM {uses} GROUP BY ALL",
        "key_rotation_versions": f"SELECT o_orderkey, version FROM {uses}",
        "key_usage": f"SELECT subject, version, count(*) AS encryption_count FROM {uses} GROUP BY ALL",
        "tombstone_blocks_mint": f"SELECT {OWNER}, CAST(1 AS BIGINT) AS version FROM customer WHERE c_nationkey <> {GONE}",
        "identifier_violations": r"SELECT c_custkey FROM customer WHERE NOT regexp_full_match(c_name, '[A-Za-z0-9\-_.:@+]{1,255}')",
        "read_mismatch_classify": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey > (SELECT min(c_custkey) FROM customer) THEN 'SHRED-SUBJECT-MISMATCH' ELSE 'OK' END AS state FROM customer",
        "chain_hashes": f"WITH RECURSIVE r AS (SELECT c_custkey + 1 AS seq, 'p' || c_custkey AS p, (1700000000000000 + c_custkey * 1500120) % 1000000 AS us, make_timestamp(CAST(1700000000000000 + c_custkey * 1500120 AS BIGINT)) AS t FROM customer), s AS (SELECT seq, p, {text} AS ts FROM r), b AS (SELECT seq, ts, {body} AS body FROM s), c AS (SELECT CAST(0 AS BIGINT) AS seq, '' AS ts, '' AS prev_hash, repeat('0', 64) AS hash UNION ALL SELECT CAST(b.seq AS BIGINT), b.ts, c.hash, sha256(b.body || '|64:' || c.hash) FROM c JOIN b ON b.seq = c.seq + 1) SELECT seq, ts, prev_hash, hash FROM c WHERE seq > 0",
        "chain_verify_intact": state.format("INTACT_UNKEYED", "NULL"),
        "chain_verify_broken_at": state.format("BROKEN", "7"),
        "chain_anchor_mismatch": state.format("ANCHOR_MISMATCH", "NULL"),
    }
