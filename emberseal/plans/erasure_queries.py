"""Queries for typed values, erasure and its checks, and the trail, with DuckDB SQL for the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.crypto import pads
from ..operators import chain, erasure, keys
from ..operators.blind_index import normalised
from ..operators.seal import SealSpec, open_columns, seal
from ..sources.stored import stored
from .queries import GONE, MASTER, OWNER, SPEC, _customers, _indexed, _owners, _sealed, _trail

RING = {k: hashlib.sha256(f"synthetic {k} secret".encode()).digest() for k in ("k1", "k2")}


def _opened(df: DataFrame, spec: SealSpec) -> DataFrame:
    """df sealed, written, read and opened again."""
    made = keys.mint(spec.owned(df).select("tenant", "subject"), None, None, MASTER)
    types = {f: t for f, t in df.dtypes if f in spec.fields}
    return open_columns(stored(seal(df, spec, made, MASTER)), spec, made, MASTER, types)


def open_date(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    spec = SealSpec("orders", "o_orderkey", "'t'", "concat('cust-', o_custkey)", ("o_orderdate",))
    return _opened(o, spec).select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))


def open_json(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "props")
    return _opened(e, SealSpec("events", "event_id", "'t'", "concat('user-', user_id)", ("props",))).select("event_id", "props")


def open_binary(spark: SparkSession, d: str) -> DataFrame:
    """A binary column of rows known by a text id."""
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_name", "n_regionkey", F.unhex(F.lpad(F.hex("n_nationkey"), 4, "0")).alias("code"))
    spec = SealSpec("nation", "n_name", "'t'", "concat('region-', n_regionkey)", ("code",), id_kind="string")
    return _opened(n, spec).select("n_name", F.lower(F.hex("code")).alias("code_hex"))


def rowid_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d).withColumn("u", F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.lower(F.hex("c_custkey")), 12, "0")))
    shown = lambda x, kind: F.lower(F.hex(formats.row_id(x, kind)))
    return c.select("c_custkey", shown(F.col("u"), "uuid").alias("as_uuid"), shown(F.col("c_name"), "string").alias("as_text"), shown(F.encode("c_name", "UTF-8"), "binary").alias("as_bytes"))


def normalised_decimal(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select("c_custkey", normalised(F.col("c_acctbal"), "decimal(18,2)").alias("plain"))


def blind_index_frequency(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d).groupBy("tenant", "c_name_bidx").agg(F.count("*").alias("n")).groupBy("tenant").agg(F.max("n").alias("most"), F.count("*").alias("n_values"))


def _gone(spark: SparkSession, d: str) -> DataFrame:
    return _owners(_customers(spark, d)).filter(F.col("c_nationkey") == GONE)


def erase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Keys destroyed and index values cleared by tenant."""
    made = keys.mint(_owners(_customers(spark, d)), None, None, MASTER)
    told = erasure.requested(_gone(spark, d), made, made.limit(0)).groupBy("tenant").agg(F.sum("keys_destroyed").alias("keys_destroyed"))
    held = _indexed(spark, d)
    left = erasure.clear_index(held, "c_name_bidx", _gone(spark, d)).groupBy("tenant").agg(F.count("c_name_bidx").alias("n_left"))
    before = held.groupBy("tenant").agg(F.count("c_name_bidx").alias("n"))
    return told.join(before, "tenant").join(left, "tenant").select("tenant", "keys_destroyed", (F.col("n") - F.col("n_left")).alias("blind_index_cleared"))


def already_erased_classify(spark: SparkSession, d: str) -> DataFrame:
    """A request for every subject, after one nation was erased and while every fifth customer never had a key."""
    o = _owners(_customers(spark, d))
    made = keys.destroy(keys.mint(o.filter(F.col("c_custkey") % 5 != 0), None, None, MASTER), _gone(spark, d))
    stones = erasure.buried(_gone(spark, d).limit(0).select("tenant", "subject"), _gone(spark, d))
    return erasure.requested(o, made, stones)


def index_residue(spark: SparkSession, d: str) -> DataFrame:
    """After clearing, with every second row of the erased subjects moved to another tenant beforehand."""
    moved = _indexed(spark, d).withColumn("tenant", F.when((F.col("c_nationkey") == GONE) & (F.col("c_custkey") % 2 == 0), "elsewhere").otherwise(F.col("tenant")))
    return erasure.residue(erasure.clear_index(moved, "c_name_bidx", _gone(spark, d)), "c_name_bidx", _gone(spark, d))


def write_settlement_bad_rows(spark: SparkSession, d: str) -> DataFrame:
    return erasure.unsettled(_sealed(spark, d)[0], SPEC).select("c_custkey", "field", "state")


def subject_moved_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh row now belongs to the next nation, with the values stored before."""
    moved = _sealed(spark, d)[0].withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return erasure.unsettled(moved, SPEC).select("c_custkey", "field", "state")


def backup_clear_dates(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", F.date_format(erasure.clear_date(F.col("o_orderdate").cast("timestamp"), 35), "yyyy-MM-dd HH:mm:ss").alias("clear_at"))


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """The trail under two keys, the second from record 11 on."""
    bare = _trail(spark, d).drop("prev_hash", "hash")
    return stored(chain.append(bare.withColumn("key_id", F.when(F.col("seq") <= 10, "k1").otherwise("k2")), RING))


def chain_keyed_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(spark, d).select("seq", "prev_hash", "hash")


def _keyed_verdict(spark: SparkSession, d: str, ring: dict[str, bytes] | None) -> DataFrame:
    t = _keyed(spark, d)
    end = t.agg(F.max_by("hash", "seq").alias("head"), F.count("*").alias("n")).first()  # the anchor
    return chain.verify(t, end["head"], end["n"], ring)


def chain_verify_keyed(spark: SparkSession, d: str) -> DataFrame:
    return _keyed_verdict(spark, d, RING)


def chain_verify_unknown_key(spark: SparkSession, d: str) -> DataFrame:
    return _keyed_verdict(spark, d, {"k1": RING["k1"]})


def chain_verify_no_anchor(spark: SparkSession, d: str) -> DataFrame:
    return chain.verify(_trail(spark, d), None, 0)


def trail_page(spark: SparkSession, d: str) -> DataFrame:
    return chain.after(_trail(spark, d), 5, 10).select("seq", "subject_pseudonym")


def _hooked(spark: SparkSession, d: str) -> DataFrame:
    """The trail dealt to five subjects; record seq runs hooks a and b, a succeeds on even and b on every third."""
    hook = lambda name, ok: F.struct(F.lit(name).alias("hook"), ok.alias("succeeded"), F.when(~ok, "pending").alias("detail"))
    seq = F.col("seq")
    return _trail(spark, d).select("seq", "tenant", F.concat(F.lit("p"), seq % 5).alias("subject_pseudonym"), F.array(hook("a", seq % 2 == 0), hook("b", seq % 3 == 0)).alias("hook_outcomes"))


def latest_record_by_subject(spark: SparkSession, d: str) -> DataFrame:
    return chain.latest(_hooked(spark, d)).select("tenant", "subject_pseudonym", "seq")


def outstanding_hooks(spark: SparkSession, d: str) -> DataFrame:
    return chain.outstanding(_hooked(spark, d))


def hook_texts(spark: SparkSession, d: str) -> DataFrame:
    return _hooked(spark, d).select("seq", chain.hook_material(F.col("hook_outcomes")).alias("material"))


ALL = (open_date, open_json, open_binary, rowid_kinds, normalised_decimal, blind_index_frequency, erase_counts, already_erased_classify, index_residue, write_settlement_bad_rows, subject_moved_rows, backup_clear_dates, chain_keyed_hashes, chain_verify_keyed, chain_verify_unknown_key, chain_verify_no_anchor, trail_page, latest_record_by_subject, outstanding_hooks, hook_texts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    own = f"(SELECT *, {OWNER} FROM customer)"
    ring = ", ".join("('{}', '{}', '{}')".format(k, *(p.hex() for p in pads(s))) for k, s in RING.items())
    body = "'sh2h|2:' || key_id || '|' || strlen(ts) || ':' || ts || '|1:t' || '|' || strlen(p) || ':' || p || '|7:officer|-|1:1|1:1|1:2|1:0|8:COMPLETE|0:|20:2026-01-01T00:00:00Z'"
    ts = "strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us = 0 THEN '' WHEN us % 1000 = 0 THEN '.' || lpad(CAST(us // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(us AS VARCHAR), 6, '0') END || 'Z'"
    mac = "sha256(unhex(b.opad) || unhex(sha256(unhex(b.ipad) || encode(b.body || '|64:' || c.hash))))"
    hooked = "(SELECT c_custkey + 1 AS seq, 'p' || (c_custkey + 1) % 5 AS p FROM customer)"
    last = f"(SELECT p, CAST(max(seq) AS BIGINT) AS seq FROM {hooked} GROUP BY p)"
    bal = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)"
    moved = "c_custkey % 7 = 0"
    state = "SELECT '{}' AS status, CAST({} AS BIGINT) AS broken_at"
    return {
        "open_date": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
        "open_json": "SELECT event_id, props FROM events",
        "open_binary": "SELECT n_name, printf('%04x', n_nationkey) AS code_hex FROM nation",
        "rowid_kinds": "SELECT c_custkey, '02' || repeat('0', 20) || printf('%012x', c_custkey) AS as_uuid, '03' || lower(hex(encode(c_name))) AS as_text, '04' || lower(hex(encode(c_name))) AS as_bytes FROM customer",
        "normalised_decimal": f"SELECT c_custkey, rtrim(rtrim({bal}, '0'), '.') AS plain FROM customer",
        "blind_index_frequency": f"SELECT tenant, max(n) AS most, count(*) AS n_values FROM (SELECT tenant, lower(trim(c_name)) AS v, count(*) AS n FROM {own} GROUP BY ALL) GROUP BY tenant",
        "erase_counts": f"SELECT tenant, CAST(count(DISTINCT subject) AS BIGINT) AS keys_destroyed, count(c_name) AS blind_index_cleared FROM {own} WHERE c_nationkey = {GONE} GROUP BY tenant",
        "already_erased_classify": f"SELECT DISTINCT tenant, subject, CAST(c_nationkey <> {GONE} AND c_custkey % 5 <> 0 AS BIGINT) AS keys_destroyed, c_nationkey = {GONE} AS already_erased FROM {own}",
        "index_residue": f"SELECT tenant, subject, CAST(0 AS BIGINT) AS residual, CAST(sum(CAST(c_custkey % 2 = 0 AS INT)) AS BIGINT) AS elsewhere FROM {own} WHERE c_nationkey = {GONE} GROUP BY ALL",
        "write_settlement_bad_rows": "SELECT c_custkey, '' AS field, '' AS state FROM customer WHERE false",
        "subject_moved_rows": f"SELECT c_custkey, field, 'SHRED-SUBJECT-MISMATCH' AS state FROM customer, (VALUES ('c_name'), ('c_acctbal')) f(field) WHERE {moved}",
        "backup_clear_dates": "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 35 DAY, '%Y-%m-%d %H:%M:%S') AS clear_at FROM orders",
        "chain_keyed_hashes": f"WITH RECURSIVE r AS (SELECT c_custkey + 1 AS seq, CASE WHEN c_custkey < 10 THEN 'k1' ELSE 'k2' END AS key_id, 'p' || c_custkey AS p, (1700000000000000 + c_custkey * 1500120) % 1000000 AS us, make_timestamp(CAST(1700000000000000 + c_custkey * 1500120 AS BIGINT)) AS t FROM customer), s AS (SELECT seq, key_id, p, {ts} AS ts FROM r), b AS (SELECT seq, {body} AS body, ipad, opad FROM s JOIN (VALUES {ring}) k(key_id, ipad, opad) USING (key_id)), c AS (SELECT CAST(0 AS BIGINT) AS seq, '' AS prev_hash, repeat('0', 64) AS hash UNION ALL SELECT CAST(b.seq AS BIGINT), c.hash, {mac} FROM c JOIN b ON b.seq = c.seq + 1) SELECT seq, prev_hash, hash FROM c WHERE seq > 0",
        "chain_verify_keyed": state.format("INTACT", "NULL"),
        "chain_verify_unknown_key": state.format("BROKEN", "11"),
        "chain_verify_no_anchor": state.format("NO_ANCHOR", "NULL"),
        "trail_page": "SELECT CAST(c_custkey + 1 AS BIGINT) AS seq, 'p' || c_custkey AS subject_pseudonym FROM customer WHERE c_custkey + 1 > 5 ORDER BY seq LIMIT 10",
        "latest_record_by_subject": f"SELECT 't' AS tenant, p AS subject_pseudonym, seq FROM {last}",
        "outstanding_hooks": f"SELECT 't' AS tenant, p AS subject_pseudonym, seq, hook, 'pending' AS detail FROM {last}, (VALUES ('a', 2), ('b', 3)) h(hook, every) WHERE seq % every <> 0",
        "hook_texts": "SELECT CAST(c_custkey + 1 AS BIGINT) AS seq, CASE WHEN c_custkey % 2 = 1 THEN '|1:a|4:true|-' ELSE '|1:a|5:false|7:pending' END || CASE WHEN c_custkey % 3 = 2 THEN '|1:b|4:true|-' ELSE '|1:b|5:false|7:pending' END AS material FROM customer",
    }
