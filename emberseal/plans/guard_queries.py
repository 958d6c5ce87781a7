"""Refusals and checks, each by its number in the inventory, with DuckDB SQL for the same rows.

Where a query shows what an attempt comes to, its rows are (attempt, code).
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SealError
from ..functions import formats
from ..functions.log_text import log_text
from ..operators import admission, chain, erasure, keys
from ..operators.seal import SealSpec, markers, open_columns, seal
from ..operators.vault import LOG, Vault
from ..sources.ledger import Ledger
from ..sources.stored import stored
from .queries import INDEX, MASTER, PEPPER, SPEC, TYPES, _customers, _owners, _sealed, _trail
from .vault_queries import NOW

NATIONS = SealSpec("nation", "n_nationkey", "'t'", "concat('n-', n_nationkey)", ("n_name",))


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledger-")
    return f"{folder.rstrip('/')}/ledger-{uuid.uuid4().hex}"


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")


def _vault(spark: SparkSession, d: str, **more) -> Vault:
    v = Vault(Ledger(spark, _folder(spark)), MASTER, PEPPER, clock=lambda: NOW, **more)
    v.write("nation", _nations(spark, d), NATIONS, INDEX, ("n_name",))
    return v


def _ask(spark: SparkSession, *numbers: int) -> DataFrame:
    return spark.createDataFrame([("t", f"n-{i}", "officer", None) for i in numbers], "tenant string, subject string, requested_by string, reason string")


def _code(attempt: Callable[[], object]) -> str:
    try:
        attempt()
    except SealError as error:
        return error.code
    except Exception as error:  # raised inside a running plan
        found = re.search(r"SHRED-[A-Z]+(?:-[A-Z0-9]+)*", str(error))
        return found[0] if found else type(error).__name__
    return "OK"


def _codes(spark: SparkSession, **attempts: Callable[[], object]) -> DataFrame:
    return spark.createDataFrame([(name, _code(f)) for name, f in attempts.items()], "attempt string, code string")


def a6_trail_state(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d)
    before = v.trail_state()
    v.erase(_ask(spark, 1, 2, 3))
    rows = [(when, s["anchored"], s["keyed"], s["count"], s["non_empty"]) for when, s in (("before", before), ("after", v.trail_state()))]
    return spark.createDataFrame(rows, "at string, anchored boolean, keyed boolean, count long, non_empty boolean")


def a7_health(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d)
    good = v.healthy()
    table = v.ledger.head().tables["data_key"]
    for folder in table["dirs"]:
        v.ledger._fs.delete(v.ledger._path(f"{v.ledger.root}/{folder}"), True)
    return spark.createDataFrame([("whole", good), ("keys gone", v.healthy())], "store string, healthy boolean")


def b1_distinct_nonces(spark: SparkSession, d: str) -> DataFrame:
    rows = _sealed(spark, d)[0].select(F.explode(F.array("c_name", "c_acctbal")).alias("v"))
    nonce = F.substring(formats.parsed(F.col("v"))["sealed"], 1, 12)
    return rows.agg(F.countDistinct(nonce).alias("n_nonces"), F.count("*").alias("n_values"))


def b5_uuid_ids(spark: SparkSession, d: str) -> DataFrame:
    """Customers known by UUIDs, sealed, written and opened."""
    m = F.md5(F.col("c_custkey").cast("string"))
    dashed = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    c = _customers(spark, d).select(dashed.alias("id"), "c_custkey", "c_name")
    return _through(c, SealSpec("person", "id", "'t'", "concat('cust-', c_custkey)", ("c_name",), "uuid")).select("id", "c_name")


def b5_binary_ids(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d).select(F.unhex(F.md5(F.col("c_custkey").cast("string"))).alias("id"), "c_custkey", "c_name")
    return _through(c, SealSpec("person", "id", "'t'", "concat('cust-', c_custkey)", ("c_name",), "binary")).select(F.lower(F.hex("id")).alias("id"), "c_name")


def _through(df: DataFrame, spec: SealSpec) -> DataFrame:
    made = keys.mint(spec.owned(df).select("tenant", "subject"), None, None, MASTER)
    return open_columns(stored(seal(df, spec, made, MASTER)), spec, made, MASTER, {})


def b8_marker_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose name reads like the marker of erased values."""
    c = _customers(spark, d).withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, "[erased]").otherwise(F.col("c_name")))
    return markers(c, SPEC).select("c_custkey")


def b8_marker_refused(spark: SparkSession, d: str) -> DataFrame:
    v = Vault(Ledger(spark, _folder(spark)), MASTER, PEPPER, clock=lambda: NOW)
    marked = _nations(spark, d).withColumn("n_name", F.when(F.col("n_nationkey") == 4, "[erased]").otherwise(F.col("n_name")))
    minted = keys.mint(NATIONS.owned(marked), None, None, MASTER)
    return _codes(spark, write=lambda: v.write("nation", marked, NATIONS), seal=lambda: seal(marked, NATIONS, minted, MASTER).collect(), plain=lambda: seal(_nations(spark, d), NATIONS, minted, MASTER).collect())


def b9_b10_owner_refused(spark: SparkSession, d: str) -> DataFrame:
    v = Vault(Ledger(spark, _folder(spark)), MASTER, PEPPER, clock=lambda: NOW)
    spec = lambda tenant, subject: SealSpec("nation", "n_nationkey", tenant, subject, ("n_name",))
    n = _nations(spark, d)
    return _codes(spark, no_tenant=lambda: v.write("nation", n, spec("cast(null as string)", "n_name")), no_subject=lambda: v.write("nation", n, spec("'t'", "nullif(n_name, n_name)")), bad_subject=lambda: v.write("nation", n, spec("'t'", "concat('a b', n_nationkey)")))


def c2_c5_reads_refused(spark: SparkSession, d: str) -> DataFrame:
    """A text that was tampered with, a destroyed key under EXCEPTION, a table without its id, an unknown policy."""
    n = _nations(spark, d)
    minted = keys.mint(NATIONS.owned(n), None, None, MASTER)
    sealed = stored(seal(n, NATIONS, minted, MASTER))
    end = F.octet_length("n_name")
    flipped = sealed.withColumn("n_name", F.concat(F.substr("n_name", F.lit(1), end - 1), F.unhex(F.hex((F.conv(F.hex(F.substr("n_name", end, F.lit(1))), 16, 10).cast("int") + 1) % 256))).cast("binary"))
    read = lambda df, k, policy="SENTINEL": open_columns(df, NATIONS, k, MASTER, {}, policy).collect()
    gone = keys.destroy(minted, NATIONS.owned(n).filter("n_nationkey = 1"))
    other = keys.mint(NATIONS.owned(n), None, None, MASTER)
    return _codes(spark, intact=lambda: read(sealed, minted), tampered=lambda: read(flipped, minted), other_key=lambda: read(sealed, other), destroyed=lambda: read(sealed, gone, "EXCEPTION"), marker=lambda: read(sealed, gone), no_id=lambda: read(sealed.drop("n_nationkey"), minted), no_policy=lambda: read(sealed, minted, "HIDE"))


def d5_over_limit(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose key has sealed a value per order so far and gets one per urgent order more, over a limit of 12."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("t").alias("tenant"), F.concat(F.lit("cust-"), "o_custkey").alias("subject"), "o_orderpriority")
    n = lambda df: df.groupBy("tenant", "subject").agg(F.count("*").alias("n"))
    return keys.over_limit(n(o), n(o.filter("o_orderpriority = '1-URGENT'")), 12)


def d5_limit_rotates(spark: SparkSession, d: str) -> DataFrame:
    """Keys that may seal two values: a third batch gets new ones, a batch of too many values is refused."""
    v = Vault(Ledger(spark, _folder(spark)), MASTER, PEPPER, clock=lambda: NOW, limit=2)
    for shift in (0, 100, 200):
        v.write("nation", _nations(spark, d).withColumn("n_nationkey", F.col("n_nationkey") + shift), SealSpec("nation", "n_nationkey", "'t'", "concat('n-', n_nationkey % 100)", ("n_name",)))
    return v.used().select("subject", F.col("version").cast("long").alias("version"), "n")


def f11_acknowledged_copies(spark: SparkSession, d: str) -> DataFrame:
    """Erasures with a declared copy of the index: not acknowledged, acknowledged, and with an acknowledgement of nothing."""
    copy = (admission.Copy("stream", "nation", "n_name_bidx", "mirror"),)
    said = (admission.Acknowledged("stream", "nation", "n_name_bidx", "mirror", "nightly job"),)
    v = _vault(spark, d)

    def tried(copies, acknowledged):
        return lambda: Vault(v.ledger, MASTER, PEPPER, clock=lambda: NOW, copies=copies, acknowledged=acknowledged).erase(_ask(spark, 1))

    return _codes(spark, open=tried(copy, ()), idle=tried((), said), other_name=tried(copy, (admission.Acknowledged("stream", "nation", "n_name_bidx", "Mirror", "nightly job"),)), unknown_kind=lambda: admission.Acknowledged("view", "nation", "n_name_bidx", "mirror", "x"), acknowledged=tried(copy, said))


def f11_record_names_copies(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d, copies=(admission.Copy("export", "nation", "n_name_bidx", "lake"),), acknowledged=(admission.Acknowledged("export", "nation", "n_name_bidx", "lake", "retention"),))
    v.erase(_ask(spark, 1, 2))
    return v.table(v.ledger.head(), LOG).select("seq", "outcome", "hook_material")


def g6_garbled_records(spark: SparkSession, d: str) -> DataFrame:
    """The trail with a record whose hash is no text, one without a time, and one twice: each breaks the chain where it stands."""
    t = _trail(spark, d)
    end = t.agg(F.max_by("hash", "seq").alias("head"), F.count("*").alias("n")).first()
    at = F.col("seq")
    changed = {"no_hash": t.withColumn("hash", F.when(at != 9, F.col("hash"))), "no_time": t.withColumn("ts", F.when(at != 4, F.col("ts"))), "twice": t.unionByName(t.filter("seq = 6")), "no_seq": t.withColumn("seq", F.when(at != 3, at)), "gap": t.filter("seq <> 12")}
    told = [chain.verify(x, end["head"], end["n"]).select(F.lit(name).alias("change"), "status", "broken_at") for name, x in changed.items()]
    out = told[0]
    for x in told[1:]:
        out = out.unionByName(x)
    return out


def g9_g10_trail_guards(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d)
    v.erase(_ask(spark, 1, 2))
    now = v.ledger.head()
    log, a = v.table(now, LOG), now.anchor
    return _codes(
        spark,
        replace=lambda: v.ledger.commit(now, replace={LOG: log.filter("seq = 1")}, anchor=a),
        lower=lambda: v.ledger.commit(now, anchor=a | {"count": 1}),
        jump=lambda: v.ledger.commit(now, append={LOG: log.limit(1)}, anchor=a | {"count": 9, "head": "x"}),
        same_head=lambda: v.ledger.commit(now, append={LOG: log.limit(1)}, anchor=a | {"count": 3}),
        no_anchor=lambda: v.ledger.commit(now, append={LOG: log.limit(1)}),
        keyed=lambda: v.ledger.commit(now, append={LOG: log.limit(1)}, anchor={"count": 3, "head": "x", "keyed": True}),
    )


def h2_tampered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every third name is another row's, every fifth balance lost its end, as read back after a write."""
    s = _sealed(spark, d)[0].select("c_custkey", "c_nationkey", "c_name", "c_acctbal")
    other = s.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("c_name").alias("other"))
    k = F.col("c_custkey")
    cut = F.expr("substr(c_acctbal, 1, octet_length(c_acctbal) - 1)")
    bad = s.join(other, "c_custkey").withColumns({"c_name": F.when(k % 3 == 0, F.col("other")).otherwise(F.col("c_name")), "c_acctbal": F.when(k % 5 == 0, cut).otherwise(F.col("c_acctbal"))})
    return erasure.unsettled(bad, SPEC).select("c_custkey", "field", "state")


def h3_moved_rows(spark: SparkSession, d: str) -> DataFrame:
    """An update that gives every seventh customer another nation and brings one that isn't there."""
    sealed = _sealed(spark, d)[0]
    new = _customers(spark, d).withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    extra = new.limit(1).withColumn("c_custkey", F.lit(-1).cast("long"))
    return erasure.moved(sealed, new.unionByName(extra), SPEC)


def h3_update(spark: SparkSession, d: str) -> DataFrame:
    """Nations renamed by an update; one that moves to another subject is refused as a whole."""
    v = _vault(spark, d)
    n = _nations(spark, d)
    v.update("nation", n.filter("n_nationkey < 5").withColumn("n_name", F.concat("n_name", F.lit("!"))), NATIONS, INDEX, ("n_name",))
    moved = SealSpec("nation", "n_nationkey", "'t'", "concat('n-', n_nationkey + 1)", ("n_name",))
    code = _code(lambda: v.update("nation", n.filter("n_nationkey > 20"), moved, INDEX, ("n_name",)))
    return v.open("nation", NATIONS, {}).select("n_nationkey", "n_name", F.lit(code).alias("code"))


def k1_k7_targets(spark: SparkSession, d: str) -> DataFrame:
    spark.range(1).createOrReplaceTempView("k4_view")
    root = d.rstrip("/")
    asked = [("view", "k4_view", (), ()), ("name", "nowhere", (), ()), ("missing", f"{root}/none.parquet", (), ()), ("nested", f"{root}/nation.parquet", (root,), ()), ("parent", root, (f"{root}/nation.parquet",), ()), ("partition", f"{root}", (), ("none",)), ("good", f"{root}/nation.parquet", (f"{root}/nation",), ())]
    rows = [(name, what) for name, *rest in asked for _, what in admission.target_findings(spark, *rest)]
    return spark.createDataFrame(rows, "target string, finding string")


def k17_k21_copies(spark: SparkSession, d: str) -> DataFrame:
    """A table with a column named like the index, in another case."""
    v = _vault(spark, d)
    rows = v.table(v.ledger.head(), "nation").select("n_nationkey", F.col("n_name_bidx").alias("N_NAME_BIDX"))
    v.ledger.commit(v.ledger.head(), append={"nation_history": rows})
    found = spark.createDataFrame(admission.index_copies(v.ledger.head()), "table string, column string")
    return found.withColumn("code", F.lit(_code(lambda: v.erase(_ask(spark, 1)))))


def k22_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Columns of which files hold bounds: of the index as written here, and as Spark writes by itself."""
    v = _vault(spark, d)
    now = v.ledger.head()
    v.table(now, "nation").write.parquet(f"{v.ledger.root}/plain")
    own = v.ledger.bounded(now.tables["nation"]["dirs"][0], ["n_name_bidx"])
    plain = v.ledger.bounded("plain", ["n_name_bidx"])
    return spark.createDataFrame([("here", len(own)), ("plain", len(plain))], "files string, n long")


def l17_log_text(spark: SparkSession, d: str) -> DataFrame:
    c = _customers(spark, d)
    odd = F.element_at(F.array(*map(F.lit, ("\n", "\\", "\u202e", "é", "\x7f", "\u2028"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return c.select("c_custkey", log_text(F.concat("c_name", odd, F.lit("x"))).alias("line"))


ALL = (a6_trail_state, a7_health, b1_distinct_nonces, b5_uuid_ids, b5_binary_ids, b8_marker_rows, b8_marker_refused, b9_b10_owner_refused, c2_c5_reads_refused, d5_over_limit, d5_limit_rotates, f11_acknowledged_copies, f11_record_names_copies, g6_garbled_records, g9_g10_trail_guards, h2_tampered_rows, h3_moved_rows, h3_update, k1_k7_targets, k17_k21_copies, k22_bounds, l17_log_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _values(columns: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) v({columns})"


def oracle_sql() -> dict[str, str]:
    codes = lambda **said: _values("attempt, code", *(f"'{a}', '{c}'" for a, c in said.items()))
    m = "md5(CAST(c_custkey AS VARCHAR))"
    dashed = " || '-' || ".join(f"substr({m}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    escaped = r"'\u000A', '\\', '\u202E', 'é', '\u007F', '\u2028'"
    first = "(SELECT min(c_custkey) FROM customer)"
    return {
        "a6_trail_state": _values('"at", anchored, keyed, count, non_empty', "'before', false, false, CAST(0 AS BIGINT), false", "'after', true, false, CAST(3 AS BIGINT), true"),
        "a7_health": _values("store, healthy", "'whole', true", "'keys gone', false"),
        "b1_distinct_nonces": "SELECT count(c_name) + count(c_acctbal) AS n_nonces, count(c_name) + count(c_acctbal) AS n_values FROM customer",
        "b5_uuid_ids": f"SELECT {dashed} AS id, c_name FROM customer",
        "b5_binary_ids": f"SELECT {m} AS id, c_name FROM customer",
        "b8_marker_rows": "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0",
        "b8_marker_refused": codes(write="SHRED-ERASED-001", seal="SHRED-ERASED-001", plain="OK"),
        "b9_b10_owner_refused": codes(no_tenant="SHRED-TENANT-MISSING", no_subject="SHRED-SUBJECT-UNRESOLVED", bad_subject="SHRED-INVALID-001"),
        "c2_c5_reads_refused": codes(intact="OK", tampered="SHRED-DECRYPT-001", other_key="SHRED-DECRYPT-001", destroyed="SHRED-KEY-DESTROYED", marker="OK", no_id="SHRED-READ-UNSCOPED", no_policy="SHRED-CONFIG-001"),
        "d5_over_limit": "SELECT 't' AS tenant, 'cust-' || o_custkey AS subject, count(*) + count(*) FILTER (o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY o_custkey HAVING count(*) + count(*) FILTER (o_orderpriority = '1-URGENT') > 12",
        "d5_limit_rotates": "SELECT 'n-' || n_nationkey AS subject, CAST(v AS BIGINT) AS version, CAST(3 - v AS BIGINT) AS n FROM nation, (VALUES (1), (2)) x(v)",
        "f11_acknowledged_copies": codes(open="SHRED-SCHEMA-010", idle="SHRED-CONFIG-001", other_name="SHRED-SCHEMA-010", unknown_kind="SHRED-CONFIG-001", acknowledged="OK"),
        "f11_record_names_copies": _values("seq, outcome, hook_material", *(f"CAST({i} AS BIGINT), 'COMPLETE', '|35:copy:export:nation.n_name_bidx:lake|4:true|9:retention'" for i in (1, 2))),
        "g6_garbled_records": _values("change, status, broken_at", "'no_hash', 'BROKEN', CAST(9 AS BIGINT)", "'no_time', 'BROKEN', 4", "'twice', 'BROKEN', 6", "'no_seq', 'BROKEN', 0", "'gap', 'BROKEN', 13"),
        "g9_g10_trail_guards": codes(replace="SHRED-ERASURE-002", lower="SHRED-ERASURE-002", jump="SHRED-ERASURE-002", same_head="SHRED-ERASURE-002", no_anchor="SHRED-ERASURE-002", keyed="SHRED-ERASURE-003"),
        "h2_tampered_rows": f"SELECT c_custkey, 'c_name' AS field, 'SHRED-SUBJECT-MISMATCH' AS state FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > {first} UNION ALL SELECT c_custkey, 'c_acctbal', 'SHRED-FORMAT-001' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > {first}",
        "h3_moved_rows": "SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT -1",
        "h3_update": "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN n_name || '!' ELSE n_name END AS n_name, 'SHRED-SUBJECT-IMMUTABLE' AS code FROM nation",
        "k1_k7_targets": _values("target, finding", "'view', 'is a temporary view'", "'name', 'names no folder'", "'missing', 'does not exist'", "'nested', 'lies in the folder of another table'", "'parent', 'holds the folder of another table'", "'partition', 'is not readable under its table'"),
        "k17_k21_copies": _values('"table", "column", code', "'nation_history', 'N_NAME_BIDX', 'SHRED-SCHEMA-010'"),
        "k22_bounds": _values("files, n", "'here', CAST(0 AS BIGINT)", "'plain', 1"),
        "l17_log_text": f"SELECT c_custkey, c_name || (list_value({escaped}))[CAST(c_custkey % 6 + 1 AS INTEGER)] || 'x' AS line FROM customer",
    }
