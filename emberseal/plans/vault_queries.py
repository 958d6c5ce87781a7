"""Queries over tables in a ledger, with DuckDB SQL for the same rows.

Each writes a ledger of its own beside the checkpoints.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission
from ..operators.vault import KEYS, LOG, Vault
from ..sources.ledger import Ledger
from .queries import GONE, INDEX, MASTER, OWNER, PEPPER, SPEC, TYPES, _customers

NOW = datetime(2026, 1, 1, tzinfo=UTC)


def _vault(spark: SparkSession, d: str, hooks=()) -> Vault:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledger-")
    v = Vault(Ledger(spark, f"{folder.rstrip('/')}/ledger-{uuid.uuid4().hex}"), MASTER, PEPPER, hooks=hooks, retention_days=35, clock=lambda: NOW)
    v.write("customer", _customers(spark, d), SPEC, INDEX, ("c_name",))
    return v


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """The customers of one nation."""
    mine = _customers(spark, d).filter(F.col("c_nationkey") == GONE)
    return SPEC.owned(mine).select("tenant", "subject", F.lit("officer").alias("requested_by"), F.lit(None).cast("string").alias("reason"))


def vault_open_after_erase(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d)
    v.erase(_requests(spark, d))
    return v.open("customer", SPEC, TYPES).select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("balance"))


def vault_erase_results(spark: SparkSession, d: str) -> DataFrame:
    return _vault(spark, d).erase(_requests(spark, d))


def vault_index_after_erase(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d)
    v.erase(_requests(spark, d))
    return v.table(v.ledger.head(), "customer").groupBy("tenant").agg(F.count("c_name_bidx").alias("n_indexed"), F.count("*").alias("n_rows"))


def vault_trail_with_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's record of the erasure, and the one of what the hooks did: one of them fails for every second subject."""

    def odd(tenant: str, subject: str) -> None:
        if int(subject.removeprefix("cust-")) % 2:
            raise LookupError

    v = _vault(spark, d, (("odd", odd),))
    v.erase(_requests(spark, d))
    return v.table(v.ledger.head(), LOG).select("seq", "tenant", "outcome", "hook_material", "keys_destroyed", "blind_index_cleared")


def vault_keys_after_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Customers have two sealed values: versions wear out after one."""
    v = _vault(spark, d)
    v.rotate_worn(1)
    return v.table(v.ledger.head(), KEYS).select("tenant", "subject", F.col("version").cast("long").alias("version"))


def vault_verify(spark: SparkSession, d: str) -> DataFrame:
    v = _vault(spark, d)
    v.erase(_requests(spark, d))
    return v.verify()


def admission_findings(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a tenant under a loose collation, a number for a subject and no index column."""
    bad = _customers(spark, d).selectExpr("*", "concat('n', c_nationkey) collate utf8_lcase as tenant", "c_custkey as subject")
    return spark.createDataFrame(admission.findings(bad, SPEC, ("c_name",)), "column string, finding string")


ALL = (vault_open_after_erase, vault_erase_results, vault_index_after_erase, vault_trail_with_hooks, vault_keys_after_rotation, vault_verify, admission_findings)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    own = f"(SELECT *, {OWNER} FROM customer)"
    gone = f"c_nationkey = {GONE}"
    bal = "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)"
    asked = f"(SELECT DISTINCT tenant, subject, c_custkey, row_number() OVER (ORDER BY tenant, subject) AS i, count(*) OVER () AS m FROM {own} WHERE {gone})"
    return {
        "vault_open_after_erase": f"SELECT c_custkey, CASE WHEN {gone} THEN '[erased]' ELSE c_name END AS c_name, CASE WHEN NOT ({gone}) THEN {bal} END AS balance FROM customer",
        "vault_erase_results": f"SELECT tenant, subject, 'COMPLETE' AS outcome, false AS already_erased, CAST(1 AS BIGINT) AS keys_destroyed, CAST(count(c_name) AS BIGINT) AS blind_index_cleared, '2026-02-05T00:00:00Z' AS complete_in_backups_at FROM {own} WHERE {gone} GROUP BY tenant, subject",
        "vault_index_after_erase": f"SELECT tenant, count(c_name) FILTER (NOT ({gone})) AS n_indexed, count(*) AS n_rows FROM {own} GROUP BY tenant",
        "vault_trail_with_hooks": f"SELECT CAST(i + step * m AS BIGINT) AS seq, tenant, CASE WHEN step = 0 OR c_custkey % 2 = 1 THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome, CASE WHEN step = 0 THEN '|3:odd|5:false|7:pending' WHEN c_custkey % 2 = 1 THEN '|3:odd|5:false|20:builtins.LookupError' ELSE '|3:odd|4:true|-' END AS hook_material, CAST(1 AS BIGINT) AS keys_destroyed, CAST(1 AS BIGINT) AS blind_index_cleared FROM {asked}, (VALUES (0), (1)) s(step)",
        "vault_keys_after_rotation": f"SELECT DISTINCT tenant, subject, CAST(version AS BIGINT) AS version FROM {own}, (VALUES (1), (2)) v(version)",
        "vault_verify": "SELECT 'INTACT_UNKEYED' AS status, CAST(NULL AS BIGINT) AS broken_at",
        "admission_findings": "SELECT * FROM (VALUES ('tenant', 'has a collation under which different texts are equal'), ('subject', 'is not a text column'), ('c_name_bidx', 'is not a nullable binary column')) f(\"column\", finding)",
    }
