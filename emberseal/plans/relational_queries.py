"""The relational operations the erasure engine's checks rest on, each as a query by its number, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SealError
from ..sources.stored import stored

#: Levels after which a walk is refused.
LEVELS = 1000
Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def i1_filters(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")).select("o_orderkey")


def i2_inner_join(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


def i3_left_join(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    return _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last")


def i4_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables of fixed size."""
    return _t(spark, d, "region").crossJoin(_t(spark, d, "nation")).select("r_regionkey", "n_nationkey", (F.col("r_regionkey") == F.col("n_regionkey")).alias("own"))


def i5_lateral(spark: SparkSession, d: str) -> DataFrame:
    _t(spark, d, "part").createOrReplaceTempView("i5_part")
    return spark.sql("SELECT p_partkey, word FROM i5_part, LATERAL explode(split(p_name, ' ')) AS w(word)")


def i6_ordinality(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word")).withColumn("place", (F.col("place") + 1).cast("long"))


def i7_or_join(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with a customer's key or name number, as a union of two equi-joins, where OR would compare all pairs."""
    c = _t(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = _t(spark, d, "supplier").select("s_suppkey", "s_nationkey").withColumn("twice", F.col("s_suppkey") * 2)
    one = c.join(s, F.col("c_custkey") == F.col("s_suppkey")).select("c_custkey", "s_suppkey")
    two = c.join(s, F.col("c_custkey") == F.col("twice")).select("c_custkey", "s_suppkey")
    return one.unionByName(two).distinct()


def i8_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def i9_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def i10_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    _t(spark, d, "customer").createOrReplaceTempView("i10_customer")
    _t(spark, d, "orders").createOrReplaceTempView("i10_orders")
    return spark.sql("SELECT c_custkey, (SELECT max(o_orderkey) FROM i10_orders WHERE o_custkey = c_custkey) AS last FROM i10_customer")


def i11_any_subquery(spark: SparkSession, d: str) -> DataFrame:
    _t(spark, d, "customer").createOrReplaceTempView("i11_customer")
    _t(spark, d, "nation").createOrReplaceTempView("i11_nation")
    return spark.sql("SELECT c_custkey FROM i11_customer WHERE c_nationkey IN (SELECT n_nationkey FROM i11_nation WHERE n_regionkey = 2)")


def i12_derived_table(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.filter("n > 5").select("o_custkey", "n")


def i13_union_all(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(_t(spark, d, "supplier").select(F.col("s_name").alias("name")))


def i14_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


def i15_count(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").agg(F.count("*").alias("n"))


def i16_group_by(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


def i17_string_agg(spark: SparkSession, d: str) -> DataFrame:
    """Names in order as one text, distinct regions as another."""
    n = _t(spark, d, "nation")
    return n.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.array_join(F.array_sort(F.collect_set(F.length("n_name").cast("string"))), ",").alias("lengths"))


def i18_min(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))


def i19_case(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large")
    return _t(spark, d, "part").select("p_partkey", kind.alias("kind"))


def i20_top(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey")


def i21_text(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    parts = F.split("c_name", "#", -1)
    return c.select("c_custkey", F.concat("c_mktsegment", F.lit("/"), "c_name").alias("joined"), F.concat_ws("-", F.lit("a"), F.lit(None).cast("string"), "c_mktsegment").alias("joined_ws"), F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("number"), F.instr("c_name", "#").cast("long").alias("at"), F.startswith(F.col("c_name"), F.lit("Cust")).alias("starts"), F.array_join(parts, "|").alias("rejoined"), F.size(parts).cast("long").alias("n_parts"), F.char(F.lit(65) + F.col("c_custkey") % 26).alias("letter"), F.col("c_custkey").cast("string").alias("text"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Customer k refers to k * 3 + 1 and to k * 5 + 2, modulo 97, so the graph has cycles."""
    k = _t(spark, d, "customer").filter("c_custkey < 97").select(F.col("c_custkey").alias("a"))
    return k.select("a", ((F.col("a") * 3 + 1) % 97).alias("b")).unionByName(k.select("a", ((F.col("a") * 5 + 2) % 97).alias("b")))


def i22_bounded_walk(spark: SparkSession, d: str) -> DataFrame:
    """Vertices within 4 steps of vertex 0, with the least number of steps; each level is one join with what is new."""
    edges, depth = _edges(spark, d), 4
    seen = spark.createDataFrame([(0, 0)], "v long, steps long")
    front = seen
    for step in range(1, depth + 1):
        front = front.join(edges, F.col("v") == F.col("a")).select(F.col("b").alias("v")).distinct().join(seen.select("v"), "v", "left_anti").withColumn("steps", F.lit(step).cast("long"))
        seen = seen.unionByName(front)
    return seen


def i23_closure(spark: SparkSession, d: str) -> DataFrame:
    """All vertices that vertex 0 reaches, level by level until one brings nothing new; each level is written before the next."""
    edges = _edges(spark, d).distinct()
    seen = front = stored(edges.filter("a = 0").select(F.col("b").alias("v")))
    for _ in range(LEVELS):
        front = stored(front.join(edges, F.col("v") == F.col("a")).select(F.col("b").alias("v")).distinct().join(seen, "v", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise SealError("SHRED-SCHEMA-009", "the walk is too deep")


def i25_null_safe(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose segment differs from FURNITURE, unknown ones included."""
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    return _t(spark, d, "customer").filter(~segment.eqNullSafe(F.lit("FURNITURE"))).select("c_custkey")


ALL = (i1_filters, i2_inner_join, i3_left_join, i4_cross_join, i5_lateral, i6_ordinality, i7_or_join, i8_semi_join, i9_anti_join, i10_scalar_subquery, i11_any_subquery, i12_derived_table, i13_union_all, i14_distinct, i15_count, i16_group_by, i17_string_agg, i18_min, i19_case, i20_top, i21_text, i22_bounded_walk, i23_closure, i25_null_safe)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    k = "(SELECT c_custkey AS a FROM customer WHERE c_custkey < 97)"
    edges = f"(SELECT a, (a * 3 + 1) % 97 AS b FROM {k} UNION ALL SELECT a, (a * 5 + 2) % 97 FROM {k})"
    return {
        "i1_filters": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')",
        "i2_inner_join": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
        "i3_left_join": "SELECT c_custkey, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
        "i4_cross_join": "SELECT r_regionkey, n_nationkey, r_regionkey = n_regionkey AS own FROM region, nation",
        "i5_lateral": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
        "i6_ordinality": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part",
        "i7_or_join": "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_custkey = s_suppkey * 2",
        "i8_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        "i9_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
        "i10_scalar_subquery": "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last FROM customer",
        "i11_any_subquery": "SELECT c_custkey FROM customer WHERE c_nationkey = ANY(SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
        "i12_derived_table": "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 5",
        "i13_union_all": "SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier",
        "i14_distinct": "SELECT DISTINCT o_custkey, o_orderstatus FROM orders",
        "i15_count": "SELECT count(*) AS n FROM lineitem",
        "i16_group_by": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
        "i17_string_agg": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(DISTINCT CAST(length(n_name) AS VARCHAR), ',' ORDER BY CAST(length(n_name) AS VARCHAR)) AS lengths FROM nation GROUP BY n_regionkey",
        "i18_min": "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey",
        "i19_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS kind FROM part",
        "i20_top": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
        "i21_text": "SELECT c_custkey, c_mktsegment || '/' || c_name AS joined, concat_ws('-', 'a', NULL, c_mktsegment) AS joined_ws, split_part(c_name, '#', 2) AS number, instr(c_name, '#') AS at, starts_with(c_name, 'Cust') AS starts, array_to_string(string_split(c_name, '#'), '|') AS rejoined, len(string_split(c_name, '#')) AS n_parts, chr(CAST(65 + c_custkey % 26 AS INTEGER)) AS letter, CAST(c_custkey AS VARCHAR) AS text FROM customer",
        "i22_bounded_walk": f"WITH RECURSIVE w AS (SELECT CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS steps UNION SELECT b, steps + 1 FROM w JOIN {edges} ON v = a WHERE steps < 4) SELECT v, min(steps) AS steps FROM w GROUP BY v",
        "i23_closure": f"WITH RECURSIVE w AS (SELECT b AS v FROM {edges} WHERE a = 0 UNION SELECT b FROM w JOIN {edges} ON v = a) SELECT v FROM w",
        "i25_null_safe": "SELECT c_custkey FROM customer WHERE CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END IS DISTINCT FROM 'FURNITURE'",
    }
