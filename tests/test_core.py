import datetime
import decimal
import hashlib

import duckdb
import pytest

from emberseal.functions.crypto import hkdf, master_key
from emberseal.errors import SealError
from emberseal.operators import chain
from emberseal.operators.blind_index import normalised
from emberseal.plans import erasure_queries, guard_queries, queries, relational_queries, vault_queries

QUERIES = queries.queries() | erasure_queries.queries() | vault_queries.queries() | guard_queries.queries() | relational_queries.queries()
SQL = queries.oracle_sql() | erasure_queries.oracle_sql() | vault_queries.oracle_sql() | guard_queries.oracle_sql() | relational_queries.oracle_sql()

D = "/root/testdata/sf0.001"


def plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(x) for x in r) for r in got.select(*cols).collect()), key=key)
    b = sorted((tuple(plain(x) for x in r) for r in want.select(*cols).fetchall()), key=key)
    assert a == b


def test_hkdf_vector():
    okm = hkdf(bytes([0x0B] * 22), bytes(range(0xF0, 0xFA)), 42, bytes(range(13)))
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_master_key_refusals():
    for bad in ("x", "AAAA", "A" * 44):
        with pytest.raises(SealError):
            master_key(bad)


def test_normalised_text(spark):
    said = ["  ABC\t", "\uff21\uff22\u00a0", "Stra\u00dfe", "\ufb01x", "", None]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    assert [r[0] for r in df.select(normalised(df.t)).collect()] == ["abc", "ab", "stra\u00dfe", "fix", "", None]


def test_keys_are_opened_above_all_exchanges(spark):
    """No plan decrypts a wrapped key below an exchange, so none lies in a shuffle file."""
    from emberseal.operators import keys
    from emberseal.operators.seal import open_columns, seal

    spec, c = queries.SPEC, queries._customers(spark, D)
    held = keys.mint(spec.owned(c), None, None, queries.MASTER)
    sealed = seal(c, spec, held, queries.MASTER)
    for df in (sealed, open_columns(queries.stored(sealed), spec, held, queries.MASTER, {})):
        above, seen = [], 0
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [a for a in above if a < depth]
            if "decrypt" in line.lower():
                seen += 1
                assert not above, line
            if "Exchange" in line and "Broadcast" not in line:
                above.append(depth)
        assert seen


def test_chain_append_by_python(spark):
    plain = [(i, k, "2024-01-01T00:00:00Z", "t", f"p{i}", "o", None, 1, 1, 2, 0, "COMPLETE", "", "2026-01-01T00:00:00Z") for i, k in ((3, "none"), (1, "none"), (2, "none"))]
    schema = "seq long, key_id string, ts string, tenant string, subject_pseudonym string, requested_by string, reason string, keys_destroyed int, entity_count int, field_count int, blind_index_cleared int, outcome string, hook_material string, backup_clear_at string"
    got = {r.seq: r for r in chain.append(spark.createDataFrame(plain, schema)).collect()}
    prev = "0" * 64
    for seq in (1, 2, 3):
        body = f"sh1|4:none|20:2024-01-01T00:00:00Z|1:t|2:p{seq}|1:o|-|1:1|1:1|1:2|1:0|8:COMPLETE|0:|20:2026-01-01T00:00:00Z|64:{prev}"
        assert got[seq].prev_hash == prev and got[seq].hash == hashlib.sha256(body.encode()).hexdigest()
        prev = got[seq].hash
    ring = {"k1": b"k" * 32}
    keyed = [(i, "k1" if i != 2 else "gone", *r[2:]) for i, r in enumerate(plain, 1)]
    hashes = {r.seq: r.hash for r in chain.append(spark.createDataFrame(keyed, schema), ring).collect()}
    assert hashes[1] and hashes[2] is None and hashes[3] is None
    assert chain.append(spark.createDataFrame([], schema)).collect() == []
