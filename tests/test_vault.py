import os
from datetime import UTC, datetime

import pyarrow.parquet as pq
import pytest

from emberseal.errors import SealError
from emberseal.operators.admission import findings, index_copies
from emberseal.operators.seal import SealSpec
from emberseal.operators.vault import CARRIED, KEYS, LOG, STONES, Vault
from emberseal.sources.ledger import Ledger

MASTER, INDEX, PEPPER = (bytes([i]) * 16 + bytes(range(16)) for i in (1, 2, 3))
SPEC = SealSpec("person", "id", "concat('t', id % 2)", "concat('s-', owner)", ("name",))
NOW = datetime(2026, 1, 1, 0, 0, 0, 120_000, tzinfo=UTC)
ROWS = [(i, i % 4, f"name {i}" if i != 5 else None) for i in range(8)]


def vault(spark, tmp_path, **more):
    return Vault(Ledger(spark, str(tmp_path / "ledger")), MASTER, PEPPER, clock=lambda: NOW, **more)


def filled(spark, tmp_path, **more):
    v = vault(spark, tmp_path, **more)
    v.write("person", spark.createDataFrame(ROWS, "id long, owner long, name string"), SPEC, INDEX, ("name",))
    return v


def ask(spark, *who):
    return spark.createDataFrame([(t, s, "officer", None) for t, s in who], "tenant string, subject string, requested_by string, reason string")


def names(v):
    return {r.id: r.name for r in v.open("person", SPEC, {}).collect()}


def test_erase_destroys_clears_and_proves(spark, tmp_path):
    v = filled(spark, tmp_path)
    assert names(v) == {i: n for i, _, n in ROWS}
    got = v.erase(ask(spark, ("t1", "s-1"))).collect()
    assert [tuple(r) for r in got] == [("t1", "s-1", "COMPLETE", False, 1, 1, "2026-01-01T00:00:00.120Z")]
    assert names(v) == {i: "[erased]" if o == 1 and n is not None else n for i, o, n in ROWS}
    again = v.erase(ask(spark, ("t1", "s-1"))).collect()
    assert [tuple(r)[:6] for r in again] == [("t1", "s-1", "COMPLETE", True, 0, 0)]
    assert v.verify().first().status == "INTACT_UNKEYED"
    head = v.ledger.head()
    assert v.table(head, LOG).count() == 1 and head.anchor["count"] == 1
    with pytest.raises(SealError, match="SHRED-ERASED-001"):
        v.write("person", spark.createDataFrame([(9, 1, "back")], "id long, owner long, name string"), SPEC, INDEX, ("name",))
    with pytest.raises(SealError, match="SHRED-ERASED-001"):
        v.rotate(ask(spark, ("t1", "s-1")))


def test_old_keys_leave_the_disk_and_indexes_have_no_statistics(spark, tmp_path):
    v = filled(spark, tmp_path)
    before = v.ledger.head()
    v.erase(ask(spark, ("t0", "s-0"), ("t0", "s-2")))
    root = tmp_path / "ledger"
    assert not any((root / d).exists() for d in before.tables[KEYS]["dirs"] + before.tables["person"]["dirs"])
    with pytest.raises(SealError, match="SHRED-KEY-UNAVAILABLE"):
        v.table(before, KEYS)
    now = v.ledger.head()
    for folder in now.tables["person"]["dirs"]:
        for f in (x for x in os.listdir(root / folder) if x.endswith(".parquet")):
            meta = pq.read_metadata(root / folder / f)
            for g in range(meta.num_row_groups):
                columns = [meta.row_group(g).column(i) for i in range(meta.num_columns)]
                assert all(c.statistics is None or not c.statistics.has_min_max for c in columns if c.path_in_schema == "name_bidx")


def test_hooks_answer_what_is_open(spark, tmp_path):
    calls, broken = [], [True]

    def purge(tenant, subject):
        calls.append((tenant, subject))
        if broken[0]:
            raise ValueError("secret")

    v = filled(spark, tmp_path, hooks=(("purge", purge), ("mail", lambda t, s: None)))
    assert v.erase(ask(spark, ("t1", "s-3"))).first().outcome == "PARTIAL"
    other = vault(spark, tmp_path, hooks=(("mail", lambda t, s: None),))
    assert other.erase(ask(spark, ("t1", "s-3"))).first().outcome == "PARTIAL"
    assert other.erase(ask(spark, ("t1", "s-3"))).first().outcome == "PARTIAL"
    broken[0] = False
    last = v.erase(ask(spark, ("t1", "s-3"))).first()
    assert (last.outcome, last.already_erased, last.keys_destroyed) == ("COMPLETE", True, 0)
    said = [[tuple(h) for h in r.hook_outcomes] for r in v.table(v.ledger.head(), LOG).orderBy("seq").collect()]
    carried = [("purge", False, CARRIED + "2"), ("mail", True, None)]
    assert said == [[("purge", False, "pending"), ("mail", False, "pending")], [("purge", False, "builtins.ValueError"), ("mail", True, None)], carried, carried, [("purge", True, None), ("mail", True, None)]]
    assert calls == [("t1", "s-3")] * 2 and v.verify().first().status == "INTACT_UNKEYED"


def test_a_writer_that_loses_changes_nothing(spark, tmp_path):
    v = filled(spark, tmp_path)
    stale = v.ledger.head()
    v.erase(ask(spark, ("t1", "s-1")))
    with pytest.raises(SealError, match="SHRED-ERASURE-LOCK-WAIT"):
        v.ledger.commit(stale, append={STONES: spark.createDataFrame([("x", "y")], "tenant string, subject string")})
    assert v.table(v.ledger.head(), STONES).count() == 1
    kept = {d.split("/")[0] for t in v.ledger.head().tables.values() for d in t["dirs"]}
    assert {x for x in os.listdir(tmp_path / "ledger") if x.startswith("v=")} == kept


def test_rotation_keeps_old_values_readable(spark, tmp_path):
    v = filled(spark, tmp_path)
    v.rotate_worn(1)
    v.write("person", spark.createDataFrame([(8, 0, "new")], "id long, owner long, name string"), SPEC, INDEX, ("name",))
    assert names(v) == {i: n for i, _, n in ROWS} | {8: "new"}
    assert {(r.tenant, r.subject, r.version): r.n for r in v.used().collect() if r.subject == "s-0"} == {("t0", "s-0", 1): 2, ("t0", "s-0", 2): 1}
    assert v.erase(ask(spark, ("t0", "s-0"))).first().keys_destroyed == 2


def test_trail_keeps_its_mode(spark, tmp_path):
    filled(spark, tmp_path).erase(ask(spark, ("t1", "s-1")))
    with pytest.raises(SealError, match="SHRED-ERASURE-003"):
        vault(spark, tmp_path, keyring={"k": INDEX}, key_id="k").erase(ask(spark, ("t0", "s-2")))


def test_keyed_trail(spark, tmp_path):
    v = filled(spark, tmp_path, keyring={"k": INDEX}, key_id="k")
    v.erase(ask(spark, ("t1", "s-1"), ("t0", "s-0")))
    v.erase(ask(spark, ("never", "seen")))
    assert v.verify().first().status == "INTACT" and v.ledger.head().anchor["count"] == 3


@pytest.mark.parametrize("bad", [("t 1", "s"), ("t1", ""), ("t1", None)])
def test_requests_are_checked(spark, tmp_path, bad):
    v = vault(spark, tmp_path)
    with pytest.raises(SealError, match="SHRED-INVALID-001"):
        v.erase(ask(spark, bad))
    with pytest.raises(SealError, match="SHRED-INVALID-001"):
        v.erase(ask(spark, ("t", "s"), ("t", "s")))


def test_admission(spark, tmp_path):
    df = spark.sql("select 1L as id, 'a' collate utf8_lcase as tenant, 1 as subject, 'n' as name, cast(null as binary) as name_bidx")
    assert {c for c, _ in findings(df, SPEC, ("name", "other"))} == {"tenant", "subject", "other", "other_bidx"}
    v = filled(spark, tmp_path)
    head = v.ledger.head()
    made = v.ledger.commit(head, append={"export": v.table(head, "person").select("id", "name_bidx")})
    assert index_copies(made) == [("export", "name_bidx")]


def test_a_batch_of_more_subjects_than_a_page(spark, tmp_path, monkeypatch):
    """10,001 subjects in one batch: one commit for the erasure, hooks in pages, one record each in order of the subjects."""
    monkeypatch.setattr("emberseal.operators.vault.PAGE", 4_000)
    n, calls = 10_001, []

    def odd(tenant, subject):
        calls.append(subject)
        if int(subject[2:]) % 2:
            raise LookupError

    v = vault(spark, tmp_path, hooks=(("odd", odd),))
    v.write("person", spark.range(n + 5).selectExpr("id", "id as owner", "concat('n', id) as name"), SPEC, INDEX, ("name",))
    asked = spark.range(n).selectExpr("concat('t', id % 2) as tenant", "concat('s-', id) as subject", "'officer' as requested_by", "cast(null as string) as reason")
    got = {r.subject: tuple(r)[2:6] for r in v.erase(asked).collect()}
    assert got == {f"s-{i}": ("PARTIAL" if i % 2 else "COMPLETE", False, 1, 1) for i in range(n)}
    order = [s for _, s in sorted((f"t{i % 2}", f"s-{i}") for i in range(n))]
    assert calls == order
    log = v.table(v.ledger.head(), LOG).orderBy("seq").collect()
    assert [r.seq for r in log] == list(range(1, 2 * n + 1)) and v.ledger.head().anchor["count"] == 2 * n
    assert [r.outcome for r in log] == ["PARTIAL"] * n + ["PARTIAL" if int(s[2:]) % 2 else "COMPLETE" for s in order]
    assert v.verify().first().status == "INTACT_UNKEYED"
    left = v.table(v.ledger.head(), "person").filter("name_bidx is not null").count()
    assert (left, v.table(v.ledger.head(), KEYS).count(), v.table(v.ledger.head(), STONES).count()) == (5, 5, n)
