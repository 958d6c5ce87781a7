"""What a table must be like before its columns are sealed or indexed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StringType

from ..errors import SealError
from ..sources.ledger import Version
from .seal import SealSpec


def findings(df: DataFrame, spec: SealSpec, indexed: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(column, what is wrong) of a table with its owners and index columns; nothing is run."""
    out = []
    seen: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in seen:
            out.append((c, "differs from another column only by case"))
        seen[c.lower()] = c
    types = {f.name: f for f in df.schema.fields}
    for c in ("tenant", "subject"):
        if c not in types or not isinstance(types[c].dataType, StringType):
            out.append((c, "is not a text column"))
        elif types[c].dataType.collation != "UTF8_BINARY":
            out.append((c, "has a collation under which different texts are equal"))
        if c in spec.fields or c == spec.id_column:
            out.append((c, "is sealed itself, or the id"))
    for f in indexed:
        index = types.get(f"{f}_bidx")
        if f not in spec.fields:
            out.append((f, "is indexed and not sealed"))
        if index is None or not isinstance(index.dataType, BinaryType) or not index.nullable:
            out.append((f"{f}_bidx", "is not a nullable binary column"))
    if df.is_cached:
        out.append(("*", "the table is cached"))
    return out


def require_admitted(df: DataFrame, spec: SealSpec, indexed: tuple[str, ...] = ()) -> None:
    wrong = findings(df, spec, indexed)
    if wrong:
        raise SealError("SHRED-SCHEMA-009", "; ".join(f"{c} {what}" for c, what in wrong))


def index_copies(version: Version) -> list[tuple[str, str]]:
    """(table, column): columns named like a table's blind index in another table, which no erasure would clear."""
    owned = {(n, c) for n, t in version.tables.items() for c in t["no_stats"]}
    names = {c.lower() for _, c in owned}
    columns = [(n, f["name"]) for n, t in version.tables.items() for f in t["schema"]["fields"]]
    return sorted(x for x in columns if x[1].lower() in names and x not in owned)


#: Kinds of copies that an acknowledgement can name, since something else clears them; other kinds only refuse.
ACKNOWLEDGED_KINDS = ("stream", "export", "change-reader")


@dataclass(frozen=True)
class Copy:
    """A place beyond a table that gets its index column: declared by the caller, or found by name."""

    kind: str  # one of ACKNOWLEDGED_KINDS, or table, view, cache, reference
    table: str
    column: str
    name: str


@dataclass(frozen=True)
class Acknowledged:
    """A copy that something else clears: all parts must match exactly."""

    kind: str
    table: str
    column: str
    name: str
    cleared_by: str

    def __post_init__(self) -> None:
        if self.kind not in ACKNOWLEDGED_KINDS:
            raise SealError("SHRED-CONFIG-001", "only streams, exports and change readers can be acknowledged")
        if not all(x.strip() for x in (self.table, self.column, self.name, self.cleared_by)):
            raise SealError("SHRED-CONFIG-001", "an acknowledgement lacks a part")


def admitted_copies(version: Version, declared: tuple[Copy, ...], acknowledged: tuple[Acknowledged, ...]) -> list[Acknowledged]:
    """The acknowledgements that apply to the indexed columns; refuses if a copy has none, or one names no copy."""
    owned = {(n, c) for n, t in version.tables.items() for c in t["no_stats"]}
    found = [Copy("table", t, c, t) for t, c in index_copies(version)] + [x for x in declared if (x.table, x.column) in owned]
    key = lambda x: (x.kind, x.table, x.column, x.name)
    known = {key(a): a for a in acknowledged}
    open_ = sorted(key(x) for x in found if key(x) not in known)
    if open_:
        raise SealError("SHRED-SCHEMA-010", "index columns are copied: " + "; ".join(f"{k} {n} of {t}.{c}" for k, t, c, n in open_))
    there = {key(x) for x in found}
    idle = sorted(k for k in known if k not in there)
    if idle:
        raise SealError("SHRED-CONFIG-001", "acknowledgements name no copy: " + "; ".join(f"{k} {n}" for k, _, _, n in idle))
    return [known[k] for k in sorted(there)]


def target_findings(spark: SparkSession, target: str, roots: tuple[str, ...] = (), rest: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(target, what is wrong) of a path a table is to be written to.

    roots: paths of other tables, none of which may hold this one or lie in it.
    rest: names of partition folders, which must stand in the target.
    """
    out = []
    if "/" not in target:
        views = {t.name for t in spark.catalog.listTables() if t.isTemporary}
        out.append((target, "is a temporary view" if target in views else "names no folder"))
        return out
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out.append((target, "does not exist"))
    inside = lambda a, b: a.rstrip("/").startswith(b.rstrip("/") + "/")
    out += [(target, "lies in the folder of another table" if inside(target, r) else "holds the folder of another table") for r in roots if inside(target, r) or inside(r, target)]
    out += [(f"{target.rstrip('/')}/{p}", "is not readable under its table") for p in rest if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{p}"))]
    return out
