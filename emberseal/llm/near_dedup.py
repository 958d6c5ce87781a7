"""MinHash near-dedup with HyperMinHash sketches.

1. Every text becomes a set of 64-bit shingle fingerprints. The set's 128-bit
   sum finds equal sets; only one document of each goes on, so copies are
   never compared.
2. A sketch has 128 registers. A register keeps the least hash of its bucket
   as a count of leading zeros (6 bits) and the 10 bits after them. Bands of
   5 registers are hashed; documents that share a band are candidates.
3. In each band bucket the member with most bucket mates becomes the centre,
   and members are paired with it: pairs are linear in the members. Pairs
   whose estimate (equal registers, less those expected to be equal by chance)
   lies far below the threshold are dropped; texts of the others are compared
   as whole sets.
4. Components are built. A link that was missed joins a member that is not
   linked with its centre to another member of the centre. Such members and
   all members are dealt out in blocks of BLOCK rows of short sketches (one
   byte a register), and each pair of blocks is looked at in one task. Sizes,
   distances to the centre (Jaccard distance is a metric) and estimates rule
   out most. The texts of the members that are left as possible partners
   between different components meet in one task for each pair of blocks,
   where an inverted index counts all common shingles; it returns links only,
   one for each member and component. Components are built again. In a group
   whose members are much alike but not linked, work grows with (members not
   linked to the centre) x (members) / BLOCK texts.

Sizes bound similarity, so pairs of unlike sizes are dropped early. Bands have
as many rows as they can so that a pair at the threshold shares none with a
probability of MISS at most: 5 rows at 85 % (4e-7), 4 at 80 %, 2 at 50 %.
Shingles are compared by 64-bit fingerprints, equal sets by 128 bits.

Edge cases: null, empty and blank texts have no shingles and link with none; a
text of fewer words than a shingle is one shingle; rows that share a doc_id
are one document (each comes back with its own n_shingles), but of rows with a
null doc_id each text is a document of its own, before all others, returned as
null; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .components import components
from .durable import durable
from .rowkeys import id_or_null, with_own_ids

REGISTERS, MISS = 128, 1e-5
BLOCK, SALTS = 512, 16
#: Standard errors that an estimate may lie below the threshold.
SLACK = 5.0


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each row."""
    h, _, _, first = T.word_hashes(T.LOWER[data], offs)
    w = T.windows(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(w[a : b - n + 1])
        else:
            short = np.full(min(1, b - a), b - a, np.uint64)
            for i in range(a, b):
                short = T.mix(short * np.uint64(T.BASE) + h[i : i + 1])
            yield short


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 per bucket: leading zeros and ten more bits of the least hash; 0 if empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rest = (shingles[first] << np.uint64(7)) | np.uint64(127)
        zeros = 63 - np.floor(np.log2(np.maximum((rest >> np.uint64(12)).astype(float), 0.5))).astype(np.int64) - 12
        bits = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(54)
        out[bucket[first]] = ((zeros + 1).astype(np.uint64) << np.uint64(10) | bits).astype(np.uint16)
    return out


def band_rows(percent: int) -> int:
    """Registers in a band: the most with which a pair at the threshold is missed with probability MISS at most."""
    t = percent / 100
    fits = [r for r in range(1, 33) if (1 - t**r) ** (REGISTERS // r) <= MISS]
    if not fits:
        raise ValueError(f"{percent} % is too low for {REGISTERS} registers")
    return max(fits)


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """documents x bands hashes; 0 for bands without a filled register."""
    n = REGISTERS // rows
    r = regs[:, : n * rows].reshape(len(regs), n, rows).astype(np.uint64)
    h = np.broadcast_to(T.mix(np.arange(1, n + 1).astype(np.uint64)), r.shape[:2]).copy()
    for i in range(rows):
        h = T.mix(h * np.uint64(T.BASE) + r[:, :, i])
    return np.where(r.any(2), h, 0).view(np.int64)


def short(regs: np.ndarray) -> np.ndarray:
    """A byte for each register: 0 if empty, else a hash of it from 1 to 255."""
    return np.where(regs > 0, 1 + T.mix(regs.astype(np.uint64)) % np.uint64(255), 0).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows (or of short ones), less chance collisions, and how many registers they rest on."""
    used = (a > 0) | (b > 0)
    n = np.maximum(used.sum(1), 1)
    same = ((a == b) & used).sum(1) / n
    # Two unrelated buckets agree if both zeros and mantissa do: near 2**-11, a little more when they hold few hashes.
    chance = 2.0**-11 * (1 + REGISTERS / np.maximum(np.minimum(*sizes), 1)) + (a.dtype == np.uint8) / 255
    return (same - chance) / (1 - chance), n


def may_link(got: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether an estimate lies at most SLACK standard errors under the threshold."""
    t = percent / 100
    return got >= t - SLACK * np.sqrt(t * (1 - t) / n) - 1 / n


def _sketch(n: int, rows: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = T.as_bytes(batch.column(1))
            for a, b in T.pieces(offs, 1 << 20):
                size, k1, k2, regs = [], [], [], np.zeros((b - a, REGISTERS), np.uint16)
                for i, s in enumerate(shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)):
                    size.append(len(s))
                    k1.append(int(T.mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    k2.append(int(T.mix(s ^ np.uint64(T.BASE)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    regs[i] = registers(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(list(bands(regs, rows)), pa.list_(pa.int64())), pa.array([r.tobytes() for r in short(regs)], pa.binary())],
                    names=["doc_id", "n", "k1", "k2", "regs", "bands", "short"],
                )

    return sketched


def _likely(percent: int):
    """Keeps pairs whose estimate may reach the threshold."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            got, n = estimate(a, b, (batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(may_link(got, n, percent)))

    return likely


def _compare(n: int):
    """Exact sizes of intersection and union; rows come ordered by b, whose set is kept."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda text: next(shingle_sets(np.frombuffer(raw := text.encode(), np.uint8), np.array([0, len(raw)]), n))
        last, own = None, None
        for batch in batches:
            both, either = [], []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if tb != last:
                    last, own = tb, one(tb)
                x = one(ta)
                k = int(np.isin(x, own, assume_unique=True).sum())
                both.append(k)
                either.append(len(x) + len(own) - k)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    return compared


PARTNERS = "centre long, i int, j int, doc_id long, c long, rest boolean"


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    return table.filter(table.column("rest")), table.filter(pc.invert(table.column("rest")))


def _partners(percent: int):
    """The unlinked members of one block that may link with members of another in other components, and the latter."""

    def partners(table: pa.Table) -> pa.Table:
        rest, others = _split(table)
        a, b = np.zeros(rest.num_rows, bool), np.zeros(others.num_rows, bool)
        if rest.num_rows and others.num_rows:
            t = percent / 100

            def read(table: pa.Table):
                far = table.column("far").to_numpy().astype(float)  # NaN: not known
                regs = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, REGISTERS)
                return table.column("c").to_numpy(), far, table.column("n").to_numpy(), regs

            (ca, fa, na, ra), (cb, fb, nb, rb) = read(rest), read(others)
            for i in range(len(ca)):
                fits = (cb != ca[i]) & (100 * np.minimum(nb, na[i]) >= percent * np.maximum(nb, na[i])) & ~(np.abs(fb - fa[i]) > 1 - t + 1e-9)
                at = np.flatnonzero(fits)
                if len(at):
                    at = at[may_link(*estimate(ra[i : i + 1], rb[at], (na[i : i + 1], nb[at])), percent)]
                    a[i] = len(at) > 0
                    b[at] = True
        return pa.concat_tables([rest.filter(pa.array(a)), others.filter(pa.array(b))]).select(["centre", "i", "j", "doc_id", "c", "rest"])

    return partners


def _across(n: int, percent: int):
    """Links between unlinked members of one block and members of another: one to each component is enough."""

    def across(table: pa.Table) -> pa.Table:
        a, b = [], []
        rest, others = _split(table)
        if rest.num_rows and others.num_rows:
            read = lambda x: (x.column("doc_id").to_numpy(), x.column("c").to_numpy(), list(shingle_sets(*T.as_bytes(x.column("text")), n)))
            (ida, ca, sa), (idb, cb, sb) = read(rest), read(others)
            size = np.array([len(x) for x in sb])
            every = np.concatenate(sb)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], np.repeat(np.arange(len(sb)), size)[order]
            for i in range(len(ida)):
                lo, hi = np.searchsorted(every, sa[i], "left"), np.searchsorted(every, sa[i], "right")
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                both = np.bincount(owner[at], minlength=len(sb))
                fits = np.flatnonzero((100 * both >= percent * (len(sa[i]) + size - both)) & (cb != ca[i]))
                fits = fits[np.unique(cb[fits], return_index=True)[1]]
                a += [int(ida[i])] * len(fits)
                b += idb[fits].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return across


def _exact(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """a, b, both, either of the pairs (a, b)."""
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    rows = pairs.join(text("a"), "a").join(text("b"), "b").sortWithinPartitions("b")
    return durable(rows.select("a", "b", "ta", "tb").mapInArrow(_compare(n), "a long, b long, both long, either long"))


def _spread(df: DataFrame) -> DataFrame:
    """Each row once for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _missed(starred: DataFrame, stars: DataFrame, reps: DataFrame, texts: DataFrame, links: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that the stars missed; links: those found so far."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    far = stars.select(F.col("a").alias("doc_id"), F.col("b").alias("centre"), (1 - F.col("both") / F.col("either")).alias("far"))
    members = starred.filter("doc_id <> centre").select("doc_id", "centre").distinct().join(far, ["doc_id", "centre"], "left")
    members = members.join(reps.select("doc_id", "n", "short"), "doc_id").withColumn("salt", salt)
    part = components(links)
    own = members.join(part.select(F.col("v").alias("doc_id"), "c"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    main = _spread(members.select("centre").distinct().join(part.select(F.col("v").alias("centre"), F.col("c").alias("main")), "centre", "left").withColumn("main", F.coalesce("main", "centre")))
    own = durable(own.join(main, ["centre", "salt"]))
    sizes = own.groupBy("centre", "salt").agg(F.count("*").alias("m"), F.count_if(F.col("c") != F.col("main")).alias("r")).groupBy("centre").agg(F.sum("m").alias("m"), F.sum("r").alias("r"))
    counts = _spread(sizes.filter("r > 0 and m > 1").select("centre", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("r") / BLOCK).cast("int").alias("rb")))
    held = own.join(counts, ["centre", "salt"])
    block = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    kinds = lambda df, k, *more: df.select("centre", "i", "j", "doc_id", "c", *more, F.lit(k).alias("rest"))
    rest = kinds(held.filter("c <> main").withColumn("j", block("rb")).withColumn("i", every("mb")), True, "far", "n", "short")
    others = kinds(held.withColumn("i", block("mb")).withColumn("j", every("rb")), False, "far", "n", "short")
    partners = durable(rest.unionByName(others).groupBy("centre", "i", "j").applyInArrow(_partners(percent), PARTNERS))
    return durable(partners.join(texts, "doc_id").groupBy("centre", "i", "j").applyInArrow(_across(n, percent), "a long, b long"))


def _linked(checked: DataFrame, percent: int) -> DataFrame:
    return checked.filter(f"100 * both >= {int(percent)} * either").select("a", "b")


def _checked(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b, both, either of the pairs (a, b) that pass the estimate."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return _exact(sized.mapInArrow(_likely(percent), "a long, b long"), texts, n)


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    rows, last = with_own_ids(docs)
    sketched = _sketch(shingle, band_rows(percent))
    sketches = durable(rows.select("doc_id", "text").mapInArrow(sketched, "doc_id long, n long, k1 long, k2 long, regs binary, bands array<long>, short binary"))
    filled = sketches.filter("n > 0")
    sets = filled.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # Rows of copies meet their set under a salt, so that a large group is not one task's.
    salted = filled.select("doc_id", "k1", "k2", "n", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    to_rep = salted.join(_spread(sets.filter("copies > 1")), ["k1", "k2", "n", "salt"]).select("doc_id", "rep")
    reps = durable(filled.join(sets.select("k1", "k2", "n", F.col("rep").alias("doc_id")), ["k1", "k2", "n", "doc_id"]).dropDuplicates(["k1", "k2", "n"]).select("doc_id", "n", "regs", "bands", "short").repartition("doc_id"))
    members = reps.select("doc_id", F.explode("bands").alias("band")).filter("band <> 0")
    shared = members.groupBy("band").agg(F.count("*").alias("mates")).filter("mates > 1")
    held = durable(members.join(shared, "band"))
    degree = held.groupBy("doc_id").agg(F.sum("mates").alias("degree"))
    ranked = held.join(degree, "doc_id")
    # The complement orders ids downwards and exists for every one of them.
    centres = ranked.groupBy("band").agg(F.max(F.struct("degree", F.bitwise_not("doc_id").alias("k"))).alias("x")).select("band", F.bitwise_not("x.k").alias("centre"))
    starred = durable(held.select("band", "doc_id").join(centres, "band"))
    texts = durable(rows.join(degree.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text"))
    stars = _checked(starred.filter("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct(), reps, texts, shingle, percent)
    links = _linked(stars, percent)
    same = to_rep.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    missed = _missed(starred, stars, reps, texts.dropDuplicates(["doc_id"]), links, shingle, percent)
    final = components(links.unionByName(missed).unionByName(same))
    joined = sketches.select("doc_id", "n").join(final.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    return joined.select(id_or_null(last=last), F.col("n").alias("n_shingles"), F.when(F.col("c") > last, F.col("c")).alias("component_id"), (F.col("doc_id") == F.col("c")).alias("kept"))


# The query's rows by DuckDB, with shingle = 3 and percent = 85, over every pair that shares a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), u AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM w
), g AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s
  FROM u
), s AS (
  SELECT DISTINCT doc_id, s FROM g WHERE i <= greatest(n - 2, 1)
), z AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), b AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT b.a, b.b FROM b JOIN z x ON b.a = x.doc_id JOIN z y ON b.b = y.doc_id
  WHERE 100 * b.both >= 85 * (x.n + y.n - b.both)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT c.a AS doc_id, coalesce(z.n, 0) AS n_shingles, component_id, component_id = c.a AS kept
FROM c LEFT JOIN z ON c.a = z.doc_id
"""
