"""Line dedup: lines found in too many documents stay only in the last of them.

Native: lines are exploded, normalised and hashed; distinct documents are
counted per hash; lines over the threshold are dropped, and the rest is joined
again by position. Two hashes of 64 and 32 bits stand for a key.

Plan: (hash, document) pairs are made distinct by both, so no key gathers in
one task, and counted with map-side sums. Of the keys over the threshold at
most HOT hold 1/HOT or more of all those pairs; these few are broadcast, so
that their lines get a salt, and are repeated for every salt before the join.

Edge cases: a null or empty text is one empty line; a null doc_id counts as
one document that sorts before all others and comes back as null; rows that
share a doc_id are one document and all keep or lose the same lines; an empty
table gives no rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .rowkeys import id_or_null, keyed

HOT, SALTS = 1000, 64
BLANKS = " \t\n\x0b\f\r"


def line_key(bare: Column) -> Column:
    """The stripped line with A-Z in lower case; lower() does the same, faster, where all is ASCII."""
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and the columns named in carry, as they are."""
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    rows = keyed(docs, F.struct(F.lit(0), *(F.col(f"`{c}`") for c in carry)).alias("carried"))
    lines = F.split("text", "\n", -1)
    bare = F.btrim("line", F.lit(BLANKS))
    listed = (
        rows.select("doc_id", "text_hash", F.posexplode(lines).alias("place", "line"))
        # Lower case keeps the length, so only lines that are long enough get it.
        .filter((F.length("line") >= min_chars) & (F.length(bare) >= min_chars))
        .select("doc_id", "text_hash", "place", line_key(bare).alias("key"))
        .select("doc_id", "text_hash", "place", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))
    )
    counted = listed.select("h", "g", "doc_id").distinct().groupBy("h", "g").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))
    frequent = durable(counted.filter(F.col("docs") >= min_docs))
    held = frequent.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") >= max(held // HOT + 1, SALTS)
    tagged = listed.join(F.broadcast(frequent.filter(hot).select("h", "g", F.lit(True).alias("hot"))), ["h", "g"], "left")
    salted = tagged.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    spread = frequent.select("h", "g", "last", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    gone = salted.join(spread, ["h", "g", "salt"]).filter(F.col("doc_id") < F.col("last")).groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("gone"))
    joined = rows.join(gone, ["doc_id", "text_hash"], "left")
    # The generator keeps the split lines as a column: inside the lambda below they would be split again for each line.
    split = joined.withColumn("lines", F.explode(F.array(lines)))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.col("lines")[i]), "\n")
    return split.select(
        id_or_null(),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        *(F.col(f"carried.`{c}`").alias(c) for c in carry),
    )


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), k AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.place, k.line, f.key IS NOT NULL AND k.doc_id < f.last AS gone
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
