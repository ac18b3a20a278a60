"""Exact dedup by deterministic block naming.

A text's bytes are cut into blocks of a fixed size.  Equal blocks get one
integer name, different blocks get different ones; then adjacent names are
paired and the pairs named in the same way, until each document is left with
one name.  Names stand for contents, not for hashes of them, so two texts with
the same length and the same last name are equal.

Naming shuffles each block once: blocks are spread by hash, sorted within a spread,
and numbered in that order.  Blocks that hold a thousandth of all rows or more
(so at most 1000 of them) are named from a broadcast copy instead, so no group
of copies gathers in one task.

Defined cases: a null text counts as empty; empty texts are equal to each other.
A repeated row (same doc_id, same text) counts once in the result and once in
``group_size``.  Null doc_ids rank below all others.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, carried, lookup, stored

BLOCK_BYTES = 4096
SPREADS = 1 << 20


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``name``: equal for rows with equal keys, different otherwise.

    The key's hash picks one of SPREADS spreads, and the rank of the key among the
    sorted keys of its spread, with the spread's number, is the name.
    """
    rows = rows.withColumn("hash", F.xxhash64(*key))
    counted = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"))
    total = counted.agg(F.sum("rows").alias("all_rows"))
    is_hot = F.col("rows") >= F.greatest(F.col("all_rows") * F.lit(HOT_SHARE), F.lit(100.0))
    hot = stored(counted.join(F.broadcast(total), is_hot).select("hash", F.lit(True).alias("is_hot")), "hot")
    rest = rows
    if some_hot := not hot.isEmpty():
        flagged = rows.join(F.broadcast(hot), "hash", "left")
        rest = flagged.where("is_hot is null").drop("is_hot")
        of_hot = flagged.where("is_hot").drop("is_hot")
        contents = of_hot.select("hash", *key).distinct()
        names = contents.withColumn("name", -F.row_number().over(Window.orderBy("hash", *key)).cast("long"))
        of_hot = of_hot.join(F.broadcast(names), ["hash", *key])
    spread = F.pmod("hash", F.lit(SPREADS))
    rank = F.dense_rank().over(Window.partitionBy("spread").orderBy(*key)).cast("long")
    rest = rest.withColumn("spread", spread).withColumn("name", rank * SPREADS + F.col("spread")).drop("spread")
    columns = [c for c in rows.columns if c not in ("hash", *key)] + ["name"]
    return rest.select(*columns).unionByName(of_hot.select(*columns)) if some_hot else rest.select(*columns)


def block_identities(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per distinct (doc_id, text) row: doc_id, text_sha256, size (bytes) and name; (size, name) is the text's identity."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id"), body.alias("body")).withColumn("row", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    cuts = F.expr(f"sequence(0L, greatest(size - 1, 0L) div {int(block_bytes)}L)")
    pieces = F.transform(cuts, lambda i: F.struct(i.alias("at"), F.substring(F.col("body"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("block")))
    blocks = base.select("doc_id", "row", "size", F.explode(pieces).alias("piece")).select(F.struct("doc_id", "row").alias("row"), "size", "piece.at", "piece.block")
    level = stored(_numbered(blocks, ["block"]).select("row", "size", "at", "name").distinct(), "level0")
    done = []
    width = block_bytes
    while True:
        last = F.col("size") <= width
        done.append(level.where(last))
        level = level.where(~last)
        if level.isEmpty():
            break
        pairs = level.groupBy("row", "size", F.expr("at div 2").alias("at")).agg(
            F.min(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.min(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        level = stored(_numbered(stored(pairs, "pairs"), ["left", "right"]), "level")
        width *= 2
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return every.select(F.col("row.doc_id").alias("doc_id"), F.col("row.row").alias("text_sha256"), "size", "name")


def exact_dedup(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; of equal texts the largest doc_id stays."""
    rows = stored(block_identities(docs, text, block_bytes), "identities")
    groups = rows.groupBy("size", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = lookup(rows, groups.withColumn("rows", F.col("group_size")), ["size", "name"], ["group_size", "keep_id"], "rows", F.col("text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one_of_equal(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that exact dedup keeps, with all their columns; of repeated rows (doc_id and text) any one."""
    named = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))  # tells rows with one doc_id and different texts apart
    kept = exact_dedup(docs, text).where("kept").select(F.concat_ws(":", F.col("doc_id").cast("string"), "text_sha256").alias("key"))
    once = carried(docs, [named]).groupBy("k0").agg(F.any_value("whole").alias("whole"))  # repeated rows meet in their own tasks first
    return once.join(kept, F.col("k0") == F.col("key"), "left_semi").select("whole.*")
