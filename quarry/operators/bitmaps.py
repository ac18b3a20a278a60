"""Conditions as bitmaps over the document blocks of an index.

``attribute_bits`` has a row a value of a dimension and block of 64 documents, with the bits of the documents that have the value; values of
sessions are their hours.  A clause of a condition picks values from the dictionary of its dimension, by
equality or by its own predicate on the few distinct values, and is the OR of their bits; conditions are the AND of their clauses.  A
negated clause keeps the documents whose attribute is known (three-valued, as the compiled conditions are) and that
have none of its values.  Pool sizes are bit counts.  Documents are joined to queries nowhere, and queries without conditions have no rows.

Arrays of attributes and of conditions hold no nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sizes import small
from .lexical import Index, Pool, bit, has_bit
from .predicates import kind_numbers

DIMENSIONS = ("course_lang", "weekday", "hour_range", "point", "kind", "lmt_kind", "unit")
_VALUE = "struct<dimension:string,value:string>"


def _values(doc: dict[str, Column]) -> Column:
    """The (dimension, value) pairs of a document; a null value says that the dimension is known."""

    def one(name: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.array(*(F.struct(F.lit(name).alias("dimension"), v.cast("string").alias("value")) for v in (F.lit(None), c))))

    def many(name: str, c: Column, value) -> Column:
        known = F.array(F.struct(F.lit(name).alias("dimension"), F.lit(None).cast("string").alias("value")))
        return F.when(c.isNotNull(), F.concat(known, F.transform(c, lambda x: F.struct(F.lit(name).alias("dimension"), value(x).cast("string").alias("value")))))

    parts = [
        one("course_lang", doc["lang"]), one("kind", doc["kind"]), one("lmt_kind", doc["lmt_kind"]), one("unit", doc["unit"]), one("point", doc["point"].cast("double")),
        many("weekday", doc["weekdays"], lambda d: d), many("hour_range", doc["sessions"], lambda s: F.concat_ws("-", s["start_hour"], s["end_hour"])),
    ]
    empty = F.array().cast(f"array<{_VALUE}>")
    return F.array_distinct(F.concat(*(F.coalesce(p, empty) for p in parts)))


def attribute_bits(docs: DataFrame, index: Index, doc: dict[str, Column]) -> DataFrame:
    """dimension, value, block, bits of documents (doc_id and the columns that ``doc`` names); write it once and keep it with the index."""
    rows = docs.select("doc_id", F.inline(_values(doc))).join(index.docs.select("doc_id", "block", "slot"), "doc_id")
    return rows.groupBy("dimension", "value", "block").agg(F.bit_or(bit(F.col("slot"))).alias("bits"))


def _clauses(conditions: DataFrame) -> DataFrame:
    """qid, side, dimension and wanted (values as text) of each clause that a condition (qid, must, must_not) has."""

    def of_side(side: str) -> Column:
        c = F.col(side)
        texts = lambda a: F.coalesce(a.cast("array<string>"), F.array().cast("array<string>"))
        wanted = {n: texts(c[n]) for n in ("course_lang", "weekday", "lmt_kind", "unit")}
        wanted["hour_range"] = F.when(F.size(c["hour_range"]) == 2, texts(c["hour_range"])).otherwise(F.array().cast("array<string>"))
        wanted["kind"] = texts(kind_numbers(c["kind"]))
        wanted["point"] = F.when(c["point"].isNotNull(), F.array(c["point"].cast("double").cast("string"))).otherwise(F.array().cast("array<string>"))
        return F.array(*(F.struct(F.lit(side).alias("side"), F.lit(n).alias("dimension"), wanted[n].alias("wanted")) for n in DIMENSIONS))

    every = F.concat(of_side("must"), of_side("must_not"))
    return conditions.select("qid", F.inline(every)).where(F.size("wanted") > 0)


def _meets(dimension: Column, value: Column, wanted: Column) -> Column:
    """Whether a value is one that a clause wants."""
    hours = F.split(value, "-")
    overlaps = (F.get(hours, F.lit(0)).try_cast("int") < F.get(wanted, F.lit(1)).try_cast("int")) & (F.get(hours, F.lit(1)).try_cast("int") > F.get(wanted, F.lit(0)).try_cast("int"))
    like = F.exists(wanted, lambda w: F.like(value, F.concat(F.lit("%"), w, F.lit("%"))))
    return F.when(dimension == "unit", like).when(dimension == "hour_range", overlaps).otherwise(F.array_contains(wanted, value))


def pools(conditions: DataFrame, bits: DataFrame) -> Pool:
    """The pool of each query under its conditions (qid, must, must_not)."""
    clauses = stored(_clauses(conditions).withColumn("clause", F.concat_ws(":", "side", "dimension")), "clauses")
    dictionary = bits.where("value is not null").select("dimension", "value").distinct()
    picked = dictionary.join(small(clauses), "dimension").where(_meets(F.col("dimension"), F.col("value"), F.col("wanted"))).select("qid", "clause", "dimension", "value")
    having = bits.join(small(picked), ["dimension", "value"]).groupBy("qid", "clause", "block").agg(F.bit_or("bits").alias("bits"))
    known = bits.where("value is null").select("dimension", "block", F.col("bits").alias("known"))
    barred = known.join(small(clauses.where("side = 'must_not'").select("qid", "clause", "dimension")), "dimension").join(having, ["qid", "clause", "block"], "left")
    barred = barred.select("qid", "clause", "block", F.col("known").bitwiseAND(F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")))).alias("bits"))
    asked = having.where(F.col("clause").startswith("must:"))
    counts = clauses.groupBy("qid").agg(F.count(F.lit(1)).alias("n_clauses"))
    met = asked.unionByName(barred).groupBy("qid", "block").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    masks = met.join(small(counts), "qid").where("n = n_clauses and bits <> 0").select("qid", "block", "bits")
    return Pool(stored(masks, "masks"), counts.select("qid"))


def pool_sizes(queries: DataFrame, pool: Pool, index: Index) -> DataFrame:
    """qid and n, the number of documents that each query may find."""
    restricted = small(pool.restricted.withColumn("is_restricted", F.lit(True)))
    counted = pool.masks.groupBy("qid").agg(F.sum(F.bit_count("bits")).alias("found"))
    rows = queries.select("qid").join(restricted, "qid", "left").join(counted, "qid", "left").crossJoin(F.broadcast(index.stats.select("n_docs")))
    return rows.select("qid", F.when(F.col("is_restricted"), F.coalesce("found", F.lit(0).cast("long"))).otherwise(F.col("n_docs")).alias("n"))


def in_pool(rows: DataFrame, pool: Pool, index: Index) -> DataFrame:
    """Rows (qid, doc_id, ...) with inside, whether the query may find the document: one bit is tested a row."""
    placed = rows.join(index.docs.select("doc_id", "block", "slot"), "doc_id", "left")
    marked = placed.join(small(pool.restricted.withColumn("is_restricted", F.lit(True))), "qid", "left").join(pool.masks, ["qid", "block"], "left")
    inside = F.coalesce(F.when(F.col("is_restricted"), has_bit(F.col("bits"), F.col("slot"))).otherwise(F.col("block").isNotNull()), F.lit(False))
    return marked.select(*rows.columns, inside.alias("inside"))


def pool_members(queries: DataFrame, pool: Pool, index: Index) -> DataFrame:
    """qid, doc_id: pools written out.  Of a query without conditions that is every document, so use it for small reports."""
    places = index.docs.select("doc_id", "block", "slot")
    members = places.join(pool.masks, "block").where(has_bit(F.col("bits"), F.col("slot"))).select("qid", "doc_id")
    free = small(queries.select("qid").join(pool.restricted, "qid", "left_anti"))
    return members.unionByName(places.crossJoin(free).select("qid", "doc_id"))
