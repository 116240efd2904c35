"""Mixing sources to target weights by systematic sampling.  DataFrame functions only.

A source's expected copies per document are its target over its size.  The
documents of a source are ordered by size (then id), the expected copies are
summed along that order, one random offset of the source is added, and a
document is emitted once for every integer that the sum crosses at it.  Ordering
by size spreads the picks evenly over the sizes, so the words taken stay within
about one largest document of the target.

The prefix sum is done in two passes, so a source that holds a third of all rows
does not gather in one task: rows are ordered by (source, size, id) over ranges,
the rows of each source in each range are counted, and the counts before a range
are added to the row numbers inside it.

Null text: size 0.  Null source: a source of its own, last.  Size 0 sources:
target 0, nothing taken.  Empty table: no rows.  Repeated rows: each its own row.
The offset depends on the source's name only, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapgraph.llm.common import numbered, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, place: str = "", *rest: str) -> DataFrame:
    """doc_id, source, size (and the columns named) of rows that hold the documents at the place given."""
    text = F.col(place + "text")
    size = F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")
    return docs.select(F.col(place + "doc_id").cast("long").alias("doc_id"), F.col(place + "source").cast("string").alias("source"), size.alias("size"), *rest)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row per source (the only list that one task orders).

    Ordered by cap / weight, the capped sources come first: a source is capped
    if the rest, shared by weight among itself and those after it, exceeds its cap.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (rank + 1).cast("int"))
    ordered = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = W.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(W.currentRow, W.unboundedFollowing))
    shared = ordered.withColumn("rest", rest).withColumn("open_weight", open_weight).withColumn("capped", F.col("cap") * F.col("open_weight") <= F.col("rest") * F.col("weight"))
    # The level of the first source that is not capped holds for all after it.
    first_open = F.min(F.when(~F.col("capped"), F.struct((F.col("cap").cast("double") / F.col("weight")).alias("at"), "rest", "open_weight"))).over(W.partitionBy())
    level = F.col("open")
    return shared.withColumn("open", first_open).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level["rest"].cast("double") * F.col("weight").cast("double") / level["open_weight"].cast("double")).alias("target"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every document."""
    sizes, _ = written(sized(docs), "sizes")
    return _picked(sizes, weights, most).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _picked(sizes: DataFrame, weights, most) -> DataFrame:
    spark = sizes.sparkSession
    goals = targets(sizes, weights, most)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = ["size", "doc_id", *(c for c in sizes.columns if c == "row")]
    key = [F.col("source").asc_nulls_last(), *inner]
    ranged, _ = written(sizes.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()), "ranges")
    # A few rows per range; their running sum is the only thing that spans ranges.
    counts = ranged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("source", "part", F.coalesce(before, F.lit(0)).alias("before"))
    facts = starts.join(goals, starts["source"].eqNullSafe(goals["source"])).select(starts["source"].alias("s"), F.col("part").alias("p"), "before", "source_size", "target")
    inside = W.partitionBy("part", "source").orderBy(*inner)
    ranks = ranged.withColumn("rank", F.row_number().over(inside))
    placed = ranks.join(facts, (ranks["part"] == facts["p"]) & ranks["source"].eqNullSafe(facts["s"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rank = (F.col("before") + F.col("rank")).cast("double")
    copies = F.floor(rank * F.col("each") + F.col("offset")) - F.floor((rank - 1.0) * F.col("each") + F.col("offset"))
    return placed.withColumn("each", each).withColumn("offset", offset).withColumn("copies", copies.cast("long"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    rows, _ = numbered(docs)
    sizes, _ = written(sized(rows, "d.", "row"), "sizes")
    picks = _picked(sizes, weights, most).where("copies > 0").select("row", "copies")
    return rows.join(picks, "row").select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("d.*")


#: The same rows in DuckDB.
ORACLE = """
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS weight, 3 * source_size AS cap FROM t),
o AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
  (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_weight FROM w),
c AS (SELECT *, cap * open_weight <= rest * weight AS capped FROM o),
f AS (SELECT rest AS r, open_weight AS ow FROM c WHERE NOT capped ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE r::DOUBLE * weight::DOUBLE / ow::DOUBLE END AS target FROM c LEFT JOIN f ON true),
n AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id)::DOUBLE AS k,
  CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS each,
  ('0x' || substr(md5(coalesce('s:' || d.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS off
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (floor(k * each + off) - floor((k - 1) * each + off))::BIGINT * size AS taken,
  (floor(k * each + off) - floor((k - 1) * each + off))::BIGINT AS copies FROM n
"""
