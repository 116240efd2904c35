"""Sorted neighbour sets: as rows (src, dst) and as ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph.functions.cuts import cut, scanned, with_rank


def contains(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, found) for the asked pairs."""
    here = edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
    return pairs.select("src", "dst").distinct().join(here, ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("found"))


def with_place(edges: DataFrame) -> DataFrame:
    """(src, dst, idx): a neighbour's place in its ascending list, from its place in the order of all edges."""
    placed = cut(with_rank(edges.select("src", "dst"), "src", "dst", name="pos"))
    starts = placed.groupBy("src").agg(F.min("pos").alias("start"))
    return placed.join(starts, "src").select("src", "dst", (F.col("pos") - F.col("start")).alias("idx"))


def folded(edges: DataFrame, value: Column) -> DataFrame:
    """(src, dst, fold): running sums of a value (on src, dst) along each ascending list."""
    placed = cut(scanned(edges.select("src", "dst", value.alias("v")), ["src", "dst"], {"upto": (F.col("v"), "sum")}))
    before = placed.groupBy("src").agg(F.min_by(F.col("upto") - F.col("v"), "dst").alias("before"))
    return placed.join(before, "src").select("src", "dst", (F.col("upto") - F.col("before")).alias("fold"))


def first_where(edges: DataFrame, condition: Column) -> DataFrame:
    """(src, dst): the first neighbour for which the condition holds, for those that have one."""
    return edges.where(condition).groupBy("src").agg(F.min("dst").alias("dst"))


def count_where(edges: DataFrame, condition: Column) -> DataFrame:
    return edges.groupBy("src").agg(F.count_if(condition).alias("n"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "dst").union(b.select("src", "dst")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a without b."""
    return a.select("src", "dst").distinct().join(b.select("src", "dst"), ["src", "dst"], "left_anti")


def intersect_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, n): common members of each source's two sets, 0 included for sources of a."""
    both = a.select("src", "dst").distinct().join(b.select("src", "dst").distinct(), ["src", "dst"]).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return a.select("src").distinct().join(both, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"))


def split(edges: DataFrame, key: int) -> DataFrame:
    """(src, below, above, found): sizes of the two sides of a key and whether the key is there."""
    return edges.groupBy("src").agg(F.count_if(F.col("dst") < key).alias("below"), F.count_if(F.col("dst") > key).alias("above"), F.bool_or(F.col("dst") == key).alias("found"))


def concatenated(low: DataFrame, high: DataFrame) -> DataFrame:
    """The join of sets of which every member of one is below every member of the other; a union without a shuffle."""
    return low.select("src", "dst").unionByName(high.select("src", "dst"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.min("dst").alias("first"), F.max("dst").alias("last"))


# -- the same on ARRAY columns


def arr_contains(nbrs: Column, key) -> Column:
    return F.array_contains(nbrs, key)


def arr_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def arr_difference(a: Column, b: Column) -> Column:
    """a without b, ascending."""
    return F.array_sort(F.array_except(a, b))


def arr_intersect_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def arr_filter(nbrs: Column, condition) -> Column:
    return F.filter(nbrs, condition)


def arr_count_where(nbrs: Column, condition) -> Column:
    return F.size(F.filter(nbrs, condition))
