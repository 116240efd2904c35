"""Indexed sequences (idx, val): scans, packs, splits, searches, sorts, histograms, set indexes and folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.functions.cuts import scanned, with_rank
from snapgraph.functions.hashing import priority

# -- construction and maps


def tabulate(spark: SparkSession, n: int, value: Column) -> DataFrame:
    """value is over idx; nothing is stored until it is asked for."""
    return spark.range(n).select(F.col("id").alias("idx")).select("idx", value.alias("val"))


def fill(spark: SparkSession, n: int, value) -> DataFrame:
    return tabulate(spark, n, F.lit(value))


def subsequence(a: DataFrame, low: int, high: int) -> DataFrame:
    """[low, high), indexed from 0."""
    return a.where((F.col("idx") >= low) & (F.col("idx") < high)).withColumn("idx", F.col("idx") - low)


def mapped(a: DataFrame, value: Column) -> DataFrame:
    return a.select("idx", value.alias("val"))


def reduce(a: DataFrame, fold: Column) -> DataFrame:
    return a.agg(fold.alias("value"))


def scan(a: DataFrame, kind: str = "sum", inclusive: bool = False) -> DataFrame:
    """idx, val, scan."""
    return scanned(a, ["idx"], {"scan": (F.col("val"), kind)}, inclusive)


def pack(a: DataFrame, keep: Column) -> DataFrame:
    """(idx, val): kept entries, in order, indexed anew."""
    return with_rank(a.where(keep), "idx", name="new").select(F.col("new").alias("idx"), "val")


def pack_index(a: DataFrame, keep: Column) -> DataFrame:
    return with_rank(a.where(keep).select("idx"), "idx", name="pos").select("pos", "idx")


def split_by(a: DataFrame, group: Column) -> DataFrame:
    """Stable partition by a small class: (pos, idx, val, class)."""
    return with_rank(a.withColumn("class", group), "class", "idx", name="pos").select("pos", "idx", "val", "class")


def enumerate_flags(a: DataFrame, flag: Column) -> DataFrame:
    """idx and how many flags are set before it."""
    return scanned(a.select("idx", flag.cast("int").alias("flag")), ["idx"], {"before": (F.col("flag"), "sum")}, inclusive=False).select("idx", "before")


def reversed_(a: DataFrame) -> DataFrame:
    n = a.agg(F.max("idx").alias("top"))
    return a.join(F.broadcast(n)).select((F.col("top") - F.col("idx")).alias("idx"), "val")


def rotated(a: DataFrame, r: int) -> DataFrame:
    n = a.agg((F.max("idx") + 1).alias("n"))
    return a.join(F.broadcast(n)).select(F.pmod(F.col("idx") + r, F.col("n")).alias("idx"), "val")


def appended(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("n"))
    return a.select("idx", "val").unionByName(b.join(F.broadcast(n)).select((F.col("idx") + F.col("n")).alias("idx"), "val"))


def flattened(nested: DataFrame) -> DataFrame:
    """(idx, ARRAY val) to (idx, val) in order."""
    each = nested.select("idx", F.posexplode("val").alias("j", "item"))
    return with_rank(each, "idx", "j", name="new").select(F.col("new").alias("idx"), F.col("item").alias("val"))


def bag(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("val")
    for part in parts[1:]:
        out = out.union(part.select("val"))
    return out


def shuffled(a: DataFrame, seed: int = 0) -> DataFrame:
    """A deterministic permutation: (pos, idx, val)."""
    return with_rank(a, priority(F.col("idx") + F.lit(seed)), "idx", name="pos").select("pos", "idx", "val")


def transposed(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def scatter(updates: DataFrame, fold) -> DataFrame:
    """(target, value): all writes to one target combined."""
    return updates.groupBy("target").agg(fold("val").alias("value"))


# -- matrices and ranges


def spmv(cells: DataFrame, x: DataFrame, rows: DataFrame, times=lambda a, b: a * b, plus=F.sum, zero=0) -> DataFrame:
    """(i, y): matrix (i, j, val) by vector (j, x) over any semiring; empty rows give the zero."""
    part = cells.join(x, "j").groupBy("i").agg(plus(times(F.col("val"), F.col("x"))).alias("y"))
    return rows.select("i").join(part, "i", "left").select("i", F.coalesce("y", F.lit(zero)).alias("y"))


def range_min(a: DataFrame, queries: DataFrame, block: int = 256) -> DataFrame:
    """(low, high, idx): index of the minimum of each closed range, leftmost on ties.

    Whole blocks inside a range are answered from their own minima, so a range
    reads at most two blocks of entries and the minima between.
    """
    b = F.floor(F.col("idx") / block)
    minima = a.groupBy(b.alias("b")).agg(F.min(F.struct("val", "idx")).alias("m"))
    q = queries.select("low", "high").distinct().withColumn("lb", F.floor(F.col("low") / block)).withColumn("hb", F.floor(F.col("high") / block))
    inner = q.where("hb > lb + 1").withColumn("b", F.explode(F.sequence(F.col("lb") + 1, F.col("hb") - 1))).join(minima, "b").select("low", "high", "m")
    edges = q.withColumn("b", F.explode(F.array_distinct(F.array("lb", "hb")))).join(a.withColumn("b", b), "b").where("idx between low and high").select("low", "high", F.struct("val", "idx").alias("m"))
    return inner.unionByName(edges).groupBy("low", "high").agg(F.min("m").alias("m")).select("low", "high", "m.idx")


def best_run(a: DataFrame) -> DataFrame:
    """(best): the largest sum of adjoining entries."""
    sums = scanned(a, ["idx"], {"s": (F.col("val"), "sum")})
    low = scanned(sums.select("idx", "s"), ["idx"], {"low": (F.col("s"), "min")}, inclusive=False)
    return low.agg(F.max(F.col("s") - F.least(F.coalesce("low", F.lit(0)), F.lit(0))).alias("best"))


# -- order


def sorted_(a: DataFrame, *order) -> DataFrame:
    """(pos, ...): the place of each row in the order."""
    return with_rank(a, *order, name="pos")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sequences as one sorted one; of equals, a's come first."""
    both = a.select("val", "idx", F.lit(0).alias("side")).unionByName(b.select("val", "idx", F.lit(1).alias("side")))
    return with_rank(both, "val", "side", "idx", name="pos").select("pos", "val", "side")


def bucket_counts(a: DataFrame, key: Column, buckets: int) -> DataFrame:
    """(bucket, n) for every bucket, empty ones too."""
    counts = a.groupBy(key.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return a.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def bucket_offsets(a: DataFrame, key: Column, buckets: int) -> DataFrame:
    """(bucket, n, start): counting sort's offsets."""
    return scanned(bucket_counts(a, key, buckets), ["bucket"], {"start": (F.col("n"), "sum")}, inclusive=False)


def kth_smallest(a: DataFrame, k: int) -> DataFrame:
    return with_rank(a, "val", "idx").where(F.col("rank") == k).select("val")


def approximate_kth(a: DataFrame, share: float, accuracy: int = 10_000) -> DataFrame:
    return a.agg(F.percentile_approx("val", share, accuracy).alias("val"))


def inversions(a: DataFrame) -> DataFrame:
    """(idx) after which the order breaks: each entry meets its successor by a join on idx."""
    return a.join(a.select((F.col("idx") - 1).alias("idx"), F.col("val").alias("next")), "idx").where("val > next").select("idx")


def is_sorted(a: DataFrame) -> DataFrame:
    return inversions(a).agg((F.count(F.lit(1)) == 0).alias("sorted"), F.min("idx").alias("first_break"))


def is_partitioned(a: DataFrame, condition: Column) -> DataFrame:
    """Whether all entries for which the condition holds stand before all others."""
    holds = F.coalesce(condition, F.lit(False))
    last, first = F.max(F.when(holds, F.col("idx"))), F.min(F.when(~holds, F.col("idx")))
    return a.agg(F.coalesce(last < first, F.lit(True)).alias("partitioned"))


def for_each(a: DataFrame, act: Callable[[Iterator], None]) -> None:
    """Runs act once for each partition's rows, on the executors; for its effects only."""
    a.foreachPartition(act)


# -- groups


def collect_reduce(a: DataFrame, key: Column, fold: Column, buckets: int | None = None, zero=0) -> DataFrame:
    """(key, value): present keys, or with buckets every key of the dense domain."""
    out = a.groupBy(key.cast("long").alias("key")).agg(fold.alias("value"))
    if buckets is None:
        return out
    return a.sparkSession.range(buckets).select(F.col("id").alias("key")).join(out, "key", "left").select("key", F.coalesce("value", F.lit(zero)).alias("value"))


def distinct_sorted(a: DataFrame) -> DataFrame:
    return with_rank(a.select("val").distinct(), "val", name="pos").select("pos", "val")


def unique(a: DataFrame) -> DataFrame:
    """Entries that differ from the one before."""
    before = a.select((F.col("idx") + 1).alias("idx"), F.col("val").alias("prev"), F.lit(True).alias("has"))
    return a.join(before, "idx", "left").where(F.col("has").isNull() | ~F.col("val").eqNullSafe(F.col("prev"))).select("idx", "val")


def min_max(a: DataFrame) -> DataFrame:
    return a.agg(F.min("val").alias("low"), F.max("val").alias("high"))


def array_sum(a: DataFrame) -> DataFrame:
    """(j, value): elementwise sum of ARRAY values."""
    return a.select(F.posexplode("val").alias("j", "item")).groupBy("j").agg(F.sum("item").alias("value"))


def heavy_keys(a: DataFrame, key: Column, share: float) -> DataFrame:
    """Keys that hold at least this share of the rows."""
    counts = a.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = a.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("n") >= F.col("total") * share).select("key", "n")


# -- search and comparison


def find_if(a: DataFrame, condition: Column) -> DataFrame:
    """The first index for which the condition holds, the length if there is none."""
    return a.agg(F.coalesce(F.min(F.when(condition, F.col("idx"))), F.coalesce(F.max("idx") + 1, F.lit(0))).alias("idx"))


def quantifiers(a: DataFrame, condition: Column) -> DataFrame:
    return a.agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("all_of"), F.coalesce(F.bool_or(condition), F.lit(False)).alias("any_of"), (~F.coalesce(F.bool_or(condition), F.lit(False))).alias("none_of"))


def find_first_of(a: DataFrame, values: DataFrame) -> DataFrame:
    return a.join(values.select("val").distinct(), "val", "left_semi").agg(F.min("idx").alias("idx"))


def adjacent_find(a: DataFrame) -> DataFrame:
    return a.join(a.select((F.col("idx") - 1).alias("idx"), F.col("val").alias("next")), "idx").where("val = next").agg(F.min("idx").alias("idx"))


def mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first index at which two sequences differ; the shorter one's length if one starts the other."""
    both = a.select("idx", F.col("val").alias("x"), F.lit(1).alias("ha")).join(b.select("idx", F.col("val").alias("y"), F.lit(1).alias("hb")), "idx", "full_outer")
    differs = F.col("ha").isNull() | F.col("hb").isNull() | ~F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.coalesce(F.min(F.when(differs, F.col("idx"))), F.coalesce(F.max("idx") + 1, F.lit(0))).alias("idx"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("idx", F.col("val").alias("x"), F.lit(1).alias("ha")).join(b.select("idx", F.col("val").alias("y"), F.lit(1).alias("hb")), "idx", "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.col("ha").isNotNull() & F.col("hb").isNotNull() & F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("equal"))


def lexicographical_less(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("idx", F.col("val").alias("x"), F.lit(1).alias("ha")).join(b.select("idx", F.col("val").alias("y"), F.lit(1).alias("hb")), "idx", "full_outer")
    differs = F.col("ha").isNull() | F.col("hb").isNull() | ~F.col("x").eqNullSafe(F.col("y"))
    less = F.col("ha").isNull() | (F.col("hb").isNotNull() & (F.col("x") < F.col("y")))
    return both.where(differs).agg(F.coalesce(F.min_by(less, "idx"), F.lit(False)).alias("less"))


def search(a: DataFrame, pattern: list, last: bool = False) -> DataFrame:
    """First (or last) index at which the pattern stands; every pattern place shifts and the hits of one start are counted."""
    wanted = F.broadcast(a.sparkSession.createDataFrame(list(enumerate(pattern)), ["k", "val"]))
    hits = a.join(wanted, "val").groupBy((F.col("idx") - F.col("k")).alias("at")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == len(pattern)) & (F.col("at") >= 0))
    return hits.agg((F.max if last else F.min)("at").alias("idx"))


def extrema(a: DataFrame) -> DataFrame:
    """Indexes of the smallest and largest values, leftmost on ties."""
    return a.agg(F.min(F.struct("val", "idx")).alias("m"), F.max(F.struct(F.col("val"), (-F.col("idx")).alias("minus"))).alias("x")).select(F.col("m.idx").alias("min_idx"), (-F.col("x.minus")).alias("max_idx"))


def count_if(a: DataFrame, condition: Column) -> DataFrame:
    return a.agg(F.count_if(condition).alias("n"))


def remove_if(a: DataFrame, condition: Column) -> DataFrame:
    return pack(a, ~F.coalesce(condition, F.lit(False)))


def lower_bound(a: DataFrame, value) -> DataFrame:
    """Index of the first entry of a sorted sequence that is not below the value."""
    return a.agg(F.count_if(F.col("val") < value).alias("idx"))


def window_average(samples: DataFrame, windows: int) -> DataFrame:
    """(time, value) to (time, latency): the mean of each of so many equal spans of time, at the span's middle."""
    edge = samples.agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    step = (F.col("t1") - F.col("t0")) / windows
    placed = samples.join(F.broadcast(edge)).withColumn("w", F.least(F.floor(F.try_divide(F.col("time") - F.col("t0"), step)), F.lit(windows - 1)))
    return placed.groupBy(F.coalesce("w", F.lit(0)).alias("w")).agg(F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.avg("value").alias("latency")).select((F.col("t0") + (F.col("w") + 0.5) * (F.col("t1") - F.col("t0")) / windows).alias("time"), "latency")
