"""Ordered maps over DataFrames (key, val) with unique keys; every operation gives a new map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapgraph.functions.cuts import ordered_parts, scanned, with_rank

KEEP_NEW = lambda old, new: new


@dataclass(frozen=True)
class OrderedMap:
    rows: DataFrame  # key, val

    @staticmethod
    def of(df: DataFrame, key: str, val: str) -> OrderedMap:
        return OrderedMap(df.select(F.col(key).alias("key"), F.col(val).alias("val")))

    # -- lookups

    def find(self, key) -> DataFrame:
        return self.rows.where(F.col("key") == key)

    def contains(self, keys: DataFrame) -> DataFrame:
        here = self.rows.select("key", F.lit(True).alias("found"))
        return keys.select("key").join(here, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))

    def near(self, keys: DataFrame, direction: str) -> DataFrame:
        """(q, key, val): for every asked key q the entry next to it (next: above, previous: below, floor: at or below); null if there is none.

        The as-of join: entries and questions share one order, cut into ranges;
        inside a range a window finds the nearest entry, and the nearest entry of
        the ranges before comes from a table with one row per range.
        """
        entry = self.rows.select("key", F.lit(0).alias("ask"), F.struct("key", "val").alias("e"))
        ask = keys.select("key", F.lit(1).alias("ask"), F.lit(None).cast(entry.schema["e"].dataType).alias("e"))
        up = direction != "next"
        # Among equal keys: floor sees the entry first, the strict forms see the question first.
        tie = F.col("ask") if direction == "floor" else -F.col("ask")
        order = [F.col("key").asc() if up else F.col("key").desc(), F.col("tie").asc()]
        parts = ordered_parts(entry.unionByName(ask).withColumn("tie", tie), *order)
        inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        edge = parts.groupBy("_part").agg((F.max if up else F.min)("e").alias("edge"))
        carried = edge.select(F.col("_part").alias("_p"), F.last("edge", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
        found = parts.withColumn("own", F.last("e", ignorenulls=True).over(inside)).join(F.broadcast(carried), F.col("_part") == F.col("_p"))
        nearest = F.coalesce("own", "before")
        return found.where("ask = 1").select(F.col("key").alias("q"), nearest["key"].alias("key"), nearest["val"].alias("val"))

    def first(self) -> DataFrame:
        return self.rows.agg(F.min(F.struct("key", "val")).alias("e")).select("e.key", "e.val")

    def last(self) -> DataFrame:
        return self.rows.agg(F.max(F.struct("key", "val")).alias("e")).select("e.key", "e.val")

    def ranked(self) -> DataFrame:
        """key, val and the 0-based place in key order."""
        return with_rank(self.rows, "key")

    def rank(self, key) -> DataFrame:
        return self.rows.agg(F.count_if(F.col("key") < key).alias("rank"))

    def select(self, i: int) -> DataFrame:
        return self.ranked().where(F.col("rank") == i).select("key", "val")

    # -- changes

    def upsert(self, other: OrderedMap, merge: Callable[[Column, Column], Column] = KEEP_NEW) -> OrderedMap:
        """Union of keys; merge(old, new) where both have one."""
        a, b = self.rows.select("key", F.col("val").alias("old"), F.lit(1).alias("ha")), other.rows.select("key", F.col("val").alias("new"), F.lit(1).alias("hb"))
        val = F.when(F.col("ha").isNull(), F.col("new")).when(F.col("hb").isNull(), F.col("old")).otherwise(merge(F.col("old"), F.col("new")))
        return OrderedMap(a.join(b, "key", "full_outer").select("key", val.alias("val")))

    union = upsert

    def update(self, key, change: Callable[[Column], Column]) -> OrderedMap:
        return OrderedMap(self.rows.select("key", F.when(F.col("key") == key, change(F.col("val"))).otherwise(F.col("val")).alias("val")))

    def remove(self, key) -> OrderedMap:
        return OrderedMap(self.rows.where(F.col("key") != key))

    def multi_insert(self, batch: DataFrame) -> OrderedMap:
        """batch (key, val, pos): of equal keys the last position wins."""
        return self.upsert(OrderedMap(batch.groupBy("key").agg(F.max_by("val", "pos").alias("val"))))

    def multi_insert_combine(self, batch: DataFrame, fold: Callable, merge: Callable[[Column, Column], Column]) -> OrderedMap:
        return self.upsert(OrderedMap(batch.groupBy("key").agg(fold("val").alias("val"))), merge)

    def multi_insert_reduce(self, batch: DataFrame, reduce: Column, merge: Callable[[Column, Column], Column] = KEEP_NEW) -> OrderedMap:
        """reduce: an aggregate over the batch's values of one key."""
        return self.upsert(OrderedMap(batch.groupBy("key").agg(reduce.alias("val"))), merge)

    def multi_update(self, batch: OrderedMap, change: Callable[[Column, Column], Column]) -> OrderedMap:
        """Only keys that are here change."""
        new = batch.rows.select("key", F.col("val").alias("new"), F.lit(True).alias("hit"))
        return OrderedMap(self.rows.join(new, "key", "left").select("key", F.when(F.col("hit"), change(F.col("val"), F.col("new"))).otherwise(F.col("val")).alias("val")))

    def filter(self, condition: Column) -> OrderedMap:
        return OrderedMap(self.rows.where(condition))

    def map(self, value: Column) -> OrderedMap:
        return OrderedMap(self.rows.select("key", value.alias("val")))

    def map_filter(self, value: Column) -> OrderedMap:
        """Entries whose new value is null leave."""
        return OrderedMap(self.rows.select("key", value.alias("val")).where("val is not null"))

    # -- set algebra

    def intersect(self, other: OrderedMap, merge: Callable[[Column, Column], Column] = KEEP_NEW) -> OrderedMap:
        both = self.rows.withColumnRenamed("val", "old").join(other.rows.withColumnRenamed("val", "new"), "key")
        return OrderedMap(both.select("key", merge(F.col("old"), F.col("new")).alias("val")))

    def difference(self, other: OrderedMap) -> OrderedMap:
        return OrderedMap(self.rows.join(other.rows.select("key"), "key", "left_anti"))

    def same_keys(self, other: OrderedMap) -> bool:
        return self.rows.select("key").exceptAll(other.rows.select("key")).isEmpty() and other.rows.select("key").exceptAll(self.rows.select("key")).isEmpty()

    def equals(self, other: OrderedMap) -> bool:
        return self.rows.exceptAll(other.rows).isEmpty() and other.rows.exceptAll(self.rows).isEmpty()

    # -- ranges

    def range(self, low, high) -> OrderedMap:
        return OrderedMap(self.rows.where(F.col("key").between(low, high)))

    def up_to(self, high) -> OrderedMap:
        return OrderedMap(self.rows.where(F.col("key") <= high))

    def from_(self, low) -> OrderedMap:
        return OrderedMap(self.rows.where(F.col("key") >= low))

    def range_number(self, low, count: int) -> DataFrame:
        """The first ``count`` entries from ``low`` on: a top-k, so nothing is sorted in whole."""
        return self.rows.where(F.col("key") >= low).orderBy("key").limit(count)

    def range_number_reduce(self, low, count: int, fold: Column) -> DataFrame:
        return self.range_number(low, count).agg(fold.alias("value"))

    def split(self, key) -> tuple[OrderedMap, OrderedMap, DataFrame]:
        return OrderedMap(self.rows.where(F.col("key") < key)), OrderedMap(self.rows.where(F.col("key") > key)), self.find(key)

    def joined(self, above: OrderedMap) -> OrderedMap:
        """Concatenation: every key of ``above`` is over every key here."""
        return OrderedMap(self.rows.unionByName(above.rows))

    # -- folds

    def reduce(self, fold: Column) -> DataFrame:
        return self.rows.agg(fold.alias("value"))

    def ordered_fold(self, zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda x: x) -> DataFrame:
        """Fold in key order for operations that do not commute; the entries meet in one array, so this is for small maps."""
        return self.rows.agg(F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("key", "val"))), lambda e: e["val"]), zero, step, finish).alias("value"))

    def affine_fold(self, multiplier: int, modulus: int, zero: int = 0) -> DataFrame:
        """Fold by acc -> (acc * multiplier + val) mod modulus over all keys, in key order.

        Such steps compose: a value counts multiplied by the multiplier to the power of the
        entries after it, so every entry is weighed by its place and the sum takes any order.
        """
        squares, x = [], multiplier % modulus
        for _ in range(48):  # multiplier ** (2 ** k)
            squares.append(x)
            x = x * x % modulus

        def power(n: Column) -> Column:
            out = F.lit(1).cast("long")
            for k, square in enumerate(squares):
                out = F.pmod(out * F.when(F.getbit(n, F.lit(k)) == 1, F.lit(square)).otherwise(F.lit(1)), F.lit(modulus).cast("long"))
            return out

        size = self.rows.agg(F.count(F.lit(1)).alias("_n"))
        m = F.lit(modulus).cast("long")
        placed = self.ranked().join(F.broadcast(size)).select(F.pmod(F.pmod("val", m) * power(F.col("_n") - 1 - F.col("rank")), m).alias("x"))
        whole = placed.agg(F.coalesce(F.sum("x"), F.lit(0).cast("long")).alias("x")).join(F.broadcast(size))
        return whole.select(F.pmod(F.lit(zero % modulus).cast("long") * power(F.col("_n")) + F.col("x"), m).alias("value"))

    def exists(self, condition: Column) -> DataFrame:
        return self.rows.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("found"))

    def prefix_sizes(self, size: Column) -> DataFrame:
        """key, val and the sum of the sizes before."""
        return scanned(self.rows, ["key"], {"before": (size, "sum")}, inclusive=False)

    def take_while(self, condition: Column) -> DataFrame:
        """Entries before the first, in key order, for which the condition fails."""
        stop = self.rows.where(~condition).agg(F.min("key").alias("stop"))
        return self.rows.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("key") < F.col("stop"))).select("key", "val")

    # -- augmented

    def aug_left(self) -> DataFrame:
        """Every key with the sum of the values up to and including it."""
        return scanned(self.rows, ["key"], {"sum": (F.col("val"), "sum")})

    def aug_right(self) -> DataFrame:
        return scanned(self.rows, [F.col("key").desc()], {"sum": (F.col("val"), "sum")})

    def aug_range(self, low, high, fold: Column) -> DataFrame:
        return self.range(low, high).reduce(fold)

    def aug_ranges(self, ranges: DataFrame) -> DataFrame:
        """(low, high, sum, n) for many closed ranges: running sums at the floor of high less those below low.  No range meets its entries."""
        running = scanned(self.rows, ["key"], {"sum": (F.col("val"), "sum"), "n": (F.lit(1), "sum")})
        upto = OrderedMap(running.select("key", F.struct("sum", "n").alias("val")))
        at = lambda side, way, name: upto.near(ranges.select(F.col(side).alias("key")).distinct(), way).select(F.col("q").alias(side), F.col("val").alias(name))
        both = ranges.join(at("high", "floor", "a"), "high", "left").join(at("low", "previous", "b"), "low", "left")
        less = lambda f: F.when(F.col("high") < F.col("low"), 0).otherwise(F.coalesce(F.col("a")[f], F.lit(0)) - F.coalesce(F.col("b")[f], F.lit(0)))
        return both.select("low", "high", less("sum").alias("sum"), less("n").cast("long").alias("n")).distinct()

    def keys(self) -> DataFrame:
        return self.ranked().select("rank", "key")

    def values(self) -> DataFrame:
        """(rank, val) in key order."""
        return self.ranked().select("rank", "val")

    def foreach_index(self, value: Column) -> DataFrame:
        """(rank, value): a function of key, val and rank for every entry."""
        return self.ranked().select("rank", value.alias("value"))

    @staticmethod
    def from_sorted(entries: DataFrame) -> OrderedMap:
        """entries (idx, key, val) in ascending order of unique keys; raises if they are not."""
        after = entries.select((F.col("idx") - 1).alias("idx"), F.col("key").alias("next"))
        if not entries.join(after, "idx").where("key >= next").isEmpty():
            raise ValueError("the keys do not ascend")
        return OrderedMap(entries.select("key", "val"))

    def multi_insert_sorted(self, entries: DataFrame, merge: Callable[[Column, Column], Column] = KEEP_NEW) -> OrderedMap:
        """A bulk insert of entries that are sorted and unique already, so nothing is reduced first."""
        return self.upsert(OrderedMap.from_sorted(entries), merge)

    def aug_select(self, share: float) -> DataFrame:
        """The first entry at which the running sum of values reaches the share of all."""
        total = self.rows.agg(F.sum("val").alias("total"))
        return self.aug_left().join(F.broadcast(total)).where(F.col("sum") >= F.col("total") * share).orderBy("key").limit(1).select("key", "val")

    def aug_filter(self, least) -> OrderedMap:
        """Entries of at least a value; on Parquet sorted by it, row groups under it are skipped."""
        return self.filter(F.col("val") >= least)
