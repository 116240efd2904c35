"""Hash tables over DataFrames: a table of unique keys, a set, and counters; every change gives a new table.

A bulk change is one aggregation by key (summed before the shuffle), so it takes
any number of rows; where several rows of a change hold one key, the smallest
``pos`` or the best value decides, never the order of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph.functions.cuts import with_rank


@dataclass(frozen=True)
class HashTable:
    rows: DataFrame  # key, val

    @staticmethod
    def of(entries: DataFrame) -> HashTable:
        """entries (key, val, pos): of equal keys the first position stays; a null key is none."""
        return HashTable(entries.where("key is not null").groupBy("key").agg(F.min_by("val", "pos").alias("val")))

    def insert(self, entries: DataFrame) -> HashTable:
        """Keys that are here keep their value."""
        new = HashTable.of(entries).rows
        return HashTable(self.rows.unionByName(new.join(self.rows.select("key"), "key", "left_anti")))

    def update(self, entries: DataFrame) -> HashTable:
        """The larger value of a key stays, as with priority inserts."""
        return HashTable(self.rows.unionByName(entries.where("key is not null").select("key", "val")).groupBy("key").agg(F.max("val").alias("val")))

    def delete(self, keys: DataFrame) -> HashTable:
        return HashTable(self.rows.join(keys.select("key").distinct(), "key", "left_anti"))

    def find(self, keys: DataFrame) -> DataFrame:
        """(key, val) of the asked keys, val null where there is none."""
        return keys.select("key").distinct().join(self.rows, "key", "left").select("key", "val")

    def count(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("n"))

    def entries(self, keep: Column | None = None) -> DataFrame:
        return self.rows if keep is None else self.rows.where(keep)

    def indexed(self) -> DataFrame:
        """(key, val, index): a place for every key, in key order."""
        return with_rank(self.rows, "key", name="index")


@dataclass(frozen=True)
class HashSet:
    rows: DataFrame  # key

    @staticmethod
    def of(keys: DataFrame) -> HashSet:
        return HashSet(keys.select("key").where("key is not null").distinct())

    def insert(self, keys: DataFrame) -> tuple[HashSet, DataFrame]:
        """The larger set, and the keys that were new."""
        new = HashSet.of(keys).rows.join(self.rows, "key", "left_anti")
        return HashSet(self.rows.unionByName(new)), new

    def contains(self, keys: DataFrame) -> DataFrame:
        here = self.rows.withColumn("found", F.lit(True))
        return keys.select("key").distinct().join(here, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"))

    def entries(self) -> DataFrame:
        return self.rows

    def clear(self) -> HashSet:
        return HashSet(self.rows.limit(0))


@dataclass(frozen=True)
class Counters:
    """An additive set: inserting a key adds to its value."""

    rows: DataFrame  # key, val

    def insert(self, entries: DataFrame) -> Counters:
        return Counters(self.rows.unionByName(entries.where("key is not null").select("key", "val")).groupBy("key").agg(F.sum("val").alias("val")))

    def find(self, keys: DataFrame, zero: int = 0) -> DataFrame:
        return keys.select("key").distinct().join(self.rows, "key", "left").select("key", F.coalesce("val", F.lit(zero)).alias("val"))

    def map(self, value: Column) -> Counters:
        return Counters(self.rows.select("key", value.alias("val")))

    def entries(self, keep: Column | None = None) -> DataFrame:
        return self.rows if keep is None else self.rows.where(keep)

    def count(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("n"))
