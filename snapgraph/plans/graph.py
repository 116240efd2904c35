"""The graph model: vertices(id) and edges(src, dst), both as DataFrames, immutable."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.functions.cuts import cut, with_rank


@dataclass(frozen=True)
class Graph:
    """An undirected graph holds both directions of every edge; vertices may have none."""

    vertices: DataFrame
    edges: DataFrame
    #: Whether every edge is there in both directions, so that in-edges may be read off the out-edges.
    symmetric: bool = False
    #: Where the vertices are the edges' sources: the edges as they came, repeats too.
    raw: DataFrame | None = None

    @staticmethod
    def from_pairs(pairs: DataFrame, vertices: DataFrame | None = None, simplify: bool = True) -> Graph:
        """Symmetric closure of (a, b); simplify drops self loops."""
        pairs = pairs.toDF("a", "b").where("a is not null and b is not null")
        if simplify:
            pairs = pairs.where("a <> b")
        both = pairs.select(F.explode(F.array(F.struct(F.col("a").cast("long").alias("src"), F.col("b").cast("long").alias("dst")), F.struct(F.col("b").cast("long").alias("src"), F.col("a").cast("long").alias("dst")))).alias("e"))
        return Graph.from_edges(both.select("e.src", "e.dst"), vertices, symmetric=True)

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, symmetric: bool = False) -> Graph:
        raw = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
        edges = raw.distinct()
        ids = edges.select(F.col("src").alias("id")).distinct() if vertices is None else vertices.select(F.col("id").cast("long")).union(edges.select("src")).union(edges.select("dst")).distinct()
        return Graph(ids, edges, symmetric, raw if vertices is None else None)

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long"))

    def cached(self) -> Graph:
        """For algorithms of many rounds: edges dealt by source and sorted once, so that a round moves its frontier and its messages only."""
        parts = int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if self.raw is None:
            return Graph(self.vertices.cache(), self.edges.repartition(parts, "src").sortWithinPartitions("src").cache(), self.symmetric)
        # Repeats of an edge meet where its source is dealt to, so the edges are shuffled once and the vertices not at all.
        edges = self.raw.repartition(parts, "src").distinct().sortWithinPartitions("src").cache()
        return Graph(edges.select(F.col("src").alias("id")).distinct().cache(), edges, self.symmetric)

    def release(self) -> None:
        """Gives back what cached() keeps."""
        self.vertices.unpersist()
        self.edges.unpersist()

    # -- sizes

    def num_vertices(self) -> DataFrame:
        """max id + 1, 0 if there is none: ids leave gaps."""
        return self.vertices.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("n"))

    def count_vertices(self) -> DataFrame:
        return self.vertices.agg(F.count(F.lit(1)).alias("n"))

    def num_edges(self) -> DataFrame:
        return self.edges.agg(F.count(F.lit(1)).alias("m"))

    def degrees(self) -> DataFrame:
        counts = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    # -- access

    def contains_vertex(self, v: int) -> bool:
        return bool(self.vertices.where(F.col("id") == v).limit(1).count())

    def find_vertex(self, v: int) -> DataFrame:
        return self.edges.where(F.col("src") == v).select("dst")

    def map_vertices(self, **columns: Column) -> DataFrame:
        """id, its place in id order, and the given columns (on id and index)."""
        return with_rank(self.vertices, "id", name="index").select("id", "index", *(c.alias(n) for n, c in columns.items()))

    def map_reduce(self, value: Column, fold) -> DataFrame:
        return self.degrees().agg(fold(value).alias("value"))

    def filter(self, condition: Column) -> Graph:
        """Keeps vertex entries; their neighbour sets stay as they are."""
        kept = self.degrees().where(condition).select("id")
        return Graph(kept, self.edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi"))

    def map_all_edges(self, **columns: Column) -> DataFrame:
        return self.edges.select("src", "dst", *(c.alias(n) for n, c in columns.items()))

    def scan(self) -> None:
        """Reads every edge and keeps nothing."""
        self.edges.write.format("noop").mode("overwrite").save()

    def map_vertices_no_index(self, **columns: Column) -> DataFrame:
        """id and the given columns (on id): nothing is ordered."""
        return self.vertices.select("id", *(c.alias(n) for n, c in columns.items()))

    def iter_edges(self) -> DataFrame:
        """(id, visited, degree, ok): every vertex's edges counted by a scan, its distinct neighbours, and whether they agree."""
        seen = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("visited"))
        sizes = self.edges.distinct().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        both = self.vertices.join(seen, "id", "left").join(sizes, "id", "left")
        return both.select("id", F.coalesce("visited", F.lit(0)).alias("visited"), F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("ok", F.col("visited") == F.col("degree"))

    def check_edges(self) -> DataFrame:
        """How many edges end outside 0..num_vertices-1 (0 for a sound graph)."""
        n = self.num_vertices()
        return self.edges.join(F.broadcast(n)).agg(F.count_if((F.col("dst") >= F.col("n")) | (F.col("dst") < 0)).alias("bad"))

    def retrieve_edges(self) -> DataFrame:
        """(pos, src, dst): the edge list by (src, dst); a vertex's edges start at its exclusive degree sum."""
        return with_rank(self.edges.select("src", "dst"), "src", "dst", name="pos").select("pos", "src", "dst")

    def adjacency(self) -> DataFrame:
        """The flat snapshot: id, nbrs (ascending), degree."""
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
        return self.vertices.join(lists, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs")).withColumn("degree", F.size("nbrs").cast("long"))

    # -- updates

    def insert_edges(self, batch: DataFrame, remove_dups: bool = True) -> Graph:
        batch = batch.select(F.col("src").cast("long"), F.col("dst").cast("long"))
        edges = self.edges.union(batch.distinct() if remove_dups else batch).distinct()
        return Graph(self.vertices.union(batch.select("src")).distinct(), edges)

    def delete_edges(self, batch: DataFrame) -> Graph:
        """Set difference; vertices stay, and a batch for unknown vertices changes nothing."""
        return Graph(self.vertices, self.edges.join(batch.select("src", "dst").distinct(), ["src", "dst"], "left_anti"))

    def append_slab(self, slab: Graph) -> Graph:
        """Adds vertices that are all new; raises if one is there already."""
        if self.vertices.join(slab.vertices, "id", "left_semi").limit(1).count():
            raise ValueError("a vertex of the slab is already in the graph")
        return Graph(self.vertices.union(slab.vertices), self.edges.union(slab.edges))

    # -- footprint

    def code_sizes(self) -> DataFrame:
        """(src, dst, bytes): the byte code of each gap; a list's first entry is a signed distance from its source.

        An edge meets the one before it by its place in the whole order, so a hub's list is spread like any other.
        """
        placed = cut(with_rank(self.edges.select("src", "dst"), "src", "dst", name="pos"))
        before = placed.select((F.col("pos") + 1).alias("pos"), F.col("src").alias("s"), F.col("dst").alias("d"))
        both = placed.join(before, "pos", "left").withColumn("first", ~F.coalesce(F.col("s") == F.col("src"), F.lit(False)))
        bits = F.length(F.bin(F.when(F.col("first"), F.abs(F.col("dst") - F.col("src"))).otherwise(F.col("dst") - F.col("d"))))
        size = F.when(F.col("first"), F.when(bits <= 6, 1).otherwise(1 + F.ceil((bits - 6) / 7))).otherwise(F.greatest(F.lit(1), F.ceil(bits / 7)))
        return both.select("src", "dst", size.cast("long").alias("bytes"))

    def storage_stats(self) -> DataFrame:
        """vertices, edges, and bytes of three layouts: uncompressed (48 a vertex, 32 an edge), plain lists (56 a vertex, 4 an
        edge) and delta (56 a vertex, byte code of the gaps in each list)."""
        sizes = self.code_sizes().agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("code"))
        n = F.col("n")
        return self.count_vertices().join(F.broadcast(sizes)).select(
            n.alias("vertices"), "edges", (n * 48 + F.col("edges") * 32).alias("uncompressed_bytes"), (n * 56 + F.col("edges") * 4).alias("plain_bytes"), F.col("code").alias("delta_bytes"), (n * 56 + F.col("code")).alias("delta_total_bytes")
        )

    def size_in_bytes(self) -> int:
        """Bytes of the delta layout; raises if the graph is not sound (ends out of range, or a repeated edge)."""
        if self.check_edges().first()["bad"] or not self.iter_edges().where("not ok").isEmpty():
            raise ValueError("the graph is not sound")
        return self.storage_stats().first()["delta_total_bytes"]


def sort_updates(batch: DataFrame) -> DataFrame:
    """(src, dst) dealt to ranges and sorted in each, so that the parts in order are the sorted batch; Spark's sort is a radix sort on key prefixes."""
    return batch.select("src", "dst").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
