"""Structured Streaming: updates go to a store in batches while readers query pinned versions."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.functions.hashing import ith_rand
from snapgraph.operators.algorithms import bfs_from
from snapgraph.operators.sequences import window_average
from snapgraph.plans.graph import Graph
from snapgraph.plans.store import GraphStore

UPDATES = "seq long, op string, src long, dst long"


def apply_batch(store: GraphStore, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch as at most two commits: of each undirected edge the last change by seq counts, deletions first.

    Runs with the same batch_id change nothing, so a restarted stream applies every batch once.
    """
    edge = F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")
    last = batch.groupBy(*edge).agg(F.max_by("op", "seq").alias("op")).persist()
    try:
        both = last.select("op", F.explode(F.array(F.struct(F.col("low").alias("src"), F.col("high").alias("dst")), F.struct(F.col("high").alias("src"), F.col("low").alias("dst")))).alias("e")).select("op", "e.src", "e.dst")
        store.delete_edges(both.where("op = '-'"), batch_id=2 * batch_id)
        store.insert_edges(both.where("op = '+'"), batch_id=2 * batch_id + 1)
    finally:
        last.unpersist()


def ingest(spark: SparkSession, store: GraphStore, folder: str, checkpoint: str, files_per_batch: int = 1):
    """A running query that applies Parquet files of UPDATES in the order they arrive."""
    source = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return source.writeStream.foreachBatch(lambda df, i: apply_batch(store, df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def update_stream(g: Graph, sample: int, delete_share: int = 10, seed: int = 0) -> DataFrame:
    """UPDATES sampled from a graph by hash: a tenth deletions, the rest insertions, in a shuffled order."""
    total = g.edges.where("src < dst").count()
    keep = min(1.0, sample / max(total, 1))
    one = ith_rand(F.col("src") * 31 + F.col("dst"), seed)
    two = ith_rand(F.col("src") * 17 + F.col("dst"), seed + 1)
    picked = g.edges.where("src < dst").where(one < keep * 4294967296.0)
    return picked.select(two.alias("seq"), F.when(F.pmod(two, F.lit(100)) < delete_share, "-").otherwise("+").alias("op"), "src", "dst")


def concurrent(spark: SparkSession, store: GraphStore, folder: str, checkpoint: str, source: int, queries: int = 2) -> dict:
    """Applies the updates of a folder while BFS runs on pinned versions; times of both, by what was really applied."""
    times: list[float] = []
    stop = threading.Event()

    def read() -> None:
        while not stop.is_set() and len(times) < queries:
            began = time.perf_counter()
            with store.acquire() as graph:
                bfs_from(graph, source).count()
            times.append(time.perf_counter() - began)

    reader = threading.Thread(target=read)
    began = time.perf_counter()
    reader.start()
    query = ingest(spark, store, folder, checkpoint)
    query.awaitTermination()
    took = time.perf_counter() - began
    applied = sum(p["numInputRows"] for p in query.recentProgress)
    reader.join()
    stop.set()
    return {"applied": applied, "updates_per_s": applied / took, "latency_s": took / max(applied, 1), "query_s": sum(times) / max(len(times), 1), "queries": len(times)}


def write_datapoints(samples: DataFrame, path: str, points: int) -> None:
    """(time, value) as CSV of (time, latency): a true mean of each of so many windows."""
    window_average(samples, points).orderBy("time").write.csv(path, header=True)
