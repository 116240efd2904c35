"""Command line: static algorithms, batch updates, concurrent updates and queries, storage statistics."""

from __future__ import annotations

import argparse
import json
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from snapgraph.functions.cuts import shared_folder
from snapgraph.operators import algorithms as A
from snapgraph.plans.store import GraphStore
from snapgraph.sources import io
from snapgraph.streaming import stream


def run_static(spark, args) -> None:
    g = io.load(spark, args.file, args.format, args.parts).cached()
    sources = io.random_sources(g, args.nsrc)
    tests = {
        "BFS": lambda: A.bfs_from(g, args.src).count(),
        "BC": lambda: A.betweenness(g, args.src).count(),
        "MIS": lambda: A.maximal_independent_set(g).count(),
        "KHOP": lambda: A.two_hop(g, sources).count(),
        "NIBBLE": lambda: A.nibble_serial(g, sources, args.eps, args.T).count(),
        "LDD": lambda: A.low_diameter_decomposition(g).count(),
    }
    times = []
    for k in range(args.rounds):
        began = time.perf_counter()
        n = tests[args.test]()
        times.append(time.perf_counter() - began)
        print(f"RESULT test={args.test} round={k} rows={n} time={times[-1]:.3f}")
    print(f"AVERAGE test={args.test} time={sum(times) / len(times):.3f}")


def root_of(spark, args) -> str:
    return args.store or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def trials(size: int) -> int:
    """20 of each size, 3 of very large ones."""
    return 20 if size < 10**8 else 3


def batch_updates(spark, args) -> None:
    """Inserts and deletes batches of growing size; the means are over the trials of a size."""
    g = io.load(spark, args.file, args.format, args.parts)
    store = GraphStore.create(spark, root_of(spark, args), g)
    n = 1 << max(0, (max(g.num_vertices().first()["n"], 1) - 1).bit_length() - 1)
    for size in args.sizes:
        took: dict[str, list[float]] = {"insert": [], "delete": []}
        for trial in range(args.trials or trials(size)):
            batch = io.rmat(spark, n, size, seed=trial, a=0.5, b=0.1, c=0.1).select("src", "dst")
            for name, change in (("insert", store.insert_edges), ("delete", store.delete_edges)):
                began = time.perf_counter()
                change(batch)
                took[name].append(time.perf_counter() - began)
        for name, each in took.items():
            mean = sum(each) / len(each)
            print(f"RESULT {name} size={size} trials={len(each)} time={mean:.3f} edges_per_s={size / mean:.0f}")


def simultaneous(spark, args) -> None:
    g = io.load(spark, args.file, args.format, args.parts)
    root = root_of(spark, args)
    updates = stream.update_stream(g, args.sample)
    updates.repartitionByRange(args.batches, "seq").write.parquet(f"{root}/updates")
    store = GraphStore.create(spark, f"{root}/store", g)
    store.delete_edges(updates.where("op = '+'").select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.src", "e.dst"))
    print(json.dumps(stream.concurrent(spark, store, f"{root}/updates", f"{root}/checkpoint", args.src)))


def storage_stats(spark, args) -> None:
    io.load(spark, args.file, args.format, args.parts).storage_stats().show()


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="snapgraph")
    sub = top.add_subparsers(dest="command", required=True)
    for name, call in (("run-static", run_static), ("batch-updates", batch_updates), ("simultaneous", simultaneous), ("storage-stats", storage_stats)):
        p = sub.add_parser(name)
        p.set_defaults(call=call)
        p.add_argument("file")
        p.add_argument("--format", default="adjacency", choices=["adjacency", "byte", "bytepda"])
        p.add_argument("--parts", type=int, default=8)
        p.add_argument("--src", type=int, default=0)
        p.add_argument("--store")
        if name == "run-static":
            p.add_argument("-t", "--test", default="BFS", choices=["BFS", "BC", "MIS", "KHOP", "NIBBLE", "LDD"])
            p.add_argument("--rounds", type=int, default=4)
            p.add_argument("--nsrc", type=int, default=40)
            p.add_argument("--eps", type=float, default=1e-6)
            p.add_argument("-T", type=int, default=10)
        if name == "batch-updates":
            p.add_argument("--sizes", type=int, nargs="+", default=[*(10**k for k in range(1, 10)), 2 * 10**9])
            p.add_argument("--trials", type=int, default=0)
        if name == "simultaneous":
            p.add_argument("--sample", type=int, default=100_000)
            p.add_argument("--batches", type=int, default=10)
    args = top.parse_args(argv)
    args.call(SparkSession.builder.appName("snapgraph").config("spark.scheduler.mode", "FAIR").getOrCreate(), args)


if __name__ == "__main__":
    main()
