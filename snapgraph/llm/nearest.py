"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A rotation turns a unit vector by three rounds of random signs and a fast
Hadamard transform and names its nearest signed axis.  A table's cell is the
axes of one or more rotations together: as many, and of the last one only so many
axes, that a cell holds about ``CELL`` vectors whatever the number of rows.  All
vectors are indexed under their own cell of each of ``TABLES`` tables; a query
looks into the ``PROBES`` cells of each whose axes are nearest together.
Candidates are ranked by the exact inner product in double precision on the
original vectors.

Rows are bucketed by norm, in bands a factor of ``BAND`` wide.  Inside a band the
smallest angle is nearly the largest inner product, so hashing sees unit vectors
and every band is asked with all probes; a band of at most ``PIECE`` rows is
one cell and is searched whole.  Index rows of one cell are dealt to pieces of about
``PIECE`` vectors and its queries go to every piece, so copies of one vector,
however many, never meet in one task; each piece returns a query's best TOP, which
loses none of the best TOP over all.  Small cells travel together, so that a task
does not open them one by one.  A query that found fewer than TOP, where
more candidates are, is asked of every piece.

Vectors that are null, empty, zero or hold null or non-finite components, or
whose vec_id is null, take no part.  Shorter vectors count as padded with zeros.
Ties go to the smaller vec_id.  A query's own vec_id is never its answer (nor a
repeated row of it); other repeated rows of one vec_id count once.  Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapgraph.llm.common import written

TABLES, PROBES, TOP = 16, 16, 20
#: Vectors that a cell of a table holds on the mean.
CELL = 64
PIECE = 2048
#: Rows of a cell that are scored for many queries at once.
SMALL = 256
BAND = 1.25
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row (length a power of two)."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x


def shape(rows: int, width: int, cell: int = 0) -> tuple[int, ...]:
    """How many axes (positive ones) each rotation of a table tells apart, so that a cell holds about so many of the rows."""
    out, left = [width], rows / (cell or CELL) / (2 * width)
    while left > 1:
        own = min(width, 1 << max(0, math.ceil(math.log2(left)) - 1))
        out.append(own)
        left /= 2 * own
    return tuple(out)


def turned(unit: np.ndarray, table: int, rotation: int) -> np.ndarray:
    """The unit vectors (as wide as a power of two) after one pseudo-random rotation."""
    width = unit.shape[1]
    signs = np.random.Generator(np.random.PCG64([SEED, width, table, rotation])).choice([-1.0, 1.0], size=(3, width))
    for r in range(3):
        unit = hadamard(unit * signs[r]) / np.sqrt(width)
    return unit


def cells_of(unit: np.ndarray, axes: tuple[int, ...], table: int, probes: int) -> np.ndarray:
    """The cells of one table whose signed axes are nearest together, nearest first: array (rows, up to probes)."""
    cells = np.zeros((len(unit), 1), np.int64)
    loss = np.zeros((len(unit), 1))
    for rotation, m in enumerate(axes):
        x = turned(unit, table, rotation)[:, :m]
        both = np.concatenate([x, -x], axis=1)
        keep = min(probes, 2 * m)
        near = np.argpartition(-both, keep - 1, axis=1)[:, :keep] if keep < 2 * m else np.tile(np.arange(2 * m), (len(unit), 1))
        values = np.take_along_axis(both, near, 1)
        away = (both.max(1, keepdims=True) - values) ** 2
        sums = (loss[:, :, None] + away[:, None, :]).reshape(len(unit), -1)
        names = (cells[:, :, None] * (2 * m) + near[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(sums, axis=1, kind="stable")[:, :probes]
        loss, cells = np.take_along_axis(sums, best, 1), np.take_along_axis(names, best, 1)
    return cells


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part, components as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))


def hashed(rows: DataFrame, width: int, tables: int, probes: int, shapes: dict[int, tuple[int, ...]], every_band: bool) -> DataFrame:
    """row, band and cell of rows (row, band, v), one for each table and probe; every_band: in all the bands named, else in the row's own."""
    full = 1 << max(1, int(width - 1).bit_length())

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, own, cells = (part.column(k).to_pylist() for k in range(3))
                x = np.zeros((len(cells), full))
                for line, values in zip(x, cells):
                    line[: len(values)] = values
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for axes in set(shapes.values()):
                    bands = [b for b, s in shapes.items() if s == axes]
                    at = np.arange(len(ids)) if every_band else np.flatnonzero(np.isin(own, bands))
                    for t in range(tables if len(at) else 0):
                        found = cells_of(x[at], axes, t, probes)
                        names = np.array(ids, np.int64)[at]
                        for band in bands if every_band else (None,):
                            of = np.full(len(at), band, np.int32) if every_band else np.array(own, np.int32)[at]
                            each = found.shape[1]
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, each)), pa.array(np.repeat(of, each)), pa.array((found * tables + t).reshape(-1))], names=["row", "band", "cell"])

    return rows.select("row", "band", "v").mapInArrow(run, "row long, band int, cell long")


def best_of(ids: np.ndarray, x: np.ndarray, names: np.ndarray, q: np.ndarray, top: int) -> list[tuple]:
    """(query, id, score) of the top distinct ids of each query among rows in order of ids: exact scores, ties to the smaller id."""
    if len(ids) <= SMALL and (len(ids) < 2 or (ids[1:] != ids[:-1]).all()):
        scores = (q[:, None, :] * x[None, :, :]).sum(2)
        ranked = np.argsort(-scores, axis=1, kind="stable")[:, : top + 1]
        pairs = np.repeat(names, ranked.shape[1]), ids[ranked].reshape(-1), np.take_along_axis(scores, ranked, 1).reshape(-1)
        other = pairs[0] != pairs[1]
        return [tuple(c[other] for c in pairs)]
    firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    out = []
    for name, own, rough in zip(names.tolist(), q, q @ x.T):
        allowed = ids != name
        rough = np.where(allowed, rough, -np.inf)
        near = np.flatnonzero(allowed)
        if len(firsts) > top:
            edge = np.partition(np.maximum.reduceat(rough, firsts), len(firsts) - top)[len(firsts) - top]
            near = np.flatnonzero((rough >= edge - 1e-9 * (1 + abs(edge))) & allowed)
        scores = (x[near] * own).sum(1)
        order = np.lexsort((ids[near], -scores))
        order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:top]
        out.append((np.full(len(order), name), ids[near][order], scores[order]))
    return out


def neighbours(vectors: DataFrame, is_query: Column, top: int = TOP, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row for which is_query (on vec_id) holds."""
    rows, _ = written(usable(vectors).dropDuplicates(["vec_id", "v"]).withColumn("row", F.monotonically_increasing_id()), "vectors")
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    norm = F.log(F.col("most")) + F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + x / F.col("most") * (x / F.col("most")))) / 2
    rows, _ = written(rows.withColumn("most", most).withColumn("band", F.round(norm / math.log(BAND)).cast("int")).drop("most"), "banded")
    width = int(rows.agg(F.max(F.size("v"))).first()[0] or 1)
    bands = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()
    shapes = {r.band: shape(r.n, 1 << max(1, int(width - 1).bit_length())) for r in bands if r.n > PIECE}
    small = [r.band for r in bands if r.n <= PIECE]
    # The one cell of a small band is -1.
    spread = hashed(rows.where(F.col("band").isin(list(shapes))), width, tables, 1, shapes, False)
    base, _ = written(spread.unionByName(rows.where(F.col("band").isin(small)).select("row", "band", F.lit(-1).cast("long").alias("cell"))), "cells")
    # Cells are opened in chunks of about PIECE vectors; a cell larger than that is dealt to pieces.
    sizes = {r.band: r.n for r in bands}
    chunks = F.element_at(F.create_map(*(F.lit(v) for b, n in sizes.items() for v in (b, max(1, n * (tables if b in shapes else 1) // PIECE)))), F.col("band")) if sizes else F.lit(1)
    loads = base.groupBy("band", "cell").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    loads, _ = written(loads.withColumn("chunk", F.pmod(F.xxhash64("cell"), chunks)), "loads")
    queries, _ = written(rows.where(is_query).dropDuplicates(["vec_id"]), "queries")
    asked = hashed(queries, width, tables, probes, shapes, True)
    if small:
        asked = asked.unionByName(queries.select("row", F.explode(F.array(*(F.lit(b) for b in small))).alias("band"), F.lit(-1).cast("long").alias("cell")))
    key = ["band", "chunk", "piece"]
    # Chunks under a name of their own: both sides of the cogroup take them from one table.
    held = base.join(loads, ["band", "cell"]).select("row", "band", (F.col("chunk") + 0).alias("chunk"), "cell", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece"))
    held = held.join(rows.drop("band"), "row").select("vec_id", *key, "cell", "v")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        x = np.zeros((len(column), width))
        for line, own in zip(x, column.to_pylist()):
            line[: len(own)] = own
        return x

    def runs(cells: np.ndarray) -> dict[int, slice]:
        """Where each cell's rows stand, in order of cells."""
        at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])).tolist() if len(cells) else []
        return {int(cells[a]): slice(a, b) for a, b in zip(at, [*at[1:], len(cells)])}

    def search(key, queries: pa.Table, items: pa.Table) -> pa.Table:
        found: list[tuple] = []
        items, queries = items.sort_by([("cell", "ascending"), ("vec_id", "ascending")]), queries.sort_by("cell")
        ids, x = items.column("vec_id").to_numpy(), matrix(items.column("v"))
        names, q = queries.column("query_id").to_numpy(), matrix(queries.column("q"))
        there = runs(items.column("cell").to_numpy())
        for cell, own in runs(queries.column("cell").to_numpy()).items():
            if cell in there:
                at = there[cell]
                for low in range(own.start, own.stop, 256):
                    part = slice(low, min(low + 256, own.stop))
                    found += best_of(ids[at], x[at], names[part], q[part], top)
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0)] * 3
        return pa.Table.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, (np.int64, np.int64, np.float64))], names=["query_id", "vec_id", "score"])

    def answers(asked: DataFrame) -> DataFrame:
        asks = asked.select("row", "band", "chunk", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        asks = asks.join(queries.select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "row").select("query_id", *key, "cell", "q")
        found = asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
        each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    first, _ = written(answers(asked.join(loads, ["band", "cell"])), "answers")
    candidates = rows.select("vec_id").distinct().count() - 1
    counts = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short, _ = written(queries.select("row", F.col("vec_id").alias("query_id")).join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < min(top, candidates)).select("row", "query_id"), "short")
    if short.isEmpty():
        return first
    # Table 0 and the small bands hold every row once.
    once = loads.where((F.col("cell") == -1) | (F.pmod("cell", F.lit(tables)) == 0))
    return first.join(short, "query_id", "left_anti").unionByName(answers(short.select("row").crossJoin(F.broadcast(once))))
