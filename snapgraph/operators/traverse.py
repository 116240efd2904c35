"""Frontiers and edge_map: { d : (s, d) in E, s in U, cond(d), update(s, d) } as a join and an aggregation.

An ``EdgeProgram`` says what an edge sends (``message``, over the columns of the
source's state and src, dst), how the messages of one target combine, and which
targets may receive (``skip``: ids that may not).  Where the reference lets a
race decide, the combination does.

A round runs in one of two forms.  Push: the frontier meets its out-edges where
they lie, messages are combined there and go to their targets.  Pull, for large
frontiers of a symmetric graph: targets that may still receive meet their own
edges where they lie and look the frontier up, so no message moves at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgraph.plans.graph import Graph

#: A frontier of up to so many ids (8 bytes each) is broadcast to the edges; a larger one is joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A frontier with more than this share of all edges (its ids counted too) is pulled from: a fixed value.
DENSE_SHARE = 20


@dataclass(frozen=True)
class EdgeProgram:
    message: dict[str, Column] = field(default_factory=dict)
    combine: dict[str, Column] = field(default_factory=dict)
    edge_condition: Column | None = None


def is_dense(g: Graph, frontier: DataFrame, size: int | None = None) -> bool:
    """Whether the frontier's ids and out-edges together are over a twentieth of all edges."""
    m = g.edges.count()
    if size is not None and size > m / DENSE_SHARE:
        return True
    out = g.edges.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi").count()
    return out + (frontier.count() if size is None else size) > m / DENSE_SHARE


def edge_map(
    g: Graph,
    frontier: DataFrame,
    program: EdgeProgram | None = None,
    skip: DataFrame | None = None,
    only: DataFrame | None = None,
    size: int | None = None,
    by: tuple[str, ...] = (),
    no_output: bool = False,
    mode: str = "push",
) -> DataFrame:
    """The targets of the frontier's edges: id, the ``by`` columns, and the combined messages.

    frontier: id, by columns and state.  skip: (id, by) that may not receive.
    only: (id) that may.  size: rows of the frontier if known, which decides
    whether it is broadcast.  mode: push, pull, or auto (pull if the frontier is
    dense); the rows are the same.
    """
    program = program or EdgeProgram()
    if mode not in ("push", "pull", "auto"):
        raise ValueError(mode)
    pull = mode == "pull" or mode == "auto" and is_dense(g, frontier, size)
    # In a symmetric graph the edges at a target are its own, turned round.
    edges = g.edges.select(F.col("src").alias("dst"), F.col("dst").alias("src")) if pull and g.symmetric else g.edges
    if only is not None:
        edges = edges.join(only.select(F.col("id").alias("dst")), "dst", "left_semi")
    if pull and skip is not None and not by:
        edges = edges.join(skip.select(F.col("id").alias("dst")), "dst", "left_anti")
    senders = frontier.withColumnRenamed("id", "src")
    if size is not None and size <= BROADCAST_IDS:
        senders = F.broadcast(senders)
    sent = edges.join(senders, "src")
    if program.edge_condition is not None:
        sent = sent.where(program.edge_condition)
    sent = sent.select(F.col("dst").alias("id"), *by, *(c.alias(n) for n, c in program.message.items()))
    got = sent.groupBy("id", *by).agg(*(c.alias(n) for n, c in program.combine.items())) if program.combine else sent.select("id", *by).distinct()
    if skip is not None and (by or not pull):
        got = got.join(skip.select("id", *by), ["id", *by], "left_anti")
    return got.limit(0) if no_output else got


# -- vertex subsets: DataFrames with a column id and any state


def singleton(g: Graph, v: int) -> DataFrame:
    return g.edges.sparkSession.createDataFrame([(v,)], "id long")


def empty_subset(g: Graph) -> DataFrame:
    return g.vertices.select("id").limit(0)


def subset_where(g: Graph, condition: Column) -> DataFrame:
    """The dense form: the vertices for which the condition (on id) holds."""
    return g.vertices.select("id").where(condition)


def size_of(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count(F.lit(1)).alias("n"))


def is_empty(frontier: DataFrame) -> bool:
    return frontier.isEmpty()


def is_in(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found) for the asked ids."""
    here = frontier.select("id").distinct().withColumn("found", F.lit(True))
    return ids.select("id").distinct().join(here, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))


def vertex_map(frontier: DataFrame, **columns: Column) -> DataFrame:
    return frontier.select("id", *(c.alias(n) for n, c in columns.items()))


def vertex_filter(frontier: DataFrame, condition: Column) -> DataFrame:
    return frontier.where(condition)


def map_reduce(frontier: DataFrame, value: Column, fold: Callable) -> DataFrame:
    return frontier.agg(fold(value).alias("value"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two frontiers that share nothing."""
    return a.select("id").unionByName(b.select("id"))


def neighbours_of(g: Graph, frontier: DataFrame, condition: Column | None = None) -> DataFrame:
    """{ u in N(frontier) : condition(u) }, each once; the condition is on id and filters the edges, not the result."""
    edges = g.edges if condition is None else g.edges.withColumn("id", F.col("dst")).where(condition).drop("id")
    return edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
