"""Graph algorithms as rounds of edge_map, one checkpointed job a round.

Everything that races decide elsewhere is a minimum here, so results are the
same on every run and for every partitioning.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.functions.cuts import cut, drop, scanned, stored, with_rank
from snapgraph.functions.hashing import priority
from snapgraph.operators.traverse import EdgeProgram, edge_map, neighbours_of
from snapgraph.plans.graph import Graph


def bfs(g: Graph, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(query, id, parent, level) for sources (query, id); the parent is the smallest id one level nearer.

    All sources run at once: a round is one job however many there are.
    """
    seen = frontier = cut(sources.select("query", F.col("id").cast("long"), F.col("id").cast("long").alias("parent"), F.lit(0).alias("level")))
    level, size = 0, frontier.count()
    while size and (depth is None or level < depth):
        level += 1
        step = EdgeProgram(message={"parent": F.col("src")}, combine={"parent": F.min("parent")})
        reached = edge_map(g, frontier.select("query", "id"), step, skip=seen, size=size, by=("query",))
        frontier = cut(reached.select("query", "id", "parent", F.lit(level).alias("level")))
        size = frontier.count()
        if size:
            seen = seen.unionByName(frontier)
    return seen


def source_table(g: Graph, *ids: int) -> DataFrame:
    spark = g.edges.sparkSession
    wanted = spark.createDataFrame([(k, v) for k, v in enumerate(ids)], "query long, id long")
    return wanted.join(g.vertices, "id", "left_semi").select("query", "id")


def bfs_from(g: Graph, source: int) -> DataFrame:
    return bfs(g, source_table(g, source)).select("id", "parent", "level")


def betweenness(g: Graph, source: int, include_unreachable: bool = False) -> DataFrame:
    """(id, score): the source's dependency on each vertex it reaches; the source's own is the sum over its successors."""
    levels = [cut(source_table(g, source).select("id", F.lit(1.0).alias("sigma")))]
    seen = levels[0].select("id")
    sizes = [levels[0].count()]
    while True:
        step = EdgeProgram(message={"sigma": F.col("sigma")}, combine={"sigma": F.sum("sigma")})
        reached = cut(edge_map(g, levels[-1], step, skip=seen, size=sizes[-1]))
        size = reached.count()
        if not size:
            break
        levels.append(reached)
        sizes.append(size)
        seen = seen.unionByName(reached.select("id"))
    below = cut(levels[-1].withColumn("score", F.lit(0.0)))
    done = [below]
    for k, level in reversed(list(enumerate(levels[:-1]))):
        share = (1.0 + F.col("score")) / F.col("sigma")
        pulled = edge_map(g, below, EdgeProgram(message={"share": share}, combine={"share": F.sum("share")}), only=level, size=sizes[k + 1], mode="pull")
        below = cut(level.join(pulled, "id", "left").select("id", "sigma", F.coalesce(F.col("share") * F.col("sigma"), F.lit(0.0)).alias("score")))
        done.append(below)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.select("id", "score")
    return g.vertices.join(out, "id", "left") if include_unreachable else out


def maximal_independent_set(g: Graph) -> DataFrame:
    """(id): the greedy set in priority order; roots are those with no live neighbour before them."""
    earlier = cut(g.edges.where((priority("dst") < priority("src")) & (F.col("src") != F.col("dst"))))
    live = cut(g.vertices.select("id"))
    chosen = []
    while not live.isEmpty():
        # Between live vertices only: earlier shrinks with them.
        roots = cut(live.join(earlier.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        chosen.append(roots)
        gone = roots.union(neighbours_of(g, roots))
        live = cut(live.join(gone, "id", "left_anti"))
        alive = lambda side: live.select(F.col("id").alias(side))
        earlier = cut(earlier.join(alive("src"), "src", "left_semi").join(alive("dst"), "dst", "left_semi"))
    out = g.vertices.select("id").limit(0)
    for part in chosen:
        out = out.union(part)
    return out


def khop(g: Graph, sources: DataFrame, k: int) -> DataFrame:
    """(query, n): vertices at distance 1..k."""
    reached = bfs(g, sources, depth=k).where("level > 0").groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return sources.select("query").distinct().join(reached, "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("n"))


def two_hop(g: Graph, sources: DataFrame) -> DataFrame:
    """(query, n): the source, its neighbours and theirs, each once."""
    start = sources.select("query", F.col("id").cast("long"))
    one = start.join(g.edges, F.col("id") == F.col("src")).select("query", F.col("dst").alias("id")).distinct()
    two = one.join(g.edges, F.col("id") == F.col("src")).select("query", F.col("dst").alias("id"))
    return start.union(one).union(two).distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n"))


def mutual_neighbours(g: Graph, pairs: DataFrame) -> DataFrame:
    """(a, b, n): common neighbours of the given pairs; 0 where a vertex is absent."""
    left = pairs.select("a", "b").distinct()
    first = left.join(g.edges, F.col("a") == F.col("src")).select("a", "b", "dst")
    both = first.join(g.edges.withColumnRenamed("src", "b"), ["b", "dst"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return left.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def nibble_serial(g: Graph, sources: DataFrame, eps: float = 1e-6, rounds: int = 10) -> DataFrame:
    """(query, id, mass): truncated lazy walk; only mass over degree * eps moves on, the rest is dropped."""
    degrees = cut(g.degrees())
    mass = cut(sources.select("query", F.col("id").cast("long"), F.lit(1.0).alias("mass")))
    for _ in range(rounds):
        active = mass.join(degrees, "id").where(F.col("mass") > F.col("degree") * eps)
        step = EdgeProgram(message={"mass": F.col("mass") / (2 * F.col("degree"))}, combine={"mass": F.sum("mass")})
        spread = edge_map(g, active, step, by=("query",))
        after = active.select("id", "query", (F.col("mass") / 2).alias("mass")).unionByName(spread.select("id", "query", "mass"))
        after = cut(after.groupBy("query", "id").agg(F.sum("mass").alias("mass")))
        if after.isEmpty():
            break
        mass = after
    return mass.select("query", "id", "mass")


def nibble_parallel(g: Graph, sources: DataFrame, eps: float = 1e-9, rounds: int = 10) -> DataFrame:
    """(query, id, mass): as the serial form, but the frontier is who has mass >= degree * eps after a step, and others keep theirs."""
    spark = g.edges.sparkSession
    # As the edges are dealt, so a round meets it without a shuffle; the mass of the round before goes when the next is stored.
    degrees = g.degrees().cache()
    mass, path = stored(sources.join(degrees, "id").select("query", F.col("id").cast("long"), F.lit(1.0).alias("mass"), "degree", F.lit(True).alias("on")))
    for _ in range(rounds):
        active = mass.where("`on`")
        step = EdgeProgram(message={"mass": F.col("mass") / (2 * F.col("degree"))}, combine={"mass": F.sum("mass")})
        spread = edge_map(g, active.select("query", "id", "mass", "degree"), step, by=("query",))
        kept = mass.select("id", "query", F.when(F.col("on"), F.col("mass") / 2).otherwise(F.col("mass")).alias("mass"), F.lit(False).alias("got"))
        both = kept.unionByName(spread.select("id", "query", "mass", F.lit(True).alias("got")))
        after = both.groupBy("query", "id").agg(F.sum("mass").alias("mass"), F.max("got").alias("got")).join(degrees, "id")
        before = path
        mass, path = stored(after.select("query", "id", "mass", "degree", (F.col("mass") >= F.col("degree") * eps).alias("on")))
        drop(spark, before)
        if mass.where("`on`").isEmpty():
            break
    degrees.unpersist()
    return mass.select("query", "id", "mass")


def shifts(n: int, beta: float) -> list[int]:
    """How many centers have started before each round: exclusive sums of floor(exp(i * beta))."""
    out, total = [0], 0
    for i in range(min(n + 1, 2 + math.ceil(math.log(max(n, 1)) / beta))):
        total += math.floor(math.exp(i * beta))
        out.append(min(total, n))
    return out


def low_diameter_decomposition(g: Graph, beta: float = 0.2) -> DataFrame:
    """(id, cluster): unvisited vertices start as centers in priority order, more every round; others take the smallest cluster that reaches them."""
    ranked = cut(with_rank(g.vertices.select("id"), priority("id"), name="rank"))
    n = ranked.count()
    starts = shifts(n, beta)
    seen = frontier = ranked.select("id", F.col("id").alias("cluster")).limit(0)
    done, i = 0, 0
    while done < n:
        low, high = starts[min(i, len(starts) - 1)], starts[i + 1] if i + 1 < len(starts) else n
        centers = ranked.where((F.col("rank") >= low) & (F.col("rank") < high)).select("id", F.col("id").alias("cluster")).join(seen, "id", "left_anti")
        frontier = cut(frontier.unionByName(centers)) if i else cut(centers)
        seen = cut(seen.unionByName(centers)) if i else frontier
        step = EdgeProgram(message={"cluster": F.col("cluster")}, combine={"cluster": F.min("cluster")})
        frontier = cut(edge_map(g, frontier, step, skip=seen))
        seen = cut(seen.unionByName(frontier))
        done = seen.count()
        i += 1
    return seen


def components(g: Graph) -> DataFrame:
    """(id, component): the smallest id of each vertex's component, by minimum labels with a jump every round."""
    labels = cut(g.vertices.select("id", F.col("id").alias("component")))
    while True:
        near = edge_map(g, labels, EdgeProgram(message={"component": F.col("component")}, combine={"near": F.min("component")}))
        lower = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        after = cut(lower.join(jump, "component", "left").select("id", F.coalesce("jump", "component").alias("component"), "was"))
        changed = not after.where("component <> was").isEmpty()
        labels = after.select("id", "component")
        if not changed:
            return labels


#: Claims that one range of items holds.
CLAIMS = 1 << 18


def deterministic_reservations(claims: DataFrame, most: int = CLAIMS) -> DataFrame:
    """(i, round): items i that claim resources (i, resource); an item commits in the first round in which it holds all it claims, lower i first.

    An item's round is one after the latest round of the items before it at its
    resources.  Ranges of items take their turn and hand on each resource's next
    free round, so a long chain costs no job a round.
    """
    own = claims.select("i", "resource").where("i is not null").distinct()
    sizes = scanned(own.groupBy("i").agg(F.count(F.lit(1)).alias("n")), ["i"], {"before": (F.col("n"), "sum")}, inclusive=False)
    left = cut(own.join(sizes.select("i", F.floor(F.col("before") / most).alias("turn")), "i"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    free = claims.sparkSession.createDataFrame([], f"resource {kinds['resource']}, next int")

    def commit(mine: pa.Table, earlier: pa.Table) -> pa.Table:
        after = dict(zip(earlier.column("resource").to_pylist(), earlier.column("next").to_pylist()))
        wants: dict = {}
        for i, resource in zip(mine.column("i").to_pylist(), mine.column("resource").to_pylist()):
            wants.setdefault(i, []).append(resource)
        rounds = {}
        for i in sorted(wants):
            held = [r for r in wants[i] if r is not None]
            rounds[i] = max((after.get(r, 0) for r in held), default=0)
            after.update((r, rounds[i] + 1) for r in held)
        items, resources = list(rounds), list(after)
        return pa.table(
            {
                "i": pa.array(items + [None] * len(resources), mine.schema.field("i").type),
                "round": pa.array([*rounds.values(), *after.values()], pa.int32()),
                "resource": pa.array([None] * len(items) + resources, mine.schema.field("resource").type),
            }
        )

    done = left.select("i", F.lit(0).alias("round")).limit(0)
    for turn in range(1 + (left.agg(F.max("turn")).first()[0] if not left.isEmpty() else -1)):
        mine = left.where(F.col("turn") == turn).select("i", "resource")
        here = mine.select(F.col("resource").alias("_r")).distinct()
        asked = free.join(here, F.col("resource") == F.col("_r"), "left_semi")
        one = F.lit(0).alias("one")
        both = cut(mine.groupBy(one).cogroup(asked.groupBy(one)).applyInArrow(commit, f"i {kinds['i']}, round int, resource {kinds['resource']}"))
        done = done.unionByName(both.where("i is not null").select("i", "round"))
        mark = both.where("i is null").select("resource", F.col("round").alias("next"))
        free = cut(free.join(mark.select(F.col("resource").alias("_r")), F.col("resource") == F.col("_r"), "left_anti").unionByName(mark))
    return done
