import math
import random

import pytest
from pyspark.sql import functions as F

from snapgraph.operators import algorithms as A
from snapgraph.operators import nbrs as N
from snapgraph.operators import traverse as T
from snapgraph.plans.graph import Graph, sort_updates
from snapgraph.sources import codec


def make(spark, pairs, vertices=()):
    extra = spark.createDataFrame([(v,) for v in vertices], "id long") if vertices else None
    return Graph.from_pairs(spark.createDataFrame(pairs, "a long, b long"), extra)


def rows(df):
    return sorted(map(tuple, df.collect()))


PATH = [(0, 1), (1, 2), (2, 3), (3, 4)]
CYCLE = [(k, (k + 1) % 6) for k in range(6)]


def test_empty(spark):
    g = Graph.empty(spark)
    assert g.num_vertices().first()[0] == 0
    assert g.num_edges().first()[0] == 0
    assert A.maximal_independent_set(g).count() == 0
    assert A.bfs_from(g, 0).count() == 0


def test_sizes_with_gaps_and_isolated_vertices(spark):
    g = make(spark, [(0, 1), (5, 6), (1, 1), (0, 1)], [9])
    assert g.num_vertices().first()[0] == 10
    assert g.count_vertices().first()[0] == 5
    assert g.num_edges().first()[0] == 4
    assert rows(g.degrees()) == [(0, 1), (1, 1), (5, 1), (6, 1), (9, 0)]
    assert g.check_edges().first()[0] == 0
    assert rows(g.retrieve_edges()) == [(0, 0, 1), (1, 1, 0), (2, 5, 6), (3, 6, 5)]


def test_updates(spark):
    g = make(spark, PATH)
    batch = spark.createDataFrame([(7, 0), (0, 7), (0, 1)], "src long, dst long")
    assert g.insert_edges(batch).edges.count() == 10
    assert g.delete_edges(batch).edges.count() == 7
    assert g.delete_edges(spark.createDataFrame([(50, 51)], "src long, dst long")).vertices.count() == 5
    with pytest.raises(ValueError):
        g.append_slab(make(spark, [(4, 8)]))


def test_bfs_levels_and_least_parent(spark):
    assert rows(A.bfs_from(make(spark, PATH), 0)) == [(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)]
    got = dict((r[0], r[1:]) for r in rows(A.bfs_from(make(spark, CYCLE), 0)))
    assert got[3] == (2, 3)
    assert rows(A.bfs_from(make(spark, [(0, 1), (5, 6)]), 0)) == [(0, 0, 0), (1, 0, 1)]


def test_betweenness_of_a_path(spark):
    got = dict(rows(A.betweenness(make(spark, PATH), 0)))
    assert got == {0: 4.0, 1: 3.0, 2: 2.0, 3: 1.0, 4: 0.0}


def test_mis_is_independent_and_maximal(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(90)]
    g = make(spark, pairs)
    chosen = {r[0] for r in A.maximal_independent_set(g).collect()}
    edges = {(a, b) for a, b in pairs if a != b}
    assert not any(a in chosen and b in chosen for a, b in edges)
    for v in {x for e in edges for x in e} - chosen:
        assert any((v in e) and (set(e) - {v}) & chosen for e in edges)


def test_hops_and_mutual(spark):
    star = make(spark, [(0, k) for k in range(1, 6)])
    sources = spark.createDataFrame([(0, 1), (1, 0)], "query long, id long")
    assert dict(rows(A.two_hop(star, sources))) == {0: 6, 1: 6}
    assert dict(rows(A.khop(star, sources, 1))) == {0: 1, 1: 5}
    clique = make(spark, [(a, b) for a in range(5) for b in range(a)])
    assert rows(A.mutual_neighbours(clique, spark.createDataFrame([(0, 1), (0, 77)], "a long, b long"))) == [(0, 1, 3), (0, 77, 0)]


def test_nibble_keeps_mass_until_it_is_cut(spark):
    g = make(spark, CYCLE)
    sources = spark.createDataFrame([(0, 0)], "query long, id long")
    for walk in (A.nibble_serial, A.nibble_parallel):
        mass = {r[1]: r[2] for r in walk(g, sources, 1e-9, 3).collect()}
        assert math.isclose(sum(mass.values()), 1.0)
        assert math.isclose(mass[1], mass[5])


def test_ldd_covers_everything(spark):
    g = make(spark, CYCLE + [(20, 21)])
    got = dict(rows(A.low_diameter_decomposition(g, 0.3)))
    assert set(got) == {0, 1, 2, 3, 4, 5, 20, 21}
    assert all(got[c] == c for c in got.values())


def test_components_and_reservations(spark):
    g = make(spark, PATH + [(9, 10), (10, 12)], [30])
    assert dict(rows(A.components(g))) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9, 10: 9, 12: 9, 30: 30}
    claims = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 2), (3, 9)], "i long, resource long")
    assert dict(rows(A.deterministic_reservations(claims))) == {0: 0, 1: 1, 2: 2, 3: 0}


def test_edge_map_forms_agree(spark):
    g = make(spark, CYCLE)
    u = g.vertices.where("id in (0, 1)")
    push = rows(T.edge_map(g, u, size=2))
    assert push == rows(T.edge_map(g, u, only=g.vertices)) == rows(T.edge_map(g, u))
    assert T.edge_map(g, u, no_output=True).count() == 0


def test_push_and_pull_agree_on_random_graphs(spark):
    rng = random.Random(14)
    g = make(spark, [(rng.randrange(30), rng.randrange(30)) for _ in range(80)]).cached()
    one_way = Graph.from_edges(spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(80)], "src long, dst long"))
    program = T.EdgeProgram(message={"m": F.col("src")}, combine={"least": F.min("m"), "n": F.count("m")})
    for graph in (g, one_way):
        u = T.subset_where(graph, F.col("id") % 3 == 1)
        forms = [rows(T.edge_map(graph, u, program, skip=u, mode=mode)) for mode in ("push", "pull", "auto")]
        assert forms[0] == forms[1] == forms[2] and forms[0]
    assert T.is_dense(g, g.vertices) and not T.is_dense(g, T.empty_subset(g))
    with pytest.raises(ValueError):
        T.edge_map(g, g.vertices, mode="sideways")
    g.release()


def test_vertex_subsets(spark):
    g = make(spark, PATH)
    assert T.size_of(T.subset_where(g, F.col("id") > 2)).first()[0] == 2 and T.is_empty(T.empty_subset(g))
    assert rows(T.is_in(T.singleton(g, 3), g.vertices)) == [(k, k == 3) for k in range(5)]


def test_sizes_of_lists_equal_the_code(spark):
    rng = random.Random(15)
    g = make(spark, [(rng.randrange(5000), rng.randrange(5000)) for _ in range(300)])
    want = {r["id"]: len(codec.encode(r["id"], list(r["nbrs"]))) for r in g.adjacency().collect()}
    got = {}
    for src, _, size in g.code_sizes().collect():
        got[src] = got.get(src, 0) + size
    assert got == want
    stats = g.storage_stats().first()
    assert stats["delta_bytes"] == sum(want.values()) and g.size_in_bytes() == stats["delta_total_bytes"] == 56 * len(want) + sum(want.values())
    with pytest.raises(ValueError):
        Graph(g.vertices, g.edges.union(g.edges.limit(1))).size_in_bytes()
    assert rows(N.folded(make(spark, PATH).edges, F.col("dst") + 1)) == [(0, 1, 2), (1, 0, 1), (1, 2, 4), (2, 1, 2), (2, 3, 6), (3, 2, 3), (3, 4, 8), (4, 3, 4)]


def test_sorted_batches(spark):
    rng = random.Random(16)
    batch = [(rng.randrange(9), rng.randrange(9)) for _ in range(60)]
    got = sort_updates(spark.createDataFrame(batch, "src long, dst long")).collect()
    assert list(map(tuple, got)) == sorted(batch)


def test_cached_graph_shuffles_its_edges_once(spark):
    """Repeats meet where their source is dealt to; the vertices come from the cached edges."""
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (4, 1)], "a long, b long")
    g = Graph.from_pairs(pairs).cached()
    plan = g.edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan
    assert sorted(map(tuple, g.edges.collect())) == [(1, 2), (1, 4), (2, 1), (4, 1)]
    assert sorted(r[0] for r in g.vertices.collect()) == [1, 2, 4]
    g.release()
