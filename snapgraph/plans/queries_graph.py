"""Registered queries: graph, traversal, neighbour sets, algorithms, store, generator.  Each entry is (query, SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from snapgraph.functions.cuts import cut, shared_folder
from snapgraph.functions.hashing import fork, ith_rand, mix32, mix64, priority
from snapgraph.operators import algorithms as A
from snapgraph.operators import nbrs as N
from snapgraph.operators import traverse as T
from snapgraph.plans.graph import Graph, sort_updates
from snapgraph.plans.store import GraphStore
from snapgraph.sources import fixtures as X
from snapgraph.sources import io

PS, CO, COPS = (X.sql_edges(n) for n in ("ps", "co", "cops"))
PRIO = "({} * 2654435761) % 4294967296"
HUGE = 1 << 40


def _batch(spark, d):
    """Pairs of part and customer ids that are mostly new edges, both directions."""
    o = X.table(spark, d, "orders").where("o_orderkey % 7 = 3").select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") % 100 * 2 + 1).alias("b")).distinct()
    return o.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(o.select("b", "a")).distinct()


BATCH = "bt AS MATERIALIZED (SELECT DISTINCT o_custkey*2 a, o_orderkey % 100 * 2 + 1 b FROM orders WHERE o_orderkey % 7 = 3), bb AS MATERIALIZED (SELECT a AS src, b AS dst FROM bt UNION SELECT b, a FROM bt)"


def _returned(spark, d):
    p = X.table(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(p.select("b", "a"))


RETURNED = "rt AS MATERIALIZED (SELECT DISTINCT l_partkey*2 a, l_suppkey*2+1 b FROM lineitem WHERE l_returnflag='R'), rr AS MATERIALIZED (SELECT a AS src, b AS dst FROM rt UNION SELECT b, a FROM rt)"


def _frontier(g: Graph):
    return g.vertices.where("id % 10 = 1")


def _sources(spark, *ids):
    return spark.createDataFrame([(k, v) for k, v in enumerate(ids)], "query long, id long")


SRC4 = "s(query, id) AS (VALUES (0::BIGINT, 0::BIGINT), (1, 2), (2, 7), (3, 20))"


def q_bfs(name, source=0):
    sql = f"""WITH RECURSIVE {X.sql_edges(name)}, b(id, level) AS (SELECT {source}::BIGINT, 0 UNION SELECT e.dst, b.level+1 FROM b JOIN e ON e.src=b.id WHERE b.level < 40),
l AS MATERIALIZED (SELECT id, MIN(level) AS level FROM b GROUP BY id),
p AS (SELECT e.dst AS id, min(e.src) AS parent FROM e JOIN l a ON a.id=e.src JOIN l c ON c.id=e.dst WHERE a.level=c.level-1 GROUP BY e.dst)
SELECT l.id, coalesce(p.parent, l.id) AS parent, l.level FROM l LEFT JOIN p USING (id)"""
    return (lambda s, d: A.bfs_from(X.graph(s, d, name).cached(), source)), sql


def sql_bc(name, source, rounds):
    steps = [X.sql_edges(name), f"l0 AS MATERIALIZED (SELECT {source}::BIGINT AS id, 1.0::DOUBLE AS sg)"]
    for i in range(1, rounds + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(i))
        steps.append(f"l{i} AS MATERIALIZED (SELECT dst AS id, sum(sg) AS sg FROM e JOIN l{i - 1} x ON e.src=x.id ANTI JOIN ({seen}) y ON y.id=e.dst GROUP BY dst)")
    steps.append(f"d{rounds} AS MATERIALIZED (SELECT id, sg, 0.0::DOUBLE AS dl FROM l{rounds})")
    for i in range(rounds - 1, -1, -1):
        steps.append(f"p{i} AS MATERIALIZED (SELECT e.src AS id, sum((1+n.dl)/n.sg) AS sh FROM e JOIN d{i + 1} n ON e.dst=n.id GROUP BY e.src)")
        steps.append(f"d{i} AS MATERIALIZED (SELECT l.id, l.sg, coalesce(l.sg*p.sh, 0.0) AS dl FROM l{i} l LEFT JOIN p{i} p USING (id))")
    every = " UNION ALL ".join(f"SELECT id, dl FROM d{i}" for i in range(rounds + 1))
    return f"WITH {', '.join(steps)} SELECT id, round(dl, 4) AS score FROM ({every})"


def sql_mis(name, rounds):
    steps = [X.sql_edges(name), f"x AS MATERIALIZED (SELECT src, dst FROM e WHERE {PRIO.format('dst')} < {PRIO.format('src')})", "l0 AS MATERIALIZED (SELECT id FROM v)"]
    for i in range(rounds):
        steps += [
            f"r{i} AS MATERIALIZED (SELECT l.id FROM l{i} l ANTI JOIN (SELECT x.src FROM x SEMI JOIN l{i} y ON y.id=x.dst) z ON z.src=l.id)",
            f"k{i} AS MATERIALIZED (SELECT id FROM r{i} UNION SELECT dst FROM e SEMI JOIN r{i} r ON r.id=e.src)",
            f"l{i + 1} AS MATERIALIZED (SELECT l.id FROM l{i} l ANTI JOIN k{i} k ON k.id=l.id)",
        ]
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT id FROM r{i}" for i in range(rounds))


def sql_nibble(name, rounds, eps, parallel):
    steps = [X.sql_edges(name), "dg AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM e GROUP BY src)", SRC4]
    steps.append("q0 AS MATERIALIZED (SELECT query, id, 1.0::DOUBLE AS q, true AS act FROM s JOIN dg USING (id))")
    for i in range(rounds):
        if parallel:
            steps.append(f"a{i} AS MATERIALIZED (SELECT query, id, q, d FROM q{i} JOIN dg USING (id) WHERE act)")
            steps.append(f"m{i} AS MATERIALIZED (SELECT query, id, sum(q) AS q FROM (SELECT query, id, CASE WHEN act THEN q/2 ELSE q END AS q FROM q{i} UNION ALL SELECT a.query, e.dst, a.q/(2*a.d) FROM a{i} a JOIN e ON e.src=a.id) GROUP BY query, id)")
            steps.append(f"q{i + 1} AS MATERIALIZED (SELECT m.query, m.id, m.q, m.q >= dg.d*{eps} AS act FROM m{i} m JOIN dg USING (id))")
        else:
            steps.append(f"a{i} AS MATERIALIZED (SELECT query, id, q, d FROM q{i} JOIN dg USING (id) WHERE q > d*{eps})")
            steps.append(f"q{i + 1} AS MATERIALIZED (SELECT query, id, sum(q) AS q FROM (SELECT query, id, q/2 AS q FROM a{i} UNION ALL SELECT a.query, e.dst, a.q/(2*a.d) FROM a{i} a JOIN e ON e.src=a.id) GROUP BY query, id)")
    return f"WITH {', '.join(steps)} SELECT query, id, round(q, 9) AS mass FROM q{rounds}"


def sql_components(name, rounds):
    steps = [X.sql_edges(name), "c0 AS MATERIALIZED (SELECT id, id AS c FROM v)"]
    for i in range(rounds):
        steps.append(f"n{i} AS MATERIALIZED (SELECT c.id, least(c.c, min(o.c)) AS c FROM c{i} c JOIN e ON e.src=c.id JOIN c{i} o ON o.id=e.dst GROUP BY c.id, c.c)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT n.id, least(n.c, j.c) AS c FROM n{i} n JOIN n{i} j ON j.id=n.c)")
    return f"WITH {', '.join(steps)} SELECT id, c AS component FROM c{rounds}"


def q_ldd(s, d):
    return A.low_diameter_decomposition(X.graph(s, d, "ps").cached(), 0.2)


def sql_ldd(name, beta, rounds):
    """Rounds unrolled for the most centers that any fixture has; starts follow floor(exp(i * beta))."""
    sums, total = [0], 0
    import math

    for i in range(rounds):
        total += math.floor(math.exp(i * beta))
        sums.append(total)
    steps = [X.sql_edges(name), f"rk AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY {PRIO.format('id')}) - 1 AS r FROM v)", f"s0 AS MATERIALIZED (SELECT id, id AS cluster FROM rk WHERE r < {sums[1]})", "f0 AS MATERIALIZED (SELECT * FROM s0)"]
    for i in range(rounds - 1):
        steps.append(f"g{i} AS MATERIALIZED (SELECT e.dst AS id, min(f.cluster) AS cluster FROM f{i} f JOIN e ON e.src=f.id ANTI JOIN s{i} t ON t.id=e.dst GROUP BY e.dst)")
        steps.append(f"h{i} AS MATERIALIZED (SELECT * FROM s{i} UNION ALL SELECT * FROM g{i})")
        steps.append(f"c{i} AS MATERIALIZED (SELECT id, id AS cluster FROM rk ANTI JOIN h{i} t ON t.id=rk.id WHERE r >= {sums[i + 1]} AND r < {sums[i + 2]})")
        steps.append(f"f{i + 1} AS MATERIALIZED (SELECT * FROM g{i} UNION ALL SELECT * FROM c{i})")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT * FROM h{i} UNION ALL SELECT * FROM c{i})")
    return f"WITH {', '.join(steps)} SELECT id, cluster FROM s{rounds - 1}"


def _pairs(spark, d):
    return spark.createDataFrame([(1, 3), (3, 5), (1, 9), (0, 2), (2, 4), (11, 13), (1, HUGE)], "a long, b long")


PAIRS = f"pr(a, b) AS (VALUES (1::BIGINT, 3::BIGINT), (3, 5), (1, 9), (0, 2), (2, 4), (11, 13), (1, {HUGE}))"


def _store(spark, d, last=14) -> GraphStore:
    """A store to which the log's batches were committed one by one: seven insertions, seven deletions."""
    store = GraphStore.create(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    log = cut(X.edge_log(spark, d))
    for version in range(1, last + 1):
        batch = log.where(F.col("version") == version).select("src", "dst")
        (store.insert_edges if version <= 7 else store.delete_edges)(batch, small=True)
    return store


def q_vacuum(s, d):
    """Versions that are left while one is pinned, with the edges of each."""
    store = _store(s, d, 9)
    held = store.acquire(3)
    store.vacuum()
    out = None
    for version in store.versions():
        part = store.graph_at(version).edges.agg(F.count(F.lit(1)).alias("m")).select(F.lit(version).cast("long").alias("version"), F.lit(store.readers(version)).cast("long").alias("readers"), "m")
        out = part if out is None else out.union(part)
    out = cut(out)
    held.release()
    return out


def q_adjacency_file(s, d):
    path = f"{shared_folder(s)}/graph-{uuid.uuid4().hex}"
    io.write_adjacency(X.graph(s, d), path)
    return io.read_adjacency(s, path).edges


def q_csr_file(s, d):
    path = f"{shared_folder(s)}/graph-{uuid.uuid4().hex}"
    io.write_adjacency(X.graph(s, d), path)
    return io.read_csr(s, path)[1]


def q_binary_file(fmt):
    def query(s, d):
        path = f"{shared_folder(s)}/graph-{uuid.uuid4().hex}"
        io.write_compressed(X.graph(s, d), path, fmt == "bytepda")
        return io.read_compressed(s, path, fmt, parts=8).edges

    return query


def q_append_slab(s, d):
    g = X.graph(s, d)
    new = [(F.col(c) + HUGE).alias(c) for c in ("src", "dst")]
    return g.append_slab(Graph(g.vertices.select((F.col("id") + HUGE).alias("id")), g.edges.select(*new))).edges


def q_scan(s, d):
    g = X.graph(s, d)
    g.scan()
    return g.num_edges()


def edge_rounds(mode):
    """One edge_map in the form named."""
    return lambda s, d: T.edge_map(g := X.graph(s, d), _frontier(g), T.EdgeProgram(message={"m": F.col("src")}, combine={"least": F.min("m"), "n": F.count(F.lit(1))}), skip=_frontier(g), mode=mode)


EDGE_ROUND = f"WITH {PS} SELECT dst AS id, min(src) AS least, count(*) AS n FROM e WHERE src%10=1 AND NOT dst%10=1 GROUP BY dst"
#: Bytes of each edge's code: the first of a list by its distance to the source, the others by their gap.
CODES = "gp AS (SELECT src, dst, dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS gap FROM e), cs AS MATERIALIZED (SELECT src, dst, (CASE WHEN gap IS NULL THEN (CASE WHEN length(bin(abs(dst-src)))<=6 THEN 1 ELSE 1+ceil((length(bin(abs(dst-src)))-6)/7.0) END) ELSE greatest(1, ceil(length(bin(gap))/7.0)) END)::BIGINT AS bytes FROM gp)"


def sql_rand(i, state):
    """ith_rand in SQL."""
    one = f"((({i}) + {state}) * 2654435761) % 4294967296"
    two = f"(xor({one}, ({one}) >> 15) * 73244475) % 4294967296"
    return f"((xor({two}, ({two}) >> 13) * 41211551) % 4294967296)"


QUERIES = {
    "g1_num_vertices": (lambda s, d: X.graph(s, d).num_vertices(), f"WITH {PS} SELECT max(id)+1 AS n FROM v"),
    "g1_count_vertices": (lambda s, d: X.graph(s, d).count_vertices(), f"WITH {PS} SELECT count(*) AS n FROM v"),
    "g2_num_edges": (lambda s, d: X.graph(s, d, "cops").num_edges(), f"WITH {COPS} SELECT count(*) AS m FROM e"),
    "g4_find_vertex": (lambda s, d: X.graph(s, d).find_vertex(2), f"WITH {PS} SELECT dst FROM e WHERE src=2"),
    "g5_degree": (lambda s, d: X.graph(s, d).degrees(), f"WITH {PS} SELECT src AS id, count(*) AS degree FROM e GROUP BY src"),
    "g5_map_vertices": (lambda s, d: X.graph(s, d).map_vertices(twice=F.col("id") * 2), f'WITH {PS} SELECT id, row_number() OVER (ORDER BY id)-1 AS "index", id*2 AS twice FROM v'),
    "g7_map_reduce": (lambda s, d: X.graph(s, d).map_reduce(F.col("degree"), F.max), f"WITH {PS} SELECT max(c) AS value FROM (SELECT count(*) c FROM e GROUP BY src)"),
    "g8_filter": (lambda s, d: X.graph(s, d).filter(F.col("degree") > 50).edges, f"WITH {PS} SELECT src, dst FROM e SEMI JOIN (SELECT src AS k FROM e GROUP BY src HAVING count(*) > 50) x ON x.k=e.src"),
    "g9_map_all_edges": (lambda s, d: X.graph(s, d).map_all_edges(gap=F.abs(F.col("src") - F.col("dst"))), f"WITH {PS} SELECT src, dst, abs(src-dst) AS gap FROM e"),
    "g12_check_edges": (lambda s, d: X.graph(s, d).check_edges(), f"WITH {PS} SELECT count(*) FILTER (WHERE dst >= (SELECT max(id)+1 FROM v) OR dst < 0) AS bad FROM e"),
    "g13_retrieve_edges": (lambda s, d: X.graph(s, d).retrieve_edges(), f"WITH {PS} SELECT row_number() OVER (ORDER BY src, dst)-1 AS pos, src, dst FROM e"),
    "g14_insert_batch": (lambda s, d: X.graph(s, d).insert_edges(_batch(s, d)).edges, f"WITH {PS}, {BATCH} SELECT src, dst FROM e UNION SELECT src, dst FROM bb"),
    "g15_delete_batch": (lambda s, d: X.graph(s, d).delete_edges(_returned(s, d)).edges, f"WITH {PS}, {RETURNED} SELECT src, dst FROM e EXCEPT SELECT src, dst FROM rr"),
    "g3_contains_vertex": (lambda s, d: s.createDataFrame([(v, X.graph(s, d).contains_vertex(v)) for v in (2, HUGE)], "id long, found boolean"), f"WITH {PS} SELECT k AS id, EXISTS (SELECT 1 FROM v WHERE v.id=k) AS found FROM (VALUES (2::BIGINT), ({HUGE})) t(k)"),
    "g6_map_vertices_no_index": (lambda s, d: X.graph(s, d).map_vertices_no_index(twice=F.col("id") * 2), f"WITH {PS} SELECT id, id*2 AS twice FROM v"),
    "g10_scan": (q_scan, f"WITH {PS} SELECT count(*) AS m FROM e"),
    "g11_iter_edges": (lambda s, d: X.graph(s, d).iter_edges(), f"WITH {PS} SELECT src AS id, count(*) AS visited, count(DISTINCT dst) AS degree, count(*)=count(DISTINCT dst) AS ok FROM e GROUP BY src"),
    "g16_append_slab": (q_append_slab, f"WITH {PS} SELECT src, dst FROM e UNION ALL SELECT src+{HUGE}, dst+{HUGE} FROM e"),
    "g17_sort_updates": (lambda s, d: sort_updates(_batch(s, d)).withColumn("part", F.spark_partition_id()).select("src", "dst", (F.col("part") >= 0).alias("dealt")), f"WITH {BATCH} SELECT src, dst, true AS dealt FROM bb"),
    "g20_storage_stats": (
        lambda s, d: X.graph(s, d).storage_stats(),
        f"WITH {PS}, {CODES}, n AS (SELECT count(*) AS n FROM v), c AS (SELECT count(*) AS m, sum(bytes)::BIGINT AS b FROM cs) SELECT n AS vertices, m AS edges, n*48+m*32 AS uncompressed_bytes, n*56+m*4 AS plain_bytes, b AS delta_bytes, n*56+b AS delta_total_bytes FROM n, c",
    ),
    "g19_size_in_bytes": (lambda s, d: s.createDataFrame([(X.graph(s, d).size_in_bytes(),)], "bytes long"), f"WITH {PS}, {CODES} SELECT ((SELECT count(*) FROM v)*56+sum(bytes))::BIGINT AS bytes FROM cs"),
    "n17_list_bytes": (lambda s, d: X.graph(s, d).code_sizes().groupBy("src").agg(F.sum("bytes").alias("bytes")), f"WITH {PS}, {CODES} SELECT src, sum(bytes)::BIGINT AS bytes FROM cs GROUP BY src"),
    "g24_adjacency": (lambda s, d: X.graph(s, d).adjacency().select("id", "degree", F.concat_ws(",", "nbrs").alias("nbrs")), f"WITH {PS} SELECT src AS id, count(*) AS degree, string_agg(dst, ',' ORDER BY dst) AS nbrs FROM e GROUP BY src"),
    "t1_edge_map": (edge_rounds("auto"), EDGE_ROUND),
    "t3_edge_map_sparse": (edge_rounds("push"), EDGE_ROUND),
    "t4_edge_map_dense": (edge_rounds("pull"), EDGE_ROUND),
    "t2_edge_map_flat": (lambda s, d: T.edge_map(g := X.graph(s, d, "co").cached(), T.subset_where(g, F.col("id") % 10 < 8), mode="auto"), f"WITH {CO} SELECT DISTINCT dst AS id FROM e WHERE src%10<8"),
    "t5_edge_map_dense_forward": (lambda s, d: T.edge_map(g := X.graph(s, d), T.subset_where(g, F.col("id") % 2 == 1)), f"WITH {PS} SELECT DISTINCT dst AS id FROM e WHERE src%2=1"),
    "t6_no_output": (lambda s, d: T.edge_map(g := X.graph(s, d), _frontier(g), no_output=True), f"WITH {PS} SELECT id FROM v WHERE false"),
    "t8_subsets": (lambda s, d: T.empty_subset(g := X.graph(s, d)).union(T.singleton(g, 2)).union(T.subset_where(g, F.col("id") % 100 == 1)), f"WITH {PS} SELECT 2::BIGINT AS id UNION ALL SELECT id FROM v WHERE id%100=1"),
    "t10_size": (lambda s, d: T.size_of(_frontier(X.graph(s, d))), f"WITH {PS} SELECT count(*) AS n FROM v WHERE id%10=1"),
    "t10_is_in": (lambda s, d: T.is_in(_frontier(g := X.graph(s, d)), g.vertices), f"WITH {PS} SELECT id, id%10=1 AS found FROM v"),
    "t4_edge_map_pull": (lambda s, d: T.edge_map(g := X.graph(s, d), _frontier(g), only=g.vertices.where("id % 4 = 2")), f"WITH {PS} SELECT DISTINCT dst AS id FROM e WHERE src%10=1 AND dst%4=2"),
    "t7_vertex_map": (lambda s, d: T.vertex_map(_frontier(X.graph(s, d)), half=F.floor(F.col("id") / 2)), f"WITH {PS} SELECT id, id//2 AS half FROM v WHERE id%10=1"),
    "t11_map_reduce": (lambda s, d: T.map_reduce(_frontier(X.graph(s, d)), F.col("id"), F.sum), f"WITH {PS} SELECT sum(id)::BIGINT AS value FROM v WHERE id%10=1"),
    "t12_subset_union": (lambda s, d: T.union((g := X.graph(s, d)).vertices.where("id % 10 = 1"), g.vertices.where("id % 10 = 2")), f"WITH {PS} SELECT id FROM v WHERE id%10 IN (1, 2)"),
    "t13_get_nghs": (lambda s, d: T.neighbours_of(g := X.graph(s, d), g.vertices.where("id % 50 = 1"), F.col("id") % 3 == 0), f"WITH {PS} SELECT DISTINCT dst AS id FROM e WHERE src%50=1 AND dst%3=0"),
    "n2_contains": (lambda s, d: N.contains(X.graph(s, d).edges, _batch(s, d)), f"WITH {PS}, {BATCH} SELECT src, dst, EXISTS (SELECT 1 FROM e WHERE e.src=bb.src AND e.dst=bb.dst) AS found FROM bb"),
    "n3_map_rank": (lambda s, d: N.with_place(X.graph(s, d).edges), f"WITH {PS} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst)-1 AS idx FROM e"),
    "n5_fold": (lambda s, d: N.folded(X.graph(s, d).edges, F.col("dst") % 7), f"WITH {PS} SELECT src, dst, (sum(dst%7) OVER (PARTITION BY src ORDER BY dst))::BIGINT AS fold FROM e"),
    "n15_filter": (lambda s, d: X.graph(s, d, "co").adjacency().select("id", F.concat_ws(",", N.arr_filter(F.col("nbrs"), lambda x: x % 3 == 0)).alias("nbrs")), f"WITH {CO} SELECT src AS id, coalesce(string_agg(dst, ',' ORDER BY dst) FILTER (WHERE dst%3=0), '') AS nbrs FROM e GROUP BY src"),
    "n6_first_where": (lambda s, d: N.first_where(X.graph(s, d).edges, F.col("dst") % 7 == 0), f"WITH {PS} SELECT src, min(dst) AS dst FROM e WHERE dst%7=0 GROUP BY src"),
    "n7_count_if": (lambda s, d: N.count_where(X.graph(s, d).edges, F.col("dst") % 3 == 0), f"WITH {PS} SELECT src, count(*) FILTER (WHERE dst%3=0) AS n FROM e GROUP BY src"),
    "n8_adjacency": (lambda s, d: X.graph(s, d, "co").adjacency().select("id", F.concat_ws(",", "nbrs").alias("nbrs")), f"WITH {CO} SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS nbrs FROM e GROUP BY src"),
    "n10_union": (lambda s, d: N.union(X.graph(s, d).edges, _batch(s, d)), f"WITH {PS}, {BATCH} SELECT src, dst FROM e UNION SELECT src, dst FROM bb"),
    "n11_difference": (lambda s, d: N.difference(_batch(s, d), X.graph(s, d).edges), f"WITH {PS}, {BATCH} SELECT src, dst FROM bb EXCEPT SELECT src, dst FROM e"),
    "n12_intersect": (lambda s, d: N.intersect_count(X.graph(s, d).edges, _returned(s, d)), f"WITH {PS}, {RETURNED} SELECT e.src, count(rr.dst) AS n FROM e LEFT JOIN rr ON rr.src=e.src AND rr.dst=e.dst GROUP BY e.src"),
    "n13_split": (lambda s, d: N.split(X.graph(s, d).edges, 101), f"WITH {PS} SELECT src, count(*) FILTER (WHERE dst<101) AS below, count(*) FILTER (WHERE dst>101) AS above, bool_or(dst=101) AS found FROM e GROUP BY src"),
    "n14_join2": (lambda s, d: N.concatenated((e := X.graph(s, d).edges).where("dst < 101"), e.where("dst >= 101")), f"WITH {PS} SELECT src, dst FROM e"),
    "n16_min_max": (lambda s, d: N.ends(X.graph(s, d).edges), f'WITH {PS} SELECT src, min(dst) AS "first", max(dst) AS "last" FROM e GROUP BY src'),
    "a1_bfs": q_bfs("cops"),
    "a1_bfs_sparse": q_bfs("co", 4),
    "a2_bc": (lambda s, d: A.betweenness(X.graph(s, d, "cops").cached(), 0).select("id", F.round("score", 4).alias("score")), sql_bc("cops", 0, 9)),
    "a3_mis": (lambda s, d: A.maximal_independent_set(X.graph(s, d, "cops").cached()), sql_mis("cops", 12)),
    "a4_khop": (
        lambda s, d: A.khop(X.graph(s, d, "cops").cached(), _sources(s, 0, 2, 7, 20), 3),
        f"WITH RECURSIVE {COPS}, {SRC4}, b(query, id, level) AS (SELECT query, s.id, 0 FROM s JOIN v USING (id) UNION SELECT b.query, e.dst, b.level+1 FROM b JOIN e ON e.src=b.id WHERE b.level<3), l AS (SELECT query, id, min(level) AS level FROM b GROUP BY ALL) SELECT s.query, count(l.id) FILTER (WHERE l.level>0) AS n FROM s LEFT JOIN l USING (query) GROUP BY s.query",
    ),
    "a6_twohop": (
        lambda s, d: A.two_hop(X.graph(s, d, "cops"), _sources(s, 0, 2, 7, 20)),
        f"WITH {COPS}, {SRC4} SELECT query, count(DISTINCT id) AS n FROM (SELECT query, id FROM s UNION ALL SELECT query, dst FROM s JOIN e ON e.src=s.id UNION ALL SELECT query, f.dst FROM s JOIN e ON e.src=s.id JOIN e f ON f.src=e.dst) GROUP BY query",
    ),
    "a7_mutual_friends": (lambda s, d: A.mutual_neighbours(X.graph(s, d), _pairs(s, d)), f"WITH {PS}, {PAIRS} SELECT a, b, (SELECT count(*) FROM e x JOIN e y ON x.dst=y.dst WHERE x.src=a AND y.src=b) AS n FROM pr"),
    "a8_nibble_parallel": (lambda s, d: A.nibble_parallel(g := X.graph(s, d, "cops").cached(), A.source_table(g, 0, 2, 7, 20)).select("query", "id", F.round("mass", 9).alias("mass")), sql_nibble("cops", 10, 1e-9, True)),
    "a9_nibble_serial": (lambda s, d: A.nibble_serial(X.graph(s, d, "cops").cached(), A.source_table(X.graph(s, d, "cops"), 0, 2, 7, 20)).select("query", "id", F.round("mass", 9).alias("mass")), sql_nibble("cops", 10, 1e-6, False)),
    "a10_ldd": (q_ldd, sql_ldd("ps", 0.2, 40)),
    "p16_components": (lambda s, d: A.components(X.graph(s, d, "co").cached()), sql_components("co", 40)),
    "v1_create": (lambda s, d: GraphStore.create(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}", X.graph(s, d)).graph_at(0).edges, f"WITH {PS} SELECT src, dst FROM e"),
    "v2_latest": (lambda s, d: s.createDataFrame([(_store(s, d).latest(),)], "version long"), f"WITH {X.SQL_LOG} SELECT max(version) AS version FROM log"),
    "v3_as_of": (lambda s, d: _store(s, d, 10).acquire(9).graph.edges, f"WITH {X.SQL_LOG} SELECT src, dst FROM log WHERE version<=9 GROUP BY src, dst HAVING max_by(op, version)='+'"),
    "v4_vacuum": (q_vacuum, f"WITH {X.SQL_LOG}, k(version, readers) AS (VALUES (3::BIGINT, 1::BIGINT), (9, 0)) SELECT k.version, k.readers, (SELECT count(*) FROM (SELECT src, dst FROM log WHERE log.version<=k.version GROUP BY src, dst HAVING max_by(op, version)='+')) AS m FROM k"),
    "v5_insert_version": (lambda s, d: _store(s, d, 3).graph_at(3).edges, f"WITH {X.SQL_LOG} SELECT DISTINCT src, dst FROM log WHERE version<=3"),
    "v6_delete_version": (lambda s, d: _store(s, d).graph_at(14).edges, f"WITH {X.SQL_LOG} SELECT src, dst FROM log GROUP BY src, dst HAVING max_by(op, version)='+'"),
    "io1_adjacency": (q_adjacency_file, f"WITH {PS} SELECT src, dst FROM e"),
    "io2_byte": (q_binary_file("byte"), f"WITH {PS} SELECT src, dst FROM e"),
    "io3_bytepda": (q_binary_file("bytepda"), f"WITH {PS} SELECT src, dst FROM e"),
    "io10_csr": (q_csr_file, f"WITH {PS} SELECT row_number() OVER (ORDER BY src, dst)-1 AS place, src, dst FROM e"),
    "io11_rmat": (lambda s, d: io.rmat(s, 1024, 20_000, seed=7), io.sql_rmat(1024, 20_000, seed=7)),
    "io15_ith_rand": (lambda s, d: X.graph(s, d).vertices.select("id", ith_rand(F.col("id"), 5).alias("r"), ith_rand(F.col("id"), fork(5, 3)).alias("f")), f"WITH {PS} SELECT id, {sql_rand('id', 5)} AS r, {sql_rand('id', fork(5, 3))} AS f FROM v"),
    "io16_mixers": (lambda s, d: X.graph(s, d).vertices.select("id", mix32(F.col("id")).alias("h32"), mix64(F.col("id")).alias("h64")), f"WITH {PS} SELECT id, {sql_rand('id', 0)} AS h32, {sql_rand('id', 0)} * {1 << 30} + ({sql_rand('id', fork(0, 1))} >> 2) AS h64 FROM v"),
    "io15_priority": (lambda s, d: X.graph(s, d).vertices.select("id", priority("id").alias("p")), f"WITH {PS} SELECT id, {PRIO.format('id')} AS p FROM v"),
}
