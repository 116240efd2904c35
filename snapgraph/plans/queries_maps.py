"""Registered queries: ordered maps and augmented maps over customers and orders.  Each entry is (query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapgraph.operators.ordered import OrderedMap
from snapgraph.sources.fixtures import table


def cust(s, d):
    """Balances in cents: whole numbers add up alike in any order."""
    return OrderedMap(table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") * 100).cast("long").alias("val")))


def left(s, d):
    return cust(s, d).filter(F.col("key") % 3 == 0)


def right(s, d):
    return OrderedMap(cust(s, d).filter(F.col("key") % 2 == 0).rows.select("key", (F.col("val") + 7).alias("val")))


def orders(s, d):
    """(key, val, pos): order totals in cents by customer, in order of order keys."""
    return table(s, d, "orders").select(F.col("o_custkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("val"), F.col("o_orderkey").alias("pos"))


def asks(s, d):
    return table(s, d, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 3 * 5 - 3).alias("key")).distinct()


C = "c AS MATERIALIZED (SELECT c_custkey AS key, round(c_acctbal*100)::BIGINT AS val FROM customer), l AS (SELECT * FROM c WHERE key%3=0), r AS (SELECT key, val+7 AS val FROM c WHERE key%2=0)"
O = "o AS MATERIALIZED (SELECT o_custkey AS key, round(o_totalprice*100)::BIGINT AS val, o_orderkey AS pos FROM orders)"
ASK = "q AS MATERIALIZED (SELECT DISTINCT o_custkey + o_orderkey%3*5 - 3 AS q FROM orders)"
THREE = "m3 AS (SELECT * FROM c WHERE key%3=0)"


def near(direction, sql_op, sql_pick):
    return (
        lambda s, d: left(s, d).near(asks(s, d), direction).where("key is not null"),
        f"WITH {C}, {ASK}, k AS (SELECT q.q, {sql_pick}(l.key) AS key FROM q JOIN l ON l.key {sql_op} q.q GROUP BY q.q) SELECT k.q, k.key, l.val FROM k JOIN l ON l.key=k.key",
    )


QUERIES = {
    "m1_find": (lambda s, d: cust(s, d).find(42), f"WITH {C} SELECT * FROM c WHERE key=42"),
    "m2_contains": (lambda s, d: left(s, d).contains(asks(s, d)), f"WITH {C}, {ASK} SELECT q.q AS key, EXISTS (SELECT 1 FROM l WHERE l.key=q.q) AS found FROM q"),
    "m3_next": near("next", ">", "min"),
    "m3_previous": near("previous", "<", "max"),
    "m4_floor": near("floor", "<=", "max"),
    "m5_first": (lambda s, d: left(s, d).first(), f"WITH {C} SELECT * FROM l ORDER BY key LIMIT 1"),
    "m5_last": (lambda s, d: left(s, d).last(), f"WITH {C} SELECT * FROM l ORDER BY key DESC LIMIT 1"),
    "m6_rank": (lambda s, d: left(s, d).ranked(), f"WITH {C} SELECT key, val, row_number() OVER (ORDER BY key)-1 AS rank FROM l"),
    "m6_rank_of": (lambda s, d: left(s, d).rank(100), f"WITH {C} SELECT count(*) AS rank FROM l WHERE key<100"),
    "m7_select": (lambda s, d: left(s, d).select(25), f"WITH {C} SELECT * FROM l ORDER BY key LIMIT 1 OFFSET 25"),
    "m8_upsert": (lambda s, d: left(s, d).upsert(right(s, d)).rows, f"WITH {C} SELECT coalesce(r.key, l.key) AS key, coalesce(r.val, l.val) AS val FROM l FULL JOIN r ON l.key=r.key"),
    "m9_update": (lambda s, d: cust(s, d).update(42, lambda v: v * 2).rows, f"WITH {C} SELECT key, CASE WHEN key=42 THEN val*2 ELSE val END AS val FROM c"),
    "m10_remove": (lambda s, d: cust(s, d).remove(42).rows, f"WITH {C} SELECT * FROM c WHERE key<>42"),
    "m11_filter": (lambda s, d: cust(s, d).filter(F.col("val") > 500_000).rows, f"WITH {C} SELECT * FROM c WHERE val>500000"),
    "m12_map": (lambda s, d: cust(s, d).map(F.col("val") * 2 + F.col("key")).rows, f"WITH {C} SELECT key, val*2+key AS val FROM c"),
    "m13_map_filter": (lambda s, d: cust(s, d).map_filter(F.when(F.col("val") > 0, F.col("val") + 1)).rows, f"WITH {C} SELECT key, val+1 AS val FROM c WHERE val>0"),
    "m14_map_reduce": (lambda s, d: cust(s, d).reduce(F.sum(F.col("val") * 2)), f"WITH {C} SELECT sum(val*2)::BIGINT AS value FROM c"),
    "m14_ordered_fold": (
        lambda s, d: cust(s, d).affine_fold(31, 1_000_003),
        f"WITH RECURSIVE {C}, x AS (SELECT row_number() OVER (ORDER BY key) AS i, val FROM c), f(i, acc) AS (SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT f.i+1, (((f.acc*31 + x.val) % 1000003) + 1000003) % 1000003 FROM f JOIN x ON x.i=f.i+1) SELECT acc AS value FROM f ORDER BY i DESC LIMIT 1",
    ),
    "m15_union": (lambda s, d: left(s, d).union(right(s, d), lambda a, b: a + b).rows, f"WITH {C} SELECT coalesce(l.key, r.key) AS key, coalesce(l.val, 0)+coalesce(r.val, 0) AS val FROM l FULL JOIN r ON l.key=r.key"),
    "m16_intersect": (lambda s, d: left(s, d).intersect(right(s, d), lambda a, b: a - b).rows, f"WITH {C} SELECT l.key, l.val-r.val AS val FROM l JOIN r ON l.key=r.key"),
    "m17_difference": (lambda s, d: left(s, d).difference(right(s, d)).rows, f"WITH {C} SELECT l.* FROM l ANTI JOIN r ON l.key=r.key"),
    "m18_range": (lambda s, d: cust(s, d).range(20, 90).rows, f"WITH {C} SELECT * FROM c WHERE key BETWEEN 20 AND 90"),
    "m19_upto": (lambda s, d: cust(s, d).up_to(50).rows, f"WITH {C} SELECT * FROM c WHERE key<=50"),
    "m19_from": (lambda s, d: cust(s, d).from_(50).rows, f"WITH {C} SELECT * FROM c WHERE key>=50"),
    "m20_range_number": (lambda s, d: left(s, d).range_number(31, 20), f"WITH {C} SELECT * FROM l WHERE key>=31 ORDER BY key LIMIT 20"),
    "m21_range_number_mr": (lambda s, d: left(s, d).range_number_reduce(31, 20, F.sum("val")), f"WITH {C} SELECT sum(val)::BIGINT AS value FROM (SELECT * FROM l WHERE key>=31 ORDER BY key LIMIT 20)"),
    "m22_multi_insert": (lambda s, d: left(s, d).multi_insert(orders(s, d)).rows, f"WITH {C}, {O}, b AS (SELECT key, max_by(val, pos) AS val FROM o GROUP BY key) SELECT coalesce(b.key, l.key) AS key, coalesce(b.val, l.val) AS val FROM l FULL JOIN b ON l.key=b.key"),
    "m23_insert_combine": (lambda s, d: left(s, d).multi_insert_combine(orders(s, d), F.sum, lambda a, b: a + b).rows, f"WITH {C}, {O}, b AS (SELECT key, sum(val)::BIGINT AS val FROM o GROUP BY key) SELECT coalesce(b.key, l.key) AS key, coalesce(b.val, 0)+coalesce(l.val, 0) AS val FROM l FULL JOIN b ON l.key=b.key"),
    "m24_insert_reduce": (lambda s, d: left(s, d).multi_insert_reduce(orders(s, d), F.max("val") - F.min("val")).rows, f"WITH {C}, {O}, b AS (SELECT key, max(val)-min(val) AS val FROM o GROUP BY key) SELECT coalesce(b.key, l.key) AS key, coalesce(b.val, l.val) AS val FROM l FULL JOIN b ON l.key=b.key"),
    "m26_multi_update": (lambda s, d: left(s, d).multi_update(right(s, d), lambda a, b: a * 2 - b).rows, f"WITH {C} SELECT l.key, CASE WHEN r.key IS NULL THEN l.val ELSE l.val*2-r.val END AS val FROM l LEFT JOIN r ON l.key=r.key"),
    "m27_join2": (lambda s, d: cust(s, d).up_to(50).joined(cust(s, d).filter(F.col("key") > 90)).rows, f"WITH {C} SELECT * FROM c WHERE key<=50 OR key>90"),
    "m28_split": (lambda s, d: (p := cust(s, d).split(70))[0].rows.withColumn("side", F.lit("<")).union(p[1].rows.withColumn("side", F.lit(">"))).union(p[2].withColumn("side", F.lit("="))), f"WITH {C} SELECT *, CASE WHEN key<70 THEN '<' WHEN key>70 THEN '>' ELSE '=' END AS side FROM c"),
    "m29_if_exist": (lambda s, d: cust(s, d).exists(F.col("val") < -99_000), f"WITH {C} SELECT coalesce(bool_or(val < -99000), false) AS found FROM c"),
    "m31_prefix_sizes": (lambda s, d: cust(s, d).prefix_sizes(F.col("key") % 10 + 1), f"WITH {C} SELECT key, val, coalesce(sum(key%10+1) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c"),
    "m32_take_while": (lambda s, d: cust(s, d).take_while(F.col("val") < 950_000), f"WITH {C} SELECT * FROM c WHERE key < coalesce((SELECT min(key) FROM c WHERE NOT val<950000), 9223372036854775807)"),
    "m30_keys": (lambda s, d: left(s, d).keys(), f"WITH {C} SELECT row_number() OVER (ORDER BY key)-1 AS rank, key FROM l"),
    "m30_foreach_index": (lambda s, d: left(s, d).foreach_index(F.col("val") + F.col("rank")), f"WITH {C} SELECT row_number() OVER (ORDER BY key)-1 AS rank, val + row_number() OVER (ORDER BY key)-1 AS value FROM l"),
    "m25_multi_insert_sorted": (lambda s, d: left(s, d).multi_insert_sorted(right(s, d).ranked().withColumnRenamed("rank", "idx")).rows, f"WITH {C} SELECT coalesce(r.key, l.key) AS key, coalesce(r.val, l.val) AS val FROM l FULL JOIN r ON l.key=r.key"),
    "m34_from_sorted": (lambda s, d: OrderedMap.from_sorted(left(s, d).ranked().withColumnRenamed("rank", "idx")).rows, f"WITH {C} SELECT * FROM l"),
    "m33_size": (lambda s, d: cust(s, d).rows.agg(F.count(F.lit(1)).alias("n")), f"WITH {C} SELECT count(*) AS n FROM c"),
    "ag1_total": (lambda s, d: cust(s, d).reduce(F.sum("val")), f"WITH {C} SELECT sum(val)::BIGINT AS value FROM c"),
    "ag2_left": (lambda s, d: cust(s, d).aug_left(), f"WITH {C} SELECT key, val, (sum(val) OVER (ORDER BY key))::BIGINT AS sum FROM c"),
    "ag3_right": (lambda s, d: cust(s, d).aug_right(), f"WITH {C} SELECT key, val, (sum(val) OVER (ORDER BY key DESC))::BIGINT AS sum FROM c"),
    "ag4_range": (lambda s, d: cust(s, d).aug_range(20, 90, F.sum("val")), f"WITH {C} SELECT sum(val)::BIGINT AS value FROM c WHERE key BETWEEN 20 AND 90"),
    "ag4_ranges": (
        lambda s, d: cust(s, d).aug_ranges(s.range(40).select((F.col("id") * 3).alias("low"), (F.col("id") * 3 + 10).alias("high"))),
        f"WITH {C} SELECT i*3 AS low, i*3+10 AS high, coalesce(sum(val), 0)::BIGINT AS sum, count(c.key) AS n FROM (SELECT range AS i FROM range(40)) LEFT JOIN c ON c.key BETWEEN i*3 AND i*3+10 GROUP BY i",
    ),
    "ag6_select": (lambda s, d: OrderedMap(cust(s, d).rows.select("key", F.abs("val").alias("val"))).aug_select(0.37), f"WITH {C}, x AS (SELECT key, abs(val) AS val, sum(abs(val)) OVER (ORDER BY key) AS s, sum(abs(val)) OVER () AS t FROM c) SELECT key, val FROM x WHERE s >= t*0.37::DOUBLE ORDER BY key LIMIT 1"),
    "ag7_filter": (lambda s, d: cust(s, d).aug_filter(900_000).rows, f"WITH {C} SELECT * FROM c WHERE val>=900000"),
}
