"""Registered queries: sequences, sorting, grouping, searching and text.  Each entry is (query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapgraph.functions.cuts import scanned
from snapgraph.functions.hashing import priority
from snapgraph.operators import sequences as Q
from snapgraph.operators import text as T
from snapgraph.operators.tables import Counters, HashSet, HashTable
from snapgraph.sources import fixtures as X
from snapgraph.sources import io
from snapgraph.sources.fixtures import table

def seq(s, d):
    """events.value in cents, indexed by event_id."""
    return table(s, d, "events").select(F.col("event_id").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("val"), "event_type", "user_id")


def vals(s, d):
    return seq(s, d).select("idx", "val")


def small(s, d):
    return vals(s, d).select("idx", (F.col("val") % 10).alias("val"))


def other(s, d):
    """As vals, but one entry differs."""
    return vals(s, d).select("idx", F.when(F.col("idx") == 700, F.col("val") + 1).otherwise(F.col("val")).alias("val"))


E = "e AS MATERIALIZED (SELECT event_id AS idx, round(value*100)::BIGINT AS val, event_type, user_id FROM events), sm AS (SELECT idx, val%10 AS val FROM e), ot AS (SELECT idx, CASE WHEN idx=700 THEN val+1 ELSE val END AS val FROM e)"
KLASS = "CASE WHEN event_type='click' THEN 0 WHEN event_type='view' THEN 1 ELSE 2 END"


def klass():
    return F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)


def ranges(s):
    return s.range(60).select((F.col("id") * 7).alias("low"), (F.col("id") * 7 + F.col("id") * 13 % 600).alias("high"))


RANGES = "rg AS (SELECT i*7 AS low, i*7 + i*13%600 AS high FROM (SELECT range AS i FROM range(60)))"


def docs(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


#: One text for the suffix structures: all documents, lower-cased, in order of their ids.  SQL would compare whole suffixes pair by pair.
def suffix_text(s, d):
    whole = docs(s, d).select("doc_id", F.lower("text").alias("text")).withColumn("size", F.char_length("text"))
    placed = scanned(whole, [F.col("doc_id").asc_nulls_last(), F.col("text")], {"start": (F.col("size"), "sum")}, inclusive=False)
    return placed.select(F.col("start").alias("idx"), F.col("text").alias("val"))


def table_rows(s, d, k):
    """A third of the events as rows (key, val, pos) of a table."""
    return seq(s, d).where(F.col("idx") % 3 == k).select(F.col("user_id").cast("long").alias("key"), "val", F.col("idx").alias("pos"))


def _added_up(s, a):
    """Effects of for_each, seen through an accumulator."""
    total = s.sparkContext.accumulator(0)

    def act(rows):
        for r in rows:
            total.add(r["val"])

    Q.for_each(a, act)
    return s.createDataFrame([(total.value,)], "value long")


CH = "ch AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, '')) AS val, generate_subscripts(string_split(text, ''), 1) - 1 AS idx FROM documents WHERE text <> '')"

QUERIES = {
    "p3_reduce": (lambda s, d: Q.reduce(vals(s, d), F.sum("val")), f"WITH {E} SELECT sum(val)::BIGINT AS value FROM e"),
    "p1_map": (lambda s, d: Q.mapped(vals(s, d), F.col("val") * 3 - F.col("idx")), f"WITH {E} SELECT idx, val*3-idx AS val FROM e"),
    "p4_scan": (lambda s, d: Q.scan(vals(s, d)), f"WITH {E} SELECT idx, val, coalesce(sum(val) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS scan FROM e"),
    "p4_scan_inclusive": (lambda s, d: Q.scan(vals(s, d), "max", True), f"WITH {E} SELECT idx, val, max(val) OVER (ORDER BY idx) AS scan FROM e"),
    "p5_sum_bools": (lambda s, d: Q.count_if(seq(s, d), F.col("event_type") == "error"), f"WITH {E} SELECT count(*) FILTER (WHERE event_type='error') AS n FROM e"),
    "p6_pack": (lambda s, d: Q.pack(seq(s, d), F.col("event_type") == "click"), f"WITH {E} SELECT row_number() OVER (ORDER BY idx)-1 AS idx, val FROM e WHERE event_type='click'"),
    "p8_pack_index": (lambda s, d: Q.pack_index(seq(s, d), F.col("event_type") == "click"), f"WITH {E} SELECT row_number() OVER (ORDER BY idx)-1 AS pos, idx FROM e WHERE event_type='click'"),
    "p9_split_two": (lambda s, d: Q.split_by(seq(s, d), (F.col("val") % 2 == 1).cast("int")), f"WITH {E} SELECT row_number() OVER (ORDER BY (val%2=1)::INT, idx)-1 AS pos, idx, val, (val%2=1)::INT AS class FROM e"),
    "p10_split_three": (lambda s, d: Q.split_by(seq(s, d), klass()), f"WITH {E} SELECT row_number() OVER (ORDER BY {KLASS}, idx)-1 AS pos, idx, val, {KLASS} AS class FROM e"),
    "p12_lower_bound": (lambda s, d: Q.lower_bound(vals(s, d), 5000), f"WITH {E} SELECT count(*) FILTER (WHERE val<5000) AS idx FROM e"),
    "p13_transpose": (lambda s, d: Q.transposed(table(s, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.lit(1).alias("val")).distinct()), "SELECT DISTINCT l_suppkey AS i, l_partkey AS j, 1 AS val FROM lineitem"),
    "p14_spmv": (
        lambda s, d: Q.spmv((g := X.graph(s, d)).edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("val")), g.vertices.select(F.col("id").alias("j"), (F.col("id") % 10).alias("x")), g.vertices.select(F.col("id").alias("i"))),
        f"WITH {X.sql_edges('ps')} SELECT src AS i, sum(dst%10)::BIGINT AS y FROM e GROUP BY src",
    ),
    "p15_range_min": (lambda s, d: Q.range_min(vals(s, d), ranges(s), 64), f"WITH {E}, {RANGES} SELECT low, high, (min(struct_pack(v := val, i := idx))).i AS idx FROM rg JOIN e ON idx BETWEEN low AND high GROUP BY low, high"),
    "p17_reservations": (
        lambda s, d: _all_rounds(s, d),
        None,  # a round for each commit: tested against brute force
    ),
    "p18_bag": (lambda s, d: Q.bag(vals(s, d), small(s, d)), f"WITH {E} SELECT val FROM e UNION ALL SELECT val FROM sm"),
    "p19_shuffle": (lambda s, d: Q.shuffled(vals(s, d), 5), f"WITH {E} SELECT row_number() OVER (ORDER BY ((idx+5)*2654435761)%4294967296, idx)-1 AS pos, idx, val FROM e"),
    "p20_scatter_min": (lambda s, d: Q.scatter(seq(s, d).select(F.col("user_id").alias("target"), "val"), F.min), f"WITH {E} SELECT user_id AS target, min(val) AS value FROM e GROUP BY user_id"),
    "p20_scatter_add": (lambda s, d: Q.scatter(seq(s, d).select(F.col("user_id").alias("target"), "val"), F.sum), f"WITH {E} SELECT user_id AS target, sum(val)::BIGINT AS value FROM e GROUP BY user_id"),
    "p22_mcss": (lambda s, d: Q.best_run(vals(s, d).withColumn("val", F.col("val") - 5000)), f"WITH {E}, p AS (SELECT idx, sum(val-5000) OVER (ORDER BY idx) AS s FROM e), q AS (SELECT s, coalesce(min(s) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM p) SELECT max(s-least(lo, 0))::BIGINT AS best FROM q"),
    "s1_sort": (lambda s, d: Q.sorted_(vals(s, d), "val", "idx"), f"WITH {E} SELECT idx, val, row_number() OVER (ORDER BY val, idx)-1 AS pos FROM e"),
    "s5_sort_with_counts": (lambda s, d: Q.bucket_offsets(vals(s, d), F.col("val") % 64, 64), f"WITH {E}, b AS (SELECT range AS bucket FROM range(64)), c AS (SELECT bucket, count(idx) AS n FROM b LEFT JOIN e ON val%64=bucket GROUP BY bucket) SELECT bucket, n, coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c"),
    "s6_get_counts": (lambda s, d: Q.bucket_counts(vals(s, d), F.col("val") % 256, 300), f"WITH {E} SELECT b.range AS bucket, count(idx) AS n FROM range(300) b LEFT JOIN e ON val%256=b.range GROUP BY b.range"),
    "s8_merge": (lambda s, d: Q.merged(vals(s, d), small(s, d)), f"WITH {E}, b AS (SELECT val, idx, 0 AS side FROM e UNION ALL SELECT val, idx, 1 FROM sm) SELECT row_number() OVER (ORDER BY val, side, idx)-1 AS pos, val, side FROM b"),
    "s10_kth": (lambda s, d: Q.kth_smallest(vals(s, d), 333), f"WITH {E} SELECT val FROM e ORDER BY val LIMIT 1 OFFSET 333"),
    "s11_approx_kth": (lambda s, d: Q.approximate_kth(vals(s, d), 0.25, 1_000_000), f"WITH {E} SELECT val FROM e ORDER BY val LIMIT 1 OFFSET (SELECT ceil(count(*)*0.25)::BIGINT-1 FROM e)"),
    "s12_is_sorted": (lambda s, d: Q.is_sorted(vals(s, d)), f"WITH {E}, x AS (SELECT idx, val, lead(val) OVER (ORDER BY idx) AS n FROM e) SELECT count(*) FILTER (WHERE val>n)=0 AS sorted, min(idx) FILTER (WHERE val>n) AS first_break FROM x"),
    "agg1_dense": (lambda s, d: Q.collect_reduce(seq(s, d), F.col("user_id") % 50, F.sum("val"), 60), f"WITH {E} SELECT b.range AS key, coalesce(sum(val), 0)::BIGINT AS value FROM range(60) b LEFT JOIN e ON user_id%50=b.range GROUP BY b.range"),
    "agg3_collect_reduce": (lambda s, d: Q.collect_reduce(seq(s, d), F.col("user_id"), F.max("val")), f"WITH {E} SELECT user_id AS key, max(val) AS value FROM e GROUP BY user_id"),
    "agg4_histogram": (lambda s, d: Q.bucket_counts(table(s, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k")), F.col("k"), 100), "SELECT b.range AS bucket, count(k) AS n FROM range(100) b LEFT JOIN (SELECT regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events) ON k=b.range GROUP BY b.range"),
    "agg5_heavy_keys": (lambda s, d: Q.heavy_keys(seq(s, d), F.col("event_type"), 0.15), f"WITH {E} SELECT event_type AS key, count(*) AS n FROM e GROUP BY event_type HAVING count(*) >= (SELECT count(*) FROM e)*0.15"),
    "agg6_distinct": (lambda s, d: small(s, d).select("val").distinct(), f"WITH {E} SELECT DISTINCT val FROM sm"),
    "agg7_distinct_sorted": (lambda s, d: Q.distinct_sorted(vals(s, d)), f"WITH {E} SELECT row_number() OVER (ORDER BY val)-1 AS pos, val FROM (SELECT DISTINCT val FROM e)"),
    "agg8_unique": (lambda s, d: Q.unique(small(s, d)), f"WITH {E}, x AS (SELECT idx, val, lag(val) OVER (ORDER BY idx) AS p FROM sm) SELECT idx, val FROM x WHERE p IS NULL OR p<>val"),
    "agg10_minmax": (lambda s, d: Q.min_max(vals(s, d)), f"WITH {E} SELECT min(val) AS low, max(val) AS high FROM e"),
    "agg10_xor": (lambda s, d: Q.reduce(vals(s, d), F.bit_xor("val")), f"WITH {E} SELECT bit_xor(val) AS value FROM e"),
    "agg10_array_sum": (lambda s, d: Q.array_sum(table(s, d, "embeddings").select(F.transform("embedding", lambda x: F.round(x * 1000).cast("long")).alias("val"))), "SELECT j-1 AS j, sum(round(embedding[j::INT]::DOUBLE*1000)::BIGINT)::BIGINT AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS j) GROUP BY j"),
    "f1_count_if": (lambda s, d: Q.count_if(vals(s, d), F.col("val") > 5000), f"WITH {E} SELECT count(*) FILTER (WHERE val>5000) AS n FROM e"),
    "f2_find_if": (lambda s, d: Q.find_if(seq(s, d), F.col("event_type") == "error"), f"WITH {E} SELECT coalesce(min(idx) FILTER (WHERE event_type='error'), max(idx)+1) AS idx FROM e"),
    "f3_all_any_none": (lambda s, d: Q.quantifiers(vals(s, d), F.col("val") > 20), f"WITH {E} SELECT bool_and(val>20) AS all_of, bool_or(val>20) AS any_of, NOT bool_or(val>20) AS none_of FROM e"),
    "f4_find_first_of": (lambda s, d: Q.find_first_of(vals(s, d), vals(s, d).where("idx >= 500 and idx < 520")), f"WITH {E} SELECT min(idx) AS idx FROM e WHERE val IN (SELECT val FROM e WHERE idx>=500 AND idx<520)"),
    "f5_adjacent_find": (lambda s, d: Q.adjacent_find(small(s, d)), f"WITH {E}, x AS (SELECT idx, val, lead(val) OVER (ORDER BY idx) AS n FROM sm) SELECT min(idx) AS idx FROM x WHERE val=n"),
    "f6_mismatch": (lambda s, d: Q.mismatch(vals(s, d), other(s, d)), f"WITH {E} SELECT coalesce(min(e.idx) FILTER (WHERE e.val<>ot.val), max(e.idx)+1) AS idx FROM e JOIN ot USING (idx)"),
    "f7_search": (lambda s, d: Q.search(small(s, d), [1, 2]), f"WITH {E}, x AS (SELECT idx, val, lead(val) OVER (ORDER BY idx) AS n FROM sm) SELECT min(idx) AS idx FROM x WHERE val=1 AND n=2"),
    "f8_find_end": (lambda s, d: Q.search(small(s, d), [1, 2], last=True), f"WITH {E}, x AS (SELECT idx, val, lead(val) OVER (ORDER BY idx) AS n FROM sm) SELECT max(idx) AS idx FROM x WHERE val=1 AND n=2"),
    "f9_equal": (lambda s, d: Q.equal(vals(s, d), other(s, d)), f"WITH {E} SELECT bool_and(e.val=ot.val) AS equal FROM e JOIN ot USING (idx)"),
    "f10_lexicographical": (lambda s, d: Q.lexicographical_less(vals(s, d), other(s, d)), f"WITH {E} SELECT min_by(e.val<ot.val, idx) AS less FROM e JOIN ot USING (idx) WHERE e.val<>ot.val"),
    "f11_min_element": (lambda s, d: Q.extrema(vals(s, d)), f"WITH {E} SELECT (SELECT idx FROM e ORDER BY val, idx LIMIT 1) AS min_idx, (SELECT idx FROM e ORDER BY val DESC, idx LIMIT 1) AS max_idx"),
    "f12_reverse": (lambda s, d: Q.reversed_(vals(s, d)), f"WITH {E} SELECT (SELECT max(idx) FROM e)-idx AS idx, val FROM e"),
    "f12_rotate": (lambda s, d: Q.rotated(vals(s, d), 13), f"WITH {E} SELECT (idx+13)%(SELECT max(idx)+1 FROM e) AS idx, val FROM e"),
    "f13_remove_if": (lambda s, d: Q.remove_if(vals(s, d), F.col("val") > 5000), f"WITH {E} SELECT row_number() OVER (ORDER BY idx)-1 AS idx, val FROM e WHERE NOT val>5000"),
    "f14_append": (lambda s, d: Q.appended(vals(s, d), small(s, d)), f"WITH {E} SELECT idx, val FROM e UNION ALL SELECT idx+(SELECT max(idx)+1 FROM e), val FROM sm"),
    "f15_enumerate": (lambda s, d: Q.enumerate_flags(seq(s, d), F.col("event_type") == "click"), f"WITH {E} SELECT idx, coalesce(sum((event_type='click')::INT) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM e"),
    "f16_flatten": (
        lambda s, d: Q.flattened(seq(s, d).groupBy("user_id").agg(F.array_sort(F.collect_list("val")).alias("val")).select(F.col("user_id").alias("idx"), "val")),
        f"WITH {E} SELECT row_number() OVER (ORDER BY user_id, val)-1 AS idx, val FROM e",
    ),
    "io13_windows": (
        lambda s, d: Q.window_average(seq(s, d).select(F.col("idx").cast("double").alias("time"), F.col("val").alias("value")), 10).select("time", F.round("latency", 6).alias("latency")),
        f"WITH {E}, b AS (SELECT min(idx)::DOUBLE AS t0, max(idx)::DOUBLE AS t1 FROM e), p AS (SELECT least(floor((idx-t0)/((t1-t0)/10)), 9) AS w, t0, t1, val FROM e, b) SELECT t0+(w+0.5)*(t1-t0)/10 AS time, round(avg(val), 6) AS latency FROM p GROUP BY w, t0, t1",
    ),
    "str1_is_space": (lambda s, d: T.partition_texts(docs(s, d), T.is_space).groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts")), "SELECT doc_id, (length(text) - length(regexp_replace(text, '[\\r\\t\\n\\x00 ]', '', 'g')) + (CASE WHEN regexp_matches(text[1], '[\\r\\t\\n\\x00 ]') THEN 0 ELSE 1 END))::BIGINT AS parts FROM documents WHERE text <> ''"),
    "str2_tokens": (
        lambda s, d: T.tokens(docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.max_by("token", "k").alias("last")),
        "WITH t AS (SELECT doc_id, regexp_split_to_array(text, '[\\r\\t\\n\\x00 ]') AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS k FROM t), q AS (SELECT *, (sum(length(token)+1) OVER (PARTITION BY doc_id ORDER BY k))::BIGINT - length(token) - 1 AS start FROM p) SELECT doc_id, count(*) AS n, sum(start)::BIGINT AS starts, max_by(token, k) AS last FROM q WHERE token <> '' GROUP BY doc_id",
    ),
    "str3_tokenize": (lambda s, d: T.tokenize(docs(s, d)).select("doc_id", F.size("words").alias("n"), F.element_at("words", -1).alias("last")), "SELECT doc_id, len(w) AS n, w[-1] AS last FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\r\\t\\n\\x00 ]'), lambda x: x <> '') AS w FROM documents)"),
    "str4_partition_at": (lambda s, d: T.partition_texts(docs(s, d), lambda c: c == " "), f"WITH {CH}, p AS (SELECT doc_id, idx, sum((idx=0 OR val=' ')::INT) OVER (PARTITION BY doc_id ORDER BY idx)-1 AS part FROM ch) SELECT doc_id, part::BIGINT AS part, min(idx) AS \"first\", max(idx) AS \"last\" FROM p GROUP BY doc_id, part"),
    "str5_split": (lambda s, d: T.tokenize(docs(s, d), chars=".,").select("doc_id", F.size("words").alias("n")), "SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.,]'), lambda x: x <> '')) AS n FROM documents"),
    "agg11_inverted_index": (lambda s, d: T.inverted_index(docs(s, d)).select("word", "part", "n", F.concat_ws(",", "keys").alias("docs")), "SELECT word, doc_id//10000 AS part, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents) GROUP BY word, doc_id//10000"),
    "str6_suffix_array": (lambda s, d: T.suffix_array(suffix_text(s, d)), None),
    "str7_lcp": (lambda s, d: T.lcp(suffix_text(s, d)), None),
    "str8_cartesian_tree": (
        lambda s, d: T.cartesian_tree(seq(s, d).select(F.col("user_id").alias("g"), "idx", "val"), "g"),
        f"WITH {E}, k AS (SELECT a.user_id AS g, a.idx, a.val, max(b.idx) FILTER (WHERE b.idx<a.idx AND b.val<=a.val) AS l, min(b.idx) FILTER (WHERE b.idx>a.idx AND b.val<a.val) AS r FROM e a JOIN e b ON a.user_id=b.user_id GROUP BY a.user_id, a.idx, a.val) SELECT g, k.idx, CASE WHEN l IS NULL THEN coalesce(r, k.idx) WHEN r IS NULL THEN l WHEN x.val>y.val THEN l ELSE r END AS parent FROM k LEFT JOIN e x ON x.idx=l LEFT JOIN e y ON y.idx=r",
    ),
    "str9_find_all": (lambda s, d: T.find_all(docs(s, d), "a"), "SELECT doc_id, unnest(list_transform(list_filter(list_zip(string_split(text, ''), range(0, length(text))), lambda x: x[1]='a'), lambda x: x[2]))::BIGINT AS at FROM documents WHERE contains(text, 'a')"),
    "s12_is_partitioned": (lambda s, d: Q.is_partitioned(vals(s, d), F.col("idx") < 500).withColumn("by_value", Q.is_partitioned(vals(s, d), F.col("val") < 5000).first()[0] == F.lit(True)), f"WITH {E} SELECT true AS partitioned, coalesce((SELECT max(idx) FROM e WHERE val<5000) < (SELECT min(idx) FROM e WHERE NOT val<5000), true) AS by_value"),
    "f17_for_each": (lambda s, d: _added_up(s, vals(s, d)), f"WITH {E} SELECT sum(val)::BIGINT AS value FROM e"),
    "agg9_table": (
        lambda s, d: HashTable.of(table_rows(s, d, 0)).insert(table_rows(s, d, 1)).update(table_rows(s, d, 2)).delete(s.range(0, 1000, 10).select(F.col("id").alias("key"))).indexed(),
        f"WITH {E}, r AS (SELECT user_id AS key, val, idx AS pos, idx%3 AS k FROM e), a AS (SELECT key, min_by(val, pos) AS val FROM r WHERE k=0 GROUP BY key), b AS (SELECT key, min_by(val, pos) AS val FROM r WHERE k=1 AND key NOT IN (SELECT key FROM a) GROUP BY key), c AS (SELECT key, max(val) AS val FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT key, val FROM r WHERE k=2) GROUP BY key) SELECT key, val, row_number() OVER (ORDER BY key)-1 AS index FROM c WHERE NOT (key<1000 AND key%10=0)",
    ),
    "agg9_find": (lambda s, d: HashTable.of(table_rows(s, d, 0)).find(s.range(60).select(F.col("id").alias("key"))), f"WITH {E}, a AS (SELECT user_id AS key, min_by(val, idx) AS val FROM e WHERE idx%3=0 GROUP BY user_id) SELECT b.range AS key, a.val FROM range(60) b LEFT JOIN a ON a.key=b.range"),
    "agg12_counters": (lambda s, d: Counters(s.createDataFrame([], "key long, val long")).insert(table_rows(s, d, 0)).insert(table_rows(s, d, 1)).entries(F.col("val") % 2 == 0), f"WITH {E} SELECT user_id AS key, sum(val)::BIGINT AS val FROM e WHERE idx%3<2 GROUP BY user_id HAVING sum(val)%2=0"),
    "agg13_new_keys": (lambda s, d: HashSet.of(table_rows(s, d, 0)).insert(table_rows(s, d, 1))[1], f"WITH {E} SELECT DISTINCT user_id AS key FROM e WHERE idx%3=1 AND user_id NOT IN (SELECT user_id FROM e WHERE idx%3=0)"),
    "agg13_contains": (lambda s, d: HashSet.of(table_rows(s, d, 0)).contains(s.range(60).select(F.col("id").alias("key"))), f"WITH {E} SELECT b.range AS key, b.range IN (SELECT user_id FROM e WHERE idx%3=0) AS found FROM range(60) b"),
    "str9_find": (lambda s, d: T.find(docs(s, d), "tion the"), "SELECT doc_id, instr(text, 'tion the')-1 AS at FROM documents WHERE instr(text, 'tion the')>0"),
    "io12_characters": (lambda s, d: io.characters(docs(s, d), start=5, end=25), "SELECT doc_id, i-1 AS idx, substr(substr(text, 6, 20), i::INT, 1) AS val FROM (SELECT doc_id, text, unnest(range(1, length(substr(text, 6, 20))+1)) AS i FROM documents)"),
    "io16_mix": (lambda s, d: vals(s, d).select("idx", priority("idx").alias("h")), f"WITH {E} SELECT idx, (idx*2654435761)%4294967296 AS h FROM e"),
}


def _all_rounds(s, d):
    from snapgraph.operators.algorithms import deterministic_reservations

    return deterministic_reservations(table(s, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("resource")))
