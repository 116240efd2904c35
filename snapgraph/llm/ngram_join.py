"""Jaccard self-join of word-shingle sets by a token-group matrix; the result is the components of its links.

1. Equal sets become one class; its first document stands for it.
2. The document frequency of every shingle (packed exchange) orders the shingles
   of each set, rare ones first.  Two sets with similarity t share a shingle among
   the first n - ceil(t n) + 1 of each (prefix), so only those that other
   classes hold too are listed: rows (token, set).
3. Partition: each set goes to the group of the leader (smallest set of a
   token's list) that most of its tokens name.  Groups over ``GROUP_BYTES`` are
   split, the leader in each piece.  A group keeps its sets, its token union and
   the links inside it.
4. Matrix: one row per (token, group), with the span of the components that the
   group's sets of the token are in.  A set asks a foreign group only if a listed
   token of the set is in it and a set of another component may hold it there; the
   group counts the set's overlap with its token union first and is opened only
   if that can reach ceil(t n).  A group with many askers is copied, one copy for
   each ASKS of them.
5. Components of all links.

Links inside a component that is already joined are not listed: the smallest id
reachable by links is the same.  Null, empty or wordless text: no set, its own
component.  Texts of fewer words than a shingle: the whole sequence is the one
shingle.  Repeated rows: equal sets.  Null doc_id: has its size, no component.
Empty table: no rows.  Shingles are 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.common import answered, components, drop, forget, gram_hashes, in_order, lower_table, numbered, pack_sorted, parts_for, prefix_sums, routed_batch, routes, span_hashes, spaced_words, sum_bytes, text_blocks, unpack_small, unpack_sorted, words_of, written

WORDS = 4
#: Linked: 100 * intersection >= PERCENT * union, in whole numbers.
PERCENT = 85
GROUP_BYTES = 6 << 20
#: Sets that are looked up in one copy of an opened group.
ASKS = 1024
#: Small blocks: a task holds the shingles of one, and the answers to them.
BLOCK = 1 << 20
SIZES = "block long, k int, doc_id long, n_shingles long, set_id long"


def shingle_sets(data: np.ndarray, ends: np.ndarray, words: int):
    """The ascending distinct shingles of each text of a block."""
    low = lower_table()[data]
    starts, stops = words_of(low, spaced_words())
    hashes = span_hashes(prefix_sums(low), starts, stops)
    grams = gram_hashes(hashes, words)
    upto = np.searchsorted(starts, ends)
    first = 0
    for last in upto.tolist():
        n = last - first
        if n >= words:
            yield np.unique(grams[first : last - words + 1])
        elif n:
            yield gram_hashes(hashes[first:last], n)
        else:
            yield np.zeros(0, np.uint64)
        first = last


def set_id(keys: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(n, percent: int):
    """Least overlap that a set of n needs: ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def linked(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def row_sets(row: dict, words: int) -> list[np.ndarray]:
    return list(shingle_sets(np.frombuffer(row["text"], np.uint8), np.array(row["ends"], np.int64), words))


def sizes(blocks: DataFrame, words: int = WORDS) -> DataFrame:
    """block, k (place in the block), doc_id, n_shingles, set_id (null for an empty set)."""

    def run(batches):
        forget()
        for batch in batches:
            for j in range(batch.num_rows):
                row = {n: batch.column(n)[j].as_py() for n in ("block", "ids", "ends", "text")}
                sets = row_sets(row, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(sets), pa.int64()), pa.array(range(len(sets)), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())],
                    names=["block", "k", "doc_id", "n_shingles", "set_id"],
                )

    return blocks.mapInArrow(run, SIZES)


class Joined:
    """Disjoint sets over 0..n-1; join() tells whether it joined two."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def local_components(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set of a group the place of the first one of its component; the first set of all is the group's leader."""
    n = np.array([len(s) for s in sets], np.int64)
    open_ones, joined_sets = [], Joined(len(sets))
    for k in range(1, len(sets)):
        if linked(shared(sets[k], sets[0]), n[k], n[0], percent):
            joined_sets.join(0, k)
        else:
            open_ones.append(k)
    if open_ones and len(sets) > 2:
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), n)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        for k in open_ones:
            low, high = np.searchsorted(tokens, sets[k]), np.searchsorted(tokens, sets[k], side="right")
            lengths = high - low
            at = np.repeat(low - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            overlap = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero(linked(overlap, n[k], n, percent) & (overlap > 0)).tolist():
                joined_sets.join(k, j)
    return [joined_sets.root(k) for k in range(len(sets))]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _table(rows: list[tuple], names: list[str], kinds: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def joined_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    blocks, path = written(text_blocks(docs, BLOCK), "blocks")
    light, _ = written(sizes(blocks, words), "sizes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "block", "k")).alias("first")
    classes, _ = written(light.where("set_id is not null").groupBy("set_id").agg(first, F.count(F.lit(1)).alias("copies")).select("set_id", "first.doc_id", "first.block", "first.k", "copies"), "classes")
    state, links = set_links(blocks, path, classes, words, percent)
    return labelled(light, classes, state, links)


def labelled(light: DataFrame, classes: DataFrame, state: DataFrame, links: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component; state: components inside groups, links: between those."""
    nodes = components(links)
    joined = state.join(nodes, state["c"] == nodes["node"], "left").select("x", F.coalesce("component", "c").alias("component"))
    of_set = classes.join(joined, classes["set_id"] == joined["x"], "left").select("set_id", "doc_id", F.coalesce("component", "set_id").alias("component"))
    smallest = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named, _ = written(of_set.join(smallest, "component").select(F.col("set_id").alias("s"), "component_id"), "named")
    return light.join(named, light["set_id"] == named["s"], "left").select("doc_id", "n_shingles", F.when(F.col("set_id").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def set_links(blocks: DataFrame, blocks_path: str, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(x, c): the component that each listed set has inside its group, and (a, b): links between such components that join all similar classes."""
    spark = blocks.sparkSession
    paths: list[str] = []

    def step(df: DataFrame, tag: str) -> DataFrame:
        df, path = written(df, tag)
        paths.append(path)
        return df

    total = blocks.agg(F.sum(F.length("text"))).first()[0] or 0
    # Frequencies only order shingles, so their names need just so many bits that few unlike ones meet.
    bits = min(64, max(32, int(total // 6 + 1).bit_length() + 11))
    cut = np.uint64(64 - bits)
    parts = parts_for(total * 8 // 6)

    def names_of(sets: list[np.ndarray]):
        return np.unique(np.concatenate(sets) >> cut, return_counts=True)

    def send(batches):
        forget()
        for batch in batches:
            for j in range(batch.num_rows):
                row = {n: batch.column(n)[j].as_py() for n in ("block", "ends", "text")}
                keys, counts = names_of(row_sets(row, words))
                rows = list(routes(row["block"], 0, keys, counts, parts, bits))
                if rows:
                    yield routed_batch(rows)

    replies = step(answered(blocks.mapInArrow(send, "part int, block long, space int, n int, keys binary, counts binary"), sum_bytes), "degrees")
    # The first document of each class, as rows of the same shape: its place and its class's copies.
    firsts = classes.select("block", F.col("k").alias("part"), F.lit(1).alias("space"), F.col("copies").cast("int").alias("n"), F.lit(None).cast("binary").alias("reply"))

    def listed(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        """Of the first documents, those with a listed prefix token: set id, n, shingles, and those tokens."""
        forget()
        rows = []
        for row in block.to_pylist():
            sets = row_sets(row, words)
            keys, _ = names_of(sets)
            ours = answers.filter(pc.equal(answers.column("space"), 1))
            degree = in_order(answers, 0, unpack_small)
            # 0 for frequency 1, else how many bits the frequency has: fine enough an order.
            octave = np.ceil(np.log2(np.maximum(degree, 1))).astype(np.uint8)
            for k, copies in zip(ours.column("part").to_pylist(), ours.column("n").to_pylist()):
                own = sets[k]
                n = len(own)
                at = np.searchsorted(keys, own >> cut)
                prefix = np.lexsort((own, octave[at]))[: n - need(n, percent) + 1]
                tokens = own[prefix[degree[at[prefix]] > copies]]
                if len(tokens):
                    rows.append((set_id(own), n, own.tobytes(), tokens.view(np.int64)))
        return _table(rows, ["x", "n", "keys", "tokens"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())])

    active = step(blocks.groupBy("block").cogroup(replies.unionByName(firsts).groupBy("block")).applyInArrow(listed, "x long, n long, keys binary, tokens array<long>"), "active")
    drop(spark, blocks_path)
    drop(spark, paths.pop(0))
    tokens = step(active.select("x", F.explode("tokens").alias("token")), "tokens")

    # Leaders and groups.
    leaders = tokens.groupBy("token").agg(F.min("x").alias("leader"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("token", "leader")
    votes = tokens.join(leaders, "token").groupBy("x", "leader").agg(F.count(F.lit(1)).alias("votes"))
    chosen = votes.groupBy("x").agg(F.max(F.struct("votes", (-F.col("leader")).alias("minus"))).alias("best")).select("x", (-F.col("best.minus")).alias("leader"))
    leads = chosen.select("leader").distinct().select(F.col("leader").alias("x"), F.col("leader"))
    member = step(leads.union(chosen.join(leads.select("x"), "x", "left_anti")), "member")
    loads = member.join(active.select("x", F.length("keys").alias("bytes")).dropDuplicates(["x"]), "x").groupBy("leader").agg(F.sum("bytes").alias("bytes"))
    pieces = loads.select("leader", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias("pieces"))
    placed = member.join(pieces, "leader").select("x", "leader", F.explode(F.when(F.col("x") == F.col("leader"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.hash("x"), F.col("pieces"))))).alias("piece"))
    placed = step(placed.withColumn("g", F.xxhash64("leader", "piece")), "placed")

    def group(key, table):
        forget()
        ids, cells, lead = (table.column(c).to_pylist() for c in ("x", "keys", "leader"))
        order = sorted(range(len(ids)), key=lambda k: (ids[k] != lead[k], ids[k]))
        order = [k for j, k in enumerate(order) if not j or ids[k] != ids[order[j - 1]]]
        sets = [np.frombuffer(cells[k], np.uint64) for k in order]
        names = [ids[k] for k in order]
        # Named by its first set, a component is the same in all pieces: only the leader is in several.
        parts = [names[k] for k in local_components(sets, percent)]
        union = np.unique(np.concatenate(sets))
        return _table(
            [(key[0].as_py(), lead[0], table.column("piece")[0].as_py(), names, parts, [len(s) for s in sets], np.concatenate(sets).tobytes(), len(union), pack_sorted(union))],
            ["g", "leader", "piece", "ids", "parts", "n", "sets", "n_union", "union"],
            [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary()],
        )

    schema = "g long, leader long, piece int, ids array<long>, parts array<long>, n array<long>, sets binary, n_union long, union binary"
    groups = step(placed.join(active.select("x", "keys"), "x").groupBy("g").applyInArrow(group, schema), "groups")

    # Token-group matrix: what a token still has to join.  A cell tells the span of the components that the
    # group's sets with the token are in, so it is one row however many of its sets are not joined yet.
    inner = groups.select("g", "leader", "piece", F.explode(F.arrays_zip("ids", "parts")).alias("s"))
    state, _ = written(inner.select("g", "leader", "piece", F.col("s.ids").alias("x"), F.col("s.parts").alias("c")).where("x <> leader or piece = 0").select("x", "g", "c"), "state")
    spots = step(tokens.join(state, "x"), "spots")
    cells = step(spots.groupBy("token", "g").agg(F.min("c").alias("low"), F.max("c").alias("high")), "cells")
    open_tokens = cells.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("groups")).where("low <> high and groups > 1").select("token")
    # The component that most of a token's sets are in does not ask: the others ask it.
    shares = spots.join(open_tokens, "token", "left_semi").groupBy("token", "c").agg(F.count(F.lit(1)).alias("sets"))
    main = step(shares.groupBy("token").agg(F.max(F.struct("sets", "c")).alias("m")).select("token", F.col("m.c").alias("main")), "main")
    asking = spots.join(main, "token").where("c <> main").select("token", "x", "c", "main", F.col("g").alias("own"))
    asked = asking.join(cells, "token").where("g <> own and (high > c or low <= main and main <= high)").select("x", "c", "g").distinct()
    asked = step(asked, "asked")
    shares = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("shares"))
    queries = asked.join(shares, "g").join(active.select("x", "keys").dropDuplicates(["x"]), "x").select("g", F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("share"), "x", "c", "keys")
    opened = groups.join(shares, "g").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def open_group(key, asks: pa.Table, held: pa.Table) -> pa.Table:
        forget()
        found = []
        for row in held.to_pylist():
            union = unpack_sorted(row["union"], row["n_union"])
            n = np.array(row["n"], np.int64)
            bounds = np.concatenate([[0], np.cumsum(n)])
            every = np.frombuffer(row["sets"], np.uint64)
            # One link of a set to each of the group's own components is enough.
            for x, c, cell in zip(*(asks.column(name).to_pylist() for name in ("x", "c", "keys"))):
                own = np.frombuffer(cell, np.uint64)
                if shared(own, union) < need(len(own), percent):
                    continue
                met = {c}
                for k in np.flatnonzero((100 * n >= percent * len(own)) & (100 * len(own) >= percent * n)).tolist():
                    part = row["parts"][k]
                    if part not in met and linked(shared(own, every[bounds[k] : bounds[k + 1]]), len(own), int(n[k]), percent):
                        met.add(part)
                        found.append((c, part))
        return _table(found, ["a", "b"], [pa.int64(), pa.int64()])

    links, _ = written(queries.groupBy("g", "share").cogroup(opened.groupBy("g", "share")).applyInArrow(open_group, "a long, b long").distinct(), "links")
    for path in paths:
        drop(spark, path)
    return state.select("x", "c"), links


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, of one document of each component: the smallest doc_id, then the first row.  Texts without words stay."""
    rows, _ = numbered(docs)
    found = joined_components(rows.select(F.col("row").alias("doc_id"), F.col("d.text").alias("text")), words, percent)
    found, _ = written(found.select(F.col("doc_id").alias("row"), "component_id"), "found")
    ranked = found.join(rows.select("row", "d.doc_id"), "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("first"))
    return rows.join(ranked.select(F.col("first.row").alias("row")), "row", "left_semi").select("d.*")


#: The same rows in DuckDB, for tables small enough to list the pairs.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i::INT, (i + 3)::INT), ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT d.doc_id, count(s.g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
k AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, k.y FROM r JOIN k ON k.x = r.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
