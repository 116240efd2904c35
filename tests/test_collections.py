import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from snapgraph.operators import nbrs as N
from snapgraph.operators import sequences as Q
from snapgraph.operators import text as T
from snapgraph.operators.algorithms import deterministic_reservations
from snapgraph.operators.ordered import OrderedMap
from snapgraph.operators.tables import Counters, HashSet, HashTable
from snapgraph.plans.queries_maps import QUERIES as MAPS
from snapgraph.plans.queries_seq import QUERIES, suffix_text


def rows(df):
    return sorted(map(tuple, df.collect()))


def seq(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "idx long, val long")


def omap(spark, items):
    return OrderedMap(spark.createDataFrame(items, "key long, val long"))


def test_near_matches_brute_force(spark):
    rng = random.Random(2)
    entries = {k: k * 10 for k in rng.sample(range(300), 60)}
    asked = list(range(-2, 303, 5))
    m = omap(spark, list(entries.items()))
    keys = spark.createDataFrame([(k,) for k in asked], "key long")
    pick = {"next": lambda q: min((k for k in entries if k > q), default=None), "previous": lambda q: max((k for k in entries if k < q), default=None), "floor": lambda q: max((k for k in entries if k <= q), default=None)}
    for how, best in pick.items():
        got = {r[0]: r[1] for r in m.near(keys, how).collect()}
        assert got == {q: best(q) for q in asked}, how


def test_map_laws(spark):
    a, b = omap(spark, [(1, 1), (2, 2), (3, 3)]), omap(spark, [(2, 20), (4, 40)])
    assert rows(a.union(b).rows) == [(1, 1), (2, 20), (3, 3), (4, 40)]
    assert rows(a.intersect(b, lambda x, y: x + y).rows) == [(2, 22)]
    assert rows(a.difference(b).rows) == [(1, 1), (3, 3)]
    assert a.same_keys(a.map(F.col("val") + 1)) and not a.equals(a.map(F.col("val") + 1))
    low, high, at = a.split(2)
    assert rows(low.joined(high).rows) == [(1, 1), (3, 3)] and rows(at) == [(2, 2)]
    assert rows(a.multi_insert(spark.createDataFrame([(9, 1, 0), (9, 2, 1)], "key long, val long, pos long")).rows)[-1] == (9, 2)


def test_scans_and_packs_against_python(spark):
    rng = random.Random(3)
    v = [rng.randrange(-50, 50) for _ in range(200)]
    a = seq(spark, v)
    assert [r[2] for r in rows(Q.scan(a))] == [sum(v[:k]) for k in range(200)]
    assert [r[2] for r in rows(Q.scan(a, "max", True))] == [max(v[: k + 1]) for k in range(200)]
    assert [r[1] for r in rows(Q.pack(a, F.col("val") > 0))] == [x for x in v if x > 0]
    best = max(sum(v[i:j]) for i in range(200) for j in range(i + 1, 201))
    assert Q.best_run(a).first()[0] == best
    assert [r[1] for r in rows(Q.rotated(a, 7))] == v[-7:] + v[:-7]
    assert [r[1] for r in rows(Q.reversed_(a))] == v[::-1]


def test_searches(spark):
    a, b = seq(spark, [1, 2, 3, 1, 2, 4]), seq(spark, [1, 2, 3, 1])
    assert Q.mismatch(a, b).first()[0] == 4
    assert not Q.equal(a, b).first()[0] and Q.equal(a, a).first()[0]
    assert Q.lexicographical_less(b, a).first()[0] and not Q.lexicographical_less(a, b).first()[0] and not Q.lexicographical_less(a, a).first()[0]
    assert Q.search(a, [1, 2]).first()[0] == 0 and Q.search(a, [1, 2], last=True).first()[0] == 3
    assert Q.find_if(a, F.col("val") > 9).first()[0] == 6
    assert tuple(Q.extrema(a).first()) == (0, 5)
    empty = a.limit(0)
    assert tuple(Q.quantifiers(empty, F.col("val") > 0).first()) == (True, False, True)
    assert Q.find_if(empty, F.col("val") > 0).first()[0] == 0


def test_range_min_and_reservoirs(spark):
    rng = random.Random(5)
    v = [rng.randrange(9) for _ in range(300)]
    q = [(rng.randrange(200), rng.randrange(200, 300)) for _ in range(40)]
    got = {(r[0], r[1]): r[2] for r in Q.range_min(seq(spark, v), spark.createDataFrame(q, "low long, high long"), 16).collect()}
    assert got == {(a, b): min(range(a, b + 1), key=lambda k: (v[k], k)) for a, b in q}


def test_suffix_structures(spark):
    for word in ("aabcabd", "bacacdaba", "a", "aaaa"):
        chars = spark.createDataFrame([(k, c) for k, c in enumerate(word)], "idx long, val string")
        order = sorted(range(len(word)), key=lambda k: word[k:])
        ranks = T.suffix_array(chars)
        assert {r[0]: r[1] for r in ranks.collect()} == {k: r for r, k in enumerate(order)}
        want = []
        for r in range(1, len(word)):
            x, y = word[order[r - 1] :], word[order[r] :]
            want.append((r, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))))
        assert rows(T.lcp(chars, ranks)) == want


def test_ordered_fold_of_all_keys(spark, tmp_path):
    rng = random.Random(10)
    balances = {k: rng.randrange(-99_999, 999_999) for k in rng.sample(range(10_000), 500)}
    spark.createDataFrame([(k, v / 100) for k, v in balances.items()], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    want = 0
    for _, v in sorted(balances.items()):
        want = (want * 31 + v) % 1_000_003
    assert rows(MAPS["m14_ordered_fold"][0](spark, str(tmp_path))) == [(want,)]
    few = OrderedMap(spark.createDataFrame([(1, 5), (2, -7)], "key long, val long"))
    assert rows(few.affine_fold(3, 101, 4)) == [(((4 * 3 + 5) * 3 - 7) % 101,)]
    assert rows(few.up_to(0).affine_fold(3, 101, 4)) == [(4,)]


def test_ranges_against_brute_force(spark):
    rng = random.Random(13)
    entries = {k: rng.randrange(-50, 50) for k in rng.sample(range(200), 70)}
    asked = sorted({(rng.randrange(-5, 205), rng.randrange(-5, 205)) for _ in range(60)})
    got = rows(omap(spark, list(entries.items())).aug_ranges(spark.createDataFrame(asked, "low long, high long")))
    inside = lambda a, b: [v for k, v in entries.items() if a <= k <= b]
    assert got == [(a, b, sum(inside(a, b)), len(inside(a, b))) for a, b in asked]


def test_sorted_entries_are_checked(spark):
    sorted_ones = spark.createDataFrame([(0, 2, 5), (1, 4, 6)], "idx long, key long, val long")
    assert rows(omap(spark, [(2, 1), (3, 1)]).multi_insert_sorted(sorted_ones).rows) == [(2, 5), (3, 1), (4, 6)]
    with pytest.raises(ValueError):
        OrderedMap.from_sorted(sorted_ones.withColumn("key", -F.col("key")))


def test_tables(spark):
    entries = lambda items: spark.createDataFrame(items, "key long, val long, pos long")
    keys = lambda *items: spark.createDataFrame([(k,) for k in items], "key long")
    t = HashTable.of(entries([(1, 10, 1), (1, 11, 0), (2, 20, 0), (None, 5, 0)]))
    assert rows(t.rows) == [(1, 11), (2, 20)]
    assert rows(t.insert(entries([(2, 99, 0), (3, 30, 0)])).rows) == [(1, 11), (2, 20), (3, 30)]
    assert rows(t.update(entries([(2, 99, 0), (1, 3, 0)])).rows) == [(1, 11), (2, 99)]
    assert rows(t.delete(keys(1, 7)).indexed()) == [(2, 20, 0)]
    assert sorted(map(tuple, t.find(keys(2, 5)).collect())) == [(2, 20), (5, None)] and t.count().first()[0] == 2
    bigger, new = HashSet.of(keys(1, 1, 2)).insert(keys(2, 3, 3))
    assert rows(bigger.entries()) == [(1,), (2,), (3,)] and rows(new) == [(3,)] and rows(bigger.contains(keys(3, 4))) == [(3, True), (4, False)] and bigger.clear().entries().isEmpty()
    c = Counters(entries([]).select("key", "val")).insert(entries([(1, 2, 0), (1, 3, 0)])).insert(entries([(1, 4, 0), (2, 1, 0)]))
    assert rows(c.entries()) == [(1, 9), (2, 1)] and rows(c.find(keys(2, 8))) == [(2, 1), (8, 0)] and rows(c.map(F.col("val") * 2).entries(F.col("val") > 5)) == [(1, 18)]


def test_all_places_of_a_pattern(spark):
    values = ["aaaa", "abab a", "", None, "b", "xa", "a.a\\Ea", "aa"]
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    for pattern in ("a", "aa", "aba", ".", "\\E"):
        want = [(d, k) for d, t in enumerate(values) for k in range(len(t or "")) if t.startswith(pattern, k)]
        assert rows(T.find_all(docs, pattern)) == want, pattern
    with pytest.raises(ValueError):
        T.find_all(docs, "")


def test_partitioned_and_for_each(spark):
    a = seq(spark, [3, 1, 9, 8])
    assert Q.is_partitioned(a, F.col("val") < 5).first()[0] and not Q.is_partitioned(a, F.col("val") > 5).first()[0]
    assert Q.is_partitioned(a.limit(0), F.col("val") > 5).first()[0]


def documents_at(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_partitions_and_characters_of_all_documents(spark, tmp_path):
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts[5], texts[7], texts[9], texts[11] = None, "", " ", "  a"
    at = documents_at(spark, tmp_path, texts)
    want = []
    for d, t in enumerate(t or "" for t in texts):
        starts = [k for k in range(len(t)) if k == 0 or t[k] == " "]
        want += [(d, p, a, b - 1) for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(t)]))]
    assert rows(QUERIES["str4_partition_at"][0](spark, at).select("doc_id", "part", "first", "last")) == want
    assert rows(QUERIES["io12_characters"][0](spark, at)) == [(d, k, c) for d, t in enumerate(texts) for k, c in enumerate((t or "")[5:25])]


def test_reservations_return_every_round(spark, tmp_path):
    rng = random.Random(12)
    claims = [(rng.randrange(900), rng.randrange(15)) for _ in range(600)]
    spark.createDataFrame(claims, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    left, want, number = {}, [], 0
    for i, r in claims:
        left.setdefault(i, set()).add(r)
    while left:
        holder = {}
        for i in sorted(left, reverse=True):
            holder.update((r, i) for r in left[i])
        won = [i for i in left if all(holder[r] == i for r in left[i])]
        want += [(i, number) for i in won]
        left, number = {i: c for i, c in left.items() if i not in won}, number + 1
    assert rows(QUERIES["p17_reservations"][0](spark, str(tmp_path))) == sorted(want)
    assert rows(deterministic_reservations(spark.createDataFrame(claims, "i long, resource long"), most=250)) == sorted(want)


def test_suffix_array_of_whole_documents(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("aBé ") for _ in range(rng.randrange(1, 150))) for _ in range(12)]
    texts[5], texts[7], texts[9] = None, "", texts[3]
    whole = "".join(t or "" for t in texts).lower()
    order = sorted(range(len(whole)), key=lambda k: whole[k:].encode())
    got = QUERIES["str6_suffix_array"][0](spark, documents_at(spark, tmp_path, texts))
    assert rows(got.select("rank", "idx")) == list(enumerate(order))


def test_suffix_array_moves_rows_of_many_places(spark, monkeypatch):
    """Ranks travel as arrays, and a group of equal prefixes over several ranges of keys: a row a suffix took too long."""
    rng = random.Random(5)
    base = "".join(rng.choice("abé 中") for _ in range(150))
    whole = base + "x" + base + "ab" * 30 + "a" * 60
    chars = spark.createDataFrame(list(enumerate(whole)), "idx long, val string")
    order = sorted(range(len(whole)), key=lambda k: whole[k:].encode())
    monkeypatch.setattr(T, "SPAN", 64)
    monkeypatch.setattr(T, "KEYS", 40)
    assert rows(T.suffix_array(chars).select("rank", "idx")) == list(enumerate(order))
    assert T.suffix_array(chars.limit(0)).count() == 0


def test_suffix_array_takes_whole_texts_and_wide_ranks(spark, tmp_path, monkeypatch):
    """Texts reach their blocks in pieces: a row a character took an executor's memory in sorting them."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé 中") for _ in range(rng.randrange(1, 150))) for _ in range(9)] + ["ab" * 200]
    texts += texts[2:5]
    pieces = suffix_text(spark, documents_at(spark, tmp_path, texts))
    starts = [sum(map(len, texts[:k])) for k in range(len(texts))]
    assert rows(pieces) == list(zip(starts, texts))
    whole = "".join(texts)
    order = sorted(range(len(whole)), key=lambda k: whole[k:].encode())
    for name, value in (("SPAN", 64), ("KEYS", 40), ("DEALT", 100)):
        monkeypatch.setattr(T, name, value)
    for narrow in (T.NARROW, 1):
        monkeypatch.setattr(T, "NARROW", narrow)
        assert rows(T.suffix_array(pieces).select("rank", "idx")) == list(enumerate(order))


def test_suffix_array_leaves_the_writer_few_rows(spark, monkeypatch):
    """The writer held a hundred rows, of some megabytes each, before it looked at their size."""
    monkeypatch.setattr(T, "SPAN", 64)
    held = []

    def looked(df, *most, stored=T.stored):
        got, path = stored(df, *most)
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file://')}/*.parquet")]
        held.extend(m.row_group(k).num_rows for m in files for k in range(m.num_row_groups))
        return got, path

    monkeypatch.setattr(T, "stored", looked)
    word = "".join(random.Random(13).choice("abc") for _ in range(64 * 60))
    chars = spark.createDataFrame(list(enumerate(word)), "idx long, val string")
    assert T.suffix_array(chars).count() == len(word)
    assert sum(held) >= 180 and max(held) <= 8


def test_lcp_of_whole_documents_takes_few_rounds(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    long_one = "".join(rng.choice("aBé ") for _ in range(200))
    whole = (long_one + "x" + long_one).lower()
    cuts = []
    monkeypatch.setattr(T, "cut", lambda df, cut=T.cut: cuts.append(1) or cut(df))
    got = rows(QUERIES["str7_lcp"][0](spark, documents_at(spark, tmp_path, [long_one, "X", long_one])).select("rank", "lcp"))
    order, want = sorted(range(len(whole)), key=lambda k: whole[k:].encode()), []
    for r in range(1, len(whole)):
        x, y = whole[order[r - 1] :], whole[order[r] :]
        want.append((r, next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))))
    assert got == want and max(n for _, n in want) == 200
    assert len(cuts) < 40  # one for each character before


def test_lcp_moves_rows_of_many_places(spark, monkeypatch):
    """Lengths travel as arrays, one comparison for each run of places; repeats reach over many blocks: a row a suffix and length took too long."""
    rng = random.Random(6)
    base = "".join(rng.choice("abé 中") for _ in range(300))
    monkeypatch.setattr(T, "SPAN", 64)
    monkeypatch.setattr(T, "KEYS", 40)
    monkeypatch.setattr(T, "NEAR", 2)
    for whole in (base + "x" + base + "ab" * 30 + "a" * 60, "a" * 130, "".join(map(chr, range(0x4E00, 0x4E00 + 300)))):
        chars = spark.createDataFrame(list(enumerate(whole)), "idx long, val string")
        order = sorted(range(len(whole)), key=lambda k: whole[k:].encode())
        shared = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
        assert rows(T.lcp(chars)) == [(r, shared(whole[order[r - 1] :], whole[order[r] :])) for r in range(1, len(whole))]
    assert T.lcp(chars.limit(0)).count() == 0


def test_lcp_takes_whole_texts_and_wide_ranks(spark, tmp_path, monkeypatch):
    """Texts reach their blocks in pieces: a row a character took an executor's memory in sorting them."""
    rng = random.Random(14)
    texts = ["".join(rng.choice("abé 中") for _ in range(rng.randrange(1, 150))) for _ in range(9)] + ["ab" * 200]
    texts += texts[2:5]
    pieces = suffix_text(spark, documents_at(spark, tmp_path, texts))
    assert pieces.count() == len(texts)
    whole = "".join(texts)
    order = sorted(range(len(whole)), key=lambda k: whole[k:].encode())
    for name, value in (("SPAN", 64), ("KEYS", 40), ("NEAR", 2)):
        monkeypatch.setattr(T, name, value)
    shared = lambda x, y: next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    want = [(r, shared(whole[order[r - 1] :], whole[order[r] :])) for r in range(1, len(whole))]
    for narrow in (T.NARROW, 1):
        monkeypatch.setattr(T, "NARROW", narrow)
        assert rows(T.lcp(pieces)) == want


def test_cartesian_tree_and_tokens(spark):
    got = rows(T.cartesian_tree(spark.createDataFrame([(1, k, v) for k, v in enumerate([3, 1, 2, 1, 5])], "g long, idx long, val long"), "g"))
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 3), (1, 3, 1), (1, 4, 3)]
    docs = spark.createDataFrame([(1, " ab\tc  d"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(T.tokens(docs)) == [(1, 0, 1, "ab"), (1, 1, 4, "c"), (1, 2, 7, "d")]


def test_neighbour_sets_and_arrays(spark):
    a = spark.createDataFrame([(1, 2), (1, 5), (2, 9)], "src long, dst long")
    b = spark.createDataFrame([(1, 5), (1, 7)], "src long, dst long")
    assert rows(N.union(a, b)) == [(1, 2), (1, 5), (1, 7), (2, 9)]
    assert rows(N.difference(a, b)) == [(1, 2), (2, 9)]
    assert rows(N.intersect_count(a, b)) == [(1, 1), (2, 0)]
    arrays = spark.createDataFrame([([1, 3], [3, 4])], "a array<int>, b array<int>")
    r = arrays.select(N.arr_union(F.col("a"), F.col("b")), N.arr_difference(F.col("a"), F.col("b")), N.arr_intersect_count(F.col("a"), F.col("b"))).first()
    assert tuple(r) == ([1, 3, 4], [1], 1)
