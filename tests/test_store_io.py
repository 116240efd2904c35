import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapgraph.plans.graph import Graph
from snapgraph.plans.store import Conflict, GraphStore
from snapgraph.sources import codec, io
from snapgraph.streaming import stream


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**31), st.sets(st.integers(0, 2**31), max_size=50))
def test_codec_round_trip(source, neighbours):
    own = sorted(neighbours)
    cell = codec.encode(source, own)
    assert codec.decode(source, len(own), cell) == (own, len(cell))
    assert codec.decode_blocks(source, codec.encode_blocks(source, own)) == own


def test_codec_edges_of_the_code():
    for gaps in ([1, 127, 128, 16383, 16384, 2**31 - 1],):
        for first in (0, 5, 70, 3000):
            own = [first]
            for g in gaps:
                own.append(own[-1] + g)
            assert codec.decode(5, len(own), codec.encode(5, own))[0] == own
    many = list(range(0, 9000, 3))
    assert codec.decode_blocks(7, codec.encode_blocks(7, many)) == many


def test_text_files_are_read_in_their_order(spark, tmp_path):
    """Spark deals large files, and full splits, before small ones; part 100000 comes after part 99999."""
    g = Graph.from_pairs(spark.createDataFrame([(k, k * 7 % 40) for k in range(40)], "a long, b long"))
    io.write_adjacency(g, str(tmp_path / "adj"))
    words = [w for f in sorted((tmp_path / "adj").glob("part-*")) for w in f.read_text().split()]
    (tmp_path / "dealt").mkdir()
    for name, own in (("part-00000", words[:2]), ("part-99999", words[2:9]), ("part-100000", words[9:])):
        (tmp_path / "dealt" / f"{name}-x.txt").write_text("\n".join(own) + "\n")
    want = rows(g.edges.orderBy("src", "dst").select("src", "dst"))
    for size in ("128m", "40"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            n, edges = io.read_csr(spark, str(tmp_path / "dealt"))
            got = rows(edges.select("place", "src", "dst"))
            assert rows(io.read_adjacency(spark, str(tmp_path / "dealt")).edges) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [r[0] for r in got] == list(range(len(want))) and [r[1:] for r in got] == want


def test_files_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    g = Graph.from_pairs(spark.createDataFrame([(rng.randrange(30), rng.randrange(30)) for _ in range(60)], "a long, b long"))
    io.write_adjacency(g, str(tmp_path / "adj"))
    assert rows(io.read_adjacency(spark, str(tmp_path / "adj")).edges) == rows(g.edges)
    for fmt in ("byte", "bytepda"):
        io.write_compressed(g, str(tmp_path / fmt), fmt == "bytepda")
        for path in (str(tmp_path / fmt), f"file://{tmp_path / fmt}", f"file:{tmp_path / fmt}"):
            assert rows(io.read_compressed(spark, path, fmt, parts=3).edges) == rows(g.edges)
        monkeypatch.setattr(io, "RANGED", ())
        assert rows(io.load(spark, str(tmp_path / fmt), fmt, parts=3).edges) == rows(g.edges)
        monkeypatch.undo()
    whole = bytearray((tmp_path / "byte").read_bytes())
    whole[8] ^= 1  # another edge count
    (tmp_path / "wrong").write_bytes(whole)
    with pytest.raises(ValueError):
        io.read_compressed(spark, str(tmp_path / "wrong"))
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_text("Nothing\n1\n")
        io.read_adjacency(spark, str(tmp_path / "bad"))


def test_rmat_is_deterministic_and_in_range(spark):
    a = rows(io.rmat(spark, 64, 500, seed=3))
    assert a == rows(io.rmat(spark, 64, 500, seed=3)) != rows(io.rmat(spark, 64, 500, seed=4))
    assert all(0 <= s < 64 and 0 <= d < 64 for _, s, d in a)
    with pytest.raises(ValueError):
        io.rmat(spark, 10, 5)


def test_snapshots_are_isolated_and_vacuum_keeps_pins(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "s"), Graph.from_edges(frame(spark, [(0, 1), (1, 0)])))
    pinned = store.acquire()
    assert store.insert_edges(frame(spark, [(2, 3), (3, 2)])) == 1
    assert store.delete_edges(frame(spark, [(0, 1)])) == 2
    assert rows(pinned.graph.edges) == [(0, 1), (1, 0)]
    with store.acquire() as g:
        assert rows(g.edges) == [(1, 0), (2, 3), (3, 2)]
        assert g.vertices.count() == 4
    assert store.readers(0) == 1
    store.compact()
    assert store.vacuum() == [1, 2]
    assert rows(pinned.graph.edges) == [(0, 1), (1, 0)]
    assert rows(store.graph_at(store.latest()).edges) == [(1, 0), (2, 3), (3, 2)]
    pinned.release()
    assert store.vacuum() == [0]


def test_second_writer_is_refused_and_no_half_version_is_seen(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "s"))
    with pytest.raises(Conflict):
        store._publish(0, {})
    (tmp_path / "s" / "manifest" / "1.json.0123.part").write_text('{"ba')  # a writer that crashed
    assert store.versions() == [0] and store.insert_edges(frame(spark, [(0, 1)])) == 1 and rows(store.graph_at(1).edges) == [(0, 1)]


def test_pins_are_seen_by_other_stores_and_end(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "s"), compact_after=2)
    other = GraphStore(spark, str(tmp_path / "s"))
    held, lost = other.acquire(), other.acquire(seconds=0.0)
    assert store.readers(0) == 1  # the other pin's time is over
    assert store.insert_edges(frame(spark, [(0, 1)])) == 1 and store.insert_edges(frame(spark, [(1, 2)])) == 2
    assert store.latest() == 3 and store._read(3)["deltas"] == []  # a new base after two batches
    stray = tmp_path / "s" / "delta" / "underway"
    stray.mkdir()
    assert store.vacuum() == [1, 2] and stray.exists() and rows(held.graph.edges) == []
    held.renew()
    held.release()
    lost.release()
    with pytest.raises(KeyError):
        other.acquire(1)
    assert store.vacuum(grace=0) == [0] and not stray.exists() and rows(store.graph_at(3).edges) == [(0, 1), (1, 2)]


def test_last_change_of_an_undirected_edge_wins(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "s"))
    stream.apply_batch(store, spark.createDataFrame([(1, "+", 1, 2), (2, "-", 2, 1), (3, "-", 4, 3), (4, "+", 3, 4)], stream.UPDATES), 0)
    assert rows(store.graph_at(store.latest()).edges) == [(3, 4), (4, 3)]


def test_batches_apply_once(spark, tmp_path):
    store = GraphStore.create(spark, str(tmp_path / "s"))
    assert store.insert_edges(frame(spark, [(0, 1)]), batch_id=5) == 1
    assert store.insert_edges(frame(spark, [(4, 1)]), batch_id=5) == 1


def test_stream_and_concurrent_readers(spark, tmp_path):
    g = Graph.from_pairs(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"))
    updates = stream.update_stream(g, 40)
    n = updates.count()
    updates.coalesce(1).write.parquet(str(tmp_path / "u"))
    store = GraphStore.create(spark, str(tmp_path / "s"), g)
    got = stream.concurrent(spark, store, str(tmp_path / "u"), str(tmp_path / "c"), 0, queries=1)
    assert got["applied"] == n and got["queries"] == 1
    gone = {(a, b) for _, op, a, b in updates.collect() if op == "-"}
    now = {tuple(r) for r in store.graph_at(store.latest()).edges.collect()}
    assert not (gone & now) and len(now) == 120 - 2 * len(gone)


def test_datapoints(spark, tmp_path):
    stream.write_datapoints(spark.createDataFrame([(float(t), float(t)) for t in range(11)], "time double, value double"), str(tmp_path / "csv"), 2)
    got = rows(spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True))
    assert got == [(2.5, 2.0), (7.5, 7.5)]
