"""What the operators share: scratch tables, text blocks, word fingerprints and the packed count exchange.

Block: some megabytes of whole texts, each followed by a line feed that belongs
to no text, in one binary cell.  A text is never split between blocks.  Null
texts count as empty, null ids stay null, repeated rows stay separate rows.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import gc
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgraph.functions.cuts import shared_folder

BLOCK_BYTES = 2 << 20
#: Bytes that go to a Python worker at once, so that two workers and the JVM fit an executor of 3 GB.
BATCH_BYTES = 16 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of packed keys that one task of an exchange holds at a time.
EXCHANGE_BYTES = 8 << 20


# ---------------------------------------------------------------- scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Cells of a megabyte are common here: sizes of pages and row groups are looked at from
#: the first row on, else the writer gathers a hundred such cells in direct memory.
WRITES = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    path = f"{shared_folder(spark)}/snapgraph-{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


_MADE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def collected():
    """The list of the scratch folders made inside."""
    paths: list[str] = []
    token = _MADE.set(paths)
    try:
        yield paths
    finally:
        _MADE.reset(token)


def drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; its folder goes with the cluster's cleanup
        pass


@contextlib.contextmanager
def own_shuffles(spark: SparkSession):
    """Writes begun here lose their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, tag: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """The rows, once written to the shared folder: lineage ends there and an executor may go."""
    path = scratch(df.sparkSession, tag)
    writer = df.write.option("compression", codec)
    for name, value in WRITES.items():
        writer = writer.option(name, value)
    with own_shuffles(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


#: As many buckets as Spark allows by default.
MOST_BUCKETS = 100_000


def bucketed(df: DataFrame, key: str, buckets: int, tag: str):
    """The rows as a table in the shared folder, bucketed by the key, so that grouping by it never shuffles them; and a function that drops it."""
    spark = df.sparkSession
    path, name = scratch(spark, tag), f"snapgraph_{tag}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).option("compression", "snappy")
    for option, value in WRITES.items():
        writer = writer.option(option, value)
    with own_shuffles(spark):
        writer.bucketBy(min(buckets, MOST_BUCKETS), key).saveAsTable(name)

    def done() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(spark, path)

    return spark.table(name), done


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """row, d: the rows as structs, written once with a number each, so that repeated rows and null ids
    stay apart and no column of the user's can be taken for one of ours; and their folder."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(docs[named(c)] for c in docs.columns)).alias("d")), "rows")


def named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def task_cache() -> dict:
    """What a Python worker keeps between tasks (tokenizers, memo tables)."""
    holder = sys.modules.setdefault("_snapgraph_worker_cache", types.ModuleType("_snapgraph_worker_cache"))
    return holder.__dict__.setdefault("items", {})


def kept(key: tuple, make):
    """What make() gives, kept in the worker under the key until a task asks for another one."""
    cache = task_cache()
    forget(key[0])
    if key not in cache:
        for k in [k for k in cache if isinstance(k, tuple) and k[0] == key[0]]:
            del cache[k]
        cache[key] = make()
    return cache[key]


#: Arrays over so many bytes are the system's own maps, so that they go back to it when they are freed.
OWN_MAP = 1 << 20


def forget(*own: str) -> None:
    """At a task's begin: drops what other operators keep in this worker, hands the memory back, and sees that large arrays will be."""
    cache = task_cache()
    if "settled" not in cache:
        cache["settled"] = True
        pa.set_memory_pool(pa.system_memory_pool())
        _libc("mallopt", -3, OWN_MAP)  # M_MMAP_THRESHOLD, which else grows with use
    old = [k for k in cache if isinstance(k, tuple) and k[0] not in ("pow", *own)]
    for k in old:
        del cache[k]
    if old:
        gc.collect()
        trim()


def trim() -> None:
    """Hands freed memory back to the system."""
    _libc("malloc_trim", 0)


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL("libc.so.6"), name)(*args)
    except (OSError, AttributeError):  # another C library: it has its own ways
        pass


# ---------------------------------------------------------------- blocks

BLOCKS = "block long, ids array<long>, ends array<long>, text binary"


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns an operator works on, so other columns may have any name."""
    spark = docs.sparkSession
    if spark.conf.get(BATCH_CONF) == "67108864b":  # Spark's default; a setting of the user's stays
        spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: int, most: int = BLOCK_BYTES):
    """The batch cut into runs of rows of about so many bytes in the column."""
    if batch.num_rows == 0:
        return
    col = batch.column(column)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + most, side="left"))
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row ends (both from 0) of a string or binary array without nulls."""
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed after each, and the place of each line feed."""
    data, ends = raw(col)
    n = len(ends)
    out = np.full(len(data) + n, 10, dtype=np.uint8)
    at = 0
    for k, end in enumerate(ends.tolist()):
        out[at + k : end + k] = data[at:end]
        at = end
    return out, ends + np.arange(n)


def text_blocks(docs: DataFrame, most: int = BLOCK_BYTES, packed: bool = False) -> DataFrame:
    """Documents as blocks; nothing is shuffled.  packed: the text cells are Zstandard frames (see unpacked)."""

    def pack(batches):
        from pyspark import TaskContext

        forget()
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, most):
                data, ends = joined(part.column(1))
                cell = zstandard.ZstdCompressor(level=3).compress(data) if packed else data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([cell], pa.binary())],
                    names=["block", "ids", "ends", "text"],
                )
                n += 1

    return id_and_text(docs).mapInArrow(pack, BLOCKS)


def unpacked(cell: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint8)


# ---------------------------------------------------------------- fingerprints


def _mix_table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept in the worker."""
    cache = task_cache()
    have = cache.get(("pow", base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have, k = np.ones(size, dtype=np.uint64), 1
        while k < size:  # a running product waits for each step
            upto = min(2 * k, size)
            np.multiply(have[: upto - k], np.uint64(pow(base, k, 2**64)), out=have[k:upto])
            k = upto
        if size <= 1 << 20:  # more are made in some milliseconds
            cache["pow", base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (in place where it can)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def prefix_sums(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """Polynomial prefix sums mod 2^64, one longer than the data."""
    table = _mix_table(seed)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = table[data]
    terms *= _powers(_BASE, len(data))
    np.cumsum(terms, out=out[1:])
    return out


def run_sums(words: np.ndarray) -> np.ndarray:
    """The same for a sequence of word fingerprints: span_hashes of it names runs of words."""
    out = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _powers(_BASE, len(words)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[start:end]; equal bytes have equal ones."""
    values = sums[ends] - sums[starts]
    values *= _powers(_INVERSE, int(len(sums)))[starts]
    return mix(values)


def mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of 256 values of one byte, without an index of eight bytes for each; to be read only."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def alnum_words() -> np.ndarray:
    """Bytes of the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def spaced_words() -> np.ndarray:
    """Bytes of the words [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, dtype=bool)
    table[0x20] = False
    table[0x09:0x0E] = False
    return table


def words_of(low: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block (texts end with a line feed, which is in no word)."""
    edge = np.diff(mapped(low, is_word).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out ^= words[k : len(words) - n + 1 + k]
        out = mix(out)
    return out


def key_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit keys, and the keys in it.

    Plain sorting is much faster than finding an order, so places are sorted within the low bits of the keys; keys that
    differ in these bits only, and so may come out wrong, are sorted as a whole.
    """
    low = np.uint64((1 << max(len(keys) - 1, 0).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    found = keys[order]
    if (found[1:] < found[:-1]).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    return order, found


# ---------------------------------------------------------------- packed exchange


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as byte planes of their differences; planes of zeros are left out."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    every = int(np.bitwise_or.reduce(gaps))
    used = [k for k in range(8) if every >> 8 * k & 255]
    return bytes([len(used), *used]) + planes[used].tobytes()


def unpack_sorted(cell: bytes, n: int) -> np.ndarray:
    used = cell[1 : 1 + cell[0]]
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[list(used)] = np.frombuffer(cell, dtype=np.uint8, offset=1 + cell[0]).reshape(len(used), n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def pack_small(values: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one needs."""
    top = int(values.max(initial=0))
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return values.astype(kind).tobytes()


def unpack_small(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(cell, dtype={0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(cell) // max(n, 1)]).astype(np.int64)


ROUTED = "part int, block long, space int, n int, keys binary, counts binary"
REPLIES = "block long, part int, space int, n int, reply binary"


def routes(block: int, space: int, keys: np.ndarray, counts: np.ndarray | None, parts: int, bits: int = 64):
    """Rows of ROUTED for the ascending distinct keys (of so many bits) of one block: each goes to the part of its high bits."""
    width = (1 << bits) // parts + 1
    cuts = np.searchsorted(keys, np.array([k * width for k in range(1, parts)], dtype=np.uint64))
    at = 0
    for part, upto in enumerate([*cuts.tolist(), len(keys)]):
        if upto > at:
            yield part, block, space, upto - at, pack_sorted(keys[at:upto]), None if counts is None else pack_small(counts[at:upto])
        at = upto


def routed_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "block", "space", "n", "keys", "counts"])


def answered(routed: DataFrame, answer) -> DataFrame:
    """Sums the counts of equal keys over all blocks and sends each block what answer(sums, leads) makes of its own keys.

    leads: True for exactly one of the blocks that hold the key.

    A block sends a key once, however often it holds it, so the rows of the
    commonest key are at most as many as the blocks.  Parts cut the space of
    fingerprints evenly, so they are about equal.
    """

    def count(table: pa.Table) -> pa.Table:
        forget()
        out = []
        for space in sorted(set(table.column("space").to_pylist())):
            rows = table.filter(pc.equal(table.column("space"), space)).to_pylist()
            keys = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in rows])
            counts = np.concatenate([np.ones(r["n"], np.int64) if r["counts"] is None else unpack_small(r["counts"], r["n"]) for r in rows])
            order = np.argsort(keys)
            sorted_keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
            sums = np.add.reduceat(counts[order], first)
            per_key = np.empty(len(keys), np.int64)
            per_key[order] = np.repeat(sums, np.diff(first, append=len(keys)))
            leads = np.zeros(len(keys), bool)
            leads[order[first]] = True
            at = 0
            for r in rows:
                out.append((r["block"], r["part"], space, r["n"], answer(per_key[at : at + r["n"]], leads[at : at + r["n"]])))
                at += r["n"]
        columns = list(zip(*out))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()])], names=["block", "part", "space", "n", "reply"])

    return routed.groupBy("part").applyInArrow(count, REPLIES)


def repeated_bits(sums: np.ndarray, leads: np.ndarray) -> bytes:
    return np.packbits(sums > 1).tobytes()


def sum_bytes(sums: np.ndarray, leads: np.ndarray) -> bytes:
    return pack_small(sums)


def in_order(replies: pa.Table, space: int, decode) -> np.ndarray:
    """The answers of one block, in the order of its keys."""
    own = replies.select(["part", "n", "reply"]).filter(pc.equal(replies.column("space"), space)).sort_by("part")
    cells = [decode(cell, n) for cell, n in zip(own.column("reply").to_pylist(), own.column("n").to_pylist())]
    return np.concatenate(cells) if cells else np.zeros(0, np.int64)


def read_bits(cell: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(cell, np.uint8), count=n).astype(bool)


def parts_for(total_bytes: int) -> int:
    return max(12, -(-int(total_bytes) // EXCHANGE_BYTES))


# ---------------------------------------------------------------- components


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the undirected links (a, b): component is the smallest node; nodes without links are absent.

    Large-star, small-star rounds: every round at least halves the depth of the
    trees, and a node's neighbours only ever meet as a minimum, never as a list.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = written(edges, "links")
    before = None
    while True:
        # Equal sets of links have equal counts and sums of fingerprints.
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            break
        before = mark
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: the larger neighbours of a node go to the node's minimum
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, large_path = written(large, "large")
        # small star: a node and its smaller neighbours go to their minimum
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        small, small_path = written(small, "small")
        drop(spark, large_path)
        drop(spark, path)
        edges, path = small, small_path
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.select(F.col("a").alias("node"), "component").union(roots)
