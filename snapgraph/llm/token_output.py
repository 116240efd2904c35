"""Token-id output: one wavelet matrix per shard of token ids, written as a table of shard files and read back.

A shard holds the ids of consecutive documents (ascending doc_id), about
``SHARD_TOKENS`` of them, as a wavelet matrix: one bit plane per bit of the
largest id, each plane the stable partition of the plane above, with the number
of ones before every 512th bit.  ``access``, ``rank`` and ``select`` work on the
planes alone; ``decode`` undoes the partitions from the lowest plane up.
The files' container is Parquet, so any store that Spark writes to will do and
a lost executor's part is written again by its task's next attempt.

Order: doc_id, nulls last; rows of one doc_id by the checksum of their ids.
Null text: only the end id.  Empty table: no shards, no rows.
Repeated rows are written again.  A text is encoded whole.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapgraph.llm.common import forget, id_and_text, joined, kept, slices, written
from snapgraph.llm.pieces import LOOK_UP_BYTES, PieceMemo

SHARD_TOKENS = 1 << 20
#: Text bytes of one range of documents: a task writes them as a few shards.
RANGE_BYTES = 8 << 20
#: Beyond so many ranges they grow instead: their bounds are on the driver and in every task, and their first places are broadcast.
MOST_RANGES = 1 << 16
END = 0
#: The string of the vocabulary's special token, which the library finds in any text.
SPECIALS = (b"<|endoftext|>",)
STEP = 512
#: Ids that are partitioned at once, so that their places stay in a core's cache.
SPAN = 1 << 15
SHARDS = "part int, shard int, first long, n_tokens long, docs array<long>, ends array<long>, payload binary"


# ---------------------------------------------------------------- wavelet matrix


def _kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def _places(ones: np.ndarray):
    """Runs of SPAN bits: where they begin, and the places in them of the zeros and of the ones; taking these is much faster than taking by a mask."""
    for at in range(0, len(ones), SPAN):
        run = ones[at : at + SPAN]
        yield at, np.flatnonzero(~run), np.flatnonzero(run)


class WaveletMatrix:
    """Bit planes with rank and select; ``dump`` and ``load`` are its file format."""

    MAGIC = b"WVMX"

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        self.bits = len(planes)
        self._ones: list[np.ndarray | None] = [None] * len(planes)
        self._zeros: list[int | None] = [None] * len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(np.max(ids, initial=0)).bit_length())
        kind = _kind(bits)
        now, planes = np.asarray(ids).astype(kind), []
        spare = np.empty_like(now)
        for level in range(bits - 1, -1, -1):
            ones = (now & kind(1 << level)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            low, high = 0, len(now) - int(np.count_nonzero(ones))
            for at, off, on in _places(ones) if level else ():
                run = now[at : at + SPAN]
                run.take(off, out=spare[low : low + len(off)], mode="clip")
                run.take(on, out=spare[high : high + len(on)], mode="clip")
                low, high = low + len(off), high + len(on)
            now, spare = spare, now
        return cls(len(now), planes)

    def plane(self, k: int) -> np.ndarray:
        return np.unpackbits(self.planes[k], count=self.n, bitorder="little")

    def _directory(self, k: int) -> np.ndarray:
        """Ones before every STEP-th bit."""
        if self._ones[k] is None:
            padded = np.zeros(-(-self.n // STEP) * STEP // 8, dtype=np.uint8)
            padded[: len(self.planes[k])] = self.planes[k]
            counts = np.bitwise_count(padded).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
            self._ones[k] = np.concatenate([[0], np.cumsum(counts)])
            self._zeros[k] = self.n - int(self._ones[k][-1])
        return self._ones[k]

    def _rank1(self, k: int, i: int) -> int:
        block = i // STEP
        before = int(self._directory(k)[block])
        cell = self.planes[k][block * STEP // 8 : -(-i // 8)]
        if not len(cell):
            return before
        count = int(np.bitwise_count(cell).sum())
        if i % 8:
            count -= int(np.bitwise_count(cell[-1] >> np.uint8(i % 8)))
        return before + count

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            bit, ones = self._bit(k, i), self._rank1(k, i)
            value = value << 1 | bit
            i = self._zeros[k] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the token is among the first i."""
        if token >> self.bits:
            return 0
        low, high = 0, i
        for k in range(self.bits):
            a, b = self._rank1(k, low), self._rank1(k, high)
            if token >> (self.bits - 1 - k) & 1:
                low, high = self._zeros[k] + a, self._zeros[k] + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence (from 0); -1 if there is none."""
        if k < 0 or k >= self.count(token):
            return -1
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            if self.rank(token, mid + 1) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """The ids, in 16 bits each where that is enough."""
        kind = _kind(self.bits)
        below, now = np.zeros(self.n, kind), np.empty(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = self.plane(k).view(bool)
            low, high = 0, self.n - int(np.count_nonzero(ones))
            below[high:] |= kind(1 << (self.bits - 1 - k))
            for at, off, on in _places(ones):
                run = now[at : at + SPAN]
                run[off] = below[low : low + len(off)]
                run[on] = below[high : high + len(on)]
                low, high = low + len(off), high + len(on)
            below, now = now, below
        return below

    def dump(self) -> bytes:
        """MAGIC, count (u64), planes (u32), then the planes, highest bit first, all little-endian."""
        return self.MAGIC + struct.pack("<QI", self.n, self.bits) + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def load(cls, cell: bytes) -> WaveletMatrix:
        if cell[:4] != cls.MAGIC:
            raise ValueError("not a wavelet shard")
        n, bits = struct.unpack_from("<QI", cell, 4)
        each = -(-n // 8)
        return cls(n, [np.frombuffer(cell, np.uint8, each, 16 + k * each) for k in range(bits)])


# ---------------------------------------------------------------- encoding


def memo_for(path: str) -> PieceMemo:
    return kept(("ids", path), lambda: PieceMemo(path, lower=False, specials=SPECIALS, drop_space=False))


def ids_of(col: pa.Array, memo: PieceMemo):
    """The ids of each text, without the end id."""
    data, ends = joined(col)
    starts, _, rows = memo.look_up(data, ends)
    ids, sums = memo.gather(rows)
    upto = np.concatenate([[0], sums])[np.searchsorted(starts, ends)]
    return np.split(ids, upto)[:-1]


ENCODED = "range int, doc_id long, n_tokens long, check long, narrow boolean, ids binary"


def encoded(docs: DataFrame, path: str, bounds: tuple[int, ...] = ()) -> DataFrame:
    """ENCODED: every whole text with the end id, 16 bits an id where that is enough; range: how many bounds its doc_id has reached."""

    def run(batches):
        memo = memo_for(path)
        end, cuts = np.array([END], "<u4"), np.array(bounds, np.int64)
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                found = chain.from_iterable(ids_of(few.column(1), memo) for few in slices(part, 1, LOOK_UP_BYTES))
                for doc, own in zip(part.column(0).to_pylist(), found):
                    ids = np.concatenate([own, end]).astype("<u4")
                    narrow = bool(ids.max() < 1 << 16)
                    place = len(cuts) if doc is None else int(np.searchsorted(cuts, doc, side="right"))
                    rows.append((place, doc, len(ids), zlib.crc32(ids), narrow, ids.astype("<u2").tobytes() if narrow else ids.tobytes()))
                columns = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["range", "doc_id", "n_tokens", "check", "narrow", "ids"])

    return id_and_text(docs).mapInArrow(run, ENCODED)


def range_bounds(docs: DataFrame) -> tuple[int, ...]:
    """Ids that cut the documents into ranges of about RANGE_BYTES of text, at most MOST_RANGES; a task streams a larger one as more shards."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(max(-(-size // RANGE_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, max(10_000, 4 * ranges))).first()[0] if shares else None
    return tuple(sorted(set(found or ())))


def write_shards(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, str]:
    """Writes the shard files and returns them as read back, with their folder."""
    bounds = range_bounds(docs)
    ordered = encoded(docs, path, bounds).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "check")

    def run(batches):
        forget()
        shard, first, part = 0, 0, 0
        held, docs_held, ends, n = [], [], [], 0

        def flush():
            matrix = WaveletMatrix.build(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([docs_held], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([matrix.dump()], pa.binary())],
                names=["part", "shard", "first", "n_tokens", "docs", "ends", "payload"],
            )

        for batch in batches:
            for place, doc, narrow, cell in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5))):
                own = np.frombuffer(cell, "<u2" if narrow else "<u4")
                if n and n + len(own) > shard_tokens:
                    yield flush()
                    held, docs_held, ends, shard, first, n = [], [], [], shard + 1, first + n, 0
                part = place
                held.append(own)
                docs_held.append(doc)
                n += len(own)
                ends.append(n)
        if n:
            yield flush()

    return written(ordered.mapInArrow(run, SHARDS), "shards", "zstd")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row per range of documents: the only list that one task sums.
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    placed = shards.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("first")).alias("first"), "docs", "ends", "payload")

    def run(batches):
        forget()
        for batch in batches:
            for first, docs, ends, payload in zip(*(batch.column(k).to_pylist() for k in range(4))):
                ids = WaveletMatrix.load(payload).decode().astype("<u4")
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64()),
                        pa.array([first + s for s in begins], pa.int64()),
                        pa.array([e - s for s, e in zip(begins, ends)], pa.int64()),
                        pa.array([zlib.crc32(ids[s:e]) for s, e in zip(begins, ends)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str) -> DataFrame:
    """Encodes, writes the shard files, reads them back and describes each document by what they hold."""
    shards, _ = write_shards(docs, path)
    return read_shards(shards)
