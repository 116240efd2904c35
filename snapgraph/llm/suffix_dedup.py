"""Repeated-passage removal by a difference-cover suffix sort, bounded at the depth that decides: 400 bytes.

A byte goes if a 400-byte string that covers it also starts anywhere else.  Only
the equality of 400-byte prefixes of suffixes matters, so the difference-cover
sort is cut at that depth:

1. Sample: the suffixes of a text whose start is in a perfect difference cover
   modulo V (1/14 of them).  Their tuples, the first DEPTH-V+1 bytes, are sorted and
   named over the whole corpus.  For any two starts i, j some shift under V puts
   both into the sample, so two equal 400-byte prefixes always share a name.
2. Discard and recurse: samples whose name is unique leave.  What remains is
   named again at full depth in the next step, on the starts that a surviving
   name can reach (at most V-1 bytes before it) and on no others.
3. Merge: those remaining suffixes, sampled or not, are merged into one order by
   their 400-byte prefixes; neighbours with equal prefixes are repeats.  Runs of
   adjoining starts go first as segments, cut by content: all starts of a segment
   that occurs again are repeats, and one of each class of equal segments, with
   the unique segments, enters the sort start by start.

The same cut at a depth of words finds passages of over 50 words that stand in
another document too, however few bytes they have: n_passage_words counts a
document's words in them (words are runs between white space).  Nothing is
removed for that.

Sorting is by 64-bit fingerprints of the prefixes, not by their bytes: names need
an order in which equal prefixes are neighbours, not the alphabet's.  Each sort
is the packed exchange: a block sends each distinct name once, a part sorts the
names of its range and compares neighbours, and answers one bit a name.  No list
of the members of a name is ever gathered, so a passage in a third of all
texts costs one entry a block.

Null text: empty.  Texts under 400 bytes keep every byte.  Matches do not cross
texts.  Empty table: no rows.  Repeated rows are copies: all their bytes go (if
they have 400).  Very long texts are whole, in a block of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.common import BLOCKS, answered, drop, forget, in_order, parts_for, prefix_sums, read_bits, repeated_bits, routed_batch, routes, run_sums, spaced_words, span_hashes, text_blocks, words_of, written

DEPTH = 400
#: A perfect difference set: every number under V is a difference of two of these modulo V.
V = 183
COVER = (0, 1, 8, 24, 37, 41, 59, 107, 119, 128, 134, 139, 153, 181)
#: Passages of over 50 words, and a perfect difference set for starts of words.
PASSAGE = 51
PASSAGE_V = 31
PASSAGE_COVER = (1, 5, 11, 24, 25, 27)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"
#: Remaining starts are merged by segments of about so many, cut where the CONTEXT bytes at a start say so.
SEGMENT, CONTEXT = 64, 16
ROUTED = "part int, block long, space int, n int, keys binary, counts binary"


def is_cover(cover: tuple[int, ...], v: int) -> bool:
    return len({(a - b) % v for a in cover for b in cover}) == v


def sample_starts(begin: np.ndarray, ends: np.ndarray, width: int, cover: tuple[int, ...] = COVER, v: int = V) -> np.ndarray:
    """Places p in [begin, end - width] of each text with (p - begin) % v in the cover, ascending."""
    found = []
    for a, b in zip(begin.tolist(), ends.tolist()):
        if b - a >= width:
            rounds = np.arange(0, b - a - width + 1, v, dtype=np.int64)
            at = (rounds[:, None] + np.array(cover)).reshape(-1)
            found.append(a + at[at <= b - a - width])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def names(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the width bytes at each (ascending) start; done in runs so that long texts take bounded memory."""
    out = np.empty(len(starts), np.uint64)
    run = 1 << 21
    for low in range(0, len(data), run):
        a, b = np.searchsorted(starts, [low, low + run])
        if b > a:
            sums = prefix_sums(data[low : low + run + width])
            out[a:b] = span_hashes(sums, starts[a:b] - low, starts[a:b] - low + width)
    return out


def begins(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends


def reach(survivors: np.ndarray, begin: np.ndarray, ends: np.ndarray, shift: int, depth: int = DEPTH) -> np.ndarray:
    """Starts of whole strings of the depth at most ``shift`` places before a surviving sample, in the same text."""
    if not len(survivors):
        return survivors
    text = np.searchsorted(ends, survivors, side="right")
    low = np.maximum(survivors - shift, begin[text])
    high = np.minimum(survivors, ends[text] - depth)
    low, high = low[high >= low], high[high >= low]
    size = int(ends[-1]) + 2
    edge = np.zeros(size, np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, high + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def segments(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (inclusive, as indexes of starts) of runs of adjoining starts, cut where the text itself says so."""
    if not len(starts):
        return starts, starts
    padded = np.concatenate([data, np.zeros(CONTEXT, np.uint8)])
    cut = names(padded, starts, CONTEXT) % np.uint64(SEGMENT) == 0
    cut[0] = True
    cut[1:] |= np.diff(starts) != 1
    first = np.flatnonzero(cut)
    return first, np.append(first[1:], len(starts)) - 1


def segment_names(data: np.ndarray, starts: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of all bytes that the 400-byte strings of each segment hold."""
    out = np.empty(len(first), np.uint64)
    run = 1 << 20
    for low in range(0, len(first), 1 << 14):
        a, b = starts[first[low : low + (1 << 14)]], starts[last[low : low + (1 << 14)]] + DEPTH
        base = int(a[0])
        if b.max() - base > 4 * run:  # very long segments: one by one
            out[low : low + len(a)] = [int.from_bytes(hashlib.blake2b(data[x:y].tobytes(), digest_size=8).digest(), "little") if y - x > run else span_hashes(prefix_sums(data[x:y]), np.array([0]), np.array([y - x]))[0] for x, y in zip(a.tolist(), b.tolist())]
        else:
            out[low : low + len(a)] = span_hashes(prefix_sums(data[base : int(b.max())]), a - base, b - base)
    return out


def runs_of(low: list, high: list) -> np.ndarray:
    return np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)]) if low else np.zeros(0, np.int64)


def in_runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of adjoining places."""
    steps = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return places[steps], places[np.append(steps[1:], len(places)) - 1] if len(places) else places


class Words:
    """The words of a block's texts: where each text's words begin and end, and names of runs of words."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        starts, stops = words_of(data, spaced_words())
        self.ends = np.searchsorted(starts, ends)
        self.begin = np.concatenate([[0], self.ends[:-1]]) if len(ends) else self.ends
        hashes = np.empty(len(starts), np.uint64)
        run = 1 << 18
        for low in range(0, len(starts), run):
            a, b = starts[low : low + run], stops[low : low + run]
            hashes[low : low + run] = span_hashes(prefix_sums(data[int(a[0]) : int(b[-1])]), a - a[0], b - a[0])
        self.sums = run_sums(hashes)

    def names(self, starts: np.ndarray, width: int) -> np.ndarray:
        return span_hashes(self.sums, starts, starts + width)

    def sample(self) -> np.ndarray:
        return sample_starts(self.begin, self.ends, PASSAGE - PASSAGE_V + 1, PASSAGE_COVER, PASSAGE_V)

    def texts(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, starts, side="right")

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """For each text, its words inside passages at these starts."""
        edge = np.zeros(len(self.sums), np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + PASSAGE, -1)
        sums = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
        return sums[self.ends] - sums[self.begin]


def by_document(names: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending distinct names, how many texts hold each (2: two or more), and the place of each name among them."""
    distinct, inverse = np.unique(names, return_inverse=True)
    low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), -1)
    np.minimum.at(low, inverse, texts)
    np.maximum.at(high, inverse, texts)
    return distinct, 1 + (high > low), inverse


def two_bits(sums: np.ndarray, leads: np.ndarray) -> bytes:
    return (np.packbits(sums > 1)).tobytes() + np.packbits(leads).tobytes()


def read_two_bits(cell: bytes, n: int) -> np.ndarray:
    """1: repeated, 2: this block leads."""
    half = len(cell) // 2
    return read_bits(cell[:half], n).astype(np.int8) + 2 * read_bits(cell[half:], n).astype(np.int8)


class Remaining:
    """The starts of a block that are left after the sample, by segment, and what is known of them."""

    def __init__(self, row: dict, replies: pa.Table | None):
        self.data, self.ends = np.frombuffer(row["text"], np.uint8), np.array(row["ends"], np.int64)
        self.starts = runs_of(row["low"], row["high"])
        first, last = segments(self.data, self.starts)
        self.sizes = last - first + 1
        self.keys, self.first_of, self.inverse = np.unique(segment_names(self.data, self.starts, first, last), return_index=True, return_inverse=True)
        if replies is not None:
            state = in_order(replies, 1, read_two_bits)
            here = np.bincount(self.inverse, minlength=len(self.keys))
            self.repeated = ((state & 1).astype(bool) | (here > 1))[self.inverse]
            # Every segment that is unique, and one of each class of equal ones, go on.
            leads = np.zeros(len(self.inverse), bool)
            leads[self.first_of] = (state & 2).astype(bool)
            self.sent = np.repeat(leads | ~self.repeated, self.sizes)

    def names(self) -> np.ndarray:
        return names(self.data, self.starts[self.sent], DEPTH)


def passages(row: dict):
    """The words of a remaining block, the starts of passages that may be repeated, and their names by document."""
    words, starts = Words(np.frombuffer(row["text"], np.uint8), np.array(row["ends"], np.int64)), runs_of(row["first"], row["last"])
    return words, starts, *by_document(words.names(starts, PASSAGE), words.texts(starts))


REMAIN = BLOCKS + ", low array<long>, high array<long>, first array<long>, last array<long>, done array<struct<doc_id: long, n_bytes: long, kept_sha256: string>>"


def removed(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words."""
    if depth != DEPTH or not is_cover(COVER, V) or not is_cover(PASSAGE_COVER, PASSAGE_V):
        raise ValueError("the cover is made for this depth")
    spark = docs.sparkSession
    width = DEPTH - V + 1
    blocks, blocks_path = written(text_blocks(docs), "blocks")
    size = blocks.agg(F.sum(F.length("text"))).first()[0] or 0
    # The sample only filters, so its names need just so many bits that few unlike ones meet.
    bits = min(64, max(32, int(size * len(COVER) // V + 1).bit_length() + 12))
    sample_parts = parts_for(size * 8 * len(COVER) // V)

    def sample(data, ends):
        starts = sample_starts(begins(ends), ends, width)
        return starts, names(data, starts, width) >> np.uint64(64 - bits)

    def sample_words(row: dict):
        """The words of a block, the sampled starts, and their names and texts."""
        words = Words(np.frombuffer(row["text"], np.uint8), np.array(row["ends"], np.int64))
        starts = words.sample()
        return words, starts, (words.names(starts, PASSAGE - PASSAGE_V + 1) >> np.uint64(64 - bits), words.texts(starts))

    def send_sample(batches):
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("block", "ends", "text")}
                _, own = sample(np.frombuffer(row["text"], np.uint8), np.array(row["ends"], np.int64))
                keys, counts = np.unique(own, return_counts=True)
                rows = list(routes(row["block"], 0, keys, np.minimum(counts, 2), sample_parts, bits))
                _, starts, own = sample_words(row)
                rows += routes(row["block"], 3, *by_document(*own)[:2], sample_parts, bits)
                if rows:
                    yield routed_batch(rows)

    def survive(key, block: pa.Table, replies: pa.Table) -> pa.Table:
        """Keeps of a block the texts, and in them the runs of starts, that a surviving name reaches; the others are done."""
        forget()
        out: dict[str, list] = {"block": [], "ids": [], "ends": [], "text": [], "low": [], "high": [], "first": [], "last": [], "done": []}
        for row in block.to_pylist():
            data, ends = np.frombuffer(row["text"], np.uint8), np.array(row["ends"], np.int64)
            begin = begins(ends)
            starts, own = sample(data, ends)
            if len(own):
                _, inverse = np.unique(own, return_inverse=True)
                starts = starts[in_order(replies, 0, read_bits)[inverse]]
            low, high = in_runs(reach(starts, begin, ends, V - 1))
            words, starts, own = sample_words(row)
            if len(starts):
                starts = starts[in_order(replies, 3, read_bits)[by_document(*own)[2]]]
            first, last = in_runs(reach(starts, words.begin, words.ends, PASSAGE_V - 1, PASSAGE))
            # A run of starts stays in one text: no start reaches the last places of a text.
            text = np.searchsorted(ends, low, side="right")
            word_text = words.texts(first)
            keep = np.zeros(len(ends), bool)
            keep[text] = keep[word_text] = True
            lengths = ends - begin + 1
            shift = np.cumsum(np.where(keep, 0, lengths))
            out["block"].append(row["block"])
            out["ids"].append([d for d, k in zip(row["ids"], keep) if k])
            out["ends"].append((ends - shift)[keep])
            out["text"].append(b"".join(row["text"][a : b + 1] for a, b, k in zip(begin.tolist(), ends.tolist(), keep) if k))
            out["low"].append(low - shift[text])
            out["high"].append(high - shift[text])
            gone = np.cumsum(np.where(keep, 0, words.ends - words.begin))
            out["first"].append(first - gone[word_text])
            out["last"].append(last - gone[word_text])
            out["done"].append([{"doc_id": d, "n_bytes": b - a, "kept_sha256": hashlib.sha256(data[a:b]).hexdigest()} for d, a, b, k in zip(row["ids"], begin.tolist(), ends.tolist(), keep) if not k])
        longs, done = pa.list_(pa.int64()), pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept_sha256", pa.string())]))
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out.values(), [pa.int64(), longs, longs, pa.binary(), longs, longs, longs, longs, done])], names=list(out))

    first = answered(blocks.mapInArrow(send_sample, ROUTED), repeated_bits)
    remain, _ = written(blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(survive, REMAIN), "remain")
    drop(spark, blocks_path)
    total = lambda low, high: F.coalesce(F.sum(F.aggregate(F.zip_with(high, low, lambda h, l: h - l + 1), F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    places, word_places = remain.agg(total("low", "high"), total("first", "last")).first()
    segment_parts, merge_parts = parts_for(places * 8 // SEGMENT + word_places * 8), parts_for(places * 8)
    some = remain.where("size(low) > 0 or size(first) > 0").drop("done")

    def send_segments(batches):
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("block", "ends", "text", "low", "high", "first", "last")}
                rows = list(routes(row["block"], 1, Remaining(row, None).keys, None, segment_parts))
                _, _, keys, counts, _ = passages(row)
                yield routed_batch(rows + list(routes(row["block"], 4, keys, counts, segment_parts)))

    def send_starts(key, block: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        rows: list = []
        for row in block.to_pylist():
            keys, counts = np.unique(Remaining(row, replies).names(), return_counts=True)
            rows += routes(row["block"], 2, keys, np.minimum(counts, 2), merge_parts)
        return pa.Table.from_batches([routed_batch(rows)])

    def finish(key, block: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        out: list[tuple] = []
        for row in block.to_pylist():
            left = Remaining(row, replies)
            again = np.repeat(left.repeated, left.sizes)
            if left.sent.any():
                _, inverse = np.unique(left.names(), return_inverse=True)
                again[left.sent] |= in_order(replies, 2, read_bits)[inverse]
            gone = np.zeros(len(left.data) + 1, np.int32)
            gone[left.starts[again]] += 1
            gone[left.starts[again] + DEPTH] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            words, starts, _, _, inverse = passages(row)
            told = (in_order(replies, 4, read_two_bits) & 1).astype(bool)[inverse] if len(starts) else np.zeros(0, bool)
            for doc, a, b, told_of in zip(row["ids"], begins(left.ends).tolist(), left.ends.tolist(), words.covered(starts[told]).tolist()):
                lost = gone[a:b]
                count = int(np.count_nonzero(lost))
                spans = int(np.count_nonzero(np.diff(lost.astype(np.int8), prepend=np.int8(0)) == 1)) if count else 0
                out.append((doc, b - a, count, spans, hashlib.sha256(left.data[a:b][~lost] if count else left.data[a:b]).hexdigest(), told_of))
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string(), pa.int64()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    second, _ = written(answered(some.mapInArrow(send_segments, ROUTED), two_bits), "segments")
    third, _ = written(answered(some.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(send_starts, ROUTED), repeated_bits), "starts")
    found = some.groupBy("block").cogroup(second.unionByName(third).groupBy("block")).applyInArrow(finish, RESULT)
    done = remain.select(F.explode("done").alias("d")).select("d.doc_id", "d.n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "d.kept_sha256", F.lit(0).cast("long").alias("n_passage_words"))
    return found.unionByName(done)
