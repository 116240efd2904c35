"""Benchmark decontamination: a positional inverted index over the training texts, in shards by document.

``build_index`` writes one row per shard (some megabytes of whole documents):
the shard's distinct terms and, for each, the ascending positions at which it
stands.  A search broadcasts a block of the test set's phrases; each shard
orders a phrase's terms by the length of their posting lists, takes the rarest
one's postings as candidate starts and intersects them, offset-adjusted, with
the next rarest lists.  What is left are the exact occurrences.  With
``slop`` > 0 the terms need only stand that near to their exact places.

Postings never leave their shard, so no term, however common, gathers in one
task, and the cost is that of the lists of rare terms.  Terms are compared by
64-bit fingerprint first and byte by byte when a shard opens a term.

Null text: no words.  Empty text or table: no words or no rows.  Repeated rows:
one row each.  An item without words has no window; a null item_id is left out.
Ties between equally rare terms do not change what is found.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.common import alnum_words, drop, forget, id_and_text, joined, lower_table, numbered, pack_small, prefix_sums, slices, span_hashes, unpack_small, words_of, written

WINDOW = 10
#: Characters of test texts that are broadcast at once; a larger test set is searched in blocks of this size.
QUERY_CHARS = 8_000_000
#: Candidate starts that a shard holds at once.
CANDIDATES = 200_000
#: Text bytes of a shard.
SHARD_BYTES = 1 << 20
INDEX = "ids array<long>, n_words array<int>, terms binary, term_ends binary, hashes binary, list_ends binary, gaps binary"


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = lower_table()[data]
    starts, ends = words_of(low, alnum_words())
    return low, starts, ends


def build_index(docs: DataFrame) -> tuple[DataFrame, str]:
    """The shards, written to the shared folder."""

    def run(batches):
        forget()
        for batch in batches:
            for part in slices(batch, 1, SHARD_BYTES):
                data, text_ends = joined(part.column(1))
                low, starts, ends = word_spans(data)
                n_words = np.diff(np.searchsorted(starts, text_ends), prepend=0)
                hashes = span_hashes(prefix_sums(low), starts, ends)
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else np.zeros(0, np.int64)
                whole = low.tobytes()
                terms = [whole[a:b] for a, b in zip(starts[order[first]].tolist(), ends[order[first]].tolist())]
                gaps = np.diff(order, prepend=0)
                gaps[first] = order[first]
                cells = [b"".join(terms), np.cumsum([len(t) for t in terms], dtype="<i4").tobytes(), ordered[first].tobytes(), np.append(first[1:], len(order)).astype("<i4").tobytes() if len(order) else b"", pack_small(gaps)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([n_words], pa.list_(pa.int32())), *(pa.array([c], pa.binary()) for c in cells)],
                    names=["ids", "n_words", "terms", "term_ends", "hashes", "list_ends", "gaps"],
                )

    # A shard's number and a place in it tell repeated rows and null ids apart.
    return written(id_and_text(docs).mapInArrow(run, INDEX).withColumn("shard", F.monotonically_increasing_id()), "index")


class Shard:
    """One row of the index, opened."""

    def __init__(self, n_words: np.ndarray, terms: bytes, term_ends: bytes, hashes: bytes, list_ends: bytes, gaps: bytes):
        self.doc_ends = np.cumsum(n_words)
        self.n = int(self.doc_ends[-1]) if len(n_words) else 0
        self.terms, self.term_ends = terms, np.frombuffer(term_ends, "<i4")
        self.hashes = np.frombuffer(hashes, np.uint64)
        self.list_ends = np.frombuffer(list_ends, "<i4").astype(np.int64)
        self.list_starts = np.concatenate([[0], self.list_ends[:-1]]).astype(np.int64)
        steps = unpack_small(gaps, self.n)
        sums = np.cumsum(steps)
        lengths = self.list_ends - self.list_starts
        before = np.where(self.list_starts > 0, sums[self.list_starts - 1], 0) if self.n else np.zeros(0, np.int64)
        self.postings = sums - np.repeat(before, lengths)
        #: term * n + position, ascending: one search answers whether a term stands at a position.
        self.places = np.repeat(np.arange(len(lengths)), lengths) * max(self.n, 1) + self.postings

    def term_rows(self, hashes: np.ndarray, words: list[bytes]) -> np.ndarray:
        """The shard's row of each term, -1 where it does not occur."""
        at = np.searchsorted(self.hashes, hashes)
        found = np.full(len(hashes), -1, np.int64)
        for k in np.flatnonzero((at < len(self.hashes)) & (self.hashes[np.minimum(at, max(len(self.hashes) - 1, 0))] == hashes)).tolist() if len(self.hashes) else []:
            row = int(at[k])
            if self.terms[int(self.term_ends[row - 1]) if row else 0 : int(self.term_ends[row])] == words[k]:
                found[k] = row
        return found

    def has(self, terms: np.ndarray, positions: np.ndarray, slop: int = 0) -> np.ndarray:
        low = np.clip(positions - slop, 0, self.n)
        high = np.clip(positions + slop + 1, 0, self.n)
        return np.searchsorted(self.places, terms * self.n + low) < np.searchsorted(self.places, terms * self.n + high)


def phrases_of(items: list[tuple[int, str]], window: int) -> dict:
    """Distinct windows of the items, the items of each, and their terms."""
    windows: dict[tuple, set] = {}
    terms: dict[bytes, int] = {}
    low_table, is_word = lower_table(), alnum_words()
    for item, text in items:
        low = low_table[np.frombuffer((text or "").encode() + b"\n", np.uint8)]
        whole = low.tobytes()
        words = [terms.setdefault(whole[a:b], len(terms)) for a, b in zip(*(x.tolist() for x in words_of(low, is_word)))]
        for at in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[at : at + window]), set()).add(item)
    names = list(terms)
    data = np.frombuffer(b"\n".join(names) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in names]) - 1 if names else np.zeros(0, np.int64)
    starts = ends - np.array([len(t) for t in names], dtype=np.int64)
    table = np.full((len(windows), window), -1, np.int64)
    for k, own in enumerate(windows):
        table[k, : len(own)] = own
    return {"names": names, "hashes": span_hashes(prefix_sums(data), starts, ends) if names else np.zeros(0, np.uint64), "table": table, "lengths": (table >= 0).sum(1), "items": [sorted(v) for v in windows.values()]}


def occurrences(shard: Shard, phrases: dict, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of all phrases in the shard, by intersection from the rarest terms on."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    table, lengths = phrases["table"], phrases["lengths"]
    if not shard.n or not len(table):
        return none
    rows = np.append(shard.term_rows(phrases["hashes"], phrases["names"]), -2)
    terms = rows[table]  # -1: absent from the shard, -2: past the phrase's end
    live = np.flatnonzero(~(terms == -1).any(1))
    if not len(live):
        return none
    terms = terms[live]
    sizes = np.append(shard.list_ends - shard.list_starts, np.iinfo(np.int64).max)[np.where(terms < 0, len(shard.list_ends), terms)]
    rarest = np.argsort(sizes, axis=1, kind="stable")
    first = rarest[:, 0]
    lead = terms[np.arange(len(live)), first]
    counts = shard.list_ends[lead] - shard.list_starts[lead]
    found_phrase, found_start = [], []
    # Candidates are opened in runs of bounded size.
    bounds = np.searchsorted(np.cumsum(counts), np.arange(0, int(counts.sum()) + 1, CANDIDATES), side="left")
    for low, high in zip(bounds, [*bounds[1:], len(live)]):
        own = np.arange(low, high)
        if not len(own):
            continue
        which = np.repeat(own, counts[own])
        inner = np.arange(len(which)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        start = shard.postings[shard.list_starts[lead[which]] + inner] - first[which]
        keep = (start >= 0) & (start + lengths[live[which]] <= shard.n)
        which, start = which[keep], start[keep]
        for k in range(1, table.shape[1]):
            offset = rarest[which, k]
            term = terms[which, offset]
            keep = (term < 0) | shard.has(np.maximum(term, 0), start + offset, slop)
            which, start = which[keep], start[keep]
            if not len(which):
                break
        last = start + lengths[live[which]] - 1
        same = np.searchsorted(shard.doc_ends, start, side="right") == np.searchsorted(shard.doc_ends, last, side="right")
        found_phrase.append(live[which[same]])
        found_start.append(start[same])
    return (np.concatenate(found_phrase), np.concatenate(found_start)) if found_phrase else none


def test_blocks(benchmark: DataFrame, most: int = QUERY_CHARS):
    """The test set's (item_id, text), in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        if block and size + len(row[1] or "") > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1] or ""))
        size += len(row[1] or "")
    yield block


HITS = "shard long, place int, doc_id long, n_words long, hit_starts array<int>, hit_ends array<int>, items array<long>"


def search(index: DataFrame, items: list, window: int = WINDOW, slop: int = 0, digest: bool = False) -> DataFrame:
    """One row per document and block of items: its words, the hit runs (word numbers, end exclusive), the items found; or their digest."""
    phrases = index.sparkSession.sparkContext.broadcast(pickle.dumps(phrases_of(items, window)))

    def run(batches):
        forget()
        asked = pickle.loads(phrases.value)
        lengths = asked["lengths"]
        for batch in batches:
            for k in range(batch.num_rows):  # one shard at a time
                ids, n_words, *cells, number = (c[k].as_py() for c in batch.columns)
                shard = Shard(np.array(n_words, np.int64), *cells)
                which, start = occurrences(shard, asked, slop)
                edge = np.zeros(shard.n + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + lengths[which], -1)
                hit = np.cumsum(edge[:-1]) > 0
                doc = np.searchsorted(shard.doc_ends, start, side="right")
                pairs = np.unique(np.stack([doc, which]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
                items_of: dict[int, set] = {}
                for d, w in pairs.T.tolist():
                    items_of.setdefault(d, set()).update(asked["items"][w])
                runs: list[tuple] = [((), ())] * len(ids)
                for d in items_of:
                    low, high = int(shard.doc_ends[d] - n_words[d]), int(shard.doc_ends[d])
                    steps = np.diff(hit[low:high].astype(np.int8), prepend=np.int8(0), append=np.int8(0))
                    runs[d] = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
                if digest:
                    yield _digest(pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), [list(zip(*r)) for r in runs], [sorted(items_of.get(d, ())) for d in range(len(ids))])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array([r[0] for r in runs], pa.list_(pa.int32())), pa.array([r[1] for r in runs], pa.list_(pa.int32())), pa.array([sorted(items_of.get(d, ())) for d in range(len(ids))], pa.list_(pa.int64()))],
                    names=["shard", "place", "doc_id", "n_words", "hit_starts", "hit_ends", "items"],
                )

    return index.mapInArrow(run, DIGEST if digest else HITS)


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(docs: pa.Array, words: pa.Array, runs: list, items: list) -> pa.RecordBatch:
    n_hit = [sum(b - a for a, b in own) for own in runs]
    names = [",".join(sorted(map(str, own))) for own in items]
    return pa.RecordBatch.from_arrays(
        [docs, words, pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(n.encode()).hexdigest() for n in names]), pa.array([n > 0 for n in n_hit])],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return described(build_index(docs)[0], benchmark, window)


def described(index: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The same, from an index."""
    blocks = test_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return search(index, first, window, digest=True)
    parts = [search(index, first, window), search(index, second, window).where("size(items) > 0")]
    parts += [search(index, block, window).where("size(items) > 0") for block in blocks]

    # Several blocks: the hits of a row meet by its place in the index, once per block.
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    met = hits.groupBy("shard", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("shard", "place")

    def merged(batches):
        for b in batches:
            runs = []
            for own in b.column(2).to_pylist():
                flat: list[list[int]] = []
                for a, e in sorted((r["hit_starts"], r["hit_ends"]) for r in own):
                    if flat and a <= flat[-1][1]:
                        flat[-1][1] = max(flat[-1][1], e)
                    else:
                        flat.append([a, e])
                runs.append(flat)
            yield _digest(b.column(0), b.column(1), runs, b.column(3).to_pylist())

    return met.mapInArrow(merged, DIGEST)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows, with all their columns, whose text holds no window of the test set."""
    rows, _ = numbered(docs)
    index, path = build_index(rows.select(F.col("row").alias("doc_id"), F.col("d.text").alias("text")))
    hit, _ = written(described(index, benchmark, window).where("contaminated").select(F.col("doc_id").alias("row")), "hit")
    drop(docs.sparkSession, path)
    return rows.join(hit, "row", "left_anti").select("d.*")


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(len(ws), 10)::INT AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1))::INT AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM i),
p AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2))::INT AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS MATERIALIZED (SELECT doc_id, i, p.n, item_id FROM p JOIN w ON p.n = w.n AND p.g = w.g),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
