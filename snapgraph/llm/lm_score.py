"""Stupid-backoff language-model scores, computed relationally from the corpus itself.

Count tables of 1-, 2- and 3-grams are partitioned by the n-gram's hash; the
n-grams of each block of documents are joined to them there and the counts go
back to the block, where they are summed per document.  A first join on short
hashes finds the n-grams that occur only once in the corpus (count 1, nothing
more to ask); all others are counted by their 64-bit hash.  A document is scored
by the rest of the corpus: its own occurrences are taken off every count first.

  S(w | u v) = c(u v w) / c(u v)                     if c(u v w) > 0
             = A * S(w | v)                           otherwise, down to
  S(w)       = c(w) / N if c(w) > 0, else 1 / (N + 1), N the words of the other documents

log10 is summed over the words; the first words of a document use the orders
that they have.  Words are lower-cased runs [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+.

Null, empty or wordless text: no words, score null.  Empty table: no rows.
Repeated rows are other documents to each other.  No count is cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.common import alnum_words, answered, bucketed, drop, forget, gram_hashes, in_order, key_order, lower_table, mapped, parts_for, prefix_sums, read_bits, repeated_bits, routed_batch, routes, span_hashes, sum_bytes, text_blocks, unpacked, unpack_small, words_of, written

ALPHA = 0.4
#: Larger blocks send a common n-gram less often.
BLOCK = 4 << 20
ORDER = 3
#: Spaces of the exchange: 1 to ORDER for short names, FULL + n for whole ones, TOTAL for the words of all texts.
FULL, TOTAL = 10, 0
ROUTED = "part int, block long, space int, n int, keys binary, counts binary"
SCORES = "doc_id long, n_words long, n_backoff long, score double"


def grams_of(data: np.ndarray, ends: np.ndarray):
    """Words per text, and for each order the n-grams that end at each word (0 where the text has too few before it) with a flag."""
    low = mapped(data, lower_table())
    starts, stops = words_of(low, alnum_words())
    words = span_hashes(prefix_sums(low), starts, stops)
    upto = np.searchsorted(starts, ends)
    n_words = np.diff(upto, prepend=0)
    place = np.arange(len(words)) - np.repeat(upto - n_words, n_words)
    orders = []
    for n in range(1, ORDER + 1):
        keys = np.zeros(len(words), np.uint64)
        keys[n - 1 :] = gram_hashes(words, n)
        orders.append((keys, place >= n - 1))
    return n_words, orders


def others(keys: np.ndarray, has: np.ndarray, doc: np.ndarray, totals: np.ndarray, ordered: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """For each word, the count of its n-gram outside its own document (0 where it has none); totals: by distinct key; ordered: key_order of the n-grams."""
    out = np.zeros(len(keys), np.int64)
    if has.any():
        order, found = key_order(keys[has]) if ordered is None else ordered
        own = doc[has][order]
        new = np.concatenate([[True], found[1:] != found[:-1]])
        runs = np.flatnonzero(new | np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(runs, append=len(own))
        rest = np.empty(len(own), np.int64)
        rest[order] = np.repeat(totals[np.cumsum(new)[runs] - 1] - counts, counts)
        out[has] = rest
    return out


def scored(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, n_backoff (words not scored by their longest n-gram), score (mean log10 of a word)."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # The texts never leave their bucket: only names and the answers to them move.
    blocks, done = bucketed(text_blocks(docs, BLOCK, packed=True), "block", max(12, -(-size // (2 * BLOCK))), "blocks")
    # Short names are enough to see that an n-gram occurs once; only a few others share them.
    bits = min(64, max(32, int(size // 2 + 1).bit_length() + 11))
    parts = parts_for(4 * size)
    cut = np.uint64(64 - bits)

    def send_short(batches):
        forget()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("block", "ends", "text")}
                _, orders = grams_of(unpacked(row["text"]), np.array(row["ends"], np.int64))
                rows = []
                for n, (keys, has) in enumerate(orders, 1):
                    distinct, counts = np.unique(keys[has] >> cut, return_counts=True)
                    rows += routes(row["block"], n, distinct, np.minimum(counts, 2), parts, bits)
                yield routed_batch(rows)

    short, short_path = written(answered(blocks.mapInArrow(send_short, ROUTED), repeated_bits), "short")

    def shared(distinct: np.ndarray, replies: pa.Table, n: int) -> np.ndarray:
        """Which of the distinct n-grams of a block may occur again."""
        names = distinct >> cut
        place = np.cumsum(names[1:] != names[:-1])
        return in_order(replies, n, read_bits).astype(bool)[np.concatenate([[0], place])] if len(distinct) else np.zeros(0, bool)

    def send_counts(key, block: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        rows: list = []
        for row in block.to_pylist():
            n_words, orders = grams_of(unpacked(row["text"]), np.array(row["ends"], np.int64))
            rows += routes(row["block"], TOTAL, np.zeros(1, np.uint64), np.array([int(n_words.sum())]), parts)
            for n, (keys, has) in enumerate(orders, 1):
                distinct, counts = np.unique(keys[has], return_counts=True)
                again = shared(distinct, replies, n)
                rows += routes(row["block"], FULL + n, distinct[again], counts[again], parts)
        return pa.Table.from_batches([routed_batch(rows)])

    full, full_path = written(answered(blocks.groupBy("block").cogroup(short.groupBy("block")).applyInArrow(send_counts, ROUTED), sum_bytes), "counts")

    def finish(key, block: pa.Table, replies: pa.Table) -> pa.Table:
        forget()
        rows = []
        for row in block.to_pylist():
            n_words, orders = grams_of(unpacked(row["text"]), np.array(row["ends"], np.int64))
            doc = np.repeat(np.arange(len(n_words)), n_words)
            total = int(in_order(replies, TOTAL, unpack_small)[0])
            c = []
            for n, (keys, has) in enumerate(orders, 1):
                ordered = key_order(keys[has])
                distinct = ordered[1][np.diff(ordered[1], prepend=~ordered[1][:1]) != 0]
                again = shared(distinct, replies, n)
                totals = np.ones(len(distinct), np.int64)
                totals[again] = in_order(replies, FULL + n, unpack_small)
                c.append(others(keys, has, doc, totals, ordered))
            rest = (total - n_words)[doc].astype(np.float64)
            value = np.where(c[0] > 0, c[0] / np.maximum(rest, 1.0), 1.0 / (rest + 1.0))
            top = c[0] > 0
            for n in range(2, ORDER + 1):
                has = orders[n - 1][1]
                context = np.concatenate([[0], c[n - 2][:-1]]) if len(doc) else c[n - 2]
                seen = has & (c[n - 1] > 0)
                value = np.where(seen, c[n - 1] / np.maximum(context, 1), np.where(has, alpha * value, value))
                top = np.where(has, seen, top)
            logs = np.log10(value)
            upto = np.cumsum(n_words)
            for d, (doc_id, n) in enumerate(zip(row["ids"], n_words.tolist())):
                own = slice(int(upto[d]) - n, int(upto[d]))
                rows.append((doc_id, n, n - int(np.count_nonzero(top[own])), float(logs[own].mean()) if n else None))
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.float64()])], names=["doc_id", "n_words", "n_backoff", "score"])

    scores, _ = written(blocks.groupBy("block").cogroup(short.unionByName(full).groupBy("block")).applyInArrow(finish, SCORES), "scores")
    done()
    for path in (short_path, full_path):
        drop(docs.sparkSession, path)
    return scores


#: The same scores in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT *, lag(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM t),
c1 AS (SELECT w, count(*) AS c FROM g GROUP BY w), o1 AS (SELECT doc_id, w, count(*) AS c FROM g GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS c FROM g WHERE i > 1 GROUP BY ALL), o2 AS (SELECT doc_id, v, w, count(*) AS c FROM g WHERE i > 1 GROUP BY ALL),
c3 AS (SELECT u, v, w, count(*) AS c FROM g WHERE i > 2 GROUP BY ALL), o3 AS (SELECT doc_id, u, v, w, count(*) AS c FROM g WHERE i > 2 GROUP BY ALL),
k1 AS (SELECT o1.doc_id, w, c1.c - o1.c AS c FROM o1 JOIN c1 USING (w)),
k2 AS (SELECT o2.doc_id, v, w, c2.c - o2.c AS c FROM o2 JOIN c2 USING (v, w)),
k3 AS (SELECT o3.doc_id, u, v, w, c3.c - o3.c AS c FROM o3 JOIN c3 USING (u, v, w)),
n AS (SELECT doc_id, (SELECT count(*) FROM t) - len(ws) AS rest, len(ws) AS n_words FROM d),
x AS (SELECT g.doc_id, g.i, n.rest, a.c AS c1, b.c AS c2, p.c AS cv, e.c AS c3, f.c AS cuv FROM g JOIN n USING (doc_id)
  JOIN k1 a ON a.doc_id = g.doc_id AND a.w = g.w
  LEFT JOIN k1 p ON p.doc_id = g.doc_id AND p.w = g.v
  LEFT JOIN k2 b ON b.doc_id = g.doc_id AND b.v = g.v AND b.w = g.w
  LEFT JOIN k2 f ON f.doc_id = g.doc_id AND f.v = g.u AND f.w = g.v
  LEFT JOIN k3 e ON e.doc_id = g.doc_id AND e.u = g.u AND e.v = g.v AND e.w = g.w),
s AS (SELECT *, CASE WHEN c1 > 0 THEN c1 / greatest(rest, 1)::DOUBLE ELSE 1.0 / (rest + 1.0) END AS s1 FROM x),
s2 AS (SELECT *, CASE WHEN i < 2 THEN s1 WHEN c2 > 0 THEN c2 / cv::DOUBLE ELSE 0.4 * s1 END AS s2 FROM s),
s3 AS (SELECT *, CASE WHEN i < 3 THEN s2 WHEN c3 > 0 THEN c3 / cuv::DOUBLE ELSE 0.4 * s2 END AS s3,
  CASE WHEN i = 1 THEN c1 > 0 WHEN i = 2 THEN c2 > 0 ELSE c3 > 0 END AS top FROM s2)
SELECT n.doc_id, n.n_words::BIGINT AS n_words, count(*) FILTER (WHERE NOT top)::BIGINT AS n_backoff, round(avg(log10(s3)), 6) AS score
FROM n LEFT JOIN s3 USING (doc_id) GROUP BY n.doc_id, n.n_words
"""
