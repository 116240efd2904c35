"""Token counts: the exact count at every prefix, by dynamic programming.

The prefix table of a text: it is cut where no token can cross, and
count[k] = count[k-1] + tokens(piece k) is stored for every cut.  The count of a
whole piece comes from the tokenizers library once per distinct piece and worker.
Between two cuts, ``count_at`` and ``longest_prefix`` read the counts of the piece's
own prefixes, which ``prefix_dp`` makes in linear time from the vocabulary alone
and which are kept as well.  So truncation and budget questions never encode a
text again.  Only a piece whose prefixes are normalised otherwise than the whole
(characters that compose) asks the library for its heads.

Null text: empty, 0 tokens.  Empty table: no rows.  Repeated rows: one row each.
Very long texts: whole, in a block of their own.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapgraph.llm.common import id_and_text, joined, kept, slices
from snapgraph.llm.pieces import PieceMemo
from snapgraph.llm.prefix_dp import PrefixCounter

LIMIT = 2048
#: Strings of the vocabulary's special tokens, which the library finds in any text.
SPECIALS = (b"<|startoftext|>", b"<|endoftext|>")
TABLE = "doc_id long, n_bytes long, n_tokens long, fit_bytes long, ends binary, counts binary"


def memo_for(path: str) -> PieceMemo:
    return kept(("counts", path), lambda: PieceMemo(path, lower=True, specials=SPECIALS, drop_space=True))


def tables(col: pa.Array, memo: PieceMemo):
    """For each text: its bytes, the ends of its pieces (from the text's start) and the tokens up to each."""
    data, ends = joined(col)
    starts, stops, rows = memo.look_up(data, ends)
    sums = np.cumsum(memo.lengths[rows], dtype=np.int64)
    upto = np.searchsorted(starts, ends)
    begin, first, before = 0, 0, 0
    for end, last in zip(ends.tolist(), upto.tolist()):
        own = sums[first:last] - before
        yield end - begin, stops[first:last] - begin, own
        before = int(sums[last - 1]) if last else 0
        begin, first = end + 1, last


class Prefixes:
    """Answers about one text from its stored prefix table, without encoding it again."""

    def __init__(self, text: str, ends: np.ndarray, counts: np.ndarray, memo: PieceMemo, counter: PrefixCounter):
        self.raw, self.ends, self.counts, self.memo, self.counter = text.encode(), ends, counts, memo, counter
        self._within: dict[bytes, tuple[list[int], list[int]]] = {}

    def within(self, piece: bytes) -> tuple[list[int], list[int]]:
        """Bytes and tokens of the piece's own prefixes, the empty one first."""
        if piece not in self._within:
            text = piece.decode()
            counts = None if any(s in piece for s in SPECIALS) else self.counter.prefixes(text)
            if counts is None:
                counts = [len(ids) for ids in self.memo.encode([text[:k] for k in range(1, len(text) + 1)])]
            self._within[piece] = [0, *accumulate(len(c.encode()) for c in text)], [0, *counts]
        return self._within[piece]

    def _piece(self, k: int) -> tuple[int, int, bytes]:
        before, start = (int(self.counts[k - 1]), int(self.ends[k - 1])) if k else (0, 0)
        gap = self.raw[start : int(self.ends[k])]
        piece = gap.lstrip(b" \t\n\r")
        return before, start + len(gap) - len(piece), piece

    def count_at(self, size: int) -> int:
        """Tokens of the first ``size`` bytes (which end at a character's end)."""
        k = int(np.searchsorted(self.ends, size, side="left"))
        if k == len(self.ends):
            return int(self.counts[-1]) if k else 0
        before, start, piece = self._piece(k)
        sizes, counts = self.within(piece)
        at = bisect_left(sizes, size - start)
        return before + (counts[at] if at < len(sizes) and sizes[at] == size - start else 0)

    def longest_prefix(self, budget: int) -> int:
        """Bytes of the whole pieces, and of the next piece's longest head, that take at most ``budget`` tokens."""
        k = int(np.searchsorted(self.counts, budget, side="right"))
        if k == len(self.ends):
            return len(self.raw)
        before, start, piece = self._piece(k)
        return start + max(b for b, n in zip(*self.within(piece)) if before + n <= budget)


def prefix_table(docs: DataFrame, path: str, limit: int = LIMIT, keep_table: bool = True) -> DataFrame:
    """One row per document: its counts and the two arrays of its prefix table (little-endian int32, null unless kept).

    fit_bytes, read off the table: where the longest run of whole pieces with at most ``limit`` tokens ends.
    """

    def run(batches):
        memo = memo_for(path)
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for size, ends, sums in tables(part.column(1), memo):
                    k = int(np.searchsorted(sums, limit, side="right"))
                    arrays = (ends.astype("<i4").tobytes(), sums.astype("<i4").tobytes()) if keep_table else (None, None)
                    rows.append((size, int(sums[-1]) if len(sums) else 0, int(ends[k - 1]) if k else 0, *arrays))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.binary()] * 2))], names=["doc_id", "n_bytes", "n_tokens", "fit_bytes", "ends", "counts"])

    return id_and_text(docs).mapInArrow(run, TABLE)


def budget_table(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_bytes."""
    return prefix_table(docs, path, limit, keep_table=False).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_bytes")
