"""Cuts texts where no token of a vocabulary can cross, and remembers the tokens of each distinct piece.

Both vocabularies split a text by character class before any merge, so the
tokens of a text are those of its pieces, one after the other.  Cuts are made
only where the class on both sides is certain (ASCII and Latin-1 letters); other
characters stay with their neighbours, and the library splits them.  Strings of
special tokens are never cut.  Pieces are known by 64-bit fingerprints.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain, compress
from operator import attrgetter

import numpy as np

from snapgraph.llm.common import lower_table, mapped, mix

LETTER, DIGIT, MARK, APOSTROPHE, SPACE, LINE = 1, 2, 3, 4, 5, 6
#: Distinct pieces a worker keeps; beyond, it starts again.
MEMO = 1_500_000
#: Pieces that the library gets at once: each leaves objects of its own until its ids are read.
AT_ONCE = 4096
#: Text bytes that are looked up at once, so that eight bytes for each stay in a core's cache.
LOOK_UP_BYTES = 1 << 17


def classes(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[33:127] = MARK
    table[65:91] = table[97:123] = LETTER
    table[48:58] = DIGIT
    table[39] = APOSTROPHE
    table[32] = SPACE
    table[[9, 10, 13]] = LINE
    found = mapped(data, table).copy()
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    found[lead] = LETTER
    found[lead + 1] = LETTER
    return found


def _pairs(rules: dict[int, tuple[int, ...]]) -> np.ndarray:
    table = np.zeros((32, 8), bool)
    for left, rights in rules.items():
        table[left, list(rights)] = True
    return table.reshape(-1)


#: White space goes with what follows it.
KEEP_SPACE = _pairs({LETTER: (DIGIT, MARK, APOSTROPHE, SPACE, LINE), DIGIT: (LETTER, MARK, APOSTROPHE, SPACE, LINE), MARK: (LETTER, DIGIT, SPACE, LINE), APOSTROPHE: (SPACE, LINE)})
#: White space is in no token.
DROP_SPACE = _pairs({LETTER: (DIGIT, MARK, APOSTROPHE, SPACE, LINE), DIGIT: (LETTER, MARK, APOSTROPHE, SPACE, LINE), MARK: (LETTER, DIGIT, SPACE, LINE), APOSTROPHE: (SPACE, LINE), 0: (SPACE, LINE), SPACE: tuple(range(5)), LINE: tuple(range(5))})


def cuts(data: np.ndarray, ends: np.ndarray, drop_space: bool, specials: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a block; ``ends`` are the places of the line feeds after its texts."""
    kinds = classes(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = mapped((kinds[:-1] << 3) | kinds[1:], DROP_SPACE if drop_space else KEEP_SPACE)
    if not drop_space:  # one line feed between sure characters is a token of its own
        sure = (kinds >= LETTER) & (kinds <= APOSTROPHE)
        cut[2:-1] |= (kinds[1:-1] == LINE) & sure[:-2] & sure[2:]
    whole = data.tobytes()
    for special in specials:
        at = whole.find(special)
        while at >= 0:
            cut[at + 1 : at + len(special)] = False
            at = whole.find(special, at + 1)
    cut[ends] = True
    cut[ends + 1] = True
    cut[0] = True
    marks = np.flatnonzero(cut)
    starts, stops = marks[:-1], marks[1:]
    keep = np.ones(len(starts), bool)
    keep[np.searchsorted(starts, ends)] = False  # the line feeds after the texts
    if drop_space:
        keep &= kinds[starts] < SPACE
    return starts[keep], stops[keep]


#: Masks of the first 0 to 8 bytes of a little-endian word.
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer pieces are hashed one by one.
_SHORT = 32


def fingerprints(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of data[start:stop], eight bytes at a step; equal bytes have equal ones."""
    words = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    words = np.ascontiguousarray(words)  # aligned, which taking needs
    lengths = stops - starts
    out = mix(words[starts] & _HEADS[np.minimum(lengths, 8)] ^ lengths.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    left = np.flatnonzero(lengths > 8)
    for k in range(8, _SHORT, 8):
        if not len(left):
            break
        out[left] = mix(out[left] ^ (words[starts[left] + k] & _HEADS[np.minimum(lengths[left] - k, 8)]))
        left = left[lengths[left] > k + 8]
    for i, a, b in zip(left.tolist(), starts[left].tolist(), stops[left].tolist()):
        out[i] = int.from_bytes(hashlib.blake2b(data[a:b].data, digest_size=8).digest(), "little")
    return out


def _byte_letters() -> np.ndarray:
    """The character by which a byte-level vocabulary writes each byte: itself where it can be printed, else one from 256 on."""
    plain = np.zeros(256, bool)
    plain[33:127] = plain[161:173] = plain[174:] = True
    return np.where(plain, np.arange(256), 255 + np.cumsum(~plain)).astype("<u2")


_LETTERS = _byte_letters()
_LETTERS[10] = 10  # the line feed parts pieces here
#: Pieces that a byte-level vocabulary leaves whole before its merges: one class, and a space before it at most.
_WHOLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)").fullmatch
#: Longer pieces are not matched, since a match takes memory for each of its letters.
LONGEST = 256


class Table:
    """Open addressing: 64-bit fingerprint -> row; at most half full."""

    def __init__(self, size: int = 1 << 16):
        self.keys, self.rows, self.count = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for those it does not hold."""
        at = (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)
        out = self.rows[at]
        left = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        at, sought = at[left], keys[left]
        while len(left):
            at = at + 1 & len(self.keys) - 1
            rows = self.rows[at]
            out[left] = rows
            on = (self.keys[at] != sought) & (rows >= 0)
            left, at, sought = left[on], at[on], sought[on]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that it does not hold."""
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            held = self.rows >= 0
            keys, rows = np.concatenate([self.keys[held], keys]), np.concatenate([self.rows[held], rows])
            size = 1 << (2 * self.count - 1).bit_length()
            self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        at, rows = (keys & np.uint64(len(self.keys) - 1)).astype(np.int64), rows.astype(np.int32)
        while len(keys):
            free = self.rows[at] < 0
            self.rows[at[free]] = rows[free]
            own = self.rows[at] == rows  # of several at one place, the one that stayed
            self.keys[at[own]] = keys[own]
            keys, rows, at = keys[~own], rows[~own], at[~own] + 1 & len(self.keys) - 1


class PieceMemo:
    """Ids of each distinct piece, kept as arrays: fingerprint -> run of a pool."""

    def __init__(self, path: str, lower: bool, specials: tuple[bytes, ...], drop_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads cost time and memory
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower, self.specials, self.drop_space = lower, specials, drop_space
        before, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        plain = self.tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        self.merges = model if plain and isinstance(model, models.BPE) else None
        self._reset()

    def _reset(self):
        self.table = Table()
        self.lengths, self.offsets, self.pool = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.pooled = 0

    def _place(self, name: str, at: int, values: np.ndarray):
        """Puts the values behind the first ``at``; the array grows by a quarter, so that it is rarely copied."""
        have = getattr(self, name)
        if at + len(values) > len(have):
            more = np.empty(max(at + len(values), len(have) + len(have) // 4, 1 << 12), have.dtype)
            more[:at] = have[:at]
            setattr(self, name, more)
            have = more
        have[at : at + len(values)] = values

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, by the whole of the library's steps."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids begin, how many they are, and the ids; a piece that the library's first steps would leave whole goes to its merges at once."""
        whole = np.fromiter((self.merges is not None and len(p) <= LONGEST and _WHOLE(p) is not None for p in pieces), bool, len(pieces))
        lengths = np.empty(len(pieces), np.int32)
        cell = b"\n".join(compress(pieces, whole.tolist()))
        written = _LETTERS[np.frombuffer(cell, np.uint8)].tobytes().decode("utf-16-le").split("\n") if cell else []
        merged = [self.merges.tokenize(w) for w in written]
        lengths[whole] = np.fromiter(map(len, merged), np.int32, len(merged))
        other = self.encode([p.decode() for p in compress(pieces, (~whole).tolist())])
        lengths[~whole] = np.fromiter(map(len, other), np.int32, len(other))
        ids = np.fromiter(chain(map(attrgetter("id"), chain.from_iterable(merged)), chain.from_iterable(other)), np.uint32, int(lengths.sum()))
        order = np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])
        begins = np.empty(len(pieces), np.int64)
        begins[order] = np.cumsum(lengths[order], dtype=np.int64) - lengths[order]
        return begins, lengths, ids

    def look_up(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, and for each the row of the memo that holds its ids."""
        starts, stops = cuts(data, ends, self.drop_space, self.specials)
        hashes = fingerprints(mapped(data, lower_table()) if self.lower else data, starts, stops)
        rows = self.table.find(hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            distinct, first, again = np.unique(hashes[new], return_index=True, return_inverse=True)
            if self.table.count + len(distinct) > MEMO and self.table.count:
                self._reset()
                new = np.arange(len(hashes))
                distinct, first, again = np.unique(hashes, return_index=True, return_inverse=True)
            base, at, whole = self.table.count, new[first], data.tobytes()
            for k in range(0, len(at), AT_ONCE):
                some = at[k : k + AT_ONCE]
                begins, lengths, ids = self.runs([whole[a:b] for a, b in zip(starts[some].tolist(), stops[some].tolist())])
                self._place("offsets", base + k, self.pooled + begins)
                self._place("lengths", base + k, lengths)
                self._place("pool", self.pooled, ids)
                self.pooled += len(ids)
            self.table.add(distinct, base + np.arange(len(distinct)))
            rows[new] = base + again
        return starts, stops, rows

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the number of ids up to each piece's end."""
        lengths = self.lengths[rows].astype(np.int64)
        sums = np.cumsum(lengths)
        total = int(sums[-1]) if len(sums) else 0
        at = np.repeat(self.offsets[rows] - (sums - lengths), lengths) + np.arange(total)
        return self.pool[at], sums
