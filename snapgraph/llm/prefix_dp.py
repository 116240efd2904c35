"""The exact number of byte-pair tokens of every prefix of a string, by dynamic programming over its bytes.

Merging pairs in order of rank has a property that makes this linear: a sequence of
tokens is what merging gives if and only if each two neighbours are what merging
gives for the two of them.  So the last token of a prefix is the one token that
ends there and may follow the last token of the prefix before it, and the count
of a prefix is one more than the count of that one.  Nothing is encoded.

A word's last character is another symbol than the same one inside it (the
vocabulary's end-of-word mark).  So the table holds prefixes without the mark,
and a prefix that is to be a word ends with a marked token on top of it.
"""

from __future__ import annotations

import json
import unicodedata

import regex

#: The split into words of the vocabulary: fixed values.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.mark = model["end_of_word_suffix"]
        self.vocabulary = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocabulary)
        self._fits: dict[tuple[str, str], bool] = {}
        self._parts: dict[str, list[str]] = {}

    def _merged(self, parts: list[str]) -> list[str]:
        """A few symbols merged in order of rank, the leftmost of equal pairs first."""
        parts = list(parts)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: (self.rank.get((parts[k], parts[k + 1]), len(self.rank)), k))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _spelled(self, token: str) -> list[str]:
        if token not in self._parts:
            marked = token.endswith(self.mark) and token != self.mark
            chars = list(token.removesuffix(self.mark) if marked else token)
            if marked:
                chars[-1] += self.mark
            self._parts[token] = chars
        return self._parts[token]

    def follows(self, before: str | None, token: str) -> bool:
        """Whether merging keeps the two apart (or the one whole, at a word's begin)."""
        key = (before or "", token)
        if key not in self._fits:
            want = [token] if before is None else [before, token]
            self._fits[key] = self._merged([c for t in want for c in self._spelled(t)]) == want
        return self._fits[key]

    def word(self, text: str) -> list[int]:
        """Tokens of each prefix of one word, by characters: element k is for the first k + 1 of them."""
        raw = [self.symbols[b] for b in text.encode()]
        ends, at = [], 0
        for c in text:
            at += len(c.encode())
            ends.append(at)
        joined = "".join(raw)
        last: list[str | None] = [None]  # of each prefix without the mark
        counts, found = [0], []
        stops = set(ends)
        for j in range(1, len(raw) + 1):
            own, n = None, -1
            marked = -1
            for i in range(max(0, j - self.longest), j):
                if counts[i] < 0:
                    continue
                piece = joined[i:j]
                if own is None and piece in self.vocabulary and self.follows(last[i], piece):
                    own, n = piece, counts[i] + 1
                if marked < 0 and j in stops and piece + self.mark in self.vocabulary and self.follows(last[i], piece + self.mark):
                    marked = counts[i] + 1
                if own is not None and (marked >= 0 or j not in stops):
                    break
            last.append(own)
            counts.append(n)
            if j in stops:
                found.append(marked)
        return found

    def prefixes(self, piece: str) -> list[int] | None:
        """Tokens of each prefix of a piece, by characters; None where a prefix is not normalised as the whole is."""
        lowered = [c.lower() for c in piece]
        if any(len(c) != 1 or unicodedata.normalize("NFC", c) != c or c.isspace() for c in lowered) or any(unicodedata.normalize("NFC", c) != c for c in piece):
            return None
        text = "".join(lowered)
        if unicodedata.normalize("NFC", piece) != piece or unicodedata.normalize("NFC", text) != text:
            return None
        out: list[int] = []
        before = 0
        for m in WORD.finditer(text):
            word = m.group()
            if m.start() != len(out):
                return None
            own = self.word(word)
            if word in CONTRACTIONS:  # a shorter head is the apostrophe, or it and a word of one letter
                own = [self.word("'")[0], *(self.word("'")[0] + self.word(word[1:k])[-1] for k in range(2, len(word))), own[-1]]
            out += [before + n for n in own]
            before = out[-1]
        return out if len(out) == len(piece) else None
