"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every prefix ends in one token that no other choice can replace, so a table of last tokens is enough:
an automaton with suffix links gives the vocabulary entries that end at a position, longest first; the first whose
predecessor (the last token of the shorter prefix) forms a compatible pair is the one. Following the table back from the
end emits the ids. Two tokens are compatible if merging the bytes around their seam never joins them, which is decided
by undoing their merges from the seam outwards.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from itertools import chain, islice

#: Fixed value: the public pattern that splits text before merging; {L}, {N}, {S} are letters, numbers, white space.
#: Letters stand before the contractions, as no text starts with both.
SPLIT = " ?[{L}]+| ?[{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
SPACE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def char_class(first_letter: str, last: int) -> str:
    """The ranges of a general category up to a code point, for the re module; up to U+FFFF it makes them a bitmap."""
    spans: list[list[int]] = []
    for c in range(last + 1):
        if unicodedata.category(chr(c))[0] == first_letter:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


class Pieces(dict):
    """Known pieces and their ids; a new one is encoded, and at the limit the oldest half goes."""

    def __init__(self, encode, limit: int) -> None:  # noqa: ANN001
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(piece) > 100:  # long pieces hardly come again
            return self.encode(piece)
        if len(self) >= self.limit:
            for old in list(islice(self, self.limit // 2)):
                del self[old]
        ids = self[piece] = self.encode(piece)
        return ids


class PrefixEncoder:
    """Encodes texts with the ranks of a vocabulary file (a line for each token: its bytes in base64, its rank)."""

    def __init__(self, rank_file: bytes, cache_limit: int = 400_000) -> None:
        import ahocorasick

        self.rank = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, rank_file.splitlines() if rank_file else ())}
        self.bytes_of = {i: t for t, i in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.rank.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.basic, self.whole = self._splitter(0xFFFF), None
        self.cache = Pieces(self.encode_piece, cache_limit)
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _splitter(last: int):  # noqa: ANN205
        import re

        return re.compile(SPLIT.format(S=SPACE, L=char_class("L", last), N=char_class("N", last))).findall

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte gives itself twice."""
        found = self.halves.get(token)
        if found is None:
            parts = list(self.bytes_of[token])
            while len(parts) > 2:
                at = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], sys.maxsize) if parts[i] + parts[i + 1] != self.bytes_of[token] else sys.maxsize, i))
                joined = parts[at] + parts[at + 1]
                k, out = 0, []
                while k < len(parts):
                    if k + 1 < len(parts) and parts[k] + parts[k + 1] == joined:
                        out.append(joined)
                        k += 2
                    else:
                        out.append(parts[k])
                        k += 1
                parts = out
            found = (self.rank[parts[0]], self.rank[parts[-1]]) if len(parts) == 2 else (token, token)
            self.halves[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens in a row are encoded as just these two."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = sys.maxsize  # a merge across the seam counts only if it comes before the merge just undone
        while True:
            if self.rank.get(self.bytes_of[left] + self.bytes_of[right], sys.maxsize) < limit:
                return False
            # undo the later merge: the right token's is the later one on equal ranks, as merges run from the left
            undo_left = left > right
            for side in (undo_left, not undo_left):
                if side and len(self.bytes_of[left]) > 1:
                    limit, left = left, self.split(left)[1]
                    break
                if not side and len(self.bytes_of[right]) > 1:
                    limit, right = right + 1, self.split(right)[0]
                    break
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.rank.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        last = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(data):
            e = end + 1
            if last[e] < 0:
                start = e - length
                if start == 0 or (last[start] >= 0 and self.compatible(last[start], token)):
                    last[e], size[e] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return tuple(reversed(out))

    def pieces(self, text: str) -> list[str]:
        if not sys.getsizeof(text) > 4 * len(text) > 0:
            return self.basic(text)
        if self.whole is None:  # four bytes for a character: some lie beyond U+FFFF
            self.whole = self._splitter(sys.maxunicode)
        return self.whole(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.pieces(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.cache.__getitem__, self.pieces(text))))
