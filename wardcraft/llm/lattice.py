"""The lattice of vocabulary pieces over a text, for segmentation and for sums over segmentations.

The vocabulary is a public SentencePiece model file. In it a space becomes U+2581, a text gets one in front, and no
piece has U+2581 after another character, nor a line break beside one (checked on load). So every path through
the lattice passes the boundaries before a run of U+2581 and around line breaks: the lattice of a text is a chain
of independent lattices of short segments, and segments repeat. All work is done once per distinct segment.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import pairwise

import ahocorasick
import numpy as np
import public_tokenizers
import sentencepiece

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: A character without a piece costs this much more than the worst piece, as in SentencePiece.
UNKNOWN = 10.0


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a model file: ids, scores, and the bytes that each id stands for."""

    def __init__(self, path: str):
        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.text: list[bytes] = [b""] * n
        self.bytes = [-1] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.text[i] = piece.encode()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in self.ids) or -1 in self.bytes:
            raise ValueError("this vocabulary has pieces across words, or no byte pieces")
        #: Every beginning of a piece, with the piece's id or -1 if it is only a beginning.
        self.trie = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)} | self.ids
        self.longest = max(map(len, self.ids), default=1)
        #: Finds all pieces in a text, with (length, id, cost) of each. A node's characters are searched in the order of their addition, so the frequent pieces go first.
        self.finder = ahocorasick.Automaton()
        for p, i in sorted(self.ids.items(), key=lambda x: -self.scores[x[1]]):
            self.finder.add_word(p, (len(p), i, -self.scores[i]))
        if self.ids:
            self.finder.make_automaton()
        self.single = frozenset(p for p in self.ids if len(p) == 1)
        #: Neighbouring characters within pieces. Between any others each path has a boundary.
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._flat = np.frombuffer(b"".join(self.text), np.uint8)
        self._length = np.array([len(x) for x in self.text], np.int64)
        self._start = np.cumsum(self._length) - self._length
        self.unknown = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN

    def edges(self, segment: str) -> list[tuple[int, int, int]]:
        """(start, end, id) by start, then end; -1 for a character without a piece of its own."""
        out, trie, n = [], self.trie, len(segment)
        for i in range(n):
            j = i + 1
            piece = trie.get(segment[i:j])
            out.append((i, j, -1 if piece is None else piece))
            while piece is not None and j < n:
                j += 1
                piece = trie.get(segment[i:j])
                if piece is not None and piece >= 0:
                    out.append((i, j, piece))
        return out

    def split(self, segment: str) -> list[str]:
        """The segment cut wherever every path has a boundary."""
        pairs, out, at = self.pairs, [], 0
        for k, (a, b) in enumerate(pairwise(segment), 1):
            if a + b not in pairs:
                out.append(segment[at:k])
                at = k
        out.append(segment[at:])
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids, without the space in front."""
        ids = np.asarray(ids, np.int64)
        length = self._length[ids]
        ends = np.cumsum(length)
        at = np.repeat(self._start[ids] - (ends - length), length) + np.arange(ends[-1] if len(ids) else 0)
        return self._flat[at].tobytes().decode("utf-8", "replace").replace(SPACE, " ")[1:]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def segments(text: str) -> list[str]:
    """The independent segments of a text; none for an empty one."""
    return SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class PieceTable:
    """The beginnings of pieces by a hash of their characters, to look many up at once."""

    BASE, SPREAD, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 19

    def __init__(self, vocabulary: Pieces):
        words = list(vocabulary.trie)
        keys = np.zeros(len(words), np.uint64)
        for k, w in enumerate(words):
            h = 0
            for ch in w:
                h = (h * int(self.BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        if len(np.unique(keys)) < len(keys) or not keys.all():
            raise ValueError("two pieces have the same hash")
        size = 1 << max(self.BITS, int(np.ceil(np.log2(4 * len(words)))))
        self.mask, self.shift = np.uint64(size - 1), np.uint64(20)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -2, np.int64)
        self.probes = 1
        for key, w in zip(keys.tolist(), words, strict=True):
            at, n = int(self._slot(np.uint64(key))), 1
            while self.keys[at]:
                at, n = (at + 1) & (size - 1), n + 1
            self.keys[at], self.values[at] = key, vocabulary.trie[w]
            self.probes = max(self.probes, n)

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return ((h * self.SPREAD) >> self.shift) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece id, -1 for a mere beginning, -2 for neither."""
        slot = self._slot(h).astype(np.int64)
        out = np.full(len(h), -2, np.int64)
        left = np.arange(len(h))
        for _ in range(self.probes):
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (key != 0)]
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & int(self.mask)
        return out

    def forward(self, words: list[str], probabilities: np.ndarray, unknown: float) -> np.ndarray:
        """For each word and each column of probabilities (a row per piece): the log of the sum over all segmentations of the product of their pieces."""
        size, n = max(map(len, words)), len(words)
        chars = np.frombuffer("".join([w.ljust(size, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, size).astype(np.uint64) + np.uint64(1)
        length = np.array([len(w) for w in words])
        a = np.zeros((size + 1, n, probabilities.shape[1]))
        a[0] = 1.0
        for i in range(size):
            rows = np.flatnonzero(length > i)
            h = chars[rows, i]
            piece = self.find(h)
            own = piece >= 0
            a[i + 1][rows[own]] += a[i][rows[own]] * probabilities[piece[own]]
            a[i + 1][rows[~own]] += a[i][rows[~own]] * unknown
            k = i + 1
            while k < size:
                on = (piece > -2) & (length[rows] > k)
                rows, h = rows[on], h[on]
                if not len(rows):
                    break
                h = h * self.BASE + chars[rows, k]
                piece = self.find(h)
                k += 1
                own = piece >= 0
                a[k][rows[own]] += a[i][rows[own]] * probabilities[piece[own]]
        return np.log(np.maximum(a[length, np.arange(n)], 1e-300))


@cache
def piece_table(path: str) -> PieceTable:
    return PieceTable(pieces(path))
