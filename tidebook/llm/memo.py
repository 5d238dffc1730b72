"""Encoding by pieces that repeat: a bounded memory of pieces already encoded, per Python worker.

A text is cut where its tokenizer never joins anything, so that the pieces' ids, put together, are the
text's ids. Natural text repeats pieces; each is encoded once and its ids are copied by numpy.
"""

from __future__ import annotations

from array import array

import numpy as np

#: Longer pieces are encoded anew each time.
LONG_PIECE = 48


class Codes(dict):
    """Numbers of pieces; a new piece gets the next number and is noted. ``split`` may name two shorter pieces
    whose ids make up the piece's."""

    def __init__(self, split):
        self.split, self.fresh = split, []

    def __missing__(self, piece: str) -> int:
        parts = self.split(piece)
        made_of = (self[parts[0]], self[parts[1]]) if parts else piece
        self.fresh.append(made_of)
        number = self[piece] = self.count = self.count + 1
        return number

    count = -1


class PieceMemo:
    """Ids of pieces, stored end to end. Subclasses say how to cut a text, split a piece, and encode pieces."""

    #: Pieces remembered at once (some 200 bytes each); then the memory starts afresh.
    MOST_PIECES = 400_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.known = Codes(self.split)
        self.ids = array("I")
        self.bounds = array("q", [0])

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def split(self, piece: str) -> tuple[str, str] | None:
        """Two pieces whose ids, one after the other, are the piece's; None if it must be encoded whole."""
        return None

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self) -> None:
        """Store the ids of the pieces that got a number lately, in the order of their numbers."""
        fresh, self.known.fresh = self.known.fresh, []
        whole = iter(self.encode_pieces([p for p in fresh if type(p) is str]))
        ids, bounds = self.ids, self.bounds
        for made_of in fresh:
            if type(made_of) is str:
                ids.extend(next(whole))
            else:
                for part in made_of:
                    ids.extend(ids[bounds[part] : bounds[part + 1]])
            bounds.append(len(ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        if len(self.known) > self.MOST_PIECES:
            self.clear()
        pieces: list[str] = []
        cuts = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            pieces += self.cut(text)
            cuts[i + 1] = len(pieces)
        before = self.known.count
        codes = np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces))
        if self.known.fresh:
            self.learn()
        bounds = np.frombuffer(self.bounds, np.int64)
        first = bounds[codes]
        size = bounds[codes + 1] - first
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        ids = flat[np.repeat(first - ends + size, size) + np.arange(total)]
        upto = np.concatenate([[0], ends])[cuts]
        del bounds, flat
        if self.known.count > before:
            for piece in {p for p in pieces if len(p) > LONG_PIECE}:
                del self.known[piece]
        return ids, np.diff(upto)


class NumberTable:
    """Numbers 0, 1, 2, ... for 64-bit keys, in an open-addressing numpy table that takes many keys at a time."""

    def __init__(self, bits: int):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a new one."""
        at = self.home(keys)
        out = self.numbers[at]
        left = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(left):
            at_left = at[left] = (at[left] + 1) & (len(self.keys) - 1)
            out[left] = self.numbers[at_left]
            left = left[(self.keys[at_left] != keys[left]) & (out[left] >= 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give distinct new keys the next numbers, in order."""
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):
            free = np.flatnonzero(self.numbers[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.numbers[at[placed]] = keys[left[placed]], self.count + left[placed]
            rest = np.ones(len(left), bool)
            rest[placed] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)
        self.count += len(keys)
