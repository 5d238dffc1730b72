"""Periodic runs: where a text repeats a passage of words again and again, and the text without the repeats.

Words are what white space parts. A run is a stretch of words with smallest period q (words q apart are equal) that
no neighbour extends, at least ``LEAST`` words and 2 q long. ``collapsed`` is the text's words without those that lie
in a run after its first q words, joined by single spaces.

Method: a suffix tree of the words and one of their reversal (Ukkonen), each with an Euler tour whose range minima
answer longest-common-extension queries in constant time: numpy takes all queries at once, a query reads two block
minima of a sparse table, or the few places of one block. Leaf order ranks the suffixes; the next suffix that ranks
lower (and the next that ranks higher, for the reversed alphabet) ends the longest Lyndon word at a place. Each such
word is the candidate for the root of a run and is extended both ways; by the runs theorem no run has another root.

Every word of a run lies in a window of ``LEAST / 2`` words that the run holds twice, since the run has that many
words beyond its period. So trees are built over the stretches covered by windows that occur twice in them, which
loses no run; a stretch cut off this way holds its runs whole. Stretches are put end to end, parted by symbols that
occur once, until a tree has ``TREE_WORDS`` words; a longer stretch has trees of its own, of some 500 bytes a word.

NULL and empty texts have no runs and an empty collapsed text. Repeated rows each get their row. An empty table
gives no row. Runs are listed by start, then period. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import lists, mixed, pieces, text_buffers, text_key

LEAST = 12
TREE_WORDS = 1 << 14
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def suffix_tree(symbols: list[int], alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of symbols below ``alphabet`` that end in one that occurs nowhere else. For each node but the
    root (0): the parent, the first symbol of its edge, where the edge starts and how long it is."""
    n = len(symbols)
    start, end, link = [0], [0], [0]
    child: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, symbol in enumerate(symbols):
        waiting += 1
        unlinked = 0
        while waiting:
            if not length:
                edge = i
            key = node * alphabet + symbols[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                at = start[below]
                span = end[below] - at
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if symbols[at + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                inner = len(start)
                child[key] = inner
                child[inner * alphabet + symbol] = inner + 1
                child[inner * alphabet + symbols[at + length]] = below
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                start[below] = at + length
                if unlinked:
                    link[unlinked] = inner
                unlinked = inner
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    keys = np.fromiter(child.keys(), np.int64, len(child))
    nodes = np.fromiter(child.values(), np.int64, len(child))
    parent, first = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    parent[nodes], first[nodes] = keys // alphabet, keys % alphabet
    begin = np.array(start, np.int64)
    return parent, first, begin, np.array(end, np.int64) - begin


class RangeMin:
    """Minima of ranges in constant time: block minima in a sparse table, running minima inside blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        size = self.BLOCK
        padded = np.full(-(-len(values) // size) * size, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        rows = padded.reshape(-1, size)
        self.values = padded
        self.upto = np.minimum.accumulate(rows, axis=1).ravel()
        self.since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(rows):
            above = self.levels[-1]
            self.levels.append(np.minimum(above[:-half], above[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each range, both ends included."""
        out = np.minimum(self.since[low], self.upto[high])
        first, last = low // self.BLOCK + 1, high // self.BLOCK
        same = np.flatnonzero(first > last)
        out[same] = self.values[low[same]]
        for step in range(1, self.BLOCK):
            out[same] = np.minimum(out[same], self.values[np.minimum(low[same] + step, high[same])])
        wide = np.flatnonzero(last > first)
        level = np.frexp((last - first)[wide])[1] - 1
        for k in np.unique(level):
            chosen = wide[level == k]
            table = self.levels[k]
            out[chosen] = np.minimum(out[chosen], np.minimum(table[first[chosen]], table[last[chosen] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of pairs of suffixes, and the rank of each suffix."""

    def __init__(self, symbols: list[int], alphabet: int):
        parent, first, start, length = suffix_tree(symbols, alphabet)
        nodes = len(parent)
        by = np.lexsort((first[1:], parent[1:])) + 1
        next_child, sibling = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        heads = np.flatnonzero(np.append(True, parent[by][1:] != parent[by][:-1]))
        next_child[parent[by[heads]]] = by[heads]
        sibling[by[:-1]] = np.where(parent[by[:-1]] == parent[by[1:]], by[1:], 0)
        inner = next_child > 0
        tour = self.toured(next_child.tolist(), sibling.tolist(), parent.tolist())
        depth = self.depths(tour, parent, length)
        self.minima = RangeMin(depth[tour])
        # A leaf stands in the tour once; its suffix starts its depth before the end.
        at = np.flatnonzero(~inner[tour])
        suffix = len(symbols) - depth[tour[at]]
        self.place, self.rank = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        self.place[suffix] = at
        self.rank[suffix] = np.arange(len(suffix))

    @staticmethod
    def toured(next_child: list[int], sibling: list[int], parent: list[int]) -> np.ndarray:
        """The nodes in the order of the Euler tour."""
        node, tour = 0, [0]
        append = tour.append
        while True:
            below = next_child[node]
            if below:
                next_child[node] = sibling[below]
                node = below
            elif node:
                node = parent[node]
            else:
                return np.array(tour, np.int64)
            append(node)

    @staticmethod
    def depths(tour: np.ndarray, parent: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Symbols from the root to each node: the tour adds an edge on its way down and takes it off on its way up."""
        down = parent[tour[1:]] == tour[:-1]
        down &= tour[1:] != 0
        step = np.where(down, length[tour[1:]], -length[tour[:-1]])
        depth = np.zeros(len(parent), np.int64)
        depth[tour[1:]] = np.cumsum(step)
        depth[0] = 0
        return depth

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b``, two different ones, share."""
        x, y = self.place[a], self.place[b]
        return self.minima.of(np.minimum(x, y), np.maximum(x, y)).astype(np.int64)


def next_lower(rank: list[int]) -> list[int]:
    """For each place the next one of lower rank, or the length."""
    out, open_places = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_places and rank[open_places[-1]] > r:
            out[open_places.pop()] = i
        open_places.append(i)
    return out


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs, in order of start and period; symbols count from 1."""
    n, alphabet = len(symbols), int(symbols.max(initial=0)) + 1
    forth = Extensions([*symbols.tolist(), 0], alphabet)
    back = Extensions([*symbols[::-1].tolist(), 0], alphabet)
    found = []
    for rank in (forth.rank, -forth.rank):
        after = np.array(next_lower(rank[:n].tolist()), np.int64)
        i = np.flatnonzero(after < n)
        j = after[i]
        right = forth.common(i, j)
        left = np.zeros(len(i), np.int64)
        inside = i > 0
        left[inside] = back.common(n - i[inside], n - j[inside])
        start, end, period = i - left, j + right, j - i
        ok = (end - start >= 2 * period) & (end - start >= least)
        found.append(np.stack([start[ok], end[ok], period[ok]], 1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def repeated_stretches(codes: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, past-the-end) word of the stretches that are covered by windows occurring twice in the stretch.

    ``codes`` are hashes of words, ``text`` the index of each word's text; equal hashes of different words only make
    stretches larger.
    """
    if len(codes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.zeros(len(codes) - window + 1, np.uint64)
    for k in range(window):
        gram = mixed(gram + codes[k : len(codes) - window + 1 + k])
    at = np.flatnonzero(text[: len(gram)] == text[window - 1 :])
    group = text[at]
    while True:
        key = mixed(gram[at] ^ mixed(group.astype(np.uint64) + np.uint64(1)))
        by = np.argsort(key, kind="stable")
        twin = key[by][1:] == key[by][:-1]
        repeats = np.zeros(len(at), bool)
        repeats[by[1:][twin]] = True
        repeats[by[:-1][twin]] = True
        kept = at[repeats]
        if not len(kept):
            return kept, kept
        new = np.append(True, (kept[1:] > kept[:-1] + window) | (text[kept[1:]] != text[kept[:-1]]))
        heads = np.flatnonzero(new)
        if len(kept) == len(at):
            return kept[heads], kept[np.append(heads[1:], len(kept)) - 1] + window
        at, group = kept, np.cumsum(new)


def runs_of_stretches(stretches: list[list[bytes]], least: int, tree_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the stretch, its runs as (start, end, period)) of those that hold runs."""
    low = 0
    while low < len(stretches):
        numbers: dict[bytes, int] = {}
        parts, begins, total, high = [], [], 0, low
        while high < len(stretches) and (high == low or total + len(stretches[high]) < tree_words):
            begins.append(total)
            parts.append([numbers.setdefault(w, len(numbers) + 1) for w in stretches[high]])
            total += len(parts[-1]) + 1
            high += 1
        marks = len(numbers) + 1
        runs = runs_of(np.concatenate([np.array([*p, marks + k], np.int64) for k, p in enumerate(parts)]), least)
        owner = np.searchsorted(begins, runs[:, 0], "right") - 1
        for k in np.unique(owner):
            yield low + int(k), runs[owner == k] - np.array([begins[k], begins[k], 0])
        low = high


def periodic_runs(docs: DataFrame, least: int = LEAST, tree_words: int = TREE_WORDS) -> DataFrame:
    """doc_id, text_key, n_words, runs (start, length, period) and the collapsed text of each row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    window = least // 2
    names = ["doc_id", "text_key", "n_words", "runs", "collapsed"]

    def analysed(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.fromiter((hash(w) for of in words for w in of), np.int64, int(bounds[-1])).view(np.uint64)
        first, end = repeated_stretches(codes, np.repeat(np.arange(len(texts)), sizes), window)
        chosen = end - first >= least
        first, end = first[chosen], end[chosen]
        text = np.searchsorted(bounds, first, "right") - 1
        first, end = first - bounds[text], end - bounds[text]
        stretches = [words[t][a:b] for t, a, b in zip(text.tolist(), first.tolist(), end.tolist())]
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        kept = dict.fromkeys(text.tolist())
        for t in kept:
            kept[t] = np.zeros(len(words[t]) + 1, np.int64)
        for k, found in runs_of_stretches(stretches, least, tree_words):
            t = int(text[k])
            start = found[:, 0] + first[k]
            np.add.at(kept[t], start + found[:, 2], 1)
            np.add.at(kept[t], found[:, 1] + first[k], -1)
            runs[t] += zip(start.tolist(), (found[:, 1] - found[:, 0]).tolist(), found[:, 2].tolist())
        collapsed = []
        for t, own in enumerate(words):
            if runs[t]:
                runs[t].sort(key=lambda r: (r[0], r[2]))
                stays = np.cumsum(kept[t][:-1]) == 0
                own = [own[i] for i in np.flatnonzero(stays).tolist()]
            collapsed.append(b" ".join(own))
        return sizes.tolist(), runs, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for low, high in pieces(offsets):
                view = memoryview(data)
                texts = [bytes(view[offsets[i] : offsets[i + 1]]) for i in range(low, high)]
                sizes, runs, collapsed = analysed(texts)
                flat = np.array([r for of in runs for r in of], np.int64).reshape(-1, 3)
                struct = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
                found = lists(np.concatenate([[0], np.cumsum([len(of) for of in runs])]), struct)
                text = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(low, high - low) for i in range(2)], pa.array(sizes, pa.int64()), found, text], names)

    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, text_key bigint, n_words bigint, runs {RUNS}, collapsed string")


def longest(runs: str = "runs"):
    """The run of greatest length, of equal ones that with the smallest start, then period; NULL without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))
