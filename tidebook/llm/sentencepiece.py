"""SentencePiece encoding and decoding with a prefix table, for merge-type (BPE) models.

Of all tokens that end where a prefix ends, exactly one can be the last of that prefix's encoding: the one
compatible with the last token of the prefix before it. Two tokens are compatible if merging their joint
text gives just these two. So an automaton's matches fill a table of last tokens from left to right, in
time linear in the text, and the ids are read off backwards. Compatibility of a pair is found once per
worker. Texts are cut where no vocabulary piece spans both sides (checked on the vocabulary), and pieces
that repeat are encoded once.

The model file is read on the driver; its table (one entry per id) travels with the tasks, so executors
need no file. Only models with identity normalisation, escaped white space and byte fallback are taken.

NULL and empty texts give the begin and end ids alone and decode to the empty text. Characters outside
the vocabulary become their bytes. Any length of text works in memory proportional to it. Repeated rows each get their
row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidebook.llm.common import binary_buffers, text_buffers, worker_cache
from tidebook.llm.common import pieces as text_pieces
from tidebook.llm.memo import LONG_PIECE, PieceMemo

SPACE = "▁"
MOST_PAIRS = 300_000


@dataclass(frozen=True)
class Model:
    """What encoding and decoding need of a model file: the entry of each id and its kind."""

    path: str
    names: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str  # n normal, b byte, c control, u unknown
    dummy_prefix: bool
    begin: int
    end: int


def load(path: str) -> Model:
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    rule = model.normalizer_spec
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or rule.name != "identity" or rule.remove_extra_whitespaces:
        raise ValueError("a merge-type model with identity normalisation is needed")
    if not (rule.escape_whitespaces and model.trainer_spec.byte_fallback) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("a model with escaped white space and byte fallback is needed")
    names = {1: "n", 2: "u", 3: "c", 6: "b"}
    library = SentencePieceProcessor(model_file=path)
    return Model(
        path,
        tuple(p.piece for p in model.pieces),
        tuple(p.score for p in model.pieces),
        "".join(names[p.type] for p in model.pieces),
        rule.add_dummy_prefix,
        library.bos_id(),
        library.eos_id(),
    )


class Encoder(PieceMemo):
    def __init__(self, model: Model):
        import ahocorasick

        super().__init__()
        self.model = model
        self.id_of = {name: i for i, (name, kind) in enumerate(zip(model.names, model.kinds)) if kind == "n"}
        self.byte_id = {int(model.names[i][3:5], 16): i for i, kind in enumerate(model.kinds) if kind == "b"}
        self.size = [len(name) for name in model.names]
        self.automaton = ahocorasick.Automaton()
        for name, i in self.id_of.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.inside = {name[i : i + 2] for name in self.id_of for i in range(len(name) - 1)}
        self.pairs: dict[int, bool] = {}
        starts_words = all(a == SPACE for a, b in self.inside if b == SPACE)
        no_newline = not any("\n" in name for name in self.id_of)
        self.pattern = re.compile(" *[^ \n]+| +|\n" if starts_words and no_newline else "(?s:.+)")

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        return self.pattern.findall((" " if self.model.dummy_prefix else "") + text.replace(SPACE, " "))

    def split(self, piece: str) -> tuple[str, str] | None:
        """The last character goes off where nothing joins it to the rest."""
        if 1 < len(piece) <= LONG_PIECE and piece[-2:].replace(" ", SPACE) not in self.inside:
            return piece[:-1], piece[-1]
        return None

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [self.by_prefixes(piece) for piece in pieces]

    def by_prefixes(self, text: str) -> list[int]:
        text = text.replace(" ", SPACE)
        if len(text) == 1:
            known = self.id_of.get(text)
            return [known] if known is not None else [self.byte_id[b] for b in text.encode()]
        last = [-1] * (len(text) + 1)  # of each prefix; -1: a character outside the vocabulary
        size, pairs, vocabulary, done = self.size, self.pairs, len(self.size), 0
        for end, token in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            before = last[end - size[token]]
            fits = pairs.get(before * vocabulary + token)
            if fits is None:
                fits = self.compatible(before, token)
            if fits:
                last[end] = token
                done = end
        ids: list[int] = []
        at = len(text)
        while at:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= size[token]
            else:
                at -= 1
                ids.extend(self.byte_id[b] for b in reversed(text[at].encode()))
        ids.reverse()
        return ids

    def compatible(self, before: int, token: int) -> bool:
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        expected = [i for i in (before, token) if i >= 0]
        fits = self.merged("".join(self.model.names[i] for i in expected)) == expected
        self.pairs[before * len(self.size) + token] = fits
        return fits

    def merged(self, text: str) -> list[int]:
        """Merges by their definition: always the best-scored neighbours, the leftmost of equals. For short texts."""
        parts, scores = list(text), self.model.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                token = self.id_of.get(parts[i] + parts[i + 1])
                if token is not None and (best is None or scores[token] > best):
                    best, at = scores[token], i
            if best is None:
                return [self.id_of.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Decoder:
    """Bytes of each id, gathered by numpy; the begin's dummy space goes."""

    def __init__(self, model: Model):
        self.model = model
        shown = [self.surface(i) for i in range(len(model.names))]
        self.bounds = np.concatenate([[0], np.cumsum([len(s) for s in shown])])
        self.flat = np.frombuffer(b"".join(shown), np.uint8)
        self.control = np.array([k == "c" for k in model.kinds])
        self.byte = np.array([k == "b" for k in model.kinds])
        self.spaced = np.array([k == "n" and n.startswith(SPACE) for k, n in zip(model.kinds, model.names)])

    def surface(self, i: int) -> bytes:
        kind, name = self.model.kinds[i], self.model.names[i]
        if kind == "b":
            return bytes([int(name[3:5], 16)])
        return {"c": "", "u": " ⁇ "}.get(kind, name.replace(SPACE, " ")).encode()

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_runs(ids, np.array([len(ids)]))[0].as_buffer().to_pybytes()

    def decode_runs(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of ``counts`` ids each."""
        if len(ids) and (ids.max() >= len(self.control)):
            raise ValueError("an id is outside the vocabulary")
        first = self.bounds[ids]
        size = self.bounds[ids + 1] - first
        upto = np.concatenate([[0], np.cumsum(counts)])
        if self.model.dummy_prefix:
            real = np.flatnonzero(~self.control[ids])
            place = np.searchsorted(real, upto[:-1])
            opening = real[place[place < np.searchsorted(real, upto[1:])]]
            opening = opening[self.spaced[ids[opening]]]
            first[opening] += 1
            size[opening] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        shown = binary(out, ends[upto])
        try:
            return shown.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([repaired(run) for run in shown.to_pylist()], pa.binary()).cast(pa.string())


def repaired(data: bytes) -> bytes:
    """Each byte that starts no valid character becomes the replacement character."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out).encode()


def cached(kind: type, model: Model):
    cache, key = worker_cache(), (kind.__name__, model.path, hash(model.names))
    if key not in cache:
        cache[key] = kind(model)
    return cache[key]


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], values], [*names, name])


def schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, kind)])


def encode(df: DataFrame, model: Model, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a binary column ``ids``: begin, ids of the text, end, as little-endian unsigned 32-bit integers.

    An existing column of that name is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoder = cached(Encoder, model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = text_buffers(column)
            for low, high in text_pieces(offsets):
                part = batch.slice(low, high - low)
                flat, counts = encoder.encode([t or "" for t in part.column(batch.schema.get_field_index(text)).to_pylist()])
                cuts = np.concatenate([[0], np.cumsum(counts)])
                whole = np.insert(flat, cuts[:-1], model.begin)
                whole = np.insert(whole, cuts[1:] + np.arange(1, len(counts) + 1), model.end).astype("<u4")
                yield with_column(part, ids, packed(whole, counts + 2))

    return df.mapInArrow(run, schema_with(df, ids, T.BinaryType()))


def packed(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of runs of a flat array."""
    return binary(flat, np.concatenate([[0], np.cumsum(counts * flat.itemsize)]))


def binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the bytes of a flat array, cut at ``offsets``."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def decode(df: DataFrame, model: Model, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a string column ``text`` decoded from the binary column ``ids``; NULL gives the empty text.

    Runs of rows are decoded and handed on one after the other, not a whole batch at once.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = cached(Decoder, shared.value)
        for batch in batches:
            data, offsets = binary_buffers(batch.column(batch.schema.get_field_index(ids)))
            if (np.diff(offsets) % 4).any():
                raise ValueError("ids are not whole 32-bit integers")
            for low, high in text_pieces(offsets):
                flat = np.frombuffer(data, "<u4", (offsets[high] - offsets[low]) // 4, offsets[low]).astype(np.int64)
                yield with_column(batch.slice(low, high - low), text, decoder.decode_runs(flat, np.diff(offsets[low : high + 1]) // 4))

    return df.mapInArrow(run, schema_with(df, text, T.StringType()))
