"""Token files: canonical length-limited Huffman codes over global id counts, in independent blocks.

Documents are put in ascending order of id by a range partitioning; each partition is a file. A file is cut
into blocks of whole documents (about ``BLOCK_IDS`` ids; a longer document is a block of its own). One row of
the stored table is one block:

    file, block        which file, which block of it
    skipped, n_ids     ids of the file before the block, and in it
    doc_ids            the block's documents, ascending
    data               "TBH1", u32 documents, u32 ids, u32 step, u32 ids of each document,
                       u64 bit offset of each step-th id (the checkpoints), code words (most significant bit first)

The table with the code lengths (id, length) lies beside it; canonical codes follow from lengths. Spark writes
both, so a file that a lost executor left unfinished is written again and any file system serves. Decoding
looks up ``limit`` bits in a table and moves on; all checkpoints of a block are decoded side by side in numpy.

Text is encoded by the tokenizers library, piece by piece between white space, where a piece has not been seen
lately: the pre-tokenizer never joins pieces across white space, nor closing ASCII signs to an ASCII letter or digit
before them, so that those are pieces of their own.

NULL and empty texts have the end id only; NULL document ids come first; repeated rows each keep their place
(ties by a hash of the text, so that the rows of one id, NULL included, spread over files). An empty table gives empty
files; columns other than ``doc_id`` and ``text`` are not read and may have any name.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import Scratch, WordSpans, byte_class, byte_values, pieces, text_buffers, worker_cache
from tidebook.llm.memo import NumberTable
from tidebook.llm.sentencepiece import packed

BLOCK_IDS = 131_072
STEP = 128
MAGIC = b"TBH1"
#: Longest code word; the decoding table has 2 ** limit entries. Raised where the ids are too many for it.
LIMIT = 16


class WordEncoder:
    """Ids by the library, for pieces between white space, which the tokenizer never joins; signs that close a piece
    are a piece of their own where they follow an ASCII letter or digit.

    Pieces are told apart by a 64-bit hash that takes A-Z for a-z, as the tokenizer does; each is encoded when it
    is first seen and its ids are kept. Texts that may hold a special token, whose case matters, go to the library.
    """

    #: Pieces remembered at once, some 100 MB; then the memory starts afresh.
    MOST_PIECES = 1_500_000
    #: One word, and closing full stops or commas as a second one.
    CLOSED = re.compile(r"([^\W\d_]+)[.,]+").fullmatch

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.flags = byte_class("spaced")
        self.values = byte_values(self.flags)
        self.letter = byte_class("alnum")
        self.letter[128:] = False
        self.sign = np.zeros(256, bool)
        self.sign[0x21:0x7F] = ~self.letter[0x21:0x7F]
        self.clear()

    def clear(self) -> None:
        self.table = NumberTable(22)
        self.ids, self.start, self.size = array("I"), array("q"), array("i")

    def closing(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where signs begin that follow an ASCII letter or digit and go on up to white space or a text's end."""
        sign = np.zeros(len(data) + 2, bool)
        sign[1:-1] = self.sign[data]
        edges = np.flatnonzero(sign[1:] != sign[:-1])
        start, end = edges[::2], edges[1::2]
        over = np.ones(len(data) + 1, bool)
        over[:-1] = ~self.flags[data]
        over[offsets] = True
        return start[(start > 0) & self.letter[data[start - 1]] & over[end]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        text = data.tobytes()
        if b"<|" in text:
            bounds = offsets.tolist()
            coded = self.library.encode_batch_fast([text[a:b].decode() for a, b in zip(bounds, bounds[1:])], add_special_tokens=False)
            return np.concatenate([np.array(c.ids, np.uint32) for c in coded]), np.array([len(c.ids) for c in coded], np.int64)
        words = WordSpans(data, offsets, self.flags, self.values, self.closing(data, offsets))
        if not len(words.hash):
            return np.zeros(0, np.uint32), words.counts
        if self.table.count > self.MOST_PIECES:
            self.clear()
        numbers = self.table.find(words.hash)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            keys, first, key = np.unique(words.hash[new], return_index=True, return_inverse=True)
            at = new[first]
            self.learn([text[a:b].decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist())])
            numbers[new] = self.table.count + key
            self.table.add(keys)
        size = np.frombuffer(self.size, np.int32)[numbers]
        ends = np.cumsum(size, dtype=np.int64)
        shift = np.frombuffer(self.start, np.int64)[numbers] - ends + size
        flat = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        ids = flat[np.repeat(shift, size) + np.arange(ends[-1])]
        upto = np.concatenate([[0], ends])[words.first]
        del flat
        return ids, np.diff(upto)

    def learn(self, pieces: list[str]) -> None:
        ids, start, size = self.encode_pieces(pieces)
        self.start.frombytes((start + len(self.ids)).tobytes())
        self.size.frombytes(size.tobytes())
        self.ids.frombytes(ids.tobytes())

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in any order, and where those of each piece start and how many they are.

        Simple pieces have one or two words: many go into one text, and word-end tokens part them.
        """
        words = np.array([1 if p.isalpha() else 2 if (found := self.CLOSED(p)) and found[1].isalpha() else 0 for p in pieces], np.int64)
        start, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32)
        parts, held = [np.zeros(0, np.uint32)], 0
        simple = np.flatnonzero(words)
        groups = [simple[low : low + 500] for low in range(0, len(simple), 500)]
        joined = [" ".join([pieces[i] for i in some.tolist()]) for some in groups]
        for some, coded in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(coded.ids, np.uint32)
            ends, last = np.flatnonzero(self.ends_word[ids]) + 1, np.cumsum(words[some])
            if len(ends) == last[-1] and ends[-1] == len(ids):
                upto = ends[last - 1]
                size[some] = np.diff(upto, prepend=0)
                start[some] = held + upto - size[some]
                parts.append(ids)
                held += len(ids)
            else:
                words[some] = 0
        rest = np.flatnonzero(words == 0).tolist()
        for low in range(0, len(rest), 4096):
            some = rest[low : low + 4096]
            coded = self.library.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)
            for i, c in zip(some, coded):
                start[i], size[i] = held, len(c.ids)
                parts.append(np.array(c.ids, np.uint32))
                held += len(c.ids)
        return np.concatenate(parts), start, size


def raw_blocks(docs: DataFrame, tokenizer_file: str, end_id: int) -> tuple[DataFrame, str]:
    """Blocks of plain ids and their number type: file, block, skipped, doc_ids, sizes, ids (little-endian, 16 bits where they suffice)."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file)
    kind = "<u2" if max(library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    shared = docs.sparkSession.sparkContext.broadcast(library.to_str())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["file", "block", "skipped", "doc_ids", "sizes", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        definition, cache = shared.value, worker_cache()
        key = ("words", zlib.crc32(definition.encode()))
        if key not in cache:
            cache[key] = WordEncoder(definition)
        encoder, file = cache[key], TaskContext.get().partitionId()
        block = skipped = held = 0
        doc_ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def finished() -> pa.RecordBatch:
            nonlocal block, skipped, held
            size, flat, names_of = np.concatenate(sizes), np.concatenate(ids), pa.concat_arrays(doc_ids)
            row = [pa.array([file], pa.int32()), pa.array([block]), pa.array([skipped]), pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), names_of)]
            row += [pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.array(size)), packed(flat, np.array([len(flat)]))]
            block, skipped, held = block + 1, skipped + len(flat), 0
            for part in (doc_ids, sizes, ids):
                part.clear()
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for low, high in pieces(offsets, 1 << 18):
                flat, counts = encoder.encode(data, offsets[low : high + 1])
                flat = np.insert(flat, np.cumsum(counts), end_id).astype(kind)
                if held and held + len(flat) > BLOCK_IDS:
                    yield finished()
                doc_ids.append(batch.column(0).slice(low, high - low))
                sizes.append(counts + 1)
                ids.append(flat)
                held += len(flat)
        if held:
            yield finished()

    schema = f"file int, block bigint, skipped bigint, doc_ids array<{id_type}>, sizes array<bigint>, ids binary"
    # Rows of one id, NULLs included, are spread by a hash of the text, which also breaks ties.
    spread = F.xxhash64("text")
    ordered = docs.select("doc_id", "text", spread.alias("spread")).repartitionByRange("doc_id", "spread").sortWithinPartitions("doc_id", "spread")
    return ordered.select("doc_id", "text").mapInArrow(run, schema), kind


def id_counts(raw: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0):
                part = np.bincount(np.frombuffer(data.as_buffer(), kind))
                total = np.pad(total, (0, max(0, len(part) - len(total))))
                total[: len(part)] += part
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return raw.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the best prefix code with no length over ``limit``, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError("more symbols than code words of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    from_leaf: list[np.ndarray] = []
    level = leaves
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        from_leaf.append(is_leaf)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([leaves, pairs])
        by_weight = np.argsort(joined, kind="stable")
        level, is_leaf = joined[by_weight], by_weight < n
    from_leaf.append(is_leaf)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(from_leaf):
        of_leaves = int(is_leaf[:taken].sum())
        lengths[order[:of_leaves]] += 1
        taken = 2 * (taken - of_leaves)
    return lengths


class CodeBook:
    """Canonical codes: shorter ones first, ids ascending within a length."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order], lengths[order]
        self.longest = int(self.lengths.max()) if len(ids) else 1
        space = np.uint64(1) << (self.longest - self.lengths).astype(np.uint64)
        first = np.concatenate([[np.uint64(0)], np.cumsum(space)[:-1]]) if len(ids) else np.zeros(0, np.uint64)
        size = int(self.ids.max()) + 1 if len(ids) else 0
        #: Code word and its length (the low 6 bits) of each id.
        self.entry = np.zeros(size, np.uint64)
        self.entry[self.ids] = (first >> (self.longest - self.lengths).astype(np.uint64)) << np.uint64(6) | self.lengths.astype(np.uint64)
        self.symbol = np.zeros(1 << self.longest, np.uint32)
        self.width = np.ones(1 << self.longest, np.uint32)
        runs = space.astype(np.int64)
        self.symbol[: runs.sum()] = np.repeat(self.ids, runs)
        self.width[: runs.sum()] = np.repeat(self.lengths, runs)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Code words end to end, and the bit offset of every STEP-th id."""
        entry = self.entry.take(ids)
        bits = (entry & np.uint64(63)).astype(np.int64)
        code = entry >> np.uint64(6)
        ends = np.cumsum(bits)
        at = ends - bits
        words = np.zeros((int(ends[-1]) if len(ends) else 0) // 64 + 2, np.uint64)
        word = at >> 6
        room = 64 - (at & 63) - bits  # below 0: the word's end cuts the code
        left = np.maximum(room, 0).astype(np.uint64)
        high = code << left
        over = np.flatnonzero(room < 0)
        cut = -room[over]
        high[over] = code[over] >> cut.astype(np.uint64)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        if len(starts):
            words[word[starts]] = np.bitwise_or.reduceat(high, starts)
            words[word[over] + 1] |= code[over] << (64 - cut).astype(np.uint64)
        return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ends) else 0], at[::STEP]

    def decode(self, data: np.ndarray, offsets: np.ndarray, n: int, step: int) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(step * self.longest // 8 + 8, np.uint8)]).astype(np.uint32)
        window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        at = offsets.astype(np.uint32 if len(data) < 1 << 28 else np.int64)
        out = np.zeros((min(step, n), len(at)), np.uint32)
        shift, mask = 32 - self.longest, (1 << self.longest) - 1
        for row in out:
            peek = (window.take(at >> 3, mode="clip") >> (shift - (at & 7)).astype(np.uint32)) & mask
            self.symbol.take(peek, out=row, mode="clip")
            at += self.width.take(peek, mode="clip")
        return out.T.ravel()[:n] if len(at) * len(out) >= n else np.zeros(0, np.uint32)


def pack_block(sizes: np.ndarray, ids: np.ndarray, book: CodeBook) -> bytes:
    payload, offsets = book.encode(ids)
    return MAGIC + struct.pack("<III", len(sizes), len(ids), STEP) + sizes.astype("<u4").tobytes() + offsets.astype("<u8").tobytes() + payload


def open_block(data: bytes, book: CodeBook) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each document's length, and all ids of the block."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    documents, n, step = struct.unpack_from("<III", data, 4)
    sizes = np.frombuffer(data, "<u4", documents, 16)
    checkpoints = np.frombuffer(data, "<u8", -(-n // step), 16 + 4 * documents)
    payload = np.frombuffer(data, np.uint8, offset=16 + 4 * documents + 8 * len(checkpoints))
    return sizes.astype(np.int64), book.decode(payload, checkpoints, n, step)


def write(docs: DataFrame, tokenizer_file: str, scratch: Scratch, end_id: int = 1, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Write the texts of ``docs`` as token files; returns the stored tables of blocks and of code lengths."""
    spark = docs.sparkSession
    raw, kind = raw_blocks(docs, tokenizer_file, end_id)
    raw = scratch.put("token-raw", raw)
    counts = id_counts(raw, kind).orderBy("id").toArrow()  # one row for each id of the vocabulary at most
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    lengths = code_lengths(n, max(limit, int(max(1, len(ids) - 1)).bit_length() + 1))
    codes = scratch.put("token-codes", spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.int64())})))
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = CodeBook(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column(4)[i].values.to_numpy()
                data = pack_block(sizes, np.frombuffer(batch.column(5)[i].as_buffer(), kind), book)
                keys = [batch.column(j).slice(i, 1) for j in range(4)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([int(sizes.sum())]), pa.array([data], pa.binary())], out_names)

    out_names = ["file", "block", "skipped", "doc_ids", "n_ids", "data"]
    schema = f"file int, block bigint, skipped bigint, doc_ids {raw.schema['doc_ids'].dataType.simpleString()}, n_ids bigint, data binary"
    blocks = scratch.put("token-blocks", raw.mapInArrow(run, schema))
    scratch.drop("token-raw")
    return blocks, codes


def read(blocks: DataFrame, codes: DataFrame) -> DataFrame:
    """The documents of token files: doc_id, ``start`` (ids of all documents before it), n_tokens and ids (binary,
    little-endian unsigned 32 bits). The code table has one row for each id of the vocabulary at most."""
    stored = codes.toArrow()
    shared = blocks.sparkSession.sparkContext.broadcast((stored["id"].to_numpy(), stored["length"].to_numpy()))
    names = ["file", "place", "doc_id", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = CodeBook(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, ids = open_block(batch.column(3)[i].as_py(), book)
                place = batch.column(1)[i].as_py() + np.cumsum(sizes) - sizes
                file = pa.array(np.full(len(sizes), batch.column(0)[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([file, pa.array(place), batch.column(2)[i].values, pa.array(sizes), packed(ids.astype("<u4"), sizes)], names)

    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    rows = blocks.select("file", "skipped", "doc_ids", "data").mapInArrow(run, f"file int, place bigint, doc_id {id_type}, n_tokens bigint, ids binary")
    # One row per file: small enough for one window.
    totals = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("file", before.alias("opening"))
    return rows.join(starts, "file").select("doc_id", (F.col("opening") + F.col("place")).alias("start"), "n_tokens", "ids")
