"""Token ids of all documents in ascending id order, as independent range-coded blocks.

Documents are range-partitioned by id and sorted, so partition k holds ids below those of partition k + 1. Each task
encodes its texts with a public tokenizer, appends the end id to each document and cuts blocks of whole documents,
about BLOCK ids each. A block is one row of the store: partition, number in it, counts, the documents' ids and
lengths, and the coded ids (range_coder.py). Spark's committer writes the rows as Parquet, so a retried task
leaves nothing twice, and the store lies wherever Spark can write. Reading needs only the counts of blocks to know
where each one starts (their prefix sum), then decodes every block by itself.

A text is cut at single spaces between two other characters, where letters, digits and signs meet, and around single
line feeds: there the tokenizer's own pattern always begins a new piece, so pieces have the same ids in any text, and each
distinct piece (its very bytes) is encoded once per worker while the memory of pieces (bounded by PIECES) lasts. Pieces are
cut, made distinct and looked up a slice of texts at a time. A new piece of one kind of characters is one match of the
pattern, so the library's model gets it without the pattern being run; all others go through the whole tokenizer.

Defined results: null text is empty and gives the end id alone; null ids come first; rows that repeat an id are
neighbours in the order of a hash of their texts; an empty table gives an empty store. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm import bytescan, range_coder
from loomery.llm.common import shared_path, sized, small_batches, staged, table

TOKENIZER, END, BLOCK, PIECES = "byte_bpe_50k.json", 0, 1 << 20, 200_000
SCHEMA = "part int, block int, n_docs long, n_ids long, docs binary, ids binary"
#: Text bytes that are cut into pieces at once.
SLICE_BYTES = 4 << 20
#: New pieces that the library gets as one text.
RUN = 50
#: How a tokenizer has to take its matches for cut() to be right.
PATTERN = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _blanks() -> tuple[np.ndarray, np.ndarray]:
    """For two bytes (first * 256 + second), whether a blank character begins with them, and whether one ends with them.

    Blank is what Python takes for white space and what a tokenizer might beyond that; some other characters share two bytes with one.
    """
    begins, ends = np.zeros((256, 256), bool), np.zeros((256, 256), bool)
    for c in filter(lambda c: c.isspace() or c in "\u180e\u200b\ufeff", map(chr, range(0xD800))):
        x = c.encode()
        if len(x) == 1:
            begins[x[0]], ends[:, x[0]] = True, True
        else:
            begins[x[0], x[1]], ends[x[-2], x[-1]] = True, True
    x = "\ufeff".encode()
    begins[x[0], x[1]], ends[x[-2], x[-1]] = True, True
    return begins.ravel(), ends.ravel()


BEGINS, ENDS = _blanks()

#: Kinds of characters, as bits: letters (ASCII and Latin of two bytes), ASCII digits, ASCII signs but the apostrophe, the apostrophe, the line feed, all else.
LETTER, DIGIT, SIGN, APOSTROPHE, FEED, OTHER = 1, 2, 4, 8, 16, 32


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each byte alone, and whether two bytes (first * 256 + second) are one letter."""
    kind, letter = np.full(256, OTHER, np.uint8), np.zeros((256, 256), bool)
    for c in map(chr, range(33, 127)):
        kind[ord(c)] = LETTER if c.isalpha() else DIGIT if c.isdigit() else APOSTROPHE if c == "'" else SIGN
    kind[10] = FEED
    for c in filter(str.isalpha, map(chr, range(0xC0, 0x180))):
        letter[tuple(c.encode())] = True
    return kind, letter.ravel()


KIND, PAIR = _kinds()


def _byte_level() -> np.ndarray:
    """The character (code point) by which byte-level models know each byte."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return np.array([b if b in seen else next(hidden) for b in range(256)], "<u4")


BYTE_LEVEL = _byte_level()


def _pairs(data: np.ndarray) -> np.ndarray:
    """Two neighbouring bytes as one number, of every byte and its next."""
    return data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    out = KIND[data]
    first = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    first = first[PAIR[_pairs(np.append(data, np.uint8(0)))[first]]] if len(first) else first
    out[first], out[first + 1] = LETTER, LETTER
    return out


def _borders() -> np.ndarray:
    """For two neighbouring kinds (first * 64 + second), whether a match of the tokenizer's pattern surely ends between them."""
    out = np.zeros((64, 64), bool)
    for a in (LETTER, DIGIT, SIGN):
        out[a, [b for b in (LETTER, DIGIT, SIGN) if b != a]] = True
    out[[LETTER, DIGIT], APOSTROPHE] = True  # after a sign it belongs to the signs, before a letter it may be a contraction
    out[[LETTER, DIGIT, SIGN, APOSTROPHE], FEED] = True
    return out.ravel()


BORDERS = _borders()
#: Kinds that are surely not blank.
SOLID = LETTER | DIGIT | SIGN | APOSTROPHE


def cut(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin, and the end of the last: at each text, at single spaces between two characters that are surely not blank, and between kinds."""
    n = len(data)
    pairs = _pairs(np.concatenate([np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)]))  # pairs[i] holds bytes i - 2 and i - 1 of data
    s = np.flatnonzero(data == 32)
    s = s[~(ENDS[pairs[s]] | BEGINS[pairs[s + 3]])]
    del pairs
    mark = np.zeros(n + 1, bool)
    if n > 1:
        kind = kinds(data)
        mark[1:n] = BORDERS[kind[:-1].astype(np.uint16) << np.uint16(6) | kind[1:]]
        feeds = np.flatnonzero(kind[1:-1] == FEED) + 1
        mark[feeds[(kind[feeds - 1] & SOLID > 0) & (kind[feeds + 1] & SOLID > 0)] + 1] = True
        del kind
    mark[s] = True
    if n:
        closing = at[1:] - 1
        last = closing[data[closing] == 32]
        mark[last] = False  # a text's last space belongs to the piece before
    mark[at] = True
    return np.flatnonzero(mark)


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, through a bounded memory of pieces."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.tokenizer.encode_special_tokens = True
        self.vocabulary = self.tokenizer.get_vocab_size()
        # the same model for pieces that are one match of the pattern, given in its own characters between line feeds
        if self.tokenizer.normalizer is not None or json.loads(self.tokenizer.pre_tokenizer.__getstate__()) != PATTERN:
            raise ValueError(f"{tokenizer}: pieces are cut for the pattern of byte-level models")
        self.words, self.mark = Tokenizer(self.tokenizer.model), self.tokenizer.token_to_id(chr(BYTE_LEVEL[10]))
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        # ids that begin with a space, which inside a plain piece only the first id can
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(chr(BYTE_LEVEL[32])) for i in range(self.vocabulary)])
        self.known = pa.array([], pa.large_binary())
        self.flat, self.begin, self.count, self.seen = np.zeros(0, np.int32), *(np.zeros(0, np.int32) for _ in range(3))

    def _forget(self) -> None:
        """Keep the pieces met most often, half of the bound at most, with half their count."""
        least = np.partition(self.seen, -PIECES // 2)[-PIECES // 2]
        keep = self.seen > least
        self.known = self.known.filter(pa.array(keep))
        size, begin = self.count[keep], self.begin[keep]
        ends = np.cumsum(size, dtype=np.int32)
        self.flat = self.flat[np.repeat(begin - ends + size, size) + np.arange(size.sum(), dtype=np.int32)]
        self.begin, self.count, self.seen = ends - size, size, self.seen[keep] // 2

    def _encode(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after another, and their number by text."""
        got = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(size.sum())), size

    def _words(self, data: np.ndarray, at: np.ndarray, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are one match of the pattern, and their number by piece; all begin with a space, or a mark that none holds follows each."""
        n, add = len(at) - 1, 1 + 2 * len(mark)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        chars = np.full(int(at[-1] - at[0]) + add * n, 10, "<u4")
        chars[np.arange(at[-1] - at[0]) + np.repeat(add * np.arange(n), np.diff(at))] = BYTE_LEVEL[data[at[0] : at[-1]]]
        edges = at - at[0] + add * np.arange(n + 1)
        if mark:
            chars[edges[1:] - 2] = ord(mark)
        joined, edges = chars.tobytes().decode("utf-32-le"), [*edges[:n:RUN].tolist(), int(edges[-1])]
        flat, _ = self._encode(self.words, [joined[i:k] for i, k in pairwise(edges)])
        if mark:
            last = flat == self.mark
            sizes, flat = np.diff(np.flatnonzero(last), prepend=-1) - 1, flat[~last]
        else:
            sizes = np.diff(np.append(np.flatnonzero(self.opens[flat]), len(flat)))
        if len(sizes) != n or sizes.sum() != len(flat):
            raise ValueError("the model took pieces otherwise than one by one")
        return flat, sizes.astype(np.int32)

    def _add(self, pieces: pa.Array) -> np.ndarray:
        """Learn pieces that are not known; their numbers."""
        data, at = bytescan.raw(pieces)
        kind = kinds(data)
        lead = at[:-1][(data[at[:-1]] == 32) & (np.diff(at) > 1)]
        kind[lead] = 0
        plain = np.isin(np.bitwise_or.reduceat(kind, at[:-1]), (LETTER, DIGIT, SIGN)) if len(pieces) else np.zeros(0, bool)
        led = np.zeros(len(pieces), bool)
        led[np.searchsorted(at, lead)] = True
        order = np.concatenate([np.flatnonzero(plain & led), np.flatnonzero(plain & ~led), np.flatnonzero(~plain)])
        pieces, n, spaced = pieces.take(pa.array(order)), int(plain.sum()), int((plain & led).sum())
        data, at = bytescan.raw(pieces)
        first, firsts = self._words(data, at[: spaced + 1], "")
        second, seconds = self._words(data, at[spaced : n + 1], chr(BYTE_LEVEL[10]))
        raw = data.tobytes()
        rest, more = self._encode(self.tokenizer, [raw[i:k].decode() for i, k in pairwise(at[n:].tolist())])
        sizes = np.concatenate([firsts, seconds, more])
        out = np.empty(len(order), np.int32)
        out[order] = np.arange(len(self.begin), len(self.begin) + len(order), dtype=np.int32)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes, dtype=np.int32) - sizes])
        self.flat = np.concatenate([self.flat, first, second, rest])
        self.count = np.concatenate([self.count, sizes])
        self.seen = np.concatenate([self.seen, np.zeros(len(sizes), np.int32)])
        self.known = pa.concat_arrays([self.known, pieces])
        return out

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, each text's followed by the end id, and their count by text."""
        return self.encode_bytes(*bytescan.utf8(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts))

    def encode_bytes(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts given as bytes, and where each begins (and the last ends)."""
        if len(self.begin) > PIECES:
            self._forget()
        edges = cut(data, at)
        found = binaries(data, edges).dictionary_encode()
        k = pc.fill_null(pc.index_in(found.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        new = k < 0
        if new.any():
            k[new] = self._add(found.dictionary.filter(pa.array(new)))
        which = found.indices.to_numpy()
        self.seen[k] += np.bincount(which, minlength=len(k)).astype(np.int32)
        k = k[which]
        size, begin = self.count[k], self.begin[k]
        del found, which, k
        before = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=before[1:])
        per = np.diff(before[np.searchsorted(edges, at[1:])], prepend=np.int32(0)).astype(np.int64)
        place = np.repeat(begin - before[:-1], size)
        place += np.arange(before[-1], dtype=np.int32)
        del edges, size, begin, before
        ids = self.flat[place]
        del place
        out = np.full(len(ids) + len(per), END, np.int32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per + 1) - 1] = False
        out[keep] = ids
        return out, per + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(tokenizer: str) -> Encoder:
    """The worker's own encoder, whose memory of pieces outlives a task."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def _pack(doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """The documents of a block: a flag for null, the id and the number of ids of each."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    value = np.array([d or 0 for d in doc_ids], "<i8")
    return zlib.compress(struct.pack("<I", len(doc_ids)) + known.tobytes() + value.tobytes() + np.asarray(sizes, "<i8").tobytes())


def _unpack(data: bytes) -> tuple[list[int | None], np.ndarray]:
    raw = zlib.decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    known, value, sizes = np.frombuffer(raw, np.uint8, n, 4), np.frombuffer(raw, "<i8", n, 4 + n), np.frombuffer(raw, "<i8", n, 4 + 9 * n)
    return [int(v) if k else None for k, v in zip(known, value, strict=True)], sizes


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, block: int = BLOCK) -> None:
    """Write the store of docs (doc_id, text) to a new folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, encoder = TaskContext.get().partitionId(), 0, encoder_of(tokenizer)
        doc_ids, sizes, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal number, held
            flat, docs = np.concatenate(ids), _pack(doc_ids, np.concatenate(sizes))
            n, number, held = len(doc_ids), number + 1, 0
            for x in (doc_ids, sizes, ids):
                x.clear()
            row = [part, number - 1, n, len(flat), docs, range_coder.encode(flat, encoder.vocabulary)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "n_docs", "n_ids", "docs", "ids"])

        for rows, data, at in bytescan.slices(batches, most=SLICE_BYTES):
            flat, per = encoder.encode_bytes(data, at)
            keys, ends, row, done = rows.column(0).to_pylist(), np.cumsum(per), 0, 0
            while row < len(keys):
                end = min(len(keys), int(np.searchsorted(ends, done + block - held)) + 1)
                doc_ids += keys[row:end]
                sizes.append(per[row:end])
                ids.append(flat[done : ends[end - 1]])
                held += int(ends[end - 1]) - done
                row, done = end, int(ends[end - 1])
                if held >= block:
                    yield closed()
        if doc_ids:
            with np.errstate(over="ignore"):
                yield closed()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    small_batches(docs.sparkSession)
    d.mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store with `first`, the number of ids before each block."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own")).join(parts, "part")
    blocks = staged(blocks.select("part", "block", (F.col("base") + F.col("own")).alias("first")), "token-starts")
    return stored.join(sized(blocks), ["part", "block"])


def decoded(blocks: DataFrame, digest: bool = False) -> DataFrame:
    """Blocks -> documents: doc_id, start, n_tokens, and their ids (or, as a digest, the CRC-32 of the ids as u32)."""
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, data, first in zip(b.column(0), b.column(1), b.column(2), strict=True):
                doc_ids, sizes = _unpack(docs.as_py())
                ids = range_coder.decode(data.as_py()).astype("<u4")
                if sizes.sum() != len(ids):
                    raise ValueError("a block's documents and ids differ")
                ends = np.cumsum(sizes)
                start = first.as_py() + ends - sizes
                if digest:
                    raw = memoryview(ids.tobytes())
                    out = pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), out], ["doc_id", "start", "n_tokens", last.split()[0]])

    return blocks.select("docs", "ids", "first").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")


def digests(docs: DataFrame) -> DataFrame:
    """Write docs as a store in the shared folder, read it back: doc_id, start, n_tokens, ids_crc32."""
    path = shared_path(docs.sparkSession, "token-store")
    write(docs, path)
    return decoded(read(docs.sparkSession, path), digest=True)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
