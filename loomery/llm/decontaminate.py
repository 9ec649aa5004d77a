"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment decides.

An item's seeds are the rarer three quarters of its word 3-grams. How rare a 3-gram is follows from how often each of its words
occurs in all documents (counted in one scan, for the items' words only), so that an item leaked into many documents
keeps its seeds. A second scan finds seeds in whole texts by hash; every hit names an item and a diagonal, hits on near
diagonals make one passage, and the passage with some words on both sides is aligned with the item word by word (letters and digits, without case):
MATCH, MISMATCH and GAP as scores, the best local alignment over the score of a full match. Edited or paraphrased
copies that keep enough words in order reach THRESHOLD.

Items are taken in blocks of bounded size (BLOCK_ITEMS, chosen by id hash), each against all documents, so that the tables
which every task holds have a fixed bound. Texts are never shuffled; results are, at one row for each document and item.

Defined results: null and empty texts and items match nothing; items of fewer than 3 words have no seeds and match
nothing; rows that repeat a document id or an item id count once, with the best score; empty tables give an empty
table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bytescan
from loomery.llm.common import table

GRAM, MATCH, MISMATCH, GAP, THRESHOLD = 3, 2, -1, 1, 0.5
BLOCK_ITEMS, CELLS = 20_000, 1 << 17
U64 = np.uint64
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False


def folded_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of letters and digits, capitals (also of Latin-1) as small letters, and the text of each."""
    low = data.copy()
    if len(data):
        capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        low[1:][capital] += 0x20
    starts, ends, text = bytescan.runs(_APART[data], at)
    return bytescan.run_hashes(low, starts, ends), text


class Hashes:
    """Membership of 64-bit hashes: a bit table sifts, the sorted list decides."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = max(16, min(24, int(np.ceil(np.log2(len(self.values) + 1))) + 5))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.values >> U64(64 - self.bits)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known hashes, and the number of each."""
        at = np.flatnonzero(self.table[hashes >> U64(64 - self.bits)])
        k = np.searchsorted(self.values, hashes[at])
        known = k < len(self.values)
        known[known] = self.values[k[known]] == hashes[at][known]
        return at[known], k[known]


@dataclass
class Items:
    ids: list
    words: np.ndarray  # hashes, item by item
    at: np.ndarray

    @staticmethod
    def of(rows: list) -> Items:
        rows = [r for r in rows if r.text]
        data, at = bytescan.utf8(pa.array([r.text for r in rows], pa.string()))
        with np.errstate(over="ignore"):
            words, text = folded_words(data, at)
        return Items([r.item_id for r in rows], words, bytescan.offsets(text, len(rows)))

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the 3-grams, the item of each, and its place in the item."""
        item = np.repeat(np.arange(len(self.ids)), np.diff(self.at))
        place = np.arange(len(self.words)) - self.at[item]
        n = max(0, len(self.words) - GRAM + 1)
        inside = item[:n] == item[GRAM - 1 : GRAM - 1 + n]
        return bytescan.shingles(self.words, item, 0, GRAM)[0][: inside.sum()], item[:n][inside], place[:n][inside]


def blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[Items]:
    """The items in blocks of about `size`."""
    known = benchmark.select("item_id", "text").where("text is not null and text <> ''")
    n = -(-known.count() // size)
    for b in range(n):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        yield Items.of(sorted(rows, key=lambda r: (r.item_id is not None, r.item_id, r.text)))


def word_counts(docs: DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all documents, how often each of the given words occurs: the words, sorted, and their counts."""
    known = Hashes(words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.values), np.int64)
        with np.errstate(over="ignore"):
            for _, data, at in bytescan.slices(batches):
                total += np.bincount(known.find(folded_words(data, at)[0])[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    out = np.zeros(len(known.values), np.int64)
    for r in docs.select("text").mapInArrow(scan, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r.k] = r.n
    return known.values, out


@dataclass
class Seeds:
    items: Items
    hashes: Hashes
    at: np.ndarray  # for each hash, where its (item, place) pairs begin
    item: np.ndarray
    place: np.ndarray


def seeds(items: Items, docs: DataFrame) -> Seeds:
    """The rarer three quarters of each item's 3-grams."""
    vocabulary, count = word_counts(docs, items.words)
    rare = np.log(count[np.searchsorted(vocabulary, items.words)] + 0.5)
    gram, item, place = items.grams()
    first = items.at[item] + place
    weight = sum((rare[first + j] for j in range(GRAM)), np.zeros(len(gram)))
    order = np.lexsort((place, weight, item))
    per = np.bincount(item, minlength=len(items.ids))
    rank = np.empty(len(gram), np.int64)
    rank[order] = np.arange(len(gram)) - np.repeat(np.cumsum(per) - per, per)
    keep = rank < (3 * per[item] + 3) // 4
    gram, item, place = gram[keep], item[keep], place[keep]
    order = np.lexsort((place, item, gram))
    known = Hashes(gram)
    at = np.searchsorted(gram[order], known.values)
    return Seeds(items, known, np.append(at, len(order)), item[order], place[order])


def align(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair (rows of item words a and passage words b, padded), and where in b it ends."""
    pairs, width = b.shape
    ramp = np.arange(width + 1) * GAP
    best, end = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    above = np.zeros((pairs, width + 1), np.int64)
    in_b = np.arange(width) < b_size[:, None]
    for i in range(a.shape[1]):
        same = (a[:, i : i + 1] == b) & in_b & (i < a_size)[:, None]
        row = np.zeros((pairs, width + 1), np.int64)
        np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] - GAP, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        # gaps in b: the best of all cells to the left, less the gap to each
        row = np.maximum.accumulate(row + ramp, axis=1) - ramp
        top = row.argmax(1)
        score = row[np.arange(pairs), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
        above = row
    return best, end


def passages(found: Seeds, words: np.ndarray, text: np.ndarray, n_texts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Texts' passages worth an alignment: text, item, first and last word (exclusive), words counted over all texts."""
    gram, owner = bytescan.shingles(words, text, n_texts, GRAM)
    count = np.bincount(text, minlength=n_texts)
    begin = np.cumsum(count) - count
    gram, owner = gram[: int(np.maximum(count - GRAM + 1, 0).sum())], owner[: int(np.maximum(count - GRAM + 1, 0).sum())]
    per = np.maximum(count - GRAM + 1, 0)
    hit, k = found.hashes.find(gram)
    if not len(hit):
        return
    many = found.at[k + 1] - found.at[k]
    pick = np.repeat(found.at[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hit = np.repeat(hit, many)
    doc = owner[hit]
    where = hit - (np.cumsum(per) - per)[doc]
    item, diagonal = found.item[pick], where - found.place[pick]
    size = np.diff(found.items.at)
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    slack = size[item] // 4 + 2
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    doc, item, slack = doc[first], item[first], slack[first]
    lo = np.maximum(diagonal[first] - slack, 0)
    hi = np.minimum(diagonal[last] + size[item] + slack, count[doc])
    # a very repetitive text makes a long passage; it is aligned in overlapping parts of bounded length
    most = 3 * size[item] + 2 * slack
    step = size[item] + slack
    parts = np.maximum(1, -(-(hi - lo - most) // step) + 1)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    doc, item, lo, hi, most, step = (np.repeat(x, parts) for x in (doc, item, lo, hi, most, step))
    lo = lo + at * step
    hi = np.minimum(lo + most, hi)
    order = np.lexsort((hi - lo, size[item]))
    # pairs of like items and passages together, so many that their matrix has about CELLS cells; one pair alone may have more
    width, cut = (hi - lo)[order], 0
    while cut < len(order):
        widest = np.maximum.accumulate(width[cut : cut + CELLS])
        end = cut + max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS, side="right")))
        o = order[cut:end]
        cut = end
        yield doc[o], item[o], lo[o], hi[o], begin[doc[o]]


def _padded(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(size), max(int(size.max()), 1)), values.dtype)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = values[(at[:, None] + np.arange(out.shape[1]))[inside]]
    return out


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, score, last_word: the best alignment of each document and item that reaches the threshold."""
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, score double, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, block):
        out = out.unionByName(_matches(docs, seeds(items, docs), threshold, schema))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "last_word")).alias("m")).select("doc_id", "item_id", "m.score", "m.last_word")


def _aligned(found: Seeds, threshold: float, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of texts, the alignments that reach the threshold: text, item, score, last word."""
    item_size = np.diff(found.items.at)
    words, text = folded_words(data, at)
    for doc, item, lo, hi, begin in passages(found, words, text, len(at) - 1):
        a = _padded(found.items.words, found.items.at[item], item_size[item])
        b = _padded(words, begin + lo, hi - lo)
        best, end = align(a, item_size[item], b, hi - lo)
        score = best / (MATCH * item_size[item])
        good = np.flatnonzero(score >= threshold)
        yield doc[good], item[good], score[good], lo[good] + end[good]


def _matches(docs: DataFrame, found: Seeds, threshold: float, schema: str) -> DataFrame:
    item_type = pa.array(found.items.ids).type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches):
                for doc, item, score, last in _aligned(found, threshold, data, at):
                    ids = pa.array([found.items.ids[i] for i in item], item_type)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc)), ids, pa.array(score), pa.array(last)], ["doc_id", "item_id", "score", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def _leaky(found: Seeds, threshold: float):
    """A column function: whether a text holds a copy of an item."""

    @F.arrow_udf("boolean")
    def leaky(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for text in texts:
                out = [np.zeros(0, bool)]
                for rows, data, at in bytescan.slices(iter([pa.record_batch([text], ["text"])])):
                    out.append(np.zeros(rows.num_rows, bool))
                    for doc, *_ in _aligned(found, threshold, data, at):
                        out[-1][doc] = True
                yield pa.array(np.concatenate(out))

    return leaky


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK_ITEMS) -> DataFrame:
    """docs without the rows that hold a copy of an item, columns as they are; rows are judged by their text alone, with or without an id."""
    out = docs
    for items in blocks(benchmark, block):
        out = out.where(~_leaky(seeds(items, docs), threshold)("text"))
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
