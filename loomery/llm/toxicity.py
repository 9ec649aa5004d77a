"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only the bag has a label.

A sentence's score is the logistic of a bias and the weights of its words and their stems (hashed to `2**BITS` places); sentences
without a weighted word are neutral and add nothing, however many a document has. A document's score is the noisy-or of
its other sentences and one leak: 1 minus the product of (1 - leak) and each (1 - sentence score). The leak is the
score of a document that has neutral sentences only. Gradient steps on the documents' log loss move blame to the
sentences that explain it, so that the model then also names the offending sentences.

The model is fitted on a bounded sample of labelled rows: at most SAMPLE toxic documents and twice as many others, those of smallest
id hash whose whole texts fit into SAMPLE_BYTES and twice that, weighted to the true odds. Everything else covers all rows: the model (1 MB) goes to every task, and whole
texts are scored by vectorised byte scans without any shuffle.

Defined results: null text counts as empty and has no sentences, so its score is the leak; with no
teachers of either class every score is the smoothed share of label 1; repeated rows are rows of their own; an
empty table gives an empty table. Other columns of the input are not read.
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
from loomery.llm.labelled import held_out, teachers

BITS, SAMPLE, ROUNDS, RATE, DECAY, LEAST_DOCS, APART, THRESHOLD = 18, 1200, 200, 0.5, 1e-3, 4, 5.5, 0.7
#: Text bytes of the toxic teachers at most, and half of those of the others.
SAMPLE_BYTES = 16 << 20
#: Bytes of the stems by which words that share a beginning are known.
STEMS = (4, 5)
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def sentences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences as runs between . ! ? and line ends: starts, ends, text of each."""
    return bytescan.runs(_END[data], at)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words (runs of letters, A-Z as a-z) and of the stems of longer ones, and the byte where each begins."""
    starts, ends, _ = bytescan.runs(_NO_LETTER[data], at)
    parts = [(starts, ends)]
    for size in STEMS:
        longer = ends - starts > size
        parts.append((starts[longer], starts[longer] + size))
    starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return (bytescan.run_hashes(data, starts, ends) >> np.uint64(64 - BITS)).astype(np.int32), starts


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    constant: float | None = None
    leak: float = 0.0  # log odds

    def instance(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence starts, ends, texts, and the log odds of each (minus infinity for neutral ones)."""
        starts, ends, text = sentences(data, at)
        place, begin = words(data, at)
        known = self.weights[place] != 0
        place, bag = place[known], np.searchsorted(starts, begin[known], side="right") - 1
        z = np.full(len(starts), -np.inf)
        said = np.unique(bag)
        z[said] = np.bincount(bag, self.weights[place], len(starts))[said] + self.bias
        return starts, ends, text, z

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        _, _, text, z = self.instance(data, at)
        return self.noisy_or(text, z, n)

    def noisy_or(self, text: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
        return -np.expm1(-np.bincount(text, np.logaddexp(0, z), n) - np.logaddexp(0, self.leak))


def fit_bags(place: np.ndarray, word_bag: np.ndarray, bag_doc: np.ndarray, y: np.ndarray, odds: tuple[float, float], rounds: int = ROUNDS) -> Model:
    """Gradient steps (scaled by past squares) on the weighted log loss of the noisy-or.

    Only words whose share of documents differs between the classes by APART standard errors get a weight.
    """
    n_docs, size = len(y), 1 << BITS
    has = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
    doc = bag_doc[word_bag]
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    for d in range(n_docs):  # documents are few (the sample), and sorted
        has[y[d]][np.unique(place[cut[d] : cut[d + 1]])] += 1
    rate = [(h + 0.5) / ((y == c).sum() + 1) for c, h in enumerate(has)]
    both = (has[0] + has[1] + 1) / (n_docs + 2)
    far = (rate[1] - rate[0]) / np.sqrt(both * (1 - both) * (1 / max((y == 0).sum(), 1) + 1 / max((y == 1).sum(), 1)) + 1e-12)
    use = ((np.abs(far) >= APART) & (has[0] + has[1] >= LEAST_DOCS))[place]
    kept, column = np.unique(place[use], return_inverse=True)
    # sentences with a weighted word; the others are neutral
    said, row = np.unique(word_bag[use], return_inverse=True)
    bag_doc = bag_doc[said]
    share = np.where(y == 1, odds[1] / max((y == 1).sum(), 1), odds[0] / max((y == 0).sum(), 1))
    w, b, leak = np.clip(np.log(rate[1] / rate[0]), -2, 8)[kept], -6.0, -6.0
    seen_w, seen_b, seen_leak = np.full(len(kept), 1e-8), 1e-8, 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[column], len(bag_doc)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.exp(-np.bincount(bag_doc, np.logaddexp(0, z), n_docs) - np.logaddexp(0, leak))
        toxic = np.maximum(1 - clean, 1e-9)
        each = share * np.where(y == 1, -clean / toxic, 1.0)
        g, gl = each[bag_doc] * p, each.sum() / (1 + np.exp(-leak))
        gw, gb = np.bincount(column, g[row], len(kept)) + DECAY * w / n_docs, g.sum()
        seen_w, seen_b, seen_leak = seen_w + gw**2, seen_b + gb**2, seen_leak + gl**2
        w, b, leak = w - RATE * gw / np.sqrt(seen_w), b - 0.1 * RATE * gb / np.sqrt(seen_b), leak - RATE * gl / np.sqrt(seen_leak)
    weights = np.zeros(size, np.float32)
    weights[kept] = w
    return Model(weights, float(b), leak=float(leak))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model from at most `sample` toxic and twice as many other teachers."""
    known = teachers(labels, column)
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    odds = (count.get(0, 0), count.get(1, 0))
    if not all(odds):
        return Model(np.zeros(0, np.float32), 0.0, (odds[1] + 1) / (sum(odds) + 2))
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = known.where("y = 0").orderBy(order, "doc_id").limit(2 * sample).unionByName(known.where("y = 1").orderBy(order, "doc_id").limit(sample))
    # at most 3 * sample rows of a few numbers; rows that repeat an id count with all their bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sizes = rows.groupBy("doc_id", "y", order.alias("h")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).collect()
    kept, held = [], [0, 0]
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if held[r.y] + r.n <= SAMPLE_BYTES * (2 - r.y):
            held[r.y] += r.n
            kept.append((r.doc_id,))
    kind = docs.schema["doc_id"].dataType.simpleString()
    taught = rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept, f"doc_id {kind}")), "doc_id", "left_semi").select("y", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches):
                starts, _, text = sentences(data, at)
                place, begin = words(data, at)
                bag = np.searchsorted(starts, begin, side="right") - 1
                doc = text[bag] if len(bag) else bag
                order = np.argsort(doc, kind="stable")  # stems come after all words
                place, bag, doc = place[order], bag[order], doc[order]
                first = np.searchsorted(text, np.arange(rows.num_rows))
                cut = bytescan.offsets(doc, rows.num_rows)
                out = [rows.column(0)]
                for values in (place, (bag - first[doc]).astype(np.int32)):
                    out.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int32())))
                yield pa.RecordBatch.from_arrays(out, ["y", "place", "bag"])

    got = taught.mapInArrow(scan, "y int, place array<int>, bag array<int>").toArrow()
    y = got["y"].to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(0, np.float32), 0.0, (odds[1] + 1) / (sum(odds) + 2))
    column_ = lambda name: got[name].combine_chunks()
    lengths = np.diff(column_("place").offsets.to_numpy())
    place, bag = column_("place").flatten().to_numpy(), column_("bag").flatten().to_numpy()
    # sentences of each document, in order: a document's begin where those before it end
    many = np.zeros(len(y), np.int64)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), lengths)
    np.maximum.at(many, doc, bag + 1)
    word_bag = (np.cumsum(many) - many)[doc].astype(np.int32) + bag
    return fit_bags(place, word_bag, np.repeat(np.arange(len(y)), many), y, (odds[0] / sum(odds), odds[1] / sum(odds)))


#: Own score from which a sentence is named as offending.
NAMED = 0.5


def score(docs: DataFrame, model: Model, named: float = NAMED) -> DataFrame:
    """(doc_id, score, n_offending, offending) for every row of docs: offending lists start:end of the sentences whose own score
    reaches `named`, in code points, end exclusive, comma-joined."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    least = float(np.log(named / (1 - named)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches):
                n = rows.num_rows
                if model.constant is not None:
                    found, many, listed = model.score(data, at), np.zeros(n, np.int64), [""] * n
                else:
                    starts, ends, text, z = model.instance(data, at)
                    found = model.noisy_or(text, z, n)
                    hit = np.flatnonzero(z >= least)
                    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    first = point[at[text[hit]]]
                    places = [f"{a}:{b}" for a, b in zip((point[starts[hit]] - first).tolist(), (point[ends[hit]] - first).tolist(), strict=True)]
                    many = np.bincount(text[hit], minlength=n)
                    cut = np.concatenate([[0], np.cumsum(many)]).tolist()
                    listed = [",".join(places[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.float64()), pa.array(many, pa.int64()), pa.array(listed, pa.string())], ["doc_id", "score", "n_offending", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_offending long, offending string")


def offending(docs: DataFrame, model: Model, least: float = NAMED) -> DataFrame:
    """(doc_id, sentence, score) of the sentences whose own score reaches `least`."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches):
                if model.constant is not None:
                    continue
                starts, ends, text, z = model.instance(data, at)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                hit = np.flatnonzero(p >= least)
                said = [data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").strip() for i in hit]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text[hit])), pa.array(said, pa.string()), pa.array(p[hit])], ["doc_id", "sentence", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sentence string, score double")


def classify(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    model = fit(docs, labels, column, sample)
    bytescan.give_back()
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_offending", "offending")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the model rejects, columns as they are. Only texts go to Python, and a number for each comes back."""
    model = fit(docs, labels)
    bytescan.give_back()

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with np.errstate(over="ignore"):
            for text in texts:
                parts = [model.score(data, at) for _, data, at in bytescan.slices(iter([pa.record_batch([text], ["text"])]))]
                yield pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())

    return docs.where(scored("text") < threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
