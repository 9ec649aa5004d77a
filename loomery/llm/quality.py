"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

One scan turns each whole text into a row of statistics (lengths, shares of byte classes, repetition of words, word
pairs and lines), computed by vectorised byte scans, and a log transform. Fitting needs only, for each class, the
count, the sum and the sum of products, which Spark adds up over all labelled rows that may teach: no sample, and a
few hundred numbers for the driver. Class covariances are shrunk towards the pooled one and then towards a multiple
of the identity; their Cholesky factors are computed once and kept in the model. A score is the logistic of the
difference of log densities, from Mahalanobis distances by the factors, plus the log odds of the classes.

Defined results: null text counts as empty, and the statistics of an empty text are those of zero counts; with fewer
than two teachers in either class every score is the smoothed share of label 1; repeated rows are rows of their own;
an empty table gives an empty table. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bytescan
from loomery.llm.common import staged, table
from loomery.llm.labelled import held_out, teachers

POOLED, ROUND, THRESHOLD = 0.1, 0.02, 0.5
_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "shout": map(ord, "!?"), "sign": map(ord, "#$%&*|~^<>{}[]\\=_@+/`"), "stop": map(ord, ".,;:'\"()-"), "line": [10], "wide": range(128, 256)}
NAMES = ("bytes", "words", "word_mean", "word_spread", *_CLASSES, "repeats", "distinct", "distinct_pairs", "distinct_lines", "longest")
_MASKS = np.zeros((len(_CLASSES), 256), bool)
for _i, _bytes in enumerate(_CLASSES.values()):
    _MASKS[_i, list(_bytes)] = True
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _i in range(len(_CLASSES)):
    _KIND[_MASKS[_i]] = _i
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(bytescan.distinct_by_text(hashes, owner)[1], minlength=n)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Transformed statistics, a row for each text."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    owner = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(owner * (len(_CLASSES) + 1) + _KIND[data], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1)[:, :-1]
    starts, ends, text = bytescan.runs(bytescan.SPACES[data], at)
    length = (ends - starts).astype(float)
    count = np.bincount(text, minlength=n).astype(float)
    some = np.maximum(count, 1)
    mean = np.bincount(text, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(text, length**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, text, length)
    hashes = bytescan.run_hashes(data, starts, ends)
    pair, pair_text = bytescan.shingles(hashes, text, n, 2)
    again = np.bincount(text[1:], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]), n)
    ls, le, lt = bytescan.runs(_NEWLINE[data], at)
    lines = np.bincount(lt, minlength=n)
    share = lambda part, whole: np.log(part / np.maximum(whole, 1) + 0.003)
    return np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(mean), np.log1p(spread), *(share(k, size) for k in kinds.T),
        share(again, count), share(_distinct(hashes, text, n), count), share(_distinct(pair, pair_text, n), np.bincount(pair_text, minlength=n)),
        share(_distinct(bytescan.run_hashes(data, ls, le), lt, n), lines), np.log1p(longest),
    ])


def features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, f), f an array of doubles in the order of NAMES."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches):
                f = statistics(data, at)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * f.shape[1], pa.int32()), pa.array(f.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), values], ["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, f array<double>")


@dataclass
class Model:
    means: np.ndarray  # by class
    factors: np.ndarray  # by class: inverse of the lower Cholesky factor of the shrunk covariance
    offset: float  # log odds of the classes and difference of log determinants

    def score(self, f: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(f), 1 / (1 + np.exp(-self.offset)))
        far = [(((f - m) @ k.T) ** 2).sum(1) for m, k in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip((far[0] - far[1]) / 2 + self.offset, -500, 500)))


def fit(known: DataFrame, pooled: float = POOLED, round_: float = ROUND) -> Model:
    """known (f, y) -> the model; Spark adds up counts, sums and products, of values less their mean over both classes."""
    d = len(NAMES)
    centre = known.agg(F.array(*(F.avg(F.col("f")[i]) for i in range(d)))).first()[0]
    centre = np.array([c or 0.0 for c in centre])
    x = [F.col("f")[i] - float(centre[i]) for i in range(d)]
    up = [(i, j) for i in range(d) for j in range(i, d)]
    sums = known.groupBy("y").agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in up)).alias("p")).collect()
    n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums:
        n[r.y], s[r.y] = r.n, r.s
        for (i, j), v in zip(up, r.p, strict=True):
            p[r.y, i, j] = p[r.y, j, i] = v
    if n.min() < 2:
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), float(np.log((n[1] + 1) / (n[0] + 1))))
    means = s / n[:, None]
    scatter = p - n[:, None, None] * means[:, :, None] * means[:, None, :]
    together = scatter.sum(0) / max(n.sum() - 2, 1)
    factors, logdet = np.zeros((2, d, d)), np.zeros(2)
    for c in (0, 1):
        cov = (1 - pooled) * scatter[c] / (n[c] - 1) + pooled * together
        cov = (1 - round_) * cov + round_ * max(np.trace(cov) / d, 1e-9) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors[c], logdet[c] = np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum()
    return Model(means + centre, factors, float(np.log(n[1] / n[0]) + (logdet[0] - logdet[1]) / 2))


def score(found: DataFrame, model: Model) -> DataFrame:
    """found (doc_id, f) -> (doc_id, score)."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(f))], ["doc_id", "score"])

    return found.select("doc_id", "f").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; labels (doc_id, column) teach."""
    found = staged(features(docs), "quality-features")
    model = fit(found.join(teachers(labels, column), "doc_id"))
    scored = score(found, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
