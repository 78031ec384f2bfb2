"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word left out of a text, hashed to 2**20
coordinates. Each coordinate has a learning rate of its own, and the L1 term leaves most weights at
zero, so the model is a few hundred numbers that travel with the task. The margin at which a text counts as
toxic comes from folds of the training rows on which their model was not fit.
"""

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import columns
from .workers import frugal, give_back
from .words import U, flat, mix, word_hashes

#: Most labelled rows a model is fit on: those with the smallest hashes of doc_id, then of text. Their features, of any length,
#: lie in a file of the task that fits.
MAX_TRAINING_ROWS = 12_000
BITS, EPOCHS, ALPHA, BETA, L1, FOLDS = 20, 3, 1.0, 1.0, 5.0, 4
RUN_BYTES = 1 << 20


def features(texts) -> Iterator[np.ndarray]:
    """Sorted distinct coordinates of each text, one text after the other; letters A-Z fold, other ASCII marks separate words."""
    offsets, data = flat(texts)
    for i, j, text, h in word_hashes(offsets, data, alnum=True):
        a = 0
        for e in np.cumsum(np.bincount(text - i, minlength=j - i)).tolist():
            w, a = h[a:e], e
            grams = np.concatenate([w, mix(w[:-1] * U(3) + w[1:]), mix(w[:-2] * U(5) + w[2:])])
            yield np.unique((grams >> U(64 - BITS)).astype(np.int32))


@dataclass
class Model:
    """Weights that are not zero, and the bias that puts the decision at 0."""
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -40.0

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.index] = self.weight
        return w

    def scores(self, texts) -> np.ndarray:
        w = self.dense()
        margins = np.fromiter((w[f].sum() for f in features(texts)), np.float64, len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Dense weights and bias by FTRL-proximal steps in a fixed random order."""
    z, n, zb, nb, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0.0

    def weights(z, root):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) * ALPHA / (BETA + root))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            f = rows[i]
            zf, nf = z[f], n[f]
            root = np.sqrt(nf)
            w = weights(zf, root)
            g = 1 / (1 + np.exp(-min(30.0, max(-30.0, w.sum() + bias)))) - labels[i]
            z[f] = zf + g - (np.sqrt(nf + g * g) - root) / ALPHA * w
            n[f] = nf + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * bias
            nb += g * g
            bias = -zb * ALPHA / (BETA + np.sqrt(nb))
    return weights(z, np.sqrt(n)), float(bias)


def best_margin(margins: np.ndarray, labels: np.ndarray) -> float:
    """The cut with the fewest errors, in the middle between the margins on its two sides."""
    order = np.argsort(-margins, kind="stable")
    m = margins[order]
    gain = np.cumsum(2 * labels[order] - 1)                        # right less wrong among all above the cut
    last = np.append(m[1:] < m[:-1], True)                         # never between equal margins
    best = int(np.argmax(np.where(last, gain, -len(m) - 1)))
    if gain[best] <= 0:
        return float(m[0]) + 1.0
    return float((m[best] + m[best + 1]) / 2) if best + 1 < len(m) else float(m[best]) - 1.0


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of labelled feature rows. With one class or none it gives every text that class, or 0."""
    if len(set(labels.tolist())) < 2:
        return Model(bias=40.0 if len(labels) and labels[0] == 1 else -40.0)
    fold = np.arange(len(rows)) % FOLDS
    margins = np.zeros(len(rows))
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        w, bias = ftrl([rows[i] for i in inside], labels[inside])
        for i in np.flatnonzero(fold == k):
            margins[i] = w[rows[i]].sum() + bias
    w, bias = ftrl(rows, labels)
    index = np.flatnonzero(w).astype(np.int32)
    return Model(index, w[index], bias - best_margin(margins, labels))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    """Fits on docs(doc_id, text) with labels(doc_id, toxic), held-out rows left out.

    At most `most` labelled rows count, chosen by hash; their features are made where the texts are and
    meet in one task, on its disk. Null labels are no labels; of several for one id the largest counts.
    """
    known = (columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
             .orderBy("h", "doc_id").limit(most))

    @frugal("words")
    def rows(batches):
        for batch in batches:
            at, cells, size = 0, [], 0
            for f in features(batch.column("text")):
                cells.append(f.tobytes())
                size += len(cells[-1])
                if size > RUN_BYTES or at + len(cells) == batch.num_rows:
                    some = batch.slice(at, len(cells))
                    yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("h", "toxic", "times")], pa.array(cells, pa.binary())], ["h", "toxic", "times", "cells"])
                    at, cells, size = at + len(cells), [], 0

    @frugal("words")
    def train(batches):
        with tempfile.TemporaryFile() as file:
            got, end = [], 0
            for b in batches:
                for h, t, times, c in zip(*[x.to_pylist() for x in b.columns]):
                    file.write(c)
                    got.append((h, t, hashlib.blake2b(c, digest_size=16).digest(), end, end := end + len(c) // 4, times))
            file.flush()
            cells = np.memmap(file, np.int32, "r") if end else np.zeros(0, np.int32)
            got = [r for r in sorted(got) for _ in range(r[-1])]
            m = fit_rows([cells[a:b] for _, _, _, a, b, _ in got], np.array([r[1] for r in got], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.index, -1).astype(np.int32)), pa.array(np.append(m.weight, m.bias))], ["index", "weight"])

    met = columns(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("h", "toxic", "text", "doc_id")   # `most` small rows
    if met.count() <= most:
        met = met.select("h", "toxic", F.lit(1).alias("times"), "text")
    else:                                                          # ids repeat: rows are chosen by their hashes, equal ones once with their number
        met = met.withColumn("k", F.xxhash64("text"))
        sizes = met.groupBy("h", "doc_id", "k").agg(F.count("*").alias("n")).orderBy("h", "doc_id", "k").limit(most).collect()
        left = np.maximum(most - np.cumsum([0, *[r.n for r in sizes]]), 0)
        chosen = [(r.doc_id, r.k, int(min(r.n, m))) for r, m in zip(sizes, left) if m]
        times = docs.sparkSession.createDataFrame(chosen, "doc_id long, k long, times int")
        met = (met.join(F.broadcast(times), ["doc_id", "k"]).groupBy("doc_id", "k")
               .agg(*[F.first(c).alias(c) for c in ("h", "toxic", "times", "text")]).select("h", "toxic", "times", "text"))
    made = met.mapInArrow(rows, "h long, toxic int, times int, cells binary")
    got = made.repartition(1).mapInArrow(train, "index int, weight double").toPandas()
    if not len(got):
        return Model()
    last = got["index"] < 0
    return Model(got["index"][~last].to_numpy(np.int32), got["weight"][~last].to_numpy(), float(got["weight"][last].iloc[0]))


def score(text: Column, model: Model) -> Column:
    """Score of a text column, 0 to 1; only the text goes to Python."""
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        give_back("words")
        out = pa.array(model.scores(texts), pa.float64())
        give_back("words")
        return out
    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...).

    A null or empty text has the score of no features. A null doc_id is not held out and has no label. Rows that repeat
    are scored each (and, if labelled, learned from each). Extra columns are ignored. Without usable labels every score is 0.
    """
    model = fit(docs, labels, most)
    scored = columns(docs, "doc_id", "text").withColumn("score", score(F.col("text"), model))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
