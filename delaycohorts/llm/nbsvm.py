"""Quality classifier: Naive Bayes support vectors.

Texts are sets of hashed n-gram indicators (words, word pairs, word shapes, shape pairs). Each
indicator is scaled by the log ratio of its smoothed counts in the two classes, then a linear
hinge-loss model is fitted on the scaled indicators by dual coordinate descent. The fit uses a bounded
sample of labelled rows (``sample``, a parameter), drawn by a hash of the id, so it fits in one task;
scoring is a narrow map over all rows with a weight vector of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaycohorts.llm.common import WordIds, mix

SAMPLE = 8_000  # labelled rows of a fit
DIMENSION = 1 << 18
SMOOTH = 1.0
COST = 1.0
EPOCHS = 12
ROWS = 512

_SHAPE = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))


class Grams:
    """Distinct indicator numbers of texts."""

    def __init__(self, dimension: int = DIMENSION) -> None:
        self.words, self.shapes = WordIds(), WordIds()
        self.low = np.uint64(dimension - 1)
        self.mark = np.zeros(dimension, np.int64)

    def of(self, text: bytes | None) -> np.ndarray:
        text = text or b""
        words = self.words.of(text.lower().split())
        shapes = self.shapes.of([w[-3:] for w in text.translate(_SHAPE).split()])
        found = [np.zeros(1, np.int64)]  # the bias
        for k, ids in enumerate((words, shapes)):
            if len(ids):
                found.append((mix(ids + np.uint64(k + 1)) & self.low).astype(np.int64))
                found.append((mix(ids[:-1] * np.uint64(3) + ids[1:] * np.uint64(5) + np.uint64(k + 7)) & self.low).astype(np.int64))
        all_ids = np.concatenate(found)
        order = np.arange(len(all_ids))
        self.mark[all_ids] = order
        return all_ids[self.mark[all_ids] == order]


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, dimension: int = DIMENSION) -> np.ndarray:
    """Log ratio of the smoothed class counts of every indicator; 1 for the bias."""
    counts = [np.full(dimension, SMOOTH), np.full(dimension, SMOOTH)]
    for row, label in zip(rows, labels):
        counts[int(label)][row] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[0] = 1.0
    return ratio


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the hinge-loss model on the scaled indicators, multiplied by the scale."""
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])
    limit = np.where(y > 0, cost * len(y) / (2 * share[1]), cost * len(y) / (2 * share[0]))
    # rows have unit length, so long and short texts weigh alike
    values = []
    for row in rows:
        scaled = ratio[row]
        values.append(scaled / max(1e-12, float(np.sqrt(scaled @ scaled))))
    w, alpha, random = np.zeros(len(ratio)), np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            slope = y[i] * float(w[rows[i]] @ values[i]) - 1.0
            new = min(max(alpha[i] - slope, 0.0), limit[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(ratios, weights) from at most ``sample`` rows of ``labels`` (doc_id, label) that ``docs`` holds.

    Rows with a null id or label are left out; of repeated ids one is taken. Without rows of both
    classes all weights are zero.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    train = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [grams.of(x).astype(np.int32).tobytes() for x in part.column(text).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "label", "grams"])

    def learn(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("doc_id").to_numpy(), kind="stable")
        blobs, marks = group.column("grams").to_pylist(), group.column("label").to_numpy()
        _, first = np.unique(group.column("doc_id").to_numpy()[order], return_index=True)
        order = order[first]
        rows, y = [np.frombuffer(blobs[i], np.int32).astype(np.int64) for i in order], marks[order]
        ratio = np.zeros(DIMENSION)
        weights = np.zeros(DIMENSION)
        if len(set(y.tolist())) == 2:
            ratio = log_ratios(rows, y)
            weights = dual_descent(rows, y, ratio)
        return pa.table({"ratio": [ratio.astype(np.float32).tobytes()], "weights": [weights.astype(np.float32).tobytes()]}, schema=pa.schema([("ratio", pa.binary()), ("weights", pa.binary())]))

    rows = train.mapInArrow(features, "doc_id long, label int, grams binary").withColumn("all", F.lit(1))
    model = rows.groupBy("all").applyInArrow(learn, "ratio binary, weights binary").first()
    if model is None:
        return np.zeros(DIMENSION, np.float32), np.zeros(DIMENSION, np.float32)
    return np.frombuffer(model[0], np.float32), np.frombuffer(model[1], np.float32)


def score(docs: DataFrame, ratio: np.ndarray, weights: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id and score of every row; null and empty texts have the score of the bias alone."""
    model = docs.sparkSession.sparkContext.broadcast((ratio, ratio * weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, product = model.value
        grams = Grams()
        square = scale.astype(np.float64) ** 2
        product = product.astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for x in part.column(text).cast(pa.binary()).to_pylist():
                    row = grams.of(x)
                    length = float(np.sqrt(square[row].sum()))
                    out.append(1.0 / (1.0 + float(np.exp(-min(30.0, max(-30.0, 2.0 * float(product[row].sum()) / max(1e-12, length)))))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", text).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Only labels of ids that are not held out are read. A null id is never held out. Repeated rows are
    scored one by one; an empty table gives an empty result. Texts are read whole, whatever their length;
    equal texts have equal scores. Other columns are not read, whatever their names.
    """
    known = labels.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("doc_id", F.col("quality").cast("int").alias("label"))
    ratio, weights = fit(docs, known, sample, text)
    out = score(docs, ratio, weights, text)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
