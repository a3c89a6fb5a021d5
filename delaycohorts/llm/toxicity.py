"""Toxicity: a convolutional text classifier over hashed word embeddings.

Every word has two hashed embeddings, so two words are mixed up only if they collide twice. Filters of
width 1, 2 and 3 slide over the whole text, each keeps its largest response (max pooling), and a
linear layer turns the responses into a score. Embeddings, filters and weights are trained in numpy by
Adagrad; the gradient of max pooling reaches only the window that won. One coordinate of each embedding
starts as the log ratio of the bucket's class counts, the others at random; buckets seen in fewer than
``SEEN`` labelled texts stay zero, so unknown words are silent however many there are. A fifth of the
labelled texts is held back to stop the training, to map responses to probabilities and to
choose a threshold per language. The language is used for that threshold only, never for the score.

All labelled rows are learnt from. Their words are packed into parts of bounded size, one row each. In every
epoch each part makes its own pass from the same network, and the results are averaged block by block of
embeddings; a row of the embeddings is averaged over the parts that moved it. Class counts, the loss that
picks the epoch, the map to probabilities and the thresholds are aggregates over all parts. The driver holds
one network, the counts of its buckets, and cells of scores per language.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.llm.common import WordIds
from delaycohorts.session import materialize, work_folder

PART_ROWS = 4_000  # labelled rows of a part, on average; there are as many parts as it takes
PART_BYTES = 16_000_000  # of their texts
BLOCK = 1 << 10  # rows of the embeddings that are averaged at a time
FILTER = 1 << 23  # bits of the map of labelled ids that spares other texts the shuffle
CELLS = 10_000  # scores are counted in so many cells for the thresholds
CUT = 0.3  # score from which a text is predicted toxic
BUCKETS = 1 << 18
HALF = 6  # coordinates of each of the two embeddings
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
SEEN = 3  # labelled texts that a bucket needs
EPOCHS = 14
RATE = 0.08
DECAY = 1e-4
STEP = 32  # texts of a gradient step
CHUNK = 1 << 15  # words that are filtered at a time
RARE = 5  # toxic texts that a language needs for a threshold of its own
PAD = max(WIDTHS) - 1
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt; a null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def buckets(ids: np.ndarray) -> np.ndarray:
    """Numbers of the two hashed embeddings of every word."""
    low = np.uint64(BUCKETS - 1)
    return np.stack([ids & low, (ids >> np.uint64(32)) & low], axis=1).astype(np.int32)


def squeezed(words: np.ndarray) -> bytes:
    return pa.compress(words.tobytes(), "zstd", asbytes=True)


def spread(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 8 * size, "zstd"), np.int32).reshape(-1, 2)


class Words:
    """Hashed words of texts."""

    def __init__(self) -> None:
        self.ids = WordIds()

    def of(self, text: str | None) -> np.ndarray:
        return buckets(self.ids.of(_WORD.findall((text or "").lower().encode())))


class Network:
    """Embeddings (2, buckets, HALF), filters per width, and the linear layer on the pooled responses."""

    def __init__(self, seed: int = 12) -> None:
        random = np.random.default_rng(seed)
        self.embeddings = np.zeros((2, BUCKETS, HALF), np.float32)
        self.filters = [random.normal(0, 0.4, (w, 2 * HALF, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.weights = random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(0)
        self.slope, self.shift = 1.0, 0.0  # of the map to probabilities
        self.thresholds: dict[str | None, float] = {}

    def embed(self, words: np.ndarray) -> np.ndarray:
        return np.concatenate([self.embeddings[0][words[:, 0]], self.embeddings[1][words[:, 1]]], axis=1)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """Per width, the response of every filter at every start of a window in ``x``, which ends with PAD rows."""
        size = len(x) - PAD
        out = []
        for w, filters in zip(WIDTHS, self.filters):
            total = x[:size] @ filters[0]
            for k in range(1, w):
                total += x[k : size + k] @ filters[k]
            out.append(total)
        return out

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest response of every filter over every whole text, block by block."""
        starts = np.cumsum([0] + [len(t) + PAD for t in texts])
        best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        words = np.zeros((starts[-1] + PAD, 2), np.int32)
        there = np.zeros(len(words), bool)
        for at, t in zip(starts, texts):
            words[at : at + len(t)] = t
            there[at : at + len(t)] = True
        for at in range(0, int(starts[-1]), CHUNK):
            end = min(at + CHUNK, int(starts[-1]))
            x = self.embed(words[at : end + PAD])
            x[~there[at : end + PAD]] = 0
            first = int(np.searchsorted(starts, at, "right")) - 1
            cuts = starts[first:-1]
            cuts = np.maximum(cuts[cuts < end] - at, 0)
            blank, responses = ~there[at:end], self.responses(x)
            for r in responses:  # windows between texts say nothing
                r[blank] = 0
            found = np.concatenate([np.maximum.reduceat(r, cuts, axis=0) for r in responses], axis=1)
            rows = slice(first, first + len(cuts))
            best[rows] = np.maximum(best[rows], found)
        return best

    def hidden(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.maximum(self.pooled(texts) + np.concatenate(self.biases), 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return (self.hidden(texts) @ self.weights + self.bias).astype(np.float64)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        z = np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


def _start(net: Network, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Fill the embeddings of known buckets from texts per half, label and bucket, and per label; returns which they are."""
    random = np.random.default_rng(3)
    known = counts.sum(axis=1) >= SEEN
    ratio = np.log((counts[:, 1] + 1) / (rows[1] + 2)) - np.log((counts[:, 0] + 1) / (rows[0] + 2))
    net.embeddings[:] = random.normal(0, 0.1, net.embeddings.shape) * known[:, :, None]
    net.embeddings[:, :, 0] = np.clip(ratio / 4, -2, 2) * known
    return known


def _step(net: Network, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, memory: dict, known: np.ndarray) -> None:
    """One Adagrad step on the weighted log loss of some texts."""
    winners, values = [], []
    for t in texts:  # windows that win the pooling
        x = np.concatenate([net.embed(t), np.zeros((1 + PAD, 2 * HALF), np.float32)]) if len(t) else np.zeros((1 + PAD, 2 * HALF), np.float32)
        found = net.responses(x)
        places = [r.argmax(axis=0) for r in found]
        winners.append(places)
        values.append([r[p, np.arange(FILTERS)] for r, p in zip(found, places)])
    h = np.array([np.concatenate(v) for v in values]) + np.concatenate(net.biases)
    on = h > 0
    h = np.maximum(h, 0)
    z = h @ net.weights + net.bias
    slope = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
    back = slope[:, None] * net.weights * on

    def move(name: str, value: np.ndarray, gradient: np.ndarray, decay: float = 0.0) -> np.ndarray:
        gradient = gradient + decay * value
        memory[name] = memory.get(name, 1e-8) + gradient * gradient
        return (value - RATE * gradient / np.sqrt(memory[name])).astype(np.float32)

    filters, biases, touched, pulls = [], [], [], []
    for j, w in enumerate(WIDTHS):
        b = back[:, j * FILTERS : (j + 1) * FILTERS]  # texts x filters
        gradient = np.zeros_like(net.filters[j])
        for k in range(w):
            at = np.array([p[j] for p in winners]) + k
            inside = at < np.array([len(t) for t in texts])[:, None]
            words = np.array([t[np.minimum(a, len(t) - 1)] if len(t) else np.zeros((FILTERS, 2), np.int32) for t, a in zip(texts, at)])
            x = np.concatenate([net.embeddings[0][words[..., 0]], net.embeddings[1][words[..., 1]]], axis=2) * inside[..., None]
            gradient[k] = np.einsum("tf,tfe->ef", b, x)
            pull = (b * inside)[..., None] * net.filters[j][k].T  # texts x filters x coordinates
            touched.append(words.reshape(-1, 2))
            pulls.append(pull.reshape(-1, 2 * HALF))
        filters.append(gradient)
        biases.append(b.sum(axis=0))
    words, pulls = np.concatenate(touched), np.concatenate(pulls)
    for half in (0, 1):
        rows, place = np.unique(words[:, half], return_inverse=True)
        gradient = np.zeros((len(rows), HALF), np.float32)
        np.add.at(gradient, place, pulls[:, half * HALF : (half + 1) * HALF])
        gradient *= known[half, rows][:, None]
        seen = memory.setdefault(f"embeddings{half}", np.full((BUCKETS, HALF), 1e-2, np.float32))
        seen[rows] += gradient * gradient
        net.embeddings[half, rows] -= 0.5 * RATE * gradient / np.sqrt(seen[rows])
    for j in range(len(WIDTHS)):
        net.filters[j] = move(f"filters{j}", net.filters[j], filters[j], DECAY)
        net.biases[j] = move(f"biases{j}", net.biases[j], biases[j])
    net.weights = move("weights", net.weights, h.T @ slope, DECAY)
    net.bias = move("bias", net.bias, slope.sum())


def _platt(judged: DataFrame) -> tuple[float, float]:
    """Slope and shift that make logits probabilities, by Newton steps on softened labels of ``judged`` (z, label, n)."""
    rows = judged.agg(F.sum(F.expr("n * label")), F.sum(F.expr("n * (1 - label)"))).first()
    high, low = (rows[0] + 1) / (rows[0] + 2), 1 / (rows[1] + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("z") + b))))
        r = F.col("n") * (p - F.when(F.col("label") == 1, high).otherwise(low))
        w, z = F.col("n") * F.greatest(p * (1 - p), F.lit(1e-9)), F.col("z")
        gz, g, wzz, wz, ww = judged.agg(F.sum(r * z), F.sum(r), F.sum(w * z * z), F.sum(w * z), F.sum(w)).first()
        d = np.linalg.solve(np.array([[wzz + 1e-3, wz], [wz, ww + 1e-3]]), np.array([gz, g]))
        d /= max(1.0, float(np.abs(d).max()) / 2)
        a, b = a - float(d[0]), b - float(d[1])
        if np.abs(d).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _threshold(high: np.ndarray, low: np.ndarray, n: np.ndarray, hits: np.ndarray) -> float:
    """Cut with the best F1, of equals the one nearest to CUT, from the scores' cells in falling order.

    ``high`` and ``low`` are the ends of a cell, ``n`` its texts and ``hits`` the toxic ones.
    """
    s, below = low, np.append(high[1:], 0.0)
    f1 = 2 * np.cumsum(hits) / (np.cumsum(n) + hits.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    cuts = [min(max(CUT, (s[i] + below[i]) / 2), s[i]) if below[i] < CUT <= s[i] else (s[i] + below[i]) / 2 for i in best]
    return float(min(cuts, key=lambda c: abs(c - CUT)))


def _thresholds(judged: DataFrame, slope: float, shift: float) -> dict[str | None, float]:
    """Threshold per language that has RARE toxic texts, from ``judged`` (lang, z, label, n)."""
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), slope * F.col("z") + shift))
    scored = judged.withColumn("score", 1 / (1 + F.exp(-z)))
    cells = scored.groupBy("lang", F.floor(F.col("score") * CELLS).alias("cell")).agg(
        F.max("score").alias("high"), F.min("score").alias("low"), F.sum("n").alias("n"), F.sum(F.expr("n * label")).alias("hits")
    )
    often = scored.groupBy("lang").agg(F.sum(F.expr("n * label")).alias("all")).where(F.col("all") >= RARE).select(F.col("lang").alias("own"))
    found = cells.join(often, F.col("lang").eqNullSafe(F.col("own"))).toPandas()
    out = {}
    for language, rows in found.groupby("lang", dropna=False):
        rows = rows.sort_values("cell", ascending=False)
        out[language if isinstance(language, str) else None] = _threshold(*(rows[k].to_numpy(float) for k in ("high", "low", "n", "hits")))
    return out


class Part:
    """Labelled texts of one row of the packed table; every fifth is held back."""

    def __init__(self, row: dict) -> None:
        sizes = np.frombuffer(row["sizes"], np.int64).tolist()
        self.texts = [spread(w, n) for n, w in zip(sizes, row["words"])]
        self.y = np.frombuffer(row["labels"], np.int32).astype(np.float64)
        self.languages = row["langs"]
        back = np.arange(len(self.texts)) % 5 == 4
        self.fit, self.held = np.flatnonzero(~back), np.flatnonzero(back)

    def chosen(self, which: np.ndarray) -> list[np.ndarray]:
        return [self.texts[i] for i in which]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row["part"], Part(row)


_DENSE = [f"{name}{j}" for name in ("filters", "biases") for j in range(len(WIDTHS))] + ["weights", "bias"]


class Course:
    """State of the training: the network, the squared gradients of Adagrad, and the known buckets."""

    def __init__(self, net: Network, known: np.ndarray) -> None:
        self.net, self.known, self.memory = net, known, {}
        for name in _DENSE:
            self.memory[name] = np.full(np.shape(self.dense(name)), 1e-8, np.float32)
        for half in (0, 1):
            self.memory[f"embeddings{half}"] = np.full((BUCKETS, HALF), 1e-2, np.float32)

    def dense(self, name: str) -> np.ndarray:
        return getattr(self.net, name) if name in ("weights", "bias") else getattr(self.net, name[:-1])[int(name[-1])]

    def flat(self) -> np.ndarray:
        """All dense parameters and their memory."""
        return np.concatenate([np.ravel(x).astype(np.float64) for n in _DENSE for x in (self.dense(n), self.memory[n])])

    def take_flat(self, values: np.ndarray) -> None:
        at = 0
        for name in _DENSE:
            old = self.dense(name)
            size = int(np.size(old))
            value = values[at : at + size].reshape(np.shape(old)).astype(np.float32)
            self.memory[name] = values[at + size : at + 2 * size].reshape(np.shape(old)).astype(np.float32)
            at += 2 * size
            if name in ("weights", "bias"):
                setattr(self.net, name, value if np.ndim(value) else np.float32(value))
            else:
                getattr(self.net, name[:-1])[int(name[-1])] = value

    def rows(self, half: int, rows: np.ndarray) -> np.ndarray:
        """Embeddings and their memory of some buckets."""
        return np.concatenate([self.net.embeddings[half, rows], self.memory[f"embeddings{half}"][rows]], axis=1)

    def take_rows(self, half: int, rows: np.ndarray, values: np.ndarray) -> None:
        self.net.embeddings[half, rows] = values[:, :HALF]
        self.memory[f"embeddings{half}"][rows] = values[:, HALF:]

    def __getstate__(self) -> dict:
        """Rows of unknown buckets are as they began and left out."""
        rows = [np.flatnonzero(k) for k in self.known]
        return {"flat": self.flat(), "rows": rows, "values": [self.rows(half, rows[half]) for half in (0, 1)]}

    def __setstate__(self, state: dict) -> None:
        known = np.zeros((2, BUCKETS), bool)
        for half in (0, 1):
            known[half, state["rows"][half]] = True
        self.__init__(Network(), known)
        self.take_flat(state["flat"])
        for half in (0, 1):
            self.take_rows(half, state["rows"][half], state["values"][half])

    def epoch(self, part: Part, weight: float, number: int) -> list[np.ndarray]:
        """One pass over a part; returns which buckets it moved."""
        random = np.random.default_rng(5)
        for _ in range(number + 1):
            order = random.permutation(part.fit)
        before = [self.memory[f"embeddings{half}"].copy() for half in (0, 1)]
        weights = np.where(part.y == 1, weight, 1.0)
        for at in range(0, len(order), STEP):
            rows = order[at : at + STEP]
            _step(self.net, part.chosen(rows), part.y[rows], weights[rows], self.memory, self.known)
        return [np.flatnonzero((self.memory[f"embeddings{half}"] != before[half]).any(axis=1)) for half in (0, 1)]


_MOVED = "block int, part int, rows binary, values binary, loss double"


def _round(packed: DataFrame, course: Course, weight: float, number: int, epochs: int, all_rows: bool) -> float:
    """Move ``course`` by one epoch over all parts, unless it is the last; returns the loss it had before on the judged texts."""
    shared = packed.sparkSession.sparkContext.broadcast(pickle.dumps(course))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in _parts(batches):
            now = pickle.loads(shared.value)
            judge = own.fit if all_rows else own.held
            loss, y = 0.0, own.y[judge]
            if number and len(judge):
                z = np.clip(now.net.logits(own.chosen(judge)), -30, 30)
                loss = float((np.where(y == 1, weight, 1.0) * np.logaddexp(0, np.where(y == 1, -z, z))).sum())
            moved = now.epoch(own, weight, number) if number < epochs else []
            blocks, rows, values = [-1], [b""], [now.flat().tobytes()]
            for half, every in enumerate(moved):
                for some in np.split(every, np.flatnonzero(np.diff(every // BLOCK)) + 1) if len(every) else []:
                    blocks.append(half * (BUCKETS // BLOCK) + int(some[0]) // BLOCK)
                    rows.append(some.tobytes())
                    values.append(now.rows(half, some).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(rows, pa.binary()), pa.array(values, pa.binary()),
                 pa.array([loss] + [0.0] * (len(blocks) - 1), pa.float64())],
                ["block", "part", "rows", "values", "loss"],
            )

    def mean(group: pa.Table) -> pa.Table:
        """Averages of one block, summed in the order of the parts."""
        table = group.sort_by("part").to_pydict()
        block, loss = table["block"][0], float(sum(table["loss"]))
        if block < 0:
            every = [np.frombuffer(v) for v in table["values"]]
            rows, value = b"", (sum(every) / len(every)).tobytes()
        else:
            count, total = np.zeros(BLOCK), np.zeros((BLOCK, 2 * HALF))
            for r, v in zip(table["rows"], table["values"]):
                at = np.frombuffer(r, np.int64) % BLOCK
                count[at] += 1
                total[at] += np.frombuffer(v, np.float32).reshape(-1, 2 * HALF)
            at = np.flatnonzero(count)
            rows = (at + block % (BUCKETS // BLOCK) * BLOCK).tobytes()
            value = (total[at] / count[at, None]).astype(np.float32).tobytes()
        return pa.table({"block": pa.array([block], pa.int32()), "part": pa.array([0], pa.int32()), "rows": pa.array([rows], pa.binary()),
                         "values": pa.array([value], pa.binary()), "loss": [loss]})

    loss = 0.0
    for r in packed.mapInArrow(run, _MOVED).groupBy("block").applyInArrow(lambda t: mean(t), _MOVED).collect():
        if r["block"] < 0:
            loss = r["loss"]
            course.take_flat(np.frombuffer(r["values"]))
        else:
            course.take_rows(r["block"] // (BUCKETS // BLOCK), np.frombuffer(r["rows"], np.int64), np.frombuffer(r["values"], np.float32).reshape(-1, 2 * HALF))
    shared.destroy()
    return loss


def _counts(packed: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts to fit per half, label and bucket; texts to fit and held back per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _parts(batches):
            for half in (0, 1):
                counts = np.zeros((2, BUCKETS), np.int64)
                for i in own.fit:
                    counts[int(own.y[i]), np.unique(own.texts[i][:, half])] += 1
                at = np.flatnonzero(counts.any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), half, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["half", "bucket", "clean", "toxic"])
            labels = [np.bincount(own.y[x].astype(int), minlength=2) for x in (own.fit, own.held)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([2, 2], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([x[0] for x in labels], pa.int64()), pa.array([x[1] for x in labels], pa.int64())],
                ["half", "bucket", "clean", "toxic"],
            )

    table = packed.mapInArrow(run, "half int, bucket int, clean long, toxic long").groupBy("half", "bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    table = table.where((F.col("half") == 2) | (F.col("clean") + F.col("toxic") >= SEEN)).toArrow()
    half, bucket, clean, toxic = (table.column(k).to_numpy() for k in ("half", "bucket", "clean", "toxic"))
    counts, rows = np.zeros((2, 2, BUCKETS)), np.zeros((2, 2))
    for k in (0, 1):
        own = half == k
        counts[k, 0, bucket[own]], counts[k, 1, bucket[own]] = clean[own], toxic[own]
    own = half == 2
    rows[bucket[own], 0], rows[bucket[own], 1] = clean[own], toxic[own]
    return counts, rows[0], rows[1]


def train(packed: DataFrame, epochs: int = EPOCHS) -> Network:
    """A network fitted on four fifths of the texts of all parts and calibrated on the rest.

    Without texts of both classes the network stays silent and every score is one half of CUT.
    """
    net = Network()
    counts, fit_rows, held_rows = _counts(packed)
    if not fit_rows.all():
        net.weights[:] = 0
        net.shift = float(np.log(CUT / 2 / (1 - CUT / 2)))
        return net
    course = Course(net, _start(net, counts, fit_rows))
    weight, all_rows = float(np.sqrt(fit_rows[0] / fit_rows[1])), not held_rows.all()
    best = (np.inf, b"")
    for number in range(epochs + 1):
        before = pickle.dumps(course)
        loss = _round(packed, course, weight, number, epochs, all_rows)
        if number and loss < best[0]:
            best = loss, before
    net = pickle.loads(best[1]).net
    model = packed.sparkSession.sparkContext.broadcast(net)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _parts(batches):
            rows = own.fit if all_rows else own.held
            if len(rows):
                z = model.value.logits(own.chosen(rows))
                yield pa.RecordBatch.from_arrays([pa.array([own.languages[i] for i in rows], pa.string()), pa.array(z), pa.array(own.y[rows].astype(np.int32))], ["lang", "z", "label"])

    judged = materialize(packed.mapInArrow(judge, "lang string, z double, label int").groupBy("lang", "z", "label").agg(F.count("*").alias("n")))
    model.destroy()
    net.slope, net.shift = _platt(judged)
    net.thresholds = _thresholds(judged, net.slope, net.shift)
    return net


def _likely(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id has its bit set in a bitmap of the ids of ``chosen``; of fixed size, so some others too."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)) + 1
    number, place = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
    maps = chosen.select(number.alias("number"), place.alias("place")).groupBy("number").agg(F.bitmap_construct_agg("place").alias("bits"))
    at = docs.withColumns({"number": number, "place": place}).join(F.broadcast(maps), "number")  # FILTER bits at most
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return at.where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(docs.columns)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network from all rows of ``labels`` (doc_id, label) that ``docs`` (doc_id, text, lang) holds.

    Of repeated ids one counts, with its largest label. Rows with a null id or label are left out.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    size = docs.select("doc_id", F.octet_length("text").alias("size")).join(chosen, "doc_id").agg(F.count("*"), F.sum("size")).first()
    parts = 1 + max(size[0] // PART_ROWS, (size[1] or 0) // PART_BYTES)
    rows = _likely(docs.select("doc_id", "text", "lang"), chosen).join(chosen, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [hashed.of(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), part.column("lang").cast(pa.string()), pa.array(map(len, found), pa.int64()),
                     pa.array([x[:8].tobytes() for x in found], pa.binary()), pa.array([squeezed(x) for x in found], pa.binary())],
                    ["doc_id", "label", "lang", "size", "head", "words"],
                )

    def pack(group: pa.Table) -> pa.Table:
        table = group.sort_by([("drawn", "ascending"), ("doc_id", "ascending")])
        one = {"part": group.column("part")[0].as_py(), "labels": table.column("label").to_numpy().astype(np.int32).tobytes(), "langs": table.column("lang").to_pylist(),
               "sizes": table.column("size").to_numpy().astype(np.int64).tobytes(), "words": table.column("words").to_pylist()}
        return pa.table({k: pa.array([one[k]], t) for k, t in zip(one, (pa.int32(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary())))})

    read = rows.mapInArrow(features, "doc_id long, label int, lang string, size long, head binary, words binary")
    drawn = F.xxhash64("doc_id")
    read = read.withColumn("part", F.pmod(drawn, F.lit(parts)).cast("int")).repartition("part")  # serves both groupings
    single = read.groupBy("part", "doc_id").agg(F.min(F.struct("head", "words", "size", "lang", "label")).alias("one")).select("part", "doc_id", drawn.alias("drawn"), "one.*")
    packed = single.groupBy("part").applyInArrow(lambda t: pack(t), "part int, labels binary, langs array<string>, sizes binary, words array<binary>")
    path = work_folder(docs.sparkSession)
    packed.write.option("maxRecordsPerFile", 1).parquet(path)  # parts are read by different tasks
    return train(docs.sparkSession.read.schema(packed.schema).parquet(path))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score, threshold (of the row's language) of every row of ``docs`` (doc_id, text, lang)."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, own = Words(), model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = own.scores([hashed.of(x) for x in part.column("text").to_pylist()])
                limits = [own.thresholds.get(x, CUT) for x in part.column("lang").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(found), pa.array(limits)], ["doc_id", "score", "threshold"])

    return docs.mapInArrow(run, "doc_id long, score double, threshold double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and flagged (score at the language's threshold) of every row.

    Null and empty texts have the score of a text without words. Only labels of ids that are not held out
    are read; a null id is never held out and never learnt from. Repeated rows are scored one by one, ties
    take the same side of a cut, an empty table gives an empty result. Texts are read whole, block by block,
    whatever their length. Other columns are not read, whatever their names.
    """
    rows = docs.select("doc_id", "text", "lang")
    known = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    out = score(rows, fit(rows, known))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).cast("int").alias("flagged"),
    )
