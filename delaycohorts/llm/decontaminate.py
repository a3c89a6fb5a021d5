"""Benchmark decontamination: n-gram seeds, then local alignment.

Every text is scanned once for word n-grams that occur in a benchmark item. The words around the hits are
aligned with every item that holds one of them, common n-grams too, by Smith-Waterman over words, so
edited and paraphrased copies score nearly like exact ones. Only pairs that cannot reach the bounds,
because too few words of the item stand there at all, are not aligned. A copy without a single intact
n-gram is not seen. The benchmark is a stated query set: its items are broadcast in blocks of bounded
size, one scan of the corpus for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaycohorts.llm.common import WordIds, windows
from delaycohorts.session import materialize

N = 4
BLOCK = 500_000  # words of the benchmark in one broadcast
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
MIN_SCORE = 0.5  # of the item aligned to itself
MIN_WORDS = 8  # matched words, or all of a shorter item
ROWS = 512
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return (text or "").lower().encode().translate(None, PUNCTUATION).split()


def item_words(benchmark: DataFrame, text: str) -> DataFrame:
    """(item_id, ids, words) of every item that has words; the ids are one blob."""

    def cut(batches):
        ids = WordIds()
        for batch in batches:
            rows = [(key, ids.of(words_of(x))) for key, x in zip(batch.column("item_id").to_pylist(), batch.column(text).to_pylist())]
            rows = [(key, own) for key, own in rows if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([len(r[1]) for r in rows], pa.int64())], ["item_id", "ids", "words"])

    return benchmark.select("item_id", text).mapInArrow(cut, "item_id long, ids binary, words long")


class Items:
    """Items of one block and, for every n-gram, the items that hold it."""

    def __init__(self, block: pa.Table, n: int, min_score: float) -> None:
        self.keys = block.column("item_id").to_pylist()
        self.words = [np.frombuffer(x, np.uint64) for x in block.column("ids").to_pylist()]
        sizes = np.array([len(x) for x in self.words], np.int64)
        self.lengths = np.unique(np.minimum(sizes, n)).tolist()
        # An alignment of the least score has at most 2 (1 - min_score) errors for each word of the item.
        self.reach = np.ceil(sizes * (1 + 2 * max(0.0, 1 - min_score))).astype(np.int64)
        self.least = np.maximum(np.minimum(sizes, MIN_WORDS), min_score * sizes)
        grams = [np.unique(windows(x, n)) for x in self.words]
        gram, owner = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(x) for x in grams])
        order = np.argsort(gram, kind="stable")
        self.owner = owner[order]
        self.grams, starts = np.unique(gram[order], return_index=True)
        self.starts = np.append(starts, len(gram))

    def places(self, ids: np.ndarray, sieve: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, end) of the words around neighbouring hits of an item."""
        low = np.uint64(len(sieve) - 1)
        at, gram = [], []
        for length in self.lengths:
            if length > len(ids):
                continue
            own = windows(ids, length)
            where = np.flatnonzero(sieve[(own & low).astype(np.int64)])
            if len(where):
                near = np.minimum(np.searchsorted(self.grams, own[where]), len(self.grams) - 1)
                same = self.grams[near] == own[where]
                at.append(where[same])
                gram.append(near[same])
        if not at or not sum(map(len, at)):
            return
        at, gram = np.concatenate(at), np.concatenate(gram)
        times = self.starts[gram + 1] - self.starts[gram]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, at = self.owner[np.repeat(self.starts[gram], times) + nth], np.repeat(at, times)
        order = np.lexsort((at, item))
        item, at = item[order], at[order]
        first = np.append(True, (item[1:] != item[:-1]) | (np.diff(at) > 2 * self.reach[item[1:]]))
        last = np.append(first[1:], True)
        reach = self.reach[item]
        yield from zip(item[first].tolist(), np.maximum(at - reach, 0)[first].tolist(), (at + reach + self.lengths[-1])[last].tolist())


def scan(docs: DataFrame, items: Items, min_score: float, text: str) -> DataFrame:
    """A row for every place of a text where the alignment with an item passes the bounds."""
    known = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items = WordIds(), known.value
        sieve = np.zeros(1 << 22, bool)
        sieve[(items.grams & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                rows = []
                for key, x in zip(part.column("doc_id").to_pylist(), part.column(text).to_pylist()):
                    own = ids.of(words_of(x))
                    for k, first, end in items.places(own, sieve):
                        item, passage = items.words[k], own[first:end]
                        if np.isin(item, passage).sum() < items.least[k]:
                            continue  # the score is at most the number of words in common
                        score, matched, start, stop = align(item, passage)
                        if score / len(item) >= min_score and matched >= min(MIN_WORDS, len(item)):
                            rows.append((key, items.keys[k], score / len(item), matched, len(item), first + start, first + stop))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_ALIGNED), _ALIGNED.types)], schema=_ALIGNED)

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias(text)).mapInArrow(run, _ROW)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int, int]:
    """Best local alignment: score, matched words, first and last word of the passage in it.

    One vector step per item word; gaps along the passage are a running maximum. Matches and start of
    the best path travel with the score.
    """
    m = len(passage)
    slope = -GAP * np.arange(m)
    score, count, start = np.zeros(m + 1), np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0.0, 0, 0, 0)
    for word in item:
        equal = passage == word
        diagonal = score[:-1] + np.where(equal, MATCH, MISMATCH)
        above = score[1:] + GAP
        use = diagonal >= above
        here = np.where(use, diagonal, above)
        matched = np.where(use, count[:-1] + equal, count[1:])
        begun = np.where(use, start[:-1], start[1:])
        fresh = here <= 0
        here[fresh], matched[fresh] = 0.0, 0
        begun[fresh] = np.arange(1, m + 1)[fresh]
        lifted = here + slope
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(m), 0))
        gapped = lifted[source] - slope
        better = gapped > here
        here = np.where(better, gapped, here)
        matched, begun = np.where(better, matched[source], matched), np.where(better, begun[source], begun)
        score[1:], count[1:], start[1:] = here, matched, begun
        k = int(np.argmax(here))
        if here[k] > best[0]:
            best = (float(here[k]), int(matched[k]), int(begun[k]), k)
    return best


_ROW = "doc_id long, item_id long, score double, matched long, item_words long, first_word long, last_word long"
_ALIGNED = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("matched", pa.int64()), ("item_words", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, min_score: float = MIN_SCORE, text: str = "text") -> DataFrame:
    """One row per document and item that its text holds, exactly or edited.

    Returns doc_id, item_id, score (1 for an exact copy), matched, item_words and the word span of
    the best place. Null and empty texts and items hold nothing. Items with fewer than ``n`` words
    are one shorter n-gram, looked for in every text. Rows that share a doc_id or item_id are one. Null ids are kept as null. Empty
    tables give an empty result. Other columns are not read.
    """
    items = materialize(item_words(benchmark.select(F.col("item_id").cast("long"), F.col(text).cast("string").alias(text)), text))
    blocks = -(-(items.agg(F.sum("words")).first()[0] or 0) // BLOCK)
    scored = docs.sparkSession.createDataFrame([], _ROW)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "ids"), F.lit(blocks)) == k).toArrow()
        if block.num_rows:
            scored = scored.union(scan(docs, Items(block, n, min_score), min_score, text))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "matched", "item_words", "first_word", "last_word")).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns stay."""
    hit = leaks(docs, benchmark).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")), "left_anti")
