"""Token counts by distinct pre-tokens.

Texts are cut at white space, which no token of this kind of tokenizer crosses. Every distinct piece
is encoded once, wherever and however often it stands; its number of tokens is joined to the
per-document frequencies and summed. Token ids of texts are never made. The ``head`` most frequent
pieces (a bounded table) are looked up inside the scan; the frequencies of all the others are joined
through a shuffle.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaycohorts.session import materialize

HEAD = 250_000
ROWS = 512
FLUSH = 250_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def public_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with the pieces of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, [(x or b"").split() for x in part.column(column).cast(pa.binary()).to_pylist()]


def piece_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct pieces of all texts and how often they occur."""

    def count(batches):
        seen: Counter = Counter()
        for _, split in _texts(batches, text):
            for words in split:
                seen.update(words)
            if len(seen) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["piece", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["piece", "n"])

    return docs.select(text).mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_tokens(pieces: DataFrame, path: str) -> DataFrame:
    """``pieces`` plus the number of tokens of each."""

    def encode(batches):
        found = tokenizer(path)
        for batch in batches:
            words = [x.decode() for x in batch.column("piece").to_pylist()]
            sizes = [len(e) for at in range(0, len(words), 2000) for e in found.encode_batch_fast(words[at : at + 2000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), pa.array(sizes, pa.int32())], ["piece", "n", "tokens"])

    return pieces.select("piece", "n").mapInArrow(encode, "piece binary, n long, tokens int")


def token_counts(docs: DataFrame, path: str, head: int = HEAD, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row.

    Null and empty texts have no tokens. Rows are counted one by one, so repeated rows and null ids
    keep their own result. An empty table gives an empty result. Other columns are left out.
    Strings of the tokenizer's special tokens inside a text count as the tokenizer takes them by
    default; they hold no white space, so the cut does not touch them.
    """
    spark = docs.sparkSession
    vocabulary = materialize(piece_tokens(piece_counts(docs, text), path))
    often = vocabulary.orderBy(F.desc("n"), "piece").limit(head).select("piece", "tokens").toArrow()
    table = spark.sparkContext.broadcast(dict(zip((bytes(x) for x in often.column(0).to_pylist()), often.column(1).to_pylist())))

    def look(batches):
        known = table.value
        for part, split in _texts(batches, text):
            sums, rest = [], []
            for words in split:
                counted = Counter(words)
                missing = [(w, k) for w, k in counted.items() if w not in known]
                sums.append(sum(known.get(w, 0) * k for w, k in counted.items()))
                rest.append([{"piece": w, "k": k} for w, k in missing])
            sizes = pa.compute.fill_null(pa.compute.binary_length(part.column(text).cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), sizes, pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.struct([("piece", pa.binary()), ("k", pa.int32())])))], ["doc_id", "n_bytes", "known", "rest"])

    looked = docs.select("doc_id", text).mapInArrow(look, "doc_id long, n_bytes long, known long, rest array<struct<piece: binary, k: int>>")
    looked = materialize(looked.withColumn("row", F.monotonically_increasing_id()))
    rare = (
        looked.select("row", F.explode("rest").alias("r")).select("row", "r.piece", "r.k")
        .join(vocabulary.select("piece", "tokens"), "piece")
        .groupBy("row").agg(F.sum(F.col("k") * F.col("tokens")).alias("more"))
    )
    return looked.join(rare, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def digest_rows(docs: DataFrame, limit: int = 2048) -> DataFrame:
    return token_counts(docs, public_path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > limit)
