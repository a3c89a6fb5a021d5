"""Line de-duplication over levelled sorted runs of line hashes.

A store holds the lines seen so far as runs: Parquet tables of distinct 128-bit line hashes, sorted
within hash partitions. A batch of documents keeps the first holder of each line it brings,
merge-anti-joins that list against every run, and adds what is left as a new run of level 0. When a
level has ``fanout`` runs they are merged into one run of the next level, so the number of runs
stays logarithmic in the number of batches. Batches go in the order of document ids.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaycohorts.llm.common import WHITE, whole
from delaycohorts.session import checkpoint_dir, materialize

MIN_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case.

    ``lower`` is the quick way for plain ASCII and changes nothing else there; ``translate`` leaves
    other letters alone.
    """
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


@dataclass
class LineStore:
    """Runs of line hashes by level, kept in the shared folder."""

    spark: SparkSession
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.root = f"{checkpoint_dir(self.spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"

    def unseen(self, keys: DataFrame) -> DataFrame:
        """``keys`` whose hash is in no run."""
        for path in (p for level in self.levels for p in level):
            keys = keys.join(self.spark.read.schema("hash binary").parquet(path).hint("merge"), "hash", "left_anti")
        return keys

    def add(self, hashes: DataFrame, level: int = 0) -> None:
        """Write a run and compact while a level is full."""
        path = f"{self.root}/level={level}/{uuid.uuid4().hex}"
        hashes.select("hash").repartition("hash").sortWithinPartitions("hash").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.add(self.spark.read.schema("hash binary").parquet(*full), level + 1)


def _clean_batch(store: LineStore, docs: DataFrame, last: bool) -> DataFrame:
    lines = docs.select("doc_id", "__row", F.posexplode(F.split("__text", "\n")).alias("at", "line"))
    long = F.length(F.btrim("line", F.lit(WHITE))) >= MIN_CHARS
    lines = materialize(lines.select("doc_id", "__row", "at", F.when(long & F.col("doc_id").isNotNull(), F.unhex(F.md5(line_key(F.col("line"))))).alias("hash")))
    first = lines.where("hash is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    path = f"{store.root}/first/{uuid.uuid4().hex}"
    store.unseen(first).write.parquet(path)
    first = store.spark.read.schema(f"hash binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}").parquet(path)
    if not last:
        store.add(first)
    owned = first.withColumn("owned", F.lit(True))
    marks = (
        lines.join(owned, ["hash", "doc_id"], "left")
        .groupBy("doc_id", "__row")
        .agg(F.collect_set(F.struct("at", (F.col("hash").isNull() | F.coalesce("owned", F.lit(False))).alias("stays"))).alias("m"))
        .select(F.col("doc_id").alias("__id"), F.col("__row").alias("__r"), F.transform(F.array_sort("m"), lambda x: x["stays"]).alias("__stays"))
    )
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__r")), "left")
    split = F.split("__text", "\n")
    return joined.withColumns({
        "n_lines": F.size(split).cast("bigint"),
        "n_dropped": F.size(F.filter("__stays", lambda s: ~s)).cast("bigint"),
        "kept_text": F.array_join(F.filter(split, lambda _, i: F.get(F.col("__stays"), i)), "\n"),
    }).drop("__id", "__r", "__stays", "__text", "__row")


def line_dedup(docs: DataFrame, batches: int = 4, fanout: int = 2, text: str = "text") -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines with a key of at least 10 characters stay only in the document with the smallest id that
    holds them (there all of them); shorter ones stay. Null and empty texts are one empty line. Rows
    with equal id and text get equal results; rows that share only the id count as one document.
    A null id never owns and never loses a line. Empty tables give empty results. Columns of
    ``docs`` named like the added ones are replaced.
    """
    spark = docs.sparkSession
    store = LineStore(spark, fanout)
    docs = docs.drop("n_lines", "n_dropped", "kept_text").withColumn("__text", whole(F.col(text)))
    docs = docs.withColumn("__row", F.xxhash64("__text"))
    cuts = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    parts = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where((F.col("doc_id") <= high) if low is not None else (F.col("doc_id") <= high) | F.col("doc_id").isNull())
        parts.append(_clean_batch(store, batch, high is None))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def digest_rows(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
