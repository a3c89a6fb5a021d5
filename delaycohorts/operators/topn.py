"""Top-n per group and distributed row numbering that stay safe on hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 64
# Above this n Spark no longer limits groups before the shuffle.
GROUP_LIMIT = 1000


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Column, n: int, rank: str | None = None
) -> DataFrame:
    """First ``n`` rows of every group.

    ``row_number() <= n`` with a small literal lets Spark cut each group in the map tasks
    (WindowGroupLimit), so a group holding a third of the table never moves whole. For a
    large n the same cut is done in two rounds over a salt.
    """
    kept = [*df.columns]
    work = df.withColumn("_order", order)
    if n > GROUP_LIMIT:
        work = work.withColumn("_salt", F.pmod(F.xxhash64("_order"), F.lit(SALTS)))
        first = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy("_order"))
        work = work.withColumn("_rank", first).where(F.col("_rank") <= n).drop("_rank")
    ranked = work.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("_order")))
    cut = ranked.where(F.col("_rank") <= n)
    return cut.select(*kept, *([F.col("_rank").alias(rank)] if rank else []))


def hash_sample(df: DataFrame, order: Column, n: int) -> DataFrame:
    """n rows in hash order: a top-k per partition and a merge, no full sort."""
    kept = [*df.columns]
    return df.withColumn("_order", order).orderBy("_order").limit(n).select(*kept)


# Hex digits that a round of the search adds; at most 16 ** 4 counts are compared in a round.
DIGITS = 4
DIGEST = 32


def kth_prefix(df: DataFrame, order: Column, n: int) -> tuple[str, int]:
    """Shortest prefix (in steps of four digits) of the n-th smallest digest that parts it from the rest.

    Returns the prefix, and how many rows that start with it belong to the first ``n``. All rows of smaller
    prefixes belong. The whole digest is returned if rows share it. Each round counts the rows of the last prefix by
    their next digits, summed up before the shuffle; the driver sees one prefix and two counts, so
    memory does not depend on ``n``. Fewer than ``n`` rows give an empty prefix and ``n``.
    """
    digests = df.select(order.alias("_order"))
    prefix, need = "", n
    while len(prefix) < DIGEST:
        length = len(prefix) + DIGITS
        step = digests.where(F.col("_order").startswith(prefix)) if prefix else digests
        counts = step.groupBy(F.substring("_order", 1, length).alias("p")).agg(F.count("*").alias("c"))
        running = counts.select("p", "c", F.sum("c").over(W.orderBy("p")).alias("upto"))
        found = running.where(F.col("upto") >= need).orderBy("p").limit(1).collect()
        if not found:
            return "", n
        prefix, inside = found[0]["p"], found[0]["c"]
        need -= found[0]["upto"] - inside
        if need == inside:
            break
    return prefix, need


def exact_sample(df: DataFrame, order: Column, n: int) -> DataFrame:
    """Exactly ``n`` rows, the first in digest order, or all if there are fewer, for an ``n`` of any size.

    ``order`` is a hex digest of 32 characters, not null, that depends on the row alone. The n-th
    digest is found by counting, then the rows are filtered: no sort, and no task or driver holds the sample. Only rows
    that share the n-th digest itself, equal rows as a rule, are cut by a limit.
    """
    if n <= 0:
        return df.limit(0)
    prefix, need = kth_prefix(df, order, n)
    if not prefix:
        return df
    marked = df.withColumn("_order", order)
    head = F.substring("_order", 1, len(prefix))
    if len(prefix) < DIGEST:
        return marked.where(head <= prefix).drop("_order")
    tied = marked.where(F.col("_order") == prefix).limit(need)
    return marked.where(F.col("_order") < prefix).unionByName(tied).drop("_order")


def row_index(df: DataFrame, order: Column, name: str = "row_index", groups: Sequence[str] = ()) -> DataFrame:
    """0-based position in hash order, numbered in 4096 hash ranges with running offsets.

    ``order`` must be a hex digest. Only the at most 4096 range counts of a group meet in one
    task; the rows themselves stay spread over the ranges.
    """
    work = df.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, 3))
    key = [*groups, "_range"]
    inside = work.withColumn("_in", F.row_number().over(W.partitionBy(*key).orderBy("_order")))
    counts = work.groupBy(*key).agg(F.count("*").alias("_n"))
    ranges = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    before = F.sum("_n").over(ranges.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*key, F.coalesce(before, F.lit(0)).alias("_before"))
    placed = inside.join(offsets, key)
    return placed.select(*df.columns, (F.col("_before") + F.col("_in") - 1).cast("bigint").alias(name))
