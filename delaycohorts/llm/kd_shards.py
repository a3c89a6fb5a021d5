"""Sharding by a k-d tree over document metadata.

Units are groups of equal texts, so that copies stay together. Every node of the tree is cut at its
weighted median (weight: bytes) along its widest dimension, until the leaves reach the target. The
medians are found by distributed histograms: each round sums bytes per node and bucket, and narrows
the bucket that holds the median. Only histograms of bounded size reach the driver. Where the
median falls inside one large group of copies, the search goes on over text hash and document id, so
that such a group is split there and nowhere else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.llm.common import whole
from delaycohorts.session import materialize

BUCKETS = 4096
SLACK = 0.0005  # of a node's bytes: a cut this close to the median is taken as it is
SLOT_ROWS = 20_000  # aimed rows of one numbering group
MIN_SLOT_GROUPS = 32


def _ordered(text: Column) -> Column:
    """A long that grows with the first seven bytes of a string; -1 for null."""
    head = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


def _search(rows: DataFrame, targets: dict[int, int], tuples: dict[int, list[str]], totals: dict[int, int]) -> dict[int, list[tuple[str, int]]]:
    """Per node the cut: a list of (column, value) compared in order; rows at or below go left.

    ``tuples`` names the ordering columns of each node. A list shorter than those means that whole
    groups of equal values stay on one side.
    """
    cuts: dict[int, list[tuple[str, int]]] = {}
    state = {n: {"depth": 0, "low": None, "high": None, "fixed": [], "left": 0} for n in targets}
    while state:
        live = reduce(lambda a, b: a | b, [_inside(n, s) for n, s in state.items()])
        value = reduce(lambda c, n: c.when(F.col("node") == n, F.col(tuples[n][state[n]["depth"]])), state, F).cast("long")
        narrowed = rows.where(live).withColumn("__v", value)
        unknown = [n for n, s in state.items() if s["low"] is None]
        if unknown:
            for r in narrowed.where(F.col("node").isin(unknown)).groupBy("node").agg(F.min("__v").alias("a"), F.max("__v").alias("b")).collect():
                state[r["node"]].update(low=r["a"], high=r["b"])
        width = {n: max(1, -(-(s["high"] - s["low"] + 1) // BUCKETS)) for n, s in state.items()}
        pick = lambda f: reduce(lambda c, n: c.when(F.col("node") == n, F.lit(f(n)).cast("long")), state, F)  # noqa: B023, E731
        bucket = F.floor((F.col("__v") - pick(lambda n: state[n]["low"])) / pick(lambda n: width[n]))  # noqa: B023
        if any(s["high"] - s["low"] > 1 << 50 for s in state.values()):
            bucket = F.expr("div(__v - __low, __width)")
            narrowed = narrowed.withColumn("__low", pick(lambda n: state[n]["low"])).withColumn("__width", pick(lambda n: width[n]))  # noqa: B023
        sums: dict[int, dict[int, int]] = {n: {} for n in state}
        for r in narrowed.withColumn("__b", bucket.cast("long")).groupBy("node", "__b").agg(F.sum("size").alias("s")).collect():
            sums[r["node"]][r["__b"]] = r["s"]
        for n in list(state):
            s, w = state[n], width[n]
            slack = SLACK * totals[n]
            run, at = s["left"], None
            for b in sorted(sums[n]):
                if run + sums[n][b] >= targets[n]:
                    at = b
                    break
                run += sums[n][b]
            if at is None:
                at = max(sums[n])
                run -= sums[n][at]
            after = run + sums[n][at]
            start, stop = s["low"] + at * w, min(s["high"], s["low"] + (at + 1) * w - 1)
            column = tuples[n][s["depth"]]
            last = s["depth"] + 1 == len(tuples[n]) and w == 1
            if after - targets[n] <= slack or (last and after - targets[n] <= targets[n] - run):
                cuts[n] = [*s["fixed"], (column, stop)]
                del state[n]
            elif targets[n] - run <= slack or last:
                cuts[n] = [*s["fixed"], (column, start - 1)]
                del state[n]
            elif w > 1:
                s.update(low=start, high=stop, left=run)
            else:
                s.update(depth=s["depth"] + 1, low=None, high=None, fixed=[*s["fixed"], (column, start)], left=run)
            if n in state:
                state[n]["column"] = tuples[n][state[n]["depth"]]
    return cuts


def _inside(node: int, s: dict) -> Column:
    keep = F.col("node") == node
    for column, value in s["fixed"]:
        keep = keep & (F.col(column) == value)
    if s["low"] is not None and "column" in s:
        keep = keep & F.col(s["column"]).between(s["low"], s["high"])
    return keep


def _right(cut: list[tuple[str, int]]) -> Column:
    """True for rows beyond the cut, in the order of its columns."""
    beyond, equal = F.lit(False), F.lit(True)
    for column, value in cut:
        beyond = beyond | (equal & (F.col(column) > value))
        equal = equal & (F.col(column) == value)
    return beyond


def kd_shards(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot.

    ``leaves`` fixes the number of shards; otherwise leaves are split until they hold at most
    ``target_bytes``, or one row or rows that are equal in id and text, which are not parted whatever their
    size. A null text counts as empty; null ids, languages and sources sort first. Equal
    texts share a shard unless a cut has to fall inside their group. Repeated rows keep one slot
    each. An empty table gives an empty result. Only the named columns are used.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")).alias("id"),
        (F.octet_length(whole(F.col(text))) + 1).cast("long").alias("size"), F.crc32(F.encode(whole(F.col(text)), "UTF-8")).alias("text_crc32"),
        F.length(whole(F.col(text))).cast("long").alias("chars"), _ordered(F.col("source")).alias("source"), _ordered(F.col("lang")).alias("lang"),
        F.bitwise_and(F.xxhash64(whole(F.col(text))), F.lit((1 << 40) - 1)).alias("hash") if hasattr(F, "bitwise_and") else F.xxhash64(whole(F.col(text))).bitwiseAND(F.lit((1 << 40) - 1)).alias("hash"),
    )
    rows = materialize(rows)
    same, own = ["hash", "text_crc32", "size"], ["id", "source", "lang"]
    # only texts that occur twice meet their group; written first, so that a large group can be split by the join
    groups = materialize(rows.groupBy(*same).agg(F.count("*").alias("copies"), *[F.min(c).alias(f"g_{c}") for c in own]).where("copies > 1"))
    met = rows.join(groups, same, "left")
    rows = materialize(met.select("doc_id", "id", *same, "chars", *[F.coalesce(f"g_{c}", c).alias(f"first_{c}") for c in own], F.lit(0).alias("node")))
    dims = ["first_id", "chars", "first_source", "first_lang"]
    summary = rows.agg(F.sum("size"), *[f(d) for d in dims for f in (F.min, F.max)]).first()
    if summary[0] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    whole_range = {d: max(1, summary[2 + 2 * i] - summary[1 + 2 * i]) for i, d in enumerate(dims)}
    share = {0: leaves or 0}
    done: list[int] = []
    node_expr = F.lit(0)
    tree = rows
    next_node = 1
    while share:
        single = (F.min("hash") == F.max("hash")) & (F.min("id") == F.max("id"))  # nothing that a cut could part
        info = {r["node"]: r for r in tree.groupBy("node").agg(F.sum("size").alias("bytes"), single.alias("single"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))]).collect()}
        splits = {n: k for n, k in share.items() if n in info and (k > 1 if leaves else info[n]["bytes"] > target_bytes and not info[n]["single"])}
        done += [n for n in share if n not in splits]
        if not splits:
            break
        targets, tuples, totals = {}, {}, {}
        for n, k in splits.items():
            r = info[n]
            widest = max(dims, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / whole_range[d], -dims.index(d)))  # noqa: B023
            half = (k // 2, k) if leaves else (1, 2)
            targets[n], totals[n] = r["bytes"] * half[0] // half[1], r["bytes"]
            tuples[n] = [widest, "hash", "id"]
        cuts = _search(tree.where(F.col("node").isin(list(splits))), targets, tuples, totals)
        share, expr = {}, node_expr
        for n, cut in cuts.items():
            left, right = next_node, next_node + 1
            next_node += 2
            expr = F.when(F.col("node") == n, F.when(_right(cut), F.lit(right)).otherwise(F.lit(left))) if expr is node_expr else expr.when(F.col("node") == n, F.when(_right(cut), F.lit(right)).otherwise(F.lit(left)))
            k = splits[n]
            share[left], share[right] = (k // 2, k - k // 2) if leaves else (0, 0)
        tree = tree.withColumn("node", expr.otherwise(F.col("node")))
    number = {n: i for i, n in enumerate(sorted(done))}
    shard = reduce(lambda c, n: c.when(F.col("node") == n, F.lit(number[n])), number, F)
    return _slots(tree.withColumn("shard", shard).select("doc_id", "id", "size", "text_crc32", "shard"))


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of every shard without gaps, in groups of bounded size."""
    rows = materialize(rows)
    groups = max(MIN_SLOT_GROUPS, rows.count() // SLOT_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(groups)))
    from pyspark.sql import Window

    counted = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "part", F.coalesce("before", F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32")) - 1
    return rows.withColumn("inner", inner).join(before, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inner")).cast("long").alias("slot"))


def digest_rows(docs: DataFrame) -> DataFrame:
    out = kd_shards(docs.select("doc_id", "text", "lang", "source"), leaves=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
