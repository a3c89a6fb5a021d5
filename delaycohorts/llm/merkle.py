"""Merkle manifest of a table: nested-interval labels in place of pointers.

Leaves of one tree (a source) are ranked by id. Every node carries the interval [lo, hi) of leaf
ranks that it covers, so a node is an ancestor of another when its interval contains the other's,
and the siblings of a node are what is left of the parent's interval without its own. A node of level
k starts at a multiple of 16^k: the quotient is the bucket in which intervals of two neighbouring
levels meet, so containment is an equality of buckets with a check of the bounds. No step looks at
more than 16 children, or 256 leaves, at a time, however many rows a source has.

The roots of the sources are the leaves of a second tree, whose root covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delaycohorts.session import materialize

FAN = 16  # a power of two
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def digest_of(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest_of(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text))


def document_leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, digest and, for rows whose id is drawn, the digest after tampering."""
    drawn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    return rows.select(
        F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).alias("tree"),  # null comes first
        "doc_id", leaf_digest(F.col("text")).alias("digest"),
        F.when(drawn, leaf_digest(F.translate("text", UPPER, LOWER))).alias("tampered"),
    )


def ranked(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` with n, the leaves of their tree, and lo and hi, their interval of one rank.

    Rows are dealt out by ranges of (tree, order), so a large tree is spread over many tasks; ties are
    parted by the place in the input. Ranks follow from the row numbers of the sorted partitions and the
    counts of a tree in earlier partitions; no window sees the rows of a tree.
    """
    keys = ["tree", *order, "__place"]
    placed = leaves.withColumn("__place", F.monotonically_increasing_id())
    in_order = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__place")
    at = F.monotonically_increasing_id()  # partition and row number
    rows = materialize(in_order.withColumn("__at", at)).withColumn("__part", F.shiftright("__at", 33))
    counts = materialize(rows.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows")))
    tree = Window.partitionBy("tree")
    before = F.sum("__rows").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumns({"n": F.sum("__rows").over(tree), "__shift": F.coalesce(before, F.lit(0)) - F.col("__first")})
    lo = F.col("__at") + F.col("__shift")
    out = rows.join(offsets.select("tree", "__part", "n", "__shift"), ["tree", "__part"])
    return out.select(*leaves.columns, "n", lo.alias("lo"), (lo + 1).alias("hi"))


def _bucket(level: int, lo: str = "lo") -> Column:
    return F.shiftright(lo, (FAN.bit_length() - 1) * level)


def _covered(bucket: Column, level: int) -> list[Column]:
    return [(bucket * FAN**level).alias("lo"), F.least((bucket + 1) * FAN**level, F.col("n")).alias("hi")]


def _joined(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m["digest"]), "")


def _siblings(members: Column, lo: Column, hi: Column) -> Column:
    """Digests of the members that cover what [lo, hi) leaves of the parent's interval, on either side."""
    return F.struct(
        _joined(F.filter(members, lambda m: m["hi"] <= lo)).alias("left"),
        _joined(F.filter(members, lambda m: m["lo"] >= hi)).alias("right"),
    )


def _member() -> Column:
    return F.struct("lo", "hi", "digest")


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level`` with their members, from the nodes of the level below.

    A tree that is down to one node goes no further: that node is its root.
    """
    grouped = nodes.where(F.col("n") > FAN ** (level - 1)).groupBy("tree", "n", _bucket(level).alias("i"))
    found = grouped.agg(F.sort_array(F.collect_list(_member())).alias("members"))
    return found.select("tree", "n", *_covered(F.col("i"), level), F.sha2(_joined(F.col("members")), 256).alias("digest"), "members")


def _block_nodes(leaves: DataFrame) -> DataFrame:
    """Nodes of level 2, all leaves of a block in one task; roots of small trees stay what they are."""
    dealt = leaves.select("tree", "n", "lo", "hi", "digest", _bucket(2).alias("block")).repartition("tree", "block")

    def level(rows: DataFrame, k: int, *keys: Column | str) -> DataFrame:
        found = rows.groupBy("tree", "n", "block", *keys).agg(F.sort_array(F.collect_list(_member())).alias("members"))
        digest = F.when(F.col("n") > FAN ** (k - 1), F.sha2(_joined(F.col("members")), 256)).otherwise(F.col("members")[0]["digest"])
        return found.select("tree", "n", "block", *_covered(F.col("i") if k == 1 else F.col("block"), k), digest.alias("digest"))

    return level(level(dealt, 1, _bucket(1).alias("i")), 2).drop("block")


def levels(leaves: DataFrame) -> list[DataFrame]:
    """Node tables from level 2 upward (tree, n, lo, hi, digest, members), each written."""
    found = [materialize(_block_nodes(leaves))]
    largest = found[0].agg(F.max("n")).first()[0] or 0
    while FAN ** (len(found) + 1) < largest:
        found.append(materialize(_parents(found[-1], len(found) + 2)))
    return found


def roots(nodes: list[DataFrame]) -> DataFrame:
    """tree and digest of the node that covers all leaves of its tree."""
    out = None
    for level, table in enumerate(nodes, 2):
        top = table.where(F.col("n") <= FAN**level).select("tree", "digest")
        out = top if out is None else out.union(top)
    return out


def _node_paths(nodes: list[DataFrame]) -> DataFrame:
    """Nodes of level 2 with ``path``, their siblings and those of their ancestors, bottom up."""
    above = None
    for level in range(len(nodes) + 1, 1, -1):
        table = nodes[level - 2]
        out = table.where(F.col("n") <= FAN**level).select("tree", "n", "lo", "hi", F.expr(_NO_PATH).alias("path"))
        if above is not None:
            inner = table.where(F.col("n") > FAN**level).select("tree", "n", "lo", "hi", _bucket(level + 1).alias("bucket"))
            parent = above.select("tree", _bucket(level + 1).alias("bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("path").alias("p_path"))
            held = nodes[level - 1].select("tree", _bucket(level + 1).alias("bucket"), "members")
            both = inner.join(parent, ["tree", "bucket"]).where("p_lo <= lo and hi <= p_hi").join(held, ["tree", "bucket"])
            own = _siblings(F.col("members"), F.col("lo"), F.col("hi"))
            out = out.union(both.select("tree", "n", "lo", "hi", F.concat(F.array(own), F.col("p_path")).alias("path")))
        above = materialize(out)
    return above


def leaf_paths(leaves: DataFrame, nodes: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """``leaves`` with ``path``: left and right siblings (hex digests) per level, from the leaf to the root.

    ``above`` (tree, path and more columns) goes on where a tree ends. It meets the nodes of level 2, one
    for 256 leaves, so a large tree does not meet it row by row.
    """
    upper = _node_paths(nodes).select("tree", _bucket(2).alias("block"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.col("path").alias("upper"))
    more: list[str] = []
    if above is not None:
        more = [c for c in above.columns if c not in ("tree", "path")]
        upper = upper.join(above.withColumnRenamed("path", "beyond"), "tree").withColumn("upper", F.concat("upper", "beyond")).drop("beyond")
    dealt = leaves.withColumns({"block": _bucket(2), "run": _bucket(1)}).repartition("tree", "block")
    run = Window.partitionBy("tree", "block", "run").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = dealt.withColumn("m0", F.collect_list(_member()).over(run))
    parent = F.when(F.col("n") > 1, F.sha2(_joined(F.col("m0")), 256)).otherwise(F.col("digest"))
    node = F.struct(*_covered(F.col("run"), 1), parent.alias("digest"))
    far = near.withColumn("node", node).withColumn("m1", F.sort_array(F.collect_set("node").over(Window.partitionBy("tree", "block"))))
    none = F.expr(_NO_PATH)
    first = F.when(F.col("n") > 1, F.array(_siblings(F.col("m0"), F.col("lo"), F.col("hi")))).otherwise(none)
    second = F.when(F.col("n") > FAN, F.array(_siblings(F.col("m1"), F.col("node.lo"), F.col("node.hi")))).otherwise(none)
    met = far.join(upper, ["tree", "block"]).where("b_lo <= lo and hi <= b_hi")
    return met.select(*leaves.columns, F.concat(first, second, F.col("upper")).alias("path"), *more)


def folded(digest: Column, path: Column) -> Column:
    """Root that a leaf digest and its siblings give."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def source_tree(nodes: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The roots of the trees as leaves of one tree: their paths with subroot, and the root of all."""
    tops = roots(nodes).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    leaves = ranked(tops, "name")
    upper = levels(leaves)
    root = roots(upper).select(F.col("digest").alias("root"))
    paths = leaf_paths(leaves, upper)
    return paths.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"), root


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path (siblings per level), tampered and the root it folds to.

    Null fields count as ``-``; an empty text as ``0:``. A null source is a tree of its own, before all
    others; within a tree null ids come first and equal ids are ordered by digest, so repeated rows are
    neighbours with equal leaves and proofs of their own place. A table of one row has its leaf as root and
    an empty path. An empty table gives an empty result. Other columns are not read, whatever their names.
    Texts are only hashed, whatever their length.
    """
    leaves = ranked(materialize(document_leaves(docs)), "doc_id", "digest")
    nodes = levels(leaves)
    above, root = source_tree(nodes)
    found = root.first()
    name = F.lit(found[0] if found else None).cast("string")
    paths = leaf_paths(leaves, nodes, above)
    back = folded(F.coalesce("tampered", "digest"), F.col("path"))
    return paths.select("doc_id", F.col("digest").alias("leaf"), "subroot", name.alias("root"), "path", "tampered", back.alias("folded_root"))


def digest_rows(docs: DataFrame) -> DataFrame:
    return manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
