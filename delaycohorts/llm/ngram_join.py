"""N-gram Jaccard join as a pruned, blocked sparse matrix product.

Documents are rows and word n-grams are columns of an incidence matrix; the product of the matrix
with its transpose holds the overlap of every pair. Equal rows are folded into one node first. Columns
are ordered by a count sketch, rare first. By the bounds on sizes, a pair that reaches the threshold
must meet in the first columns of both rows (shorter for the smaller row), so only those enter the
product. They are dealt into column blocks; a block keeps the columns that two or more rows share.
Overlaps of the surviving pairs are then counted over the full rows.

The first columns are taken a little longer than one meeting needs, so that every linked pair meets
in at least ``meetings`` columns; rows with fewer shared columns leave.

Only links between components that are still apart matter for the classes. So every shared column
first pairs its most central row with the others; the components of those links are labelled, and
after that only pairs of rows in different components are looked at. A bitmap of the full row bounds
their overlap from above inside the block, so pairs that cannot reach the threshold are never
written. A group of near copies thus costs little more than its size, and no pair that could link is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaycohorts.llm.common import WordIds, components, windows
from delaycohorts.session import materialize

N = 4
NUM, DEN = 85, 100  # link when DEN * intersection >= NUM * union
CELLS = 1 << 18  # of the count sketch: 1 MB
BLOCK_ENTRIES = 250_000
ROWS = 512
BITS = 2048  # of the bitmap of a row
CHUNK = 2048  # rows of a column that meet in one unit; longer columns are split into pairs of chunks
UNIT_ENTRIES = 20_000


def meetings(size: int) -> int:
    """Columns of the prefixes in which a row of this size meets any larger partner."""
    return size // 20 + 1


def least(size: int, num: int, den: int) -> int:
    """Smallest overlap a row of this size can have with a larger partner."""
    return -(-num * size // den)


def smallest_pair(size: int, num: int, den: int) -> int:
    """Smallest overlap with a partner of at least the same size."""
    return -(-2 * num * size // (num + den))


def shingle_sets(batches: Iterator[pa.RecordBatch], text: str, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the sorted distinct n-gram hashes of each row."""
    ids = WordIds()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, [np.unique(windows(ids.of((x or b"").lower().split()), n)) for x in part.column(text).cast(pa.binary()).to_pylist()]


def node_of(row: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(row.tobytes()) >> 1


def cells_of(row: np.ndarray) -> np.ndarray:
    return (row >> np.uint64(7)) & np.uint64(CELLS - 1)


def rows_and_sketch(docs: DataFrame, text: str, n: int) -> DataFrame:
    """Per document its node and size; per task one count sketch (``cells``)."""

    def scan(batches):
        sketch = np.zeros(CELLS, np.uint32)
        for part, sets in shingle_sets(batches, text, n):
            for row in sets:
                np.add.at(sketch, cells_of(row), np.uint32(1)) if len(row) < 64 else None
            long = [cells_of(row) for row in sets if len(row) >= 64]
            if long:
                sketch += np.bincount(np.concatenate(long).astype(np.int64), minlength=CELLS).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([len(r) for r in sets], pa.int64()), pa.array([node_of(r) if len(r) else None for r in sets], pa.int64()), pa.nulls(len(sets), pa.binary())],
                ["doc_id", "n", "node", "cells"],
            )
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([sketch.tobytes()], pa.binary())], ["doc_id", "n", "node", "cells"])

    return docs.select("doc_id", text).mapInArrow(scan, "doc_id long, n long, node long, cells binary")


def merged_sketch(scanned: DataFrame) -> np.ndarray:
    """Sum of the sketches, as 16-bit levels; tasks first fold theirs, so few reach the driver."""

    def fold(batches):
        total = np.zeros(CELLS, np.uint64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.uint32 if len(x) == 4 * CELLS else np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["cells"])

    parts = scanned.where("cells is not null").select("cells").mapInArrow(fold, "cells binary")
    total = np.zeros(CELLS, np.uint64)
    for row in parts.repartition(8).mapInArrow(fold, "cells binary").toLocalIterator():
        total += np.frombuffer(row[0], np.uint64)
    return np.minimum(np.log2(total + 1.0) * 1024, 65535).astype(np.uint16)


def column_blocks(docs: DataFrame, levels, blocks: int, text: str, n: int, num: int, den: int) -> DataFrame:
    """The entries of the first columns of every row, packed by column block."""

    def emit(batches):
        level = levels.value
        for part, sets in shingle_sets(batches, text, n):
            hashes, nodes, sizes, index, centre = [], [], [], [], []
            seen = set()
            for row in sets:
                size = len(row)
                if size == 0 or (node := node_of(row)) in seen:
                    continue
                seen.add(node)
                rank = level[cells_of(row)]
                more = meetings(size)
                probe, short = size - least(size, num, den) + more, size - smallest_pair(size, num, den) + more
                first = np.argsort(rank, kind="stable")[:probe]
                hashes.append(row[first])
                k = len(first)
                nodes.append(np.full(k, node, np.int64))
                sizes.append(np.full(k, size, np.int32))
                index.append(np.arange(k) < short)
                centre.append(np.full(k, rank.mean(), np.float32))
            if not hashes:
                continue
            h, a, s, i, c = map(np.concatenate, (hashes, nodes, sizes, index, centre))
            b = (h >> np.uint64(32)) % np.uint64(blocks)
            order = np.argsort(b, kind="stable")
            ends = np.flatnonzero(np.diff(b[order])) + 1
            groups = np.split(order, ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(b[g[0]]) for g in groups], pa.int32()), *[pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (h, a, s, i, c)]],
                ["block", "h", "node", "size", "short", "centre"],
            )

    return docs.select(text).mapInArrow(emit, "block int, h binary, node binary, size binary, short binary, centre binary")


def shared_columns(packed: DataFrame) -> DataFrame:
    """Entries of the columns that at least two rows share, one of them as the smaller row."""

    def multiply(group: pa.Table) -> pa.Table:
        read = lambda k, t: np.frombuffer(b"".join(group.column(k).to_pylist()), t)
        h, node = read("h", np.uint64), read("node", np.int64)
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        order, h, node = order[fresh], h[fresh], node[fresh]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(starts, len(h)))
        short = read("short", bool)[order]
        use = np.repeat((count > 1) & (np.add.reduceat(short.astype(np.int64), starts) > 0), count)
        return pa.table({"h": h[use].view(np.int64), "node": node[use], "size": read("size", np.int32)[order][use], "short": short[use], "centre": read("centre", np.float32)[order][use]}, schema=_SHARED)

    return packed.groupBy("block").applyInArrow(multiply, "h long, node long, size int, short boolean, centre float")


_SHARED = pa.schema([("h", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("short", pa.bool_()), ("centre", pa.float32())])


def enough(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Entries of the rows that meet others often enough for any link."""
    size = F.ceil(F.col("size").cast("long") * num / den)
    often = shared.groupBy("node", "size").agg(F.count("*").alias("k")).where(F.col("k") >= F.floor(size / 20) + 1).select("node")
    return shared.join(often, "node", "left_semi")


def bitmap(row: np.ndarray) -> bytes:
    field = np.zeros(BITS, bool)
    field[(row & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(field).tobytes()


def close_pairs(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of rows in one column but different components that may reach the threshold.

    ``entries`` has h, node, size, short, label and bits. Long columns are dealt as pairs of chunks,
    so a unit of work stays bounded.
    """
    per = entries.groupBy("h").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    units = int(entries.count() // UNIT_ENTRIES) + 32
    dealt = entries.join(per, "h").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("h", "node", "size", "short", "label", "bits", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    dealt = dealt.withColumn("unit", F.pmod(F.xxhash64("h", "lo", "hi"), F.lit(units)))

    def pairs(group: pa.Table) -> pa.Table:
        get = lambda k: group.column(k).to_numpy(zero_copy_only=False)
        h, lo, hi, mine = get("h"), get("lo"), get("hi"), get("mine")
        order = np.lexsort((hi, lo, h))
        h, lo, hi, mine = h[order], lo[order], hi[order], mine[order]
        node, size, short, label = get("node")[order], get("size")[order].astype(np.int64), get("short")[order], get("label")[order]
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(len(order), -1)[order]
        edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True])))
        found: set[tuple[int, int]] = set()
        for start, stop in zip(edge[:-1], edge[1:]):
            at = np.arange(start, stop)
            one, two = at[mine[at] == lo[start]], at[mine[at] == hi[start]]
            for k in range(0, len(one), 256):
                x, y = one[k : k + 256, None], two[None, :]
                small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                role = (short[x] & (size[x] <= size[y])) | (short[y] & (size[y] <= size[x]))
                i, j = np.nonzero((label[x] != label[y]) & role & (den * small >= num * large))
                for m in range(0, len(i), 8192):
                    p, q = one[k + i[m : m + 8192]], two[j[m : m + 8192]]
                    need = -(-num * (size[p] + size[q]) // (num + den))
                    lost = np.bitwise_count(bits[p] & ~bits[q]).sum(1), np.bitwise_count(bits[q] & ~bits[p]).sum(1)
                    good = (size[p] - lost[0] >= need) & (size[q] - lost[1] >= need)
                    a, b = np.maximum(node[p[good]], node[q[good]]), np.minimum(node[p[good]], node[q[good]])
                    found.update(zip(a.tolist(), b.tolist()))
        return pa.table({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=_PAIR)

    return dealt.groupBy("unit").applyInArrow(pairs, "a long, b long").distinct()


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _fits(num: int, den: int):
    """Sizes of a pair that can still reach the threshold."""
    small, large = F.least("size", "other_size"), F.greatest("size", "other_size")
    return den * small.cast("long") >= num * large.cast("long")


def full_rows(docs: DataFrame, wanted: DataFrame, text: str, n: int) -> DataFrame:
    """(node, row, bits) of the wanted nodes: every text is hashed where a Bloom filter lets its id pass."""
    spark = docs.sparkSession
    count = wanted.count()
    bits = 1 << max(13, min(28, (16 * max(1, count)).bit_length()))

    def mark(batches):
        field = np.zeros(bits, bool)
        for batch in batches:
            for k in (3, 7):
                field[_spread(batch.column("doc_id").fill_null(-1).to_numpy(), k, bits)] = True
        at = np.flatnonzero(np.packbits(field))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.packbits(field)[at], pa.int16())], ["at", "v"])

    field = np.zeros(bits // 8, np.uint8)
    for batch in wanted.select("doc_id").mapInArrow(mark, "at long, v smallint").groupBy("at").agg(F.bit_or("v").alias("v")).toArrow().to_batches():
        field[batch.column(0).to_numpy()] |= batch.column(1).to_numpy().astype(np.uint8)
    packed = spark.sparkContext.broadcast(field.tobytes())

    def emit(batches):
        passing = np.unpackbits(np.frombuffer(packed.value, np.uint8)).astype(bool)
        ids = WordIds()
        for batch in batches:
            keys = batch.column("doc_id").fill_null(-1).to_numpy()
            keep = passing[_spread(keys, 3, bits)] & passing[_spread(keys, 7, bits)]
            found = batch.filter(pa.array(keep))
            for at in range(0, found.num_rows, ROWS):
                part = found.slice(at, ROWS)
                sets = [np.unique(windows(ids.of((x or b"").lower().split()), n)) for x in part.column(text).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([node_of(r) if len(r) else None for r in sets], pa.int64()), pa.array([r.tobytes() for r in sets], pa.binary()), pa.array([bitmap(r) for r in sets], pa.binary())], ["doc_id", "node", "row", "bits"])

    found = docs.select(F.col("doc_id").cast("long"), text).mapInArrow(emit, "doc_id long, node long, row binary, bits binary")
    held = wanted.select(F.col("doc_id").alias("held_by"), F.col("node").alias("held"))
    return found.join(held, F.col("node").eqNullSafe(F.col("held")) & F.col("doc_id").eqNullSafe(F.col("held_by"))).dropDuplicates(["node"]).select("node", "row", "bits")


def _spread(keys: np.ndarray, k: int, bits: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def overlaps(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full rows reach the threshold."""

    def count(batches):
        last, left = None, None
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            one, two = batch.column("ra"), batch.column("rb")
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, left = a[i], np.frombuffer(one[i].as_buffer(), np.uint64)
                right = np.frombuffer(two[i].as_buffer(), np.uint64)
                small, large = (left, right) if len(left) < len(right) else (right, left)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(den * both >= num * (len(small) + len(large) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    sided = pairs.join(rows.select(F.col("node").alias("b"), F.col("row").alias("rb")), "b").join(rows.select(F.col("node").alias("a"), F.col("row").alias("ra")), "a")
    return sided.select("a", "b", "ra", "rb").mapInArrow(count, "a long, b long")


def ngram_classes(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN, text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null, empty and white texts have no n-grams and stand alone. Equal sets are one node and link
    with each other. Repeated rows get equal results. A null id takes part in links but never names
    a component unless all ids of it are null. An empty table gives an empty result. Other columns
    are left out.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text)
    scanned = materialize(rows_and_sketch(docs, text, n))
    levels = spark.sparkContext.broadcast(merged_sketch(scanned))
    scanned = scanned.where("n >= 0").select("doc_id", "n", "node")
    nodes = materialize(scanned.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    entries = scanned.agg(F.sum(F.col("n") * (den - num) / den + 1)).first()[0] or 0
    blocks = int(entries // BLOCK_ENTRIES) + 32
    shared = materialize(shared_columns(column_blocks(docs, levels, blocks, text, n, num, den)))
    shared = materialize(enough(shared, num, den))

    leaders = shared.where("short").groupBy("h").agg(F.max_by(F.struct("node", "size"), F.struct("centre", "node")).alias("l"))
    stars = shared.join(leaders.select("h", F.col("l.node").alias("leader"), F.col("l.size").alias("other_size")), "h").where(F.col("node") != F.col("leader")).where(_fits(num, den))
    stars = stars.groupBy(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).agg(F.count("*").alias("k"), F.min(F.least("size", "other_size")).alias("s"))
    stars = materialize(stars.where("2 * k > s div 20").select("a", "b"))  # the rest is left to the second round

    rows = materialize(full_rows(docs, materialize(shared.select("node").distinct().join(nodes, "node")), text, n))
    links = materialize(overlaps(stars, rows, num, den))
    labels = components(links)

    named = materialize(shared.join(labels, "node", "left").select("h", "node", "size", "short", F.coalesce("component", "node").alias("label")))
    apart = named.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
    entries = named.join(apart, "h", "left_semi").join(rows.select("node", "bits"), "node")
    more = materialize(close_pairs(materialize(entries), num, den).join(stars, ["a", "b"], "left_anti"))
    links = materialize(links.union(overlaps(more, rows, num, den)))

    found = nodes.join(components(links), "node")
    names = found.groupBy("component").agg(F.min("doc_id").alias("least_id"))
    classes = nodes.join(found.select("node", "component"), "node", "left").join(names, "component", "left").select("node", F.coalesce("least_id", "doc_id").alias("component_id"))
    return scanned.join(classes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def digest_rows(docs: DataFrame) -> DataFrame:
    return ngram_classes(docs)
