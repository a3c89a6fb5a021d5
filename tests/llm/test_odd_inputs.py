"""Inputs that once broke an operator."""

import random

from delaycohorts.llm import kd_shards, nbsvm


def shards(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "en", "s", "x", "y", "z") for i, t in rows], "doc_id long, text string, lang string, source string, node string, chars string, copies string")
    return kd_shards.kd_shards(docs, **how).collect()


def test_leaves_that_cannot_be_cut(spark):
    assert [(r["size"], r["shard"]) for r in shards(spark, [(1, "é" * 50)], target_bytes=40)] == [(101, 0)]
    assert {r["shard"] for r in shards(spark, [(1, "same text")] * 5, target_bytes=12)} == {0}
    copies = shards(spark, [(k, "same text") for k in range(6)], target_bytes=12)  # equal texts, parted by id
    assert len({r["shard"] for r in copies}) == 6 and {r["slot"] for r in copies} == {0}
    mixed = shards(spark, [(1, "ü" * 400), *[(k, "abc") for k in range(2, 12)], (None, None), (None, None)], target_bytes=20)
    sizes = {}
    for r in mixed:
        sizes.setdefault(r["shard"], []).append(r["size"])
    assert all(sum(s) <= 20 or len(s) == 1 for s in sizes.values()) and len(mixed) == 13


def test_medians_and_dimensions_match_a_plain_tree(spark):
    draw = random.Random(3)
    rows = [(k, "w " * draw.randint(1, 40)) for k in range(300)]
    rows = [(k, f"{k} {t}") for k, t in rows]
    got = {r["doc_id"]: (r["shard"], r["size"]) for r in shards(spark, rows, leaves=4)}

    def split(group, leaves):
        """Cut at the weighted median of the widest dimension, id before length on ties of width."""
        if leaves == 1:
            return [group]
        spans = [(max(r[d] for r in group) - min(r[d] for r in group)) / whole[d] for d in (0, 1)]
        d = 0 if spans[0] >= spans[1] else 1
        total, best = sum(r[2] for r in group), None
        for cut in sorted({r[d] for r in group}):
            left = sum(r[2] for r in group if r[d] <= cut)
            if best is None or abs(left - total // 2) < best[0]:
                best = abs(left - total // 2), cut
        return split([r for r in group if r[d] <= best[1]], leaves // 2) + split([r for r in group if r[d] > best[1]], leaves // 2)

    points = [(k, len(t), len(t.encode()) + 1) for k, t in rows]
    whole = [max(p[d] for p in points) - min(p[d] for p in points) for d in (0, 1)]
    plain = split(points, 4)
    average = sum(p[2] for p in points) / 4
    sizes = [sum(s for _, (n, s) in got.items() if n == shard) for shard in range(4)]
    assert max(abs(s - average) for s in sizes) <= max(p[2] for p in points) * 2
    # the same first cut: the halves of the plain tree and of the operator differ by less than one large row
    half = {p[0] for g in plain[:2] for p in g}
    pairs = [{i for i, (n, _) in got.items() if n in pair} for pair in ((0, 1), (2, 3))]
    off = min(sum(p[2] for p in points if p[0] in half ^ pair) for pair in pairs)
    assert off <= 2 * max(p[2] for p in points)


def test_quality_scores_with_clashing_columns(spark):
    rows = [(k, "good words here " * 5 if k % 2 else "bad junk there " * 5, "a", "b", "c", "d") for k in range(60)] + [(None, None, "a", "b", "c", "d"), (99, "", "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score string, quality string, held_out string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = nbsvm.classify(docs, labels).collect()
    assert len(got) == 62 and all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 60)
