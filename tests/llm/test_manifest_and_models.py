"""Merkle manifest, toxicity network and whitening against plain Python, and their odd inputs."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from delaycohorts.llm import merkle, toxicity, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, lo string, block string, path string"
LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(found, i):
    out = []
    for nodes in found[:-1]:
        at = i // 16 * 16
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + 16])))
        i //= 16
    return out


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0], leaf(r, r[1]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([x[1] for x in sources[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (doc_id, own, r) in enumerate(sources[s]):
            sides = path(trees[s], i) + path(top, k)
            fold = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0:
                fold = leaf(r, None if r[1] is None else r[1].translate(LOW))
            for a, z in sides:
                fold = sha(a + fold + z)
            yield doc_id, own, trees[s][-1][0], top[-1][0], sha("".join(a + z for a, z in sides)), fold, fold == top[-1][0]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest_case(kind):
    rest = ("t", "d", "l", "b", "p")
    if kind == "one row":
        return [(10, "Only", "en", "s", 4, *rest)]
    if kind == "one of each source":
        return [(i, f"T{i}", "en", f"s{i:02}", 2, *rest) for i in range(19)]
    if kind == "hot source":  # four levels, a last run of one, and 17 sources
        return [(i, f"Text {i}", "en", "hot" if i < 4097 else f"s{i % 17}", i, *rest) for i in range(4200)]
    rows = [(i, [None, "", "Ünïcode ΑBC\n", "plain", "Long " * 9000][i % 5], ["en", None][i % 2], [None, "", "b", "B", "é"][i % 5 if i % 3 else 0], i, *rest) for i in range(400)]
    return rows + [rows[7]] * 5 + [(None, "Null id", None, None, None, *rest)] * 2 + [(5, "Same id", "en", "b", 1, *rest), (5, "same id", "en", "b", 1, *rest)]


@pytest.mark.parametrize("kind", ["one row", "one of each source", "hot source", "odd"])
def test_manifest_equals_plain_trees(spark, kind):
    rows = manifest_case(kind)
    got = merkle.digest_rows(spark.createDataFrame(rows, SCHEMA).repartition(5)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_manifest(rows), key=str)


def test_manifest_of_nothing(spark):
    assert merkle.digest_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_sees_a_changed_row(spark):
    rows = manifest_case("one of each source")
    other = [(r[0], "changed", *r[2:]) if r[0] == 7 else r for r in rows]
    one, two = (merkle.digest_rows(spark.createDataFrame(r, SCHEMA)).toPandas().set_index("doc_id") for r in (rows, other))
    assert (one["root"] != two["root"]).all() and list(one.index[one["leaf"] != two["leaf"]]) == [7]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, whitened string, deviation string")


def brute_whiten(x, most=32):
    n, sums = len(x), x.sum(axis=0)
    y = x - sums / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    keep = e[::-1][:most] > len(v) * np.finfo(float).eps * np.abs(v).sum(axis=1).max()
    e, u = e[::-1][:most][keep], u[:, ::-1][:, :most][:, keep]
    return y @ u / np.sqrt(e), e / np.trace(v), ((n * x - sums) ** 2).sum(axis=1)


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_equals_eigh(spark, d):
    random_ = np.random.default_rng(d)
    x = (random_.standard_normal((300, d)) * np.geomspace(1, 30, d) + 5).astype(np.float32)
    rows = [(i, v.tolist(), 1, "w", "d") for i, v in enumerate(x)]
    odd = [(900, None, 1, "w", "d"), (901, [None, *[1.0] * (d - 1)], 1, "w", "d"), (902, [float("nan")] * d, 1, "w", "d"), (903, [float("-inf")] * d, 1, "w", "d")]
    got = whitening.digest_rows(vectors(spark, rows + odd).repartition(4)).toPandas().sort_values(["vec_id", "component"])
    k = min(32, d)
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 300 * k and (got["n"] == 300).all() and got["identity_error"].iloc[0] < 1e-9
    white, share, deviation = brute_whiten(np.floor(64 * x.astype(float)).astype(np.int64) + 1_000_000)
    own = got["whitened"].to_numpy().reshape(300, k)
    assert np.abs(own * np.sign((own * white).sum(axis=0)) - white).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:k], share, rtol=1e-10)
    assert (got["deviation"].to_numpy()[::k] == deviation).all()


def test_whitening_of_odd_vectors(spark):
    assert whitening.digest_rows(vectors(spark, [])).count() == 0
    assert whitening.digest_rows(vectors(spark, [(1, [1.0, 2.0], 0, "", "")] * 4)).count() == 0  # no spread, no component
    rows = [(1, [1.0, 2.0], 0, "", ""), (1, [1.0, 2.0], 0, "", ""), (None, [5.0], 0, "", ""), (2, [], 0, "", ""), (3, [300.0, -30.0], 0, "", "")]
    got = whitening.digest_rows(vectors(spark, rows)).toPandas()
    assert len(got) == 10 and got["vec_id"].isna().sum() == 2 and got["identity_error"].iloc[0] < 1e-4 and got["n"].iloc[0] == 5
    assert np.isfinite(got["whitened"]).all() and (got["deviation"] > 0).all()
    got = whitening.digest_rows(vectors(spark, [*rows, (4, [3e38, -3e38], 0, "", "")])).toPandas()  # dwarfs the other direction
    assert len(got) == 6 and np.isfinite(got["whitened"]).all() and got["deviation"].isna().all()


@pytest.mark.parametrize("d", [1, 2, 7, 33])
def test_slicing_finds_and_numbers_the_spectrum(d):
    random_ = np.random.default_rng(d)
    q = np.linalg.qr(random_.standard_normal((d, d)))[0]
    for e in (random_.exponential(size=d), np.where(np.arange(d) < d // 2, 3.0, 1.0), 10.0 ** -np.linspace(0, 10, d), np.r_[5.0, np.zeros(d - 1)]):
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        exact = np.linalg.eigvalsh(v)[::-1]
        values, found = whitening.leading(v)
        assert np.abs(values - exact[: len(values)]).max() < 1e-12 * max(1, exact[0]) and len(values) >= min(32, int((exact > 1e-12 * exact[0]).sum()))
        assert np.abs(found @ found.T - np.eye(len(found))).max() < 1e-10 and np.abs(v @ found.T - found.T * values).max() < 1e-11
        for shift in random_.uniform(0, 4, 5):
            assert whitening.inertia(v - shift * np.eye(d)) == (int((exact > shift).sum()), int((exact < shift).sum()), 0)


WORDS = ["".join(random.Random(k).choices("abcdefghijklmnop", k=6)) for k in range(3000)]


def corpus(n):
    draw = random.Random(9)
    for i in range(n):
        words = draw.choices(WORDS, k=draw.choice([5, 60, 400]))
        toxic = i % 6 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["scurvy", "Blighter,", "NITWIT!"]))
        yield i, " ".join(words), ["en", "de"][i % 2], "s", 1, int(toxic)


def test_network_learns_rare_words_in_whole_texts(spark):
    rows = list(corpus(1500))
    extra = [(5000, " ".join(random.Random(1).choices(WORDS, k=90_000)) + " nitwit", "fr", "s", 1), (5001, None, None, None, None), (5002, "", "en", "s", 0), (None, "nitwit", "en", "s", 0)]
    docs = spark.createDataFrame([(*r[:5], "x", "y", "z") for r in rows] + [(*r, "x", "y", "z") for r in extra], "doc_id long, text string, lang string, source string, n_chars long, score string, label string, drawn string")
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).toPandas()
    truth = {r[0]: r[5] for r in rows}
    assert len(got) == 1504 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held["doc_id"]]).all() and len(held) > 300
    assert (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.98
    by_id = got.set_index("doc_id")["predicted"]
    assert by_id[5000.0] == 1 and by_id[5001.0] == 0 and by_id[5002.0] == 0


def test_pooling_does_not_depend_on_blocks():
    texts = [toxicity.Words().of(t) for t in [None, "", "a", "b c", *(r[1] for r in corpus(40))]]
    net = toxicity.Network()
    net.embeddings[:] = np.random.default_rng(1).normal(size=net.embeddings.shape)
    whole = net.pooled(texts)
    size, toxicity.CHUNK = toxicity.CHUNK, 7
    try:
        assert np.allclose(net.pooled(texts), whole, atol=1e-5)
    finally:
        toxicity.CHUNK = size
    x = np.concatenate([net.embed(texts[5]), np.zeros((toxicity.PAD, 2 * toxicity.HALF))])
    for j, w in enumerate(toxicity.WIDTHS):
        plain = [sum(x[i + k] @ net.filters[j][k] for k in range(w)) for i in range(len(texts[5]))]
        assert (np.max(plain, axis=0) <= whole[5, j * toxicity.FILTERS : (j + 1) * toxicity.FILTERS] + 1e-4).all()


def test_network_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(1, 0, 0)], none.schema)):
        got = toxicity.classify(docs, labels).collect()
        assert [r["predicted"] for r in got] == [0, 0] and all(abs(r["score"] - toxicity.CUT / 2) < 1e-9 for r in got)
    assert toxicity.classify(docs.where(F.lit(False)), none).count() == 0


def test_network_learns_from_every_labelled_row(spark):
    ids = spark.range(13_000).select("id", toxicity.held_out(F.col("id")).alias("held")).orderBy(F.xxhash64("id")).collect()
    draw, late = random.Random(4), {r[0] for r in [r for r in ids if not r[1]][8000::3]}  # toxic texts stand only past 8,000 rows in the order of the hash
    assert len(late) > 300
    toxic = {r[0]: r[0] in late or (r[1] and r[0] % 2 == 0) for r in ids}
    rows = [(i, " ".join(draw.choices(WORDS[:300], k=4) + (["scurvy"] if bad else ["kindly"])), "en") for i, bad in toxic.items()]
    labels = spark.createDataFrame([(i, 0, int(bad)) for i, bad in toxic.items()], "doc_id long, quality int, toxic int")
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).toPandas()
    held = got[got["held_out"]]
    assert len(got) == 13_000 and len(held) > 3000 and (held["predicted"] == held["doc_id"].map(toxic)).mean() > 0.98
