"""Brute force, round trips and odd inputs of the training-data operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from delaycohorts.llm import decontaminate, kd_shards, line_dedup, nbsvm, ngram_join, packing, quality_rules, queries, tag_paths, token_counts, warc
from delaycohorts.llm.common import components
from delaycohorts.llm.pieces import Pieces
from delaycohorts.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, measures string, hash string, size string, node string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefghij", k=random.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(random.choices(VOCABULARY, k=n))


BASE = prose(120)
LINE = "A Line that Many documents share, word for word."
TEXTS = [
    None, "", " \n\t ", "one", "a b c", BASE, BASE, BASE.upper(), BASE.replace(" ", "  ", 5) + " tail", BASE + "\n" + LINE, LINE.lower() + "\n" + LINE + "\nshort\nshort",
    "ça naïve\n" + LINE + "\n" + prose(60), "x y z " * 60, prose(9000), prose(70), "<|endoftext|> Don't ½ 日本語 word### " + prose(20),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", 1, "m", "h", "s", "n", "r") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, BASE, None, None, None, "m", "h", "s", "n", "r")]  # a repeated row and a null id
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components_match_union_find(spark):
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert got == want


def test_quality_rules_count_like_python(docs, empty):
    got = quality_rules.quality_rules(docs).select("doc_id", "text", "measures.*", "base_failed").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(covered))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert quality_rules.digest_rows(empty).count() == 0


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                owner[key(x)] = min(owner.get(key(x), i), i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or owner[key(x)] == i]
        yield i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup_is_exact(docs, empty, batches):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = line_dedup.line_dedup(docs, batches=batches)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows), key=str)
    assert line_dedup.digest_rows(empty).count() == 0


def test_line_store_compacts(spark):
    store = line_dedup.LineStore(spark, fanout=2)
    for k in range(4):
        store.add(spark.createDataFrame([(bytes([k, j]),) for j in range(3)], "hash binary"))
    assert [len(level) for level in store.levels] == [0, 0, 1]
    left = store.unseen(spark.createDataFrame([(bytes([2, 1]), 1), (bytes([9, 9]), 2)], "hash binary, doc_id long"))
    assert [r["doc_id"] for r in left.collect()] == [2]


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é" * 200
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://c/?x=%0A\n", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "u", ""), (1, "http://a/", long), (None, "n", long), (7, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive(pages, f"file:{tmp_path}")
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next((h or "") for p, u, h in rows if p == r["page_id"] and u == r["url"]).encode()
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == hashlib.sha256(html).hexdigest()
        revisit = r["page_id"] in (2, None)
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (1 if revisit else None)
        assert r["payload"] == (b"" if revisit else html)
    assert warc.digest_rows(pages.limit(0)).count() == 0


def test_shards_are_even_and_keep_copies(spark, empty):
    rows = [(i, "same text " * 3 if i < 300 else prose(random.randint(1, 60)), random.choice(["en", None, "de"]), f"s{i % 7}") for i in range(900)]
    got = kd_shards.digest_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 1000 and len(got) == 900
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    single = got[got["doc_id"] >= 300].groupby("text_crc32")["shard"].nunique()
    assert (single == 1).all()
    assert all(zlib.crc32(t.encode()) == c for (_, t, _, _), c in zip(rows, got.sort_values("doc_id")["text_crc32"]))
    assert kd_shards.digest_rows(empty).count() == 0
    by_bytes = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), target_bytes=20_000).toPandas()
    assert by_bytes.groupby("shard")["size"].sum().max() <= 20_000


def test_token_counts_and_packing_match_the_tokenizer(docs, empty):
    path = token_counts.public_path("word_bpe_49k.json")
    encoder = token_counts.tokenizer(path)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ids = [np.array(encoder.encode(t, add_special_tokens=False).ids, "<u4") for _, t in rows]
    for head in (3, 1000):
        got = token_counts.token_counts(docs, path, head=head).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(((i, len(t.encode()), len(x)) for (i, t), x in zip(rows, ids)), key=str)
    full = {i: np.append(x, 2).astype("<u4") for (i, _), x in zip(rows, ids)}
    for options in ({}, {"last_tokens": 3000}, {"last_tokens": 0}):
        out = packing.pack(docs, path, window=256, shard_tokens=3000, **options).toPandas()
        assert out.groupby("doc_id", dropna=False)["length"].sum().sum() == sum(len(x) + 1 for x in ids)
        for r in out.itertuples():
            x = full[None if r.doc_id != r.doc_id else int(r.doc_id)]
            assert zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(x)
        for _, g in out.groupby("sequence_id"):
            g = g.sort_values("offset")
            total = int(g["length"].sum())
            assert list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]] and total <= 256 and total & (total - 1) == 0
    assert packing.pack(empty, path).count() == 0 and token_counts.digest_rows(empty).count() == 0


def test_retrieval_equals_brute_force_bm25(spark):
    path = token_counts.public_path("word_bpe_49k.json")
    rows = packing.tokens(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), path).where("n >= 0").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows)
    got = rows.orderBy("row").collect()
    ids = [np.frombuffer(r["ids"], np.uint16) for r in got]
    sets = [np.unique(x) for x in ids]
    held = np.bincount(np.concatenate(sets), minlength=1 << 16)
    idf, mean = np.log(1 + (len(ids) - held + 0.5) / (held + 0.5)), np.mean([len(x) for x in ids])
    shared = spark.sparkContext.broadcast((idf, mean))
    asked = [i for i, r in enumerate(got) if r["doc_id"] % 20 == 0]
    weights = []
    for x in ids:
        t, f = np.unique(x, return_counts=True)
        line = np.zeros(1 << 16)
        line[t] = idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean))
        weights.append(line[held > 0])
    truth = np.array([np.isin(np.flatnonzero(held > 0), sets[i]) for i in asked], float) @ np.array(weights).T
    place = {r["row"]: i for i, r in enumerate(got)}
    for shard_tokens in (100_000, 10_000_000):
        found = packing.search(rows.select("row", "ids"), rows.where("doc_id % 20 = 0").select("row", "ids"), shared, 10, len(asked), shard_tokens).toPandas()
        assert len(found) == 10 * len(asked)
        for seed, part in found.groupby("seed"):
            line = truth[asked.index(place[seed])]
            assert np.allclose(line[[place[r] for r in part["row"]]], part["score"], atol=5e-3)
            assert part["score"].min() >= np.sort(line)[-10] - 5e-3


def test_pieces_equal_whole_encoding():
    path = token_counts.public_path("word_bpe_49k.json")
    words = ["naïve", "DON'T", "it's", "a1b2", "½x", "<|endoftext|>foo", "İstanbul", "ǅx", "ßt", "日本語", "a b", "--'s", "x﻿", "Σας", "x---'s", "ªb", "abc.'s", "word###"]
    got = Pieces(path).ids([[w.encode() for w in words]])[0]
    encoder = token_counts.tokenizer(path)
    assert [np.frombuffer(x, np.uint16).tolist() for x in got] == [encoder.encode(w, add_special_tokens=False).ids for w in words]


def brute_classes(rows, n, num, den):
    sets = []
    for i, t in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(n, len(words))
        sets.append((i, {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if k else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_join_against_all_pairs(spark, docs, empty, n, num, den):
    rows = []
    for group in range(6):
        base = prose(90).split()
        for k in range(25):
            words = list(base)
            for _ in range(random.randint(0, 5)):
                words[random.randrange(len(words))] = random.choice(VOCABULARY)
            rows.append((len(rows), " ".join(words[: random.randint(80, 90)])))
    rows += [(len(rows) + k, t) for k, t in enumerate(TEXTS)]
    got = ngram_join.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows, n, num, den)
    odd = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_classes(docs).collect()}
    assert odd[None] == 5 and odd[6] == 5 and odd[7] == 5 and odd[0] == 0
    assert ngram_join.ngram_classes(empty).count() == 0


def test_null_id_joins_two_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    near = lambda *at: " ".join("other" if k in at else w for k, w in enumerate(words))
    big = (1 << 53) + 1  # the ends share 0.8498 of their n-grams, each 0.90 or more with the bridge
    rows = [(big, near(20, 40)), (None, near(40, 60)), (big + 2, near(60, 80)), (7, prose(90))]
    edges = [(big, near(20)), (None, near(20, 60, 61, 62)), (big + 2, near(60, 61, 62, 120, 121, 122))]
    for given in (rows[:3], edges):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_classes(spark.createDataFrame([*given, rows[3]], "doc_id long, text string")).collect()}
        assert got == {big: big, None: big, big + 2: big, 7: 7}


def test_leaks_finds_exact_and_edited_copies(spark, docs, empty):
    items = [(1, prose(40)), (2, prose(30)), (3, None), (4, ""), (None, prose(30))]
    words = items[0][1].split()
    edited = [w if k % 7 else "changed" for k, w in enumerate(words)]
    texts = [prose(50) + " " + items[0][1].upper() + ". " + prose(20), prose(300) + " " + " ".join(edited), prose(400), items[1][1], None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(rows, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (3, 2)} and got[0, 1]["score"] == 1.0 and got[0, 1]["first_word"] == 50
    assert {r["doc_id"] for r in decontaminate.decontaminate(rows, bench).collect()} == {2, 4, 5}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_finds_copies_with_regular_and_random_edits(spark):
    draw = random.Random(11)
    items = [(k, " ".join(draw.choices(VOCABULARY, k=45))) for k in range(40)] + [(40, "zebra quagga"), (41, "okapi")]
    texts = [(1000 + k, f"{prose(30)} {items[k][1]} {prose(30)}") for k in range(0, 40, 3)]  # makes some 4-grams common
    for k, text in items[:40]:
        words = text.split()
        for step in (5, 6):
            texts.append((step * 10_000 + k, prose(40) + " " + " ".join(f"new{k}x{j}" if j % step == step - 1 else w for j, w in enumerate(words)) + " " + prose(40)))
        texts.append((70_000 + k, prose(20) + " " + " ".join(f"new{k}x{j}" if draw.random() < 0.15 else w for j, w in enumerate(words))))
    texts += [(80_000, prose(20) + " Zebra, quagga " + prose(20)), (80_001, prose(9) + " okapi")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    coded = {k: [w.encode() for w in t.split()] for k, t in items}
    ids = decontaminate.WordIds()
    want = set()
    for d, t in texts:
        own = ids.of(decontaminate.words_of(t))
        for k, words in coded.items():
            if set(decontaminate.windows(ids.of(words), 4).tolist()) & set(decontaminate.windows(own, min(4, len(words))).tolist()):
                score, matched, _, _ = decontaminate.align(ids.of(words), own)
                if score >= 0.5 * len(words) and matched >= min(8, len(words)):
                    want.add((d, k))
    assert got == want and {(50_000 + k, k) for k in range(40)} | {(60_000 + k, k) for k in range(40)} | {(80_000, 40), (80_001, 41)} <= got


def brute_alignment(a, b):
    best, table = 0.0, np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), table[i - 1, j] - 0.5, table[i, j - 1] - 0.5)
            best = max(best, table[i, j])
    return best


def test_alignment_is_smith_waterman():
    for _ in range(60):
        a, b = np.array(random.choices(range(6), k=random.randint(1, 15))), np.array(random.choices(range(6), k=random.randint(1, 30)))
        assert decontaminate.align(a, b)[0] == pytest.approx(brute_alignment(a, b))


def test_classifier_separates_and_ignores_held_out_labels(spark, empty):
    rows = [(i, prose(60) if i % 2 else " ".join(w + "###" for w in prose(60).split())) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = nbsvm.classify(docs, labels).toPandas().set_index("doc_id")
    assert all(got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(402))
    assert (got.loc[:399, "predicted"] == [i % 2 for i in range(400)]).all() and got["score"].between(0, 1).all()
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    assert got["score"].equals(nbsvm.classify(docs, flipped).toPandas().set_index("doc_id")["score"])
    assert nbsvm.classify(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert nbsvm.classify(empty, labels).count() == 0


def test_pages_keep_the_article_only(spark):
    page = """<html><head><title>T</title><script>var a="</p>"</script></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies, accept.</div>
    <article><h1>Big  &amp; news</h1><p>First <b>bold</b>, text.<p>Second&nbsp;one<ul><li>a<li>b</ul><aside>Ad here</aside><form>Sign up</form></article><div id="comments"><p>Nice, very nice indeed.</p></div><footer>&copy; 2020</footer>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "no tags at all, just text."), (5, "u", "<<<>>><p")]
    got = {r["page_id"]: r for r in tag_paths.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "Big & news\nFirst bold, text.\nSecond one\na\nb" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and len(got) == 5


def sentences(draw, n):
    return " ".join(" ".join(draw.choices(VOCABULARY, k=12)).capitalize() + ", so." for _ in range(n))


def page_of(body):
    return f"<html><body><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>{body}<footer>&copy; 2020</footer></body></html>"


def test_scores_select_the_content_with_teaser_articles():
    draw = random.Random(3)
    story, more = [sentences(draw, 4) for _ in range(6)], ["Short teaser", "Other one", "Third of all"]
    paragraphs = "".join(f"<p>{x}</p>" for x in story)
    teasers = "".join(f"<article class='card'><h3>{x}</h3></article>" for x in more)
    for body in (f"<div class='text'>{paragraphs}</div><div>{teasers}</div>", f"<main><div>{paragraphs}</div><div>{teasers}</div></main>", f"<div><div>{paragraphs}</div><section>{teasers}</section></div>"):
        assert tag_paths.main_text(page_of(body)).split("\n") == story


def test_short_parts_and_wrappers_keep_the_article():
    draw = random.Random(4)
    lead, story, end = sentences(draw, 3), [sentences(draw, 4) for _ in range(12)], sentences(draw, 3)
    paragraphs = "".join(f"<p>{x}</p>" for x in story)
    whole = [lead, *story, end]
    parts = f"<section><p>{lead}</p></section><section>{paragraphs}</section><section><p>{end}</p></section>"
    for a, b in (("<div class='content'>", "</div>"), ("<div class='has-sidebar no-ads'><div class='content'>", "</div></div>"), ("<form action='/'><div class=post>", "</div></form>"), ("<div style='overflow:hidden' title=\"the hidden valley id=menu\"><div class='entry'>", "</div></div>")):
        page = page_of(a + parts + b + "<div class='sidebar'><p>Read this as well.</p></div>")
        assert tag_paths.main_text(page).split("\n") == whole, a
    assert "secret" not in tag_paths.main_text(page_of(f"<div class='content'>{parts}<div hidden><p>secret {lead}</p></div></div>"))


def test_registered_queries_name_every_operator():
    names = {re.match(r"op(\d+)_", n)[1] for n in queries.queries() if n.startswith("op")}
    assert names == {str(k) for k in range(1, 14)} and "pipeline" in queries.queries()
