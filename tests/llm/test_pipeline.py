"""The pipeline against a plain-Python version of its filtering stages."""

import hashlib
import re

import corpus_pipeline
import pytest
from delaycohorts.llm import quality_rules
from tests.llm.test_operators import LINE, brute_classes, brute_lines, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_what_plain_python_keeps(spark, tmp_path):
    lead = "the of and to in "
    item = prose(30)
    texts = [lead + " ".join(lead.split()[k % 5] if k % 4 == 0 else w for k, w in enumerate(prose(90).split())) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", texts[2] + "\n" + LINE, texts[3] + "\n" + LINE, texts[4] + " " + item, "too short", "", None, "word### " * 90]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = {i: t for i, t in enumerate(texts) if len(WORD.findall(t or "")) >= 50 and "#" not in t}
    step = corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert step.columns == docs.columns and {r["doc_id"] for r in step.collect()} == set(good)
    step = corpus_pipeline.drop_repeated_lines(spark, step, str(tmp_path))
    clean = {r["doc_id"]: r["text"] for r in step.collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()} == {r[0]: r[3] for r in brute_lines(list(good.items()))}
    step = corpus_pipeline.one_of_each_class(spark, step, str(tmp_path))
    single = {i for i, (_, c) in brute_classes(list(clean.items()), 5, 80, 100).items() if c == i}
    assert {r["doc_id"] for r in step.collect()} == single
    step = corpus_pipeline.drop_leaks(spark, step, str(tmp_path))
    left = {i for i in single if item not in clean[i]}
    assert {r["doc_id"] for r in step.collect()} == left and step.columns == docs.columns
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left
    assert quality_rules.MIN_WORDS == 50


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, prose(30)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


EXTRA = ["kept", "measures", "base_failed", "n_lines", "n_dropped", "kept_text", "component_id", "hit", "item_id", "score", "ids"]


def test_stages_keep_columns_null_ids_and_repeated_rows(spark, folder):
    base = "the of and to in " * 3 + prose(90)
    texts = [(1, base), (2, base + " tail"), (None, prose(80) + " the of and to in " * 2), (None, None), (4, ""), (5, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in EXTRA)
    rows = [(i, t, "en", None, None, *[f"mine {c}" for c in EXTRA]) for i, t in [*texts, texts[0]]]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes, name
    left = docs.collect()
    assert sorted((r["doc_id"] for r in left), key=str) == [1, 1, None]
    assert all(r[c] == f"mine {c}" for r in left for c in EXTRA) and all(r["n_chars"] == len(r["text"]) for r in left)
    packed = corpus_pipeline.pack_windows(spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == {1, None}


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.write.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
