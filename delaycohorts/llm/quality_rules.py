"""Quality rules: a table of thresholds compiled into one projection.

``measure`` adds the counts of a text, ``compile_rules`` turns the threshold table into one boolean
expression, ``quality_rules`` does both. Everything is a built-in column expression in one narrow
stage: no shuffle, no user function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaycohorts.llm.common import WHITE, whole

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

# Common function words of the four languages of the corpus, counted as they stand in lower case.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this from at or an not have has but they he she his her which their we you were been will would there can all if so "
    "de la le et les des en un une du que qui dans pour pas sur au avec est ce il par plus ne se sont "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "el los las por con una su para del al lo como más pero sus este ya entre cuando muy sin sobre también me hasta hay donde"
).split()

# name, numerator, denominator (per word, line or character), lower and upper bound.
THRESHOLDS: tuple[tuple[str, str, str, float | None, float | None], ...] = (
    ("mean_word_length", "word_chars", "n_words", 2.0, 20.0),
    ("symbol_ratio", "n_symbols", "n_words", None, 0.2),
    ("stop_word_ratio", "n_stop_words", "n_words", 0.04, None),
    ("upper_case_ratio", "n_upper", "word_chars", None, 0.4),
    ("exclamation_ratio", "n_exclaim", "n_words", None, 0.5),
    ("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    ("repeated_word_ratio", "n_repeat_words", "n_words", None, 0.5),
)


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(words: Column, n: Column, bits: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Each window becomes one long, its hash above and its position below; after one primitive sort
    equal windows are neighbours. The covered words follow from the sorted positions of those.
    """
    pack = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("bigint"))
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), pack))
    high = lambda x: F.call_function("shiftrightunsigned", x, bits)
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    none = F.lit(False)
    twice = lambda p: F.filter(p, lambda x, j: F.coalesce(high(x) == high(F.get(p, j + 1)), none) | F.coalesce(high(x) == high(F.get(p, j - 1)), none))
    starts = F.sort_array(F.transform(let(packed, twice), lambda x: x.bitwiseAND(low)))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["covered"] + F.least(F.lit(3).cast("bigint"), s - acc["last"])).alias("covered"))
    zero = F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("covered"))
    return F.when(n >= 3, F.aggregate(starts, zero, step, lambda acc: acc["covered"])).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus one struct ``measures`` of the counts of the whole text; a null text has no words."""
    full = whole(F.col(text))
    words = lambda t: F.when(F.length(t) > 0, F.split(t, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    spoken = F.filter(F.split(full, "\n"), lambda line: F.length(F.btrim(line, F.lit(WHITE))) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            let(F.struct(F.size(w).alias("n"), F.length(F.bin(F.size(w))).cast("int").alias("bits")), lambda v: _repeated(w, v["n"], v["bits"])).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*dict.fromkeys(STOP_WORDS)))).cast("bigint").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    def together(v: Column) -> Column:
        return F.struct(
            v["w"]["n_words"].alias("n_words"), F.length(F.translate(full, WHITE, "")).cast("bigint").alias("word_chars"),
            _count_of(full, SYMBOLS).cast("bigint").alias("n_symbols"), v["l"]["n_dup_lines"].alias("n_dup_lines"),
            v["w"]["n_repeat_words"].alias("n_repeat_words"), v["l"]["n_lines"].alias("n_lines"),
            _count_of(full, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("bigint").alias("n_upper"), _count_of(full, "!").cast("bigint").alias("n_exclaim"),
            v["w"]["n_stop_words"].alias("n_stop_words"),
        )

    counted = F.struct(let(let(F.btrim(full, F.lit(WHITE)), words), of_words).alias("w"), let(spoken, of_lines).alias("l"))
    return docs.withColumn("measures", let(counted, together))


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean over ``measures``: true if no ratio leaves its bounds."""
    verdict = F.lit(True)
    for _, top, bottom, low, high in thresholds:
        above, below = F.col(f"measures.{top}"), F.col(f"measures.{bottom}")
        if low is not None:
            verdict = verdict & (above >= F.lit(low) * below)
        if high is not None:
            verdict = verdict & (above <= F.lit(high) * below)
    return verdict


def quality_rules(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` plus ``measures``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules; repeated rows are judged one by one;
    an empty table gives an empty result. Columns of ``docs`` named like the added ones are replaced.
    """
    low = (F.col("measures.n_words") < MIN_WORDS) | (100 * F.col("measures.n_repeat_words") > 50 * F.col("measures.n_words"))
    judged = measure(docs, text)
    return judged.withColumns({"base_failed": low, "kept": ~low & compile_rules(thresholds)})


def digest_rows(docs: DataFrame) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_rules(docs.select("doc_id", "text"))
    return judged.select("doc_id", *[F.col(f"measures.{c}").alias(c) for c in names], "base_failed", "kept")
