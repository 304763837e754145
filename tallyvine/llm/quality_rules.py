"""Quality rules of texts as a short-circuit cascade of native expressions.

Measures are plain expressions over a text and its words (maximal runs of characters other
than ASCII white space). A rule is a named condition that rejects. The cascade takes a sample
of the documents, measures there how long each rule takes and how many documents it rejects,
and puts the rules in order of rejection per cost into one CASE, which stops at the first rule
that rejects. The order changes the time and the name of the first rejecting rule, never the
verdict.

Null texts have no words: all counts are 0. Rows are judged one by one, repeats alike; other
columns, whatever their names, are neither read nor returned by ``measure``.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyvine.sources.scratch import store

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Expected rows of the sample that the order of the rules is estimated on.
SAMPLE_ROWS = 1000


def with_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text (null as empty), flat (white space as blanks) and words."""
    base = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    flat = reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit(" ")), "\t\n\x0b\x0c\r", F.col("text"))
    flattened = base.select("*", flat.alias("flat"))
    return flattened.select("*", F.array_remove(F.split("flat", " "), "").alias("words"))


def repeated_window_words(frame: DataFrame, words: str = "words", window: int = WINDOW) -> DataFrame:
    """``frame`` with n_repeat_words: words inside windows of so many words found twice or more.

    Windows are compared by 64-bit hashes, combined from those of words by doubling (``window``
    is a power of two). Only texts with a repeated hash are sorted: equal hashes then stand side
    by side, and the words under their windows are counted from start to start.
    """
    kept = frame.columns
    frame = frame.select(*kept, F.transform(words, lambda w: F.xxhash64(w)).alias("__hash"))
    reach = 1
    while reach < window:
        ahead = F.slice("__hash", reach + 1, F.size("__hash"))
        frame = frame.select(*kept, F.zip_with("__hash", ahead, lambda a, b: F.xxhash64(a, b)).alias("__hash"))
        reach *= 2
    whole = F.greatest(F.size(words) - (window - 1), F.lit(0))
    frame = frame.select(*kept, F.slice("__hash", F.lit(1), whole).alias("__hash"))
    numbered = F.sort_array(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct("__hash")) < F.size("__hash")
    frame = frame.select(*kept, F.when(repeated, numbered).alias("__sorted"))
    none = F.expr("array(cast(null as struct<h: bigint, i: int>))")
    beside = F.arrays_zip(
        F.col("__sorted").alias("c"),
        F.slice("__sorted", 2, F.size("__sorted")).alias("n"),
        F.concat(none, "__sorted").alias("p"),
    )
    equal = F.filter(beside, lambda z: (z["c"]["h"] == z["n"]["h"]) | (z["c"]["h"] == z["p"]["h"]))
    starts = F.sort_array(F.transform(equal, lambda z: z["c"]["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(window), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    covered = F.when(F.col("__sorted").isNotNull(), covered).otherwise(0)
    return frame.select(*kept, covered.cast("long").alias("n_repeat_words"))


def lines_with_words(text: str = "text") -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^ \t-\r]"))


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    frame = with_words(docs, id_column, text_column)
    frame = frame.select("*", lines_with_words().alias("__lines"))
    frame = frame.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.replace("flat", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
    )
    return repeated_window_words(frame).drop("words")


def rules() -> dict[str, Column]:
    """The rules beyond the base ones: shares of symbols, capitals and repeated lines, word length."""
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    short, long = 10 * F.col("word_chars") < 15 * F.col("n_words"), F.col("word_chars") > 25 * F.col("n_words")
    return {
        "symbols": 100 * F.col("n_symbols") > 10 * F.col("word_chars"),
        "word_length": short | long,
        "repeated_lines": 100 * F.col("n_dup_lines") > 40 * F.size(lines_with_words()),
        "capitals": 100 * capitals > 50 * F.col("word_chars"),
    }


def order_rules(sample: DataFrame, conditions: dict[str, Column]) -> list[str]:
    """Names of the rules by falling rejection per cost, both measured on the sample."""
    gain = {}
    for name, condition in conditions.items():
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(condition)).first()[0]
        gain[name] = rejected / (time.perf_counter() - began)
    return sorted(conditions, key=lambda name: -gain[name])


def cascade(conditions: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in this order that rejects; null if none does."""
    named = [F.when(conditions[name], F.lit(name)) for name in order]
    return F.coalesce(*named, F.lit(None).cast("string"))


def apply_cascade(measured: DataFrame, conditions: dict[str, Column], sample_rows: int = SAMPLE_ROWS, rows: int | None = None) -> DataFrame:
    """``measured`` with ``rejected_by``. The sample is what a hash of the ids picks."""
    total = measured.count() if rows is None else rows
    every = max(1, total // sample_rows)
    sample = store(measured.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
    return measured.withColumn("rejected_by", cascade(conditions, order_rules(sample, conditions)))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed and kept.

    Base rules: under 20 words, or over 30 % of the words in repeated windows. What fails them is
    not kept; for the rest the cascade decides.
    """
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = measure(docs, id_column, text_column).withColumn("base_failed", base_failed)
    judged = apply_cascade(measured, rules(), rows=docs.count())
    return judged.select(
        F.col("doc_id").alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"),
    )
