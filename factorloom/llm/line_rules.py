"""Line-first cleaning with column expressions only.

Every line is judged by itself; lines that fail a rule are removed, and a document that loses too much
of its text with them is rejected. A few rules on the whole text come first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import WORD, text_of

# The limits of the base rules.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

#: A document is rejected if less than this share of its word characters is in lines that stay.
MIN_KEPT_PERCENT = 50
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright|licen[cs]ed under|terms of (use|service)|privacy policy|cookie policy|use[sd]? cookies|enable javascript|"
    r"click here|read more|sign up|log in|subscribe to|share this|skip to (main )?content|back to top|lorem ipsum)"
)
SEPARATOR = r"[|»›•·]"
SYMBOL_WORD = r"[#*$%&|<>]{2,}"
SHOUT = r"!!"


def line_rules() -> dict[str, Callable[[Column, Column], Column]]:
    """Name to rule: given a line and its number of words, whether the line fails."""
    return {
        # a short line that ends in no punctuation: a heading, a button, a fragment
        "punctuation": lambda line, n: (n < 5) & ~F.rlike(line, F.lit(r"[.!?:;,\"')\]…。！？-][\x20\x09-\x0D]*$")),
        # items between separators
        "navigation": lambda line, n: (F.regexp_count(line, F.lit(SEPARATOR)) >= 2) & (F.regexp_count(line, F.lit(SEPARATOR)) * 4 >= n),
        "boilerplate": lambda line, n: F.rlike(line, F.lit(BOILERPLATE)),
        # every third word carries a run of symbols
        "symbols": lambda line, n: F.regexp_count(line, F.lit(SYMBOL_WORD)) * 3 >= n,
        "shouting": lambda line, n: F.regexp_count(line, F.lit(SHOUT)) * 3 >= n,
        # hardly any two words differ
        "stuffing": lambda line, n: (n >= 10) & (F.size(F.array_distinct(words_of(line))) * 3 <= n),
    }


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))


def bare(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, WHITE, "")


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the words and the windows' hashes.

    Windows with equal hashes are compared word by word: they sort by hash, then words, then place.
    """
    seen = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.slice(words, i + 1, WINDOW).alias("w"), i.alias("i"))))

    def places(sorted_windows: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (a["w"] == b["w"])
        again = F.filter(sorted_windows, lambda s, k: F.coalesce(same(s, F.get(sorted_windows, k - 1)), F.lit(False)) | F.coalesce(same(s, F.get(sorted_windows, k + 1)), F.lit(False)))
        return F.sort_array(F.transform(again, lambda s: s["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p)), F.lit(0).cast("bigint"), lambda total, n: total + n)

    # each array is bound to a name by a transform over one element, so that it is made once
    bound = F.transform(F.array(seen), places)
    return F.get(F.transform(bound, covered), 0)


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the whole-text counts and ``base_failed``."""
    split = docs.withColumn("__words", words_of(F.col("text"))).withColumn("__lines", F.split("text", "\n", -1))
    split = split.withColumn("n_words", F.size("__words").cast("bigint"))
    windows = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    hashed = split.withColumn("__hashes", F.transform(windows, lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    live = F.filter("__lines", lambda line: F.rlike(line, F.lit(WORD)))
    repeats = F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), _repeated_words(F.col("__words"), F.col("__hashes"))).otherwise(F.lit(0).cast("bigint"))
    counted = hashed.select(
        "doc_id",
        "text",
        "__lines",
        "n_words",
        F.length(bare(F.col("text"))).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size(live) - F.size(F.array_distinct(live))).cast("bigint").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _kept_lines(lines: Column) -> Column:
    """Lines that fail no rule; lines without words stay as they are."""

    def stays(line: Column) -> Column:
        words = F.regexp_count(line, F.lit(WORD))
        # the number of words is bound to a name by a filter over one element
        fails = lambda n: reduce(lambda a, b: a | b, [rule(line, n) for rule in line_rules().values()])
        return F.size(F.filter(F.array(words), lambda n: (n == 0) | ~fails(n))) == 1

    return F.filter(lines, stays)


def clean_lines(docs: DataFrame, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """doc_id, clean_text, the counts, base_failed, kept_chars and kept for every row of ``docs``.

    Null text counts as empty; an empty text has no words, so it fails the base rules. Repeated rows
    are judged alike; an empty table gives an empty result; other columns are not carried. Everything
    is a column expression on one row: nothing is shuffled, and a text of any length is judged whole.
    """
    counted = base_counts(docs.select("doc_id", text_of().alias("text")))
    cleaned = counted.withColumn("clean_text", F.array_join(_kept_lines(F.col("__lines")), "\n")).drop("__lines", "text")
    cleaned = cleaned.withColumn("kept_chars", F.length(bare(F.col("clean_text"))).cast("bigint"))
    enough = 100 * F.col("kept_chars") >= min_kept_percent * F.col("word_chars")
    return cleaned.withColumn("kept", ~F.col("base_failed") & enough)
