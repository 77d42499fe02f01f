"""Line-first quality rules with DataFrame functions only.

Each line is tried on its own: by its punctuation, as navigation, as boilerplate.
Lines that fail are removed; a document that loses too much of its text with them is
rejected, as is one too short or too repetitive as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, and symbols that are counted.
SPACES = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
# Fixed value: hash of the window at i.
WINDOW_HASH = "xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))"
# Phrases of boilerplate lines, in lower case.
BOILERPLATE = ("all rights reserved", "click here", "cookie", "follow us", "javascript", "licensed under", "log in", "lorem ipsum", "newsletter", "privacy policy", "read more", "released under", "share this", "sign up", "subscribe", "terms of service", "terms of use")


@dataclass(frozen=True)
class QualityRules:
    """min_words and most_repeated (percent of words in repeated 3-word windows): of a document.
    noisy: symbols a word of a line; shouting: exclamation marks a word; bars: separators a word;
    most_lost: percent of a document's word characters that may go with failed lines."""

    min_words: int = 50
    most_repeated: int = 50
    noisy: float = 0.3
    shouting: float = 0.4
    bars: float = 0.3
    most_lost: int = 40


def _solid(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, SPACES, ""))


def line_fails(line: Column, rules: QualityRules) -> Column:
    """The rules of a line that has a word: punctuation, navigation, boilerplate."""
    words = F.regexp_count(line, F.lit("[^ \\t-\\r]+"))
    punctuation = (F.regexp_count(line, F.lit("[#*$%&<>]")) >= rules.noisy * words) | (F.regexp_count(line, F.lit("!")) >= rules.shouting * words)
    bars = F.regexp_count(line, F.lit("[|»›·•]"))
    navigation = (bars >= 2) & (bars >= rules.bars * words)
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE))
    return punctuation | navigation | boilerplate


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split(text, SPACES), ""))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")))
    rows = rows.withColumn("_n", F.size("_words")).withColumn("_bits", F.length(F.bin(F.col("_n"))))
    # A window's hash in the high bits, its place in the low ones: sorting brings equal windows together.
    packed = f"transform(sequence(0, _n - 3), i -> shiftleft({WINDOW_HASH}, _bits) | cast(i as bigint))"
    rows = rows.withColumn("_packed", F.expr(f"if(_n >= 3, sort_array({packed}), cast(array() as array<bigint>))"))
    rows = rows.withColumn("_low", F.expr("shiftleft(cast(1 as bigint), _bits) - 1"))
    at = "cast({} & _low as int)"
    equal = " and ".join(f"get(_words, {at.format('{0}')} + {k}) = get(_words, {at.format('{1}')} + {k})" for k in range(3))
    bits = "shiftright({0}, _bits) = shiftright({1}, _bits)"
    same = f"({bits} and {equal})"
    twin = f"(k > 0 and {same.format('x', 'get(_packed, k - 1)')}) or (k + 1 < size(_packed) and {same.format('x', 'get(_packed, k + 1)')})"
    found = f"transform(filter(_packed, (x, k) -> {twin}), x -> {at.format('x')})"
    # Different windows of equal hash bits may part equal ones: such a text's windows are sorted by their words.
    rows = rows.withColumn("_clash", F.expr(f"exists(sequence(1, size(_packed)), k -> k < size(_packed) and {bits.format('get(_packed, k)', 'get(_packed, k - 1)')} and not ({equal.format('get(_packed, k)', 'get(_packed, k - 1)')}))"))
    rows = rows.withColumn("_sorted", F.expr("if(_clash, sort_array(transform(sequence(0, _n - 3), i -> struct(get(_words, i) as a, get(_words, i + 1) as b, get(_words, i + 2) as c, i as at))), null)"))
    alike = " and ".join(f"x.{f} = get(_sorted, k + {{0}}).{f}" for f in "abc")
    exact = f"transform(filter(_sorted, (x, k) -> (k > 0 and {alike.format('-1')}) or (k + 1 < size(_sorted) and {alike.format('1')})), x -> x.at)"
    rows = rows.withColumn("_twins", F.expr(f"sort_array(if(_clash, {exact}, {found}))"))
    covered = F.expr("aggregate(transform(_twins, (x, k) -> least(3, coalesce(get(_twins, k + 1) - x, 3))), 0, (a, x) -> a + x)")
    return rows.withColumn("_repeated", covered)


def judge_quality(docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_failed_lines, failed_chars), a row for each input row.

    A null or empty text has no words and fails.  Rows with null or repeated ids are
    judged each by its own text; other columns are neither read nor returned; an empty
    table gives an empty result.
    """
    r = rules or QualityRules()
    rows = _measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw")), "_raw")
    rows = rows.withColumn("_failed", F.filter("_lines", lambda line: line_fails(line, r)))
    long = lambda c: c.cast("long")
    rows = rows.select(
        F.col("_id").alias("doc_id"),
        long(F.col("_n")).alias("n_words"),
        long(_solid(F.col("_text"))).alias("word_chars"),
        long(F.char_length("_text") - F.char_length(F.regexp_replace("_text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(F.col("_repeated")).alias("n_repeat_words"),
        long(F.size("_failed")).alias("n_failed_lines"),
        long(_solid(F.array_join("_failed", ""))).alias("failed_chars"),
    )
    base = (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.most_repeated * F.col("n_words"))
    kept = ~base & (100 * F.col("failed_chars") <= r.most_lost * F.col("word_chars"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"), "n_failed_lines", "failed_chars")


def clean_lines(docs: DataFrame, rules: QualityRules | None = None, text_col: str = "text") -> DataFrame:
    """All rows and columns with the failed lines taken out of the texts; lines without a word stay."""
    r = rules or QualityRules()
    stays = F.filter(F.split(F.col(text_col), "\n"), lambda line: ~(line.rlike("[^ \\t-\\r]") & line_fails(line, r)))
    return docs.withColumn(text_col, F.array_join(stays, "\n"))
