"""Quality rules: a threshold table compiled into one Spark projection.

Counts come from built-in functions only (no Python, no shuffle, one pass over the text):
``text_counts`` adds them, ``compile_rules`` turns the table RULES into one boolean column.
Repeated three-word windows are found inside the row by sorting one packed long a window
(hash above, position below) and comparing neighbours; equal neighbours are confirmed on the
full 64-bit hash. A null or empty text has zero counts and fails the base rule. An input column
named like a new one gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_way

# Word breaks, symbols and stop words.
BREAKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au de des en est et la le les ou par pas pour que sur un une "
    "das der die ein eine ist mit nicht oder und von zu "
    "con del el es las los no para por se y"
).split()

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; measure is SQL over the counts, null passes."""

    name: str
    measure: str
    low: float
    high: float


RULES = (
    Rule("length", "n_words", 50, 100_000_000),
    Rule("mean_word", "word_chars / n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols / n_words", 0.0, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.01, 1.0),
    Rule("repeated_lines", "n_dup_lines / n_lines", 0.0, 0.4),
    Rule("words_a_line", "n_words / n_lines", 2.0, 100_000_000),
)


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words."""
    docs = give_way(docs, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")
    out = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("_words", F.filter(F.split("_text", r"[ \t-\r]+"), lambda w: w != "")).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BREAKS, "") != ""))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate("_text", BREAKS, "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.expr("size(filter(_words, w -> lower(w) in (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")))").cast("long"),
            "_bits": F.length(F.bin(F.size("_words").cast("long"))),
            "_hash": F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(slice(_words, 3, size(_words)), (w, i) -> xxhash64(get(_words, i), get(_words, i + 1), w)))"),
        }
    )
    out = out.withColumn("_sorted", F.expr("sort_array(transform(_hash, (h, i) -> shiftleft(h, _bits) | cast(i as bigint)))")).withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1"))
    # texts of a million words leave 44 bits: where two of these stand for different windows, whole hashes are sorted
    clash = "exists(zip_with(_sorted, slice(_sorted, 2, size(_sorted)), (x, y) -> shiftrightunsigned(x, _bits) = shiftrightunsigned(y, _bits) and get(_hash, cast(x & _mask as int)) <> get(_hash, cast(y & _mask as int))), x -> x)"
    whole = "transform(sort_array(transform(_hash, (h, i) -> struct(h as h, cast(i as bigint) as i))), s -> shiftleft(s.h, _bits) | s.i)"
    out = out.withColumn("_sorted", F.expr(f"if({clash}, {whole}, _sorted)"))
    same = "shiftrightunsigned(x, _bits) = shiftrightunsigned(y, _bits) and get(_hash, cast(x & _mask as int)) = get(_hash, cast(y & _mask as int))"
    out = out.withColumn("_next", F.expr(f"zip_with(_sorted, slice(_sorted, 2, size(_sorted)), (x, y) -> coalesce({same}, false))"))
    out = out.withColumn("_starts", F.expr("sort_array(array_compact(zip_with(_sorted, zip_with(_next, concat(array(false), _next), (a, b) -> coalesce(a, false) or b), (x, hit) -> if(hit and x is not null, x & _mask, cast(null as bigint)))))"))
    covered = "aggregate(zip_with(_starts, slice(_starts, 2, size(_starts)), (x, y) -> coalesce(least(y - x, 3L), 3L)), 0L, (t, x) -> t + x)"
    out = out.withColumn("n_repeat_words", F.expr(covered))
    return out.drop("_text", "_words", "_lines", "_bits", "_hash", "_sorted", "_mask", "_next", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: every rule of the table holds (a ratio over zero counts as passed)."""
    verdict = F.lit(True)
    for rule in rules:
        measure = F.expr("try_divide(" + ", ".join(rule.measure.split(" / ")) + ")" if " / " in rule.measure else rule.measure).cast("double")
        verdict = verdict & F.coalesce(measure.between(rule.low, rule.high), F.lit(True))
    return verdict


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed`` and ``kept`` (false where the base fails)."""
    counted = text_counts(give_way(docs, "base_failed", "kept"), text_col).withColumn("base_failed", base_failed())
    return counted.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
