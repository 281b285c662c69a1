"""Quality rules: a table of thresholds compiled into one Spark projection.

Every statistic is a Spark expression over the text; no user functions, no shuffle.  Null texts count as empty texts
and have no words.  Very long texts cost n log n in their number of words, for the repeated three-word windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, words_of

#: Function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the be to of and that have with is in for "
    "der die das und den von zu nicht mit ein für auf "
    "le la les des du et que qui dans pour une par "
    "el los las del y en por con para una se".split()
)

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``low <= statistic <= high``."""

    name: str
    statistic: str
    low: float = float("-inf")
    high: float = float("inf")


#: The thresholds, after published rule sets for web text.
RULES = (
    Rule("words", "n_words", low=50, high=10_000_000),
    Rule("mean_word", "word_chars / n_words", low=2, high=14),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("ellipses", "n_ellipses / n_lines", high=0.3),
    Rule("bullets", "n_bullets / n_lines", high=0.9),
    Rule("dup_lines", "n_dup_lines / n_lines", high=0.5),
    Rule("repeats", "n_repeat_words / n_words", high=0.5),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("capitals", "n_upper / word_chars", high=0.4),
    Rule("shouts", "n_shouts / n_words", high=0.2),
)


def _windows(words: Column) -> Column:
    """A 64-bit hash of each three-word window."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    return F.when(F.size(words) >= 3, F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Where a hash repeats, windows are sorted as (hash, position) inside the row; neighbours with one hash mark each
    other's positions.
    """

    def marked(ordered: Column) -> Column:
        same = F.transform(
            ordered,
            lambda w, k: F.when((F.get(ordered, k - 1)["h"] == w["h"]) | (F.get(ordered, k + 1)["h"] == w["h"]), w["i"]),
        )
        starts = F.filter(same, lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(~repeated, F.lit(0)).otherwise(F.element_at(F.transform(F.array(ordered), marked), 1))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and every statistic that a rule may name, as long columns."""
    words, lines = F.col("_words"), F.col("_lines")
    stops = "(?i)(?<![^\\x20\\x09-\\x0D])(?:" + "|".join(STOP_WORDS) + ")(?![^\\x20\\x09-\\x0D])"
    count = lambda pattern: F.regexp_count(F.col("_text"), F.lit(pattern))
    base = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    base = base.withColumn("_words", words_of(F.col("_text")))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    base = base.withColumn("_windows", _windows(F.col("_words")))
    return base.select(
        id_col,
        F.size(words).cast("long").alias("n_words"),
        (F.length("_text") - count(r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
        count(f"[{SYMBOLS}]").cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_windows")).cast("long").alias("n_repeat_words"),
        count(stops).cast("long").alias("n_stop_words"),
        count(r"(?m)(?:\.\.\.|…)[\x20\x09]*$").cast("long").alias("n_ellipses"),
        count(r"(?m)^[\x20\x09]*[-*•]").cast("long").alias("n_bullets"),
        count(r"!!").cast("long").alias("n_shouts"),
        count(r"\p{Lu}").cast("long").alias("n_upper"),
    )


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, failed_rules and kept.  A statistic without value (no words, no lines) breaks no rule."""
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def broken(rule: Rule) -> Column:
        x = F.expr(rule.statistic.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)").replace("/ word_chars", "/ nullif(word_chars, 0)"))
        out = F.lit(False)
        if rule.low != float("-inf"):
            out = out | (x < rule.low)
        if rule.high != float("inf"):
            out = out | (x > rule.high)
        return F.when(F.coalesce(out, F.lit(False)), F.lit(rule.name))

    failed = F.array_compact(F.array(*(broken(r) for r in rules)))
    out = measured.withColumn("base_failed", base_failed).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, statistics, base_failed, failed_rules (names), kept."""
    return judge(measure(docs, id_col, text_col), rules)
