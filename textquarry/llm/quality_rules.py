"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is a built-in expression; there is no user function and no shuffle. Arrays that several expressions
use are bound once by a one-element transform (`_let`), because Catalyst would otherwise copy the expression that
makes them into every lambda and evaluate it for each element.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "der die das den des dem ein eine einer für im ist mit nicht sich und von zu auch auf "
    "au aux ce dans de des du elle en est et il la le les ne par pas plus pour que qui sur un une "
    "al como con del el es las los más para pero por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails when `measure` (a column of measures()) leaves [low, high], if it has `words` words or more."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: The thresholds. Shares are of words, but for symbol_share (of characters in words) and the line shares (of lines).
RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_chars", 1.5, 20.0),
    Rule("symbols", "symbol_share", None, 0.10),
    Rule("bars", "bar_share", None, 0.25),
    Rule("shouting", "upper_share", None, 0.70, words=20),
    Rule("exclamations", "exclamation_share", None, 0.30, words=20),
    Rule("duplicate_lines", "dup_line_share", None, 0.50),
    Rule("duplicate_words", "max_word_share", None, 0.60, words=50),
    Rule("stop_words", "stop_share", 0.005, None, words=80),
    Rule("bullets", "bullet_line_share", None, 0.90),
    Rule("ellipses", "ellipsis_line_share", None, 0.30),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words inside some window that occurs twice or more in the array, first occurrences included.

    Windows are compared by 64-bit hash within one text. A text without repeated windows (nearly all) costs one
    array_distinct; the others sort (hash, position) once and add up the covered words, so the cost stays
    n log n for a text of any length.
    """

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(window)]))

        def covered(h: Column) -> Column:
            order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def spread(s: Column) -> Column:
                def repeated(x: Column, i: Column) -> Column:
                    # get() counts from 0 and is null outside the array
                    return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

                at = F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"]))
                return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

            return _let(order, spread)

        return F.when(F.size(w) < window + 1, F.lit(0)).otherwise(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    return _let(words, count)


def base_measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a (null: empty) text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words).cast("long"),
    }


def more_measures(text: Column) -> dict[str, Column]:
    """Counts behind the ratios that the rules and the quality classifier use."""
    text = F.coalesce(text, F.lit(""))
    lower = F.array_remove(F.split(F.lower(text), SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_chars": F.length(text).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_bars": F.length(F.regexp_replace(text, r"[^|]+", "")).cast("long"),
        "n_exclamations": F.length(F.regexp_replace(text, r"[^!]+", "")).cast("long"),
        "n_digits": F.length(F.regexp_replace(text, r"[^0-9]+", "")).cast("long"),
        "n_stops": F.length(F.regexp_replace(text, r"[^.!?]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
        "n_lower": F.length(F.regexp_replace(text, r"\P{Ll}+", "")).cast("long"),
        "n_distinct": F.size(F.array_distinct(lower)).cast("long"),
        "n_stop_words": F.size(F.filter(lower, lambda x: x.isin(STOP_WORDS))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long"),
    }


def ratios() -> dict[str, Column]:
    """The measures that RULES names, from the counts."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    letters = F.col("n_upper") + F.col("n_lower")
    return {
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "bar_share": share("n_bars", "n_words"),
        "upper_share": F.when(letters > 0, F.col("n_upper") / letters).otherwise(F.lit(0.0)),
        "exclamation_share": share("n_exclamations", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "max_word_share": F.when(F.col("n_words") > 0, 1 - F.col("n_distinct") / F.col("n_words")).otherwise(F.lit(0.0)),
        "stop_share": share("n_stop_words", "n_words"),
        "bullet_line_share": share("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the failed rules, as an array column over the measures."""
    tests = []
    for r in rules:
        out = F.lit(False)
        if r.low is not None:
            out = out | (F.col(r.measure) < r.low)
        if r.high is not None:
            out = out | (F.col(r.measure) > r.high)
        tests.append(F.when((F.col("n_words") >= r.words) & out, F.lit(r.name)))
    return F.array_compact(F.array(*tests))


def quality_rules(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules.

    base_failed: under 10 words, or more than a fifth of the words in repeated 5-word windows. Null and empty texts
    have no words and so fail; repeated rows each get a row; other columns are ignored.
    """
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("txt"))
    base = base_measures(F.col("txt"))
    counted = slim.select("id", *[c.alias(n) for n, c in {**base, **more_measures(F.col("txt"))}.items()])
    counted = counted.withColumns({"base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")), **ratios()})
    counted = counted.withColumn("failed_rules", compiled(rules))
    return counted.select(F.col("id").alias(doc), *base, "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
