"""Quality rules: a threshold table compiled into one Spark projection.

No user functions anywhere: word, symbol, stop-word and line ratios are built-in expressions on
the text column, and each row of :data:`RULES` becomes one comparison of the same projection.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[ \\t\\n\\u000B\\f\\r]+"
#: The symbols counted, and the characters that separate words.
SYMBOLS = "#*$%&|<>"
TRAILING = ".,;:!?\"'()"
BLANKS = " \t\n\x0b\x0c\r"
#: Frequent function words of the languages served.
STOP_WORDS = tuple(dict.fromkeys((
    "the of and to in is that it for was on are as with be at by this from have or an not "
    "der die das und ist nicht ein eine mit von zu den auf für sich im dem des auch "
    "le la les de des et est une un dans que qui pour par sur pas au du avec en "
    "el los las una y no se por con para del lo como su al"
).split()))


class Rule(NamedTuple):
    name: str
    metric: str
    low: float | None
    high: float | None


#: A text passes a rule if low <= metric <= high; a rule whose metric is null passes.
RULES = (
    Rule("word_length", "mean_word_length", 1.5, 14.0),
    Rule("symbols", "symbols_per_word", None, 0.4),
    Rule("shouting", "upper_letter_ratio", None, 0.6),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("stop_word_ratio", "stop_word_ratio", 0.02, None),
    Rule("letters", "letter_ratio", 0.5, None),
    Rule("dup_lines", "dup_line_ratio", None, 0.6),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _covered(starts: Column) -> Column:
    """Words covered by 3-word windows at the sorted positions ``starts``: each adds what the next doesn't."""
    n = F.size(starts)
    steps = F.transform(starts, lambda p, i: F.when(i + 1 < n, F.least(F.lit(3), F.get(starts, i + 1) - p)).otherwise(F.lit(3)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns plus the counts and ratios that the rules use, over whole texts.

    Null texts count as empty: every count is 0 and every ratio null. Windows of three words are
    compared by their 64-bit hash (a chance agreement in a text of 20,000 words: about 1e-11).
    """
    df = docs.select(*(F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    df = df.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != ""))
    df = df.withColumn("n", F.size("w"))
    grams = F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn("g", F.when(F.col("n") >= 4, F.sort_array(grams)))
    g = F.col("g")
    twice = F.filter(g, lambda x, i: (F.get(g, i - 1)["h"] == x["h"]) | (F.get(g, i + 1)["h"] == x["h"]))
    df = df.withColumn("r", F.sort_array(F.transform(twice, lambda x: x["i"])))
    n = F.col("n")
    squeezed = F.translate("t", BLANKS, "")
    n_lines = F.size("lines")
    word_chars = F.length(squeezed)
    n_symbols = F.length("t") - F.length(F.translate("t", SYMBOLS, ""))
    n_stop = F.size(F.filter("w", lambda x: F.lower(F.translate(x, TRAILING, "")).isin(*STOP_WORDS)))
    n_letters = F.length(squeezed) - F.length(F.regexp_replace(squeezed, r"\p{L}+", ""))
    n_upper = F.length(squeezed) - F.length(F.regexp_replace(squeezed, r"\p{Lu}+", ""))
    return df.select(
        *(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)),
        n.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        n_symbols.cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n < 4, F.lit(0).cast("long")).otherwise(_covered(F.col("r"))).alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        n_stop.cast("long").alias("n_stop_words"),
        _ratio(word_chars, n).alias("mean_word_length"),
        _ratio(n_symbols, n).alias("symbols_per_word"),
        _ratio(n_stop, n).alias("stop_word_ratio"),
        _ratio(n_letters, word_chars).alias("letter_ratio"),
        _ratio(n_upper, n_letters).alias("upper_letter_ratio"),
        _ratio(n_lines - F.size(F.array_distinct("lines")), n_lines).alias("dup_line_ratio"),
        _ratio(F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), n_lines).alias("ellipsis_line_ratio"),
        _ratio(F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•‣]"))), n_lines).alias("bullet_line_ratio"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """One boolean expression for each rule, by name: true where the text passes."""
    out = {}
    for r in rules:
        m = F.col(r.metric)
        tests = [m >= r.low] * (r.low is not None) + [m <= r.high] * (r.high is not None)
        ok = F.lit(True)
        for t in tests:
            ok = ok & t
        out[r.name] = F.coalesce(ok, F.lit(True))
    return out


def verdicts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns, all metrics, ``base_failed``, ``failed`` (names of failed rules) and ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows each get their row;
    ties need no order, and columns other than ``keep`` and ``text`` are never read.
    """
    df = measured(docs, text, keep)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    tests = compiled(rules)
    failed = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in tests.items())), lambda x: x.isNotNull())
    ok = F.lit(True)
    for t in tests.values():
        ok = ok & t
    return df.select("*", base.alias("base_failed"), failed.alias("failed"), (~base & ok).alias("kept"))


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns, unchanged."""
    names = [f"in_{i}" for i in range(len(docs.columns))]
    judged = verdicts(docs.toDF(*names), names[docs.columns.index(text)], tuple(names))
    # a filter on computed columns alone would be pushed down as a copy of every rule's expression for each use of it;
    # one on a column that isn't a function of the row stays above the projection
    judged = judged.select(*names, "kept", F.monotonically_increasing_id().alias("mark"))
    return judged.filter(F.col("kept") & (F.col("mark") >= 0)).select(*names).toDF(*docs.columns)
