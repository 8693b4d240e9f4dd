"""Quality rules: a threshold table compiled into one Spark projection.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and
return. No user function runs: words and three-word windows are arrays of the row itself, so
nothing is shuffled and a text of any length is judged whole.

Defined cases: a null text has no words and fails the base rule like an empty one; repeated
rows are judged one by one; an empty table gives an empty result; columns of the input whose
names clash with a measure are hidden by it in ``measure`` and untouched by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, whole_text

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for on with as are this be at by from or an not "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine "
    "le la les des et est un une du dans que pour qui sur pas au avec ne se plus "
    "el los las y en por con para del al lo una su es no como más"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text fails unless ``low <= measure <= high``; an open side is None."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The ratios a kept text has to meet.
THRESHOLDS = (
    Threshold("mean_word_chars", 1.5, 20.0),
    Threshold("symbol_ratio", None, 0.1),
    Threshold("upper_ratio", None, 0.5),
    Threshold("letter_ratio", 0.6, None),
    Threshold("stop_word_ratio", 0.01, None),
    Threshold("dup_line_ratio", None, 0.6),
    Threshold("ellipsis_line_ratio", None, 0.3),
    Threshold("bullet_line_ratio", None, 0.9),
)

MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio",
    "upper_ratio", "letter_ratio", "stop_word_ratio", "dup_line_ratio", "ellipsis_line_ratio", "bullet_line_ratio",
    "base_failed", "kept",
]


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once for the row."""
    return F.transform(F.array(value), body)[0]


def _repeated(windows: Column) -> Column:
    """Words inside windows that occur twice or more: neighbours in sorted order mark the windows."""

    def covered(ordered: Column) -> Column:
        again = lambda x, i: F.when((x.w == F.get(ordered, i - 1).w) | (x.w == F.get(ordered, i + 1).w), x.i)
        hit = F.array_compact(F.transform(ordered, again))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(ordered, covered))


def _judged(df: DataFrame, text: str, thresholds) -> DataFrame:
    """``df`` (a struct column of kept columns and ``text``) with every measure."""
    bare = lambda chars: F.length(F.translate(text, chars, ""))
    df = df.withColumn("__words", F.regexp_extract_all(text, F.lit(f"({WORD})"), 1))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
    joined = F.transform("__words", lambda w, i: F.concat_ws(" ", w, F.get("__words", i + 1), F.get("__words", i + 2)))
    df = df.withColumn("__windows", F.slice(joined, F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    n_lines = F.size("__lines")
    starts = lambda pattern: F.size(F.filter("__lines", lambda x: x.rlike(pattern)))
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    df = df.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": bare(SPACES).cast("long"),
            "n_symbols": (F.length(text) - bare(SYMBOLS)).cast("long"),
            "n_dup_lines": (n_lines - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeated(F.col("__windows")).cast("long"),
            "__stop": F.size(F.filter("__words", lambda x: F.lower(x).isin(STOP_WORDS))),
            "__letters": letters,
            "__upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")),
            "__n_lines": n_lines,
            "ellipsis_line_ratio": ratio(starts(r"(\.\.\.|…)\s*$"), n_lines),
            "bullet_line_ratio": ratio(starts(r"^\s*[-*•‣·]\s"), n_lines),
        }
    ).drop("__words", "__lines", "__windows")
    df = df.withColumns(
        {
            "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
            "symbol_ratio": ratio(F.col("n_symbols"), F.col("n_words")),
            "upper_ratio": ratio(F.col("__upper"), F.col("__letters")),
            "letter_ratio": ratio(F.col("__letters"), F.col("word_chars")),
            "stop_word_ratio": ratio(F.col("__stop"), F.col("n_words")),
            "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("__n_lines")),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        }
    )
    within = ~F.col("base_failed")
    for t in thresholds:
        if t.low is not None:
            within &= F.col(t.measure) >= t.low
        if t.high is not None:
            within &= F.col(t.measure) <= t.high
    return df.withColumn("kept", within)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), thresholds=THRESHOLDS) -> DataFrame:
    """Columns ``keep`` beside every measure, ``base_failed`` and ``kept``, one row per input row."""
    names = [c for c in keep if c not in MEASURES]
    slim = docs.select(*names, whole_text(docs, text).alias("__text"))
    # As in ``keep``: a caller's filter on a measure stays above the generator.
    return _judged(slim, "__text", thresholds).select(*names, F.inline(F.array(F.struct(*MEASURES))))


def keep(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` whose text meets the base rule and every threshold, with their columns."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), whole_text(docs, text).alias("__text"))
    # A generator, for a filter would be pushed below the arrays and build them anew for every word.
    return _judged(packed, "__text", thresholds).select(F.inline(F.when(F.col("kept"), F.array("__row"))))
