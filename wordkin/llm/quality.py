"""Line-first cleaning with column expressions only.

Every line is judged on its own: closing punctuation, navigation bars, boilerplate phrases,
symbol noise, shouting and stutter. Failing lines are removed; a document that loses too large a
part of its text this way, or fails the base rules, is rejected.

Defined results: a null text counts as empty; a text without words has all counts 0 and is rejected
(base rule); blank lines are neither judged nor counted as lost; equal rows get equal verdicts; every
input column is passed through, but for those with the name of a result (after the caller's prefix), which
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wordkin.llm.common import SPACE, SPACE_CHARS, let, words

# Symbols that the base statistics count.
SYMBOLS = "#*$%&|<>"
# Phrases of page furniture, and the characters that may close a sentence.
BOILERPLATE = (
    "all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use cookies"
    "|javascript|lorem ipsum|licensed under|subscribe to our|click here|read more|sign up for"
)
CLOSING = "[.!?…。！？:;][\"'”’»)\\]]*$"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST = 0.3
MAX_SYMBOLS_PER_WORD = 0.2
MAX_SHOUT = 0.3
MIN_STUTTER_WORDS = 10
MIN_DISTINCT = 0.25
# Reserved names of columns that exist between the steps only.
HELD = "_wordkin_quality_"


def repeated_word_count(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, the first time included.

    Windows are sorted by hash inside the row, so the work is n log n in the words of a text.
    """

    def windows(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(x) - 3)
        return F.sort_array(
            F.transform(at, lambda i: F.struct(F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)).alias("h"), i.alias("i")))
        )

    def twice(s: Column) -> Column:
        def same(j: Column, x: Column) -> Column:
            return F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))

        hit = F.transform(s, lambda x, j: F.when(same(j - 1, x) | same(j + 1, x), x["i"]))
        return F.sort_array(F.filter(hit, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        # A window covers three words, or only those before the next window starts.
        part = F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3))))
        return F.aggregate(part, F.lit(0), lambda a, b: a + b)

    count = let(w, lambda x: let(windows(x), lambda s: let(twice(s), covered)))
    return F.when(F.size(w) >= 3, count).otherwise(F.lit(0)).cast("long")


def line_fails(line: Column) -> Column:
    """True for a line that breaks a rule; blank lines pass."""

    def judge(w: Column) -> Column:
        n = F.size(w)
        symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
        shouts = F.size(F.filter(w, lambda x: x.endswith("!!")))
        return (n > 0) & (
            ~F.rtrim(F.regexp_replace(line, SPACE, " ")).rlike(CLOSING)
            | F.lower(line).rlike(BOILERPLATE)
            | (symbols > n * MAX_SYMBOLS_PER_WORD)
            | (shouts > n * MAX_SHOUT)
            | ((n >= MIN_STUTTER_WORDS) & (F.size(F.array_distinct(w)) < n * MIN_DISTINCT))
        )

    return let(words(line), judge)


def quality(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the base statistics, the cleaned text and the verdict to every row.

    Columns (each with the prefix): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, clean_text, n_lines, lost_share. Input columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    p = prefix
    lines = F.split(t, "\n")
    full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Arrays are built once, in a projection of their own, then measured.
    judged = df.withColumns(
        {
            f"{HELD}w": words(t),
            f"{HELD}full": full,
            f"{HELD}ok": F.filter(lines, lambda x: ~line_fails(x)),
        }
    )
    w, ok = F.col(f"{HELD}w"), F.col(f"{HELD}ok")
    ink = lambda c: F.length(F.translate(c, SPACE_CHARS, ""))
    counted = judged.withColumns(
        {
            f"{p}n_words": F.size(w).cast("long"),
            f"{p}word_chars": ink(t).cast("long"),
            f"{p}n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            f"{p}n_dup_lines": (F.size(f"{HELD}full") - F.size(F.array_distinct(f"{HELD}full"))).cast("long"),
            f"{p}n_repeat_words": repeated_word_count(w),
            f"{p}clean_text": F.array_join(ok, "\n"),
            f"{p}n_lines": F.size(f"{HELD}full").cast("long"),
        }
    )
    n, chars = F.col(f"{p}n_words"), F.col(f"{p}word_chars")
    lost = chars - ink(F.col(f"{p}clean_text"))
    return (
        counted.withColumn(f"{p}base_failed", (n < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * n))
        .withColumn(f"{p}lost_share", F.when(chars > 0, lost / chars).otherwise(F.lit(0.0)))
        .withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}lost_share") <= MAX_LOST))
        .drop(f"{HELD}w", f"{HELD}full", f"{HELD}ok")
    )
