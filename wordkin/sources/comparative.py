"""Comparative-database text: ``a`` gloss, ``b`` group, ``c`` relation and indented form lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordkin.functions.ordered import fill_down, running_total
from wordkin.functions.text import clean_language, first_variant

# Fixed value: the layout of a form line.
FORM = r"  ([0-9]+) ([0-9]+) (([A-Z.a-z]+ )+) +(.*)"


def comparative_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )


def with_headers(lines: DataFrame) -> DataFrame:
    """Every line with the gloss and the group number of the last headers above it."""
    value = F.col("value")
    token = F.split(F.trim(value), r"\s+")
    marked = (
        lines.withColumn("kind", F.substring(value, 1, 1))
        .withColumn("gloss", F.when(F.col("kind") == "a", F.element_at(token, 3)))
        .withColumn("group_no", F.when(F.col("kind") == "b", F.element_at(token, -1)))
    )
    return fill_down(marked, ["file"], "line_no", ["gloss", "group_no"])


def read_forms(lines: DataFrame, repeated: str = "last") -> DataFrame:
    """(gloss, group_id, language, lang_no, word) of the form lines.

    Words of group 1 are unrelated to each other: each line gets a group of its own,
    numbered in file order. Of several words of a language in a group the last line counts, and a
    gloss that a file opens again starts anew; ``repeated="all"`` keeps every line instead.
    """
    if repeated == "all":
        return _all_forms(lines)
    if repeated != "last":
        raise ValueError("repeated must be last or all")
    opened = lines.filter(F.substring("value", 1, 1) == "a").groupBy("file", F.element_at(F.split(F.trim("value"), r"\s+"), 3).alias("gloss"))
    forms = _all_forms(lines).join(opened.agg(F.max("line_no").alias("_opened")), ["file", "gloss"]).filter("line_no > _opened")
    last = F.max_by(F.struct("line_no", "lang_no", "word"), "line_no").alias("_last")
    return (
        forms.groupBy("file", "gloss", "group_id", "language")
        .agg(last)
        .select("file", "_last.line_no", "gloss", "group_id", "language", "_last.lang_no", "_last.word")
    )


def _all_forms(lines: DataFrame) -> DataFrame:
    form = with_headers(lines).filter(F.col("value").startswith("  "))
    single = (F.col("group_no").cast("int") == 1).cast("bigint")
    form = running_total(form, ["file"], "line_no", single, "_singles")
    line = F.rtrim(F.col("value"))
    forms = F.regexp_extract(line, FORM, 5)
    return (
        form.filter(line.rlike(FORM) & ~F.contains(forms, F.lit(".")))
        .select(
            "file",
            "line_no",
            "gloss",
            F.when(single == 1, F.concat_ws("-", "group_no", F.col("_singles").cast("string")))
            .otherwise(F.col("group_no"))
            .alias("group_id"),
            clean_language(F.regexp_extract(line, FORM, 3)).alias("language"),
            F.regexp_extract(line, FORM, 2).alias("lang_no"),
            first_variant(forms).alias("word"),
        )
    )


def read_relations(lines: DataFrame) -> DataFrame:
    """(gloss, group_a, group_b, certainty) of the ``c`` lines: 2 sure, 3 doubtful."""
    rel = with_headers(lines).filter(F.col("kind") == "c")
    token = F.split(F.trim(F.col("value")), r"\s+")
    code = F.element_at(token, 3)
    return rel.select(
        "gloss",
        F.element_at(token, 2).alias("group_a"),
        F.element_at(token, 4).alias("group_b"),
        F.when(code == "2", "sure")
        .when(code == "3", "doubtful")
        .otherwise(F.raise_error(F.concat(F.lit("unknown relation: "), F.col("value"))))
        .alias("certainty"),
    )


def language_order(forms: DataFrame) -> DataFrame:
    """Languages by their number, compared as text; the last number seen wins."""
    return (
        forms.groupBy("language")
        .agg(F.max_by("lang_no", F.struct("file", "line_no")).alias("lang_no"))
        .orderBy("lang_no", "language")
    )
