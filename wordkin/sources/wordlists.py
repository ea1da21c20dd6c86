"""Wide word lists: one line per gold group, one column per language, '?' for a hole.

Long form used everywhere else:
``words(slot string, language string, word string, gold_id, obs_id string)``.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordkin.functions.text import HOLE, gloss_of
from wordkin.session import small
from wordkin.sources.treetext import read_trees

NO_GLOSS = "None"


@dataclass(frozen=True)
class Dataset:
    """Words, the tree of their languages, and the column languages in file order.

    ``base`` is the dataset as read, before any restriction to a subtree.
    """

    words: DataFrame
    tree: DataFrame
    languages: list[str]
    base: "Dataset | None" = None


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a UTF-8 file with an increasing (not gap-free) line number."""
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line_no"), F.rtrim(F.col("value")).alias("value")
    )


def data_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Drop comment lines and empty lines."""
    return lines.filter(~F.col(value).startswith("#") & (F.col(value) != ""))


def header_languages(header: DataFrame, value: str = "value") -> DataFrame:
    """(pos, language) from header lines such as ``# es it la pt``."""
    cells = F.split(F.trim(F.col(value)), r"\s+")
    keep = [c for c in header.columns if c != value]
    return header.select(*keep, F.posexplode(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).alias("pos", "language"))


def parse_wide(
    lines: DataFrame,
    languages: list[str],
    has_gloss: bool = False,
    line: str = "line_no",
    value: str = "value",
    truncate: bool = False,
) -> DataFrame:
    """Unpivot wide lines to long words. Narrow: no shuffle, one pass over the text."""
    cells = F.split(F.trim(F.col(value)), r"\s+")
    rows = data_lines(lines, value).select(F.col(line).alias("gold_id"), cells.alias("_cells"))
    if has_gloss:
        rows = rows.select(
            "gold_id",
            gloss_of(F.element_at("_cells", 1)).alias("slot"),
            F.slice("_cells", 2, F.size("_cells") - 1).alias("_cells"),
        )
    else:
        warnings.warn("no gloss column: every word shares one slot, pair work is quadratic in it")
        rows = rows.select("gold_id", F.lit(NO_GLOSS).alias("slot"), "_cells")
    names = F.array(*[F.lit(x) for x in languages])
    width = F.lit(len(languages))
    if not truncate:
        rows = rows.withColumn(
            "_cells",
            F.when(F.size("_cells") == width, F.col("_cells")).otherwise(
                F.raise_error(
                    F.format_string(
                        "line %s has %s word cells, expected %s",
                        F.col("gold_id").cast("string"), F.size("_cells").cast("string"), width.cast("string"),
                    )
                ).cast("array<string>")
            ),
        )
    zipped = F.arrays_zip(
        F.slice(F.col("_cells"), 1, width).alias("word"),
        F.slice(names, 1, F.least(F.size("_cells"), width)).alias("language"),
    )
    return (
        rows.select("gold_id", "slot", F.posexplode(zipped).alias("pos", "_c"))
        .select(
            "slot",
            F.col("_c.language").alias("language"),
            F.col("_c.word").alias("word"),
            "gold_id",
            F.concat_ws(":", F.col("gold_id").cast("string"), F.col("pos").cast("string")).alias("obs_id"),
        )
        .filter((F.col("word") != HOLE) & (F.col("word") != ""))
    )


def infer_languages(spark: SparkSession, path: str) -> list[str]:
    """Languages of the header, the first ``#`` line of a file; headers of several files must agree."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = lines.filter(F.col("value").startswith("#")).groupBy("file").agg(F.min_by("value", "at").alias("value"))
    headers = first.select("value").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError(f"{path}: expected one header line, found {len(headers) or 'none'}{' or more' if headers else ''}")
    return headers[0].value.split()[1:] if headers[0].value[1:2] in ("", " ", "\t") else headers[0].value[1:].split()


def read_wordlist(
    spark: SparkSession,
    path: str,
    languages: list[str] | None = None,
    has_gloss: bool = False,
    truncate: bool = False,
) -> DataFrame:
    languages = languages or infer_languages(spark, path)
    return parse_wide(text_lines(spark, path), languages, has_gloss, truncate=truncate)


def load_dataset(
    spark: SparkSession,
    words_path: str,
    tree_path: str,
    languages: list[str] | None = None,
    has_gloss: bool = False,
    truncate: bool = False,
) -> Dataset:
    languages = languages or infer_languages(spark, words_path)
    words = read_wordlist(spark, words_path, languages, has_gloss, truncate)
    texts = spark.read.text(tree_path, wholetext=True).select(
        F.lit("tree").alias("tree_id"), F.col("value").alias("text")
    )
    return Dataset(words, read_trees(texts, style="lisp"), languages)


def configured_dataset(base: Dataset, subtree: str | None = None, filter_leaves: bool = False) -> Dataset:
    """Tree cut down to the subtree with the given label; words optionally to its leaves."""
    from wordkin.operators.trees import leaf_words, subtree_at

    tree = subtree_at(base.tree, subtree) if subtree else base.tree
    words = leaf_words(base.words, tree) if filter_leaves else base.words
    return Dataset(words, tree, base.languages, base)


def drop_language(words: DataFrame, language: str) -> DataFrame:
    return words.filter(F.col("language") != language)


def wide_lines(
    words: DataFrame, cluster: str, languages: list[str], sep: str = "\t"
) -> DataFrame:
    """One text line per cluster; a language with several words keeps the largest one.

    The per-language pick is a plain aggregate, so a hot cluster is reduced before the
    shuffle and never gathered.
    """
    picks = [
        F.max(F.when(F.col("language") == x, F.col("word"))).alias(f"_w{i}") for i, x in enumerate(languages)
    ]
    cells = [F.coalesce(F.col(f"_w{i}"), F.lit(HOLE)) for i in range(len(languages))]
    return words.groupBy(cluster).agg(*picks).select(cluster, F.concat_ws(sep, *cells).alias("value"))


def vote_words(words: DataFrame, cluster: str, gold_word: str) -> DataFrame:
    """Most frequent gold word of a cluster; ties go to the larger word."""
    n = words.filter(F.col(gold_word).isNotNull()).groupBy(cluster, gold_word).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(F.max_by(gold_word, F.struct("n", gold_word)).alias("vote"))


def wide_lines_with_gold(
    words: DataFrame, cluster: str, languages: list[str], eval_language: str, gold_word: str, sep: str = "\t"
) -> DataFrame:
    """As ``wide_lines``, the evaluation column holding the voted gold word where there is one."""
    voted = (
        vote_words(words, cluster, gold_word)
        .filter(F.col("vote").isNotNull())
        .select(cluster, F.lit(eval_language).alias("language"), F.col("vote").alias("word"))
    )
    own = words.select(cluster, "language", "word")
    kept = own.filter(F.col("language") != eval_language).unionByName(
        own.filter(F.col("language") == eval_language).join(voted.select(cluster), cluster, "left_anti")
    )
    return wide_lines(kept.unionByName(voted), cluster, languages, sep)


def write_wordlist(lines: DataFrame, languages: list[str], path: str) -> None:
    """Header and data files in one folder; the reader finds the header of a folder by its mark, not by order."""
    spark = lines.sparkSession
    header = spark.createDataFrame([("# " + "\t".join(languages),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(path + "/part=0")
    lines.select("value").write.mode("overwrite").text(path + "/part=1")


def gold_word_pairs(words: DataFrame, cluster: str, eval_language: str) -> DataFrame:
    """(language, word, gold_word): the evaluation language's word next to all others.

    A cluster has one word per evaluation language here (the largest), so the join adds
    one column to each row and never multiplies rows.
    """
    gold = (
        words.filter(F.col("language") == eval_language)
        .groupBy(cluster)
        .agg(F.max("word").alias("gold_word"))
    )
    rest = words.filter(F.col("language") != eval_language)
    return rest.join(gold, cluster).select("language", "word", "gold_word")


def clade_lines(words: DataFrame, tree: DataFrame, cluster: str, languages: list[str], sep: str = "\t") -> DataFrame:
    """Wide list limited to a clade's leaves and its root label."""
    from wordkin.operators.trees import clade_vocabulary

    names = clade_vocabulary(tree)
    kept = words.join(small(names), "language", "left_semi")
    return wide_lines(kept, cluster, languages, sep)


def write_iteration(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parameter, likelihood or cluster rows of one iteration, partitioned by it."""
    df.write.mode(mode).partitionBy("iter").parquet(path)
