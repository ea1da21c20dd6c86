"""Alphabets and character models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wordkin.functions.text import EMPTY, boundary_bigrams, chars
from wordkin.operators.wordscore import ScoreTable
from wordkin.session import cut, need_at_most, python_ready, small

# Fixed values of the model: weight of the counts over all nodes, and added mass.
SHARED = 0.5
ADDED = 0.01
# Models up to this size are sent to the tasks as a dense table; larger ones are joined.
TABLE_ROWS = 200_000
TABLE_CELLS = 4_000_000


def alphabet(words: DataFrame) -> DataFrame:
    """(ch, idx), the empty symbol included. Unicode bounds the rows that get numbered."""
    seen = words.select(F.explode(chars(F.col("word"))).alias("ch")).distinct()
    empty = words.sparkSession.createDataFrame([(EMPTY,)], "ch string")
    numbered = Window.orderBy("ch")
    return seen.union(empty).select("ch", (F.row_number().over(numbered) - 1).alias("idx"))


def legal_words(words: DataFrame) -> DataFrame:
    return words.select("slot", "word").distinct()


def bigram_counts(words: DataFrame, node: str = "node_id", weight: Column | None = None) -> DataFrame:
    """(node_id, prev, next, cnt) with both word boundaries; weighted if asked."""
    w = F.lit(1) if weight is None else weight
    if weight is not None:
        # one row a word before it becomes many
        words = words.groupBy(F.col(node), "word").agg(F.sum(w).alias("_w"))
        w = F.col("_w")
    return (
        words.select(F.col(node).alias("node_id"), w.alias("_w"), F.explode(boundary_bigrams(F.col("word"))).alias("b"))
        .groupBy("node_id", F.col("b.prev").alias("prev"), F.col("b.next").alias("next"))
        .agg(F.sum("_w").alias("cnt"))
    )


@dataclass(frozen=True)
class BigramModel:
    """``rows(node_id, prev, next, lp)`` for pairs seen anywhere, ``defaults(node_id, prev, lp)``
    for the rest, and ``uniform`` where even ``prev`` is new. No dense grid is stored. The
    frames carry a broadcast hint if their counted rows allow it."""

    rows: DataFrame | None
    defaults: DataFrame | None
    uniform: float
    table: list = field(default_factory=list, compare=False, repr=False)

    @staticmethod
    def flat(n_chars: int) -> "BigramModel":
        import math

        return BigramModel(None, None, -math.log(n_chars))


def fit_bigrams(counts: DataFrame, nodes: list, n_chars: int) -> BigramModel:
    """ln(own + 0.5 all + 0.01) - ln(total(prev) + 0.01 n), for every node.

    ``counts`` is model-sized (alphabet squared by nodes), whatever the number of words.
    """
    everywhere = counts.groupBy("prev", "next").agg((F.sum("cnt") * F.lit(SHARED)).alias("_all"))
    ids = F.array(*[F.lit(x) for x in nodes])
    mixed = (
        everywhere.withColumn("node_id", F.explode(ids))
        .join(counts, ["node_id", "prev", "next"], "left")
        .withColumn("_c", F.coalesce("cnt", F.lit(0.0)) + F.col("_all"))
    )
    total = mixed.groupBy("node_id", "prev").agg(F.log(F.sum("_c") + F.lit(ADDED * n_chars)).alias("_total"))
    rows = mixed.join(total, ["node_id", "prev"]).select(
        "node_id", "prev", "next", (F.log(F.col("_c") + F.lit(ADDED)) - F.col("_total")).alias("lp")
    )
    defaults = total.select("node_id", "prev", (F.log(F.lit(ADDED)) - F.col("_total")).alias("lp"))
    return BigramModel(small(cut(rows)), small(cut(defaults)), BigramModel.flat(n_chars).uniform)


def score_table(model: BigramModel) -> ScoreTable | None:
    """The model as one dense table for the tasks; None if it is too large for that."""
    if not model.table:
        defaults = model.defaults.limit(TABLE_ROWS + 1).collect()
        ids, chars = sorted({r.node_id for r in defaults}), sorted({r.prev for r in defaults} - {EMPTY})
        n = len(chars) + 2
        if len(defaults) > TABLE_ROWS or len(ids) * n * n > TABLE_CELLS:
            model.table.append(None)
        else:
            at = {ch: i + 1 for i, ch in enumerate(chars)} | {EMPTY: 0}
            node = {x: i for i, x in enumerate(ids)}
            cells = np.full((len(ids) + 1, n, n), model.uniform)
            for r in defaults:
                cells[node[r.node_id], at[r.prev]] = r.lp
            # At most a row for every cell.
            for r in need_at_most(model.rows, TABLE_CELLS, "bigrams"):
                cells[node[r.node_id], at[r.prev], at.get(r.next, n - 1)] = r.lp
            model.table.append(ScoreTable(ids, "".join(chars), cells))
    return model.table[0]


def with_scores(rows: DataFrame, model: BigramModel) -> DataFrame:
    """Add ``lm``, the log-probability of ``word`` at ``node_id``, end included. Narrow: the model goes to the rows."""
    if model.rows is None:
        return rows.withColumn("lm", F.lit(model.uniform) * (F.size(chars(F.col("word"))) + 1))
    table = score_table(model)
    if table is None:
        return rows.join(_joined_scores(rows.select("node_id", "word").distinct(), model), ["node_id", "word"])
    spark = python_ready(rows.sparkSession)
    shared = spark.sparkContext.broadcast(table)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lm = shared.value.score(batch.column(names.index("node_id")), batch.column(names.index("word")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lm)], names=[*names, "lm"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lm", T.DoubleType())]))


def word_scores(items: DataFrame, model: BigramModel) -> DataFrame:
    """(node_id, word, lm): log-probability of each distinct (node_id, word), end included."""
    if model.rows is None:
        return with_scores(items.select("node_id", "word"), model)
    return _joined_scores(items, model)


def _joined_scores(items: DataFrame, model: BigramModel) -> DataFrame:
    """The same by joins, for models of any size."""
    steps = items.select("node_id", "word", F.explode(boundary_bigrams(F.col("word"))).alias("b")).select(
        "node_id", "word", "b.prev", "b.next"
    )
    lp = F.coalesce("_lp", "_default", F.lit(model.uniform))
    return (
        steps.join(model.rows.withColumnRenamed("lp", "_lp"), ["node_id", "prev", "next"], "left")
        .join(model.defaults.withColumnRenamed("lp", "_default"), ["node_id", "prev"], "left")
        .groupBy("node_id", "word")
        .agg(F.sum(lp).alias("lm"))
    )


def conditional_bigrams(counts: DataFrame) -> DataFrame:
    """p(next | prev) without smoothing."""
    total = counts.groupBy("node_id", "prev").agg(F.sum("cnt").alias("_t"))
    return counts.join(small(total), ["node_id", "prev"]).select(
        "node_id", "prev", "next", (F.col("cnt") / F.col("_t")).alias("p")
    )


def unigrams(words: DataFrame, node: str = "node_id") -> DataFrame:
    """(node_id, ch, p, mean_length): character shares and expected word length."""
    c = chars(F.col("word"))
    per = words.groupBy(F.col(node).alias("node_id")).agg(
        F.sum(F.size(c)).alias("_chars"), F.avg(F.size(c).cast("double")).alias("mean_length")
    )
    cnt = (
        words.select(F.col(node).alias("node_id"), F.explode(c).alias("ch"))
        .groupBy("node_id", "ch")
        .agg(F.count("*").alias("cnt"))
    )
    return cnt.join(small(per), "node_id").select("node_id", "ch", (F.col("cnt") / F.col("_chars")).alias("p"), "mean_length")


def positional_unigrams(words: DataFrame, node: str = "node_id") -> DataFrame:
    """(node_id, pos, ch, p): what follows at each position; the empty symbol is stopping there."""
    ends = F.concat(chars(F.col("word")), F.array(F.lit(EMPTY)))
    cnt = (
        words.select(F.col(node).alias("node_id"), F.posexplode(ends).alias("pos", "ch"))
        .groupBy("node_id", "pos", "ch")
        .agg(F.count("*").alias("cnt"))
    )
    total = cnt.groupBy("node_id", "pos").agg(F.sum("cnt").alias("_t"))
    return cnt.join(small(total), ["node_id", "pos"]).select("node_id", "pos", "ch", (F.col("cnt") / F.col("_t")).alias("p"))
