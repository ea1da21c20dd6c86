"""Scoring word pairs inside a slot without ever shuffling or storing the pairs.

Words of a slot are cut in blocks of about ``BLOCK`` rows by a hash of the word; almost all
slots are a single block. One row of ``pair_blocks`` holds one block of parents and one
block of children. Pairs exist only inside the task that scans such a row, and the
aggregate that follows combines them there before its shuffle. A hot slot becomes many
independent rows, spread by their own key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wordkin.functions.text import bigram_set, dice
from wordkin.operators import alignment, passes
from wordkin.operators.edit_model import EditModel
from wordkin.session import cut, python_ready, small

BLOCK = 256
PAIRS_PER_TASK = 4_000_000


def tasks_for(spark: SparkSession, pairs: int = 0) -> int:
    """Tasks of a pair stage. Its work is far larger than its bytes, so partitions are set
    by number (adaptive coalescing goes by bytes) and grow with the pairs to score."""
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, min(pairs // PAIRS_PER_TASK, 200_000))


def block_of(n_blocks: Column, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), n_blocks).cast("int")


def with_blocks(rows: DataFrame, key: str = "slot", word: str = "word", block: int = BLOCK) -> DataFrame:
    """Add ``nb`` (blocks of the slot) and ``blk`` (block of the word)."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = sizes.filter(F.col("_n") > block).select(key, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_nb"))
    return (
        rows.join(small(hot), key, "left")
        .withColumn("nb", F.coalesce("_nb", F.lit(1)))
        .withColumn("blk", block_of(F.col("nb"), F.col(word)))
        .drop("_nb")
    )


def spread(stats: DataFrame) -> DataFrame:
    """Copy a per-slot row to every block of its slot, so it can be joined on (slot, blk)."""
    return stats.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb")


def pair_blocks(parents: DataFrame, children: DataFrame, keys: list[str], pairs: int = 0) -> DataFrame:
    """(keys, pb, cb, parents array, children array).

    ``parents(keys, nb, blk, p)`` and ``children(keys, nb, blk, c)`` with struct columns.
    One shuffle groups both sides; each side is copied ``nb`` times, once per opposite block.
    ``pairs`` is the expected number of pairs, if known.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = parents.select(*keys, F.col("blk").alias("pb"), other.alias("cb"), "p")
    right = children.select(*keys, other.alias("pb"), F.col("blk").alias("cb"), "c")
    both = left.unionByName(right, allowMissingColumns=True)
    return (
        both.repartition(tasks_for(parents.sparkSession, pairs), *keys, "pb", "cb")
        .groupBy(*keys, "pb", "cb")
        .agg(F.collect_list("p").alias("parents"), F.collect_list("c").alias("children"))
        .filter((F.size("parents") > 0) & (F.size("children") > 0))
    )


def diagonal_blocks(rows: DataFrame, keys: list[str], p: Column) -> DataFrame:
    """Blocks that hold just a word paired with itself."""
    zero = F.lit(0)
    return rows.select(*keys, zero.alias("pb"), zero.alias("cb"), F.array(p).alias("parents"), F.array("c").alias("children"))


def explode_pairs(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of each block as a stream of (keys, p, c)."""
    return blocks.select(*keys, F.explode("parents").alias("p"), "children").select(
        *keys, "p", F.explode("children").alias("c")
    )


@dataclass(frozen=True)
class ColumnScorer:
    """A scorer that is a column expression of the two words."""

    score: Callable[[Column, Column], Column]

    def pairs(self, blocks: DataFrame, keys: list[str]) -> DataFrame:
        p, c = F.col("p.word"), F.col("c.word")
        return explode_pairs(blocks, keys).withColumn("edit", self.score(p, c))


def _run_blocks(blocks: DataFrame, costs, keep: Callable, factors: str, ddl: str) -> DataFrame:
    """Score the blocks of every batch and keep what ``keep`` makes of their pairs."""
    spark = python_ready(blocks.sparkSession)
    shared = spark.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in alignment.slices(whole):
                scores, p, c, _ = alignment.score_all(batch.column("parents"), batch.column("children"), shared.value)
                yield keep(passes.Pairs(batch, scores, p, c, factors))

    return blocks.mapInArrow(run, ddl)


@dataclass(frozen=True)
class LevenshteinScorer:
    """A multiple of the edit distance of the two words."""

    weight: float

    def pairs(self, blocks: DataFrame, keys: list[str]) -> DataFrame:
        return ColumnScorer(lambda p, c: F.levenshtein(p, c).cast("double") * F.lit(self.weight)).pairs(blocks, keys)

    def reduced(self, blocks: DataFrame, keep: Callable, factors: str, ddl: str) -> DataFrame:
        """Partial rows of a pass over the pairs (see ``passes``)."""
        return _run_blocks(blocks, partial(alignment.distance_costs, weight=self.weight), keep, factors, ddl)


def levenshtein_scorer(weight: float = -4.0) -> LevenshteinScorer:
    return LevenshteinScorer(weight)


def dice_scorer(weight: float = 4.0) -> ColumnScorer:
    return ColumnScorer(lambda p, c: (F.coalesce(dice(bigram_set(p), bigram_set(c)), F.lit(0.0)) - 1.0) * F.lit(weight))


@dataclass(frozen=True)
class EditScorer:
    """Probabilistic edit distance: one score array per block row, pairs stay on the JVM side."""

    model: EditModel
    _costs: list = field(default_factory=list, compare=False)

    def costs(self):
        if not self._costs:
            self._costs.extend(self.model.parts())
        return self._costs

    def _part(self, blocks: DataFrame, keys: list[str], costs) -> DataFrame:
        out = T.StructType(blocks.schema.fields + [T.StructField("_lps", T.ArrayType(T.DoubleType()))])
        spark = python_ready(blocks.sparkSession)
        shared = spark.sparkContext.broadcast(costs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in alignment.slices(whole):
                    lps = alignment.score_blocks(batch.column("parents"), batch.column("children"), shared.value)
                    yield pa.RecordBatch.from_arrays(batch.columns + [lps], names=batch.schema.names + ["_lps"])

        scored = blocks.mapInArrow(run, out)
        n = F.size("children")
        return (
            scored.select(*keys, F.posexplode("parents").alias("_i", "p"), "children", "_lps")
            .select(
                *keys,
                "p",
                F.explode(F.arrays_zip(F.col("children").alias("c"), F.slice("_lps", F.col("_i") * n + 1, n).alias("edit"))).alias("_z"),
            )
            .select(*keys, "p", F.col("_z.c").alias("c"), F.col("_z.edit").alias("edit"))
        )

    def _by_part(self, blocks: DataFrame, score: Callable) -> DataFrame:
        """Union over the cost tables; each scores the children whose nodes it has."""
        parts = self.costs()
        if len(parts) == 1:
            return score(blocks, parts[0])
        out = None
        for part in parts:
            ids = F.array(*[F.lit(x) for x in part.node_ids])
            mine = blocks.withColumn(
                "children", F.filter("children", lambda c: F.array_contains(ids, c["node_id"]))
            ).filter(F.size("children") > 0)
            done = score(mine, part)
            out = done if out is None else out.unionByName(done)
        return out

    def pairs(self, blocks: DataFrame, keys: list[str]) -> DataFrame:
        return self._by_part(blocks, lambda b, costs: self._part(b, keys, costs))

    def reduced(self, blocks: DataFrame, keep: Callable, factors: str, ddl: str) -> DataFrame:
        """Partial rows of a pass over the pairs (see ``passes``)."""
        return self._by_part(blocks, lambda b, costs: _run_blocks(b, costs, keep, factors, ddl))


@dataclass(frozen=True)
class FunctionScorer:
    """Any function of a pair frame (keys, p, c) that adds a column ``edit``."""

    score: Callable[[DataFrame], DataFrame]

    def pairs(self, blocks: DataFrame, keys: list[str]) -> DataFrame:
        return self.score(explode_pairs(blocks, keys))


def as_scorer(scorer) -> ColumnScorer | LevenshteinScorer | EditScorer | FunctionScorer:
    if isinstance(scorer, str):
        return {"levenshtein": levenshtein_scorer, "dice": dice_scorer}[scorer]()
    return FunctionScorer(scorer) if callable(scorer) else scorer


def slot_blocks(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """All parent-child blocks over the distinct words of each slot."""
    legal = with_blocks(cut(words.select("slot", "word").distinct()), block=block)
    p = legal.withColumn("p", F.struct("word"))
    c = legal.withColumn("c", F.struct("word"))
    return pair_blocks(p, c, ["slot"], count_pairs(legal, legal))


def count_pairs(parents: DataFrame, children: DataFrame) -> int:
    """Sum over the slots of parents times children, from one count per slot."""
    both = parents.select("slot", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        children.select("slot", F.lit(0), F.lit(1))
    )
    per = both.groupBy("slot").agg((F.sum("a") * F.sum("b")).alias("n"))
    return int(per.agg(F.sum("n")).first()[0] or 0)


def candidate_summary(words: DataFrame, scorer="levenshtein", block: int = BLOCK) -> DataFrame:
    """Per (slot, word): number of candidate partners, best score and best partner.

    Ties between partners go to the alphabetically first.
    """
    scorer, blocks = as_scorer(scorer), slot_blocks(words, block)
    if isinstance(scorer, LevenshteinScorer):
        kind = blocks.schema["slot"].dataType.simpleString()
        found = scorer.reduced(blocks, passes.partner_rows, "none", f"slot {kind}, word string, candidates long, score double, partner string")
        pick = F.min(F.when(F.col("partner").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("partner").alias("w")))).alias("_b")
        return found.groupBy("slot", "word").agg(F.sum("candidates").alias("candidates"), pick).select(
            "slot", "word", "candidates", (-F.col("_b.s")).alias("score"), F.col("_b.w").alias("partner")
        )
    pairs = scorer.pairs(blocks, ["slot"])
    other = F.col("p.word") != F.col("c.word")
    rank = F.struct(F.col("edit").alias("s"), F.col("c.word").alias("w"))
    best = F.min(F.when(other, F.struct((-rank["s"]).alias("s"), rank["w"].alias("w"))))
    return (
        pairs.groupBy("slot", F.col("p.word").alias("word"))
        .agg(F.count("*").alias("candidates"), best.alias("_b"))
        .select("slot", "word", "candidates", (-F.col("_b.s")).alias("score"), F.col("_b.w").alias("partner"))
    )


def score_pairs(pairs: DataFrame, model: EditModel) -> DataFrame:
    """Log-likelihood of given rows (node_id, parent, child)."""
    keys = ["node_id", "parent", "child"]
    blocks = pairs.repartition(tasks_for(pairs.sparkSession)).select(
        F.array(F.struct(F.col("parent").alias("word"), *keys)).alias("parents"),
        F.array(F.struct("node_id", F.col("child").alias("word"))).alias("children"),
    )
    done = EditScorer(model).pairs(blocks, [])
    return done.select("p.node_id", "p.parent", "p.child", F.col("edit").alias("lp"))


def expected_alignments(pairs: DataFrame, model: EditModel, per_pair: bool = False) -> DataFrame:
    """Posterior alignment counts of rows (node_id, parent, child, weight).

    Per pair: (node_id, parent, child, x, y, cnt). Otherwise (node_id, x, y, cnt), weighted
    and summed, first inside every Arrow batch and then by a plain aggregate.
    """
    ids = pairs.schema["node_id"].dataType.simpleString()
    spark = python_ready(pairs.sparkSession)
    out = None
    parts = model.parts()
    for costs in parts:
        mine = pairs
        if len(parts) > 1:
            mine = pairs.filter(F.col("node_id").isin(list(costs.node_ids)))
        shared = spark.sparkContext.broadcast(costs)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches if per_pair else alignment.gathered(batches):
                yield alignment.count_batch(batch, shared.value, per_pair)

        schema = f"node_id {ids}, " + ("parent string, child string, " if per_pair else "") + "x string, y string, cnt double"
        cols = ["node_id", "parent", "child"] + ([] if per_pair else ["weight"])
        tasks = tasks_for(spark)
        dealt = mine.select(*cols).repartition(tasks)
        if costs.shared and not per_pair:
            # rows of one pair stand together, it is aligned once for all its nodes
            dealt = mine.select(*cols).repartition(tasks, "parent", "child").sortWithinPartitions("parent", "child")
        done = dealt.mapInArrow(run, schema)
        out = done if out is None else out.unionByName(done)
    if per_pair:
        return out
    return out.groupBy("node_id", "x", "y").agg(F.sum("cnt").alias("cnt"))
