"""Belief propagation over all slots at once, as joins and aggregates.

Beliefs and messages are long rows ``(slot, blk, nb, node_id, word, lp)``; an absent row is
minus infinity. ``blk`` is the block of the word in its slot and ``nb`` the number of blocks
of the slot, so per-slot values are joined on (slot, blk) and a hot slot stays split.
Slots never mix. Loops run over tree levels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wordkin.functions.logmath import mixture, responsibility
from wordkin.operators import passes
from wordkin.operators.lexicon import BigramModel, with_scores
from wordkin.operators.pairs import ColumnScorer, as_scorer, count_pairs, diagonal_blocks, pair_blocks, spread, with_blocks
from wordkin.session import cut, need_at_most, small

# Fixed values of the model: beam width, and the smallest weights that are counted.
BEAM = 10.0
TINY_WEIGHT = 1e-8
MAX_TREE_NODES = 100_000
AT = ["slot", "blk", "nb"]
FACTORS = ("mixture", "edit", "bigrams")


@dataclass(frozen=True)
class TreeShape:
    """One language tree as model metadata: a bounded number of nodes, held by the driver."""

    nodes: dict
    root: object
    levels: list
    leaf_of: dict

    @staticmethod
    def of(tree: DataFrame) -> "TreeShape":
        rows = need_at_most(tree.select("node_id", "parent_id", "label", "depth"), MAX_TREE_NODES, "language tree")
        parents = {r.parent_id for r in rows}
        levels: list = [[] for _ in range(max(r.depth for r in rows) + 1)]
        for r in rows:
            levels[r.depth].append(r.node_id)
        return TreeShape(
            {r.node_id: r for r in rows},
            next(r.node_id for r in rows if r.parent_id is None),
            levels,
            {r.label: r.node_id for r in rows if r.node_id not in parents},
        )

    def inner(self, depth: int) -> list:
        leaf = set(self.leaf_of.values())
        return [x for x in self.levels[depth] if x not in leaf]

    def table(self, spark: SparkSession) -> DataFrame:
        kind = "string" if isinstance(self.root, str) else "int"
        return spark.createDataFrame(
            [(r.node_id, r.parent_id, r.label, r.depth) for r in self.nodes.values()],
            f"node_id {kind}, parent_id {kind}, label string, depth int",
        )


@dataclass(frozen=True)
class EdgeModel:
    """Scores of an edge: kept words by ``scorer``, replaced ones by ``bigrams``, mixed with
    the innovation probability of the node (``q0`` where the node has none of its own).

    ``factors`` picks the edge: "mixture" of both, "edit" (every word is kept; the root word is
    scored as an edit of the empty word) or "bigrams" (every word is replaced)."""

    scorer: object
    bigrams: BigramModel
    innovation: dict
    q0: float = 0.4
    semiring: str = "max"
    project_parent: bool = False
    beam: float = BEAM
    factors: str = "mixture"


def observations(words: DataFrame, shape: TreeShape) -> DataFrame:
    """Distinct leaf words with their multiplicity ``n``: equal words multiply equal messages."""
    spark = words.sparkSession
    at = shape.table(spark).filter(F.col("node_id").isin(list(shape.leaf_of.values()))).select(
        F.col("label").alias("language"), "node_id"
    )
    return words.join(small(at, MAX_TREE_NODES), "language").groupBy("slot", "node_id", "word").agg(
        F.count("*").cast("double").alias("n")
    )


class Inference:
    """One E-step over all slots for given parameters."""

    def __init__(self, words: DataFrame, tree: DataFrame, model: EdgeModel, prepared=None):
        self.shape = tree if isinstance(tree, TreeShape) else TreeShape.of(tree)
        self.model = model
        if model.factors not in FACTORS:
            raise ValueError(f"factors must be one of {FACTORS}")
        unread = ColumnScorer(lambda p, c: F.lit(0.0))
        self.scorer = unread if model.factors == "bigrams" else as_scorer(model.scorer)
        self.spark = words.sparkSession
        self.tree = self.shape.table(self.spark)
        self.obs, self.legal, self.pairs = prepared or prepare(words, self.shape)
        self._cache: dict = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    # ---- edge scores -------------------------------------------------------------

    def _children(self, rows: DataFrame, extra: list[str]) -> DataFrame:
        """Pack child rows with the two halves of the mixture: ``keep`` = ln(1-q) and
        ``repl`` = lm + ln q."""
        rows = with_scores(rows, self.model.bigrams)
        if self.model.factors != "mixture":
            repl, keep = F.col("lm"), F.lit(0.0)
        else:
            q: Column = F.lit(self.model.q0)
            if self.model.innovation:
                rows = rows.join(small(self._rates(), MAX_TREE_NODES), "node_id", "left")
                q = F.coalesce(F.col("_q"), q)
            repl, keep = F.col("lm") + F.log(q), F.log(F.lit(1.0) - q)
        return rows.withColumn("c", F.struct("node_id", "word", repl.alias("repl"), keep.alias("keep"), *extra))

    def _rates(self) -> DataFrame:
        """(node_id, _q): the innovation probabilities that nodes have of their own."""
        kind = self.tree.schema["node_id"].dataType.simpleString()
        rows = [(x, float(p)) for x, p in self.model.innovation.items()]
        return self._once("rates", lambda: self.spark.createDataFrame(rows, f"node_id {kind}, _q double"))

    def _scored(self, blocks: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs with ``kept`` and ``repl`` (both with prior) and ``cost`` = their log-sum, or the one
        of them that the model has."""
        kept, repl = F.col("edit") + F.col("c.keep"), F.col("c.repl")
        cost = {"mixture": mixture(F.col("kept"), repl), "edit": F.col("kept"), "bigrams": repl}
        return self.scorer.pairs(blocks, keys).withColumn("kept", kept).withColumn("cost", cost[self.model.factors])

    def _reduces(self) -> bool:
        """Whether the scorer works out a pass inside its tasks, so that no pair becomes a row."""
        return hasattr(self.scorer, "reduced")

    def _kind(self) -> str:
        return self.tree.schema["node_id"].dataType.simpleString()

    def _reduced(self, blocks: DataFrame, keep, ddl: str) -> DataFrame:
        return self.scorer.reduced(blocks, keep, self.model.factors, ddl)

    def _best_rows(self, blocks: DataFrame, down: bool) -> DataFrame:
        kind = blocks.schema["slot"].dataType.simpleString()
        ddl = f"slot {kind}, blk int, nb int, node_id {self._kind()}, word string, top double, lp double, mass double"
        best = F.max("lp") if self.model.semiring == "max" else F.max("top") + F.log(F.sum("mass"))
        rows = self._reduced(blocks, partial(passes.best_rows, down=down), ddl)
        return rows.groupBy(*AT, "node_id", "word").agg(best.alias("lp"))

    def _replaced(self) -> Column:
        """Posterior that a scored pair is a replacement."""
        sure = {"edit": F.lit(0.0), "bigrams": F.lit(1.0)}
        return sure.get(self.model.factors, responsibility(F.col("kept"), F.col("c.repl")))

    def _best(self, lp: Column, shift: Column) -> Column:
        if self.model.semiring == "max":
            return F.max(lp)
        return F.max(shift) + F.log(F.sum(F.exp(lp - shift)))

    def edge_cost_range(self) -> DataFrame:
        """(node_id, slot, word, best, worst): range of an observation's edge cost over all
        legal parents. The costs themselves stay inside the tasks that make them."""
        children = self._children(self.obs, ["n"])
        blocks = pair_blocks(self.legal.withColumn("p", F.struct("word")), children, ["slot"], self.pairs)
        return (
            self._scored(blocks, ["slot"])
            .groupBy(F.col("c.node_id").alias("node_id"), "slot", F.col("c.word").alias("word"))
            .agg(F.max("cost").alias("best"), F.min("cost").alias("worst"))
        )

    # ---- upward ------------------------------------------------------------------

    def leaf_messages(self) -> DataFrame:
        """Message of every leaf to its parent: the observations' scores summed."""

        def make():
            children = self._children(self.obs, ["n"])
            blocks = pair_blocks(self.legal.withColumn("p", F.struct("word", "blk", "nb")), children, ["slot"], self.pairs)
            if self._reduces():
                kind = blocks.schema["slot"].dataType.simpleString()
                rows = self._reduced(blocks, passes.leaf_rows, f"slot {kind}, blk int, nb int, node_id {self._kind()}, word string, lp double")
                return rows.groupBy(*AT, "node_id", "word").agg(F.sum("lp").alias("lp"))
            pairs = self._scored(blocks, ["slot"])
            return pairs.groupBy(
                "slot",
                F.col("p.blk").alias("blk"),
                F.col("p.nb").alias("nb"),
                F.col("c.node_id").alias("node_id"),
                F.col("p.word").alias("word"),
            ).agg(F.sum(F.col("c.n") * F.col("cost")).alias("lp"))

        return self._once("leaf", make)

    def upward(self) -> tuple[DataFrame, DataFrame]:
        """(messages to the parent, beliefs of inner nodes), deepest level first."""
        if "up" in self._cache:
            return self._cache["up"]
        up = self.tree.select("node_id", "parent_id")
        messages = cut(self.leaf_messages())
        beliefs = None
        for d in range(len(self.shape.levels) - 1, -1, -1):
            inner = self.shape.inner(d)
            if not inner:
                continue
            level = cut(
                messages.join(F.broadcast(up.filter(F.col("parent_id").isin(inner))), "node_id")
                .groupBy(*AT, F.col("parent_id").alias("node_id"), "word")
                .agg(F.sum("lp").alias("lp"))
            )
            beliefs = level if beliefs is None else beliefs.unionByName(level)
            if d > 0:
                messages = messages.unionByName(cut(self._project(level)))
        self._cache["up"] = (messages, beliefs)
        return self._cache["up"]

    def _tops(self, beliefs: DataFrame) -> DataFrame:
        """Largest belief per (slot, node), copied to the blocks of the slot."""
        return spread(beliefs.groupBy("slot", "node_id").agg(F.max("lp").alias("top"), F.max("nb").alias("nb")))

    def with_top(self, beliefs: DataFrame) -> DataFrame:
        return beliefs.join(self._tops(beliefs), ["slot", "blk", "node_id"])

    def beam(self, beliefs: DataFrame) -> DataFrame:
        """Beliefs within the beam of the best one of their (slot, node)."""
        return self.with_top(beliefs).filter(F.col("lp") >= F.col("top") - self.model.beam)

    def _project(self, beliefs: DataFrame) -> DataFrame:
        """Message to the parent: best (or log-sum) child word for every legal parent word.

        Child words outside the beam still count for the parent word equal to them.
        """
        keys = ["slot", "node_id"]
        rows = self._children(self.with_top(beliefs), ["lp", "top"])
        near = F.col("lp") >= F.col("top") - self.model.beam
        nodes = beliefs.select("slot", "node_id", "word", "blk", "nb")
        parents = nodes.withColumn("p", F.struct("word", "blk", "nb"))
        wide = pair_blocks(parents, rows.filter(near), keys, self.pairs)
        own = diagonal_blocks(rows.filter(~near), keys, F.struct("word", "blk", "nb"))
        if self._reduces():
            return self._best_rows(wide.unionByName(own), False)
        pairs = self._scored(wide.unionByName(own), keys)
        lp = F.col("c.lp") + F.col("cost")
        return pairs.groupBy(
            "slot", F.col("p.blk").alias("blk"), F.col("p.nb").alias("nb"), "node_id", F.col("p.word").alias("word")
        ).agg(self._best(lp, F.col("c.top")).alias("lp"))

    # ---- root and likelihood -------------------------------------------------------

    def root_message(self) -> DataFrame:
        """Score of every legal word at the root: its bigrams, or its edit from the empty word."""

        def make():
            root = self.legal.withColumn("node_id", F.lit(self.shape.root))
            if self.model.factors == "edit":
                blocks = self._children(root, ["blk", "nb"]).select(
                    "slot", F.array(F.struct(F.lit("").alias("word"))).alias("parents"), F.array("c").alias("children")
                )
                at = [F.col(f"c.{x}").alias(x) for x in ("blk", "nb", "node_id", "word")]
                return cut(self._scored(blocks, ["slot"]).select("slot", *at, F.col("cost").alias("lp")))
            return with_scores(root, self.model.bigrams).select(*AT, "node_id", "word", F.col("lm").alias("lp"))

        return self._once("rootmsg", make)

    def root_belief(self) -> DataFrame:
        _, beliefs = self.upward()
        keys = [*AT, "node_id", "word"]
        return product(beliefs.filter(F.col("node_id") == F.lit(self.shape.root)), self.root_message(), keys)

    def slot_likelihood(self) -> DataFrame:
        return log_partition(self.root_belief()).select("slot", F.col("lp").alias("log_likelihood"))

    def likelihood(self) -> DataFrame:
        return self.slot_likelihood().agg(F.sum("log_likelihood").alias("log_likelihood"), F.count("*").alias("slots"))

    # ---- downward ----------------------------------------------------------------

    def downward(self) -> DataFrame:
        """Message into every edge from above: the parent's own one plus the siblings' upward
        messages (all of the parent's children less the own one)."""

        def make():
            messages, beliefs = self.upward()
            level = self.root_message()
            out = level
            for d in range(1, len(self.shape.levels)):
                nodes = self.shape.levels[d]
                here = self.tree.filter(F.col("node_id").isin(nodes)).select("node_id", "parent_id")
                above = level
                if self.model.project_parent and d > 1:
                    above = self._project_down(level)
                total = product(above, beliefs, [*AT, "node_id", "word"]).select(
                    *AT, F.col("node_id").alias("parent_id"), "word", F.col("lp").alias("_all")
                )
                level = cut(
                    messages.join(F.broadcast(here), "node_id")
                    .join(total, [*AT, "parent_id", "word"])
                    .select(*AT, "node_id", "word", (F.col("_all") - F.col("lp")).alias("lp"))
                )
                out = out.unionByName(level)
            return out

        return self._once("down", make)

    def _project_down(self, above: DataFrame) -> DataFrame:
        """Best (or log-sum) parent word for every legal child word, through the node's edge."""
        keys = ["slot", "node_id"]
        top = self.with_top(above)
        near = F.col("lp") >= F.col("top") - self.model.beam
        child = self._children(above.select(*AT, "node_id", "word"), ["blk", "nb"])
        wide = pair_blocks(top.filter(near).withColumn("p", F.struct("word", "lp", "top")), child, keys, self.pairs)
        own = diagonal_blocks(
            top.filter(~near).join(child.select(*AT, "node_id", "word", "c"), [*AT, "node_id", "word"]),
            keys,
            F.struct("word", "lp", "top"),
        )
        if self._reduces():
            return self._best_rows(wide.unionByName(own), True)
        pairs = self._scored(wide.unionByName(own), keys)
        lp = F.col("p.lp") + F.col("cost")
        return pairs.groupBy(
            "slot",
            F.col("c.blk").alias("blk"),
            F.col("c.nb").alias("nb"),
            "node_id",
            F.col("c.word").alias("word"),
        ).agg(self._best(lp, F.col("p.top")).alias("lp"))

    # ---- marginals ---------------------------------------------------------------

    def _edge_children(self) -> DataFrame:
        """Upward beliefs inside the beam: one per observation at leaves, one per inner node.

        ``obs_word`` names the observation, '' for an inner node. ``base`` is a shift for the exponentials of pairs
        that are rows: the middle between a lower and an upper bound of their scores.
        """

        def make():
            _, beliefs = self.upward()
            leaf = self._children(self.obs, ["n"]).select(
                *AT, "node_id", "word", F.col("word").alias("obs_word"), F.lit(0.0).alias("lp"), "n",
                F.col("c.repl").alias("repl"), F.col("c.keep").alias("keep"), (F.col("c.repl") / 2).alias("base"),
            )
            inner = self._children(self.beam(beliefs), ["lp", "top"])
            if self._reduces():
                plain = [F.col("c.repl").alias("repl"), F.col("c.keep").alias("keep"), F.lit(0.0).alias("base")]
                inner = inner.select(*AT, "node_id", "word", F.lit("").alias("obs_word"), "lp", F.lit(1.0).alias("n"), *plain)
                return cut(leaf.unionByName(inner))
            low = spread(
                inner.groupBy("slot", "node_id").agg(
                    F.max(F.col("lp") + F.col("c.repl")).alias("_low"), F.max("nb").alias("nb")
                )
            )
            inner = inner.join(low, ["slot", "blk", "node_id"]).select(
                *AT, "node_id", "word", F.lit("").alias("obs_word"), "lp", F.lit(1.0).alias("n"),
                F.col("c.repl").alias("repl"), F.col("c.keep").alias("keep"),
                ((F.col("top") + F.col("_low")) / 2).alias("base"),
            )
            return cut(leaf.unionByName(inner))

        return self._once("edge_children", make)

    def _edge_parents(self) -> DataFrame:
        return self._once(
            "edge_parents", lambda: cut(self.beam(self.downward()).withColumn("p", F.struct("word", "lp", "top")))
        )

    def _edge_blocks(self, children: DataFrame, extra: list[str]) -> DataFrame:
        packed = children.withColumn(
            "c", F.struct("node_id", "word", "repl", "keep", "lp", "n", "obs_word", "base", *extra)
        )
        return pair_blocks(self._edge_parents(), packed, ["slot", "node_id"], self.pairs)

    def _edge_scores(self, children: DataFrame, extra: list[str]) -> DataFrame:
        return (
            self._scored(self._edge_blocks(children, extra), ["slot", "node_id"])
            .withColumn("score", F.col("p.lp") + F.col("c.lp") + F.col("cost"))
            .withColumn("resp", self._replaced())
        )

    def edge_marginals(self) -> DataFrame:
        """(slot, node_id, obs_word, n, log_z, innovation): partition of each edge's pair
        scores, and the posterior probability that the edge replaced the word."""

        keys = ["slot", "node_id", "obs_word"]

        def summed(scores: DataFrame, shift: Column) -> DataFrame:
            w = F.exp(F.col("score") - shift)
            return scores.groupBy("slot", "node_id", F.col("c.obs_word").alias("obs_word")).agg(
                F.max(shift).alias("_shift"),
                F.sum(w).alias("_z"),
                F.sum(w * F.col("resp")).alias("_zi"),
                F.max("c.n").alias("n"),
            )

        def in_tasks() -> DataFrame:
            """A (maximum, mass relative to it) pair for each observation and block, then put together."""
            blocks = self._edge_blocks(self._edge_children(), [])
            slot = blocks.schema["slot"].dataType.simpleString()
            ddl = f"slot {slot}, node_id {self._kind()}, obs_word string, n double, top double, mass double, replaced double"
            rows = self._reduced(blocks, passes.edge_rows, ddl).withColumn("_max", F.max("top").over(Window.partitionBy(*keys)))
            scale = F.exp(F.col("top") - F.col("_max"))
            sums = rows.groupBy(*keys).agg(
                F.max("n").alias("n"), F.max("_max").alias("_max"), F.sum(scale * F.col("mass")).alias("_z"), F.sum(scale * F.col("replaced")).alias("_zi")
            )
            return cut(sums.select(*keys, "n", (F.col("_max") + F.log("_z")).alias("log_z"), F.try_divide("_zi", "_z").alias("innovation")))

        def make():
            if self._reduces():
                return in_tasks()
            children = self._edge_children()
            guess = cut(summed(self._edge_scores(children, []), F.col("p.top") + F.col("c.base")))
            # The guessed shift spares a pass over the pairs. Edges whose words differ so much in length
            # that it over- or underflows are summed again, relative to their true maximum.
            fine = (F.col("_z") > 1e-280) & (F.col("_z") < 1e280)
            off = guess.filter(~fine | F.isnan("_z")).select(*keys)
            done = guess.filter(fine & ~F.isnan("_z"))
            if off.limit(1).count():
                again = children.join(off, keys, "left_semi")
                top = self._edge_scores(again, []).groupBy("slot", "node_id", F.col("c.obs_word").alias("obs_word"))
                highest = cut(top.agg(F.max("score").alias("_max")))
                exact = self._edge_scores(again.join(highest, keys), ["_max"])
                done = done.unionByName(summed(exact, F.col("c._max")))
            return cut(
                done.select(
                    *keys,
                    "n",
                    (F.col("_shift") + F.log("_z")).alias("log_z"),
                    F.try_divide("_zi", "_z").alias("innovation"),
                )
            )

        return self._once("marginals", make)

    def pair_weights(self) -> DataFrame:
        """(node_id, parent, child, kept_weight, new_weight) summed over slots and observations.

        Weights under the threshold are left out, as in the model. Not written down: rows stay in the tasks that make
        them where no word lies in two slots, since then each is whole; who reads them twice cuts them.
        """

        def whole(rows: DataFrame) -> DataFrame:
            if not self.legal.groupBy("word").count().filter("count > 1").limit(1).count():
                return rows
            return rows.groupBy("node_id", "parent", "child").agg(
                F.sum("kept_weight").alias("kept_weight"), F.sum("new_weight").alias("new_weight")
            )

        def make():
            z = self.edge_marginals().select("slot", "node_id", "obs_word", "log_z")
            rows = self._edge_children()
            leaf = rows.filter(F.col("obs_word") != "").join(z, ["slot", "node_id", "obs_word"])
            per_node = z.filter(F.col("obs_word") == "").drop("obs_word")
            sizes = self.legal.groupBy("slot").agg(F.max("nb").alias("nb"))
            inner = rows.filter(F.col("obs_word") == "").join(
                spread(per_node.join(sizes, "slot")), ["slot", "blk", "node_id"]
            )
            if self._reduces():
                blocks = self._edge_blocks(leaf.unionByName(inner), ["log_z"])
                ddl = f"node_id {self._kind()}, parent string, child string, kept_weight double, new_weight double"
                return whole(self._reduced(blocks, partial(passes.weight_rows, least=TINY_WEIGHT), ddl))
            w = F.exp(F.col("score") - F.col("c.log_z"))
            kept, new = w * (1.0 - F.col("resp")), w * F.col("resp")
            n = F.col("c.n")
            return whole(
                self._edge_scores(leaf.unionByName(inner), ["log_z"])
                .select(
                    "node_id",
                    F.col("p.word").alias("parent"),
                    F.col("c.word").alias("child"),
                    (F.when(kept > TINY_WEIGHT, kept).otherwise(0.0) * n).alias("kept_weight"),
                    (F.when(new > TINY_WEIGHT, new).otherwise(0.0) * n).alias("new_weight"),
                )
                .filter((F.col("kept_weight") > 0) | (F.col("new_weight") > 0))
            )

        return self._once("weights", make)

    def innovation_counts(self) -> DataFrame:
        """(node_id, yes, n): expected replacements and observations, model-sized."""
        return self.edge_marginals().groupBy("node_id").agg(
            F.sum(F.col("innovation") * F.col("n")).alias("yes"), F.sum("n").alias("n")
        )

    def node_beliefs(self) -> DataFrame:
        """Beliefs of inner nodes: the message from above through the node's edge, times the
        upward belief; at the root the root message times the upward belief."""
        _, beliefs = self.upward()
        keys = [*AT, "node_id", "word"]
        at_root = F.col("node_id") == F.lit(self.shape.root)
        inner = [x for d in range(len(self.shape.levels)) for x in self.shape.inner(d) if x != self.shape.root]
        below = product(
            self._project_down(self.downward().filter(F.col("node_id").isin(inner))), beliefs.filter(~at_root), keys
        )
        return self.root_belief().unionByName(below)


def prepare(words: DataFrame, shape: TreeShape) -> tuple[DataFrame, DataFrame, int]:
    """Observations, legal words and their number of pairs; cut once, shared by all iterations."""
    obs = cut(with_blocks(observations(words, shape)))
    legal = cut(obs.select(*AT, "word").distinct())
    return obs, legal, count_pairs(legal, obs)


def product(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Belief product: scores add, words missing on either side drop out."""
    return a.select(*keys, "lp").join(b.select(*keys, F.col("lp").alias("_b")), keys).select(
        *keys, (F.col("lp") + F.col("_b")).alias("lp")
    )


def log_partition(beliefs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """log-sum of the beliefs per (slot, node): a maximum, then a shifted sum."""
    keys = keys or ["slot", "node_id"]
    top = spread(beliefs.groupBy(*keys).agg(F.max("lp").alias("top"), F.max("nb").alias("nb")))
    return (
        beliefs.join(top, [*keys, "blk"])
        .groupBy(*keys)
        .agg((F.max("top") + F.log(F.sum(F.exp(F.col("lp") - F.col("top"))))).alias("lp"), F.max("nb").alias("nb"))
    )


def normalized(beliefs: DataFrame) -> DataFrame:
    """Beliefs less their log partition."""
    z = spread(log_partition(beliefs).withColumnRenamed("lp", "_z"))
    return beliefs.join(z, ["slot", "node_id", "blk"]).withColumn("lp", F.col("lp") - F.col("_z")).drop("_z")


def best_words(beliefs: DataFrame) -> DataFrame:
    """Arg-max word per (slot, node); ties go to the larger word."""
    return beliefs.groupBy("slot", "node_id").agg(
        F.max_by("word", F.struct("lp", "word")).alias("word"), F.max("lp").alias("lp")
    )


def top_words(beliefs: DataFrame, k: int) -> DataFrame:
    """The k best words per (slot, node): k best per block first, then k best of those."""
    order = (F.desc("lp"), F.desc("word"))
    inside = Window.partitionBy("slot", "node_id", "blk").orderBy(*order)
    across = Window.partitionBy("slot", "node_id").orderBy(*order)
    return (
        beliefs.withColumn("_r", F.row_number().over(inside))
        .filter(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(across))
        .filter(F.col("rank") <= k)
        .drop("_r")
    )


def mass_of_top(beliefs: DataFrame, k: int) -> DataFrame:
    """Cumulative posterior mass of the 1..k best words per (slot, node)."""
    run = Window.partitionBy("slot", "node_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return top_words(normalized(beliefs), k).select(
        "slot", "node_id", "rank", "word", F.sum(F.exp("lp")).over(run).alias("mass")
    )


def cut_anchors(inference: Inference, threshold: float = 0.5) -> DataFrame:
    """(slot, language, node_id, anchor): the deepest inner node above a leaf whose edge is cut."""
    shape, spark = inference.shape, inference.spark
    cuts = (
        inference.edge_marginals()
        .filter((F.col("innovation") >= threshold) & (F.col("obs_word") == "") & (F.col("node_id") != F.lit(shape.root)))
        .select("slot", F.col("node_id").alias("ancestor"))
    )
    chain = []
    for label, leaf in shape.leaf_of.items():
        at = shape.nodes[leaf].parent_id
        while at is not None and at != shape.root:
            chain.append((label, leaf, at, shape.nodes[at].depth))
            at = shape.nodes[at].parent_id
    kind = "string" if isinstance(shape.root, str) else "int"
    above = spark.createDataFrame(chain, f"language string, node_id {kind}, ancestor {kind}, depth int")
    return (
        cuts.join(F.broadcast(above) if len(chain) <= MAX_TREE_NODES else above, "ancestor")
        .groupBy("slot", "language", "node_id")
        .agg(F.max_by("ancestor", "depth").alias("anchor"))
    )


def decode(words: DataFrame, inference: Inference, threshold: float = 0.5) -> DataFrame:
    """Clusters: words under the same deepest cut edge; a cut leaf word is alone.

    The anchor of each (slot, leaf) is found on node level, so words only join one row.
    """
    shape, spark = inference.shape, inference.spark
    marks = inference.edge_marginals().filter(F.col("innovation") >= threshold)
    lonely = marks.filter(F.col("obs_word") != "").select(
        "slot", "node_id", F.col("obs_word").alias("word"), F.lit(True).alias("_alone")
    )
    anchors = cut_anchors(inference, threshold).select("slot", "node_id", F.col("anchor").alias("_anchor"))
    sizes = inference.legal.groupBy("slot").agg(F.max("nb").alias("nb"))
    anchors = spread(anchors.join(sizes, "slot"))
    leaf_ids = shape.table(spark).select(F.col("label").alias("language"), "node_id").filter(
        F.col("node_id").isin(list(shape.leaf_of.values()))
    )
    rows = (
        words.join(small(leaf_ids, MAX_TREE_NODES), "language")
        .join(inference.legal, ["slot", "word"])
        .join(lonely, ["slot", "node_id", "word"], "left")
        .join(anchors, ["slot", "node_id", "blk"], "left")
    )
    anchor = F.coalesce(F.col("_anchor"), F.lit(shape.root)).cast("string")
    cluster = F.when(F.col("_alone"), F.concat_ws("|", "slot", F.lit("word"), "obs_id")).otherwise(
        F.concat_ws("|", "slot", F.lit("node"), anchor)
    )
    return rows.select("obs_id", "slot", "language", "word", "gold_id", cluster.alias("cluster_id"))
