"""Tree relations over ``(tree_id, node_id, parent_id, label, branch_length, ordinal, depth)``.

Loops run over the depth of the trees, never over their rows (closures over its logarithm). Every step is a join or an
aggregate keyed by node, so a tree with many nodes spreads over tasks like any table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordkin.functions.ordered import ranked, running_total
from wordkin.operators.overlap import common_counts
from wordkin.operators.pairs import pair_blocks, with_blocks
from wordkin.session import cut, python_ready, small

MEMBER = ["tree_id", "node_id"]


def tree_depth(tree: DataFrame) -> int:
    return tree.agg(F.max("depth")).first()[0] or 0


def relabel(tree: DataFrame, label: Column) -> DataFrame:
    return tree.withColumn("label", label)


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    inner = tree.filter(F.col("parent_id").isNotNull()).select("tree_id", F.col("parent_id").alias("node_id"))
    return tree.join(inner.distinct(), MEMBER, "left_anti")


def edges(tree: DataFrame) -> DataFrame:
    """(parent label, child label) of every edge."""
    top = tree.select("tree_id", F.col("node_id").alias("parent_id"), F.col("label").alias("parent_label"))
    return tree.join(top, ["tree_id", "parent_id"]).select("tree_id", "parent_label", F.col("label").alias("child_label"))


def closure(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(tree_id, ancestor, descendant, distance, length), each node being its own ancestor.

    Paths double: those shorter than 2^k, lengthened by the jump of 2^k steps from their upper end, are those
    shorter than 2^(k+1). A tree of depth d takes about log2(d) rounds.
    """
    depth = tree_depth(tree) if depth is None else depth
    jump = tree.filter(F.col("parent_id").isNotNull()).select(
        "tree_id", F.col("node_id").alias("ancestor"), F.col("parent_id").alias("_up"), F.col("branch_length").alias("_len")
    )
    out = tree.select(
        "tree_id",
        F.col("node_id").alias("ancestor"),
        F.col("node_id").alias("descendant"),
        F.lit(0).alias("distance"),
        F.lit(0.0).alias("length"),
    )
    reach = 1
    while reach <= depth:
        longer = out.join(jump, ["tree_id", "ancestor"]).select(
            "tree_id",
            F.col("_up").alias("ancestor"),
            "descendant",
            (F.col("distance") + reach).alias("distance"),
            (F.col("length") + F.col("_len")).alias("length"),
        )
        out = out.unionByName(longer)
        reach *= 2
        if reach > depth:
            break
        out = cut(out)
        next_ = jump.select("tree_id", F.col("ancestor").alias("_up"), F.col("_up").alias("_top"), F.col("_len").alias("_more"))
        jump = cut(
            jump.join(next_, ["tree_id", "_up"]).select("tree_id", "ancestor", F.col("_top").alias("_up"), (F.col("_len") + F.col("_more")).alias("_len"))
        )
    return out


def clade_members(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """Long clades: one row per (node, leaf below it). Holds for trees of any size."""
    leaf = leaves(tree).select("tree_id", F.col("node_id").alias("descendant"), F.col("label").alias("leaf"))
    return closure(tree, depth).join(leaf, ["tree_id", "descendant"]).select(
        "tree_id", F.col("ancestor").alias("node_id"), F.col("descendant").alias("leaf_id"), "leaf"
    )


def _leaf_sets(rows: list[dict]) -> dict:
    """Node -> leaf labels below it, of the rows (node_id, parent_id, label) of one tree."""
    up: dict = {}
    for r in rows:
        up.setdefault(r["node_id"], set()).add(r["parent_id"])
    inner = set().union(*up.values())
    found: dict = {}
    for r in rows:
        todo, seen = [r["node_id"]] if r["node_id"] not in inner else [], set()
        while todo:
            node = todo.pop()
            if node is not None and node not in seen:
                seen.add(node)
                found.setdefault(node, set()).update(() if r["label"] is None else (r["label"],))
                todo += up.get(node, ())
    return found


def clades(tree: DataFrame) -> DataFrame:
    """Sorted leaf-label arrays, for samples of trees that each fit one text row: a tree goes to one task whole, in one
    shuffle. ``clade_members`` does the same for trees of any size."""
    python_ready(tree.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in tree.schema.fields}
    whole = (
        tree.where("tree_id is not null and node_id is not null")
        .groupBy("tree_id")
        .agg(F.collect_list(F.struct("node_id", "parent_id", "label")).alias("nodes"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, found = [], [], []
            for k, rows in enumerate(batch.column(1).to_pylist()):
                for node, labels in _leaf_sets(rows).items():
                    at.append(k)
                    ids.append(node)
                    found.append(sorted(labels, key=lambda x: x.encode("utf-8")))
            node_kind = batch.schema.field("nodes").type.value_type.field("node_id").type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, node_kind), pa.array(found, pa.list_(pa.string()))], names=["tree_id", "node_id", "clade"]
            )

    return whole.mapInArrow(run, f"tree_id {kinds['tree_id']}, node_id {kinds['node_id']}, clade array<string>")


def clade_support(clade_rows: DataFrame) -> DataFrame:
    """In how many trees of the sample each clade occurs."""
    return clade_rows.select("tree_id", "clade").distinct().groupBy("clade").agg(F.count("*").alias("support"))


def ranked_support(support: DataFrame) -> DataFrame:
    """Sort order of the consensus: support, then larger clades, then the labels."""
    return support.orderBy(F.desc("support"), F.desc(F.size("clade")), F.asc(F.array_join("clade", "\u0001")))


def clades_agree(a: Column, b: Column) -> Column:
    """Nested or disjoint."""
    common = F.size(F.array_intersect(a, b))
    return (common == 0) | (common == F.size(a)) | (common == F.size(b))


def conflicts_with(clade_rows: DataFrame, family: DataFrame) -> DataFrame:
    """Per clade, with how many clades of a family it conflicts.

    A conflict needs a shared leaf, so the join goes through leaf labels. A conflict-free
    family has few clades per leaf label, which bounds the fan-out by the depth of the family;
    any other family costs one row per pair of clades and leaf that they share. Clades travel
    as numbers, their leaves are never repeated per leaf.
    """
    ours = cut(clade_rows.select("clade").distinct().withColumn("_id", F.monotonically_increasing_id()))
    theirs = cut(family.select("clade").distinct().withColumn("_other", F.monotonically_increasing_id()))
    leaf_of = theirs.select("_other", F.size("clade").alias("_m"), F.explode("clade").alias("_leaf"))
    shared = (
        ours.select("_id", F.size("clade").alias("_n"), F.explode("clade").alias("_leaf"))
        .join(small(leaf_of), "_leaf")
        .groupBy("_id", "_n", "_other", "_m")
        .agg(F.count("*").alias("_common"))
    )
    bad = (F.col("_common") < F.col("_n")) & (F.col("_common") < F.col("_m"))
    found = shared.filter(bad).groupBy("_id").agg(F.count("*").alias("conflicts"))
    return ours.join(found, "_id", "left").select("clade", F.coalesce("conflicts", F.lit(0)).cast("bigint").alias("conflicts"))


# Clades whose conflicts with each other are looked at together.
CONSENSUS_WINDOW = 2_048


def conflict_edges(rows: DataFrame) -> DataFrame:
    """(above, below): ranks of clades of rows(rank, clade) that conflict, the higher-ranked one first. All pairs of the
    given rows are compared, block by block."""
    python_ready(rows.sparkSession)
    sized = with_blocks(rows.select(F.lit("").alias("slot"), F.col("rank").cast("string").alias("word"), "rank", "clade"))
    item = F.struct("rank", "clade")
    blocks = pair_blocks(sized.withColumn("p", item), sized.withColumn("c", item), ["slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above, below = [], []
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = ([x["clade"] for x in side] for side in (left, right))
                common = common_counts(a, b)
                n, m = (np.array([len(x) for x in side]) for side in (a, b))
                i, j = np.nonzero((common > 0) & (common < n[:, None]) & (common < m[None, :]))
                ranks = [np.array([x["rank"] for x in side]) for side in (left, right)]
                i, j = ranks[0][i], ranks[1][j]
                above.append(i[i < j])
                below.append(j[i < j])
            columns = [pa.array(np.concatenate(v) if v else [], pa.int64()) for v in (above, below)]
            yield pa.RecordBatch.from_arrays(columns, names=["above", "below"])

    return blocks.select("parents", "children").mapInArrow(run, "above long, below long")


def first_in_rank(rows: DataFrame) -> DataFrame:
    """The rows(rank, ...) that are kept when each is kept unless it conflicts with one kept before.

    Rows that no live row of higher rank conflicts with are kept together, those in conflict with them dropped, until
    none is live: all on the executors."""
    edges = cut(conflict_edges(rows))
    live = cut(rows.select("rank"))
    kept = live.limit(0)
    while not live.isEmpty():
        blocked = edges.join(live.withColumnRenamed("rank", "above"), "above").select(F.col("below").alias("rank")).distinct()
        free = cut(live.join(blocked, "rank", "left_anti"))
        kept = kept.unionByName(free)
        gone = edges.join(free.withColumnRenamed("rank", "above"), "above").select(F.col("below").alias("rank")).distinct()
        live = cut(live.join(free, "rank", "left_anti").join(gone, "rank", "left_anti"))
    return rows.join(kept, "rank", "left_semi")


def consensus(support: DataFrame, window: int = CONSENSUS_WINDOW) -> DataFrame:
    """Plurality consensus: clades by falling support, each kept if it fits those kept before.

    Rounds take the ``window`` highest live clades, keep the first in rank among them and drop every live clade that
    conflicts with one of those. Kept clades are free of conflicts, so there are fewer than two per leaf label.
    """
    name = F.array_join("clade", "\u0001")
    order = [F.desc("support"), F.desc(F.size("clade")), F.asc(name)]
    live = cut(ranked(support.select("clade", "support"), [], order, -F.col("support"), "rank"))
    kept = live.limit(0)
    while True:
        last = live.select("rank").orderBy("rank").limit(window).agg(F.max("rank")).first()[0]
        if last is None:
            return consensus_parents(cut(kept.select("clade", "support")))
        fresh = cut(first_in_rank(cut(live.where(F.col("rank") <= last))))
        kept = kept.unionByName(fresh)
        rest = live.where(F.col("rank") > last)
        good = conflicts_with(rest, fresh).filter("conflicts = 0").select("clade")
        live = cut(rest.join(good, "clade", "left_semi"))


def consensus_parents(kept: DataFrame) -> DataFrame:
    """Parent of a kept clade = the smallest other kept clade that holds it.

    One leaf is enough to find the candidates: clades with a shared leaf are nested. Clades travel as numbers.
    """
    numbered = cut(kept.withColumn("_id", F.monotonically_increasing_id()))
    a = numbered.select("_id", F.size("clade").alias("_n"), F.element_at("clade", 1).alias("_leaf"))
    b = numbered.select(F.col("_id").alias("_p"), F.size("clade").alias("_m"), F.explode("clade").alias("_leaf"))
    up = a.join(b, "_leaf").filter(F.col("_m") > F.col("_n")).groupBy("_id").agg(F.min_by("_p", "_m").alias("_p"))
    names = numbered.select(F.col("_id").alias("_p"), F.col("clade").alias("parent_clade"))
    return numbered.join(up.join(names, "_p").drop("_p"), "_id", "left").select("clade", "support", "parent_clade")


def clade_times(consensus_rows: DataFrame, node_times: DataFrame) -> DataFrame:
    """Mean time of each consensus clade over the trees; (clade, time) rows come in."""
    mean = node_times.groupBy("clade").agg(F.avg("time").alias("time"))
    return consensus_rows.join(mean, "clade", "left")


def fold_up(
    tree: DataFrame,
    leaf_value: Column,
    combine: Callable[[], Column],
    carry: Callable[[Column], Column] = lambda v: v,
    depth: int | None = None,
) -> DataFrame:
    """Bottom-up fold: ``value`` of a node = ``combine`` over the carried values of its children.

    ``combine`` is an aggregate over the column ``carried``; a child with a third of all
    rows below it costs one partial-aggregate row, not one task.
    """
    tree = cut(tree)
    depth = tree_depth(tree) if depth is None else depth
    base = tree.withColumn("_leaf", leaf_value)
    out = None
    level = None
    for d in range(depth, -1, -1):
        rows = base.filter(F.col("depth") == d)
        if level is None:
            rows = rows.withColumn("value", F.col("_leaf"))
        else:
            up = (
                level.withColumn("carried", carry(F.col("value")))
                .groupBy("tree_id", F.col("parent_id").alias("node_id"))
                .agg(combine().alias("_folded"))
            )
            rows = (
                rows.join(up, MEMBER, "left")
                .withColumn("value", F.coalesce("_folded", "_leaf"))
                .drop("_folded")
            )
        level = rows if d == 0 else cut(rows)
        out = level if out is None else out.unionByName(level)
    return out.drop("_leaf")


def heights(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """Longest and shortest path to a leaf, and the distance from the root (its own length counts)."""
    depth = tree_depth(tree) if depth is None else depth
    pair = fold_up(
        tree,
        F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo")),
        lambda: F.struct(F.max("carried.hi").alias("hi"), F.min("carried.lo").alias("lo")),
        lambda v: F.struct(
            (v["hi"] + F.col("branch_length")).alias("hi"), (v["lo"] + F.col("branch_length")).alias("lo")
        ),
        depth,
    )
    return node_distances(pair, depth).select(
        *MEMBER,
        F.col("value.hi").alias("max_to_leaf"),
        F.col("value.lo").alias("min_to_leaf"),
        "from_root",
    )


def node_distances(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """Top-down running sum of branch lengths."""
    tree = cut(tree)
    depth = tree_depth(tree) if depth is None else depth
    level = tree.filter(F.col("depth") == 0).withColumn("from_root", F.col("branch_length"))
    out = level
    for d in range(1, depth + 1):
        up = level.select("tree_id", F.col("node_id").alias("parent_id"), F.col("from_root").alias("_up"))
        level = (
            tree.filter(F.col("depth") == d)
            .join(up, ["tree_id", "parent_id"])
            .withColumn("from_root", F.col("_up") + F.col("branch_length"))
            .drop("_up")
            .select(*out.columns)
        )
        level = level if d == depth else cut(level)
        out = out.unionByName(level)
    return out


def with_times(tree: DataFrame, root_time: float, depth: int | None = None) -> DataFrame:
    """Node time: the root's time less the branch lengths on the way down."""
    d = node_distances(tree, depth)
    own = F.when(F.col("depth") == 0, F.col("branch_length")).otherwise(0.0)
    roots = d.filter(F.col("depth") == 0).select("tree_id", own.alias("_root_len"))
    return d.join(small(roots), "tree_id").withColumn(
        "time", F.lit(root_time) - (F.col("from_root") - F.col("_root_len"))
    ).drop("from_root", "_root_len")


def visit_order(tree: DataFrame, depth: int | None = None) -> DataFrame:
    """Pre-order and post-order numbers, from subtree sizes instead of a global sort.

    Sizes come bottom-up; each node is then offset by the sizes of its earlier siblings.
    Those prefix sums are chunked, so a node with very many children is still split.
    """
    tree = cut(tree)
    depth = tree_depth(tree) if depth is None else depth
    sizes = fold_up(tree, F.lit(1).cast("bigint"), lambda: F.sum("carried") + 1, depth=depth).withColumnRenamed(
        "value", "_size"
    )
    sizes = running_total(
        sizes.withColumn("_pk", F.coalesce(F.col("parent_id").cast("string"), F.lit("\u0000"))),
        ["tree_id", "_pk"],
        "ordinal",
        F.col("_size"),
        "_earlier",
    ).drop("_pk")
    sizes = cut(sizes)
    level = sizes.filter(F.col("depth") == 0).select(
        "*", F.lit(0).cast("bigint").alias("pre"), F.lit(0).cast("bigint").alias("_off")
    )
    out = level
    for d in range(1, depth + 1):
        up = level.select(
            "tree_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("_pre"), F.col("_off").alias("_poff")
        )
        level = (
            sizes.filter(F.col("depth") == d)
            .join(up, ["tree_id", "parent_id"])
            .withColumn("pre", F.col("_pre") + 1 + F.col("_earlier"))
            .withColumn("_off", F.col("_poff") + F.col("_earlier"))
            .select(*out.columns)
        )
        level = level if d == depth else cut(level)
        out = out.unionByName(level)
    return out.select(
        *tree.columns, "pre", (F.col("_off") + F.col("_size") - 1).alias("post"), F.col("_size").alias("subtree_size")
    )


def first_match(ordered_tree: DataFrame) -> DataFrame:
    """First node of every label in pre-order, with its number."""
    return ordered_tree.groupBy("tree_id", "label").agg(
        F.min_by("node_id", "pre").alias("node_id"), F.min("pre").alias("pre")
    )


def subtree_at(tree: DataFrame, label: str) -> DataFrame:
    """The subtree under the first node with that label, re-rooted at depth 0."""
    order = cut(visit_order(tree))
    top = first_match(order.filter(F.col("label") == label)).select("tree_id", F.col("node_id").alias("_top"))
    lo_hi = order.join(small(top), "tree_id").filter(F.col("node_id") == F.col("_top")).select(
        "tree_id", "_top", F.col("pre").alias("_lo"), (F.col("pre") + F.col("subtree_size")).alias("_hi"),
        F.col("depth").alias("_d"),
    )
    inside = order.join(small(lo_hi), "tree_id").filter((F.col("pre") >= F.col("_lo")) & (F.col("pre") < F.col("_hi")))
    return (
        inside.withColumn(
            "parent_id", F.when(F.col("node_id") == F.col("_top"), F.lit(None)).otherwise(F.col("parent_id"))
        )
        .withColumn("depth", F.col("depth") - F.col("_d"))
        .select(*tree.columns)
    )


def leaf_words(words: DataFrame, tree: DataFrame) -> DataFrame:
    """Words whose language is a leaf of the tree."""
    names = leaves(tree).select(F.col("label").alias("language")).distinct()
    return words.join(small(names), "language", "left_semi")


def clade_vocabulary(tree: DataFrame) -> DataFrame:
    """Leaf labels plus the root label."""
    return (
        leaves(tree)
        .select(F.col("label").alias("language"))
        .union(tree.filter(F.col("depth") == 0).select("label"))
        .distinct()
    )


def observed_nodes(words: DataFrame, tree: DataFrame, depth: int | None = None) -> DataFrame:
    """(slot, node_id): nodes with a word at or below them. Distinct before the lift."""
    seen = words.select("slot", "language").distinct()
    at = leaves(tree).select("tree_id", F.col("node_id").alias("descendant"), F.col("label").alias("language"))
    lifted = closure(tree, depth).join(at, ["tree_id", "descendant"]).select("language", F.col("ancestor").alias("node_id"))
    return seen.join(small(lifted), "language").select("slot", "node_id").distinct()
