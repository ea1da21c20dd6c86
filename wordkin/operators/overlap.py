"""Dice overlap of letter-pair sets inside a slot, without listing pairs that have nothing in common.

Most slots are one block; its sets are compared in one task through the list of sets of every letter
pair. Slots of more than a block get an inverted index where that compares less: a set is sent to the
lists of its rarest letter pairs, as many as any partner of enough overlap must share (prefix filter),
and two sets meet at the first letter pair, in order of rarity, that both have. Lists of frequent letter
pairs are cut in blocks that meet pairwise, so no list is one task. Both sides' best partners come out
of the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wordkin.operators.pairs import pair_blocks, with_blocks
from wordkin.session import cut, python_ready, small

BLOCK = 512
PLAIN_PAIRS = 100
BEST = "side int, id string, partner string, dice double"
EDGES = "left_id string, right_id string, dice double"


def leastcommon_counts(size: Column, threshold: float) -> Column:
    """Common elements that a set of that size needs for the threshold, whatever its partner's size."""
    return F.greatest(F.ceil(size * F.lit(threshold / (2.0 - threshold)) - 1e-9), F.lit(1))


def by_rarity(sets: DataFrame) -> DataFrame:
    """Sort the elements of every set by how many sets of the slot have them, then by name."""
    one = sets.select("slot", "id", "side", F.explode("bigrams").alias("gram"))
    frequency = one.groupBy("slot", "gram").agg(F.count("*").alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct("f", "gram")))
    listed = one.join(small(frequency), ["slot", "gram"]).groupBy("slot", "id", "side").agg(ordered.alias("o"))
    return listed.select("slot", "id", "side", F.transform("o", lambda x: x["gram"]).alias("bigrams"))


def prefix_rows(sets: DataFrame, threshold: float) -> DataFrame:
    """(slot, gram, id, side, bigrams, before): a set once for each element of its prefix, with those before it."""
    n = F.size("bigrams")
    length = (n - leastcommon_counts(n, threshold) + 1).cast("int")
    at = F.posexplode(F.slice("bigrams", 1, length)).alias("i", "gram")
    return sets.select("slot", "id", "side", "bigrams", at).withColumn("before", F.slice("bigrams", F.lit(1), F.col("i"))).drop("i")


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    sized = cut(with_blocks(rows, key, "id", BLOCK))
    item = F.struct("id", "bigrams", "before")
    left, right = sized.where("side = 0").withColumn("p", item), sized.where("side = 1").withColumn("c", item)
    return pair_blocks(left, right, ["slot"] if key == "slot" else ["slot", key])


def overlaps(left: DataFrame, right: DataFrame, threshold: float, best: bool = True) -> DataFrame:
    """Partners with a Dice coefficient of at least threshold (above 0) of (slot, id, bigrams) rows.

    best: (slot, side, id, partner, dice), the best right partner of every left set (side 0) and the best left partner
    of every right one (side 1), ties to the larger id. Otherwise all pairs (slot, left_id, right_id, dice)."""
    python_ready(left.sparkSession)
    every = left.select("slot", "id", "bigrams", F.lit(0).alias("side")).unionAll(right.select("slot", "id", "bigrams", F.lit(1)))
    every = cut(every.where(F.size("bigrams") > 0))
    sizes = every.groupBy("slot").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    wide = cut(sizes.where((F.col("a") + F.col("b") > BLOCK) & (F.col("a") > 0) & (F.col("b") > 0)))
    none = F.array().cast("array<string>").alias("before")
    if wide.isEmpty():
        blocks = _blocks(every.select("*", none), "slot")
    else:
        listed = cut(prefix_rows(by_rarity(every.join(small(wide.select("slot")), "slot", "left_semi")), threshold))
        lists = listed.groupBy("slot", "gram").agg((F.count_if(F.col("side") == 0) * F.count_if(F.col("side") == 1)).alias("n"))
        cheaper = lists.groupBy("slot").agg(F.sum("n").alias("n")).join(wide, "slot").where(F.col("n") < F.col("a") * F.col("b")).select("slot")
        indexed = small(cut(cheaper))
        whole = every.join(indexed, "slot", "left_anti").select("*", none)
        met = listed.join(indexed, "slot", "left_semi").withColumn("list", F.concat("slot", F.lit("\u0001"), "gram"))
        blocks = _blocks(whole, "slot").unionByName(_blocks(met.drop("gram"), "list").drop("list"))
    found = _compared(blocks, threshold, best)
    if not best:
        return found
    rank = F.struct("dice", "partner")
    return found.groupBy("slot", "side", "id").agg(F.max_by("partner", rank).alias("partner"), F.max("dice").alias("dice"))


def _compared(blocks: DataFrame, threshold: float, best: bool) -> DataFrame:
    names = [f.split()[0] for f in (BEST if best else EDGES).split(", ")]
    types = [pa.int32()] * best + [pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, lists, out = batch.column(0).to_pylist(), [[] for _ in names], []
            sides = [_lists(batch.column(i)) for i in (1, 2)]
            for k, slot in enumerate(slots):
                rows = compare(*(s[k] for s in sides), threshold, best)
                out += [slot] * len(rows[0])
                for held, more in zip(lists, rows):
                    held += more
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(pa.array(v, t) for v, t in zip(lists, types))], names=["slot", *names])

    return blocks.select("slot", "parents", "children").mapInArrow(run, "slot string, " + (BEST if best else EDGES))


def _lists(column: pa.ListArray) -> list[list[tuple]]:
    """The (id, bigrams, before) items of every row."""
    at = column.offsets.to_pylist()
    flat = column.values
    ids, grams, before = (flat.field(n).to_pylist() for n in ("id", "bigrams", "before"))
    return [list(zip(ids[a:b], grams[a:b], before[a:b])) for a, b in zip(at, at[1:])]


def compare(left: list[tuple], right: list[tuple], threshold: float, best: bool) -> list[list]:
    """Columns of the best partners, or of all pairs, of one block."""
    left, right = (sorted(side, key=lambda x: x[0].encode("utf-8")) for side in (left, right))
    n, m = len(left), len(right)
    if n * m <= PLAIN_PAIRS:
        dice = np.zeros((n, m))
        sets = [(set(g), set(b)) for _, g, b in right]
        for i, (_, g, b) in enumerate(left):
            g, b = set(g), set(b)
            for j, (h, c) in enumerate(sets):
                if b.isdisjoint(c):
                    dice[i, j] = 2.0 * len(g & h) / (len(g) + len(h))
    else:
        common = common_counts([g for _, g, _ in left], [g for _, g, _ in right])
        sizes = [np.array([len(g) for _, g, _ in side], float) for side in (left, right)]
        dice = 2.0 * common / (sizes[0][:, None] + sizes[1][None, :])
        if any(b for _, _, b in left) and any(b for _, _, b in right):
            dice[common_counts([b for _, _, b in left], [b for _, _, b in right]) > 0] = 0.0
    dice[dice < threshold] = 0.0
    if not best:
        i, j = np.nonzero(dice)
        return [[left[k][0] for k in i], [right[k][0] for k in j], dice[i, j].tolist()]
    out: list[list] = [[], [], [], []]
    for side, own, other, d in ((0, left, right, dice), (1, right, left, dice.T)):
        # Partners are in the order of their ids: of equals the last one counts.
        top = d.shape[1] - 1 - d[:, ::-1].argmax(axis=1)
        for i in np.flatnonzero(d.max(axis=1) > 0):
            out[0].append(side)
            out[1].append(own[i][0])
            out[2].append(other[top[i]][0])
            out[3].append(float(d[i, top[i]]))
    return out


def common_counts(left: list[list], right: list[list]) -> np.ndarray:
    """How many elements each two sets share, through the lists of sets that hold an element."""
    code: dict[str, int] = {}
    tables = []
    for side in (left, right):
        for g in side:
            for x in g:
                code.setdefault(x, len(code))
    for side in (left, right):
        t = np.zeros((len(side), len(code)), np.float32)
        for i, g in enumerate(side):
            t[i, [code[x] for x in g]] = 1.0
        tables.append(t)
    return (tables[0] @ tables[1].T).astype(float)
