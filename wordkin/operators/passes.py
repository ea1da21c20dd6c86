"""What a pass over the pairs of a block keeps, worked out in the task that scores them. No Spark imports.

Each function takes a batch of blocks with the flat scores of their pairs and the places of each pair's
parent and child, and gives partial rows: one per parent and node, per parent, per child, or the few pairs
that carry weight. Pairs themselves never leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


# Sums by (parent, node) are made in one array up to this size.
DENSE = 8_000_000


class Pairs:
    """Flat pairs of a batch: ``p`` and ``c`` are places in the concatenated parent and child lists."""

    def __init__(self, batch: pa.RecordBatch, edit: np.ndarray, p: np.ndarray, c: np.ndarray, factors: str):
        self.batch, self.p, self.c = batch, p, c
        self.parents, self.children = batch.column("parents").flatten(), batch.column("children").flatten()
        self.block = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column("parents").offsets, np.int64)))
        self.child_block = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column("children").offsets, np.int64)))
        self.edit = edit
        if factors == "none":
            return
        self.factors = factors
        self.kept = edit + self.child("keep")[c]
        self.new = self.child("repl")[c]
        self.cost = self.kept if factors == "edit" else log_sum(self.kept, self.new)

    @property
    def replaced(self) -> np.ndarray:
        """Posterior that a pair is a replacement."""
        if self.factors == "edit":
            return np.zeros(len(self.c))
        return 1.0 / (1.0 + np.exp(np.minimum(self.kept - self.new, 700.0)))

    def child(self, name: str) -> np.ndarray:
        return self.children.field(name).to_numpy(zero_copy_only=False).astype(float)

    def parent(self, name: str) -> np.ndarray:
        return self.parents.field(name).to_numpy(zero_copy_only=False).astype(float)

    def keys(self, names: list[str], blocks: np.ndarray) -> list[pa.Array]:
        at = pa.array(blocks, pa.int64())
        return [self.batch.column(n).take(at) for n in names]


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) + exp(b)); many times as fast as ``np.logaddexp``, which does not work on several numbers at once."""
    top = np.maximum(a, b)
    if not len(top) or not np.isfinite(top.min()):
        return np.logaddexp(a, b)
    small = np.minimum(a, b)
    small -= top
    np.exp(small, out=small)
    small += 1.0
    top += np.log(small, out=small)
    return top


def partner_rows(pairs: Pairs) -> pa.RecordBatch:
    """(slot, word, candidates, score, partner): how many children a parent meets, and the best other word (ties: the first)."""
    p, c, edit = pairs.p, pairs.c, pairs.edit
    both = pa.concat_arrays([pairs.parents.field("word").cast(pa.string()), pairs.children.field("word").cast(pa.string())]).dictionary_encode()
    words, index = both.dictionary, np.asarray(both.indices, np.int64)
    rank = np.empty(len(words), np.int64)
    order = np.array(sorted(range(len(words)), key=[w.encode("utf-8") for w in words.to_pylist()].__getitem__), np.int64)
    rank[order] = np.arange(len(order))
    own, other = rank[index[: len(pairs.block)]], rank[index[len(pairs.block) :]]
    apart = np.flatnonzero(own[p] != other[c])
    best = np.full(len(own), -np.inf)
    np.maximum.at(best, p[apart], edit[apart])
    top = apart[edit[apart] == best[p[apart]]]
    first = np.full(len(own), len(order))
    np.minimum.at(first, p[top], other[c[top]])
    none = first == len(order)
    partner = words.take(pa.array(order)).take(pa.array(np.where(none, 0, first), pa.int64(), mask=none))
    return pa.RecordBatch.from_arrays(
        [*pairs.keys(["slot"], pairs.block), pairs.parents.field("word"), pa.array(np.bincount(p, minlength=len(own)), pa.int64()), pa.array(best, mask=none), partner],
        names=["slot", "word", "candidates", "score", "partner"],
    )


def leaf_rows(pairs: Pairs) -> pa.RecordBatch:
    """(slot, blk, nb, node_id, word, lp): summed costs of the observations of a node, for every parent."""
    nodes = pairs.children.field("node_id").dictionary_encode()
    code, k = np.asarray(nodes.indices, np.int64), len(nodes.dictionary)
    cell = pairs.p * k + code[pairs.c]
    values = pairs.child("n")[pairs.c] * pairs.cost
    if len(pairs.block) * k <= DENSE:
        sums = np.bincount(cell, values, len(pairs.block) * k)
        seen = np.flatnonzero(np.bincount(cell, minlength=len(sums)))
        sums = sums[seen]
    else:
        seen, where = np.unique(cell, return_inverse=True)
        sums = np.bincount(where, values, len(seen))
    at = pa.array(seen // k, pa.int64())
    words = [pairs.parents.field(n).take(at) for n in ("blk", "nb")]
    return pa.RecordBatch.from_arrays(
        [*pairs.keys(["slot"], pairs.block[seen // k]), *words, nodes.dictionary.take(pa.array(seen % k, pa.int64())),
         pairs.parents.field("word").take(at), pa.array(sums)],
        names=["slot", "blk", "nb", "node_id", "word", "lp"],
    )


def _highest(place: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Largest value of every place; values of one place that stand together are compared as a run."""
    out = np.full(size, -np.inf)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    if len(starts):
        np.maximum.at(out, place[starts], np.maximum.reduceat(value, starts))
    return out


def best_rows(pairs: Pairs, down: bool) -> pa.RecordBatch:
    """(slot, blk, nb, node_id, word, top, lp, mass): the best pair of every receiving word, and the mass of its pairs
    relative to the best belief. Upwards parents receive from the beliefs of children, downwards the other way."""
    mine, other = (pairs.c, pairs.p) if down else (pairs.p, pairs.c)
    lp, top = (pairs.parent("lp"), pairs.parent("top")) if down else (pairs.child("lp"), pairs.child("top"))
    value = lp[other] + pairs.cost
    held, blocks = (pairs.children, pairs.child_block) if down else (pairs.parents, pairs.block)
    best, shift = _highest(mine, value, len(blocks)), _highest(mine, top[other], len(blocks))
    mass = np.bincount(mine, np.exp(value - shift[mine]), len(blocks))
    at = np.flatnonzero(best > -np.inf)
    take = pa.array(at, pa.int64())
    slot, node = pairs.keys(["slot", "node_id"], blocks[at])
    return pa.RecordBatch.from_arrays(
        [slot, *(held.field(n).take(take) for n in ("blk", "nb")), node, held.field("word").take(take), pa.array(shift[at]), pa.array(best[at]), pa.array(mass[at])],
        names=["slot", "blk", "nb", "node_id", "word", "top", "lp", "mass"],
    )


def edge_rows(pairs: Pairs) -> pa.RecordBatch:
    """(slot, node_id, obs_word, n, top, mass, replaced): mass of the pairs of an observation relative to its best one."""
    score = pairs.parent("lp")[pairs.p] + pairs.child("lp")[pairs.c] + pairs.cost
    names = pairs.children.field("obs_word").dictionary_encode()
    # The pairs of one observation of a block; an inner node's words are one observation.
    cell = pairs.child_block * len(names.dictionary) + np.asarray(names.indices, np.int64)
    seen, of_child = np.unique(cell, return_inverse=True)
    where = of_child[pairs.c]
    top = _highest(where, score, len(seen))
    mass = np.exp(score - top[where])
    n = np.zeros(len(seen))
    np.maximum.at(n, where, pairs.child("n")[pairs.c])
    return pa.RecordBatch.from_arrays(
        [*pairs.keys(["slot", "node_id"], seen // len(names.dictionary)), names.dictionary.take(pa.array(seen % len(names.dictionary), pa.int64())), pa.array(n),
         pa.array(top), pa.array(np.bincount(where, mass, len(seen))), pa.array(np.bincount(where, mass * pairs.replaced, len(seen)))],
        names=["slot", "node_id", "obs_word", "n", "top", "mass", "replaced"],
    )


def weight_rows(pairs: Pairs, least: float) -> pa.RecordBatch:
    """(node_id, parent, child, kept_weight, new_weight) of the pairs with any weight above the least one."""
    score = pairs.parent("lp")[pairs.p] + pairs.child("lp")[pairs.c] + pairs.cost
    w = np.exp(score - pairs.child("log_z")[pairs.c])
    n = pairs.child("n")[pairs.c]
    replaced = pairs.replaced
    kept, new = w * (1.0 - replaced), w * replaced
    at = np.flatnonzero((kept > least) | (new > least))
    p, c = pairs.p[at], pairs.c[at]
    parts = [np.where(v[at] > least, v[at] * n[at], 0.0) for v in (kept, new)]
    return pa.RecordBatch.from_arrays(
        [*pairs.keys(["node_id"], pairs.block[p]), pairs.parents.field("word").take(pa.array(p, pa.int64())), pairs.children.field("word").take(pa.array(c, pa.int64())),
         *map(pa.array, parts)],
        names=["node_id", "parent", "child", "kept_weight", "new_weight"],
    )
