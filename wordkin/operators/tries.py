"""Alignment sums of whole blocks of words over two prefix tries. No Spark imports: loaded by workers.

All parents of a block are aligned with all children, so cells of the alignment table that belong to the
same two prefixes are the same number for every pair of words with these prefixes. The words of either
side become a trie per block (children also per cost row); one cell per pair of trie nodes is computed,
level by level for all blocks of a slice together, and the score of a pair is read where both words end.
A block of many pairs is a table of its own, of which only two levels of parents are held.
Equal words of a block share their nodes, so no pair is aligned twice under the same costs.
"""

from __future__ import annotations

import numpy as np

# Cells of one slice, and letters of the matrix that words are compared in.
CELLS = 2_000_000
LETTERS = 8_000_000
# Cells of a table of its own that are worked on at a time (small enough for a processor's cache).
CACHED = 100_000


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] numbers, then on from starts[1]."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class PrefixTrie:
    """Tries of many blocks as arrays by depth. Entries (block, row, word) are distinct and sorted, words by rank."""

    def __init__(self, block: np.ndarray, row: np.ndarray, word: np.ndarray, letters: np.ndarray, length: np.ndarray, blocks: int):
        n = len(block)
        sizes = length[word]
        same = np.zeros(n, bool)
        same[1:] = (block[1:] == block[:-1]) & (row[1:] == row[:-1])
        # Letters that an entry has in common with the one before it.
        common = np.full(n, -1)
        at = np.flatnonzero(same)
        step = max(1, LETTERS // max(1, letters.shape[1]))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            differ = letters[word[some]] != letters[word[some - 1]]
            common[some] = np.where(differ.any(1), differ.argmax(1), letters.shape[1])
        self.block, self.row, self.letter, self.above, self.first, self.count = [], [], [], [], [], []
        here = np.full(n, -1)
        for depth in range(int(sizes.max(initial=0)) + 1):
            reach = np.flatnonzero(sizes >= depth)
            fresh = common[reach] < depth
            who = reach[fresh]
            self.block.append(block[who])
            self.row.append(row[who])
            self.letter.append(letters[word[who], depth - 1] if depth else np.zeros(len(who), np.int64))
            self.above.append(here[who])
            count = np.bincount(block[who], minlength=blocks)
            self.count.append(count)
            self.first.append(np.cumsum(count) - count)
            here[reach] = np.cumsum(fresh) - 1
        # Nodes of a block are numbered by depth.
        self.count, self.first = np.array(self.count), np.array(self.first)
        self.offset = np.cumsum(self.count, axis=0) - self.count
        self.size = self.count.sum(axis=0)
        self.local = [np.arange(len(b)) - self.first[d][b] + self.offset[d][b] for d, b in enumerate(self.block)]
        # ``here`` holds the node at the end of every entry's word.
        self.end = self.offset[sizes, block] + here - self.first[sizes, block]

    def local_above(self, depth: int) -> np.ndarray:
        """Numbers of the nodes above those of a depth within their blocks."""
        return self.local[depth - 1][self.above[depth]]


def grid_sums(parents: PrefixTrie, children: PrefixTrie, flat, n: int, ring) -> tuple[np.ndarray, np.ndarray]:
    """(sums over all alignments of the prefixes of every pair of nodes, where the cells of each block begin)."""
    width = children.size
    base = np.cumsum(parents.size * width) - parents.size * width
    cells = int((parents.size * width).sum())
    total, open_ = np.full(cells, ring.zero), np.full(cells, ring.zero)
    starts = [base[b] + parents.local[d] * width[b] for d, b in enumerate(parents.block)]
    fixed = [r * (n * n) for r in children.row]
    inserted = [flat[f + y] for f, y in zip(fixed, children.letter)]
    left_of = [None] + [children.local_above(j) for j in range(1, len(children.block))]
    for i, block in enumerate(parents.block):
        above = starts[i - 1][parents.above[i]] if i else None
        x = parents.letter[i] * n
        for j in range(len(children.block)):
            sizes = children.count[j][block]
            if not sizes.any():
                continue
            shift = children.offset[j][block]
            own = runs(starts[i] + shift, sizes)
            if not i and not j:
                total[own] = open_[own] = ring.one
                continue
            col = runs(children.first[j][block], sizes)
            if i:
                cost = np.repeat(x, sizes) + fixed[j][col]
                deleted = ring.mul(flat[cost], total[runs(above + shift, sizes)])
            if j:
                left = left_of[j][col]
                kept = ring.mul(inserted[j][col], open_[np.repeat(starts[i], sizes) + left])
                if i:
                    matched = ring.mul(flat[cost + children.letter[j][col]], total[np.repeat(above, sizes) + left])
                    kept = ring.add(kept, matched)
                open_[own] = kept
                total[own] = ring.add(kept, deleted) if i else kept
            else:
                total[own] = deleted
    return total, base


def table_sums(parents: PrefixTrie, children: PrefixTrie, p_end: np.ndarray, c_end: np.ndarray, flat, n: int, ring) -> np.ndarray:
    """Sums over all alignments of the words that end at ``p_end`` with those that end at ``c_end``, of tries of one block."""
    fixed, letter = np.concatenate(children.row) * (n * n), np.concatenate(children.letter)
    roots, width = len(children.row[0]), len(fixed)
    left = np.concatenate([np.zeros(roots, np.int64)] + [children.local_above(j) for j in range(1, len(children.block))])
    cols = [slice(at, at + k) for at, k in zip(children.offset[1:, 0], children.count[1:, 0])]
    inserted = flat[fixed + letter]
    steps = max(1, CACHED // width)
    out = np.empty((len(p_end), len(c_end)))
    total = None
    for i, letters in enumerate(parents.letter):
        level = np.empty((len(letters), width))
        if i:
            used, code = np.unique(letters, return_inverse=True)
            # costs of the letters of this level against every node of the children
            deleting = flat[(used * n)[:, None] + fixed]
            matching = flat[(used * n)[:, None] + (fixed + letter)]
        for k in range(0, len(letters), steps):
            some = slice(k, k + steps)
            if i:
                above = total[parents.above[i][some]]
                open_ = np.take(above, left, axis=1)
                open_ = ring.mul(matching[code[some]], open_, out=open_)
                open_[:, :roots] = ring.zero
            else:
                open_ = np.full((len(letters[some]), width), ring.zero)
                open_[:, :roots] = ring.one
            for here in cols:
                kept = ring.mul(inserted[here], np.take(open_, left[here], axis=1))
                open_[:, here] = ring.add(kept, open_[:, here]) if i else kept
            level[some] = ring.add(open_, ring.mul(deleting[code[some]], above, out=above)) if i else open_
        total = level
        done = np.flatnonzero((p_end >= parents.offset[i, 0]) & (p_end < parents.offset[i, 0] + len(letters)))
        out[done] = total[p_end[done] - parents.offset[i, 0]][:, c_end]
    return out


def distinct(block: np.ndarray, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(block, row, word, index): sorted distinct entries and where each given one is among them."""
    order = np.lexsort((word, row, block))
    b, r, w = block[order], row[order], word[order]
    fresh = np.ones(len(b), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (r[1:] != r[:-1]) | (w[1:] != w[:-1])
    index = np.empty(len(b), np.int64)
    index[order] = np.cumsum(fresh) - 1
    return b[fresh], r[fresh], w[fresh], index
