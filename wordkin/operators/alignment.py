"""Alignment sums over Arrow batches: all pairs of a batch advance together in NumPy.

Three layers per cell: last step a match (m), an insertion (i) or a deletion (d). An
insertion may follow a match or an insertion, anything may follow the rest, so gaps are
ordered insertions first and no alignment is counted twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wordkin.operators import tries
from wordkin.operators.costs import CostTable, SparseCells
from wordkin.symbols import EMPTY

CELLS = 1_500_000
SLICE_PAIRS = 400_000
# exp() of this stays a normal double; longer pairs are summed in log space.
PLAIN_LIMIT = 600.0
TINY_COUNT = 1e-7
# Cells of one layer of a chunk whose steps are counted (small enough for a processor's cache), and rows counted together.
COUNT_CELLS = 200_000
COUNT_ROWS = 50_000
# Blocks of fewer pairs, of more cells, or of batches with longer words times words, are scored pair by pair.
TRIE_PAIRS = 16
# Blocks of at least as many pairs are scored one by one, as a table each.
TABLE_PAIRS = 6_000
MAX_TABLE = 64_000_000
# Edit distances: longest word, cells of the table of letters, and pairs that are worked on at a time (small enough for
# a processor's cache).
BITS = 64
MAX_MASKS = 16_000_000
BIT_PAIRS = 32_000
MAX_LETTERS = 40_000_000


class _Plain:
    zero, one = 0.0, 1.0
    add = staticmethod(np.add)
    mul = staticmethod(np.multiply)

    @staticmethod
    def enter(lp):
        return np.exp(lp)

    @staticmethod
    def leave(v):
        with np.errstate(divide="ignore"):
            return np.log(v)

    @staticmethod
    def share(f, b, total, stop):
        return f * b * (1.0 / (total * stop))


class _Log:
    zero, one = -np.inf, 0.0
    add = staticmethod(np.logaddexp)
    mul = staticmethod(np.add)

    @staticmethod
    def enter(lp):
        return lp

    @staticmethod
    def leave(v):
        return v

    @staticmethod
    def share(f, b, total, stop):
        return np.exp(f + b - (total + stop))


class _Words:
    """Flat character codes of distinct words."""

    def __init__(self, column: pa.Array, costs):
        words = column.cast(pa.string()).to_pylist()
        joined = "".join(words)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        self.codes = np.append(costs.encode(points), 0)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if len(words) else np.zeros(0, np.int64)

    def _sort(self):
        """Distinct words in the order of their codes: ranks, letters as one matrix, lengths."""
        width = int(self.length.max(initial=0))
        every = np.full((len(self.length), width), -1, np.int64)
        owner = np.repeat(np.arange(len(self.length)), self.length)
        every[owner, np.arange(len(owner)) - self.start[owner]] = self.codes[:-1]
        order = np.lexsort(every.T[::-1]) if width else np.arange(len(self.length))
        self._rank = np.empty(len(order), np.int64)
        self._rank[order] = np.arange(len(order))
        self._sorted = every[order], self.length[order]

    @property
    def rank(self) -> np.ndarray:
        if not hasattr(self, "_rank"):
            self._sort()
        return self._rank

    @property
    def letters(self) -> np.ndarray:
        return self.rank is not None and self._sorted[0]

    @property
    def sorted_length(self) -> np.ndarray:
        return self._sorted[1]

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """(width, pairs) codes; cells past the end of a word repeat its last position safely."""
        at = self.start[which][None, :] + np.arange(width)[:, None]
        return self.codes[np.minimum(at, len(self.codes) - 1)]


class _Best:
    """Best alignment instead of the sum over all."""

    zero, one = -np.inf, 0.0
    add = staticmethod(np.maximum)
    mul = staticmethod(np.add)

    @staticmethod
    def leave(v):
        return v


def _chunks(lp: np.ndarray, lc: np.ndarray, layers: int):
    """Index chunks of pairs with similar lengths, sized by their cells."""
    order = np.lexsort((lc, lp))
    at = 0
    while at < len(order):
        rows = lp[order[at]] + 1
        size = max(1, CELLS // int((lc.max() + 1) * (rows if layers > 1 else 1)))
        size = min(size, 16384)
        # keep one chunk within about the same parent length
        stop = min(at + size, len(order))
        top = int(np.searchsorted(lp[order[at:stop]], lp[order[at]] + 1, side="right"))
        stop = at + max(top, 1)
        yield order[at:stop]
        at = stop


def _forward(x, y, lp, lc, flat, base, n, ring, keep):
    """Forward sums. Returns per-pair totals (without stop) and, if asked, all layers."""
    width, pairs = y.shape[0], lp.shape[0]
    ins = flat[base + y]
    shape = (width + 1, pairs)
    total = np.full(pairs, ring.zero)
    layers = []
    prev = None
    for i in range(x.shape[0] + 1):
        m = np.full(shape, ring.zero)
        g = np.full(shape, ring.zero)
        if i == 0:
            m[0] = ring.one
            d = np.full(shape, ring.zero)
        else:
            row = base + x[i - 1] * n
            d = ring.mul(flat[row], prev)
            if width:
                m[1:] = ring.mul(flat[row + y], prev[:-1])
        for j in range(1, width + 1):
            g[j] = ring.mul(ins[j - 1], ring.add(g[j - 1], m[j - 1]))
        prev = ring.add(ring.add(m, g), d)
        here = np.flatnonzero(lp == i)
        if len(here):
            total[here] = prev[lc[here], here]
        if keep:
            layers.append((m, g, d))
    return total, layers


def _backward(x, y, lp, lc, flat, base, n, ring, stop):
    width, depth = y.shape[0], x.shape[0]
    pairs = lp.shape[0]
    shape = (width + 1, pairs)
    ins = flat[base + y]
    out = [None] * (depth + 1)
    below_m = np.full(shape, ring.zero)
    below_d = np.full(shape, ring.zero)
    for i in range(depth, -1, -1):
        open_ = np.full(shape, ring.zero)
        if i < depth:
            row = base + x[i] * n
            if width:
                open_[:-1] = ring.mul(flat[row + y], below_m[1:])
            open_ = ring.add(open_, ring.mul(flat[row], below_d))
        ends = np.flatnonzero(lp == i)
        if len(ends):
            open_[lc[ends], ends] = stop[ends]
        g = open_.copy()
        last = lc[ends]
        for j in range(width - 1, -1, -1):
            g[j] = ring.add(open_[j], ring.mul(ins[j], g[j + 1]))
            if len(ends):
                here = ends[last == j]
                g[j, here] = stop[here]
        out[i] = (g, g, open_)
        below_m, below_d = g, open_
    return out


def _ring_for(lp, lc, lowest):
    return _Plain if float((lp + lc).max() + 2) * abs(lowest) < PLAIN_LIMIT else _Log


def distance_costs(words: list[str], weight: float) -> CostTable:
    """Costs whose best alignment is a multiple of the edit distance, for the characters of some words."""
    chars = "\0" + "".join(sorted(set("".join(words)) - {"\0"}))
    n = len(chars)
    if n * n <= CELLS:
        cells = np.full((1, n, n), weight)
        np.fill_diagonal(cells[0], 0.0)
    else:
        cells = SparseCells(n, np.arange(n) * (n + 1), np.zeros(n), np.full(n, weight))
    return CostTable(chars, [], cells, np.zeros(1), True, True, weight)


def edit_distances(words, parent: np.ndarray, sizes: np.ndarray, child: np.ndarray, n: int) -> np.ndarray:
    """Edit distances of word ``parent[k]`` and the next ``sizes[k]`` of the words ``child``, of at most 64 letters each.

    A column of the alignment table is two words of bits, where it grows and where it falls down the child's letters;
    one step of all pairs adds a letter of their parents (Myers' recurrence)."""
    longest = int(words.length.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if longest <= np.dtype(k).itemsize * 8)
    # where every word has every letter
    masks = np.zeros((len(words.length), n), kind)
    for j in range(longest):
        who = np.flatnonzero(words.length > j)
        masks[who, words.codes[words.start[who] + j]] |= kind(1 << j)
    masks = masks.reshape(-1)
    low = np.array([(1 << k) - 1 for k in range(longest + 1)], kind)[words.length]
    # longest parents first, so that those with a letter left are always the first ones
    order = np.argsort(-words.length[parent], kind="stable")
    starts = np.cumsum(sizes) - sizes
    out = np.empty(len(child), np.int64)
    ends = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + BIT_PAIRS, side="right")))
        mine, count = order[at:stop], sizes[order[at:stop]]
        place = tries.runs(starts[mine], count)
        cells = child[place] * n
        length = words.length[parent[mine]]
        up, down = np.full(len(place), ~kind(0), kind), np.zeros(len(place), kind)
        for i in range(int(length.max(initial=0))):
            left = int(np.searchsorted(-length, -i, side="left"))
            letter = words.codes[words.start[parent[mine[:left]]] + i]
            k = int(count[:left].sum())
            same = masks[cells[:k] + np.repeat(letter, count[:left])]
            u, d = up[:k], down[:k]
            across = (((same & u) + u) ^ u) | same
            rise = ((d | ~(across | u)) << kind(1)) | kind(1)
            fall = (u & across) << kind(1)
            same |= d
            np.bitwise_or(fall, ~(same | rise), out=u)
            np.bitwise_and(rise, same, out=d)
        short = low[child[place]]
        out[place] = np.repeat(length, count) + np.bitwise_count(up & short) - np.bitwise_count(down & short).astype(np.int64)
        at = stop
    return out


def score_pairs(words, parent, child, row, costs) -> np.ndarray:
    """Log-likelihood of word indices ``parent[k] -> child[k]`` under cost row ``row[k]``."""
    n = costs.n
    logs, plain, lowest = costs.views()
    out = np.empty(len(parent))
    lp, lc = words.length[parent], words.length[child]
    for pick in _chunks(lp, lc, 1):
        a, b = lp[pick], lc[pick]
        ring = _Best if costs.best else _ring_for(a, b, lowest)
        x = words.padded(parent[pick], int(a.max()))
        y = words.padded(child[pick], int(b.max()))
        flat = plain if ring is _Plain else logs
        total, _ = _forward(x, y, a, b, flat, row[pick] * (n * n), n, ring, False)
        out[pick] = ring.leave(total)
    return out + costs.stop[row]


def slices(batch: pa.RecordBatch):
    """Row slices of a block batch with a bounded number of pairs each."""
    sizes = np.diff(np.asarray(batch.column("parents").offsets, dtype=np.int64)) * np.diff(
        np.asarray(batch.column("children").offsets, dtype=np.int64)
    )
    at = 0
    while at < len(sizes):
        reach = np.searchsorted(np.cumsum(sizes[at:]), SLICE_PAIRS, side="right")
        step = max(1, int(reach))
        yield batch.slice(at, step)
        at += step


def score_blocks(parents: pa.ListArray, children: pa.ListArray, costs) -> pa.ListArray:
    """One score list per block row, parent-major over parents x children."""
    scores, _, _, offsets = score_all(parents, children, costs)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(scores, pa.float64()))


def score_all(parents: pa.ListArray, children: pa.ListArray, costs) -> tuple[np.ndarray, ...]:
    """(score, parent place, child place, offset of each block) of all pairs of a batch of blocks; ``costs`` may be a
    function that gives the costs for a list of words.

    Words of a batch are told apart once. Blocks are scored over prefix tries; a block whose words share too
    little, or whose table would be too large, is scored pair by pair."""
    po = np.asarray(parents.offsets, dtype=np.int64)
    co = np.asarray(children.offsets, dtype=np.int64)
    np_, nc = np.diff(po), np.diff(co)
    offsets = np.concatenate([[0], np.cumsum(np_ * nc)])
    p = parents.values.field("word").slice(po[0], po[-1] - po[0])
    c = children.values.field("word").slice(co[0], co[-1] - co[0])
    both = pa.concat_arrays([p.cast(pa.string()), c.cast(pa.string())]).dictionary_encode()
    index = np.asarray(both.indices, dtype=np.int64)
    if callable(costs):
        costs = costs(both.dictionary.to_pylist())
    words = _Words(both.dictionary, costs)
    pw, cw = index[: len(p)], index[len(p) :]
    if costs.shared:
        row = np.zeros(len(cw), dtype=np.int64)
    else:
        nodes = children.values.field("node_id").slice(co[0], co[-1] - co[0]).dictionary_encode()
        row = costs.row_of(nodes.dictionary.to_pylist())[np.asarray(nodes.indices, dtype=np.int64)]
    out = np.empty(offsets[-1])
    block = np.arange(len(np_))
    pb, cb = np.repeat(block, np_), np.repeat(block, nc)
    size = np_ * nc
    pi = np.repeat(np.arange(len(pw)), nc[pb])
    ci = tries.runs((co[:-1] - co[0])[pb], nc[pb])
    longest = int(words.length.max(initial=0))
    if costs.step is not None and longest <= BITS and len(words.length) * costs.n <= MAX_MASKS:
        return costs.step * edit_distances(words, pw, nc[pb], cw[ci], costs.n), pi, ci, offsets
    ends = words.length + 1
    weight = [np.bincount(b, weights=ends[w], minlength=len(block)) for b, w in ((pb, pw), (cb, cw))]
    table = weight[0] * weight[1]
    alone = (np_ * nc < TRIE_PAIRS) | (table > MAX_TABLE) | (longest * len(words.length) > MAX_LETTERS)
    large = ~alone & (size >= TABLE_PAIRS)
    for b in np.flatnonzero(large):
        mine = [slice(o[b] - o[0], o[b + 1] - o[0]) for o in (po, co)]
        out[offsets[b] : offsets[b + 1]] = _score_table(words, pw[mine[0]], cw[mine[1]], row[mine[1]], costs)
    at = tries.runs(offsets[:-1][alone], size[alone])
    if len(at):
        out[at] = score_pairs(words, pw[pi[at]], cw[ci[at]], row[ci[at]], costs)
    for some in _table_slices(np.flatnonzero(~alone & ~large & (size > 0)), table):
        at = tries.runs(offsets[:-1][some], size[some])
        if len(at):
            out[at] = _score_tables(words, some, pb, pw, cb, cw, row, pi[at], ci[at], costs)
    return out, pi, ci, offsets


def _ring_of(depth: int, lowest: float, costs):
    return _Best if costs.best else _Plain if (depth + 2) * abs(lowest) < PLAIN_LIMIT else _Log


def _score_table(words, parent, child, row, costs) -> np.ndarray:
    """Scores of all pairs of one block, parent-major."""
    sides, ends = [], []
    for w, r in ((parent, np.zeros(len(parent), np.int64)), (child, row)):
        db, dr, dw, where = tries.distinct(np.zeros(len(w), np.int64), r, words.rank[w])
        trie = tries.PrefixTrie(db, dr, dw, words.letters, words.sorted_length, 1)
        sides.append(trie)
        ends.append(trie.end[where])
    logs, plain, lowest = costs.views()
    ring = _ring_of(sum(len(t.block) - 1 for t in sides), lowest, costs)
    sums = tries.table_sums(*sides, *ends, plain if ring is _Plain else logs, costs.n, ring)
    return (ring.leave(sums) + costs.stop[row]).reshape(-1)


def _table_slices(blocks: np.ndarray, table: np.ndarray):
    """Blocks cut into runs with a bounded number of cells (if no prefixes were shared)."""
    part = np.cumsum(table[blocks]) // (4 * tries.CELLS)
    return np.split(blocks, np.flatnonzero(np.diff(part)) + 1)


def _score_tables(words, blocks, pb, pw, cb, cw, row, pi, ci, costs) -> np.ndarray:
    """Scores of the pairs (pi, ci) of some blocks, all of whose words become tries."""
    local = np.full(max(pb.max(), cb.max()) + 1, -1)
    local[blocks] = np.arange(len(blocks))
    sides, ends = [], []
    for b, w, r in ((pb, pw, np.zeros(len(pw), np.int64)), (cb, cw, row)):
        mine = np.flatnonzero(local[b] >= 0)
        db, dr, dw, where = tries.distinct(local[b[mine]], r[mine], words.rank[w[mine]])
        trie = tries.PrefixTrie(db, dr, dw, words.letters, words.sorted_length, len(blocks))
        end = np.empty(len(b), np.int64)
        end[mine] = trie.end[where]
        sides.append(trie)
        ends.append(end)
    n = costs.n
    logs, plain, lowest = costs.views()
    deepest = sum(len(t.block) - 1 for t in sides)
    ring = _ring_of(deepest, lowest, costs)
    total, base = tries.grid_sums(*sides, plain if ring is _Plain else logs, n, ring)
    here = local[pb[pi]]
    return ring.leave(total[base[here] + ends[0][pi] * sides[1].size[here] + ends[1][ci]]) + costs.stop[row[ci]]


def gathered(batches, rows: int = COUNT_ROWS):
    """Batches put together until they hold a number of rows."""
    some, held = [], 0
    for batch in batches:
        some.append(batch)
        held += batch.num_rows
        if held >= rows:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, held = [], 0
    if held:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _even_chunks(lp: np.ndarray, lc: np.ndarray):
    """Index chunks of pairs with one parent length and similar child lengths, of at most ``COUNT_CELLS`` cells."""
    order = np.lexsort((lc, lp))
    lp, lc = lp[order], lc[order]
    ends = np.append(np.flatnonzero(np.diff(lp)) + 1, len(lp))
    at = 0
    while at < len(order):
        end = int(ends[np.searchsorted(ends, at, side="right")])
        cells = np.arange(1, end - at + 1) * (lc[at:end] + 1) * (lp[at] + 1)
        stop = at + max(1, int(np.searchsorted(cells, COUNT_CELLS, side="right")))
        yield order[at:stop]
        at = stop


def _cell_sums(words, parent, child, row, node, weight, nodes: int, costs) -> np.ndarray:
    """Weighted steps of all alignments, summed by flat (node, x, y). Rows of one pair under the same costs are aligned once."""
    n, size = costs.n, len(words.length)
    logs, plain, lowest = costs.views()
    _, first, of, times = np.unique((row * size + parent) * size + child, return_index=True, return_inverse=True, return_counts=True)
    owned = np.argsort(of, kind="stable")
    starts = np.cumsum(times) - times
    sums = np.zeros(nodes * n * n)
    lp, lc = words.length[parent[first]], words.length[child[first]]
    for pick in _even_chunks(lp, lc):
        a, b = lp[pick], lc[pick]
        lead = first[pick]
        ring = _ring_for(a, b, lowest)
        x = words.padded(parent[lead], int(a.max()))
        y = words.padded(child[lead], int(b.max()))
        flat = plain if ring is _Plain else logs
        base = row[lead] * (n * n)
        stop = ring.enter(costs.stop[row[lead]])
        total, fwd = _forward(x, y, a, b, flat, base, n, ring, True)
        bwd = _backward(x, y, a, b, flat, base, n, ring, stop)
        mine = owned[tries.runs(starts[pick], times[pick])]
        at = np.repeat(np.arange(len(pick)), times[pick])
        plane, w = node[mine] * (n * n), weight[mine]
        inserted = np.zeros((y.shape[0] + 1, len(mine)))

        def share(i, layer):
            post = ring.share(fwd[i][layer], bwd[i][layer], total, stop)
            # cells beyond the end of a word have no way to its end, so their share is 0
            return np.where(post > TINY_COUNT, post, 0.0)[:, at]

        def add(cells, post):
            seen = post != 0
            np.add(sums, np.bincount(cells[seen], (post * w)[seen], len(sums)), out=sums)

        for i in range(x.shape[0] + 1):
            if y.shape[0]:
                inserted += share(i, 1)
            if not i:
                continue
            above = plane + x[i - 1][at] * n
            add(above, share(i, 2).sum(0))
            if y.shape[0]:
                add(above + y[:, at], share(i, 0)[1:])
        if y.shape[0]:
            add(plane + y[:, at], inserted[1:])
    return sums


def count_batch(batch: pa.RecordBatch, costs, per_pair: bool) -> pa.RecordBatch:
    """Expected alignment counts of a batch of (node_id, parent, child[, weight])."""
    n = costs.n
    logs, plain, lowest = costs.views()
    both = pa.concat_arrays(
        [batch.column("parent").cast(pa.string()), batch.column("child").cast(pa.string())]
    ).dictionary_encode()
    index = np.asarray(both.indices, dtype=np.int64)
    words = _Words(both.dictionary, costs)
    rows = batch.num_rows
    parent, child = index[:rows], index[rows:]
    nodes = batch.column("node_id").dictionary_encode()
    node_of = np.asarray(nodes.indices, dtype=np.int64)
    row = costs.row_of(nodes.dictionary.to_pylist())[node_of]
    weight = None if per_pair else batch.column("weight").to_numpy(zero_copy_only=False)
    if not per_pair and len(nodes.dictionary) * n * n <= CELLS:
        sums = _cell_sums(words, parent, child, row, node_of, weight, len(nodes.dictionary), costs)
        key = np.flatnonzero(sums)
        return _count_rows([nodes.dictionary], ["node_id"], key, sums[key], costs)
    lp, lc = words.length[parent], words.length[child]
    who, xs, ys, cnt = [], [], [], []
    for pick in _chunks(lp, lc, 6):
        a, b = lp[pick], lc[pick]
        ring = _ring_for(a, b, lowest)
        x = words.padded(parent[pick], int(a.max()))
        y = words.padded(child[pick], int(b.max()))
        flat = plain if ring is _Plain else logs
        base = row[pick] * (n * n)
        stop = ring.enter(costs.stop[row[pick]])
        total, fwd = _forward(x, y, a, b, flat, base, n, ring, True)
        bwd = _backward(x, y, a, b, flat, base, n, ring, stop)
        for i in range(x.shape[0] + 1):
            for layer in range(3):
                if (layer != 1 and i == 0) or (layer == 0 and y.shape[0] == 0):
                    continue
                post = ring.share(fwd[i][layer], bwd[i][layer], total, stop)
                # cells beyond the end of a word have no way to its end, so their share is 0
                j, k = np.nonzero(post > TINY_COUNT)
                if layer != 2:
                    k, j = k[j > 0], j[j > 0]
                who.append(pick[k])
                xs.append(x[i - 1, k] if layer != 1 else np.zeros(len(k), np.int64))
                ys.append(y[j - 1, k] if layer != 2 else np.zeros(len(k), np.int64))
                cnt.append(post[j, k])
    if who:
        who, xs, ys, cnt = map(np.concatenate, (who, xs, ys, cnt))
    else:
        who = xs = ys = np.zeros(0, np.int64)
        cnt = np.zeros(0)
    group = who if per_pair else node_of[who]
    if weight is not None:
        cnt = cnt * weight[who]
    cell = (group * n + xs) * n + ys
    key, inverse = np.unique(cell, return_inverse=True)
    sums = np.bincount(inverse, weights=cnt, minlength=len(key))
    if per_pair:
        return _count_rows([batch.column(c) for c in ("node_id", "parent", "child")], ["node_id", "parent", "child"], key, sums, costs)
    return _count_rows([nodes.dictionary], ["node_id"], key, sums, costs)


def _count_rows(heads: list, names: list[str], key: np.ndarray, sums: np.ndarray, costs) -> pa.RecordBatch:
    """Rows of the flat keys (place in the heads, x, y) and their sums."""
    n = costs.n
    symbol = pa.array([EMPTY] + list(costs.chars[1:]))
    g = pa.array(key // (n * n))
    steps = [symbol.take(pa.array(key // n % n)), symbol.take(pa.array(key % n)), pa.array(sums)]
    return pa.RecordBatch.from_arrays([h.take(g) for h in heads] + steps, names=[*names, "x", "y", "cnt"])
