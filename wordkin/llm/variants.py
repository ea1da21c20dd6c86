"""Spelling variants by a trie over letter-count vectors.

Words that differ by one inserted, deleted or replaced letter differ in their letter counts by at most
one letter too many (surplus) and one too few (deficit). Words are arranged in a trie whose levels are
the counts of successive letter groups. A depth-first walk of two tries in step follows every pair of
branches whose counts keep within a surplus and a deficit of one each; the words of the leaves it
reaches are verified letter by letter.

The trie is dealt over the cluster by its first levels, which count a few wide groups of letters: the
words with the same wide counts are one shard, and a word visits the neighbouring shards that its budget
reaches, each unordered pair in one shard only. Shards of more than BLOCK words are cut into blocks that
meet pairwise, so no task holds a whole shard and nothing is dropped. The number of wide groups grows
with the vocabulary (wide_groups), so that shards do not grow with it.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, that is one Latin-1 byte a letter; only A-Z is lowered.

Defined results: null and empty texts hold no words; copies of rows count as often as they occur; a word
whose near words tie for the largest count takes the smallest in code-point order; an empty table gives
no rows; input columns other than the text and the id are not looked at. Very long words (over WIDE
letters) are compared one by one, shorter ones in matrices.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordkin.llm.common import UPPER
from wordkin.session import cut, small

#: Letter groups of the trie; wide groups are runs of neighbouring ones.
GROUPS = 24
#: Words of one block of a shard.
BLOCK = 2_048
#: Pairs of trie nodes that one step of the walk widens.
STEP = 200_000
WIDE = 48
#: Letters at either end that are compared before whole words.
HALF = 2
#: Words that a counting task holds before it hands on its partial counts.
PARTIAL = 400_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(UPPER, UPPER.lower())
# Rule for the group of a letter: its code point times 7 modulo GROUPS, so that neighbouring letters and the vowels spread.
GROUP_OF = (np.arange(256) * 7 % GROUPS).astype(np.int64)


def count_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): words of at least min_length letters and min_count occurrences.

    Of a word whose crc32 with its document's id is a multiple of every, one letter is left out (0: of none).
    Tasks count their own words first, so a frequent word costs one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "k"])
            held.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                found = Counter(RUN.findall(t.translate(LOWER) if not t.isascii() else t.lower()))
                if every:
                    start = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for w in list(found):
                        h = zlib.crc32(w.encode(), start)
                        if h % every == 0:
                            cut_at = h % len(w)
                            held[w[:cut_at] + w[cut_at + 1 :]] += found.pop(w)
                held.update(found)
                if len(held) >= PARTIAL:
                    yield flush()
        if held:
            yield flush()

    counted = df.select(F.col(doc_id).cast("string"), text).mapInArrow(run, "word string, k long")
    long_enough = counted.where(F.length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.sum("k").alias("n")).where(F.col("n") >= min_count)


def wide_groups(words: int) -> int:
    """How many wide letter groups shard a vocabulary of that many words: so many that usual shards hold about a block."""
    return next((d for d, most in ((2, 20_000), (3, 100_000), (4, 5_000_000), (6, 500_000_000)) if words <= most), 8)


def _neighbours(d: int) -> list[tuple[int, ...]]:
    """Changes of d counts that a surplus and a deficit of one reach, each direction once: none, or a first change of +1."""
    out = [(0,) * d]
    for up in range(d):
        for down in (None, *range(up + 1, d)):
            out.append(tuple(1 if k == up else -1 if k == down else 0 for k in range(d)))
    return out


def letter_counts(words: list[bytes]) -> np.ndarray:
    """One row of GROUPS counts per word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = GROUP_OF[np.frombuffer(b"".join(words), np.uint8)]
    cells = np.repeat(np.arange(len(words)), sizes) * GROUPS + letters
    return np.bincount(cells, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


class CountTrie:
    """The trie of a list of words as arrays: for every level, where the children of a node begin and their counts."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        rows = counts[self.order]
        fresh = np.ones(rows.shape, bool)
        fresh[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
        self.starts, self.counts = [], []
        above = np.zeros(len(rows), bool)
        above[:1] = True
        for level in range(GROUPS):
            begins = np.flatnonzero(fresh[:, level])
            # The children of a node of the level above are those that begin within it.
            self.starts.append(np.append(np.searchsorted(begins, np.flatnonzero(above)), len(begins)))
            self.counts.append(rows[begins, level])
            above = fresh[:, level]
        self.leaves = np.append(np.flatnonzero(above), len(rows))


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of all positions from starts to ends."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def walk(a: CountTrie, b: CountTrie) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in both word lists whose count vectors lie within a surplus and a deficit of one."""
    zero = np.zeros(1, np.int64)
    stack = [(0, zero, zero, zero.astype(np.int8), zero.astype(np.int8))]
    while stack:
        level, x, y, over, under = stack.pop()
        if len(x) > STEP:
            stack += [(level, *(v[k : k + STEP] for v in (x, y, over, under))) for k in range(0, len(x), STEP)]
            continue
        if level == GROUPS:
            owner, left = _spans(a.leaves[x], a.leaves[x + 1])
            again, right = _spans(b.leaves[y[owner]], b.leaves[y[owner] + 1])
            yield a.order[left[again]], b.order[right]
            continue
        owner, left = _spans(a.starts[level][x], a.starts[level][x + 1])
        again, right = _spans(b.starts[level][y[owner]], b.starts[level][y[owner] + 1])
        left, owner = left[again], owner[again]
        gap = b.counts[level][right] - a.counts[level][left]
        over, under = over[owner] + np.maximum(gap, 0), under[owner] + np.maximum(-gap, 0)
        keep = (over <= 1) & (under <= 1)
        if keep.any():
            stack.append((level + 1, left[keep], right[keep], over[keep].astype(np.int8), under[keep].astype(np.int8)))


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Letters:
    """Words as matrices of letters, aligned left and right."""

    def __init__(self, words: list[bytes]):
        self.words, self.sizes = words, np.fromiter(map(len, words), np.int64, len(words))
        fit = [w if len(w) <= WIDE else b"" for w in words]
        self.left = np.frombuffer(b"".join(w.ljust(WIDE, b"\0") for w in fit), np.uint8).reshape(-1, WIDE)
        self.right = np.frombuffer(b"".join(w.rjust(WIDE, b"\0") for w in fit), np.uint8).reshape(-1, WIDE)
        ends = [(w[: HALF].ljust(HALF, b"\0"), w[-HALF:].rjust(HALF, b"\0")) for w in words]
        self.head, self.tail = (np.frombuffer(b"".join(v), np.uint16) for v in zip(*ends)) if ends else (np.zeros(0, np.uint16),) * 2


def verify(a: Letters, b: Letters, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of places hold words one edit apart."""
    ok = np.zeros(len(x), bool)
    # An edit beyond the first letters leaves them equal; an edit within them leaves the last letters of a long word equal.
    likely = np.flatnonzero((a.head[x] == b.head[y]) | (a.tail[x] == b.tail[y]) | (a.sizes[x] <= 2 * HALF))
    ok[likely] = _compare(a, b, x[likely], y[likely])
    return ok


def _compare(a: Letters, b: Letters, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    ok = np.zeros(len(x), bool)
    n, m = a.sizes[x], b.sizes[y]
    wide = (n > WIDE) | (m > WIDE)
    for k in np.flatnonzero(wide):
        ok[k] = one_edit(a.words[x[k]], b.words[y[k]])
    rest = np.flatnonzero(~wide)
    x, y, n, m = x[rest], y[rest], n[rest], m[rest]
    # Equal letters from the left and from the right cover all but the one place that differs.
    differ = a.left[x] != b.left[y]
    front = np.where(differ.any(1), differ.argmax(1), WIDE)
    differ = a.right[x] != b.right[y]
    back = np.where(differ.any(1), differ[:, ::-1].argmax(1), WIDE)
    longest = np.maximum(n, m)
    ok[rest] = (np.abs(n - m) <= 1) & (front < longest) & (front + back >= longest - 1)
    return ok


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every row of vocabulary(word, n): how many words are one edit away, and the
    one of largest n (ties: smallest word)."""
    vocabulary = cut(vocabulary.select("word", "n"))
    spark = vocabulary.sparkSession
    d = wide_groups(vocabulary.count())
    width = GROUPS // d

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            counts = letter_counts(words).reshape(len(words), d, width).sum(2) if words else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts.tolist(), pa.list_(pa.int64()))], names=["word", "n", "own"])

    shards = cut(vocabulary.mapInArrow(measure, "word string, n long, own array<long>"))
    steps = [F.array(*map(F.lit, step)) for step in _neighbours(d)]
    visits = shards.select("word", "n", "own", F.explode(F.array(*steps)).alias("step")).select(
        "word", "n", F.zip_with("own", "step", lambda a, b: (a + b).cast("long")).alias("shard"), F.forall("step", lambda s: s == 0).alias("home")
    )
    # Home words of a shard and its guests are cut into blocks; every block meets the home blocks, two home blocks once.
    sizes = visits.groupBy("shard").agg(
        F.ceil(F.count_if("home") / BLOCK).alias("homes"), F.ceil(F.count_if(~F.col("home")) / BLOCK).alias("guests")
    )
    hashed = F.xxhash64("word")
    sized = visits.join(small(sizes.where("homes > 0")), "shard").withColumn(
        "part", F.when(F.col("home"), F.pmod(hashed, "homes")).otherwise(F.col("homes") + F.pmod(hashed, F.greatest("guests", F.lit(1))))
    )
    others = F.sequence(F.when(F.col("home"), F.col("part")).otherwise(0), F.col("homes") - 1)
    askers = F.filter(F.sequence(F.lit(0).cast("long"), F.col("homes") + F.col("guests") - 1), lambda k: (k <= F.col("part")) | (k >= F.col("homes")))
    asks = sized.select("shard", F.col("part").alias("asker"), F.explode(others).alias("block"), "word", "n", F.lit(False).alias("kept"))
    keeps = sized.where("home").select("shard", F.explode(askers).alias("asker"), F.col("part").alias("block"), "word", "n", F.lit(True).alias("kept"))
    cells = asks.unionByName(keeps)
    found = cells.groupBy("shard", "asker", "block").applyInArrow(_near_in_cell, "word string, near long, best string, best_n long")
    best = found.groupBy("word").agg(
        F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best"))).alias("top")
    )
    joined = vocabulary.join(best, "word", "left")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("top.best").alias("form"), (-F.col("top.k")).alias("form_n")
    )


def _near_in_cell(table: pa.Table) -> pa.Table:
    """Partial results of one cell: for each word the near words it met here, their number and the best."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n, kept = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "kept"))
    asks, keeps = np.flatnonzero(~kept), np.flatnonzero(kept)
    if not len(asks) or not len(keeps):
        return _partial([], np.zeros(0, np.int64), n, np.zeros(0, np.int64))
    at, of = [words[k] for k in asks], [words[k] for k in keeps]
    a, b = Letters(at), Letters(of)
    xs, ys = [], []
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    same = table.column("block")[0] == table.column("asker")[0]
    for x, y in walk(CountTrie(letter_counts(at)), CountTrie(letter_counts(of))):
        if same:
            # Two words of one block meet twice; one meeting counts.
            once = rank[asks[x]] < rank[keeps[y]]
            x, y = x[once], y[once]
        ok = verify(a, b, x, y)
        xs.append(asks[x[ok]])
        ys.append(keeps[y[ok]])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    return _partial(words, np.concatenate([x, y]), n, np.concatenate([y, x]))


def _partial(words: list[bytes], who: np.ndarray, n: np.ndarray, whom: np.ndarray) -> pa.Table:
    if len(who):
        text = np.array(words, object)
        order = sorted(range(len(who)), key=lambda k: (who[k], -n[whom[k]], text[whom[k]]))
        who, whom = who[order], whom[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    near = np.diff(np.append(first, len(who)))
    return pa.table(
        {
            "word": pa.array([words[k].decode("latin-1") for k in who[first]], pa.string()),
            "near": pa.array(near, pa.int64()),
            "best": pa.array([words[k].decode("latin-1") for k in whom[first]], pa.string()),
            "best_n": pa.array(n[whom[first]], pa.int64()),
        }
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root): from every word of links(word, form), which have no cycle, the last form that is reached.

    Every round doubles the length of the steps."""
    at = cut(links.select("word", F.col("form").alias("root")))
    while True:
        far = small(at.select(F.col("word").alias("root"), F.col("root").alias("far")))
        moved = cut(at.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        at = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return at


def variant_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its near word of largest count n, if that is ratio times its
    own at least (else null), and the word that the forms lead to."""
    near = near_words(count_words(df, doc_id, text, every, min_length, min_count))
    strong = F.col("form_n") >= ratio * F.col("n")
    chosen = cut(near.select("word", "n", "n_near", F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")))
    ends = roots(chosen.where(F.col("form").isNotNull()))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
