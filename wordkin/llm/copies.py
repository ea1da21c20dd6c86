"""What both duplicate operators share: texts without their exact copies, pair verification, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wordkin.llm.common import words
from wordkin.session import cut, passing_shuffles, small

SHINGLE = 5
#: Members of one group that one task verifies against a copy of the group's first text.
CHUNK = 256
WORD_MEMO = 200_000
#: Bitmaps of row numbers that are broadcast at most, 4 KB each.
BITMAPS = 16_384
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Memo(dict):
    """Hashes of words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8"))
        return h


class Shingler:
    """Hashes of the words of a text and of its five-word shingles. Words are compared in lower case."""

    def __init__(self):
        self.memo = _Memo()

    def words(self, text: str) -> np.ndarray:
        found = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        return np.fromiter(map(self.memo.__getitem__, filter(None, found)), np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, counts): one hash for each window of five words, text after text, and how many
        each text has. A text of fewer words is one shingle, an empty one none."""
        lists = [self.words(t) for t in texts]
        sizes = np.array([len(w) for w in lists], np.int64)
        filled = [np.concatenate([w, np.zeros(SHINGLE - len(w), np.uint64)]) if 0 < len(w) < SHINGLE else w for w in lists]
        held = np.maximum(sizes, np.where(sizes > 0, SHINGLE, 0))
        counts = np.maximum(held - SHINGLE + 1, 0)
        every = np.concatenate(filled) if filled else np.zeros(0, np.uint64)
        n = len(every) - SHINGLE + 1
        if n <= 0:
            return np.zeros(0, np.uint64), counts
        total, mixed = np.zeros(n, np.uint64), mix(every)
        for k in range(SHINGLE):
            total += mixed[k : n + k] * _FACTORS[k]
        # Windows that begin in the last four words of a text would reach into the next one.
        inside = np.ones(len(every), bool)
        ends = np.cumsum(held)[sizes > 0]
        for k in range(1, SHINGLE):
            inside[ends - k] = False
        return mix(total[inside[:n]]), counts


def distinct_texts(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, texts, copies) of a table.

    rows(rid, doc_id, text, row, letters): all rows with a number, the whole input row in a struct. texts(rid, text): rows
    of the first row of each text. copies(rid, of): the other rows and the number of that first one.
    Texts are equal if their words are, in lower case; a null text is an empty one.
    """
    seen = df.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text)).alias("row") if len(df.columns) > 1 else F.lit(None).alias("row"),
    )
    joined = F.array_join(words(F.lower("text")), " ")
    rows = cut(seen.withColumn("print", F.md5(joined.cast("binary"))).withColumn("letters", F.length("text").cast("long")), codec="zstd")
    # The first row of a text comes from partial sums, so a text with very many copies is no hot key.
    first = rows.groupBy("print").agg(F.min("rid").alias("of"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(rows.select("rid", "print").join(first, "print").where("rid <> of").select("rid", "of"))
    texts = rows.select("rid", "text").join(small(copies.select("rid")), "rid", "left_anti")
    return rows, texts, copies


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose rid is one of ids(rid): bitmaps of row numbers go to all tasks, so that texts which are not
    asked for are not shuffled. Row numbers lie close together, a bitmap for 32,768 of them takes 4 KB."""
    bucket = F.expr("bitmap_bucket_number(rid)")
    bits = cut(ids.groupBy(bucket.alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(rid))").alias("bits")))
    with passing_shuffles(texts.sparkSession):
        n = bits.count()
    if n > BITMAPS:
        return texts.join(ids.select("rid").distinct(), "rid", "left_semi")
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(rid) div 8 + 1 as int), 1)), 16, 10) as int)")
    found = texts.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket")
    return found.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(rid) % 8 as int))")) != 0).select(*texts.columns)


def compare_with_first(
    pairs: DataFrame, texts: DataFrame, judge: Callable[[str, int, list[tuple[int, str]]], Iterator[tuple]], schema: pa.Schema, ddl: str
) -> DataFrame:
    """Judge pairs(first, rid) of texts: judge(first text, first rid, [(rid, text), ...]) yields result rows.

    Groups are cut into chunks; a chunk gets one copy of the first text, so no task gets a whole large
    group and no text is repeated for every pair.
    """
    needed = small(pairs.select("rid").union(pairs.select("first")).distinct())
    held = cut(texts.join(needed, "rid", "left_semi"))
    sizes = pairs.groupBy("first").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = cut(pairs.join(sizes, "first").select("first", "rid", F.pmod(F.xxhash64("rid"), "chunks").alias("chunk")))
    members = dealt.join(held, "rid").select("first", "chunk", F.lit(1).alias("kind"), "rid", "text")
    heads = dealt.select("first", "chunk").distinct().join(held.withColumnRenamed("rid", "first"), "first")
    rows = heads.select("first", "chunk", F.lit(0).alias("kind"), F.col("first").alias("rid"), "text").unionAll(members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_rid, out = "", None, []
        for batch in batches:
            names = batch.schema.names
            first, kind, rid, text = (batch.column(names.index(n)).to_pylist() for n in ("first", "kind", "rid", "text"))
            waiting: list[tuple[int, str]] = []
            for i in range(batch.num_rows):
                if kind[i] == 0:
                    if waiting:
                        out.extend(judge(head, head_rid, waiting))
                        waiting = []
                    head, head_rid = text[i], first[i]
                else:
                    waiting.append((rid[i], text[i]))
            if waiting:
                out.extend(judge(head, head_rid, waiting))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "first", "chunk").sortWithinPartitions("first", "chunk", "kind", "rid").mapInArrow(run, ddl)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an undirected graph; the root is the smallest node of its component.

    Smallest labels spread along links, then labels jump to the label of their label, until none changes.
    """
    both = cut(links.select(F.col(a).alias("node"), F.col(b).alias("next")).union(links.select(F.col(b), F.col(a))).where("node <> next").distinct())
    labels = cut(both.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node").agg(F.min("root").alias("m"))
        spread = labels.join(around, "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        spread = cut(spread)
        over = spread.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = cut(
            spread.join(over, "root", "left").select("node", F.coalesce("far", "root").alias("root"), "was")
        )
        changed = jumped.where("root <> was").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted hashes and weights), n log n."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    start = np.searchsorted(ratio, ratio, side="left")
    above = x.sum() - np.concatenate([[0.0], np.cumsum(x)])[start]
    below = np.concatenate([[0.0], np.cumsum(y)])[start]
    return float(math.fsum(1.0 / ((only_x + above) / x + (only_y + below) / y)))
