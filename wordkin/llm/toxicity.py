"""Toxicity by compression distance.

Two zstandard dictionaries of equal size, one of toxic and one of ordinary text, compress every window of
WINDOW words of a document. The distance of a window is the number of bytes by which the toxic dictionary
does better. A logistic curve over a document's distances (the largest ones, their mean, the shares of
windows that reach each of LEVELS) gives the score.

Training. Both dictionaries begin with the content that zstandard's own trainer picks from windows of both
classes without toxic segments, so what all texts have in common costs the same in both. The toxic one goes on with segments
(beginnings of words) that are significantly more frequent in toxic texts, strongest last, the ordinary one
with as many bytes of the most frequent other segments of ordinary texts. The curve is fitted to distances
by dictionaries that have not seen the text (each half of the sample is measured by dictionaries from the
other one; those from all of it then score). Each text weighs as many of its class as it stands for, so
scores are probabilities at the share of toxic texts in the input, whatever its size. Labels, languages,
sources and ids are never inputs of a score.

Only a bounded sample of labelled texts is looked at (documented parameters): SAMPLE texts per class, those
with the smallest hashes, and TRAINED windows of them per class for the trainer. Equal texts count once,
and so do texts of one class with the same smallest shingle, which most near copies share. Hashes are
compared as numbers; only the texts of the sample are moved.

Defined results: a null text counts as empty and gets the score of a text without windows, a number like
any other; without labelled texts of both classes in the sample every score is the share of toxic labels
(0 without labels); equal texts get equal scores; rows are never dropped and extra columns are passed
through, but for input columns of the score's name, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from wordkin.llm.common import with_fields, without
from wordkin.llm.copies import Shingler
from wordkin.session import cut

SAMPLE = 5_000
TRAINED = 20_000
WINDOW = 8
COMMON = 4_096
LEVELS = (1, 2, 3, 4, 5)
# Segments: beginnings of words of 4 to 12 letters; how significant and how much more frequent they are in toxic texts.
SHORTEST, LONGEST = 4, 12
SEGMENTS = 1_000
MIN_TEXTS = 3
MIN_G2 = 25.0
MIN_RATIO = 6.0
# The compressor does not look for matches in the last bytes of its input.
PADDING = b" " + b"\n" * 8
CHUNK = 256
TEXT_HASH = "text_hash"
WORD = re.compile(r"[^\W_]+")


def windows(text: str | None) -> list[bytes]:
    """All windows of WINDOW words; a text without words has one empty window."""
    words = (text or "").lower().split()
    return [" ".join(words[k : k + WINDOW]).encode("utf-8") for k in range(0, len(words), WINDOW)] or [b""]


def segments(text: str | None) -> set[str]:
    """All beginnings of the words of a text."""
    return {w[:k] for w in set(WORD.findall((text or "").lower())) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def trained(samples: list[bytes], size: int) -> bytes:
    """Dictionary content by zstandard's trainer; of too few samples, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def apart(ranked: list[str], most: int) -> list[str]:
    """The first segments of a ranking none of which holds another."""
    kept: list[str] = []
    for s in ranked:
        if len(kept) < most and not any(s in k or k in s for k in kept):
            kept.append(s)
    return kept


class CompressionModel:
    """The two dictionaries and the fitted curve."""

    def __init__(self, common: bytes, toxic: list[str], ordinary: list[str], prior: float):
        self.prior, self.weights = prior, None
        # The strongest segments come last, next to the window.
        marked = (" " + "  ".join(reversed(toxic)) + " ").encode()
        usual = (" " + "  ".join(reversed(ordinary)) + " ").encode()
        # The compressor does not index the last bytes of a dictionary either.
        self.toxic = common + marked + PADDING
        self.ordinary = common + usual[-len(marked) :].rjust(len(marked)) + PADDING

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tools"}

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
            window_log=17,
            hash_log=16,
            chain_log=16,
            search_log=6,
            min_match=5,
            target_length=32,
            strategy=zstandard.STRATEGY_BTLAZY2,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=how)

    def distances(self, text: str | None) -> np.ndarray:
        if not hasattr(self, "tools"):
            self.tools = self.compressor(self.ordinary), self.compressor(self.toxic)
        plain, toxic = self.tools
        padded = [b" " + w + PADDING for w in windows(text)]
        return np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in padded], np.int32)

    def features(self, text: str | None) -> list[float]:
        d = self.distances(text)
        top = np.zeros(3)
        best = np.sort(d)[::-1][:3]
        top[: len(best)] = best
        reach = [(d >= level).mean() for level in LEVELS]
        return [*top, d.mean(), *reach, *(math.log1p((d >= level).sum()) for level in LEVELS)]

    def fit(self, rows: np.ndarray, labels: np.ndarray, sizes: tuple[int, int] | None = None) -> None:
        """Logistic regression by Newton steps, with a small ridge penalty.

        sizes: texts without and with a toxic label that the rows were drawn from, if they are a sample.
        """
        drawn = np.bincount(labels.astype(int), minlength=2)
        weight = (np.array(sizes or drawn) / np.maximum(drawn, 1))[labels.astype(int)]
        weight *= len(weight) / weight.sum()
        self.mean = np.average(rows, axis=0, weights=weight)
        self.scale = np.sqrt(np.average((rows - self.mean) ** 2, axis=0, weights=weight)) + 1e-6
        x = self._scaled(rows)
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (weight * (p - labels)) + 0.05 * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def _scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.c_[(rows - self.mean) / self.scale, np.ones(len(rows))]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._scaled(np.array([self.features(t) for t in texts])) @ self.weights, -30, 30)))


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(TEXT_HASH)


def draw(labelled: DataFrame, text: str, label: str, per_class: int, texts: DataFrame | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """(sample(text, y, half), texts without and with a toxic label): distinct labelled texts with the smallest hashes.

    Up to per_class texts of each class are drawn and dealt to two halves, near copies to one. Where texts is given, labelled holds their hashes only (TEXT_HASH), and no text but the drawn ones is moved."""
    if texts is None:
        texts = labelled
        labelled = labelled.select(text_hash(text), label)
    known = labelled.where(F.col(label).isin(0, 1)).select(F.col(TEXT_HASH).alias("h"), F.col(label).cast("int").alias("y"))
    marks = cut(known.groupBy("h").agg(F.max("y").alias("y")))
    total = marks.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0))).first()
    drawn = None
    for y in (0, 1):
        own = marks.where(F.col("y") == y).orderBy("h").limit(per_class)
        drawn = own if drawn is None else drawn.unionAll(own)
    given = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"), text_hash(text).alias("h"))
    # At most 2 * per_class rows.
    sample = given.join(F.broadcast(cut(drawn)), "h").dropDuplicates(["h"]).select("text", "y", "h")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            least = [int(min(shingler.shingles(t), default=0)) - 2**63 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "y", "h", "least"])

    # Near copies mostly have the same smallest shingle; one of them says what all say.
    sample = sample.mapInArrow(sketch, "text string, y int, h long, least long").dropDuplicates(["least", "y"])
    return cut(sample.select("text", "y", F.pmod(F.xxhash64("least"), F.lit(2)).alias("half"))), (total[0] - total[1], total[1])


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of CHUNK rows, so that a worker holds little at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def count_segments(sample: DataFrame) -> DataFrame:
    """(segment, a, b): texts of sample(text, y) with and without a toxic label that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            held = Counter(), Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[1 - y].update(segments(t))
            every = list(held[0].keys() | held[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), *(pa.array([h[s] for s in every], pa.int64()) for h in held)], names=["segment", "a", "b"]
            )

    return sample.select("text", "y").mapInArrow(run, "segment string, a long, b long").groupBy("segment").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def sample_windows(sample: DataFrame, most: int) -> list[bytes]:
    """Windows with the smallest hashes, up to most of them per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [(y, w) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in set(windows(t)) if w]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([w for _, w in found], pa.binary())], names=["y", "w"])

    every = sample.select("text", "y").mapInArrow(run, "y int, w binary")
    order = F.xxhash64("w")
    return [bytes(r["w"]) for y in (0, 1) for r in every.where(F.col("y") == y).orderBy(order, "w").limit(most).collect()]


def build(sample: DataFrame, prior: float) -> CompressionModel | None:
    """The dictionaries from the texts of a sample; None if it lacks a class."""
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    n0, n1 = sizes[0], sizes[1]
    counts = cut(count_segments(sample))
    a, b = F.col("a"), F.col("b")
    rate = (a + b) / (n0 + n1)
    g2 = F.round(2 * (a * F.log(a / (n1 * rate)) + F.when(b > 0, b * F.log(b / (n0 * rate))).otherwise(0.0)), 6)
    strong = counts.where(a >= MIN_TEXTS).where(a / n1 >= MIN_RATIO * (b + 0.5) / n0).select("segment", g2.alias("g2")).where(F.col("g2") >= MIN_G2)
    # Among equals the longest segment says most.
    toxic = [r["segment"] for r in strong.orderBy(F.desc("g2"), F.desc(F.length("segment")), "segment").limit(8 * SEGMENTS).collect()]
    toxic = apart(toxic, SEGMENTS)
    usual = [r["segment"] for r in counts.where(b > 0).orderBy(F.desc("b"), "segment").limit(4 * SEGMENTS).collect()]
    usual = [s for s in usual if not any(s in t or t in s for t in toxic)]
    # What is common to both classes is trained without the toxic segments.
    marks = re.compile("|".join(map(re.escape, toxic)).encode("utf-8")) if toxic else re.compile(rb"\b\B")
    common = trained([w for w in sample_windows(sample, TRAINED) if not marks.search(w)], COMMON)
    return CompressionModel(common, toxic, usual, prior)


def measure(sample: DataFrame, model: CompressionModel) -> list:
    """(features, label) of the texts of a bounded sample."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return sample.select("text", "y").repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "x array<double>, y int").collect()


def train_toxicity(labelled: DataFrame, text: str = "text", label: str = "toxic", per_class: int = SAMPLE, texts: DataFrame | None = None) -> CompressionModel:
    """labelled: one row per labelled training text, label 0 or 1; rows without a label are ignored. A caller whose
    labels lie in another table gives the texts and joins only their hashes with the labels (see draw)."""
    sample, sizes = draw(labelled, text, label, per_class, texts)
    prior = sizes[1] / sum(sizes) if sum(sizes) else 0.0
    got = []
    for half in (0, 1):
        model = build(sample.where(F.col("half") != half), prior)
        if model:
            got += measure(sample.where(F.col("half") == half), model)
    whole = build(sample, prior)
    if not whole or len({r["y"] for r in got}) < 2:
        return CompressionModel(b"", [], [], prior)
    whole.fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float), sizes)
    return whole


def score_toxicity(df: DataFrame, model: CompressionModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add a score between 0 and 1 to every row."""
    df = without(df, score)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts), pa.float64())], names=[*batch.schema.names, score])

    return df.mapInArrow(run, with_fields(df, f"{score} double"))
