"""Packing token sequences with Karmarkar-Karp multiway differencing.

A document's ids are cut into pieces of at most the capacity. A full piece is a sequence of its own.
All others are dealt at random to groups of about GROUP pieces; inside a group the differencing
method spreads them over the smallest number of near-equal windows: it keeps partial partitions in
a heap by spread and merges the two with the largest, heaviest window with lightest. When a window
exceeds the capacity the window count rises and the group is spread again.

Only lengths and checksums of pieces move between tasks, never ids.

Defined results: a null or empty text still has its end id; a null id stays null; repeated rows are
packed as often as they occur; an empty table gives no sequences; a document longer than the capacity
spans several sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordkin.session import cut

CAPACITY = 4096
GROUP = 384
END_ID = 2
MEMO = 800_000


def spread(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k near-equal groups of positions."""
    # A partial partition: sums in falling order, and the positions behind each sum.
    heap = [(-n, i, [n] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, order, b, in_b = heapq.heappop(heap)
        sums = np.array(a) + np.array(b[::-1])
        by = np.argsort(-sums, kind="stable").tolist()
        merged = [x + y if x and y else x or y for x, y in zip(in_a, reversed(in_b))]
        total = sums[by].tolist()
        heapq.heappush(heap, (total[-1] - total[0], order, total, [merged[i] for i in by]))
    return heap[0][3] if heap else []


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the lower bound up, that differencing fits into the capacity."""
    if not lengths:
        return []
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = spread(lengths, k)
        over = max(sum(lengths[i] for i in w) for w in windows)
        if over <= capacity:
            return [w for w in windows if w]
        k += 1


class WordTokenizer:
    """Ids of a text by the given tokenizer file, encoded word by word and remembered.

    The tokenizer drops white space and never merges across it, so encoding the parts between spaces and
    line feeds gives the ids of the whole text; its special marks hold none, so they lie within a part and
    get their ids, as the library does by default. It also lower-cases, and parts letters from a closing
    point or comma: words of Latin-1 letters, whose lower case has no special rules, are remembered once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {"": b""}

    @staticmethod
    def _stem(word: str) -> str | None:
        """The lower-case letters of a plain word, without one closing point or comma."""
        letters = word[:-1] if word[-1] in ".," else word
        return letters.lower() if letters.isalpha() and max(letters) < "\u0100" else None

    def learn(self, missing: list[str]) -> None:
        memo = self.memo
        stems = {w: stem for w in missing if (stem := self._stem(w))}
        plain = [x for x in {*stems.values()} if x not in memo]
        # Plain words are encoded many in a line; each ends with the only token of its that closes a word.
        lines = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(line):
                raise ValueError("the tokenizer does not close every word")
            raw, at = ids.tobytes(), 0
            for word, end in zip(line, (4 * ends).tolist()):
                memo[word] = raw[at:end]
                at = end
        others = [w for w in missing if w not in stems] + [x for x in ".," if x not in memo]
        for word, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            memo[word] = np.array(e.ids, "<u4").tobytes()
        for word, stem in stems.items():
            memo[word] = memo[stem] + memo[word[-1]] if word[-1] in ".," else memo[stem]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        seen = set().union(*split) if split else set()
        missing = [w for w in seen if w not in self.memo]
        if len(self.memo) + len(missing) > MEMO:
            self.memo = {"": b""}
            missing = [w for w in seen if w]
        if missing:
            self.learn(missing)
        memo = self.memo
        return [b"".join([memo[w] for w in parts]) for parts in split]


_tokenizers: dict[str, WordTokenizer] = {}


def cut_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every row."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokenizers:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            _tokenizers[tokenizer_path] = WordTokenizer(tokenizer_path)
        tokenizer = _tokenizers[tokenizer_path]
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), tokenizer.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        rows.append((key, start, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return df.select(F.col(doc_id).cast("long"), text).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to every piece."""
    spark = pieces.sparkSession
    # Written first: the row numbers that deal out the pieces must not change when a task is repeated.
    fixed = cut(pieces)
    n_groups = max(1, -(-fixed.count() // group))
    dealt = fixed.withColumn("_n", F.monotonically_increasing_id()).withColumn("_g", F.pmod(F.xxhash64("_n"), F.lit(n_groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        rest = np.flatnonzero(lengths < capacity)
        windows = pack_group(lengths[rest].tolist(), capacity)
        for s, window in enumerate(windows):
            at = 0
            for i in rest[sorted(window)]:
                sequence[i], offset[i] = s, at
                at += lengths[i]
        full = np.flatnonzero(lengths >= capacity)
        sequence[full] = len(windows) + np.arange(len(full))
        pdf["sequence_id"] = (pdf["_g"].to_numpy() << 24) + sequence
        pdf["offset"] = offset
        return pdf.drop(columns=["_n", "_g"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if n_groups > int(spark.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(min(n_groups, 100_000), "_g")
    return dealt.groupBy("_g").applyInPandas(one, schema)


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return pack_pieces(cut_pieces(df, tokenizer_path, capacity, doc_id, text), capacity)
