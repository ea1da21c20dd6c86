"""Byte-level BPE in two tiers.

Tier one: a minimal perfect hash over the vocabulary (two hash functions and one displacement per
bucket) tells whether a whole pre-token is already a token. Tier two, for misses: a heap of adjacent
pairs over a doubly linked list of bytes, merged by lowest rank, leftmost first.

The tables are built once on the driver from the rank file (its path is a parameter, its size the
bound of what is broadcast). Tasks keep a bounded memory of pre-tokens they have encoded.

Defined results: a null text counts as empty and has no ids; unpaired surrogates cannot occur in a
Spark string; a pre-token of any length costs n log n; equal texts get equal ids; rows are never dropped,
extra columns pass through, input columns of the result's names are replaced.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from wordkin.llm.common import with_fields, without

MEMO = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """Minimal perfect hash from byte strings to slots 0..n-1, each slot holding key and value."""

    def __init__(self, items: dict[bytes, int]):
        n = len(items)
        self.n, self.buckets = n, max(1, n // 3)
        self.keys: list[bytes] = [b""] * n
        self.values: list[int] = [0] * n
        self.shift = [0] * self.buckets
        groups: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in items:
            bucket, a, b = self._parts(key)
            groups.setdefault(bucket, []).append((a, b, key))
        free = bytearray(b"\x01") * n
        for bucket, group in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(group) == 1:
                break
            d = 0
            while True:
                slots = {(a + d * b) % n for a, b, _ in group}
                if len(slots) == len(group) and all(free[s] for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for a, b, key in group:
                self._put((a + d * b) % n, key, items[key], free)
        # A bucket with one key names its slot directly, as -1 - slot.
        empty = iter([s for s in range(n) if free[s]])
        for bucket, group in groups.items():
            if len(group) == 1:
                slot = next(empty)
                self.shift[bucket] = -1 - slot
                self._put(slot, group[0][2], items[group[0][2]], free)

    def _put(self, slot: int, key: bytes, value: int, free: bytearray) -> None:
        self.keys[slot], self.values[slot], free[slot] = key, value, 0

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFF, ((h >> 64) & 0xFFFFFFFF) | 1

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        bucket, a, b = self._parts(key)
        d = self.shift[bucket]
        slot = -1 - d if d < 0 else (a + d * b) % self.n
        return self.values[slot] if self.keys[slot] == key else None


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges by lowest rank, then leftmost, with a heap over linked parts."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of its parts has been merged meanwhile
        k, left = after[j], before[i]
        end[i], after[i], alive[j] = stop, k, 0
        if k < n:
            before[k] = i
            r = get(piece[i : end[k]])
            if r is not None:
                push(heap, (r, i, end[k]))
        if left >= 0:
            r = get(piece[left:stop])
            if r is not None:
                push(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Whole-token lookup first, merges for the rest. Ids travel as little-endian unsigned 32 bits."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.whole = ranks, PerfectHash(ranks)
        self.pattern = pattern
        self.tokens = {i: b for b, i in ranks.items()}
        self._start()

    def _start(self) -> None:
        self.find, self.memo = regex.compile(self.pattern).findall, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "memo")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.whole.get(raw)
        return little([whole] if whole is not None else merge_bytes(raw, self.ranks))

    def encode(self, text: str) -> bytes:
        memo, out = self.memo, []
        for piece in self.find(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.piece(piece)
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", prefix: str = "") -> DataFrame:
    """Add ids (little-endian unsigned 32-bit), n_tokens and the bytes decoded from the ids."""
    df = without(df, f"{prefix}ids", f"{prefix}n_tokens", f"{prefix}decoded")
    shared = df.sparkSession.sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            # Slices keep the ids of one output batch small whatever the length of the texts.
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [encoder.encode(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(ids, pa.binary()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([encoder.decode(i) for i in ids], pa.binary()),
                    ],
                    names=[*part.schema.names, f"{prefix}ids", f"{prefix}n_tokens", f"{prefix}decoded"],
                )

    return df.mapInArrow(run, with_fields(df, f"{prefix}ids binary, {prefix}n_tokens long, {prefix}decoded binary"))
