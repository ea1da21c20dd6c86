"""Bigram log-probabilities of words, looked up in a dense table. No Spark imports: loaded by workers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass
class ScoreTable:
    """``cells[k, x, y]`` of node k; character 0 is the word boundary, the last one any character not in ``chars``,
    the last k any node not in ``node_ids``."""

    node_ids: list
    chars: str
    cells: np.ndarray

    def __post_init__(self):
        points = np.array([ord(ch) for ch in self.chars], np.uint32)
        order = np.argsort(points)
        self._points, self._codes = points[order], order + 1
        self._rows = {x: i for i, x in enumerate(self.node_ids)}

    def encode(self, points: np.ndarray) -> np.ndarray:
        if not len(self._points):
            return np.full(len(points), 1)
        at = np.minimum(np.searchsorted(self._points, points), len(self._points) - 1)
        return np.where(self._points[at] == points, self._codes[at], len(self._points) + 1)

    def score(self, nodes: pa.Array, words: pa.Array) -> np.ndarray:
        """One score per row, both ends of the word included."""
        words = words.cast(pa.string()).dictionary_encode()
        texts = words.dictionary.to_pylist()
        size = np.array([len(w) for w in texts], np.int64)
        codes = self.encode(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
        # Every word behind a boundary, one more at the end: step k of a word goes from place k to k + 1.
        start = np.cumsum(size + 1) - size - 1
        line = np.zeros(int((size + 1).sum()) + 1, np.int64)
        inside = np.ones(len(line), bool)
        inside[np.append(start, len(line) - 1)] = False
        line[inside] = codes
        which = np.asarray(words.indices, np.int64)
        steps = size[which] + 1
        row = np.repeat(np.arange(len(which)), steps)
        at = np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps) + np.repeat(start[which], steps)
        named = nodes.dictionary_encode()
        node = np.array([self._rows.get(x, len(self.node_ids)) for x in named.dictionary.to_pylist()], np.int64)[np.asarray(named.indices, np.int64)]
        return np.bincount(row, self.cells[node[row], line[at], line[at + 1]], len(which))
