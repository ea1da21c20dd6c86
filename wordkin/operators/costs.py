"""Cost tables as the tasks see them. No Spark imports: this module is loaded by workers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class SparseCells:
    """Log costs of a large alphabet: stored cells, and a default per (node, parent character).

    Indexed like a flat dense array: ``k * n * n + x * n + y``.
    """

    def __init__(self, n: int, keys: np.ndarray, values: np.ndarray, row_default: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.n = n
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(values[order], 0.0)
        self.row_default = row_default

    def __getitem__(self, at):
        pos = np.searchsorted(self.keys, at)
        return np.where(self.keys[pos] == at, self.values[pos], self.row_default[at // self.n])

    def exp(self) -> "SparseCells":
        return SparseCells(self.n, self.keys[:-1], np.exp(self.values[:-1]), np.exp(self.row_default))

    def lowest(self) -> float:
        return float(min(self.values.min(), self.row_default.min()))


@dataclass
class CostTable:
    """Log costs of some nodes: ``cells[k, x, y]`` with character 0 the empty symbol. A pair scores the sum over its
    alignments, or the ``best`` of them. ``step`` is the cost of every step but a match, where all are alike (a match: 0)."""

    chars: str
    node_ids: list
    cells: np.ndarray | SparseCells
    stop: np.ndarray
    shared: bool = False
    best: bool = False
    step: float | None = None

    def __post_init__(self):
        points = np.array([ord(ch) for ch in self.chars], dtype=np.uint32)
        order = np.argsort(points)
        self._points = points[order]
        self._codes = order.astype(np.int64)
        self._rows = {x: i for i, x in enumerate(self.node_ids)}
        self._views = None

    @property
    def n(self) -> int:
        return len(self.chars)

    def views(self) -> tuple:
        """(log costs, plain costs, lowest log cost), both addressed by flat cell number."""
        if self._views is None:
            if isinstance(self.cells, SparseCells):
                self._views = (self.cells, self.cells.exp(), self.cells.lowest())
            else:
                logs = self.cells.reshape(-1)
                self._views = (logs, np.exp(logs), float(logs.min()))
        return self._views

    def encode(self, points: np.ndarray) -> np.ndarray:
        if not len(points):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self._points, points), len(self._points) - 1)
        if not np.array_equal(self._points[at], points):
            raise ValueError("word holds a character that is not in the alphabet")
        return self._codes[at]

    def row_of(self, node_ids) -> np.ndarray:
        if self.shared:
            return np.zeros(len(node_ids), dtype=np.int64)
        return np.array([self._rows[x] for x in node_ids], dtype=np.int64)
