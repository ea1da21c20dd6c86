"""Parameters of the probabilistic edit distance."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wordkin.operators.costs import CostTable, SparseCells
from wordkin.session import need_at_most
from wordkin.symbols import EMPTY

# Cost tables shipped to the tasks hold at most this many cells at a time: more nodes are
# scored part by part, and alphabets whose square is larger get sparse tables.
MAX_CELLS = 16_000_000
MAX_NODES = 1_000_000
MAX_MODEL_ROWS = 20_000_000


@dataclass(frozen=True)
class UniformCosts:
    match: float
    substitute: float
    gap: float
    stop: float


def uniform_costs(n_chars: int, substitute: float = -4.0, gap: float = -4.0) -> UniformCosts:
    """Normalised log costs from two weights: per parent character one match, n-1
    substitutions, one deletion and n insertions share the mass."""
    log_c = -math.log((n_chars - 1) * math.exp(substitute) + 1.0 + (n_chars + 1) * math.exp(gap))
    return UniformCosts(
        log_c, substitute + log_c, gap + log_c, math.log(1.0 - math.exp(math.log(n_chars) + gap + log_c))
    )


@dataclass
class EditModel:
    """Uniform costs for nodes without own parameters, sparse rows for the others.

    ``rows(node_id, x, y, lp)`` holds seen pairs, ``defaults(node_id, x, lp)`` the score of
    unseen ones (``x`` NULL: parent character unseen at the node). Re-estimated nodes have
    stop cost 0.
    """

    alphabet: list[str]
    uniform: UniformCosts
    rows: DataFrame | None = None
    defaults: DataFrame | None = None
    _parts: list = field(default_factory=list)

    @staticmethod
    def initial(alphabet: list[str], substitute: float = -4.0, gap: float = -4.0) -> "EditModel":
        return EditModel(alphabet, uniform_costs(len(alphabet), substitute, gap))

    def _chars(self) -> str:
        return "\0" + "".join(ch for ch in self.alphabet if ch != EMPTY)

    def _flat(self, nodes: list, shared: bool = False) -> CostTable:
        """Uniform costs for the given nodes (one matrix for all of them if shared)."""
        n, k, u = len(self.alphabet), 1 if shared else len(nodes), self.uniform
        if self._dense():
            m = np.full((n, n), u.substitute)
            m[0, :] = u.gap
            m[:, 0] = u.gap
            np.fill_diagonal(m, u.match)
            cells = np.broadcast_to(m, (k, n, n)).copy()
        else:
            x = np.arange(n)
            keys = np.concatenate([x * n + x, x[1:] * n])
            values = np.concatenate([np.full(n, u.match), np.full(n - 1, u.gap)])
            row = np.full(n, u.substitute)
            row[0] = u.gap
            shift = np.repeat(np.arange(k) * n * n, len(keys))
            cells = SparseCells(n, np.tile(keys, k) + shift, np.tile(values, k), np.tile(row, k))
        return CostTable(self._chars(), list(nodes), cells, np.full(k, u.stop), shared)

    def _dense(self) -> bool:
        return len(self.alphabet) ** 2 <= MAX_CELLS

    def _step(self) -> int:
        """Nodes per cost table."""
        n = len(self.alphabet)
        return max(1, MAX_CELLS // (n * n if self._dense() else 4 * n))

    def parts(self) -> list[CostTable]:
        """Cost tables that cover all nodes, each within the cell bound."""
        if self._parts:
            return self._parts
        if self.rows is None:
            self._parts.append(self._flat([], shared=True))
            return self._parts
        n = len(self.alphabet)
        code = {ch: i for i, ch in enumerate(self._chars())}
        code[EMPTY] = 0
        nodes = self.defaults.select("node_id").distinct()
        ids = sorted(r.node_id for r in need_at_most(nodes, MAX_NODES, "model nodes"))
        for start in range(0, len(ids), self._step()):
            some = ids[start : start + self._step()]
            at = {x: i for i, x in enumerate(some)}
            mine = F.col("node_id").isin(some)
            row = np.empty((len(some), n))
            defaults = need_at_most(self.defaults.filter(mine), MAX_MODEL_ROWS, "edit defaults")
            for r in sorted(defaults, key=lambda r: r.x is not None):
                row[at[r.node_id], slice(None) if r.x is None else code[r.x]] = r.lp
            seen = need_at_most(self.rows.filter(mine), MAX_MODEL_ROWS, "edit parameters")
            keys = np.array([(at[r.node_id] * n + code[r.x]) * n + code[r.y] for r in seen], dtype=np.int64)
            values = np.array([r.lp for r in seen], dtype=np.float64)
            if self._dense():
                cells = np.repeat(row[:, :, None], n, axis=2)
                cells.reshape(-1)[keys] = values
            else:
                cells = SparseCells(n, keys, values, row.reshape(-1))
            self._parts.append(CostTable(self._chars(), some, cells, np.zeros(len(some))))
        return self._parts

    def with_initial(self, nodes: list) -> "EditModel":
        """Give nodes that were not re-estimated the uniform costs."""
        parts = self.parts()
        if not parts[0].shared:
            known = {x for p in parts for x in p.node_ids}
            missing = [x for x in nodes if x not in known]
            for start in range(0, len(missing), self._step()):
                parts.append(self._flat(missing[start : start + self._step()]))
            self._parts = merge_tables(parts)
        return self


def merge_tables(parts: list[CostTable]) -> list[CostTable]:
    """Join neighbouring dense tables that fit the cell bound together."""
    out = parts[:1]
    for part in parts[1:]:
        last = out[-1]
        dense = isinstance(last.cells, np.ndarray) and isinstance(part.cells, np.ndarray)
        if dense and last.cells.size + part.cells.size <= MAX_CELLS:
            out[-1] = CostTable(
                last.chars,
                last.node_ids + part.node_ids,
                np.concatenate([last.cells, part.cells]),
                np.concatenate([last.stop, part.stop]),
            )
        else:
            out.append(part)
    return out
