"""Fixed values shared by driver and task code: the boundary / empty symbol, the hole."""

EMPTY = "∅"
HOLE = "?"
