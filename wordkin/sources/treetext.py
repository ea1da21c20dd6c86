"""Tree strings: Newick ``((a:1,b:2)c:0.5,d)r;`` and nested ``(r (c:0.5 (a:1) (b)) (d))``."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from wordkin.session import cut, python_ready, small

NODE_FIELDS = "node_id int, parent_id int, label string, branch_length double, ordinal int, depth int"

# Punctuation of the two formats and the accepted length spellings.
_NEWICK = re.compile(r"\s*([(),;]|:\s*(?:\[.*?\])?\s*(?:[0-9.]+|Infinity)?|[^(),:;]+)")
_MASK = 2**128 - 1
_LISP = re.compile(r"\s*([();]|:\s*[0-9.]+|[^\s():;,]+)")


def _length(token: str) -> float:
    digits = re.sub(r"\[.*?\]", "", token[1:]).strip()
    if not digits:
        return 0.0
    return float("inf") if digits == "Infinity" else float(digits)


def tree_rows(text: str, style: str) -> list[tuple]:
    """One pass with a stack of open nodes; node numbers follow the opening order."""
    pattern = {"newick": _NEWICK, "lisp": _LISP}[style]
    rows: list[list] = []
    children: list[int] = []
    stack: list[int] = []

    def add() -> int:
        parent = stack[-1] if stack else None
        ordinal = 0
        if parent is not None:
            ordinal = children[parent]
            children[parent] += 1
        rows.append([len(rows), parent, "", 0.0, ordinal, len(stack)])
        children.append(0)
        return len(rows) - 1

    pos, end = 0, len(text.rstrip())
    current: int | None = None
    while pos < end:
        m = pattern.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError(f"bad {style} tree at character {pos}")
        token, pos = m.group(1), m.end()
        if token == ";":
            break
        if token == "(":
            stack.append(add())
            current = stack[-1] if style == "lisp" else None
        elif token == ")":
            if style == "newick" and current is None:
                add()
            if not stack:
                raise ValueError(f"unbalanced {style} tree")
            current = stack.pop()
        elif token == ",":
            if current is None:
                add()
            current = None
        elif token[0] == ":":
            if current is None:
                current = add()
            rows[current][3] = _length(token)
        else:
            if current is None:
                current = add()
            rows[current][2] = token.strip()
    if stack or not rows or sum(r[1] is None for r in rows) != 1:
        raise ValueError(f"unbalanced {style} tree")
    return [tuple(r) for r in rows]


def read_trees(texts: DataFrame, style: str = "newick") -> DataFrame:
    """Node rows of every tree string in ``texts(tree_id, text)``; narrow, no shuffle."""
    python_ready(texts.sparkSession)
    tree_type = texts.schema["tree_id"].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (tree_id, *row)
                for tree_id, text in zip(batch["tree_id"], batch["text"])
                for row in tree_rows(text, style)
            ]
            frame = pd.DataFrame(
                out,
                columns=["tree_id", "node_id", "parent_id", "label", "branch_length", "ordinal", "depth"],
            )
            frame["parent_id"] = frame["parent_id"].astype("Int32")
            yield frame

    return texts.select("tree_id", "text").mapInPandas(parse, f"tree_id {tree_type}, {NODE_FIELDS}")


@functools.lru_cache(65_536)
def _label_print(label: str) -> int:
    return int.from_bytes(hashlib.blake2b(label.encode("utf-8"), digest_size=16).digest(), "little")


def clade_sets(text: str, style: str) -> list[tuple[int, int]]:
    """(node, fingerprint) of the distinct clades of a tree, first node first.

    The fingerprint of a clade is the sum of the 128-bit hashes of its leaf labels, so it comes out of one walk from
    the leaves up. A label that occurs twice in a tree counts once: such trees carry their label sets upwards."""
    rows = tree_rows(text, style)
    inner = {r[1] for r in rows}
    labels = [r[2] for r in rows if r[0] not in inner]
    repeated = len(set(labels)) < len(labels)
    held = [{r[2]} if repeated and r[0] not in inner else set() for r in rows] if repeated else None
    sums = [0 if r[0] in inner else _label_print(r[2]) for r in rows]
    for r in reversed(rows):
        # Children are numbered after their parents.
        node, parent = r[0], r[1]
        if held:
            sums[node] = sum(map(_label_print, held[node])) & _MASK
        if parent is not None:
            if held:
                held[parent] |= held[node]
            else:
                sums[parent] = (sums[parent] + sums[node]) & _MASK
    first: dict[int, int] = {}
    for node, total in enumerate(sums):
        first.setdefault(total, node)
    return [(node, total) for total, node in first.items()]


def clade_leaves(text: str, style: str, node: int) -> list[str]:
    """Sorted distinct labels of the leaves under a node."""
    rows = tree_rows(text, style)
    inner = {r[1] for r in rows}
    under = {node}
    for r in rows[node + 1 :]:
        if r[1] in under:
            under.add(r[0])
    return sorted({rows[n][2] for n in under if n not in inner}, key=lambda x: x.encode("utf-8"))


def text_clade_support(texts: DataFrame, style: str = "newick") -> DataFrame:
    """(clade, support) of all clades of the trees in texts(tree_id, text): in how many trees each occurs.

    One narrow pass gives 16 bytes per clade and tree; only these are counted. Leaf labels are listed once per
    distinct clade, from the first tree that has it."""
    spark = python_ready(texts.sparkSession)
    tree_type = texts.schema["tree_id"].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes, marks = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for node, total in clade_sets(text, style):
                    ids.append(k)
                    nodes.append(node)
                    marks.append(total.to_bytes(16, "little"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(nodes, pa.int32()), pa.array(marks, pa.binary())], names=["tree_id", "node_id", "mark"]
            )

    given = texts.select("tree_id", "text")
    marks = given.mapInArrow(prints, f"tree_id {tree_type}, node_id int, mark binary")
    counted = cut(marks.groupBy("mark").agg(F.count("*").alias("support"), F.min(F.struct("tree_id", "node_id")).alias("at")))
    wanted = counted.select("at.tree_id", "at.node_id", "support").groupBy("tree_id").agg(F.collect_list(F.struct("node_id", "support")).alias("want"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(clade_leaves(text, style, w["node_id"]), w["support"]) for text, want in zip(*(c.to_pylist() for c in batch.columns)) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.list_(pa.string())), pa.array([n for _, n in out], pa.int64())], names=["clade", "support"])

    first = given.join(small(wanted), "tree_id").select("text", "want")
    return first.mapInArrow(names, "clade array<string>, support long")


@udtf(returnType=NODE_FIELDS)
class TreeNodes:
    """SQL form: ``SELECT n.* FROM t, LATERAL tree_nodes(t.text, 'newick') n``."""

    def eval(self, text: str, style: str):
        yield from tree_rows(text, style)


def register_tree_nodes(spark: SparkSession) -> None:
    python_ready(spark).udtf.register("tree_nodes", TreeNodes)


def tree_texts(tree: DataFrame, depth: int, style: str = "newick") -> DataFrame:
    """Strings of whole trees, built from the deepest level upwards.

    A tree becomes one string, so one row holds it by definition of the format.
    """
    length = F.when(
        F.col("branch_length") != 0.0,
        F.concat(
            F.lit(":"),
            F.when(F.col("branch_length") == float("inf"), F.lit("Infinity")).otherwise(
                F.col("branch_length").cast("string")
            ),
        ),
    ).otherwise("")
    nodes = tree.withColumn("_tag", F.concat(F.col("label"), length))
    built = None
    for d in range(depth, -1, -1):
        level = nodes.filter(F.col("depth") == d)
        if built is None:
            level = level.withColumn("_kids", F.lit(None).cast("string"))
        else:
            sep = ", " if style == "newick" else " "
            kids = (
                built.groupBy("tree_id", "parent_id")
                .agg(F.sort_array(F.collect_list(F.struct("ordinal", "_text"))).alias("_list"))
                .select(
                    "tree_id",
                    F.col("parent_id").alias("node_id"),
                    F.array_join(F.transform("_list", lambda x: x["_text"]), sep).alias("_kids"),
                )
            )
            level = level.join(kids, ["tree_id", "node_id"], "left")
        if style == "newick":
            text = F.concat(F.coalesce(F.concat(F.lit("("), "_kids", F.lit(")")), F.lit("")), "_tag")
        else:
            text = F.concat(F.lit("("), "_tag", F.coalesce(F.concat(F.lit(" "), "_kids"), F.lit("")), F.lit(")"))
        built = level.withColumn("_text", text)
    return built.select("tree_id", F.col("_text").alias("text"))

