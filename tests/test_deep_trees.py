"""Trees that are deep, wide or repeat labels, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from wordkin.operators import trees as tr
from wordkin.sources import treetext as tt

TREE = "tree_id string, node_id int, parent_id int, label string, branch_length double, ordinal int, depth int"


def test_closure_doubles_paths(spark, monkeypatch):
    depth = 700
    rows = [("t", k, k - 1 if k else None, f"n{k}", 0.5, 0, k) for k in range(depth + 1)]
    rows += [("u", 0, None, "r", 0.0, 0, 0), ("u", 1, 0, "a", 1.0, 0, 1), ("u", 2, 0, "b", 2.0, 1, 1)]
    calls = []
    monkeypatch.setattr(tr, "cut", lambda df, keep=tr.cut: calls.append(1) or keep(df))
    got = tr.closure(spark.createDataFrame(rows, TREE))
    assert len(calls) <= 2 * 10
    one = got.where("tree_id = 't'").agg(F.count("*").alias("n"), F.countDistinct("ancestor", "descendant").alias("d"), F.sum("distance").alias("s"), F.sum("length").alias("l")).first()
    n = depth + 1
    steps = sum(k * (n - k) for k in range(n))
    assert (one.n, one.d, one.s, one.l) == (n * (n + 1) // 2, n * (n + 1) // 2, steps, steps / 2)
    assert got.where("tree_id = 't' and descendant - ancestor <> distance").count() == 0
    assert {tuple(r)[1:] for r in got.where("tree_id = 'u'").collect()} == {(0, 0, 0, 0.0), (1, 1, 0, 0.0), (2, 2, 0, 0.0), (0, 1, 1, 1.0), (0, 2, 1, 2.0)}


def greedy(rows):
    kept = []
    for clade, support in sorted(rows, key=lambda r: (-r[1], -len(r[0]), "\u0001".join(r[0]))):
        s = set(clade)
        if all(not s & t or s <= t or t <= s for t, _, _ in kept):
            kept.append((s, clade, support))
    out = {}
    for s, clade, support in kept:
        above = [(len(t), c) for t, c, _ in kept if s < t]
        out[tuple(clade)] = (support, tuple(min(above)[1]) if above else None)
    return out


@pytest.mark.parametrize("leaves, n, longest, window", [(12, 300, 6, 2048), (12, 300, 6, 7), (10_000, 400, 3_000, 64)])
def test_consensus_is_the_greedy_order(spark, leaves, n, longest, window):
    rng = random.Random(leaves)
    names = [f"x{k:05d}" for k in range(leaves)]
    rows = {}
    for _ in range(n):
        a = rng.randrange(leaves)
        # Runs of neighbours are often nested, random picks mostly conflict.
        size = rng.randint(1, longest)
        clade = names[a : a + size] if rng.random() < 0.8 else rng.sample(names, min(size, 5))
        rows[tuple(sorted(clade))] = rng.randint(1, 4)
    data = [(list(c), s) for c, s in rows.items()]
    got = tr.consensus(spark.createDataFrame(data, "clade array<string>, support long"), window).collect()
    want = greedy(data)
    assert len(got) == len(want)
    assert {tuple(r.clade): (r.support, tuple(r.parent_clade) if r.parent_clade else None) for r in got} == want


def test_consensus_of_nothing(spark):
    assert tr.consensus(spark.createDataFrame([], "clade array<string>, support long")).collect() == []


def random_newick(rng, labels, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(labels)
    return "(" + ",".join(random_newick(rng, labels, depth - 1) for _ in range(rng.randint(1, 3))) + ")" + rng.choice(["", "k"])


@pytest.mark.parametrize("labels", [list("abcdef"), [f"l{k}" for k in range(500)], ["é", "", "a b"]])
def test_clade_support_of_texts(spark, labels):
    """Fingerprints count what label sets count, also where a tree repeats a label or has single children."""
    rng = random.Random(len(labels))
    texts = [(k, f"({random_newick(rng, labels, 4)},{random_newick(rng, labels, 4)})r;") for k in range(60)]
    texts += [(100, texts[0][1]), (101, "a;"), (102, "((a,b)x,(b,a)y)r;")]
    df = spark.createDataFrame(texts, "tree_id int, text string")
    want: dict = {}
    for _, text in texts:
        rows = tt.tree_rows(text, "newick")
        inner = {r[1] for r in rows}
        under = {r[0]: set() if r[0] in inner else {r[2]} for r in rows}
        for r in reversed(rows):
            if r[1] is not None:
                under[r[1]] |= under[r[0]]
        for clade in {frozenset(s) for s in under.values()}:
            want[clade] = want.get(clade, 0) + 1
    got = tt.text_clade_support(df).collect()
    assert len(got) == len(want) and {frozenset(r.clade): r.support for r in got} == want
    by_closure = tr.clade_support(tr.clades(tt.read_trees(df))).collect()
    assert {tuple(r.clade): r.support for r in got} == {tuple(r.clade): r.support for r in by_closure}
