"""What the tasks of a pass over pairs hold and do once, and what of it leaves them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordkin.operators import alignment as al, messages as ms, passes, tries
from wordkin.operators.edit_model import EditModel
from wordkin.operators.lexicon import BigramModel, bigram_counts
from wordkin.operators.pairs import expected_alignments

ABC = ["∅", "a", "b", "c"]
TREE = [(0, None, "r", 0.0, 0, 0), (1, 0, "x", 1.0, 0, 1), (2, 0, "c", 2.0, 1, 1), (3, 1, "a", 0.5, 0, 2), (4, 1, "b", 1.5, 1, 2)]


def some_words(n, seed):
    pick = random.Random(seed)
    return sorted({"".join(pick.choice("abc") for _ in range(pick.randint(0, 9))) for _ in range(n)})


def own_costs(nodes):
    costs = EditModel.initial(ABC)._flat(nodes)
    costs.cells = costs.cells - 0.5 * np.random.default_rng(1).random(costs.cells.shape)
    return costs


def test_a_pair_is_aligned_once_for_all_nodes(monkeypatch):
    rows = [(node, p, c, 0.1 * node) for node in (1, 2, 3, 4) for p, c in (("ab", "abb"), ("", "a"), ("c", ""), ("bca", "ba"))]
    batch = pa.RecordBatch.from_pylist([dict(zip(("node_id", "parent", "child", "weight"), r)) for r in rows])
    costs = EditModel.initial(ABC).parts()[0]
    single = al.count_batch(batch, costs, True).to_pylist()
    weight = {r[:3]: r[3] for r in rows}
    want = {}
    for r in single:
        key = r["node_id"], r["x"], r["y"]
        want[key] = want.get(key, 0.0) + r["cnt"] * weight[r["node_id"], r["parent"], r["child"]]
    aligned, plain = [], al._forward
    monkeypatch.setattr(al, "_forward", lambda x, y, lp, *rest: aligned.append(len(lp)) or plain(x, y, lp, *rest))
    found = al.count_batch(batch, costs, False).to_pylist()
    assert sum(aligned) == 4
    assert {(r["node_id"], r["x"], r["y"]): r["cnt"] for r in found} == pytest.approx(want)


def test_counts_of_nodes_with_own_costs(spark):
    words = some_words(40, 3)
    rows = [(k % 3 + 1, p, c, 0.5 + k % 4) for k, (p, c) in enumerate((p, c) for p in words for c in words)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("node_id", "parent", "child", "weight"), r)) for r in rows])
    costs = own_costs([1, 2, 3])
    want = {}
    for r, w in ((r, {x[:3]: x[3] for x in rows}) for r in al.count_batch(batch, costs, True).to_pylist()):
        key = r["node_id"], r["x"], r["y"]
        want[key] = want.get(key, 0.0) + r["cnt"] * w[r["node_id"], r["parent"], r["child"]]
    assert {(r["node_id"], r["x"], r["y"]): r["cnt"] for r in al.count_batch(batch, costs, False).to_pylist()} == pytest.approx(want)
    df = spark.createDataFrame(rows + rows, "node_id int, parent string, child string, weight double")
    model = EditModel.initial(ABC)
    single = expected_alignments(df.distinct(), model, per_pair=True).join(df, ["node_id", "parent", "child"])
    want = {tuple(r)[:3]: r.s for r in single.groupBy("node_id", "x", "y").agg(F.sum(F.col("cnt") * F.col("weight")).alias("s")).collect()}
    assert {tuple(r)[:3]: r.cnt for r in expected_alignments(df, model).collect()} == pytest.approx(want)


@pytest.mark.parametrize("kind", ["shared", "nodes", "best", "sparse"])
def test_large_blocks_hold_two_levels_of_their_table(kind, monkeypatch):
    words = some_words(150, 5)
    child = [{"node_id": 1 + k % 2, "word": w} for k, w in enumerate(words + words[:20])]
    costs = {"shared": EditModel.initial(ABC).parts()[0], "nodes": own_costs([1, 2]), "best": al.distance_costs(words, -4.0), "sparse": EditModel.initial(ABC)._flat([], True)}[kind]
    if kind == "sparse":
        costs.cells = al.SparseCells(costs.n, np.arange(costs.n**2), costs.cells.reshape(-1), np.zeros(costs.n))
    blocks = [([{"word": "ab"}], [{"node_id": 2, "word": "b"}]), ([{"word": w} for w in words], child), ([], child[:1])]
    parents, children = (pa.array([b[k] for b in blocks]) for k in (0, 1))
    assert len(words) * len(child) >= 6_000
    monkeypatch.setattr(tries, "grid_sums", lambda *_: pytest.fail("the whole table is held"))
    monkeypatch.setattr(tries, "CACHED", 1_000, raising=False)
    scores, p, c, offsets = al.score_all(parents, children, costs)
    assert offsets.tolist() == [0, 1, 1 + len(words) * len(child), 1 + len(words) * len(child)]
    assert p[1:].tolist() == [1 + k for k in range(len(words)) for _ in child] and c[1:].tolist() == [1 + k for _ in words for k in range(len(child))]
    monkeypatch.setattr(al, "TRIE_PAIRS", 10**9)
    assert scores == pytest.approx(al.score_all(parents, children, costs)[0])


def weights_of(spark, rows):
    df = spark.createDataFrame([(s, l, w, s, f"{i}:{l}") for i, (s, l, w) in enumerate(rows)], "slot string, language string, word string, gold_id string, obs_id string")
    tree = spark.createDataFrame(TREE, "node_id int, parent_id int, label string, branch_length double, ordinal int, depth int")
    model = ms.EdgeModel("levenshtein", BigramModel.flat(4), {}, 0.4)
    return ms.Inference(df, ms.TreeShape.of(tree), model)


def test_weights_leave_their_tasks_summed(spark):
    rows = [("s", "a", "ab"), ("s", "b", "abb"), ("s", "c", "ba"), ("t", "a", "cc"), ("t", "b", "c")]
    plan = weights_of(spark, rows).pair_weights().filter("new_weight > 0").groupBy("node_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert "parent" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(" in x)
    both = weights_of(spark, rows + [("u", "a", "ab"), ("u", "b", "abb"), ("u", "c", "ba")]).pair_weights().collect()
    once = weights_of(spark, rows).pair_weights().collect()
    twice = {"ab", "abb", "ba"}
    want = {(r.node_id, r.parent, r.child): (r.kept_weight + r.new_weight) * (2 if r.parent in twice else 1) for r in once}
    assert len(both) == len(once) == len(want)
    assert {(r.node_id, r.parent, r.child): r.kept_weight + r.new_weight for r in both} == pytest.approx(want)


def test_weighted_bigrams_are_summed_by_word_first(spark):
    df = spark.createDataFrame([(1, "ab", 0.5), (1, "ab", 0.25), (1, "b", 1.0), (2, "ab", 2.0), (1, None, 1.0)], "node_id int, word string, w double")
    counts = bigram_counts(df, weight=F.col("w"))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.rindex("Aggregate [node_id")
    assert {tuple(r)[:3]: r.cnt for r in counts.collect()} == {
        (1, "∅", "a"): 0.75, (1, "a", "b"): 0.75, (1, "b", "∅"): 1.75, (1, "∅", "b"): 1.0, (2, "∅", "a"): 2.0, (2, "a", "b"): 2.0, (2, "b", "∅"): 2.0,
    }


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("longest", [3, 8, 9, 16, 33, 64])
def test_distances_need_no_alignment_table(longest, monkeypatch):
    pick = random.Random(longest)

    def side():
        return ["".join(pick.choice("abé😀") for _ in range(pick.choice([0, 1, longest // 2, longest - 1, longest]))) for _ in range(pick.randint(1, 7))]

    blocks = [(side(), side()) for _ in range(12)]
    batch = pa.RecordBatch.from_pylist([{"parents": [{"word": w} for w in p], "children": [{"word": w} for w in c]} for p, c in blocks]).slice(3, 6)
    # neither tries nor single pairs
    monkeypatch.setattr(al.tries, "PrefixTrie", None)
    monkeypatch.setattr(al, "_forward", None)
    monkeypatch.setattr(al, "BIT_PAIRS", 10)
    costs = lambda words: al.distance_costs(words, -4.0)
    scores, *_ = al.score_all(batch.column("parents"), batch.column("children"), costs)
    assert scores.tolist() == [-4.0 * plain_distance(p, c) for ps, cs in blocks[3:9] for p in ps for c in cs]


def test_distances_of_words_beyond_the_bits():
    words = ["a" * 70, "a" * 69 + "b", "", "ab"]
    batch = pa.RecordBatch.from_pylist([{"parents": [{"word": w} for w in words], "children": [{"word": w} for w in words]}])
    scores, *_ = al.score_all(batch.column("parents"), batch.column("children"), lambda w: al.distance_costs(w, -1.0))
    assert scores.tolist() == [-1.0 * plain_distance(p, c) for p in words for c in words]


def test_log_sums_of_any_numbers():
    values = np.array([-np.inf, -800.0, -3.0, 0.0, 2.5, 700.0])
    for some in (values, values[1:]):
        a, b = (x.reshape(-1) for x in np.meshgrid(some, some))
        np.testing.assert_allclose(passes.log_sum(a, b), np.logaddexp(a, b), rtol=1e-15, atol=1e-15)
