"""Pair scores and alignment counts against full enumeration."""

import math
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordkin.operators import edit_model as em
from wordkin.operators.edit_model import EditModel
from wordkin.operators.pairs import (
    EditScorer, as_scorer, candidate_summary, expected_alignments, levenshtein_scorer, pair_blocks, score_pairs, with_blocks,
)

ABC = ["∅", "a", "b", "ʤ"]
WORDS = ["", "a", "ab", "aʤb", "ʤab", "bba"]


def enumerate_alignments(x, y, cost, stop):
    """All alignments; an insertion never follows a deletion. Returns total and pair counts."""
    counts: dict = {}
    total = 0.0

    def walk(i, j, last, p, steps):
        nonlocal total
        if i == len(x) and j == len(y):
            total += p * stop
            for s in steps:
                counts[s] = counts.get(s, 0.0) + p * stop
            return
        if j < len(y) and last != "d":
            walk(i, j + 1, "i", p * cost("∅", y[j]), steps + [("∅", y[j])])
        if i < len(x):
            walk(i + 1, j, "d", p * cost(x[i], "∅"), steps + [(x[i], "∅")])
        if i < len(x) and j < len(y):
            walk(i + 1, j + 1, "m", p * cost(x[i], y[j]), steps + [(x[i], y[j])])

    walk(0, 0, "m", 1.0, [])
    return total, {k: v / total for k, v in counts.items()}


def uniform_cost(model):
    u = model.uniform

    def cost(a, b):
        return math.exp(u.match if a == b else u.gap if "∅" in (a, b) else u.substitute)

    return cost


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(0, p, c) for p in WORDS for c in WORDS]
    return spark.createDataFrame(rows, "node_id int, parent string, child string").repartition(3)


def check(pairs, model, cost, stop):
    got = {(r.parent, r.child): r.lp for r in score_pairs(pairs, model).collect()}
    counts: dict = {}
    for r in expected_alignments(pairs, model, per_pair=True).collect():
        counts.setdefault((r.parent, r.child), {})[(r.x, r.y)] = r.cnt
    assert len(got) == len(WORDS) ** 2
    for (p, c), lp in got.items():
        total, want = enumerate_alignments(p, c, cost, stop)
        assert lp == pytest.approx(math.log(total), abs=1e-9)
        for key in set(want) | set(counts.get((p, c), {})):
            assert counts.get((p, c), {}).get(key, 0.0) == pytest.approx(want.get(key, 0.0), abs=1e-5)


def test_uniform_costs(pairs):
    model = EditModel.initial(ABC)
    check(pairs, model, uniform_cost(model), math.exp(model.uniform.stop))


def test_sparse_tables_and_log_space(pairs, monkeypatch):
    from wordkin.operators import alignment

    monkeypatch.setattr(em, "MAX_CELLS", 9)
    model = EditModel.initial(ABC)
    assert not model._dense()
    check(pairs, model, uniform_cost(model), math.exp(model.uniform.stop))
    table = model.parts()[0]
    words = alignment._Words(__import__("pyarrow").array(WORDS), table)
    p, c = np.repeat(np.arange(6), 6), np.tile(np.arange(6), 6)
    plain = alignment.score_pairs(words, p, c, np.zeros(36, int), table)
    monkeypatch.setattr(alignment, "PLAIN_LIMIT", 0.0)
    assert np.allclose(plain, alignment.score_pairs(words, p, c, np.zeros(36, int), table), atol=1e-9)


def test_learned_costs_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(em, "MAX_CELLS", 20)
    rows = spark.createDataFrame([(1, "a", "b", -0.5), (2, "a", "b", -1.5)], "node_id int, x string, y string, lp double")
    floor = spark.createDataFrame(
        [(1, None, -2.0), (1, "∅", -3.0), (2, None, -2.5), (2, "∅", -4.0)], "node_id int, x string, lp double"
    )
    start = EditModel.initial(ABC)
    model = EditModel(ABC, start.uniform, rows, floor).with_initial([1, 2, 3])
    assert len(model.parts()) == 3
    pairs = spark.createDataFrame([(n, "ab", "bʤ") for n in (1, 2, 3)], "node_id int, parent string, child string")
    got = {r.node_id: r.lp for r in score_pairs(pairs, model).collect()}

    def cost(lp_ab, low, ins):
        return lambda a, b: math.exp(lp_ab if (a, b) == ("a", "b") else ins if a == "∅" else low)

    for node, args in ((1, (-0.5, -2.0, -3.0)), (2, (-1.5, -2.5, -4.0))):
        total, _ = enumerate_alignments("ab", "bʤ", cost(*args), 1.0)
        assert got[node] == pytest.approx(math.log(total), abs=1e-9)
    total, _ = enumerate_alignments("ab", "bʤ", uniform_cost(start), math.exp(start.uniform.stop))
    assert got[3] == pytest.approx(math.log(total), abs=1e-9)
    weighted = pairs.withColumn("weight", F.lit(2.0))
    sums = expected_alignments(weighted, model).groupBy("node_id").agg(
        F.sum(F.when(F.col("x") != "∅", F.col("cnt")).otherwise(0.0)).alias("s")
    )
    assert [round(r.s, 3) for r in sums.collect()] == [4.0, 4.0, 4.0]


def test_child_strings_share_a_mass_of_one():
    u = em.uniform_costs(3)

    @lru_cache(None)
    def mass(length, i, last_d):
        # probability of all child strings over two letters given a parent of that length
        out = math.exp(u.stop) if i == length else 0.0
        if i < length:
            out += math.exp(u.gap) * mass(length, i + 1, True)
            out += (math.exp(u.match) + math.exp(u.substitute)) * mass(length, i + 1, False)
        ins = 2 * math.exp(u.gap)
        return out if last_d else out / (1 - ins)

    assert 0.5 < mass(2, 0, False) <= 1.0 + 1e-9


def test_very_long_words(spark):
    word = "ab" * 400
    pairs = spark.createDataFrame([(0, "a", word), (0, word, word)], "node_id int, parent string, child string")
    got = {r.parent: r.lp for r in score_pairs(pairs, EditModel.initial(ABC)).collect()}
    assert all(math.isfinite(v) for v in got.values())
    assert got["a"] < -3000 < got[word]


def test_unknown_character_is_refused(spark):
    pairs = spark.createDataFrame([(0, "a", "z")], "node_id int, parent string, child string")
    with pytest.raises(Exception, match="alphabet"):
        score_pairs(pairs, EditModel.initial(ABC)).collect()


def test_hot_slot_blocks_give_every_pair_once(spark):
    words = spark.createDataFrame([("s", f"w{i}") for i in range(50)] + [("t", "w1")], "slot string, word string")
    rows = with_blocks(words, block=7)
    assert rows.filter("slot = 's'").select("nb").distinct().collect()[0].nb == 8
    item = F.struct("word")
    blocks = pair_blocks(rows.withColumn("p", item), rows.withColumn("c", item), ["slot"])
    pairs = levenshtein_scorer().pairs(blocks, ["slot"]).select("slot", "p.word", F.col("c.word").alias("other"))
    assert pairs.count() == pairs.distinct().count() == 50 * 50 + 1
    assert blocks.filter("size(parents) > 25 or size(children) > 25").count() == 0
    whole = candidate_summary(words).orderBy("slot", "word").collect()
    assert whole == candidate_summary(words, block=7).orderBy("slot", "word").collect()


def test_scorers(spark):
    words = spark.createDataFrame([("s", "abab"), ("s", "abba"), ("s", "b")], "slot string, word string")
    best = {r.word: (r.partner, r.score) for r in candidate_summary(words, "dice").collect()}
    assert best["abab"][0] == "abba"
    model = EditModel.initial(["∅", "a", "b"])

    def own(pairs):
        return pairs.withColumn("edit", -F.abs(F.length("p.word") - F.length("c.word")).cast("double"))

    assert {r.word: r.partner for r in candidate_summary(words, own).collect()}["abab"] == "abba"
    with_node = words.withColumn("p", F.struct("word")).withColumn("c", F.struct(F.lit(1).alias("node_id"), "word"))
    rows = with_blocks(with_node)
    out = as_scorer(EditScorer(model)).pairs(pair_blocks(rows, rows, ["slot"]), ["slot"])
    assert out.count() == 9


def block_lists(blocks, nodes=None):
    import pyarrow as pa

    def side(i, names):
        rows = [[{"word": w, "node_id": k % names if names else 0} for k, w in enumerate(b[i])] for b in blocks]
        return pa.array(rows, pa.list_(pa.struct([("word", pa.string()), ("node_id", pa.int64())])))

    return side(0, 0), side(1, nodes)


@pytest.mark.parametrize("letters, longest, rows", [("ab", 6, 1), ("abʤ", 12, 3), ("abʤ", 90, 2)])
def test_tries_score_every_pair_as_alone(letters, longest, rows, monkeypatch):
    """Blocks with equal, empty and long words: the shared tables hold what each pair gives on its own."""
    import random

    from wordkin.operators import alignment
    from wordkin.operators.costs import CostTable

    rng = random.Random(longest)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(60)]
    words += [w + w[:3] for w in words[:20]] + ["", ""]
    blocks = [([rng.choice(words) for _ in range(rng.randint(0, 25))], [rng.choice(words) for _ in range(rng.randint(0, 25))]) for _ in range(30)]
    n = len(letters) + 1
    np_rng = np.random.default_rng(3)
    cells = np.log(np_rng.uniform(0.01, 0.3, (rows, n, n)))
    costs = CostTable("\0" + letters, list(range(rows)), cells, np_rng.uniform(-1, 0, rows), rows == 1)
    lists = block_lists(blocks, rows)
    got = {}
    for least in (0, 16, 10**9):
        monkeypatch.setattr(alignment, "TRIE_PAIRS", least)
        got[least] = alignment.score_blocks(*lists, costs)
        assert got[least].offsets.to_pylist()[-1] == sum(len(a) * len(b) for a, b in blocks)
    for least in (0, 16):
        np.testing.assert_allclose(np.asarray(got[least].values), np.asarray(got[10**9].values), rtol=1e-12)
    monkeypatch.setattr(alignment, "TRIE_PAIRS", 0)
    monkeypatch.setattr(alignment.tries, "CELLS", 50)
    np.testing.assert_allclose(np.asarray(alignment.score_blocks(*lists, costs).values), np.asarray(got[0].values), rtol=1e-12)


def test_equal_words_of_a_block_are_one_entry():
    """A word in four languages adds no cells under shared costs, and one set of nodes a cost row otherwise."""
    from wordkin.operators import tries

    letters = np.array([[0, 1, 2], [0, 1, 3], [0, -1, -1]])
    length = np.array([3, 3, 1])
    for rows in (1, 4):
        block = np.zeros(12, np.int64)
        entries = tries.distinct(block, np.arange(12) % rows, np.repeat([0, 1, 2], 4))
        trie = tries.PrefixTrie(*entries[:3], letters, length, 1)
        assert trie.size.tolist() == [{1: 5, 4: 20}[rows]]
        assert len(entries[0]) == 3 * rows
