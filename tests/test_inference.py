"""Messages, marginals and decoding against enumeration on small trees."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordkin.operators import messages as ms, pairs as pr
from wordkin.operators.edit_model import EditModel
from wordkin.operators.estimation import (
    fit_alignment_features, fit_alignments, fit_branch_rate, fit_insertions, fit_rates,
)
from wordkin.operators.lexicon import BigramModel, alphabet, bigram_counts, fit_bigrams
from wordkin.plans import cluster_job as job

NODES = "node_id int, parent_id int, label string, branch_length double, ordinal int, depth int"
# root -> (x -> (a, b)), c
TREE = [(0, None, "r", 0.0, 0, 0), (1, 0, "x", 1.0, 0, 1), (2, 0, "c", 2.0, 1, 1), (3, 1, "a", 0.5, 0, 2), (4, 1, "b", 1.5, 1, 2)]
WORDS = [("s", "a", "ab"), ("s", "b", "abb"), ("s", "c", "ba"), ("t", "a", "bb"), ("t", "b", "bb")]


def as_words(spark, rows):
    return spark.createDataFrame(
        [(s, l, w, s, f"{i}:{l}") for i, (s, l, w) in enumerate(rows)],
        "slot string, language string, word string, gold_id string, obs_id string",
    )


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(TREE, NODES).select(F.lit("t").alias("tree_id"), "*")


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def edge(p, c, q=0.4, n=3):
    return math.log(math.exp(-4.0 * lev(p, c)) * (1 - q) + math.exp(-math.log(n) * (len(c) + 1)) * q)


def lm(w, n=3):
    return -math.log(n) * (len(w) + 1)


def logsum(v):
    m = max(v)
    return m + math.log(sum(math.exp(x - m) for x in v))


def infer(spark, tree, rows, **options):
    model = ms.EdgeModel("levenshtein", BigramModel.flat(3), {}, 0.4, **options)
    return ms.Inference(as_words(spark, rows), tree, model)


def test_sum_messages_equal_enumeration(spark, tree):
    step = infer(spark, tree, WORDS, semiring="sum", project_parent=True, beam=1e9)
    legal = ["ab", "abb", "ba"]
    joint = {
        (r, x): lm(r) + edge(r, x) + edge(r, "ba") + edge(x, "ab") + edge(x, "abb")
        for r, x in itertools.product(legal, legal)
    }
    z = logsum(list(joint.values()))
    got = {r.slot: r.log_likelihood for r in step.slot_likelihood().collect()}
    assert got["s"] == pytest.approx(z, abs=1e-9)
    # the partition is the same on every edge below the root
    for r in step.edge_marginals().filter("slot = 's' and node_id <> 0").collect():
        assert r.log_z == pytest.approx(z, abs=1e-9), r
    # posterior that the edge into x replaced the word
    want = 0.0
    for (r, x), lp in joint.items():
        new = math.exp(lm(x)) * 0.4
        want += math.exp(lp - z) * new / math.exp(edge(r, x))
    got = {(r.node_id, r.obs_word): r.innovation for r in step.edge_marginals().filter("slot = 's'").collect()}
    assert got[(1, "")] == pytest.approx(want, abs=1e-9)
    # node beliefs are the unnormalised posteriors
    below = {r.word: r.lp for r in step.node_beliefs().filter("slot = 's' and node_id = 1").collect()}
    for x in legal:
        assert below[x] == pytest.approx(logsum([joint[(r, x)] for r in legal]), abs=1e-9)


def test_default_messages_follow_the_recurrence(spark, tree):
    step = infer(spark, tree, WORDS)
    legal = ["ab", "abb", "ba"]
    bel = {x: edge(x, "ab") + edge(x, "abb") for x in legal}
    top = max(bel.values())
    up = {r: max(bel[x] + edge(r, x) for x in legal if bel[x] >= top - 10 or x == r) for r in legal}
    messages, _ = step.upward()
    got = {(r.node_id, r.word): r.lp for r in messages.filter("slot = 's'").collect()}
    down = {(r.node_id, r.word): r.lp for r in step.downward().filter("slot = 's'").collect()}
    for w in legal:
        assert got[(1, w)] == pytest.approx(up[w])
        assert got[(2, w)] == pytest.approx(edge(w, "ba"))
        assert down[(0, w)] == pytest.approx(lm(w))
        assert down[(1, w)] == pytest.approx(lm(w) + edge(w, "ba"))
        # the parent edge is not projected through by default
        assert down[(3, w)] == pytest.approx(lm(w) + edge(w, "ba") + edge(w, "abb"))


def test_separate_factor_models(spark, tree):
    """One factor alone, with a long word: costs, root messages, posteriors and M-steps of that factor only."""
    rows = WORDS + [("s", "c", "ab" * 15)]
    legal = ["ab", "abb", "ba", "ab" * 15]
    alone = {"edit": (lambda p, c: -4.0 * lev(p, c), lambda w: -4.0 * len(w), 0.0), "bigrams": (lambda p, c: lm(c), lm, 1.0)}
    for name, (cost, root, replaced) in alone.items():
        step = infer(spark, tree, rows, factors=name)
        leaf = {(r.node_id, r.word): r.lp for r in step.leaf_messages().filter("slot = 's'").collect()}
        top = {r.word: r.lp for r in step.root_message().filter("slot = 's'").collect()}
        for w in legal:
            assert leaf[(2, w)] == pytest.approx(cost(w, "ba") + cost(w, "ab" * 15))
            assert top[w] == pytest.approx(root(w))
        assert {r.innovation for r in step.edge_marginals().collect()} == {replaced}
    letters = ["∅", "a", "b"]
    for name, learnt in (("edit", "scorer"), ("bigrams", "bigrams")):
        start = job.initial_model(letters, factors=name)
        step = ms.Inference(as_words(spark, rows), tree, start)
        after = job.re_estimate(step, letters, start)
        assert {k for k in ("scorer", "bigrams", "innovation") if getattr(after, k) is not getattr(start, k)} == {learnt}
    with pytest.raises(ValueError):
        infer(spark, tree, rows, factors="none")


def test_repeated_words_multiply(spark, tree):
    once = infer(spark, tree, WORDS[3:]).slot_likelihood().first().log_likelihood
    twice = infer(spark, tree, WORDS[3:] + [("t", "a", "bb")])
    assert twice.obs.filter("n = 2").count() == 1
    assert twice.slot_likelihood().first().log_likelihood < once


def test_hot_slot_is_split_without_changing_results(spark, tree, monkeypatch):
    rng = random.Random(3)
    rows = [("hot", rng.choice("abc"), "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))) for _ in range(60)]
    rows = sorted(set(rows)) + WORDS

    def everything():
        step = infer(spark, tree, rows)
        marg = {(r.slot, r.node_id, r.obs_word): (round(r.log_z, 8), round(r.innovation, 8)) for r in step.edge_marginals().collect()}
        like = {r.slot: round(r.log_likelihood, 8) for r in step.slot_likelihood().collect()}
        weights = {(r.node_id, r.parent, r.child): round(r.kept_weight, 8) for r in step.pair_weights().collect()}
        clusters = sorted(map(tuple, ms.decode(as_words(spark, rows), step).select("obs_id", "cluster_id").collect()))
        top = sorted((r.slot, r["rank"], r.word) for r in ms.top_words(step.root_belief(), 2).collect())
        return marg, like, weights, clusters, top, step.legal.agg(F.max("nb")).first()[0]

    whole = everything()
    monkeypatch.setattr(pr, "BLOCK", 5)
    monkeypatch.setattr(pr.with_blocks, "__defaults__", ("slot", "word", 5))
    split = everything()
    assert split[-1] > 5 and whole[-1] == 1
    assert whole[:-1] == split[:-1]


def test_weights_sum_to_the_observations(spark, tree):
    step = infer(spark, tree, WORDS)
    w = step.pair_weights().groupBy("node_id").agg(F.sum(F.col("kept_weight") + F.col("new_weight")).alias("w"))
    assert {r.node_id: round(r.w, 5) for r in w.collect()} == {0: 2.0, 1: 2.0, 2: 1.0, 3: 2.0, 4: 2.0}
    yes = {r.node_id: r for r in step.innovation_counts().collect()}
    assert yes[3].n == 2.0 and 0 <= yes[3].yes <= 2.0


def recursive_groups(children, leaf_words, node, cut_nodes, cut_words):
    """Groups below a node: (open group, closed groups)."""
    open_group, closed = [], []
    for c in children.get(node, []):
        if c in leaf_words:
            for w in leaf_words[c]:
                if w in cut_words:
                    closed.append([w])
                else:
                    open_group.append(w)
        else:
            inner, done = recursive_groups(children, leaf_words, c, cut_nodes, cut_words)
            closed += done
            if c in cut_nodes:
                closed.append(inner)
            else:
                open_group += inner
    return open_group, closed


def test_decode_equals_the_recursive_definition(spark):
    for seed in range(4):
        rng = random.Random(seed)
        nodes, children = [(0, None, "n0", 1.0, 0, 0)], {}
        for i in range(1, 14):
            p = rng.choice(nodes)
            nodes.append((i, p[0], f"n{i}", 1.0, 0, p[5] + 1))
            children.setdefault(p[0], []).append(i)
        leaf = [n[0] for n in nodes if n[0] not in children]
        rows = [("s", f"n{rng.choice(leaf)}", f"w{k}") for k in range(15)]
        words = as_words(spark, rows)
        tree = spark.createDataFrame(nodes, NODES)
        shape = ms.TreeShape.of(tree)
        cut_nodes = {n for n in children if n and rng.random() < 0.4}
        cut_words = {w for _, _, w in rows if rng.random() < 0.3}
        marks = [("s", n, "", 1.0, 0.0, 0.9 if n in cut_nodes else 0.1) for n in children]
        marks += [("s", shape.leaf_of[l], w, 1.0, 0.0, 0.9 if w in cut_words else 0.1) for _, l, w in rows]

        class Fixed:
            pass

        fixed = Fixed()
        fixed.shape, fixed.spark = shape, spark
        fixed.legal = pr.with_blocks(words.select("slot", "word").distinct())
        frame = spark.createDataFrame(marks, "slot string, node_id int, obs_word string, n double, log_z double, innovation double")
        fixed.edge_marginals = lambda frame=frame: frame
        got = {}
        for r in ms.decode(words, fixed).collect():
            got.setdefault(r.cluster_id, set()).add(r.word)
        leaf_words = {x: [w for _, l, w in rows if l == f"n{x}"] for x in leaf}
        top, closed = recursive_groups(children, leaf_words, 0, cut_nodes, cut_words)
        want = {frozenset(g) for g in closed + [top] if g}
        assert {frozenset(g) for g in got.values()} == want


def test_em_job(spark, tree):
    rows = [(s, l, w) for s, base in (("s1", "abab"), ("s2", "bbaa"), ("s3", "aabba")) for l, w in
            (("a", base), ("b", base.replace("ab", "b")), ("c", base + "a"))]
    result = job.run_job(as_words(spark, rows), tree, max_iterations=4)
    assert [h["iter"] for h in result.history] == list(range(len(result.history)))
    assert result.history[1]["log_likelihood"] > result.history[0]["log_likelihood"]
    assert result.clusters.count() == 9
    again = job.run_job(as_words(spark, rows), tree, max_iterations=2, alignment="features", branch_lengths_after=0)
    assert set(again.model.innovation) == {0, 1, 2, 3, 4}
    assert job.history_table(again, spark).count() == 2


COUNTS = [("n1", "a", "a", 8.0), ("n1", "a", "b", 2.0), ("n1", "∅", "a", 1.0), ("n1", "b", "∅", 3.0),
          ("n2", "a", "b", 5.0), ("n2", "b", "b", 5.0), ("n2", "∅", "b", 2.0)]


def test_alignment_estimates(spark):
    counts = spark.createDataFrame(COUNTS, "node_id string, x string, y string, cnt double")
    abc = ["∅", "a", "b"]
    start = EditModel.initial(abc)
    import numpy as np

    for model in (fit_alignments(counts, abc, start), fit_alignment_features(counts, abc, start)):
        table = model.parts()[0]
        p = np.exp(table.cells)
        k = table.node_ids.index("n1")
        assert p[k, 1, 1] > p[k, 1, 2]
        assert np.all(table.stop == 0.0)
    closed = np.exp(fit_alignments(counts, abc, start).parts()[0].cells)
    assert np.allclose(closed[:, 0, 1:].sum(axis=1, keepdims=True) + closed[:, 1:, :].sum(axis=2), 1.0)
    learned = np.exp(fit_alignment_features(counts, abc, start).parts()[0].cells)
    ins = {r.node_id: r.ins for r in fit_insertions(counts).collect()}
    for k, node in enumerate(["n1", "n2"]):
        assert learned[k, 0, 1:].sum() == pytest.approx(ins[node], abs=1e-6)
        assert np.allclose(learned[k, 1:, :].sum(axis=1), 1 - ins[node], atol=1e-6)


def test_feature_fits(spark, monkeypatch):
    """No slope is left at the fit, in one place and over rows in tasks; copies per language and the match feature count."""
    from wordkin.operators import logit

    rng = np.random.default_rng(8)
    chars = ["∅", "a", "b", "c"]
    rows = [(n, x, y, float(rng.integers(0, 30))) for n in ("n1", "n2", "n3") for x in chars for y in chars if x != "∅" or y != "∅"]
    counts = spark.createDataFrame(rows, "node_id string, x string, y string, cnt double").filter("cnt > 3")
    seen = {r[:3]: r[3] for r in rows if r[3] > 3}
    fits = {}
    for features in (logit.FEATURES, ("child", "match"), ("pair", "language_match")):
        for cells in (logit.LOCAL_CELLS, 0):
            monkeypatch.setattr(logit, "LOCAL_CELLS", cells)
            fit = logit.fit_features(counts, chars, features, iterations=300 if cells else 60, tolerance=1e-7)
            fits[features, cells] = fit.weights
        monkeypatch.undo()
        fit = logit.fit_features(counts, chars, features, iterations=300, tolerance=1e-7)
        p = {(r.node_id, r.x, r.y): r.p for r in fit.shares(counts.select("node_id", "x").distinct()).collect()}
        total = {}
        for (n, x, y), c in seen.items():
            total[n, x] = total.get((n, x), 0.0) + c
        for key in {k[:2] for k in p}:
            assert sum(v for k, v in p.items() if k[:2] == key) == pytest.approx(1)
        for r in fit.table(spark, "string").collect():
            plain = r.feature.removeprefix("language_")
            mine = [k for k in p if r.node_id in (None, k[0]) and r.x in (None, k[1]) and r.y in (None, k[2]) and (plain != "match" or k[1] == k[2])]
            assert sum(seen.get(k, 0.0) - total[k[:2]] * p[k] for k in mine) - 2 * r.weight == pytest.approx(0, abs=1e-4)
        np.testing.assert_allclose(fits[features, 0], fits[features, logit.LOCAL_CELLS], atol=0.02)
    with pytest.raises(ValueError):
        logit.fit_features(counts, chars, ("vowel",))


def test_rates(spark):
    counts = spark.createDataFrame([("a", 3.0, 10.0), ("b", 8.0, 10.0)], "node_id string, yes double, n double")
    got = {r.node_id: r.p for r in fit_rates(counts).collect()}
    assert got["a"] == pytest.approx(0.3, abs=1e-3) and got["b"] == pytest.approx(0.8, abs=1e-3)
    none = spark.createDataFrame([("a", 0.0, 10.0)], "node_id string, yes double, n double")
    assert fit_rates(none).first().p == pytest.approx(0.5 / 11)
    tree = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", float("inf"))], "node_id string, branch_length double")
    p = {r.node_id: r.p for r in fit_branch_rate(counts, tree).collect()}
    # slope of the likelihood at the fitted rate is zero
    assert (3 - 10 * p["a"]) * 1.0 + (8 - 10 * p["b"]) * 2.0 == pytest.approx(0.0, abs=1e-2)
    flat = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "node_id string, branch_length double")
    assert fit_branch_rate(counts, flat).first().p == pytest.approx(11 / 20)
    never = spark.createDataFrame([("a", 0.0, 10.0), ("b", 0.0, 10.0)], "node_id string, yes double, n double")
    assert fit_branch_rate(never, flat).first().p == pytest.approx(0.5 / 21)
    still = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "node_id string, branch_length double")
    assert fit_branch_rate(counts, still).first().p == pytest.approx(0.5)


def test_bigram_model_defaults(spark):
    words = spark.createDataFrame([("n", "ab")], "node_id string, word string")
    counts = bigram_counts(words).withColumn("cnt", F.col("cnt").cast("double"))
    model = fit_bigrams(counts, ["n", "m"], 4)
    from wordkin.operators.lexicon import word_scores

    items = spark.createDataFrame([("n", "ab"), ("m", "ab"), ("n", "ba"), ("z", "c")], "node_id string, word string")
    got = {(r.node_id, r.word): r.lm for r in word_scores(items, model).collect()}
    seen, unseen = math.log(1.51) - math.log(1.54), math.log(0.01) - math.log(1.54)
    assert got[("n", "ab")] == pytest.approx(3 * seen)
    assert got[("m", "ab")] == pytest.approx(3 * (math.log(0.51) - math.log(0.54)))
    assert got[("n", "ba")] == pytest.approx(3 * unseen)
    assert got[("z", "c")] == pytest.approx(-2 * math.log(4))
    assert alphabet(words).count() == 3


def test_word_scores_of_large_models_are_joined(spark, monkeypatch):
    """Too large for a table: the same scores by joins, unknown nodes and characters and empty words included."""
    from wordkin.operators import lexicon

    rows = [(n, w) for n in ("n", "m") for w in ("ab", "aé", "bʤb", "")]
    counts = bigram_counts(spark.createDataFrame(rows[:5], "node_id string, word string")).withColumn("cnt", F.col("cnt").cast("double"))
    items = spark.createDataFrame([*rows, ("z", "ab"), ("n", "xyx"), ("m", "a" * 300)], "node_id string, word string")
    small_model = fit_bigrams(counts, ["n", "m"], 5)
    got = {(r.node_id, r.word): r.lm for r in lexicon.word_scores(items, small_model).collect()}
    monkeypatch.setattr(lexicon, "TABLE_CELLS", 0)
    large = {(r.node_id, r.word): r.lm for r in lexicon.word_scores(items, fit_bigrams(counts, ["n", "m"], 5)).collect()}
    assert got.keys() == large.keys() and len(got) == 11
    for key, lm in got.items():
        assert lm == pytest.approx(large[key], abs=1e-9)


@pytest.mark.parametrize("semiring, down", [("max", False), ("sum", True)])
def test_passes_in_tasks_equal_passes_over_rows(spark, semiring, down):
    """The same E-step with pairs as rows, and with sums kept inside the tasks that score them; several blocks a slot."""
    from dataclasses import replace

    from wordkin.operators.messages import Inference, decode
    from wordkin.operators.pairs import ColumnScorer
    from wordkin.plans import views

    rng = np.random.default_rng(4)
    rows = []
    for k in range(700):
        slot = "st"[k % 7 == 0]
        w = "".join("aeiou"[i] for i in rng.integers(0, 5, rng.integers(1, 6)))
        rows.append((slot, ("en", "de", "fr", "es")[k % 4], w))
    tree = views.language_tree(spark)
    df = as_words(spark, rows)
    step, _ = job.fixed_cost_job(df, tree)
    fast = replace(step.model, semiring=semiring, project_parent=down, innovation={3: 0.2, 5: 0.6})
    slow = replace(fast, scorer=ColumnScorer(lambda p, c: F.levenshtein(p, c).cast("double") * F.lit(-4.0)))
    one, two = (Inference(df, step.shape, m, (step.obs, step.legal, step.pairs)) for m in (fast, slow))
    assert one._reduces() and not two._reduces() and step.legal.agg(F.max("nb")).first()[0] > 1

    def same(a, b, keys, values):
        left, right = ({tuple(r[k] for k in keys): [r[v] for v in values] for r in x.collect()} for x in (a, b))
        assert left.keys() == right.keys() and left
        for k, v in left.items():
            assert v == pytest.approx(right[k], abs=1e-9)

    keys = ["slot", "node_id", "word"]
    same(one.upward()[1], two.upward()[1], keys, ["lp"])
    same(one.downward(), two.downward(), keys, ["lp"])
    same(one.node_beliefs(), two.node_beliefs(), keys, ["lp"])
    same(one.edge_marginals(), two.edge_marginals(), ["slot", "node_id", "obs_word"], ["log_z", "innovation", "n"])
    same(one.pair_weights(), two.pair_weights(), ["node_id", "parent", "child"], ["kept_weight", "new_weight"])
    same(decode(df, one).withColumn("z", F.lit(0)), decode(df, two).withColumn("z", F.lit(0)), ["obs_id", "cluster_id"], ["z"])


def test_rates_solve_their_equations(spark):
    """At the fit the gradient is zero: n p - yes + l2 w per node, and the sum over all nodes for the shared part."""
    from wordkin.operators.estimation import fit_branch_rate, fit_rates

    rng = np.random.default_rng(6)
    rows = [(k, float(y), float(n)) for k, (y, n) in enumerate((rng.integers(0, n + 1), n) for n in rng.integers(1, 400, 300))] + [(900, 0.0, 50.0), (901, 7.0, 7.0)]
    counts = spark.createDataFrame(rows, "node_id int, yes double, n double").repartition(5)
    for l2 in (1e-4, 2.0):
        p = {r.node_id: r.p for r in fit_rates(counts, l2).collect()}
        assert len(p) == len(rows)
        assert sum(n * p[k] - y for k, y, n in rows) == pytest.approx(0, abs=1e-3)
        score = {k: math.log(p[k] / (1 - p[k])) for k in p}
        shared = [score[k] + (n * p[k] - y) / l2 for k, y, n in rows]
        assert max(shared) - min(shared) < 1e-2 / l2
    tree = spark.createDataFrame([(k, 0.1 + (k % 5)) for k, _, _ in rows] + [(2000, float("inf"))], "node_id int, branch_length double")
    p = {r.node_id: r.p for r in fit_branch_rate(counts, tree).collect()}
    length = {k: 0.1 + k % 5 for k, _, _ in rows}
    r = math.log(p[0] / (1 - p[0])) / length[0]
    assert sum(length[k] * (n * p[k] - y) for k, y, n in rows) + 1e-4 * r == pytest.approx(0, abs=1e-6)


def test_marginals_of_very_unequal_words(spark):
    """One short word among long ones: the guessed shift fails there and the exact sum takes over."""
    from wordkin.operators.lexicon import alphabet
    from wordkin.operators.messages import Inference, TreeShape, prepare
    from wordkin.plans import cluster_job, views

    rows = [("s", x, "a" * 1200, "g", f"{x}:1") for x in ("de", "en", "es")] + [("s", "fr", "a", "g", "fr:1")]
    words = spark.createDataFrame(rows, "slot string, language string, word string, gold_id string, obs_id string")
    shape = TreeShape.of(views.language_tree(spark))
    letters = [r.ch for r in alphabet(words).collect()]
    step = Inference(words, shape, cluster_job.initial_model(letters), prepare(words, shape))
    got = step.edge_marginals().collect()
    assert got and all(math.isfinite(r.log_z) and 0.0 <= r.innovation <= 1.0 for r in got)


def test_stopped_job_goes_on_behind_its_last_iteration(spark, tree, monkeypatch, tmp_path):
    """Killed before a commit and after a half-written iteration: the same history, groups and model as in one go."""
    import os

    from wordkin.session import scratch_dir

    rng = random.Random(3)
    rows = [(s, l, "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))) for s in "stuv" for l in "abc" for _ in range(3)]
    words = as_words(spark, rows)
    whole = job.run_job(words, tree, max_iterations=4, state=str(tmp_path / "whole"))
    commit, calls = job.JobState.commit, []

    def killed(self, row):
        calls.append(row["iter"])
        if len(calls) in (2, 4):
            raise KeyboardInterrupt
        commit(self, row)

    monkeypatch.setattr(job.JobState, "commit", killed)
    state = str(tmp_path / "stopped")
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            job.run_job(words, tree, max_iterations=4, state=state)
    again = job.run_job(words, tree, max_iterations=4, state=state)
    assert calls == [0, 1, 1, 2, 2, 3]
    assert [h["iter"] for h in again.history] == [0, 1, 2, 3]
    for a, b in zip(whole.history, again.history):
        assert a["log_likelihood"] == pytest.approx(b["log_likelihood"], abs=1e-9) and a["f1"] == b["f1"]
    assert sorted(again.clusters.collect()) == sorted(whole.clusters.collect())
    assert again.model.innovation == pytest.approx(whole.model.innovation)
    # A finished job is only read.
    calls.clear()
    assert job.run_job(words, tree, max_iterations=4, state=state).reason == "iteration limit" and calls == []
    with pytest.raises(ValueError, match="another job"):
        job.run_job(words.limit(5), tree, max_iterations=4, state=state)
    # Tables between steps are gone: an iteration leaves none of its own.
    before = len(os.listdir(scratch_dir(spark).removeprefix("file:")))
    job.run_job(words, tree, max_iterations=5, state=state)
    assert len(os.listdir(scratch_dir(spark).removeprefix("file:"))) - before < 6
