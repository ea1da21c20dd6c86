"""Queries over inference: edge scores, messages, marginals, decoding, re-estimation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordkin.functions.text import EMPTY
from wordkin.operators import evaluation as ev, messages as ms
from wordkin.operators.edit_model import EditModel
from wordkin.operators.estimation import (
    fit_alignment_features, fit_alignments, fit_branch_rate, fit_insertions, fit_rates,
)
from wordkin.operators.lexicon import alphabet, bigram_counts
from wordkin.operators.logit import FEATURES, fit_features
from wordkin.operators.pairs import EditScorer, expected_alignments, score_pairs, slot_blocks
from wordkin.plans import cluster_job as job, views
from wordkin.plans.catalog import LT, LT_CLOSURE, LT_LEAF, WL, query, shared, tree_values, with_
from wordkin.plans.catalog_words import BG, LANGS, alignment_stand_in, n_chars, words
from wordkin.session import cut, need_at_most


def step(spark: SparkSession, sf: str) -> ms.Inference:
    """One E-step with the Levenshtein scorer and the smoothed bigram model."""
    return shared(
        spark, sf, "step", lambda: job.fixed_cost_job(words(spark, sf), views.language_tree(spark))[0]
    )


def letters(spark: SparkSession, sf: str) -> list[str]:
    return shared(
        spark, sf, "letters", lambda: [r.ch for r in need_at_most(alphabet(words(spark, sf)).orderBy("idx"), job.UNICODE, "alphabet")]
    )


def first_model(spark: SparkSession, sf: str) -> EditModel:
    return EditModel.initial(letters(spark, sf))


def as_rows(df: DataFrame, *cols: str, digits: int = 4) -> DataFrame:
    """Named columns, node ids as bigint and scores rounded, for comparison."""
    out = []
    for c in cols:
        kind = dict(df.dtypes)[c]
        out.append(
            F.col(c).cast("bigint").alias(c) if kind == "int" else F.round(c, digits).alias(c) if kind == "double" else F.col(c)
        )
    return df.select(*out)


# ---- the same E-step in SQL -----------------------------------------------------------

MODEL = [
    WL, LT, LT_LEAF,
    "obs AS MATERIALIZED (SELECT slot, node_id, parent_id, word FROM wl JOIN leaf USING (language))",
    "legal AS MATERIALIZED (SELECT DISTINCT slot, word FROM wl)",
    "nc AS (SELECT count(*) + 1 AS n FROM (SELECT DISTINCT unnest(string_split(word, '')) FROM legal))",
    f"""wbg AS MATERIALIZED (SELECT word, substr(s, i, 1) AS prev, substr(s, i + 1, 1) AS next, count(*) AS c FROM (
      SELECT word, s, unnest(range(1, length(s))) AS i FROM (SELECT DISTINCT word, '{EMPTY}' || word || '{EMPTY}' AS s FROM legal)) GROUP BY ALL)""",
    "own AS (SELECT node_id, prev, next, sum(c)::DOUBLE AS cnt FROM (SELECT DISTINCT node_id, word FROM obs) JOIN wbg USING (word) GROUP BY ALL)",
    "ac AS (SELECT prev, next, 0.5::DOUBLE * sum(cnt) AS a FROM own GROUP BY ALL)",
    "num AS (SELECT lt.node_id, ac.prev, ac.next, coalesce(own.cnt, 0) + a AS c FROM ac CROSS JOIN lt LEFT JOIN own USING (node_id, prev, next))",
    "bl AS MATERIALIZED (SELECT node_id, prev, next, ln(c + 0.01::DOUBLE) - ln(sum(c) OVER (PARTITION BY node_id, prev) + 0.01::DOUBLE * (SELECT n FROM nc)) AS lp FROM num)",
    "lm AS MATERIALIZED (SELECT node_id, word, sum(c * lp) AS lm FROM wbg JOIN bl USING (prev, next) GROUP BY ALL)",
    "pr AS MATERIALIZED (SELECT a.slot, a.word AS p, b.word AS c, -4.0::DOUBLE * levenshtein(a.word, b.word) + ln(0.6::DOUBLE) AS kept FROM legal a JOIN legal b USING (slot))",
]


def mix(kept: str, repl: str) -> str:
    return f"(greatest({kept}, {repl}) + ln(1 + exp(-abs({kept} - {repl}))))"


NEW = "(lm.lm + ln(0.4::DOUBLE))"
UP = MODEL + [
    # joined step by step, so that no plan pairs rows by node alone
    "ol AS MATERIALIZED (SELECT o.slot, o.node_id, o.parent_id, o.word, lm.lm FROM obs o JOIN lm ON lm.node_id = o.node_id AND lm.word = o.word)",
    f"""leafm AS MATERIALIZED (SELECT pr.slot, lm.node_id, lm.parent_id, pr.p AS word, sum({mix('kept', NEW)}) AS lp
      FROM pr JOIN ol lm ON lm.slot = pr.slot AND lm.word = pr.c GROUP BY ALL)""",
    "bel1 AS MATERIALIZED (SELECT slot, parent_id AS node_id, word, sum(lp) AS lp FROM leafm GROUP BY ALL)",
    "top1 AS MATERIALIZED (SELECT *, max(lp) OVER (PARTITION BY slot, node_id) AS top FROM bel1)",
    "bl1 AS MATERIALIZED (SELECT b.slot, b.node_id, b.word, b.lp, b.top, lm.lm FROM top1 b JOIN lm ON lm.node_id = b.node_id AND lm.word = b.word)",
    f"""up1 AS MATERIALIZED (SELECT pr.slot, lm.node_id, pr.p AS word, max(lm.lp + {mix('kept', NEW)}) AS lp
      FROM pr JOIN bl1 lm ON lm.slot = pr.slot AND lm.word = pr.c
      WHERE lm.lp >= lm.top - 10 OR pr.p = pr.c GROUP BY ALL)""",
    "bel0 AS MATERIALIZED (SELECT slot, 0 AS node_id, word, sum(lp) AS lp FROM up1 GROUP BY ALL)",
    "rootm AS (SELECT slot, 0 AS node_id, word, lm AS lp FROM legal JOIN lm USING (word) WHERE lm.node_id = 0)",
    "bel AS (SELECT * FROM bel1 UNION ALL SELECT * FROM bel0)",
    "msg AS (SELECT slot, node_id, word, lp FROM leafm UNION ALL SELECT * FROM up1)",
    "rootb AS MATERIALIZED (SELECT slot, word, b.lp + r.lp AS lp FROM bel0 b JOIN rootm r USING (slot, word))",
]
LIK = "lik AS (SELECT slot, m + ln(sum(exp(lp - m))) AS log_likelihood FROM (SELECT *, max(lp) OVER (PARTITION BY slot) AS m FROM rootb) GROUP BY slot, m)"
DOWN1 = "down1 AS MATERIALIZED (SELECT u.slot, u.node_id, u.word, r.lp - u.lp AS lp FROM up1 u JOIN rootb r USING (slot, word))"
DOWN = UP + [
    DOWN1,
    """down2 AS MATERIALIZED (SELECT m.slot, m.node_id, m.word, d.lp + b.lp - m.lp AS lp FROM leafm m JOIN down1 d ON d.slot = m.slot AND d.word = m.word AND d.node_id = m.parent_id
      JOIN bel1 b ON b.slot = m.slot AND b.word = m.word AND b.node_id = m.parent_id)""",
    "down AS MATERIALIZED (SELECT * FROM rootm UNION ALL SELECT * FROM down1 UNION ALL SELECT * FROM down2)",
]
MARGINAL = DOWN + [
    "par AS MATERIALIZED (SELECT slot, node_id, word, lp FROM (SELECT *, max(lp) OVER (PARTITION BY slot, node_id) AS top FROM down) WHERE lp >= top - 10)",
    """chi AS MATERIALIZED (SELECT slot, node_id, word, word AS obs_word, 0.0::DOUBLE AS lp FROM obs
      UNION ALL SELECT slot, node_id, word, '', lp FROM (SELECT *, max(lp) OVER (PARTITION BY slot, node_id) AS top FROM bel) WHERE lp >= top - 10)""",
    f"""sc AS MATERIALIZED (SELECT c.slot, c.node_id, c.obs_word, p.word AS parent, c.word AS child, p.lp + c.lp + {mix('pr.kept', NEW)} AS score,
      1 / (1 + exp(pr.kept - {NEW})) AS resp
      FROM chi c JOIN par p ON p.slot = c.slot AND p.node_id = c.node_id JOIN pr ON pr.slot = c.slot AND pr.p = p.word AND pr.c = c.word
      JOIN lm ON lm.node_id = c.node_id AND lm.word = c.word)""",
    """mar AS MATERIALIZED (SELECT slot, node_id, obs_word, m + ln(sum(exp(score - m))) AS log_z, sum(exp(score - m) * resp) / sum(exp(score - m)) AS innovation
      FROM (SELECT *, max(score) OVER (PARTITION BY slot, node_id, obs_word) AS m FROM sc) GROUP BY slot, node_id, obs_word, m)""",
]
WEIGHTS = MARGINAL + [
    "pw AS MATERIALIZED (SELECT node_id, parent, child, exp(score - log_z) * (1 - resp) AS kept, exp(score - log_z) * resp AS new FROM sc JOIN mar USING (slot, node_id, obs_word))",
    """wt AS (SELECT node_id, parent, child, sum(CASE WHEN kept > 1e-8 THEN kept ELSE 0 END) AS kept_weight, sum(CASE WHEN new > 1e-8 THEN new ELSE 0 END) AS new_weight
      FROM pw WHERE kept > 1e-8 OR new > 1e-8 GROUP BY ALL)""",
]
DECODE = MARGINAL + [
    """cutn AS (SELECT slot, node_id FROM mar WHERE obs_word = '' AND node_id <> 0 AND innovation >= 0.5)""",
    """dec AS MATERIALIZED (SELECT w.obs_id, w.slot, w.language, w.gold_id, CASE WHEN m.innovation >= 0.5 THEN w.slot || '|word|' || w.obs_id
      WHEN c.node_id IS NOT NULL THEN w.slot || '|node|' || c.node_id ELSE w.slot || '|node|0' END AS cluster_id
      FROM wl w JOIN leaf USING (language) JOIN mar m ON m.slot = w.slot AND m.node_id = leaf.node_id AND m.obs_word = w.word
      LEFT JOIN cutn c ON c.slot = w.slot AND c.node_id = leaf.parent_id)""",
]
PRF = """t AS (SELECT (SELECT sum(n*(n-1)//2)::BIGINT FROM (SELECT count(*) AS n FROM dec GROUP BY cluster_id, gold_id)) AS correct,
  (SELECT sum(n*(n-1)//2)::BIGINT FROM (SELECT count(*) AS n FROM dec GROUP BY cluster_id)) AS guesses,
  (SELECT sum(n*(n-1)//2)::BIGINT FROM (SELECT count(*) AS n FROM dec GROUP BY gold_id)) AS gold)"""
PRF_OUT = """SELECT correct, guesses, gold, correct / guesses AS precision, correct / gold AS recall,
  round(2 * (correct / guesses) * (correct / gold) / (correct / guesses + correct / gold), 9) AS f1 FROM t"""


# ---- the whole job --------------------------------------------------------------------


@query("cluster_job", with_(*DECODE, PRF) + PRF_OUT)
def _(spark, sf):
    clusters = ms.decode(words(spark, sf), step(spark, sf))
    return ev.precision_recall(clusters).withColumn("f1", F.round("f1", 9))


@query("m7_em_job")
def _(spark, sf):
    # to its own stop
    result = job.run_job(words(spark, sf), views.language_tree(spark))
    return job.history_table(result, spark)


@query("m7_em_two_steps")
def _(spark, sf):
    result = job.run_job(words(spark, sf), views.language_tree(spark), max_iterations=2)
    return job.history_table(result, spark)


# ---- pair scores ----------------------------------------------------------------------


@query("e2_pair_likelihood", with_(WL, "nc AS (SELECT (count(*) + 1)::DOUBLE AS n FROM (SELECT DISTINCT unnest(string_split(word, '')) FROM wl))",
  "z AS (SELECT n, -ln((n - 1) * exp(-4.0::DOUBLE) + 1 + (n + 1) * exp(-4.0::DOUBLE)) - 4 AS gap FROM nc)") +
  "SELECT word, round(length(word) * gap + ln(1 - exp(ln(n) + gap)), 6) AS lp FROM (SELECT DISTINCT word FROM wl) CROSS JOIN z")
def _(spark, sf):
    # from the empty word only insertions are possible, which has a closed form
    pairs = words(spark, sf).select(F.lit(0).alias("node_id"), F.lit("").alias("parent"), F.col("word").alias("child")).distinct()
    return score_pairs(pairs, first_model(spark, sf)).select(F.col("child").alias("word"), F.round("lp", 6).alias("lp"))


@query("e2_symmetric_totals", with_(WL, "v AS (SELECT slot, count(DISTINCT word) AS n FROM wl GROUP BY 1)") + "SELECT slot, n * n AS pairs, 0.0::DOUBLE AS gap FROM v")
def _(spark, sf):
    # substitution and gap costs are symmetric, matches too: both directions of a slot sum up alike
    blocks = slot_blocks(words(spark, sf))
    pairs = EditScorer(first_model(spark, sf)).pairs(
        blocks.withColumn("children", F.transform("children", lambda c: F.struct(F.lit(0).alias("node_id"), c["word"].alias("word")))),
        ["slot"],
    )
    low = F.col("p.word") < F.col("c.word")
    high = F.col("p.word") > F.col("c.word")
    gap = F.sum(F.when(low, F.col("edit")).when(high, -F.col("edit")).otherwise(0.0))
    return pairs.groupBy("slot").agg(F.count("*").alias("pairs"), F.abs(F.round(gap, 3)).alias("gap"))


def gold_pairs(spark, sf) -> DataFrame:
    """Every word next to the largest word of its gold group."""
    w = words(spark, sf)
    top = w.groupBy("gold_id").agg(F.max("word").alias("parent"))
    return w.join(top, "gold_id").select(F.lit(0).alias("node_id"), "parent", F.col("word").alias("child")).distinct()


GOLD_PAIRS = "gp AS (SELECT DISTINCT t.parent, w.word AS child FROM wl w JOIN (SELECT gold_id, max(word) AS parent FROM wl GROUP BY 1) t USING (gold_id))"


# The sum over all alignments, one parent letter a step: row i holds the sums up to every place of the child. With one
# insertion cost, the sum over insertions after a match is a sum over where they begin.
ALIGNMENT_SUM = """q AS (SELECT exp(-4.0::DOUBLE) AS w, (n - 1) * exp(-4.0::DOUBLE) + 1 + (n + 1) * exp(-4.0::DOUBLE) AS z, n
    FROM (SELECT (count(*) + 1)::DOUBLE AS n FROM (SELECT DISTINCT unnest(string_split(word, '')) FROM wl))),
  al AS (SELECT parent, child, 0 AS i, w / z AS gap, 1 / z AS same, n, list_transform(range(0, length(child) + 1), lambda j: pow(w / z, j)) AS t FROM gp CROSS JOIN q
    UNION ALL SELECT parent, child, i + 1, gap, same, n, list_transform(range(0, length(child) + 1), lambda j: gap * t[j + 1] + coalesce(list_sum(list_transform(range(0, j),
      lambda k: pow(gap, j - 1 - k) * t[k + 1] * CASE WHEN parent[i + 1] = child[k + 1] THEN same ELSE gap END)), 0)) AS t
    FROM (SELECT parent, child, i, gap, same, n, t FROM al WHERE i < length(parent)))"""


@query("e2_alignment_sum", with_(WL, GOLD_PAIRS, ALIGNMENT_SUM, recursive=True) +
  "SELECT parent, child, round(ln(t[length(child) + 1]) + ln(1 - n * gap), 6) AS lp FROM al WHERE i = length(parent)")
def _(spark, sf):
    return score_pairs(gold_pairs(spark, sf), first_model(spark, sf)).select("parent", "child", F.round("lp", 6).alias("lp"))


@query("e3_expected_alignments", with_(WL, GOLD_PAIRS) + "SELECT parent, child, length(parent)::DOUBLE AS parent_chars, length(child)::DOUBLE AS child_chars FROM gp")
def _(spark, sf):
    rows = expected_alignments(gold_pairs(spark, sf), first_model(spark, sf), per_pair=True)

    def total(side):
        return F.round(F.sum(F.when(F.col(side) != EMPTY, F.col("cnt")).otherwise(0.0)), 3)

    return rows.groupBy("parent", "child").agg(total("x").alias("parent_chars"), total("y").alias("child_chars"))


@query("x1_pluggable_scorer", with_(*MODEL, f"leafm AS (SELECT pr.slot, o.node_id, pr.p AS word, sum({mix('kept', NEW)}) AS lp FROM pr JOIN obs o ON o.slot = pr.slot AND o.word = pr.c JOIN lm ON lm.node_id = o.node_id AND lm.word = pr.c GROUP BY ALL)") +
  "SELECT node_id::BIGINT AS node_id, count(*) AS messages, round(sum(lp), 2) AS total FROM leafm GROUP BY 1")
def _(spark, sf):
    base = step(spark, sf)

    def own_scorer(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("edit", F.levenshtein(F.col("p.word"), F.col("c.word")) * F.lit(-4.0))

    model = ms.EdgeModel(own_scorer, base.model.bigrams, {}, 0.4)
    again = ms.Inference(words(spark, sf), base.shape, model, (base.obs, base.legal, base.pairs))
    return again.leaf_messages().groupBy(F.col("node_id").cast("bigint").alias("node_id")).agg(
        F.count("*").alias("messages"), F.round(F.sum("lp"), 2).alias("total")
    )


@query("e4_innovation_cost", with_(*MODEL, f"co AS (SELECT o.node_id, pr.slot, pr.c AS word, max({mix('kept', NEW)}) AS best, min({mix('kept', NEW)}) AS worst FROM pr JOIN obs o ON o.slot = pr.slot AND o.word = pr.c JOIN lm ON lm.node_id = o.node_id AND lm.word = pr.c GROUP BY ALL)") +
  "SELECT node_id::BIGINT AS node_id, slot, word, round(best, 4) AS best, round(worst, 4) AS worst FROM co")
def _(spark, sf):
    return as_rows(step(spark, sf).edge_cost_range(), "node_id", "slot", "word", "best", "worst")


# ---- messages ---------------------------------------------------------------------------


@query("b2_indicator_beliefs", with_(*MODEL) + "SELECT slot, node_id::BIGINT AS node_id, word, 0.0::DOUBLE AS lp FROM obs")
def _(spark, sf):
    return as_rows(step(spark, sf).obs.withColumn("lp", F.lit(0.0)), "slot", "node_id", "word", "lp")


@query("b3_root_message", with_(*UP) + "SELECT slot, word, round(lp, 4) AS lp FROM rootm")
def _(spark, sf):
    return as_rows(step(spark, sf).root_message(), "slot", "word", "lp")


@query("j5_leaf_messages", with_(*UP) + "SELECT slot, node_id::BIGINT AS node_id, word, round(lp, 4) AS lp FROM leafm")
def _(spark, sf):
    return as_rows(step(spark, sf).leaf_messages(), "slot", "node_id", "word", "lp")


@query("a9_message_projection", with_(*UP) + "SELECT slot, node_id::BIGINT AS node_id, word, round(lp, 4) AS lp FROM up1")
def _(spark, sf):
    messages, _ = step(spark, sf).upward()
    return as_rows(messages.filter(F.col("node_id").isin(1, 2)), "slot", "node_id", "word", "lp")


@query("b4_upward_pass", with_(*UP) + "SELECT slot, node_id::BIGINT AS node_id, word, round(lp, 4) AS lp FROM bel")
def _(spark, sf):
    _, beliefs = step(spark, sf).upward()
    return as_rows(beliefs, "slot", "node_id", "word", "lp")


@query("b5_downward_pass", with_(*DOWN) + "SELECT slot, node_id::BIGINT AS node_id, word, round(lp, 4) AS lp FROM down")
def _(spark, sf):
    return as_rows(step(spark, sf).downward(), "slot", "node_id", "word", "lp")


@query("j6_sibling_messages", with_(*DOWN) + "SELECT d.slot, d.node_id::BIGINT AS node_id, round(sum(d.lp - r.lp), 4) AS siblings FROM down1 d JOIN rootm r USING (slot, word) GROUP BY 1, 2")
def _(spark, sf):
    s = step(spark, sf)
    root = s.root_message().select("slot", "word", F.col("lp").alias("_r"))
    rows = s.downward().filter(F.col("node_id").isin(1, 2)).join(root, ["slot", "word"])
    return as_rows(rows.groupBy("slot", "node_id").agg(F.sum(F.col("lp") - F.col("_r")).alias("siblings")), "slot", "node_id", "siblings")


@query("j7_belief_product", with_(*UP) + "SELECT slot, word, round(lp, 4) AS lp FROM rootb")
def _(spark, sf):
    return as_rows(step(spark, sf).root_belief(), "slot", "word", "lp")


@query("p7_beam", with_(*UP) + "SELECT slot, node_id::BIGINT AS node_id, word, round(lp, 4) AS lp FROM (SELECT *, max(lp) OVER (PARTITION BY slot, node_id) AS top FROM bel) WHERE lp >= top - 10")
def _(spark, sf):
    s = step(spark, sf)
    return as_rows(s.beam(s.upward()[1]), "slot", "node_id", "word", "lp")


@query("a10_log_partition", with_(*UP, LIK) + "SELECT slot, round(log_likelihood, 4) AS log_likelihood FROM lik")
def _(spark, sf):
    return as_rows(step(spark, sf).slot_likelihood(), "slot", "log_likelihood")


@query("a26_total_likelihood", with_(*UP, LIK) + "SELECT round(sum(log_likelihood), 2) AS log_likelihood, count(*) AS slots FROM lik")
def _(spark, sf):
    return as_rows(step(spark, sf).likelihood(), "log_likelihood", "slots", digits=2)


@query("w1_normalised_belief", with_(*UP, LIK) + "SELECT slot, word, round(lp - log_likelihood, 4) AS lp FROM rootb JOIN lik USING (slot)")
def _(spark, sf):
    return as_rows(ms.normalized(step(spark, sf).root_belief()), "slot", "word", "lp")


@query("t2_best_ancestor", with_(*UP) + "SELECT slot, arg_max(word, (lp, word)) AS word, round(max(lp), 4) AS lp FROM (SELECT slot, word, round(lp, 9) AS lp FROM rootb) GROUP BY 1")
def _(spark, sf):
    # rounded first, so that words that tie by symmetry tie in every engine
    best = ms.best_words(step(spark, sf).root_belief().withColumn("lp", F.round("lp", 9)))
    return as_rows(best, "slot", "word", "lp")


@query("t2_top_words", with_(*UP) + """SELECT slot, word, row_number() OVER (PARTITION BY slot ORDER BY lp DESC, word DESC) AS rank FROM (SELECT slot, word, round(lp, 9) AS lp FROM rootb) QUALIFY rank <= 3""")
def _(spark, sf):
    top = ms.top_words(step(spark, sf).root_belief().withColumn("lp", F.round("lp", 9)), 3)
    return top.select("slot", "word", F.col("rank").cast("bigint").alias("rank"))


@query("w6_top_k_mass", with_(*UP, LIK, "nb AS (SELECT slot, round(lp - log_likelihood, 9) AS lp, word FROM rootb JOIN lik USING (slot))",
  "rk AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY lp DESC, word DESC) AS rank FROM nb)") +
  "SELECT slot, rank, round(sum(exp(lp)) OVER (PARTITION BY slot ORDER BY rank), 4) AS mass FROM rk QUALIFY rank <= 5")
def _(spark, sf):
    rows = ms.mass_of_top(step(spark, sf).root_belief(), 5)
    return rows.select("slot", F.col("rank").cast("bigint").alias("rank"), F.round("mass", 4).alias("mass"))


@query("b6_edge_marginals", with_(*MARGINAL) + "SELECT slot, node_id::BIGINT AS node_id, obs_word, round(log_z, 4) AS log_z FROM mar")
def _(spark, sf):
    return as_rows(step(spark, sf).edge_marginals(), "slot", "node_id", "obs_word", "log_z")


@query("b7_innovation_posterior", with_(*MARGINAL) + "SELECT slot, node_id::BIGINT AS node_id, obs_word, round(innovation, 6) AS innovation FROM mar")
def _(spark, sf):
    return as_rows(step(spark, sf).edge_marginals(), "slot", "node_id", "obs_word", "innovation", digits=6)


@query("p8_weight_threshold", with_(*WEIGHTS) + "SELECT node_id::BIGINT AS node_id, count(*) AS pairs, round(sum(kept_weight), 4) AS kept_weight, round(sum(new_weight), 4) AS new_weight FROM wt GROUP BY 1")
def _(spark, sf):
    w = step(spark, sf).pair_weights()
    return as_rows(
        w.groupBy("node_id").agg(F.count("*").alias("pairs"), F.sum("kept_weight").alias("kept_weight"), F.sum("new_weight").alias("new_weight")),
        "node_id", "pairs", "kept_weight", "new_weight",
    )


@query("a27_innovation_counts", with_(*MARGINAL) + "SELECT node_id::BIGINT AS node_id, round(sum(innovation), 4) AS yes, count(*)::DOUBLE AS n FROM mar GROUP BY 1")
def _(spark, sf):
    return as_rows(step(spark, sf).innovation_counts(), "node_id", "yes", "n")


@query("b8_cluster_decode", with_(*DECODE) + "SELECT obs_id, cluster_id FROM dec")
def _(spark, sf):
    return ms.decode(words(spark, sf), step(spark, sf)).select("obs_id", "cluster_id")


@query("w5_deepest_cut", with_(*MARGINAL, "c AS (SELECT slot, node_id FROM mar WHERE obs_word = '' AND node_id <> 0 AND innovation >= 0.5)") +
  "SELECT c.slot, leaf.language, c.node_id::VARCHAR AS anchor FROM c JOIN leaf ON leaf.parent_id = c.node_id")
def _(spark, sf):
    return ms.cut_anchors(step(spark, sf)).select("slot", "language", F.col("anchor").cast("string").alias("anchor"))


BELIEF = [
    "dt AS MATERIALIZED (SELECT *, max(lp) OVER (PARTITION BY slot, node_id) AS top FROM down1)",
    """dp AS MATERIALIZED (SELECT pr.slot, d.node_id, pr.c, pr.kept, d.lp FROM pr JOIN dt d ON d.slot = pr.slot AND d.word = pr.p
      WHERE d.lp >= d.top - 10 OR pr.p = pr.c)""",
    f"""pd AS MATERIALIZED (SELECT dp.slot, dp.node_id, dp.c AS word, max(dp.lp + {mix('dp.kept', NEW)}) AS lp FROM dp
      JOIN lm ON lm.node_id = dp.node_id AND lm.word = dp.c GROUP BY ALL)""",
]


@query("b9_node_beliefs", with_(*UP, DOWN1, *BELIEF) + """SELECT slot, node_id::BIGINT AS node_id, word, round(pd.lp + bel1.lp, 4) AS lp FROM pd JOIN bel1 USING (slot, node_id, word)
  UNION ALL SELECT slot, 0, word, round(lp, 4) FROM rootb""")
def _(spark, sf):
    return as_rows(step(spark, sf).node_beliefs(), "slot", "node_id", "word", "lp")


@query("b10_new_bigram_counts", with_(*WEIGHTS) + """SELECT node_id::BIGINT AS node_id, prev, next, round(sum(new_weight * c), 4) AS cnt FROM wt JOIN wbg ON wbg.word = wt.child WHERE new_weight > 0 GROUP BY ALL""")
def _(spark, sf):
    w = step(spark, sf).pair_weights().filter("new_weight > 0")
    rows = bigram_counts(w.withColumnRenamed("child", "word"), weight=F.col("new_weight"))
    return as_rows(rows, "node_id", "prev", "next", "cnt")


def kept_weights(spark, sf) -> DataFrame:
    w = step(spark, sf).pair_weights().filter("kept_weight > 0")
    return w.select("node_id", "parent", "child", F.col("kept_weight").alias("weight"))


@query("b10_alignment_counts", with_(*WEIGHTS) + """SELECT node_id::BIGINT AS node_id, round(sum(kept_weight * length(parent)), 0) AS parent_chars, round(sum(kept_weight * length(child)), 0) AS child_chars FROM wt GROUP BY 1""")
def _(spark, sf):
    rows = shared(spark, sf, "aligned", lambda: cut(expected_alignments(kept_weights(spark, sf), first_model(spark, sf))))

    def total(side):
        return F.round(F.sum(F.when(F.col(side) != EMPTY, F.col("cnt")).otherwise(0.0)), 0)

    return rows.groupBy(F.col("node_id").cast("bigint").alias("node_id")).agg(total("x").alias("parent_chars"), total("y").alias("child_chars"))


FACTOR_SQL = with_(
    *MODEL,
    f"""fc AS (SELECT o.node_id, sum(pr.kept - ln(0.6::DOUBLE)) AS edit, sum(lm.lm) AS bigrams, sum({mix('kept', NEW)}) AS mixture
      FROM pr JOIN obs o ON o.slot = pr.slot AND o.word = pr.c JOIN lm ON lm.node_id = o.node_id AND lm.word = pr.c GROUP BY 1)""",
    "rt AS (SELECT sum(-4.0::DOUBLE * length(word)) AS edit, sum(lm.lm) AS bigrams FROM legal JOIN lm USING (word) WHERE lm.node_id = 0)",
) + """SELECT 'edit' AS model, node_id::BIGINT AS node_id, round(edit, 2) AS total FROM fc UNION ALL SELECT 'bigrams', node_id, round(bigrams, 2) FROM fc
  UNION ALL SELECT 'mixture', node_id, round(mixture, 2) FROM fc UNION ALL SELECT 'edit', 0, round(edit, 2) FROM rt
  UNION ALL SELECT 'bigrams', 0, round(bigrams, 2) FROM rt UNION ALL SELECT 'mixture', 0, round(bigrams, 2) FROM rt"""


@query("x2_factor_model", FACTOR_SQL)
def _(spark, sf):
    """Leaf and root messages of three factor models: edit only, bigrams only, and their mixture."""
    base = step(spark, sf)
    out = None
    for name in ms.FACTORS:
        model = replace(base.model, factors=name)
        again = ms.Inference(words(spark, sf), base.shape, model, (base.obs, base.legal, base.pairs))
        messages = again.leaf_messages().select("node_id", "lp").unionAll(again.root_message().select("node_id", "lp"))
        rows = messages.groupBy("node_id").agg(F.sum("lp").alias("total")).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return as_rows(out, "model", "node_id", "total", digits=2)


# ---- a deeper tree, leaves at several depths ------------------------------------------------


def deep_step(spark: SparkSession, sf: str) -> ms.Inference:
    return shared(spark, sf, "deep_step", lambda: job.fixed_cost_job(words(spark, sf), views.deep_tree(spark))[0])


def _deep_sql() -> list[str]:
    """The messages node by node, from the deepest inner node up and down again; then marginals as above."""
    tree = views.DEEP_TREE
    inner = sorted({r[1] for r in tree if r[1] is not None}, key=lambda n: -next(r[5] for r in tree if r[0] == n))
    leaf = UP[UP.index(next(x for x in UP if x.startswith("ol AS"))) :][:2]
    out = [tree_values(tree) if x == LT else x for x in MODEL] + leaf

    def message(c: int) -> str:
        return f"up_{c}" if c in inner else f"(SELECT slot, word, lp FROM leafm WHERE node_id = {c})"

    for n in inner:
        kids = [r[0] for r in tree if r[1] == n]
        out.append(f"bel_{n} AS MATERIALIZED (SELECT slot, word, sum(lp) AS lp FROM (" + " UNION ALL ".join(f"SELECT slot, word, lp FROM {message(c)}" for c in kids) + ") GROUP BY slot, word)")
        if n:
            out.append(f"""sl_{n} AS MATERIALIZED (SELECT b.*, max(b.lp) OVER (PARTITION BY slot) AS top, lm.lm FROM bel_{n} b JOIN lm ON lm.node_id = {n} AND lm.word = b.word)""")
            out.append(f"""up_{n} AS MATERIALIZED (SELECT pr.slot, pr.p AS word, max(lm.lp + {mix('kept', NEW)}) AS lp FROM pr JOIN sl_{n} lm ON lm.slot = pr.slot AND lm.word = pr.c
              WHERE lm.lp >= lm.top - 10 OR pr.p = pr.c GROUP BY ALL)""")
    out.append("down_0 AS MATERIALIZED (SELECT slot, word, lm AS lp FROM legal JOIN lm USING (word) WHERE lm.node_id = 0)")
    for n in reversed(inner):
        for c in (r[0] for r in tree if r[1] == n):
            out.append(f"down_{c} AS MATERIALIZED (SELECT m.slot, m.word, d.lp + b.lp - m.lp AS lp FROM {message(c)} m JOIN down_{n} d USING (slot, word) JOIN bel_{n} b USING (slot, word))")
    out.append("bel AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT slot, {n} AS node_id, word, lp FROM bel_{n}" for n in inner) + ")")
    out.append("down AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT slot, {r[0]} AS node_id, word, lp FROM down_{r[0]}" for r in tree) + ")")
    return out


DEEP = _deep_sql()
DEEP_MARGINAL = DEEP + MARGINAL[len(DOWN):]
_ABOVE = {r[0]: r[1] for r in views.DEEP_TREE}


def _ancestors(n: int) -> list[int]:
    up = _ABOVE[n]
    return [] if up in (None, 0) else [up, *_ancestors(up)]


DEEP_DECODE = DEEP_MARGINAL + [
    "anc(leaf_id, node_id, depth) AS (VALUES " + ", ".join(f"({r[0]}, {a}, {next(x[5] for x in views.DEEP_TREE if x[0] == a)})" for r in views.DEEP_TREE for a in _ancestors(r[0])) + ")",
    "cutn AS (SELECT m.slot, anc.leaf_id, arg_max(anc.node_id, anc.depth) AS node_id FROM mar m JOIN anc USING (node_id) WHERE m.obs_word = '' AND innovation >= 0.5 GROUP BY 1, 2)",
    """dec AS MATERIALIZED (SELECT w.obs_id, w.slot, w.language, w.gold_id, CASE WHEN m.innovation >= 0.5 THEN w.slot || '|word|' || w.obs_id
      ELSE w.slot || '|node|' || coalesce(c.node_id, 0) END AS cluster_id
      FROM wl w JOIN leaf USING (language) JOIN mar m ON m.slot = w.slot AND m.node_id = leaf.node_id AND m.obs_word = w.word
      LEFT JOIN cutn c ON c.slot = w.slot AND c.leaf_id = leaf.node_id)""",
]


@query("b4_deep_upward", with_(*DEEP) + "SELECT slot, node_id::BIGINT AS node_id, word, round(lp, 4) AS lp FROM bel")
def _(spark, sf):
    return as_rows(deep_step(spark, sf).upward()[1], "slot", "node_id", "word", "lp")


@query("b5_deep_downward", with_(*DEEP) + "SELECT slot, node_id::BIGINT AS node_id, word, round(lp, 4) AS lp FROM down")
def _(spark, sf):
    return as_rows(deep_step(spark, sf).downward(), "slot", "node_id", "word", "lp")


@query("b7_deep_marginals", with_(*DEEP_MARGINAL) + "SELECT slot, node_id::BIGINT AS node_id, obs_word, round(log_z, 4) AS log_z, round(innovation, 6) AS innovation FROM mar")
def _(spark, sf):
    rows = deep_step(spark, sf).edge_marginals()
    return rows.select("slot", F.col("node_id").cast("bigint").alias("node_id"), "obs_word", F.round("log_z", 4).alias("log_z"), F.round("innovation", 6).alias("innovation"))


@query("b8_deep_decode", with_(*DEEP_DECODE) + "SELECT obs_id, cluster_id FROM dec")
def _(spark, sf):
    return ms.decode(words(spark, sf), deep_step(spark, sf)).select("obs_id", "cluster_id")


@query("w5_deep_cut", with_(*DEEP_DECODE) + "SELECT c.slot, leaf.language, c.node_id::VARCHAR AS anchor FROM cutn c JOIN leaf ON leaf.node_id = c.leaf_id")
def _(spark, sf):
    return ms.cut_anchors(deep_step(spark, sf)).select("slot", "language", F.col("anchor").cast("string").alias("anchor"))


# ---- re-estimation ---------------------------------------------------------------------------


def language_counts(spark, sf) -> DataFrame:
    """(node_id, yes, n) per language: words of at least seven letters among all words."""
    return words(spark, sf).groupBy(F.col("language").alias("node_id")).agg(
        F.sum((F.length("word") >= 7).cast("double")).alias("yes"), F.count("*").cast("double").alias("n")
    )


def rates_sql(counts: str, l2: float) -> str:
    """Newton steps over a table rc(node_id, yes, n): a shared part b and a penalised weight per node. The steps of the
    weights follow from that of the shared part."""
    return f"""{counts},
  ls AS (SELECT list(node_id ORDER BY node_id) AS ids, list(yes ORDER BY node_id) AS y, list(n ORDER BY node_id) AS n, {l2}::DOUBLE AS l2 FROM rc),
  nw AS (SELECT 0 AS k, 0.0::DOUBLE AS b, list_transform(y, lambda v: 0.0::DOUBLE) AS w FROM ls
    UNION ALL SELECT k + 1, b + db, list_transform(range(1, len(w) + 1), lambda i: w[i] - (g[i] + h[i] * db) / (h[i] + l2)) FROM (
      SELECT *, -(list_sum(list_transform(range(1, len(w) + 1), lambda i: g[i] - l2 * w[i])) - list_sum(list_transform(range(1, len(w) + 1), lambda i: h[i] / (h[i] + l2) * g[i])))
        / (list_sum(h) - list_sum(list_transform(range(1, len(w) + 1), lambda i: h[i] * h[i] / (h[i] + l2)))) AS db FROM (
      SELECT *, list_transform(range(1, len(w) + 1), lambda i: n[i] * p[i] - y[i] + l2 * w[i]) AS g, list_transform(range(1, len(w) + 1), lambda i: n[i] * p[i] * (1 - p[i])) AS h FROM (
      SELECT nw.*, ls.y, ls.n, ls.l2, list_transform(w, lambda v: 1 / (1 + exp(-(b + v)))) AS p FROM nw, ls WHERE k < 40)))),
  fr AS (SELECT unnest(ids) AS node_id, unnest(list_transform(w, lambda v: 1 / (1 + exp(-(b + v))))) AS p FROM nw, ls WHERE k = 40)"""


LONG_WORDS = "rc AS (SELECT language AS node_id, sum((length(word) >= 7)::INT)::DOUBLE AS yes, count(*)::DOUBLE AS n FROM wl GROUP BY 1)"


@query("m5_innovation_rate", with_(WL, rates_sql(LONG_WORDS, 1e-4), recursive=True) + "SELECT node_id, round(p, 6) AS p FROM fr")
def _(spark, sf):
    return fit_rates(language_counts(spark, sf)).withColumn("p", F.round("p", 6))


AL = f"ac AS (SELECT language AS node_id, prev AS x, next AS y, sum(0.5::DOUBLE) AS cnt FROM bg WHERE NOT (prev = '{EMPTY}' AND next = '{EMPTY}') GROUP BY ALL)"
STEPS = f"rc AS (SELECT node_id, sum(CASE WHEN x = '{EMPTY}' THEN cnt ELSE 0 END)::DOUBLE AS yes, sum(cnt)::DOUBLE AS n FROM ac GROUP BY 1)"


NODE_RATES = "rc AS (SELECT node_id, sum(innovation) AS yes, count(*)::DOUBLE AS n FROM mar GROUP BY 1)"


@query("m7_one_step", with_(*DECODE, LIK, PRF, rates_sql(NODE_RATES, 1e-4), recursive=True) + f"""SELECT node_id::BIGINT AS node_id, round(p, 5) AS rate,
  (SELECT round(sum(log_likelihood), 2) FROM lik) AS log_likelihood, (SELECT f1 FROM ({PRF_OUT})) AS f1 FROM fr""")
def _(spark, sf):
    """One whole iteration of the job with given costs: likelihood, decoded groups, and the rates it goes on with."""
    w, tree = words(spark, sf), views.language_tree(spark)
    first = job.given_model(w, ms.TreeShape.of(tree))
    result = job.run_job(w, tree, max_iterations=1, first=first)
    row = result.history[0]
    rates = spark.createDataFrame([(int(k), float(p)) for k, p in result.model.innovation.items()], "node_id long, rate double")
    return rates.select("node_id", F.round("rate", 5).alias("rate"), F.round(F.lit(row["log_likelihood"]), 2).alias("log_likelihood"), F.round(F.lit(row["f1"]), 9).alias("f1"))


@query("m4_insertion_rate", with_(WL, BG, AL, rates_sql(STEPS, 2.0), recursive=True) + "SELECT node_id, round(p, 6) AS ins FROM fr")
def _(spark, sf):
    return fit_insertions(alignment_stand_in(spark, sf)).withColumn("ins", F.round("ins", 6))


def varied_tree(spark) -> DataFrame:
    """The language tree with every third branch twice as long, so that the rate has no closed form."""
    return views.language_tree(spark).withColumn("branch_length", F.when(F.col("node_id") % 3 == 0, F.col("branch_length") * 2).otherwise(F.col("branch_length")))


BRANCH_RATE = """vt AS (SELECT node_id, label, branch_length * CASE WHEN node_id % 3 = 0 THEN 2 ELSE 1 END AS branch_length FROM lt),
  rb AS (SELECT vt.branch_length AS x, yes, n FROM rc JOIN vt ON vt.label = rc.node_id),
  nr AS (SELECT 0 AS k, 0.0::DOUBLE AS r UNION ALL
    SELECT k + 1, r + (sum(x * (yes - n / (1 + exp(-r * x)))) - 1e-4 * r) / (sum(x * x * n * exp(-r * x) / pow(1 + exp(-r * x), 2)) + 1e-4) FROM nr, rb WHERE k < 40 GROUP BY k, r)"""


@query("m6_branch_rate", with_(WL, LT, LONG_WORDS, BRANCH_RATE, recursive=True) +
  "SELECT vt.node_id::BIGINT AS node_id, round(1 / (1 + exp(-r * branch_length)), 6) AS p FROM vt, nr WHERE k = 40")
def _(spark, sf):
    tree = varied_tree(spark)
    leaf = tree.select("node_id", "label")
    counts = language_counts(spark, sf).withColumnRenamed("node_id", "label").join(F.broadcast(leaf), "label")
    return as_rows(fit_branch_rate(counts.select("node_id", "yes", "n"), tree), "node_id", "p", digits=6)


# At the fit no slope is left; a feature has a weight for everything it looks at (the empty symbol never steps to itself).
GRADIENT_SQL = with_(WL, "nc AS (SELECT count(*) + 1 AS n FROM (SELECT DISTINCT unnest(string_split(word, '')) FROM wl))", "nn AS (SELECT count(DISTINCT language) AS k FROM wl)") + """
  SELECT feature, (CASE WHEN feature LIKE 'language_%' THEN k ELSE 1 END * CASE WHEN feature LIKE '%pair' THEN n * n - 1 WHEN feature LIKE '%child' THEN n ELSE 1 END)::BIGINT AS weights,
  0.0::DOUBLE AS slope FROM (VALUES {features}) f(feature), nc, nn"""


def feature_slopes(spark, sf, features: tuple[str, ...]) -> DataFrame:
    """Per feature: how many weights it has, and the largest slope of the penalised likelihood at the fit. Slopes are
    worked out anew, from the table of weights and the shares that follow from them."""
    counts = cut(alignment_stand_in(spark, sf))
    fit = fit_features(counts, letters(spark, sf), features, iterations=5_000)
    shares = fit.shares(counts.select("node_id", "x").distinct())
    total = counts.groupBy("node_id", "x").agg(F.sum("cnt").alias("total"))
    cells = shares.join(total, ["node_id", "x"]).join(counts, ["node_id", "x", "y"], "left")
    left = cut(cells.select("node_id", "x", "y", (F.coalesce("cnt", F.lit(0.0)) - F.col("total") * F.col("p")).alias("left")))
    slopes = None
    for name in features:
        plain = name.removeprefix("language_")
        keys = {"pair": ["x", "y"], "child": ["y"], "match": []}[plain] + (["node_id"] if plain != name else [])
        held = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("node_id", "x", "y")]
        sums = (left.filter("x = y") if plain == "match" else left).groupBy(*keys).agg(F.sum("left").alias("left"))
        sums = sums.select(F.lit(name).alias("feature"), *held, "left")
        slopes = sums if slopes is None else slopes.unionAll(sums)
    weights = fit.table(spark, "string")
    on = (F.col("w.feature") == F.col("s.feature")) & F.col("w.node_id").eqNullSafe(F.col("s.node_id")) & F.col("w.x").eqNullSafe(F.col("s.x")) & F.col("w.y").eqNullSafe(F.col("s.y"))
    both = weights.alias("w").join(slopes.alias("s"), on, "left")
    slope = F.coalesce("s.left", F.lit(0.0)) - 2.0 * F.col("w.weight")
    return both.groupBy("w.feature").agg(F.count("*").alias("weights"), F.round(F.max(F.abs(slope)), 3).alias("slope"))


@query("m3_feature_estimate", GRADIENT_SQL.format(features="('pair'), ('child'), ('match'), ('language_pair'), ('language_child'), ('language_match')"))
def _(spark, sf):
    return feature_slopes(spark, sf, FEATURES)


@query("x4_feature_choice", GRADIENT_SQL.format(features="('child'), ('match'), ('language_pair')"))
def _(spark, sf):
    return feature_slopes(spark, sf, ("child", "match", "language_pair"))


MASS_SQL = with_(WL, BG, f"ac AS (SELECT DISTINCT language AS node_id, prev AS x FROM bg WHERE prev <> '{EMPTY}')") + "SELECT node_id, x, 1.0::DOUBLE AS mass FROM ac"


@query("m2_alignment_normalised", MASS_SQL)
def _(spark, sf):
    abc = letters(spark, sf)
    return mass_per_character(fit_alignments(alignment_stand_in(spark, sf), abc, first_model(spark, sf)))


@query("m3_feature_mass", MASS_SQL)
def _(spark, sf):
    return mass_per_character(fit_alignment_features(alignment_stand_in(spark, sf), letters(spark, sf), first_model(spark, sf)))


def mass_per_character(model: EditModel) -> DataFrame:
    """(node_id, x, mass): per parent character, all insertions and all other steps share a mass of one."""
    size = len(model.alphabet)
    seen = model.rows.groupBy("node_id", "x").agg(F.sum(F.exp("lp")).alias("own"), F.count("*").alias("k"))
    floor = model.defaults.filter(F.col("x").isNotNull()).select("node_id", "x", F.exp("lp").alias("unseen"))
    cells = F.when(F.col("x") == EMPTY, F.lit(size - 1)).otherwise(F.lit(size))
    both = seen.join(floor, ["node_id", "x"], "left").select(
        "node_id", "x", (F.col("own") + (cells - F.col("k")) * F.coalesce("unseen", F.lit(0.0))).alias("part")
    )
    ins = both.filter(F.col("x") == EMPTY).select("node_id", F.col("part").alias("ins"))
    return both.filter(F.col("x") != EMPTY).join(ins, "node_id").select("node_id", "x", F.round(F.col("part") + F.col("ins"), 6).alias("mass"))
