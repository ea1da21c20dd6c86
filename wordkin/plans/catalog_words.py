"""Queries over word lists: sources, sinks, filters, character models, groups, evaluation."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wordkin.functions.logmath import log_sum, mixture, responsibility, sigmoid
from wordkin.functions.ordered import ranked
from wordkin.functions.text import (
    EMPTY, bigram_set, bigrams, chars, clean_language, dice, first_variant, gloss_of,
)
from wordkin.operators import clusters as cl, evaluation as ev, lexicon as lx
from wordkin.operators.edit_model import uniform_costs
from wordkin.operators.estimation import alignment_table
from wordkin.operators.pairs import candidate_summary, levenshtein_scorer
from wordkin.operators.trees import clade_vocabulary, leaf_words, leaves, subtree_at
from wordkin.plans import views
from wordkin.plans.catalog import LT, LT_CLOSURE, LT_LEAF, TOK, WL, query, shared, with_
from wordkin.session import cut, scratch_dir
from wordkin.sources import comparative as comp, wordlists as wls

LANGS = views.LANGUAGES


def words(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "words", lambda: cut(views.word_list(spark, sf)))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return views.wide_text(spark, sf)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """Words with the slot as their cluster."""
    return words(spark, sf).withColumn("cluster_id", F.col("slot"))


# ---- sources and sinks ---------------------------------------------------------------

CELLS = """cells AS (SELECT slot, gold_id || '#' || row_number() OVER (PARTITION BY slot, gold_id, language ORDER BY word) AS gold_id,
  language, word FROM wl)"""


@query("s1_wide_word_list", with_(WL, CELLS) + "SELECT 'g' || slot AS slot, language, word, gold_id FROM cells")
def _(spark, sf):
    return wls.parse_wide(wide(spark, sf), LANGS, has_gloss=True).select("slot", "language", "word", "gold_id")


@query("s2_header_languages", "SELECT (row_number() OVER (ORDER BY lang) - 1)::BIGINT AS pos, lang AS language FROM (SELECT DISTINCT lang FROM documents)")
def _(spark, sf):
    header = views.table(spark, sf, "documents").agg(
        F.concat(F.lit("# "), F.array_join(F.array_sort(F.collect_set("lang")), " ")).alias("value")
    )
    return wls.header_languages(header).select(F.col("pos").cast("bigint").alias("pos"), "language")


@query("s3_load_dataset", with_(WL, CELLS) + "SELECT 'g' || slot AS slot, language, word FROM cells")
def _(spark, sf):
    base = f"{scratch_dir(spark)}/wordlist-{uuid4().hex}"
    wls.write_wordlist(wide(spark, sf), LANGS, base + "/words")
    spark.createDataFrame([("(ROOT (A (en) (de)) (B (fr) (es)))",)], "value string").write.text(base + "/tree")
    data = wls.load_dataset(spark, base + "/words/*", base + "/tree", LANGS, has_gloss=True)
    return leaf_words(data.words, data.tree).select("slot", "language", "word")


@query("s4_configured_dataset", with_(WL) + "SELECT slot, language, word FROM wl WHERE language IN ('en','de')")
def _(spark, sf):
    base = wls.Dataset(words(spark, sf), views.language_tree(spark), LANGS)
    return wls.configured_dataset(base, "A", filter_leaves=True).words.select("slot", "language", "word")


COMP = """form AS (SELECT 'g' || slot AS gloss, slot AS file, language, word,
  CASE WHEN length(gold_id) % 5 = 0 THEN 1 ELSE length(gold_id) + 1 END AS g FROM wl)"""


def comparative_text(spark: SparkSession, sf: str) -> DataFrame:
    """Comparative-database lines, one file per slot."""
    form = words(spark, sf).select(
        F.col("slot").alias("file"), "language", "word",
        F.when(F.length("gold_id") % 5 == 0, 1).otherwise(F.length("gold_id") + 1).alias("g"),
    )
    head = form.select("file").distinct().select(
        "file", F.lit(0).alias("g"), F.lit(0).alias("k"), F.concat(F.lit("a 001 g"), "file").alias("value")
    )
    group = form.select("file", "g").distinct().select(
        "file", "g", F.lit(0).alias("k"), F.concat(F.lit("b            "), F.col("g").cast("string")).alias("value")
    )
    rel = form.filter("g > 1").select("file", "g").distinct().select(
        "file", "g", F.lit(1).alias("k"),
        F.concat(F.lit("c "), F.col("g").cast("string"), F.when(F.col("g") % 2 == 0, "  2  ").otherwise("  3  "), (F.col("g") + 1).cast("string")).alias("value"),
    )
    line = form.select(
        "file", "g", F.lit(2).alias("k"),
        F.concat(F.lit("  001 02 "), F.initcap("language"), F.lit(".       "), "word", F.lit(", x (y)")).alias("value"),
    )
    rows = head.unionByName(group).unionByName(rel).unionByName(line)
    return ranked(rows, ["file"], ["g", "k", "value"], F.col("g"), "line_no").select("file", "line_no", "value")


@query("s5_comparative_forms", with_(WL, COMP) + """SELECT gloss, group_id, language, max(word) AS word FROM (SELECT gloss, CASE WHEN g = 1 THEN '1-' || (row_number() OVER (PARTITION BY file, g
  ORDER BY '  001 02 ' || upper(language[1]) || language[2:] || '.       ' || word || ', x (y)') - 1) ELSE g::VARCHAR END AS group_id,
  upper(language[1]) || language[2:] AS language, word FROM form) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return comp.read_forms(comparative_text(spark, sf)).select("gloss", "group_id", "language", "word")


@query("s5_comparative_all_forms", with_(WL, COMP) + """SELECT gloss, CASE WHEN g = 1 THEN '1-' || (row_number() OVER (PARTITION BY file, g
  ORDER BY '  001 02 ' || upper(language[1]) || language[2:] || '.       ' || word || ', x (y)') - 1) ELSE g::VARCHAR END AS group_id,
  upper(language[1]) || language[2:] AS language, word FROM form""")
def _(spark, sf):
    return comp.read_forms(comparative_text(spark, sf), "all").select("gloss", "group_id", "language", "word")


@query("s5_comparative_relations", with_(WL, COMP) + """SELECT DISTINCT gloss, g::VARCHAR AS group_a, (g + 1)::VARCHAR AS group_b,
  CASE WHEN g % 2 = 0 THEN 'sure' ELSE 'doubtful' END AS certainty FROM form WHERE g > 1""")
def _(spark, sf):
    return comp.read_relations(comparative_text(spark, sf))


@query("w4_header_fill_down", with_(WL, COMP) + "SELECT gloss, g::VARCHAR AS group_no, count(*) AS lines FROM form GROUP BY 1, 2")
def _(spark, sf):
    filled = comp.with_headers(comparative_text(spark, sf))
    return filled.filter(F.col("value").startswith("  ")).groupBy("gloss", "group_no").agg(F.count("*").alias("lines"))


@query("t4_language_order", "SELECT DISTINCT upper(lang[1]) || lang[2:] AS language, '02' AS lang_no FROM documents")
def _(spark, sf):
    return comp.language_order(comp.read_forms(comparative_text(spark, sf)))


PIVOT = ", ".join(f"coalesce(max(CASE WHEN language = '{x}' THEN word END), '?')" for x in LANGS)


@query("s7_wide_sink", with_(WL) + f"SELECT gold_id, concat_ws(chr(9), {PIVOT}) AS value FROM wl GROUP BY gold_id")
def _(spark, sf):
    return wls.wide_lines(words(spark, sf), "gold_id", LANGS)


VOTE = "SELECT slot AS cluster_id, gold_id AS vote FROM (SELECT slot, gold_id, row_number() OVER (PARTITION BY slot ORDER BY count(*) DESC, gold_id DESC) AS r FROM wl GROUP BY 1, 2) WHERE r = 1"


@query("s7_wide_sink_with_gold", with_(WL, f"vote AS ({VOTE})") + "SELECT w.slot AS cluster_id, concat_ws(chr(9), " + PIVOT.replace("coalesce(max(CASE WHEN language = 'es' THEN word END), '?')", "max(v.vote)") + ") AS value FROM wl w JOIN vote v ON v.cluster_id = w.slot GROUP BY w.slot")
def _(spark, sf):
    return wls.wide_lines_with_gold(groups(spark, sf), "cluster_id", LANGS, "es", "gold_id")


@query("s8_gold_words", with_(WL) + """SELECT w.language, w.word, g.gold_word FROM wl w
  JOIN (SELECT gold_id, max(word) AS gold_word FROM wl WHERE language = 'en' GROUP BY 1) g USING (gold_id) WHERE w.language <> 'en'""")
def _(spark, sf):
    return wls.gold_word_pairs(words(spark, sf), "gold_id", "en")


@query("s9_clade_export", with_(WL) + f"SELECT gold_id, concat_ws(chr(9), {PIVOT}) AS value FROM wl WHERE language IN ('fr','es','B') GROUP BY gold_id")
def _(spark, sf):
    return wls.clade_lines(words(spark, sf), subtree_at(views.language_tree(spark), "B"), "gold_id", LANGS)


BG = f"""bg AS (SELECT language, word, substr(s, i, 1) AS prev, substr(s, i + 1, 1) AS next FROM (
  SELECT language, word, s, unnest(range(1, length(s))) AS i FROM (SELECT language, word, '{EMPTY}' || word || '{EMPTY}' AS s FROM wl)))"""
BG_COUNT = "bc AS (SELECT language AS node_id, prev, next, count(*) AS cnt FROM bg GROUP BY ALL)"


@query("s11_iteration_sink", with_(WL, BG, BG_COUNT) + "SELECT node_id, prev, next, cnt, 0::INT AS iter FROM bc")
def _(spark, sf):
    path = f"{scratch_dir(spark)}/bigrams-{uuid4().hex}"
    wls.write_iteration(lx.bigram_counts(words(spark, sf), "language").withColumn("iter", F.lit(0)), path)
    return spark.read.parquet(path)


# ---- projections and filters ---------------------------------------------------------


@query("p1_comment_filter", """SELECT lang AS language, count(*) AS lines FROM (SELECT lang, unnest(string_split(text, chr(10))) AS value FROM documents)
  WHERE value <> '' AND NOT starts_with(value, '#') GROUP BY 1""")
def _(spark, sf):
    lines = views.documents(spark, sf).select("lang", F.explode(F.split("text", "\n")).alias("value"))
    return wls.data_lines(lines).groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("lines"))


@query("p2_hole_filter", with_(WL) + "SELECT language, count(*) AS cells FROM wl GROUP BY 1")
def _(spark, sf):
    return wls.parse_wide(wide(spark, sf), LANGS, True).groupBy("language").agg(F.count("*").alias("cells"))


@query("p3_gloss_normalise", with_(WL, CELLS) + "SELECT 'g' || slot AS gloss, count(DISTINCT gold_id) AS lines FROM cells GROUP BY 1")
def _(spark, sf):
    first = F.element_at(F.split("value", " "), 1)
    return wide(spark, sf).groupBy(gloss_of(first).alias("gloss")).agg(F.count("*").alias("lines"))


@query("p4_drop_language", with_(WL) + "SELECT language, count(*) AS words FROM wl WHERE language <> 'en' GROUP BY 1")
def _(spark, sf):
    return wls.drop_language(words(spark, sf), "en").groupBy("language").agg(F.count("*").alias("words"))


@query("p6_empty_groups", with_(WL) + "SELECT gold_id, count(*) AS words FROM wl WHERE language <> 'en' GROUP BY 1")
def _(spark, sf):
    return wls.drop_language(words(spark, sf), "en").groupBy("gold_id").agg(F.count("*").alias("words")).filter("words > 0")


HASH = "(('0x' || substr(md5({0}), 1, 8))::BIGINT % 10000)"


@query("p9_mask_words", with_(WL) + "SELECT language, slot, word FROM wl WHERE " + HASH.format("'7|' || slot || '|' || language || '|' || word") + " >= 2000")
def _(spark, sf):
    return cl.mask_words(words(spark, sf), 0.2, 7).select("language", "slot", "word")


@query("p10_prune_branches", with_(WL, LT, LT_LEAF, LT_CLOSURE, recursive=True) + """SELECT w.language, w.slot, w.word FROM wl w JOIN leaf USING (language)
  WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.descendant = leaf.node_id AND cl.ancestor <> 0 AND """ + HASH.format("'7|' || w.slot || '|' || cl.ancestor") + " < 2000)")
def _(spark, sf):
    return cl.prune_branches(words(spark, sf), views.language_tree(spark), 0.2, 7).select("language", "slot", "word")


# ---- joins -----------------------------------------------------------------------------


@query("j1_positional_zip", with_(WL) + "SELECT language, (CASE language WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END)::BIGINT AS pos, count(*) AS cells FROM wl GROUP BY 1, 2")
def _(spark, sf):
    rows = wls.parse_wide(wide(spark, sf), LANGS, True)
    pos = F.element_at(F.split("obs_id", ":"), -1).cast("bigint")
    return rows.groupBy("language", pos.alias("pos")).agg(F.count("*").alias("cells"))


@query("j2_leaf_semi_join", with_(WL) + "SELECT slot, language, word FROM wl WHERE language IN ('fr','es')")
def _(spark, sf):
    return leaf_words(words(spark, sf), subtree_at(views.language_tree(spark), "B")).select("slot", "language", "word")


@query("j3_candidate_pairs", with_(WL, "legal AS (SELECT DISTINCT slot, word FROM wl)") + """SELECT a.slot, a.word, count(*) AS candidates,
  max(CASE WHEN a.word <> b.word THEN -levenshtein(a.word, b.word)::DOUBLE END) AS score,
  arg_min(b.word, levenshtein(a.word, b.word)::VARCHAR.lpad(6, '0') || b.word) FILTER (a.word <> b.word) AS partner
  FROM legal a JOIN legal b USING (slot) GROUP BY 1, 2""")
def _(spark, sf):
    return candidate_summary(words(spark, sf), levenshtein_scorer(-1.0))


@query("j4_slot_language_groups", with_(WL) + "SELECT slot, language, count(*) AS words FROM wl GROUP BY 1, 2")
def _(spark, sf):
    return words(spark, sf).groupBy("slot", "language").agg(F.count("*").alias("words"))


@query("j8_group_compatibility", with_(WL, """sets AS (SELECT slot, gold_id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM wl GROUP BY 1, 2)""",
  "sc AS (SELECT slot, languages, count(*) AS groups FROM sets GROUP BY 1, 2)") + """SELECT a.slot, a.languages, max(a.groups) AS groups,
  sum(CASE WHEN NOT list_has_any(string_split(a.languages, ','), string_split(b.languages, ',')) THEN b.groups ELSE 0 END)::BIGINT AS partners
  FROM sc a JOIN sc b USING (slot) GROUP BY 1, 2""")
def _(spark, sf):
    return cl.compatible_groups(words(spark, sf).withColumn("cluster_id", F.col("gold_id")))


@query("j11_cluster_pairs", with_(WL) + """SELECT c.slot AS cluster_id, coalesce(p.guesses, 0) AS guesses, coalesce(p.correct, 0) AS correct
  FROM (SELECT DISTINCT slot FROM wl) c LEFT JOIN (SELECT a.slot, count(*) AS guesses, sum((a.gold_id = b.gold_id)::INT)::BIGINT AS correct
  FROM wl a JOIN wl b ON a.slot = b.slot AND a.obs_id < b.obs_id GROUP BY 1) p ON p.slot = c.slot""")
def _(spark, sf):
    return ev.cluster_pairs(groups(spark, sf))


# The best open pair of every slot is taken, one a step.
GREEDY = """pick(slot, g, gold, ug, uw) AS (
    SELECT slot, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[] FROM (SELECT DISTINCT slot FROM ed)
    UNION ALL SELECT slot, g, gold, list_append(ug, g), list_append(uw, gold) FROM (
      SELECT p.slot, arg_max(e.g, (d, e.g, e.gold)) AS g, arg_max(e.gold, (d, e.g, e.gold)) AS gold, any_value(ug) AS ug, any_value(uw) AS uw
      FROM pick p JOIN ed e ON e.slot = p.slot AND NOT list_contains(ug, e.g) AND NOT list_contains(uw, e.gold) GROUP BY p.slot))"""


@query("j12_gold_assignment", with_(WL,
  "gw AS MATERIALIZED (SELECT slot, gold_id, min(word) AS gold_word FROM wl GROUP BY 1, 2)",
  "ob AS MATERIALIZED (SELECT slot, slot || '|' || length(word) AS g, word, gold_word FROM wl JOIN gw USING (slot, gold_id))",
  "vo AS MATERIALIZED (SELECT slot, g, arg_max(gold_word, (n, gold_word)) AS gold FROM (SELECT slot, g, gold_word, count(*) AS n FROM ob GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1, 2)",
  "gs AS (SELECT slot, g, list_distinct(flatten(list(" + "CASE WHEN length(word) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(word)), lambda i: substr(word, i::INT, 2))) END" + "))) AS x FROM ob GROUP BY 1, 2)",
  "ws AS (SELECT DISTINCT slot, gold_word, " + "CASE WHEN length(gold_word) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length(gold_word)), lambda i: substr(gold_word, i::INT, 2))) END" + " AS y FROM gw)",
  """ed AS MATERIALIZED (SELECT gs.slot, gs.g, ws.gold_word AS gold, 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) AS d FROM gs JOIN ws USING (slot)
    WHERE len(list_intersect(x, y)) > 0 AND (gs.slot, gs.g) NOT IN (SELECT slot, g FROM vo) AND (gs.slot, ws.gold_word) NOT IN (SELECT slot, gold FROM vo))""",
  GREEDY, recursive=True) + """SELECT slot, g AS cluster_id, gold AS gold_word, 'vote' AS how FROM vo
  UNION ALL SELECT slot, g, gold, 'overlap' FROM pick WHERE g IS NOT NULL""")
def _(spark, sf):
    w = words(spark, sf)
    gold = w.groupBy("slot", "gold_id").agg(F.min("word").alias("gold_word"))
    rows = w.join(gold, ["slot", "gold_id"]).withColumn(
        "cluster_id", F.concat_ws("|", "slot", F.length("word").cast("string"))
    )
    return cl.assign_gold(rows.select("slot", "cluster_id", "word", "gold_word"), gold)


# ---- character models -------------------------------------------------------------------


@query("a1_alphabet", with_(WL) + f"""SELECT ch, (row_number() OVER (ORDER BY ch) - 1)::BIGINT AS idx FROM (
  SELECT DISTINCT unnest(string_split(word, '')) AS ch FROM wl UNION SELECT '{EMPTY}')""")
def _(spark, sf):
    return lx.alphabet(words(spark, sf)).select("ch", F.col("idx").cast("bigint").alias("idx"))


@query("a2_legal_words", with_(WL) + "SELECT DISTINCT slot, word FROM wl")
def _(spark, sf):
    return lx.legal_words(words(spark, sf))


@query("a3_bigram_counts", with_(WL, BG, BG_COUNT) + "SELECT * FROM bc")
def _(spark, sf):
    return lx.bigram_counts(words(spark, sf), "language")


N_CHARS = f"nc AS (SELECT count(*) + 1 AS n FROM (SELECT DISTINCT unnest(string_split(word, '')) FROM wl))"
FIT = """ac AS (SELECT prev, next, 0.5::DOUBLE * sum(cnt)::DOUBLE AS a FROM bc GROUP BY ALL),
fn AS (SELECT n.node_id, ac.prev, ac.next, coalesce(bc.cnt, 0)::DOUBLE + ac.a AS c FROM ac CROSS JOIN (SELECT DISTINCT node_id FROM bc) n
  LEFT JOIN bc USING (node_id, prev, next)),
ft AS (SELECT node_id, prev, ln(sum(c) + 0.01::DOUBLE * (SELECT n FROM nc)) AS t FROM fn GROUP BY ALL),
fit AS (SELECT node_id, prev, next, ln(c + 0.01::DOUBLE) - t AS lp FROM fn JOIN ft USING (node_id, prev))"""


def n_chars(spark, sf) -> int:
    return shared(spark, sf, "n_chars", lambda: lx.alphabet(words(spark, sf)).count())


def fitted(spark, sf) -> lx.BigramModel:
    counts = lx.bigram_counts(words(spark, sf), "language").withColumn("cnt", F.col("cnt").cast("double"))
    return lx.fit_bigrams(counts, LANGS, n_chars(spark, sf))


@query("a4_smoothed_bigrams", with_(WL, BG, BG_COUNT, N_CHARS, FIT) + "SELECT node_id, prev, next, round(lp, 6) AS lp FROM fit")
def _(spark, sf):
    return fitted(spark, sf).rows.withColumn("lp", F.round("lp", 6))


@query("a5_uniform_bigrams", with_(WL, N_CHARS) + "SELECT word, round(-(length(word) + 1) * ln((SELECT n FROM nc)::DOUBLE), 6) AS lm FROM (SELECT DISTINCT word FROM wl)")
def _(spark, sf):
    items = words(spark, sf).select(F.lit(0).alias("node_id"), "word").distinct()
    return lx.word_scores(items, lx.BigramModel.flat(n_chars(spark, sf))).select("word", F.round("lm", 6).alias("lm"))


@query("a6_word_scores", with_(WL, BG, BG_COUNT, N_CHARS, FIT) + """SELECT bg.language AS node_id, bg.word, round(sum(fit.lp), 6) AS lm FROM bg
  JOIN fit ON fit.node_id = bg.language AND fit.prev = bg.prev AND fit.next = bg.next GROUP BY 1, 2""")
def _(spark, sf):
    items = words(spark, sf).select(F.col("language").alias("node_id"), "word")
    return lx.word_scores(items, fitted(spark, sf)).withColumn("lm", F.round("lm", 6))


@query("a7_weighted_bigrams", with_(WL, BG) + "SELECT language AS node_id, prev, next, round(sum(1.0::DOUBLE / length(word)), 6) AS cnt FROM bg GROUP BY ALL")
def _(spark, sf):
    return lx.bigram_counts(words(spark, sf), "language", F.lit(1.0) / F.length("word")).withColumn("cnt", F.round("cnt", 6))


@query("a13_positional_unigrams", with_(WL, f"ch AS (SELECT language, unnest(range(0, length(word) + 1)) AS pos, word || '{EMPTY}' AS s FROM wl)",
  "cc AS (SELECT language AS node_id, pos, substr(s, pos + 1, 1) AS ch, count(*) AS c FROM ch GROUP BY ALL)") +
  "SELECT node_id, pos::BIGINT AS pos, ch, c / sum(c) OVER (PARTITION BY node_id, pos) AS p FROM cc")
def _(spark, sf):
    return lx.positional_unigrams(words(spark, sf), "language").withColumn("pos", F.col("pos").cast("bigint"))


@query("a14_unigrams", with_(WL, "cc AS (SELECT language AS node_id, ch, count(*) AS c FROM (SELECT language, unnest(string_split(word, '')) AS ch FROM wl) GROUP BY ALL)",
  "ml AS (SELECT language AS node_id, sum(length(word)) / count(*)::DOUBLE AS mean_length FROM wl GROUP BY 1)") +
  "SELECT node_id, ch, c / sum(c) OVER (PARTITION BY node_id) AS p, round(mean_length, 9) AS mean_length FROM cc JOIN ml USING (node_id)")
def _(spark, sf):
    return lx.unigrams(words(spark, sf), "language").withColumn("mean_length", F.round("mean_length", 9))


@query("a15_conditional_bigrams", with_(WL, BG, BG_COUNT) + "SELECT node_id, prev, next, cnt / sum(cnt) OVER (PARTITION BY node_id, prev) AS p FROM bc")
def _(spark, sf):
    return lx.conditional_bigrams(lx.bigram_counts(words(spark, sf), "language"))


# ---- groups ------------------------------------------------------------------------------

BIG = "CASE WHEN length({0}) < 2 THEN [] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i::INT, 2))) END"


@query("a11_dice", with_(WL,
  f"wb AS (SELECT slot, word, {BIG.format('word')} AS x FROM (SELECT DISTINCT slot, word FROM wl WHERE language = 'en'))",
  f"gb AS (SELECT slot, gold_id, list_distinct(flatten(list({BIG.format('word')}))) AS y FROM wl WHERE language <> 'en' GROUP BY 1, 2)") +
  """SELECT slot, word, max(CASE WHEN len(x) + len(y) > 0 THEN 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END) AS dice, count(*) AS groups
  FROM wb JOIN gb USING (slot) WHERE len(y) > 0 GROUP BY 1, 2""")
def _(spark, sf):
    return cl.word_group_dice(words(spark, sf).withColumn("cluster_id", F.col("gold_id")), "en")


@query("e6_dice_round", with_(WL,
  f"wb AS (SELECT DISTINCT slot, word, {BIG.format('word')} AS x FROM wl WHERE language = 'en')",
  f"gb AS (SELECT slot, gold_id AS g, list_distinct(flatten(list({BIG.format('word')}))) AS y FROM wl WHERE language <> 'en' GROUP BY 1, 2)",
  "dc AS (SELECT slot, word, g, CASE WHEN len(x) + len(y) > 0 THEN 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END AS d FROM wb JOIN gb USING (slot) WHERE len(y) > 0)",
  "rk AS (SELECT *, row_number() OVER (PARTITION BY slot, word ORDER BY d DESC, g DESC) AS rw, row_number() OVER (PARTITION BY slot, g ORDER BY d DESC, word DESC) AS rg FROM dc WHERE d >= 0.2)") +
  """SELECT w.obs_id, coalesce(rk.g, w.slot || '|en|' || w.word) AS cluster_id FROM wl w
  LEFT JOIN rk ON rk.slot = w.slot AND rk.word = w.word AND rk.rw = 1 AND rk.rg = 1 WHERE w.language = 'en'
  UNION ALL SELECT obs_id, gold_id FROM wl WHERE language <> 'en'""")
def _(spark, sf):
    start = words(spark, sf).withColumn("cluster_id", F.col("gold_id"))
    return cl.match_round(start, "en").select("obs_id", "cluster_id")


def _baseline_sql() -> str:
    """The rounds of all languages one after another, from singletons."""
    steps = ["r0 AS MATERIALIZED (SELECT obs_id, slot, language, word, slot || '|' || language || '|' || word AS g FROM wl)"]
    for k, language in enumerate(LANGS):
        steps.append(f"""wb{k} AS (SELECT DISTINCT slot, word, {BIG.format('word')} AS x FROM r{k} WHERE language = '{language}')""")
        steps.append(f"""gb{k} AS (SELECT slot, g, list_distinct(flatten(list({BIG.format('word')}))) AS y FROM r{k} WHERE language <> '{language}' GROUP BY 1, 2)""")
        steps.append(f"""dc{k} AS (SELECT slot, word, g, 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) AS d FROM wb{k} JOIN gb{k} USING (slot) WHERE len(y) > 0)""")
        steps.append(f"""rk{k} AS (SELECT *, row_number() OVER (PARTITION BY slot, word ORDER BY d DESC, g DESC) AS rw, row_number() OVER (PARTITION BY slot, g ORDER BY d DESC, word DESC) AS rg
          FROM dc{k} WHERE d >= 0.2)""")
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT w.obs_id, w.slot, w.language, w.word, CASE WHEN w.language <> '{language}' THEN w.g
          ELSE coalesce(rk{k}.g, w.slot || '|{language}|' || w.word) END AS g FROM r{k} w
          LEFT JOIN rk{k} ON w.language = '{language}' AND rk{k}.slot = w.slot AND rk{k}.word = w.word AND rk{k}.rw = 1 AND rk{k}.rg = 1)""")
    return with_(WL, *steps) + f"SELECT obs_id, g AS cluster_id FROM r{len(LANGS)}"


@query("e6_dice_baseline", _baseline_sql())
def _(spark, sf):
    return cl.dice_baseline(words(spark, sf), LANGS).select("obs_id", "cluster_id")


@query("a12_majority_vote", with_(WL) + VOTE)
def _(spark, sf):
    return wls.vote_words(groups(spark, sf), "cluster_id", "gold_id")


@query("a30_merge_groups", with_(WL) + "SELECT DISTINCT CASE WHEN length(slot) % 2 = 0 THEN substr(slot, 1, 1) ELSE slot END AS cluster_id, language, word FROM wl")
def _(spark, sf):
    rows = groups(spark, sf).select("cluster_id", "language", "word")
    moves = rows.select("cluster_id").distinct().filter(F.length("cluster_id") % 2 == 0).withColumn("into", F.substring("cluster_id", 1, 1))
    return cl.merge_groups(rows, moves)


@query("a30_group_glosses", with_(WL) + "SELECT length(word)::BIGINT AS cluster_id, count(DISTINCT slot) AS glosses FROM wl GROUP BY 1")
def _(spark, sf):
    rows = words(spark, sf).withColumn("cluster_id", F.length("word").cast("bigint"))
    return cl.group_glosses(rows).groupBy("cluster_id").agg(F.count("*").alias("glosses"))


@query("u1_group_union", with_(WL) + "SELECT language, word FROM wl WHERE language IN ('en','de') UNION SELECT language, word FROM wl WHERE length(word) > 6")
def _(spark, sf):
    w = words(spark, sf).select("language", "word")
    return cl.add_words(w.filter(F.col("language").isin("en", "de")), w.filter(F.length("word") > 6))


@query("u2_flatten_groups", with_(WL, CELLS) + "SELECT language, count(*) AS words, count(DISTINCT word) AS forms FROM cells GROUP BY 1")
def _(spark, sf):
    rows = wls.parse_wide(wide(spark, sf), LANGS, True)
    return rows.groupBy("language").agg(F.count("*").alias("words"), F.countDistinct("word").alias("forms"))


@query("u4_clade_vocabulary", with_(WL) + "SELECT language, count(*) AS words FROM wl WHERE language IN ('en','de','A') GROUP BY 1")
def _(spark, sf):
    names = clade_vocabulary(subtree_at(views.language_tree(spark), "A"))
    return words(spark, sf).join(F.broadcast(names), "language", "left_semi").groupBy("language").agg(F.count("*").alias("words"))


# ---- evaluation --------------------------------------------------------------------------


@query("a19_precision_recall", with_(WL, """t AS (SELECT (SELECT sum(n*(n-1)//2)::BIGINT FROM (SELECT count(*) AS n FROM wl GROUP BY slot, gold_id)) AS correct,
  (SELECT sum(n*(n-1)//2)::BIGINT FROM (SELECT count(*) AS n FROM wl GROUP BY slot)) AS guesses,
  (SELECT sum(n*(n-1)//2)::BIGINT FROM (SELECT count(*) AS n FROM wl GROUP BY gold_id)) AS gold)""") +
  """SELECT correct, guesses, gold, correct / guesses AS precision, correct / gold AS recall,
  round(2 * (correct / guesses) * (correct / gold) / (correct / guesses + correct / gold), 9) AS f1 FROM t""")
def _(spark, sf):
    return ev.precision_recall(groups(spark, sf)).withColumn("f1", F.round("f1", 9))


@query("a20_purity", with_(WL) + """SELECT sum(top) / sum(n) AS purity, sum(n)::BIGINT AS words FROM (SELECT slot, max(n) AS top, sum(n) AS n FROM (
  SELECT slot, gold_id, count(*) AS n FROM wl GROUP BY 1, 2) GROUP BY 1)""")
def _(spark, sf):
    return ev.purity(groups(spark, sf))


@query("a21_pair_accuracy", with_(WL, """pr AS (SELECT least(a.language, b.language) AS l1, greatest(a.language, b.language) AS l2, length(a.word) % 4 = length(b.word) % 4 AS k
  FROM wl a JOIN wl b ON a.gold_id = b.gold_id AND a.language < b.language)""") +
  "SELECT l1, l2, count(*) AS gold, sum(k::INT)::BIGINT AS kept, sum(k::INT) / count(*) AS accuracy FROM pr GROUP BY 1, 2")
def _(spark, sf):
    return ev.pair_accuracy(words(spark, sf).withColumn("cluster_id", F.length("word") % 4))


@query("a22_exact_groups", with_(WL, """c AS (SELECT slot || '|' || (length(word) % 4) AS cl, * FROM wl)""",
  "m AS (SELECT gold_id, count(DISTINCT cl) AS k, count(*) AS n, min(cl) AS cl FROM c GROUP BY 1)",
  "e AS (SELECT m.gold_id, m.k = 1 AND m.n = s.n AS ok FROM m JOIN (SELECT cl, count(*) AS n FROM c GROUP BY 1) s USING (cl))") +
  "SELECT sum(ok::INT)::BIGINT AS exact, count(*) AS groups, sum(ok::INT) / count(*) AS share FROM e")
def _(spark, sf):
    rows = words(spark, sf).withColumn("cluster_id", F.concat_ws("|", "slot", (F.length("word") % 4).cast("string")))
    return ev.exact_groups(rows)


@query("a23_mean_edit_distance", with_(WL) + """SELECT round(avg(levenshtein(w.word, g.gold_word)::DOUBLE), 9) AS mean_distance, count(*) AS pairs FROM wl w
  JOIN (SELECT gold_id, max(word) AS gold_word FROM wl WHERE language = 'en' GROUP BY 1) g USING (gold_id) WHERE w.language <> 'en'""")
def _(spark, sf):
    pairs = wls.gold_word_pairs(words(spark, sf), "gold_id", "en")
    return ev.mean_edit_distance(pairs, "word", "gold_word").withColumn("mean_distance", F.round("mean_distance", 9))


@query("a24_death_rates", with_(WL, LT, LT_LEAF, LT_CLOSURE, """live AS (SELECT ancestor AS node_id, count(DISTINCT slot) AS live FROM wl JOIN leaf USING (language) JOIN cl ON cl.descendant = leaf.node_id GROUP BY 1)""", recursive=True) +
  """SELECT lt.node_id::BIGINT AS node_id, lt.label, p.live AS live_parents, p.live - coalesce(c.live, 0) AS deaths, (p.live - coalesce(c.live, 0) + 0.5::DOUBLE) / p.live AS rate
  FROM lt JOIN live p ON p.node_id = lt.parent_id LEFT JOIN live c ON c.node_id = lt.node_id""")
def _(spark, sf):
    return cl.death_rates(words(spark, sf), views.language_tree(spark)).withColumn("node_id", F.col("node_id").cast("bigint"))


# ---- scalar functions ----------------------------------------------------------------------


@query("f1_first_variant", "SELECT doc_id, regexp_extract(text, '^[^,/ (\\n]*', 0) AS form FROM documents")
def _(spark, sf):
    return views.documents(spark, sf).select("doc_id", first_variant(F.col("text")).alias("form"))


@query("f2_clean_language", "SELECT source, replace(trim(' ' || source || '.x '), '.', '') AS name, count(*) AS docs FROM documents GROUP BY 1, 2")
def _(spark, sf):
    raw = F.concat(F.lit(" "), "source", F.lit(".x "))
    return views.table(spark, sf, "documents").groupBy("source", clean_language(raw).alias("name")).agg(F.count("*").alias("docs"))


@query("f3_log_sum", """SELECT l_returnflag, round(sum(ln(exp(l_discount) + exp(l_tax) + exp(l_quantity / 10))), 4) AS s FROM lineitem GROUP BY 1""")
def _(spark, sf):
    v = log_sum(F.array("l_discount", "l_tax", F.col("l_quantity") / 10))
    return views.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(v), 4).alias("s"))


@query("f4_sigmoid", "SELECT l_linestatus, round(sum(1 / (1 + exp(-(l_quantity / 10 - 2)))), 4) AS s FROM lineitem GROUP BY 1")
def _(spark, sf):
    return views.table(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(sigmoid(F.col("l_quantity") / 10 - 2)), 4).alias("s"))


@query("f5_innovation_mixture", "SELECT l_returnflag, round(sum(ln(exp(-l_quantity / 10) * 0.6::DOUBLE + exp(-l_discount * 50) * 0.4::DOUBLE)), 4) AS s FROM lineitem GROUP BY 1")
def _(spark, sf):
    kept = -F.col("l_quantity") / 10 + F.log(F.lit(0.6))
    new = -F.col("l_discount") * 50 + F.log(F.lit(0.4))
    return views.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(mixture(kept, new)), 4).alias("s"))


@query("f6_responsibility", """SELECT l_returnflag, round(sum(exp(-l_discount * 50) * 0.4::DOUBLE / (exp(-l_quantity / 10) * 0.6::DOUBLE + exp(-l_discount * 50) * 0.4::DOUBLE)), 4) AS s FROM lineitem GROUP BY 1""")
def _(spark, sf):
    kept = -F.col("l_quantity") / 10 + F.log(F.lit(0.6))
    new = -F.col("l_discount") * 50 + F.log(F.lit(0.4))
    return views.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(responsibility(kept, new)), 4).alias("s"))


@query("f7_word_bigrams", with_(WL) + """SELECT language, b AS bigram, count(*) AS cnt FROM (SELECT language, unnest(CASE WHEN length(word) < 2 THEN [] ELSE
  list_transform(range(1, length(word)), lambda i: substr(word, i::INT, 2)) END) AS b FROM wl) GROUP BY 1, 2""")
def _(spark, sf):
    return words(spark, sf).select("language", F.explode(bigrams(F.col("word"))).alias("bigram")).groupBy("language", "bigram").agg(F.count("*").alias("cnt"))


# ---- parameters ------------------------------------------------------------------------------


@query("e1_uniform_costs", with_(WL, N_CHARS, "z AS (SELECT n::DOUBLE AS n, -ln((n - 1) * exp(-4.0::DOUBLE) + 1 + (n + 1) * exp(-4.0::DOUBLE)) AS c FROM nc)") +
  "SELECT round(c, 9) AS match, round(c - 4, 9) AS substitute, round(c - 4, 9) AS gap, round(ln(1 - exp(ln(n) + c - 4)), 9) AS stop FROM z")
def _(spark, sf):
    u = uniform_costs(n_chars(spark, sf))
    return spark.createDataFrame(
        [(u.match, u.substitute, u.gap, u.stop)], "match double, substitute double, gap double, stop double"
    ).select(*(F.round(c, 9).alias(c) for c in ("match", "substitute", "gap", "stop")))


@query("m8_initial_parameters", with_(WL, LT, N_CHARS, "z AS (SELECT n::DOUBLE AS n, -ln((n - 1) * exp(-4.0::DOUBLE) + 1 + (n + 1) * exp(-4.0::DOUBLE)) AS c FROM nc)") +
  """SELECT node_id::BIGINT AS node_id, round(c, 9) AS match, round(c - 4, 9) AS substitute, round(c - 4, 9) AS gap, round(ln(1 - exp(ln(n) + c - 4)), 9) AS stop,
  round(-ln(n), 9) AS bigram, 0.4::DOUBLE AS innovation FROM lt CROSS JOIN z""")
def _(spark, sf):
    n = n_chars(spark, sf)
    u, flat = uniform_costs(n), lx.BigramModel.flat(n).uniform
    cols = {"match": u.match, "substitute": u.substitute, "gap": u.gap, "stop": u.stop, "bigram": flat}
    return views.language_tree(spark).select(
        F.col("node_id").cast("bigint").alias("node_id"),
        *[F.round(F.lit(v), 9).alias(k) for k, v in cols.items()],
        F.lit(0.4).alias("innovation"),
    )


@query("m1_bigram_estimate", with_(WL, BG, "bc AS (SELECT language AS node_id, prev, next, sum(1.0::DOUBLE / length(word)) AS cnt FROM bg GROUP BY ALL)", N_CHARS, FIT) +
  "SELECT node_id, prev, next, round(lp, 6) AS lp FROM fit")
def _(spark, sf):
    counts = lx.bigram_counts(words(spark, sf), "language", F.lit(1.0) / F.length("word"))
    return lx.fit_bigrams(counts, LANGS, n_chars(spark, sf)).rows.withColumn("lp", F.round("lp", 6))


@query("a8_alignment_merge", with_(WL, BG) + f"SELECT language AS node_id, prev AS x, next AS y, sum(0.5::DOUBLE) AS cnt FROM bg WHERE NOT (prev = '{EMPTY}' AND next = '{EMPTY}') GROUP BY ALL")
def _(spark, sf):
    return alignment_stand_in(spark, sf)


def alignment_stand_in(spark, sf) -> DataFrame:
    """Count rows shaped like alignment counts: neighbouring characters, weight one half."""
    rows = lx.bigram_counts(words(spark, sf), "language", F.lit(0.5)).filter((F.col("prev") != EMPTY) | (F.col("next") != EMPTY))
    return rows.select("node_id", F.col("prev").alias("x"), F.col("next").alias("y"), "cnt")


@query("m2_alignment_estimate", with_(WL, BG, N_CHARS, f"ac AS (SELECT language AS node_id, prev AS x, next AS y, sum(0.5::DOUBLE) AS e FROM bg WHERE NOT (prev = '{EMPTY}' AND next = '{EMPTY}') GROUP BY ALL)",
  f"tt AS (SELECT node_id, sum(e) + 0.01::DOUBLE * ((SELECT n * n - 1 FROM nc)) AS den, sum(CASE WHEN x = '{EMPTY}' THEN e ELSE 0 END) + 0.01::DOUBLE * (SELECT n - 1 FROM nc) AS ins FROM ac GROUP BY 1)",
  "xx AS (SELECT node_id, x, sum(e) + 0.01::DOUBLE * (SELECT n FROM nc) AS xs FROM ac GROUP BY 1, 2)") +
  f"""SELECT node_id, x, y, round(ln(CASE WHEN x = '{EMPTY}' THEN (e + 0.01::DOUBLE) / den ELSE (1 - ins / den) * (e + 0.01::DOUBLE) / xs END), 6) AS lp
  FROM ac JOIN tt USING (node_id) JOIN xx USING (node_id, x)""")
def _(spark, sf):
    rows, _ = alignment_table(alignment_stand_in(spark, sf), n_chars(spark, sf))
    return rows.withColumn("lp", F.round("lp", 6))
