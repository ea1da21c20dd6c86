"""Queries over trees and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordkin.functions.ordered import ranked
from wordkin.operators import lineage as ln, trees as tr
from wordkin.plans import views
from wordkin.plans.catalog import (
    LT, LT_CLOSURE, LT_LEAF, OT, OT_CLADES, PT, PT_CLOSURE, PT_LEAF, WL, query, shared, with_,
)
from wordkin.plans.catalog_words import words
from wordkin.session import cut, small
from wordkin.sources.treetext import read_trees, register_tree_nodes, text_clade_support, tree_texts


def places(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "places", lambda: cut(views.place_tree(spark, sf)))


def order_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The tree strings, built once: both readers below go over them, the second one twice."""
    return views.spread_input(shared(spark, sf, "order_texts", lambda: cut(views.order_tree_texts(spark, sf))))


def order_trees(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "order_trees", lambda: cut(read_trees(order_texts(spark, sf), "newick")))


def order_clades(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "order_clades", lambda: cut(tr.clades(order_trees(spark, sf))))


def support(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "support", lambda: cut(text_clade_support(order_texts(spark, sf), "newick")))


NODE_SQL = with_(OT) + """SELECT tree_id, label, parent_label, depth, length, count(*) AS nodes FROM (
  SELECT DISTINCT tree_id, 'root' AS label, NULL AS parent_label, 0 AS depth, 0.0::DOUBLE AS length, '' AS k FROM ot
  UNION ALL SELECT DISTINCT tree_id, f, 'root', 1, 0.0::DOUBLE, '' FROM ot
  UNION ALL SELECT DISTINCT tree_id, s, f, 2, 0.0::DOUBLE, f FROM ot
  UNION ALL SELECT tree_id, leaf, s, 3, {leaf}, '' FROM ot) GROUP BY ALL"""


def node_summary(nodes: DataFrame) -> DataFrame:
    top = nodes.select("tree_id", F.col("node_id").alias("parent_id"), F.col("label").alias("parent_label"))
    return nodes.join(top, ["tree_id", "parent_id"], "left").groupBy(
        "tree_id", "label", "parent_label", "depth", F.col("branch_length").alias("length")
    ).agg(F.count("*").alias("nodes"))


@query("s6_read_newick", NODE_SQL.format(leaf="0.5::DOUBLE"))
def _(spark, sf):
    return node_summary(order_trees(spark, sf))


@query("s6_read_nested", NODE_SQL.format(leaf="0.0::DOUBLE"))
def _(spark, sf):
    return node_summary(read_trees(views.order_tree_texts(spark, sf, "lisp"), "lisp"))


@query("x3_tree_nodes_udtf", with_(OT) + """SELECT tree_id, (SELECT 1)::BIGINT + count(DISTINCT f) + count(DISTINCT f || s) + count(DISTINCT leaf) AS nodes, 3::BIGINT AS depth
  FROM ot GROUP BY tree_id""")
def _(spark, sf):
    register_tree_nodes(spark)
    views.order_tree_texts(spark, sf).createOrReplaceTempView("wordkin_order_trees")
    return spark.sql(
        "SELECT t.tree_id, count(*) AS nodes, CAST(max(n.depth) AS BIGINT) AS depth "
        "FROM wordkin_order_trees t, LATERAL tree_nodes(t.text, 'newick') n GROUP BY t.tree_id"
    )


@query("s10_write_newick", with_(OT, """a AS (SELECT tree_id, f, s, '(' || string_agg(leaf || ':0.5', ',' ORDER BY leaf) || ')' || s AS t FROM ot GROUP BY tree_id, f, s)""",
  "b AS (SELECT tree_id, f, '(' || string_agg(t, ',' ORDER BY t) || ')' || f AS t FROM a GROUP BY tree_id, f)") +
  "SELECT tree_id, replace('(' || string_agg(t, ',' ORDER BY t) || ')root', ',', ', ') AS text FROM b GROUP BY tree_id")
def _(spark, sf):
    return tree_texts(order_trees(spark, sf), 3)


@query("p5_relabel_nodes", with_(PT) + "SELECT lower(label) || '/' || depth AS label, count(*) AS nodes FROM pt GROUP BY 1")
def _(spark, sf):
    label = F.concat(F.lower("label"), F.lit("/"), F.col("depth").cast("string"))
    return tr.relabel(places(spark, sf), label).groupBy("label").agg(F.count("*").alias("nodes"))


@query("j9_ancestor_closure", with_(PT, PT_CLOSURE, recursive=True) + "SELECT ancestor, descendant, distance::BIGINT AS distance, length FROM pc")
def _(spark, sf):
    return tr.closure(places(spark, sf), 3).select("ancestor", "descendant", F.col("distance").cast("bigint").alias("distance"), "length")


@query("j9_edges", with_(PT) + "SELECT p.label AS parent_label, c.label AS child_label, count(*) AS edges FROM pt c JOIN pt p ON p.node_id = c.parent_id GROUP BY 1, 2")
def _(spark, sf):
    return tr.edges(places(spark, sf)).groupBy("parent_label", "child_label").agg(F.count("*").alias("edges"))


CONFLICT_SQL = with_(OT_CLADES, "sup AS (SELECT clade, count(DISTINCT tree_id) AS support FROM oc GROUP BY 1)",
  "l AS (SELECT clade, string_split(clade, ',') AS x FROM sup)") + """SELECT a.clade, coalesce(sum((n > 0 AND n < len(a.x) AND n < m)::INT), 0)::BIGINT AS conflicts
  FROM (SELECT a.clade, a.x, len(list_intersect(a.x, b.x)) AS n, len(b.x) AS m FROM l a JOIN l b ON true) a GROUP BY 1"""


@query("j10_clade_compatibility", CONFLICT_SQL)
def _(spark, sf):
    # every distinct clade of the sample against all others
    every = support(spark, sf)
    return tr.conflicts_with(every, every).select(F.array_join("clade", ",").alias("clade"), "conflicts")


@query("a16_clades", with_(OT_CLADES) + "SELECT tree_id, clade, count(*) AS nodes FROM oc GROUP BY 1, 2")
def _(spark, sf):
    return order_clades(spark, sf).groupBy("tree_id", F.array_join("clade", ",").alias("clade")).agg(F.count("*").alias("nodes"))


@query("a16_clade_members", with_(PT, PT_LEAF, PT_CLOSURE, recursive=True) + "SELECT pc.ancestor AS node_id, pc.descendant AS leaf_id, l.label AS leaf FROM pc JOIN ptleaf l ON l.node_id = pc.descendant")
def _(spark, sf):
    return tr.clade_members(places(spark, sf), 3).select("node_id", "leaf_id", "leaf")


@query("a17_clade_support", with_(OT_CLADES) + "SELECT clade, count(DISTINCT tree_id) AS support FROM oc GROUP BY 1")
def _(spark, sf):
    return support(spark, sf).select(F.array_join("clade", ",").alias("clade"), "support")


@query("t1_support_ranking", with_(OT_CLADES) + """SELECT clade, support, row_number() OVER (ORDER BY support DESC, length(clade) DESC, clade) AS rank
  FROM (SELECT clade, count(DISTINCT tree_id) AS support FROM oc GROUP BY 1)""")
def _(spark, sf):
    # clades of one support are numbered among themselves, then moved behind those of larger support
    rows = support(spark, sf).withColumns({"name": F.array_join("clade", ","), "size": F.length(F.array_join("clade", ","))})
    numbered = ranked(rows, [], [F.desc("support"), F.desc("size"), F.asc("name")], -F.col("support"), "rank")
    return numbered.select(F.col("name").alias("clade"), "support", (F.col("rank") + 1).cast("bigint").alias("rank"))


# One clade a step, in order of rank, is kept if it fits all that were kept before.
CONSENSUS = """sup AS (SELECT string_split(clade, ',') AS x, count(DISTINCT tree_id) AS support FROM oc GROUP BY 1),
  everyone AS (SELECT list_sort(list(DISTINCT leaf)) AS x, (SELECT count(DISTINCT tree_id) + 1 FROM ot) AS support FROM ot),
  rk AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY support DESC, len(x) DESC, array_to_string(x, chr(1))) AS k FROM (
    SELECT * FROM sup WHERE x NOT IN (SELECT x FROM everyone) UNION ALL SELECT * FROM everyone)),
  fit(k, kept) AS (SELECT 0::BIGINT, []::VARCHAR[][] UNION ALL
    SELECT rk.k, CASE WHEN len(list_filter(kept, lambda y: len(list_intersect(x, y)) > 0 AND len(list_intersect(x, y)) < len(x) AND len(list_intersect(x, y)) < len(y))) = 0
      THEN list_append(kept, x) ELSE kept END FROM fit JOIN rk ON rk.k = fit.k + 1),
  con AS (SELECT unnest(arg_max(kept, k)) AS x FROM fit)"""


@query("a18_consensus_tree", with_(OT_CLADES, CONSENSUS, recursive=True) + """SELECT array_to_string(a.x, ',') AS clade, any_value(rk.support) AS support,
  array_to_string(arg_min(b.x, len(b.x)), ',') AS parent_clade FROM con a JOIN rk ON rk.x = a.x
  LEFT JOIN con b ON len(b.x) > len(a.x) AND len(list_intersect(a.x, b.x)) = len(a.x) GROUP BY a.x""")
def _(spark, sf):
    # the whole leaf set of the sample goes first, so that one root holds all clades
    sup = support(spark, sf)
    every = sup.select(F.explode("clade").alias("x")).distinct().agg(F.array_sort(F.collect_list("x")).alias("clade"))
    total = order_trees(spark, sf).select("tree_id").distinct().count() + 1
    rest = sup.join(small(every), "clade", "left_anti")
    kept = tr.consensus(rest.unionByName(every.withColumn("support", F.lit(total).cast("bigint"))))
    return kept.select(F.array_join("clade", ",").alias("clade"), "support", F.array_join("parent_clade", ",").alias("parent_clade"))


@query("a18_clade_times", with_(OT_CLADES) + "SELECT clade, avg(CASE WHEN label IN ('F', 'O') THEN 0.5 WHEN length(label) = 2 THEN 0 ELSE 0.5 END::DOUBLE) AS time FROM oc WHERE clade LIKE '%,%' GROUP BY 1")
def _(spark, sf):
    t = tr.with_times(order_trees(spark, sf), 0.5, 3).select("tree_id", "node_id", "time")
    # read twice: by the clades and by their times
    rows = cut(order_clades(spark, sf).filter(F.size("clade") > 1).join(t, ["tree_id", "node_id"]).select("clade", "time"))
    sup = rows.select("clade").distinct()
    return tr.clade_times(sup, rows).select(F.array_join("clade", ",").alias("clade"), "time")


@query("u3_clade_algebra", with_(OT_CLADES, """pr AS (SELECT a.tree_id, string_split(a.clade, ',') AS x, string_split(b.clade, ',') AS y FROM
  (SELECT * FROM oc WHERE label IN ('A','N','R')) a JOIN (SELECT * FROM oc WHERE label IN ('F','O')) b USING (tree_id))""") +
  """SELECT tree_id, sum(len(list_intersect(x, y)))::BIGINT AS common, sum((len(list_intersect(x, y)) = len(y))::INT)::BIGINT AS subsets,
  sum((len(list_intersect(x, y)) = 0)::INT)::BIGINT AS disjoint FROM pr GROUP BY 1""")
def _(spark, sf):
    named = order_clades(spark, sf).join(order_trees(spark, sf).select("tree_id", "node_id", "label"), ["tree_id", "node_id"])
    a = named.filter(F.col("label").isin("A", "N", "R")).select("tree_id", F.col("clade").alias("x"))
    b = named.filter(F.col("label").isin("F", "O")).select("tree_id", F.col("clade").alias("y"))
    # at most three flags by six states per tree
    return a.join(b, "tree_id").groupBy("tree_id").agg(
        F.sum(F.size(F.array_intersect("x", "y"))).cast("bigint").alias("common"),
        F.sum((F.size(F.array_except("y", "x")) == 0).cast("bigint")).alias("subsets"),
        F.sum((~F.arrays_overlap("x", "y")).cast("bigint")).alias("disjoint"),
    )


HEIGHT = """up AS (SELECT pc.ancestor AS node_id, max(pc.length) AS max_to_leaf, min(pc.length) AS min_to_leaf FROM pc JOIN ptleaf l ON l.node_id = pc.descendant GROUP BY 1),
dn AS (SELECT pc.descendant AS node_id, max(pc.length) + 0.0::DOUBLE AS from_root FROM pc WHERE pc.ancestor = 'ROOT' GROUP BY 1)"""


@query("a28_tree_heights", with_(PT, PT_LEAF, PT_CLOSURE, HEIGHT, recursive=True) + "SELECT node_id, max_to_leaf, min_to_leaf, from_root FROM up JOIN dn USING (node_id)")
def _(spark, sf):
    return tr.heights(places(spark, sf), 3).drop("tree_id")


@query("a28_node_times", with_(PT, PT_LEAF, PT_CLOSURE, HEIGHT, recursive=True) + "SELECT node_id, 10.0::DOUBLE - from_root AS time FROM dn")
def _(spark, sf):
    return tr.with_times(places(spark, sf), 10.0, 3).select("node_id", "time")


@query("a29_bottom_up_fold", with_(PT, PT_LEAF, PT_CLOSURE, recursive=True) + """SELECT pc.ancestor AS node_id, round(sum(c.c_acctbal), 2) AS balance FROM pc
  JOIN ptleaf l ON l.node_id = pc.descendant JOIN customer c ON l.node_id = 'C' || c.c_custkey GROUP BY 1""")
def _(spark, sf):
    money = views.table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_id"), "c_acctbal")
    tree = places(spark, sf).join(money, "node_id", "left")
    folded = tr.fold_up(tree, F.col("c_acctbal"), lambda: F.sum("carried"), depth=3)
    return folded.filter(F.col("value").isNotNull()).select("node_id", F.round("value", 2).alias("balance"))


VISIT = """path(node_id, pre_path, post_path) AS (
  SELECT node_id, '', '~' FROM pt WHERE parent_id IS NULL UNION ALL
  SELECT pt.node_id, path.pre_path || lpad(pt.ordinal::VARCHAR, 12, '0'), path.pre_path || lpad(pt.ordinal::VARCHAR, 12, '0') || '~'
  FROM path JOIN pt ON pt.parent_id = path.node_id)"""


@query("w2_post_order", with_(PT, VISIT, recursive=True) + """SELECT node_id, (row_number() OVER (ORDER BY pre_path) - 1)::BIGINT AS pre, (row_number() OVER (ORDER BY post_path) - 1)::BIGINT AS post FROM path""")
def _(spark, sf):
    return tr.visit_order(places(spark, sf), 3).select("node_id", "pre", "post")


@query("t3_first_match", with_(PT, VISIT, recursive=True) + "SELECT label, arg_min(node_id, pre_path) AS node_id FROM path JOIN pt USING (node_id) GROUP BY 1")
def _(spark, sf):
    return tr.first_match(tr.visit_order(places(spark, sf), 3)).select("label", "node_id")


@query("t3_subtree", with_(PT, PT_CLOSURE, recursive=True) + "SELECT pc.descendant AS node_id, pc.distance::BIGINT AS depth FROM pc JOIN pt ON pt.node_id = pc.ancestor WHERE pt.label = 'ASIA'")
def _(spark, sf):
    return tr.subtree_at(places(spark, sf), "ASIA").select("node_id", F.col("depth").cast("bigint").alias("depth"))


@query("b1_observed_nodes", with_(WL, LT, LT_LEAF, LT_CLOSURE, recursive=True) + "SELECT DISTINCT slot, ancestor::BIGINT AS node_id FROM wl JOIN leaf USING (language) JOIN cl ON cl.descendant = leaf.node_id")
def _(spark, sf):
    return tr.observed_nodes(words(spark, sf), views.language_tree(spark), 2).withColumn("node_id", F.col("node_id").cast("bigint"))


LIN = """ev AS (SELECT user_id AS lineage_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000.0::DOUBLE AS time, epoch_us(ts) AS us FROM events)"""


@query("a25_lineage_likelihood", with_(LIN, "g AS (SELECT *, time - lag(time, 1, 0.0::DOUBLE) OVER (PARTITION BY lineage_id ORDER BY i) AS gap, count(*) OVER (PARTITION BY lineage_id) + 1 AS n FROM ev)") +
  "SELECT lineage_id, round(-sum((n - i) * (n - i - 1) / 2 * gap), 4) AS log_p, max(n)::BIGINT AS n FROM g GROUP BY 1")
def _(spark, sf):
    return ln.log_likelihood(views.lineages(spark, sf)).select("lineage_id", F.round("log_p", 4).alias("log_p"), "n")


@query("w3_merge_gaps", with_(LIN) + "SELECT lineage_id, i::BIGINT AS i, round(time - lag(time, 1, 0.0::DOUBLE) OVER (PARTITION BY lineage_id ORDER BY i), 9) AS gap FROM ev")
def _(spark, sf):
    return ln.merge_gaps(views.lineages(spark, sf)).select("lineage_id", F.col("i").cast("bigint").alias("i"), F.round("gap", 9).alias("gap"))
