"""Trees that fit one row go through one shuffle, with the same rows as the general form."""

from pyspark.sql import functions as F

from wordkin.operators import trees as tr
from wordkin.plans import views
from wordkin.sources import treetext as tt


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_order_texts_are_dealt_once(spark, tmp_path):
    rows = [(1, 1, "A", "F"), (1, 2, "A", "O"), (1, 3, "N", "O"), (1, 3, "R", "F"), (2, 1, "R", "F"), (2, 1, "R", "F"), (None, 4, "N", "O"), (3, None, "N", "O")]
    names = "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    texts = views.order_tree_texts(spark, str(tmp_path))
    assert shuffles(texts) == 1
    assert {r.tree_id: r.text for r in texts.collect()} == {
        1: "(((L1:0.5)F,(L2:0.5)O)A,((L3:0.5)F)N)root;", 2: "(((L1:0.5)F)R)root;", None: "(((L4:0.5)O)N)root;", 3: "((()O)N)root;",
    }


def test_clades_of_whole_trees(spark):
    texts = [(1, "((b,a)x,(c,(d,b)y)z)root;"), (2, "(a)root;"), (3, "((é,z,a)v,(a)w)root;"), (None, "(a,b)root;")]
    nodes = tt.read_trees(spark.createDataFrame(texts, "tree_id long, text string"))
    # rows that come twice, and a leaf without a label
    nodes = nodes.unionByName(nodes.where("tree_id = 1")).withColumn("label", F.when(F.col("label") != "c", F.col("label")))
    found = tr.clades(nodes)
    assert shuffles(found) == 1
    want = tr.clade_members(nodes).groupBy("tree_id", "node_id").agg(F.sort_array(F.collect_set("leaf")).alias("clade"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("tree_id", "node_id", "clade").collect()))
