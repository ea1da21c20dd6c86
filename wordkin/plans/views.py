"""Relations of the engine derived from the given tables.

The tables hold no word families, so these are stand-ins without linguistic meaning:
every distinct word of every document is used, its consonants name the slot, and its
consonants with vowel runs marked name the gold group. Accents are folded so that byte
and character edit distances agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordkin.functions.ordered import ranked
from wordkin.functions.text import HOLE
from wordkin.operators.pairs import tasks_for

# Folded letters (same position = same letter) and the language tree.
ACCENTED = "áàâäãéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"
LANGUAGE_TREE = [
    (0, None, "ROOT", 0.0, 0, 0),
    (1, 0, "A", 1.0, 0, 1),
    (2, 0, "B", 1.0, 1, 1),
    (3, 1, "en", 0.5, 0, 2),
    (4, 1, "de", 0.5, 1, 2),
    (5, 2, "fr", 0.5, 0, 2),
    (6, 2, "es", 0.5, 1, 2),
]
# Three inner levels, leaves at depths 1 to 3.
DEEP_TREE = [
    (0, None, "ROOT", 0.0, 0, 0),
    (1, 0, "A", 1.0, 0, 1),
    (6, 0, "es", 0.5, 1, 1),
    (2, 1, "B", 1.0, 0, 2),
    (5, 1, "fr", 0.5, 1, 2),
    (3, 2, "en", 0.5, 0, 3),
    (4, 2, "de", 0.5, 1, 3),
]
LANGUAGES = ["de", "en", "es", "fr"]
NODES = "node_id int, parent_id int, label string, branch_length double, ordinal int, depth int"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_input(df: DataFrame) -> DataFrame:
    """Split an input that arrives in fewer partitions than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread_input(table(spark, sf, "documents").select("doc_id", "lang", "text"))


def language_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGE_TREE, NODES).select(F.lit("lang").alias("tree_id"), "*")


def deep_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEEP_TREE, NODES).select(F.lit("deep").alias("tree_id"), "*")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    folded = F.translate(F.regexp_replace(F.lower("text"), "ß", "ss"), ACCENTED, PLAIN)
    word = F.explode(F.split(folded, "[^a-z]+")).alias("word")
    return documents(spark, sf).select("doc_id", F.col("lang").alias("language"), word).filter("word <> ''")


def word_list(spark: SparkSession, sf: str) -> DataFrame:
    """words(slot, language, word, gold_id, obs_id): the whole vocabulary of each language."""
    return (
        tokens(spark, sf)
        .select("language", "word")
        .distinct()
        .select(
            F.regexp_replace("word", "[aeiou]+", "").alias("slot"),
            "language",
            "word",
            F.regexp_replace("word", "[aeiou]+", "a").alias("gold_id"),
            F.concat_ws(":", "language", "word").alias("obs_id"),
        )
    )


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return word_list(spark, sf).select("obs_id", "language", "word", F.col("slot").alias("cluster_id"), "gold_id")


def wide_text(spark: SparkSession, sf: str) -> DataFrame:
    """Wide lines ``gloss(n) word word ...``: line k of a gold group holds its k-th word of each language."""
    picks = [
        F.coalesce(F.max(F.when(F.col("language") == x, F.col("word"))), F.lit(HOLE)) for x in LANGUAGES
    ]
    line = F.concat_ws("#", "gold_id", (F.col("k") + 1).cast("string"))
    return (
        ranked(word_list(spark, sf), ["slot", "gold_id", "language"], ["word"], F.ascii("word"), "k")
        .groupBy("slot", line.alias("line_no"))
        .agg(F.array(*picks).alias("cells"))
        .select(
            "line_no",
            F.concat_ws(" ", F.concat(F.lit("g"), F.col("slot"), F.lit("("), F.col("line_no"), F.lit(")")), F.array_join("cells", " ")).alias("value"),
        )
    )


def place_tree(spark: SparkSession, sf: str) -> DataFrame:
    """root -> region -> nation -> customer; the label of a customer is the market segment."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    root = spark.range(1).select(
        F.lit("ROOT").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("world").alias("label"),
        F.lit(0.0).alias("branch_length"), F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).alias("depth"),
    )

    def level(df, key, tag, parent, label, length, depth):
        return df.select(
            F.concat(F.lit(tag), F.col(key).cast("string")).alias("node_id"),
            parent.alias("parent_id"),
            label.alias("label"),
            length.alias("branch_length"),
            F.col(key).cast("bigint").alias("ordinal"),
            F.lit(depth).alias("depth"),
        )

    def under(tag, key):
        return F.concat(F.lit(tag), F.col(key).cast("string"))

    rows = root.union(
        level(region, "r_regionkey", "R", F.lit("ROOT"), F.col("r_name"), F.lit(1.0), 1)
    ).union(
        level(nation, "n_nationkey", "N", under("R", "n_regionkey"), F.col("n_name"), 1.0 + (F.col("n_nationkey") % 3) * 0.5, 2)
    ).union(
        level(customer, "c_custkey", "C", under("N", "c_nationkey"), F.col("c_mktsegment"), 0.5 + (F.col("c_custkey") % 7) * 0.25, 3)
    )
    return rows.select(F.lit("place").alias("tree_id"), "*")


def order_tree_texts(spark: SparkSession, sf: str, style: str = "newick") -> DataFrame:
    """One tree per order: return flag -> line status -> line numbers (leaves L1..L7).

    Lines are dealt by order once; all groups below lie inside an order and need no further shuffle."""
    line = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("tree_id"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("leaf"),
    ).repartition(tasks_for(spark), "tree_id").groupBy("tree_id", "leaf").agg(F.min("f").alias("f"), F.min("s").alias("s"))
    lisp = style == "lisp"

    def join_up(rows, keys, tag):
        inner = F.array_join(F.sort_array(F.collect_list("t")), " " if lisp else ",")
        text = F.concat(F.lit("("), tag, F.lit(" "), inner, F.lit(")")) if lisp else F.concat(F.lit("("), inner, F.lit(")"), tag)
        return rows.groupBy(*keys).agg(inner.alias("_i")).select(
            *keys, (F.concat(F.lit("("), tag, F.lit(" "), "_i", F.lit(")")) if lisp else F.concat(F.lit("("), F.col("_i"), F.lit(")"), tag)).alias("t")
        )

    leaf = F.concat(F.lit("("), "leaf", F.lit(")")) if lisp else F.concat(F.col("leaf"), F.lit(":0.5"))
    t = line.select("tree_id", "f", "s", leaf.alias("t"))
    t = join_up(t, ["tree_id", "f", "s"], F.col("s"))
    t = join_up(t.select("tree_id", "f", "t"), ["tree_id", "f"], F.col("f"))
    t = join_up(t.select("tree_id", "t"), ["tree_id"], F.lit("root"))
    return t.select("tree_id", (F.col("t") if lisp else F.concat("t", F.lit(";"))).alias("text"))


def lineages(spark: SparkSession, sf: str) -> DataFrame:
    """lineage(lineage_id, i, time): events of a user, time in days since the first one."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("lineage_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    first = ev.groupBy("lineage_id").agg(F.min("us").alias("us0"))
    hour = F.floor(F.col("us") / F.lit(3_600_000_000))
    at = ranked(ev, ["lineage_id"], ["us", "event_id"], hour, "i")
    return at.join(first, "lineage_id").select(
        "lineage_id", "i", ((F.col("us") - F.col("us0")) / F.lit(86_400_000_000.0)).alias("time")
    )
