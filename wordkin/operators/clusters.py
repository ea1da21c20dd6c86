"""Word groups: merging, compatibility, masking, survival, and bigram matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wordkin.functions.text import bigram_set, keyed_share
from wordkin.operators.overlap import overlaps
from wordkin.operators.pairs import count_pairs, explode_pairs, pair_blocks, with_blocks
from wordkin.operators.trees import closure, leaves, observed_nodes
from wordkin.session import cut, small


# Dice threshold of the baseline, added count of the survival estimate.
DICE_THRESHOLD = 0.2
ADDED_DEATHS = 0.5
# Below the Dice coefficient of any two sets with a common element.
ANY_COMMON = 1e-9


def merge_groups(words: DataFrame, moves: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Set union of groups: ``moves(cluster_id, into)`` renames, then equal rows collapse."""
    return (
        words.join(moves, cluster, "left")
        .withColumn(cluster, F.coalesce("into", cluster))
        .drop("into")
        .distinct()
    )


def add_words(words: DataFrame, more: DataFrame) -> DataFrame:
    return words.unionByName(more).distinct()


def group_glosses(words: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, slot): the distinct glosses of each group."""
    return words.select(cluster, "slot").distinct()


def words_by_language(words: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """language -> word map of a group; of several words the largest stays."""
    one = words.groupBy(cluster, "language").agg(F.max("word").alias("word"))
    return one.groupBy(cluster).agg(F.map_from_entries(F.collect_list(F.struct("language", "word"))).alias("by_language"))


def can_merge(languages_a: Column, languages_b: Column) -> Column:
    """Two groups can merge when they share no language."""
    return ~F.arrays_overlap(languages_a, languages_b)


def compatible_groups(words: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Per slot and set of languages: how many groups have it, and with how many groups of
    the slot each of them can merge. Groups are first reduced to their language sets."""
    sets = words.groupBy("slot", cluster).agg(F.array_sort(F.collect_set("language")).alias("languages"))
    count = sets.groupBy("slot", "languages").agg(F.count("*").alias("groups"))
    rows = with_blocks(count.withColumn("word", F.array_join("languages", ",")))
    packed = F.struct("word", "languages", "groups")
    blocks = pair_blocks(rows.withColumn("p", packed), rows.withColumn("c", packed), ["slot"], count_pairs(rows, rows))
    fits = can_merge(F.col("p.languages"), F.col("c.languages"))
    return (
        explode_pairs(blocks, ["slot"])
        .groupBy("slot", F.col("p.word").alias("languages"))
        .agg(
            F.max("p.groups").alias("groups"),
            F.sum(F.when(fits, F.col("c.groups")).otherwise(0)).alias("partners"),
        )
    )


def mask_words(words: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Hide a seeded share of the words; the same words on every run."""
    at = keyed_share([F.lit(str(seed)), F.col("slot"), F.col("language"), F.col("word")])
    return words.filter(at >= F.lit(int(share * 10_000)))


def prune_branches(words: DataFrame, tree: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Hide all words below a seeded share of the (slot, branch) pairs.

    A word only needs the branches above its own leaf, so the test is local to its row.
    """
    at = leaves(tree).select("tree_id", F.col("node_id").alias("descendant"), F.col("label").alias("language"))
    above = closure(tree).join(at, ["tree_id", "descendant"])
    top = tree.filter(F.col("parent_id").isNull()).select("tree_id", F.col("node_id").alias("ancestor"))
    path = (
        above.join(top, ["tree_id", "ancestor"], "left_anti")
        .groupBy("language")
        .agg(F.array_sort(F.collect_set(F.col("ancestor").cast("string"))).alias("_path"))
    )
    limit = F.lit(int(share * 10_000))
    hit = F.exists("_path", lambda n: keyed_share([F.lit(str(seed)), F.col("slot"), n]) < limit)
    return words.join(small(path), "language").filter(~hit).drop("_path")


def death_rates(words: DataFrame, tree: DataFrame) -> DataFrame:
    """Per branch: (slots dead below a live parent + 0.5) / slots with a live parent.

    A live child has live ancestors, so two counts per node are enough.
    """
    live = observed_nodes(words, tree).groupBy("node_id").agg(F.count("*").alias("live"))
    up = live.select(F.col("node_id").alias("parent_id"), F.col("live").alias("live_parents"))
    return (
        tree.filter(F.col("parent_id").isNotNull())
        .join(small(up), "parent_id")
        .join(small(live), "node_id", "left")
        .select(
            "node_id",
            "label",
            "live_parents",
            (F.col("live_parents") - F.coalesce("live", F.lit(0))).alias("deaths"),
        )
        .withColumn("rate", (F.col("deaths") + F.lit(ADDED_DEATHS)) / F.col("live_parents"))
    )


def group_bigrams(words: DataFrame, keys: list[str]) -> DataFrame:
    """Union of the members' bigrams; the alphabet bounds its size, repeats go before the shuffle."""
    return (
        words.select(*keys, F.explode(bigram_set(F.col("word"))).alias("_b"))
        .distinct()
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_b")).alias("bigrams"))
    )


def best_partners(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(slot, left_id, right_id, dice): mutual best partners at or above the threshold; ties go to the larger id."""
    found = cut(overlaps(left, right, threshold))
    for_left = found.where("side = 0").select("slot", F.col("id").alias("left_id"), F.col("partner").alias("right_id"), "dice")
    for_right = found.where("side = 1").select("slot", F.col("partner").alias("left_id"), F.col("id").alias("right_id"))
    return for_left.join(for_right, ["slot", "left_id", "right_id"])


def word_group_dice(words: DataFrame, language: str, cluster: str = "cluster_id") -> DataFrame:
    """Best Dice of each word of a language with the groups of its slot, own language left out."""
    groups = cut(group_bigrams(words.filter(F.col("language") != language), ["slot", cluster]).withColumnRenamed(cluster, "id"))
    own = words.filter(F.col("language") == language).select("slot", F.col("word").alias("id"), bigram_set(F.col("word")).alias("bigrams")).distinct()
    best = overlaps(groups, own, ANY_COMMON).where("side = 1").select("slot", "id", "dice")
    count = groups.groupBy("slot").agg(F.count("*").alias("groups"))
    return own.join(count, "slot").join(best, ["slot", "id"], "left").select(
        "slot", F.col("id").alias("word"), F.coalesce("dice", F.lit(0.0)).alias("dice"), "groups"
    )


def match_round(words: DataFrame, language: str, threshold: float = DICE_THRESHOLD, cluster: str = "cluster_id") -> DataFrame:
    """One round of the bigram baseline: every word of ``language`` leaves its group and joins
    its mutual best group of the other languages, or starts a group of its own."""
    rest = words.filter(F.col("language") != language)
    own = words.filter(F.col("language") == language)
    groups = group_bigrams(rest, ["slot", cluster]).withColumnRenamed(cluster, "id")
    items = own.select("slot", F.col("word").alias("id"), bigram_set(F.col("word")).alias("bigrams")).distinct()
    picked = best_partners(groups, items, threshold).select("slot", F.col("right_id").alias("word"), F.col("left_id").alias("_to"))
    moved = own.join(picked, ["slot", "word"], "left").withColumn(
        cluster, F.coalesce("_to", F.concat_ws("|", "slot", "language", "word"))
    )
    return rest.unionByName(moved.select(*rest.columns))


def dice_baseline(words: DataFrame, languages: list[str], rounds: int = 1, threshold: float = DICE_THRESHOLD) -> DataFrame:
    """Rounds over all languages, starting from singletons."""
    at = words.withColumn("cluster_id", F.concat_ws("|", "slot", "language", "word"))
    for _ in range(rounds):
        for language in languages:
            at = cut(match_round(at, language, threshold))
    return at


def assign_gold(words: DataFrame, gold_words: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Gold word of every group: the word that at least two members agree on, else mutual
    best bigram overlap with the gold words of the slot still free, round by round.

    ``words(slot, cluster_id, word, gold_word)``, ``gold_words(slot, gold_word)``. The overlaps of all open
    groups and gold words are scored once. A round settles every pair that neither side could better, and
    drops the pairs of those settled: the result is that of taking the best open pair again and again, but
    rounds do not follow the size of a slot.
    """
    n = words.groupBy("slot", cluster, "gold_word").agg(F.count("*").alias("n"))
    voted = n.filter("n >= 2").groupBy("slot", cluster).agg(F.max_by("gold_word", F.struct("n", "gold_word")).alias("gold_word"))
    done = cut(voted.withColumn("how", F.lit("vote")))
    groups = group_bigrams(words, ["slot", cluster]).withColumnRenamed(cluster, "id")
    golds = gold_words.select("slot", F.col("gold_word").alias("id"), bigram_set(F.col("gold_word")).alias("bigrams")).distinct()
    open_groups = groups.join(done.select("slot", F.col(cluster).alias("id")), ["slot", "id"], "left_anti")
    open_golds = golds.join(done.select("slot", F.col("gold_word").alias("id")), ["slot", "id"], "left_anti")
    pairs = overlaps(open_groups, open_golds, ANY_COMMON, best=False)
    found = dominant_pairs(pairs).select("slot", F.col("left_id").alias(cluster), F.col("right_id").alias("gold_word"), F.lit("overlap").alias("how"))
    return done.unionByName(found)


def dominant_pairs(pairs: DataFrame) -> DataFrame:
    """Greedy matching of (slot, left_id, right_id, dice): pairs by falling (dice, left_id, right_id), each taken if both
    its ends are free. Pairs that are the best of both their ends are settled together, round by round."""
    live = cut(pairs)
    settled = None
    while True:
        order = F.struct("dice", "left_id", "right_id")
        for_left = live.groupBy("slot", "left_id").agg(F.max(order).alias("_t")).select("slot", "left_id", F.col("_t.right_id").alias("right_id"))
        for_right = live.groupBy("slot", "right_id").agg(F.max(order).alias("_t")).select("slot", F.col("_t.left_id").alias("left_id"), "right_id")
        found = cut(for_left.join(for_right, ["slot", "left_id", "right_id"]))
        if found.isEmpty():
            return found if settled is None else settled
        settled = found if settled is None else settled.unionByName(found)
        live = cut(
            live.join(found.select("slot", "left_id"), ["slot", "left_id"], "left_anti").join(
                found.select("slot", "right_id"), ["slot", "right_id"], "left_anti"
            )
        )
