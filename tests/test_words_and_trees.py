"""Golden word list, tree strings, orders and consensus against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from wordkin.functions.ordered import fill_down, ranked, running_total
from wordkin.operators import clusters as cl, evaluation as ev, trees as tr
from wordkin.sources import comparative as comp, wordlists as wls
from wordkin.sources.treetext import read_trees, tree_rows, tree_texts

LINES = [
    "# es it la pt ",
    "Country(1) alemania ʤermanja germania ɐlɨmɐmɐ ",
    "",
    "Country(2) aɾxel alʤɛri algeria ɐɾʒel",
    "Group(3) aɾabes arabe ? aɾɐbeʃ",
]
LANGS = ["es", "it", "la", "pt"]


@pytest.fixture(scope="module")
def words(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no int, value string")
    return wls.parse_wide(lines, LANGS, has_gloss=True)


def test_golden_word_list(words):
    rows = words.collect()
    assert len(rows) == 11
    assert {r.slot for r in rows} == {"Country", "Group"}
    assert ("pt", "ɐlɨmɐmɐ") in {(r.language, r.word) for r in rows}


def test_slot_level_scores(words):
    at = words.withColumn("cluster_id", F.col("slot"))
    r = ev.precision_recall(at).first()
    assert (r.correct, r.guesses, r.gold) == (15, 31, 15)
    assert (r.precision, r.recall) == (15 / 31, 1.0)
    assert ev.purity(at).first().purity == (4 + 3) / 11
    assert ev.exact_groups(at).first().exact == 1
    lonely = ev.precision_recall(words.withColumn("cluster_id", F.col("obs_id"))).first()
    assert lonely.precision is None and lonely.recall == 0.0


def test_width_is_checked(spark):
    lines = spark.createDataFrame([(1, "a b c")], "line_no int, value string")
    with pytest.raises(Exception, match="3 word cells"):
        wls.parse_wide(lines, ["x", "y"]).collect()
    assert [r.word for r in wls.parse_wide(lines, ["x", "y"], truncate=True).collect()] == ["a", "b"]


def test_files_round_trip(spark, tmp_path, words):
    wide = wls.wide_lines(words, "gold_id", LANGS)
    wls.write_wordlist(wide, LANGS, str(tmp_path / "w"))
    (tmp_path / "tree").write_text("(la (b (it) (c (es) (pt))))\n")
    data = wls.load_dataset(spark, str(tmp_path / "w" / "*"), str(tmp_path / "tree"), LANGS)
    assert {(r.language, r.word) for r in data.words.collect()} == {(r.language, r.word) for r in words.collect()}
    part = wls.configured_dataset(data, "c", filter_leaves=True)
    assert {r.language for r in part.words.collect()} == {"es", "pt"}
    assert part.base is data
    (tmp_path / "head").write_text("\n".join(LINES))
    assert wls.infer_languages(spark, str(tmp_path / "head")) == LANGS


COMPARATIVE = """a 001 ALL
b                      001
  001 02 Irish A       uile, gach
  001 03 Irish B.      gach
b                      002
c    2  2  3
  001 05 Welsh List    pob/x (y)
  001 06 Latin         .
b                      003
c    3  3  2
  001 07 Breton        hol
"""


def test_repeated_comparative_forms(spark, tmp_path):
    """The last line of a language in a group counts; a gloss that is opened again starts anew."""
    text = """a 001 ALL
b                      002
  001 02 French          tout
  001 03 Irish           uile
  001 02 French          tous
a 002 DOG
b                      001
  002 02 French          chien
  002 02 French          mâtin
b                      003
  002 03 Irish           gadhar, madra
a 001 ALL
b                      002
  001 04 Welsh           holl
"""
    path = tmp_path / "base.txt"
    path.write_text(text)
    lines = comp.comparative_lines(spark, str(path))

    def rows(**how):
        return sorted((r.gloss, r.group_id, r.language, r.word) for r in comp.read_forms(lines, **how).collect())

    assert rows() == [("ALL", "002", "Welsh", "holl"), ("DOG", "001-0", "French", "chien"), ("DOG", "001-1", "French", "mâtin"), ("DOG", "003", "Irish", "gadhar")]
    assert len(rows(repeated="all")) == 7
    with pytest.raises(ValueError):
        comp.read_forms(lines, "first")


def test_comparative_file(spark, tmp_path):
    path = tmp_path / "db.txt"
    path.write_text(COMPARATIVE)
    lines = comp.comparative_lines(spark, str(path))
    got = sorted((r.gloss, r.group_id, r.language, r.word) for r in comp.read_forms(lines).collect())
    assert got == [
        ("ALL", "001-0", "Irish A", "uile"),
        ("ALL", "001-1", "Irish B", "gach"),
        ("ALL", "002", "Welsh List", "pob"),
        ("ALL", "003", "Breton", "hol"),
    ]
    rel = sorted((r.group_a, r.group_b, r.certainty) for r in comp.read_relations(lines).collect())
    assert rel == [("2", "3", "sure"), ("3", "2", "doubtful")]


def test_chunked_prefixes_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [("k", i, rng.choice([None, f"h{i}"]), rng.randint(0, 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, h string, v int")
    last, total, want = None, 0, {}
    for _, i, h, v in rows:
        last = h or last
        want[i] = (last, total)
        total += v
    down = {r.i: r.h for r in fill_down(df, ["k"], "i", ["h"], chunk=3).collect()}
    sums = {r.i: r.s for r in running_total(df, ["k"], "i", F.col("v"), "s", chunk=3).collect()}
    assert all((down[i], sums[i]) == want[i] for i in want)
    rank = {r.i: r.r for r in ranked(df, ["k"], ["i"], F.floor(F.col("i") / 7), "r").collect()}
    assert rank == {i: i for i in range(40)}


NEWICK = "((a:1, b:[x]2)c:0.5, d:Infinity, (e)f)r;"


def test_tree_strings(spark):
    rows = tree_rows(NEWICK, "newick")
    by = {r[2]: r for r in rows}
    assert by["a"][3] == 1.0 and by["b"][3] == 2.0 and by["d"][3] == float("inf") and by["c"][3] == 0.5
    assert by["e"][1] == by["f"][0] and by["r"][1] is None and by["d"][4] == 1
    lisp = {r[2]: r for r in tree_rows("(r (c:0.5 (a:1) (b:2)) (d:3))", "lisp")}
    assert lisp["b"][5] == 2 and lisp["c"][3] == 0.5 and lisp["d"][4] == 1
    assert [r[2] for r in tree_rows("(,b)", "newick")] == ["", "", "b"]
    for bad in ("((a)b", "a)b", "(a)b(c)d"):
        with pytest.raises(ValueError):
            tree_rows(bad, "newick")
    df = spark.createDataFrame([("t", NEWICK)], "tree_id string, text string")
    nodes = read_trees(df)
    assert tree_texts(nodes, 2).first().text == "((a:1.0, b:2.0)c:0.5, d:Infinity, (e)f)r"
    again = read_trees(tree_texts(nodes, 2))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, nodes.collect()), key=repr)


def test_orders_and_heights(spark):
    df = spark.createDataFrame([("t", "((a:1,b:2)c:0.5,d:3)r;")], "tree_id string, text string")
    tree = read_trees(df)
    order = {r.label: (r.pre, r.post, r.subtree_size) for r in tr.visit_order(tree).collect()}
    assert order == {"r": (0, 4, 5), "c": (1, 2, 3), "a": (2, 0, 1), "b": (3, 1, 1), "d": (4, 3, 1)}
    names = {r.node_id: r.label for r in tree.collect()}
    h = {names[r.node_id]: (r.max_to_leaf, r.min_to_leaf, r.from_root) for r in tr.heights(tree).collect()}
    assert h["r"] == (3.0, 1.5, 0.0) and h["c"] == (2.0, 1.0, 0.5) and h["b"] == (0.0, 0.0, 2.5)
    times = {r.label: r.time for r in tr.with_times(tree, 10.0).collect()}
    assert times == {"r": 10.0, "c": 9.5, "a": 8.5, "b": 7.5, "d": 7.0}
    assert {r.label for r in tr.subtree_at(tree, "c").collect()} == {"a", "b", "c"}


def greedy(ranked_clades):
    kept = []
    for c in ranked_clades:
        if all(not (c & k) or c <= k or k <= c for k in kept):
            kept.append(c)
    return set(kept)


def test_consensus_equals_greedy_insertion(spark):
    taxa = "abcdefg"
    for seed, batch in ((0, 1000), (1, 2)):
        rng = random.Random(seed)
        sets = {frozenset(taxa)} | {frozenset(rng.sample(taxa, rng.randint(2, 5))) for _ in range(12)}
        rows = [(sorted(s), 100 if len(s) == 7 else rng.randint(1, 9)) for s in sets]
        df = spark.createDataFrame(rows, "clade array<string>, support long")
        order = sorted(rows, key=lambda r: (-r[1], -len(r[0]), "\u0001".join(r[0])))
        want = greedy([frozenset(r[0]) for r in order])
        got = tr.consensus(df, batch).collect()
        assert {frozenset(r.clade) for r in got} == want
        for r in got:
            above = [k for k in want if frozenset(r.clade) < k]
            assert (r.parent_clade is None) == (not above)
            if above:
                assert frozenset(r.parent_clade) == min(above, key=len)


def test_gold_assignment_and_matching(spark):
    rows = [("s", "k1", "kasa", "kasa"), ("s", "k1", "kaza", "kasa"), ("s", "k2", "mare", "mar"), ("s", "k3", "luna", "lun")]
    df = spark.createDataFrame(rows, "slot string, cluster_id string, word string, gold_word string")
    gold = df.select("slot", "gold_word").distinct()
    got = {r.cluster_id: (r.gold_word, r.how) for r in cl.assign_gold(df, gold).collect()}
    assert got == {"k1": ("kasa", "vote"), "k2": ("mar", "overlap"), "k3": ("lun", "overlap")}
    words = spark.createDataFrame(
        [("s", "es", "kasa"), ("s", "it", "kaza"), ("s", "es", "mare"), ("s", "it", "mar")], "slot string, language string, word string"
    ).withColumn("obs_id", F.concat_ws(":", "language", "word"))
    groups: dict = {}
    for r in cl.dice_baseline(words, ["es", "it"]).collect():
        groups.setdefault(r.cluster_id, set()).add(r.word)
    assert sorted(map(sorted, groups.values())) == [["kasa", "kaza"], ["mar", "mare"]]


def test_group_operations(spark, words):
    sets = {r.languages: (r.groups, r.partners) for r in cl.compatible_groups(words.withColumn("cluster_id", F.col("language"))).filter("slot = 'Country'").collect()}
    assert sets["es"] == (1, 3)
    maps = cl.words_by_language(words, "gold_id").collect()
    assert {len(r.by_language) for r in maps} == {4, 3}
    masked = cl.mask_words(words, 0.5, 1).count()
    assert masked == cl.mask_words(words, 0.5, 1).count() < 11
