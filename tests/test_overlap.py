"""Set overlap and matching against listing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from wordkin.operators import clusters as cl, overlap


def sets_of(rng, n, letters, prefix):
    out = []
    for i in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(0, 7)))
        out.append(("s", f"{prefix}{i}", sorted({w[k : k + 2] for k in range(len(w) - 1)})))
    return out


def all_pairs(left, right, threshold):
    out = {}
    for slot, a, x in left:
        for other, b, y in right:
            if slot == other and x and y:
                d = 2.0 * len(set(x) & set(y)) / (len(x) + len(y))
                if d >= threshold and d > 0:
                    out[slot, a, b] = d
    return out


@pytest.mark.parametrize("block, threshold, letters", [(512, 0.2, "abc"), (6, 1e-9, "abc"), (6, 0.2, "abcdefghijklmnop"), (6, 0.7, "abcd"), (6, 1.0, "ab")])
def test_overlaps_equal_all_pairs(spark, monkeypatch, block, threshold, letters):
    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(block)
    left, right = sets_of(rng, 70, letters, "l"), sets_of(rng, 60, letters, "r")
    left += [("t", "x", ["ab"]), ("u", "x", ["ab"])]
    right += [("t", "y", ["ab", "bc"]), ("v", "y", ["ab"]), ("t", "ÿ", ["ab", "bé"])]
    schema = "slot string, id string, bigrams array<string>"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = all_pairs(left, right, threshold)
    got = overlap.overlaps(a, b, threshold, best=False).collect()
    assert len(got) == len(want) and {(r.slot, r.left_id, r.right_id): r.dice for r in got} == want
    best = {(r.slot, r.side, r.id): (r.dice, r.partner) for r in overlap.overlaps(a, b, threshold).collect()}
    wanted: dict = {}
    for (slot, x, y), d in want.items():
        for key, other in (((slot, 0, x), y), ((slot, 1, y), x)):
            wanted[key] = max(wanted.get(key, (0.0, "")), (d, other), key=lambda v: (v[0], v[1].encode()))
    assert best == wanted


def test_rare_elements_send_sets_to_few_lists(spark):
    """Sets meet through the rarest elements that a partner must share: fewer for a higher threshold."""
    sets = spark.createDataFrame([("s", f"i{k}", 0, ["all", f"half{k % 2}", f"own{k}"]) for k in range(8)], "slot string, id string, side int, bigrams array<string>")
    rows = overlap.by_rarity(sets)
    assert all(r.bigrams[0].startswith("own") and r.bigrams[2] == "all" for r in rows.collect())
    assert {t: overlap.prefix_rows(rows, t).count() for t in (1e-9, 0.6, 1.0)} == {1e-9: 24, 0.6: 16, 1.0: 8}


@pytest.mark.parametrize("seed", range(3))
def test_dominant_pairs_are_the_greedy_matching(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.choice("st"), f"l{rng.randrange(30)}", f"r{rng.randrange(30)}"): rng.randrange(1, 5) / 7 for _ in range(300)}.items())
    pairs = [(*k, d) for k, d in rows]
    used, want = set(), set()
    for slot, a, b, d in sorted(pairs, key=lambda p: (p[3], p[1], p[2]), reverse=True):
        if (slot, "l", a) not in used and (slot, "r", b) not in used:
            used |= {(slot, "l", a), (slot, "r", b)}
            want.add((slot, a, b))
    df = spark.createDataFrame(pairs, "slot string, left_id string, right_id string, dice double")
    got = cl.dominant_pairs(df).collect()
    assert {(r.slot, r.left_id, r.right_id) for r in got} == want and len(got) == len(want)
    assert cl.dominant_pairs(df.where(F.lit(False))).count() == 0
