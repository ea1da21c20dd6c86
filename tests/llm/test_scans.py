"""Licence scans, spelling variants and exact clustering against brute force and odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wordkin.llm import centroids, licenses, variants
from wordkin.llm.queries import op11_licenses, op12_spelling_variants, op13_centroids

DOCS = "doc_id long, text string, labels string, n_words string"
ODD = [(None, None, "x", None), (1, "", "x", "1"), (1, "", "x", "1"), (2, " \n\t ", None, ""), (3, "one two", "n_words", "word")]


# ---- licences ----------------------------------------------------------------------------


def words_of(text):
    out, run = [], ""
    for ch in (text or "") + " ":
        low = ch.lower() if "A" <= ch <= "Z" else ch
        if low in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(low) >= 128:
            run += low
        elif run:
            out.append(run)
            run = ""
    return out


def slow_matches(words, templates, long):
    """All longest common runs on every diagonal, by comparing every pair of places."""
    found = set()
    for t, template in enumerate(templates):
        for i in range(len(words)):
            for j in range(len(template)):
                if words[i] == template[j] and not (i and j and words[i - 1] == template[j - 1]):
                    n = 0
                    while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                        n += 1
                    if n >= long:
                        found.add((t, i, i + n - 1, j - i))
    return found


def slow_best(runs, gap):
    """Largest cover of a chain that ends with each run, over all chains."""
    runs = sorted(runs)

    def follow(chain, covered, k, out):
        first, last, shift = runs[k]
        key = runs[k]
        out[key] = max(out.get(key, 0), covered)
        for m in range(len(runs)):
            f, g, s = runs[m]
            if f > first and g > last and f + s > first + shift and g + s > last + shift and f - last - 1 <= gap and f + s - last - shift - 1 <= gap:
                follow(chain + [m], covered + g - f + 1 - max(0, last - f + 1, last + shift - f - s + 1), m, out)
        return out

    out = {}
    for k, (first, last, _) in enumerate(runs):
        follow([k], last - first + 1, k, out)
    return out


def test_automaton_matches_equal_all_diagonals():
    rng = random.Random(4)
    for _ in range(60):
        letters = "abc" if rng.random() < 0.5 else "abcdefg"
        templates = [" ".join(rng.choice(letters) for _ in range(rng.randint(2, 14))) for _ in range(4)]
        phrases = {" ".join(rng.choice(letters) for _ in range(rng.randint(2, 3))): f"p{k}" for k in range(3)}
        text = " ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            text = templates[0] + " q " + text + " " + templates[1]
        machine = licenses.LicenseAutomaton([("l", t) for t in templates], phrases, long=2)
        words = licenses.split_words(text)
        found, runs = machine.matches(words)
        plain = words_of(text)
        want = slow_matches(plain, [t.split() for t in templates], 2)
        assert {(t, *r) for t, own in runs.items() for r in own} == want
        assert sum(map(len, runs.values())) == len(want)
        places = sorted((k, i) for k, p in enumerate(phrases) for i in range(len(plain)) if plain[i : i + len(p.split())] == p.split())
        assert sorted(found) == places
        # The matching statistic is the longest run that ends at a place.
        for i, _, length in machine.stream(words):
            ends = [" ".join(plain[i - n + 1 : i + 1]) for n in range(1, i + 2)]
            assert length == max(n for n, e in enumerate(ends, 1) if any(f" {e} " in f" {t} " for t in [*templates, *phrases]))


def test_chains_cover_as_much_as_any():
    rng = random.Random(5)
    for _ in range(200):
        runs = list({(a, a + rng.randint(1, 6), rng.randint(-3, 8)) for a in (rng.randint(0, 30) for _ in range(rng.randint(1, 9)))})
        want = slow_best(runs, 4)
        got = licenses.chains(runs, 4)
        assert [c for _, _, c in got] == [want[r] for r in sorted(runs)]


def test_licence_labels():
    machine = licenses.LicenseAutomaton()
    for label, text in licenses.TEMPLATES:
        found = machine.scan("x y z " + text.upper() + " z y x")
        assert label in found["labels"].split(",") and found["score"] == 1.0
    # Two licences that differ in one word: only the one that covers more.
    for label, text in licenses.TEMPLATES:
        if label.startswith("gpl"):
            assert machine.scan(text)["labels"] == f"gpl,{label}"
    changed = licenses.TEMPLATES[0][1].replace("merge", "mix").replace("publish", "print")
    assert machine.scan(changed)["labels"] == "mit" and 0.9 < machine.scan(changed)["score"] < 1
    half = " ".join(licenses.TEMPLATES[0][1].split()[:40])
    assert machine.scan(half)["labels"] == "" and 0.3 < machine.scan(half)["score"] < 0.6
    assert machine.scan("the software is provided to any person")["labels"] == ""


def test_licence_query_equals_search(spark, tmp_path):
    rng = random.Random(6)
    phrases = list(licenses.PHRASES)
    texts = [t for _, t, *_ in ODD] + ["CC-BY cc by,by CC BY", "mit license" * 3, "The MIT\nLicense", "gnu general public license é mit license"]
    for _ in range(60):
        texts.append(" ".join(rng.choice(phrases + ["the", "license", "mit", "é", "cc", "by", "general public"]) for _ in range(rng.randint(1, 12))))
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        words = words_of(t)
        places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[k]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((i for i, _ in places), default=None) and r.last_word == max((i for i, _ in places), default=None)
        base = {label for _, label in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | (set() if base else base)
        assert 0 <= r.score <= 1 and (r.score == 1 or not base)


def test_licence_odd_rows_and_long_texts(spark):
    df = spark.createDataFrame(ODD + [(9, "mit license " * 500_000 + licenses.TEMPLATES[0][1], None, None)], DOCS)
    out = licenses.scan_licenses(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    got = out.drop("text").collect()
    assert len(got) == 6
    assert all((r.n_base, r.labels, r.score, r.spans) == (0, "", 0.0, []) for r in got if r.doc_id != 9)
    long = next(r for r in got if r.doc_id == 9)
    assert (long.n_base, long.first_word, long.last_word, long.labels) == (500_000, 0, 999_998, "mit")
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    # A text column with the name of a result is read, then replaced.
    assert licenses.scan_licenses(df.select("labels"), "labels").columns[-1] == "spans"


# ---- spelling variants -------------------------------------------------------------------


def slow_edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "A" <= ch <= "Z" or "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch.lower() if "A" <= ch <= "Z" else ch
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
                run = ""
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if slow_edit_one(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b if n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n[w], len(near[w]), n[f] if f else None))
    return out


def misspelt(rng, n):
    base = ["colour", "harbour", "strasse", "éléphant", "naïveté", "aaaaa", "ababab", "Àbcde", "running", "x" * 60, "y" * 70 + "z"]
    out = []
    for _ in range(n):
        w = rng.choice(base)
        while rng.random() < 0.5:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("rstü") + w[k + 1 :]]) or "a"
        out.append(rng.choice([w, w, w.upper() if w.isascii() else w]))
    return out


@pytest.mark.parametrize("block, wide", [(variants.BLOCK, None), (5, 2), (3, 6), (4, 8)])
def test_spelling_variants_match_brute_force(spark, monkeypatch, tmp_path, block, wide):
    monkeypatch.setattr(variants, "BLOCK", block)
    if wide:
        monkeypatch.setattr(variants, "wide_groups", lambda _: wide)
    rng = random.Random(7)
    rows = [(k if k % 7 else None, " ".join(misspelt(rng, 30)).replace(" ", rng.choice([" ", "1", "-", "\n"]))) for k in range(150)]
    rows += [(d, t) for d, t, *_ in ODD]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op12_spelling_variants(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = slow_variants(rows)
    assert len(got) == len(want) and set(got) == want and len(want) > 100


def test_walk_finds_all_near_counts():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))).encode("latin-1") for _ in range(400)})
    a, b = words[::2], words[1::2]
    x, y = (np.concatenate(v) for v in zip(*variants.walk(variants.CountTrie(variants.letter_counts(a)), variants.CountTrie(variants.letter_counts(b)))))
    met = set(zip(x.tolist(), y.tolist()))
    assert len(met) == len(x)
    left, right = variants.letter_counts(a), variants.letter_counts(b)
    for i in range(len(a)):
        gap = right - left[i]
        fits = np.flatnonzero((np.maximum(gap, 0).sum(1) <= 1) & (np.maximum(-gap, 0).sum(1) <= 1))
        assert {j for k, j in met if k == i} == set(fits.tolist())
    ok = variants.verify(variants.Letters(a), variants.Letters(b), x, y)
    want = {(i, j) for i, v in enumerate(a) for j, w in enumerate(b) if slow_edit_one(v, w)}
    assert {(i, j) for i, j, k in zip(x.tolist(), y.tolist(), ok) if k} == want


def test_spelling_odd_rows(spark):
    df = spark.createDataFrame(ODD * 3 + [(9, "letters " * 1_200_000 + "lettres " * 3, "", "")], DOCS)
    got = {r.word: r for r in variants.variant_groups(df, every=0).collect()}
    assert set(got) == {"letters", "lettres"} and got["letters"].n == 1_200_000 and got["lettres"].form is None
    assert variants.variant_groups(df.limit(0)).collect() == []


# ---- exact clustering --------------------------------------------------------------------


def slow_lloyd(rows, size, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) if abs(x) < 1e30 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centres = [v for _, v in order[:k]]

    def nearest():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        at = nearest()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centres[j] = [sum(col) // len(own) for col in zip(*own)]
    at, top = nearest(), 2**63 - 1
    inertia = {j: sum(min(d, top) for d, c in at if c == j) for j in range(len(centres))}
    total = min(sum(min(d, top) for d, _ in at), top)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, min(d, top), min(inertia[c], top), total, digest[c]) for (i, _), (d, c) in zip(kept, at)), key=repr)


@pytest.mark.parametrize("scale, rows_per_cell, width", [(1.0, centroids.ROWS, centroids.WIDTH), (1.0, 7, 5), (1e5, 16, 64), (1e12, 16, 20)])
def test_lloyd_matches_brute_force(spark, monkeypatch, scale, rows_per_cell, width):
    monkeypatch.setattr(centroids, "ROWS", rows_per_cell)
    rng = np.random.default_rng(9)
    rows = [(k, (rng.normal(size=64) * scale).tolist()) for k in range(120)]
    # Repeated rows and ids, ties, and vectors that are left out.
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (500, rows[6][1]), (501, [0.0] * 64), (502, [0.0] * 64)]
    rows += [(600, None), (601, []), (602, [1.0] * 63), (603, [None] + [1.0] * 63), (604, [float("nan")] * 64), (605, [float("inf")] + [0.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, cluster string, inertia int")
    got = sorted((tuple(r) for r in centroids.lloyd(df, width=width).collect()), key=repr)
    assert got == slow_lloyd(rows, 64)


def test_lloyd_of_few_and_huge_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(1, [0.5] * 64, 1), (2, [-0.5] * 64, 1), (3, [3e38] * 64, 1)], schema)
    got = sorted((tuple(r) for r in centroids.lloyd(few).collect()), key=repr)
    assert got == slow_lloyd([(r.vec_id, r.embedding) for r in few.collect()], 64)
    few.limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op13_centroids(spark, str(tmp_path)).collect() == []


def test_whole_numbers_survive_packing():
    for values in ([], [1, -1], [2**40], [-(2**62)], [10**30, -5]):
        x = np.array(values, object if any(abs(v) >= 2**62 and v > 0 for v in values) else np.int64)
        assert [int(v) for v in centroids.unpacked(centroids.packed(x))] == values
