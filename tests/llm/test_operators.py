"""The operators for training data against brute force, round trips and odd rows."""

import base64
import itertools
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wordkin.llm import bpe, chat, copies, hmm, media, minhash, packing, quality, queries, substrings, toxicity, urls
from wordkin.session import scratch_dir

DOCS = "doc_id long, text string, extra string"
ODD = [(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, " \n\t ", None), (3, "one two", "n_words"), (4, "a" * 5000, ""), (5, "é<|im_end|>\u00a0 b", "")]


def prose(rng, n):
    return " ".join(f"{''.join(rng.choice('abcdefghij') for _ in range(5))}" for _ in range(n)) + "."


# ---- near duplicates ---------------------------------------------------------------------


def test_probability_jaccard_matches_definition():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 30, 15).astype(np.uint64)) for _ in range(2))
        wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
        x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
        want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in x.keys() & y.keys())
        assert copies.probability_jaccard(a, wa, b, wb) == pytest.approx(want)


def test_prob_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    every = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.sort(every[:250]), np.sort(every[50:])
    got = minhash.prob_minhash(np.concatenate([a, b]), np.ones(500), np.repeat([0, 1], 250), 2, 4000)
    assert (got[0] == got[1]).mean() == pytest.approx(200 / 300, abs=0.03)


@pytest.mark.parametrize("block, cell_pairs", [(minhash.BLOCK, minhash.CELL_PAIRS), (4, 3)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block, cell_pairs):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CELL_PAIRS", cell_pairs)
    rng = random.Random(3)
    base = [prose(rng, 80) for _ in range(6)]
    rows = [(i, t, "") for i, t in enumerate(base)]
    for i in range(30):
        words = base[i % 6].split(" ")
        for _ in range(i // 6):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((100 + i, " ".join(words), ""))
    rows += ODD
    shingles = {}
    for i, (_, t, _) in enumerate(rows):
        w = (t or "").lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    want = sorted((str(d), str(min([x for x in m if x is not None], default=None)), len(m)) for m in members.values() for d in m)
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in minhash.near_duplicates(df).collect())
    assert got == want
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(members)


def test_prefilter_keeps_pairs_at_the_threshold(spark):
    n, least = minhash.REGISTERS, math.ceil(minhash.PREFILTER * minhash.REGISTERS)
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least)) < 1e-6
    signed = spark.createDataFrame([(1, bytes(n)), (2, bytes(82) + b"\1" * (n - 82))], "rid long, sig binary")
    assert minhash._agreeing(spark.createDataFrame([(1, 2)], "first long, rid long"), signed).count() == 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(df).count() == 0
    assert substrings.report(df).count() == 0
    assert quality.quality(df).count() == 0
    assert packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# ---- passages ---------------------------------------------------------------------------------


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(4)
    shingles = rng.integers(0, 2**63, 400).astype(np.uint64)
    counts = np.array([150, 30, 220])
    _, centre, left, right, _, _, row = substrings.compact_windows(shingles, counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    values = copies.mix(shingles[None, :] ^ substrings._SEEDS[: substrings.HASHES, None])
    t = substrings.MIN_SHINGLES
    want = {(h, s, s + int(np.argmin(values[h, s : s + t]))) for h in range(substrings.HASHES) for a, b in zip(begin, begin[1:]) for s in range(a, b - t + 1)}
    got = [(int(h), s, int(c)) for h, c, a, b in zip(row, centre, left, right) for s in range(c - a, c + b - t + 2)]
    assert len(got) == len(set(got)) and set(got) == want


def test_passages_are_found_and_cut(spark):
    rng = random.Random(5)
    shared = prose(rng, 60)
    rows = [(i, f"{prose(rng, 40)} {shared} {prose(rng, 30)}", "") for i in range(12)] + [(50 + i, prose(rng, 90), "") for i in range(8)]
    rows += [(d and d + 1000, t, x) for d, t, x in ODD]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = substrings.report(df).collect()
    # in a large group, windows whose context reaches out of the passage may lead to another earlier text
    assert {r.doc_id for r in got} == set(range(1, 12)) and all(r.first_doc_id < r.doc_id for r in got)
    assert all(r.start_word == 40 and r.n_words == 60 and r.first_start_word == 40 for r in got)
    cleaned = {r.doc_id: r.text for r in substrings.remove_repeated(df).where("doc_id is not null").collect()}
    assert shared in cleaned[0] and all(len(cleaned[i].split()) == 70 for i in range(1, 12))
    assert all(cleaned[50 + i] == rows[12 + i][1] for i in range(8))


def uncovered(rows, got):
    """Places of 50 words that an earlier row has too and that the report does not cover."""
    seen, lost = set(), []
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start_word, r.start_word + r.n_words))
    for d, t, _ in rows:
        w = t.lower().split()
        mine = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        for k, passage in enumerate(mine):
            if passage in seen:
                lost += [(d, k)] if not any(a <= k and k + 50 <= b for a, b in spans.get(d, [])) else []
        seen.update(mine)
    return lost


@pytest.mark.parametrize("phrase", [5, 30, 42])
def test_passages_around_a_frequent_phrase(spark, phrase):
    # The phrase is in all texts; its first text, and most others, lack the passages that pairs of texts share.
    rng = random.Random(11)
    line = prose(rng, phrase)
    rows = [(i, f"{prose(rng, 40)} {line} {prose(rng, 40)}", "") for i in range(40)]
    for i in range(40):
        before, after = prose(rng, (60 - phrase) // 2), prose(rng, (60 - phrase) // 2)
        rows += [(100 + 2 * i + k, f"{prose(rng, 30)} {before} {line} {after} {prose(rng, 30)}", "") for k in (0, 1)]
    got = substrings.report(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    assert uncovered(rows, got) == [] and {r.doc_id for r in got} == set(range(101, 180, 2))


def test_changed_passages_of_frequent_shingles(spark):
    # Every word of a pair's passage is in 40 texts, in pieces of 11 words, so all its shingles but those over seams are
    # frequent; the second text of a pair has changed words, so no long run is equal and the first text has no passage.
    rng = random.Random(21)
    lines = [prose(rng, 16) for _ in range(4)]
    rows = [(i, f"{prose(rng, 40)} {' '.join(lines)} {prose(rng, 12)}", "") for i in range(40)]
    for i in range(12):
        changed = [prose(rng, 16) for _ in range(2)]
        body = " ".join([*lines[:2], changed[0], lines[2], changed[1], lines[3]]).split()
        other = body.copy()
        other[36] = other[74] = "xx"
        rows += [(100 + 2 * i + k, f"{prose(rng, 30)} {' '.join(words)} {prose(rng, 30)}", "") for k, words in enumerate((body, other))]
    got = substrings.report(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    for i in range(12):
        longest = max(r.n_words for r in got if r.doc_id == 101 + 2 * i and r.first_doc_id == 100 + 2 * i)
        assert longest >= 75


def test_pairs_left_over_in_large_groups(spark):
    # 60 texts under one key; texts 1 to 20 share a passage with text 0. Text 30 has text 0's shingles in another order,
    # 40 and 41 share shingles that text 0 lacks, 5 and 6 some behind their passage, others only those of text 0's change.
    rng = random.Random(22)
    common = prose(rng, 60).split()
    tails = {i: prose(rng, 20).split() for i in range(60)}
    tails[41][:6], tails[6][:6] = tails[40][:6], tails[5][:6]
    texts = {i: [*common[:20], *tails[i]] if i > 20 else [*common, *tails[i]] for i in range(60)}
    texts[30] = [*common[:20], *common[40:], *common[20:40], *tails[30]]
    for i in range(1, 21):
        texts[i][30] = "yy"
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "rid long, text string")
    groups = spark.createDataFrame([(9, 0, 60, i, *((40, 52) if i in (5, 6) else (4, 12))) for i in range(60)], "key long, first long, n long, rid long, start long, stop long")
    passages = spark.createDataFrame([(i, 0, 60, 0) for i in range(1, 21)], "rid long, start long, n_words long, first long")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 60)], "first long, rid long")
    got = {tuple(r) for r in substrings.remaining_pairs(frame, groups, passages, pairs).collect()}
    assert got == {(min(30, i), max(30, i)) for i in range(1, 60) if i != 30} | {(5, 6), (40, 41)}


def test_passages_after_a_repeated_opening():
    rng = np.random.default_rng(12)
    new = lambda n: rng.integers(0, 2**40, n).astype(np.uint64)

    def shingles(*parts):
        w = np.concatenate(parts)
        return sum(copies.mix(w[k : len(w) - 4 + k]) * copies._FACTORS[k] for k in range(5))

    line, rest = new(20), new(40)
    head = shingles(line, new(30), line, rest)
    assert substrings.shared_passages(shingles(line, rest), head) == [(0, 60, 50, 60)]
    assert substrings.shared_passages(shingles(new(7), line, rest, new(9)), head) == [(7, 60, 50, 60)]
    longer = new(90)
    assert substrings.shared_passages(shingles(line, longer), shingles(line, new(30), line, longer)) == [(0, 110, 50, 110)]
    # A chain that fails as a whole holds a passage with one changed word.
    a, b = new(120), new(3)
    other = np.concatenate([a[:30], b[:1], a[31:80], b[1:2], a[81:86], b[2:3], a[87:120]])
    (start, n, _, _), *_ = substrings.shared_passages(shingles(other), shingles(a))
    assert start == 0 and n >= 80


def test_passages_match_brute_force_with_repeats(monkeypatch):
    rng = random.Random(13)
    for hits in (substrings.HITS, 7):
        monkeypatch.setattr(substrings, "HITS", hits)
        for _ in range(60):
            lines = [[rng.randrange(2**40) for _ in range(rng.randint(6, 30))] for _ in range(6)]
            a, b = (np.array(sum((rng.choice(lines) for _ in range(8)), []), np.uint64) for _ in range(2))
            x, y = (copies.mix(sum(copies.mix(w[k : len(w) - 4 + k]) * copies._FACTORS[k] for k in range(5))) for w in (a, b))
            have = {tuple(y[k : k + 46]) for k in range(len(y) - 45)}
            found = substrings.shared_passages(x, y)
            for k in range(len(x) - 45):
                if tuple(x[k : k + 46]) in have:
                    assert any(s <= k and k + 50 <= s + n for s, n, _, _ in found)
            for s, n, t, m in found:
                same = len(set(x[s : s + n - 4].tolist()) & set(y[t : t + m - 4].tolist()))
                assert min(n, m) >= 50 and same >= 0.5 * len(set(x[s : s + n - 4].tolist()))


# ---- media, packing, BPE ----------------------------------------------------------------------


def test_media_round_trip_and_retry(spark, monkeypatch):
    path = f"{scratch_dir(spark)}/media-test"
    df = spark.createDataFrame(ODD, DOCS)
    media.write_archives(df, path)
    got = media.read_archives(spark, path, 300).collect()  # ranges far smaller than an archive
    want = sorted((str(d), media.padded(t)[0]) for d, t, _ in ODD)
    assert sorted((str(r.doc_id), media.from_png(r.media)) for r in got) == want
    failures = []

    class Source:
        def read_at(self, n, at):
            failures.append(at)
            raise OSError("lost")

    store, root = media._open(path)
    name, _ = json.loads(store.open_input_stream(f"{root}/{media.MANIFEST}").read())[0]
    import zipfile

    with store.open_input_file(f"{root}/{name}") as file, zipfile.ZipFile(file) as archive:
        member = archive.infolist()[0]
    assert media.ArchiveReader._member(store, f"{root}/{name}", Source(), member) and len(failures) == 1
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b" " * 192)[:-20] + b"\0" * 20)


def test_spread_is_near_equal():
    rng = random.Random(6)
    lengths = [rng.randint(20, 900) for _ in range(600)]
    windows = packing.pack_group(lengths, 4096)
    sums = [sum(lengths[i] for i in w) for w in windows]
    assert sorted(i for w in windows for i in w) == list(range(600))
    assert max(sums) <= 4096 and len(windows) <= -(-sum(lengths) // 4096) + 1 and max(sums) - min(sums) < 40


def test_packing_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(7)
    rows = ODD + [(10 + i, prose(rng, 700 * (i % 3) + 5), "") for i in range(12)]
    # Special marks inside, next to and apart from words, whole and in other letters.
    rows += [(30, "a<|endoftext|>b <|startoftext|> c.<|endoftext|><|endoftext|>\n<|ENDOFTEXT|> <|endof text|> <|endoftext|", "")]
    got = packing.pack(spark.createDataFrame(rows, DOCS), path).collect()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for d, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            piece = ids[s : s + 4096]
            want.append((str(d), s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)))
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    for _, pieces in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_bpe_matches_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    truth = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = ODD + [(20, "Hello   world's 12345 ünïcödé 日本語 \r\n\n x" * 3, "")]
    got = bpe.encode_texts(spark.createDataFrame(rows, DOCS), path, public_tokenizers.PATTERN).collect()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == truth.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    whole = bpe.PerfectHash(dict(itertools.islice(ranks.items(), 5000)))
    assert all(whole.get(k) == v for k, v in itertools.islice(ranks.items(), 5000)) and whole.get(b"no such token!") is None
    assert sorted(whole.keys) == sorted(itertools.islice(ranks, 5000))


# ---- language model, URLs, quality, toxicity, chat ---------------------------------------


def test_forward_and_expected_counts_match_enumeration():
    rng = np.random.default_rng(8)
    model = hmm.HmmModel(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2))
    texts = [[0, 1, 4], [4], [2, 2, 3, 1, 4]]
    values, offsets = np.concatenate([np.array(t) for t in texts]), np.array([0, 3, 4, 9])
    total, moves, logs = np.zeros((2, 5)), np.zeros((2, 2)), []
    for t in texts:
        paths = {}
        for path in itertools.product(range(2), repeat=len(t)):
            p = model.pi[path[0]] * model.emit[path[0], t[0]]
            for k in range(1, len(t)):
                p *= model.move[path[k - 1], path[k]] * model.emit[path[k], t[k]]
            paths[path] = p
        z = sum(paths.values())
        logs.append(np.log(z))
        for path, p in paths.items():
            for k, s in enumerate(path):
                total[s, t[k]] += p / z
                if k:
                    moves[path[k - 1], s] += p / z
    assert np.allclose(model.log_likelihood(values, offsets), logs)
    _, got_moves, got, likelihood = model.expected(values, offsets)
    assert np.allclose(got, total) and np.allclose(got_moves, moves) and likelihood == pytest.approx(sum(logs))


def test_training_goes_on_until_the_likelihood_settles(spark, monkeypatch):
    monkeypatch.setattr(hmm, "EMISSION_PRIOR", 1.0)
    rng = np.random.default_rng(14)
    truth = hmm.HmmModel(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.3, 0.4]]))
    texts = []
    for _ in range(200):
        state, text = rng.integers(2), []
        for _ in range(30):
            text.append(int(rng.choice(4, p=truth.emit[state])))
            state = rng.choice(2, p=truth.move[state])
        texts.append(text + [4])
    values, offsets = np.concatenate([np.array(t) for t in texts]), np.arange(0, 31 * 201, 31)
    usage = np.bincount(values, minlength=5) / len(values)
    df = spark.createDataFrame([(t,) for t in texts], "symbols array<int>")
    model = hmm.baum_welch(df, "symbols", usage, 2)
    first, moves, emits, now = model.expected(values, offsets)
    pi, emits = first + 1.0, emits + usage
    after = hmm.HmmModel(pi / pi.sum(), (moves + 1.0) / (moves + 1.0).sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    assert after.log_likelihood(values, offsets).sum() - now < 1e-4 * abs(now)
    assert hmm.STATES == 8


def test_language_model_rows_and_hot_words(spark):
    rows = [(i, "the cat sat on the mat and the dog ran" if i % 2 else "le chat et le chien", "") for i in range(40)] + ODD
    df = spark.createDataFrame(rows, DOCS).withColumn("learn", F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True)))
    a = sorted(hmm.score_language(df, "learn", symbols=64, states=2).collect(), key=str)
    b = sorted(hmm.score_language(df, "learn", symbols=64, states=2, hot=3).collect(), key=str)
    assert len(a) == len(rows)
    for x, y in zip(a, b):
        assert (x.doc_id, x.n_tokens, x.n_known) == (y.doc_id, y.n_tokens, y.n_known)
        assert x.score == pytest.approx(y.score) and x.base_score == pytest.approx(y.base_score) and np.isfinite(x.score)


def test_urls(spark):
    rows = [(i, f"https://site{i}.example.com/fr/{i}") for i in range(30)] + [(100 + i, f"http://spam{i}.example.net/es/{i}") for i in range(30)]
    rows += [(200, None), (201, "no scheme"), (202, "http://WWW.Example.com/en/a?b#c"), (203, "x://example.com/en/1"), (204, "x://com"), (205, "ftp://a://b/c")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    assert (got[0].rule, got[0].verdict, got[100].rule, got[100].verdict) == ("com/", "allow", "net/es/", "block")
    assert (got[202].host, got[202].path, got[202].rule) == ("www.example.com", "/en/a", "www.example.com/en/")
    assert (got[203].rule, got[203].verdict) == ("example.com/en/", "block")
    assert got[204].rule is None and (got[200].host, got[200].path) == ("", "") and (got[205].host, got[205].path) == ("a:", "//b/c")


def test_urls_learn_from_every_labelled_url(spark):
    """Scores and verdicts against the models of all labelled URLs, more than 5,000 of a class and a long one among them."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    allowed = sorted({f"https://{name()}{i}.com/{name()}" for i in range(5_200)}) + ["https://long.com/" + "abcd" * 600]
    blocked = sorted({f"http://{name()}.net/{rng.choice(('es', 'fr'))}/{name()}" for i in range(300)})
    judged = [f"https://{name()}.org/{name()}" for _ in range(40)] + ["", "no scheme", "abcd" * 30]
    rows = [(i, u) for i, u in enumerate([*allowed, *blocked, *judged, judged[0], None, allowed[0]])]
    got = {r.id: r for r in urls.judge_urls(spark.createDataFrame(rows, "id long, url string")).collect()}
    held = lambda u: zlib.crc32(u.encode()) % 5 == 0
    models = [urls.MarkovModel([u for u in us if not held(u)]) for us in (allowed, blocked)]

    def score(u):
        full = urls.START * urls.ORDER + u + urls.STOP
        places = range(urls.ORDER, len(full))
        yes, no = (sum(m.logp(full[i - urls.ORDER : i], full[i]) for i in places) for m in models)
        return (yes - no) / (len(u) + 1)

    tests = [[score(u) for u in us if held(u)] for us in (allowed, blocked)]
    every = sorted({*tests[0], *tests[1]})
    value = {s: sum(x >= s for x in tests[0]) / len(tests[0]) + sum(x < s for x in tests[1]) / len(tests[1]) for s in every}
    top = max(value.values())
    best = next(i for i, s in enumerate(every) if value[s] > top - 1e-12)
    threshold = every[best] - 0.5 if not best else (every[best] + every[best - 1]) / 2
    assert len(got) == len(rows)
    for i, u in rows:
        if allowed[0] == u or u in blocked or u in allowed:
            assert got[i].url_score is None and got[i].verdict == ("block" if u in blocked else "allow")
        else:
            want = score(u or "")
            assert got[i].url_score == pytest.approx(want, abs=1e-9) and got[i].verdict == ("allow" if want > threshold else "block")


@pytest.mark.parametrize("labelled", [[], ["http://a.com/b"], ["http://b.net/es/c"]])
def test_urls_without_both_classes_are_allowed(spark, labelled):
    rows = [(i, u, "x") for i, u in enumerate([*labelled, "http://c.org/d", None])]
    got = {r.id: r for r in urls.judge_urls(spark.createDataFrame(rows, "id long, url string, verdict string")).collect()}
    assert len(got) == len(rows) and all(got[i].verdict == "allow" and got[i].url_score is not None for i in range(len(labelled), len(rows)))


def test_markov_model_is_a_distribution():
    model = urls.MarkovModel(["abab", "abc"], order=2, alphabet=4)
    for context in ("ab", "zz", "ba"):
        assert sum(np.exp(model.logp(context, c)) for c in "abc" + urls.STOP) == pytest.approx(1.0)


def test_quality(spark):
    rng = random.Random(9)
    good = "\n".join(prose(rng, 20).capitalize() for _ in range(6))
    rows = ODD + [(10, good, ""), (11, good + "\nHome | About | Contact", ""), (12, "Home | About\n" * 40 + good[:200], ""), (13, "same words here. " * 40, "")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).where("doc_id is not null").collect()}
    assert got[10].kept and got[10].clean_text == good and got[11].kept and got[11].clean_text == good
    assert not got[12].kept and got[13].base_failed and got[13].n_repeat_words == 120 and not got[2].kept


def test_quality_keeps_columns_with_clashing_names(spark):
    rows = [(1, "words here. " * 60, "w", "full", "ok", "n"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _w string, _full string, _ok string, N_Words string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert (got[1]._w, got[1]._full, got[1]._ok, got[1].N_Words if "N_Words" in got[1] else got[1].n_words) == ("w", "full", "ok", 120)
    assert quality.quality(df.limit(0)).count() == 0
    assert quality.quality(df, prefix="_q_").columns[:6] == df.columns


def test_toxicity(spark):
    rng = random.Random(10)
    bad = ["vile", "scumlike", "horridness"]
    train = [(prose(rng, 40) + (f" {rng.choice(bad)} {rng.choice(bad)}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(480)]
    model = toxicity.train_toxicity(spark.createDataFrame(train, "text string, toxic int"))
    fresh = [(i, prose(rng, 40) + (f" {rng.choice(bad)}" if i < 20 else ""), "") for i in range(40)] + ODD
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(fresh, DOCS), model).collect()}
    assert sum(got[i] >= 0.7 for i in range(20, 40)) == 0 and sum(got[i] > max(got[j] for j in range(20, 40)) for i in range(20) if i > 5) >= 12
    assert all(0.0 <= s <= 1.0 for s in got.values())
    none = toxicity.train_toxicity(spark.createDataFrame([], "text string, toxic int"))
    assert none.scores(["", "x", None]).tolist() == [0.0, 0.0, 0.0]
    empty = spark.createDataFrame([], DOCS + ", Score string")
    assert toxicity.score_toxicity(empty, model).columns == ["doc_id", "text", "extra", "score"]


def test_toxicity_distances_equal_plain_compression(spark):
    """Distances are differences of the lengths that zstandard gives for whole windows of several words, nothing else."""
    import zstandard

    rng = random.Random(11)
    train = [(prose(rng, 60) + (" horridness vilest" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.train_toxicity(spark.createDataFrame(train, "text string, toxic int"))
    assert len(model.toxic) == len(model.ordinary) and b"horridness" in model.toxic and b"horridness" not in model.ordinary
    texts = [prose(rng, 100) + " Horridness.\nIt is", None, "", "one", "x" * 100_000, "word " * 20_000]
    for t in texts:
        words = (t or "").lower().split()
        want = []
        for k in range(0, max(len(words), 1), 8):
            data = b" " + " ".join(words[k : k + 8]).encode() + b" " + b"\n" * 8
            fresh = [toxicity.CompressionModel.compressor(d) for d in (model.ordinary, model.toxic)]
            sizes = [len(c.compress(data)) for c in fresh]
            for c, n, d in zip(fresh, sizes, (model.ordinary, model.toxic)):
                again = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                assert n == len(c.compress(data)) and again.decompress(c.compress(data), max_output_size=len(data)) == data
            want.append(sizes[0] - sizes[1])
            if len(want) == 40:
                break
        assert model.distances(t)[:40].tolist() == want and len(model.distances(t)) == max(1, -(-len(words) // 8))


def test_toxicity_query_learns_nothing_from_held_out_labels(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, prose(rng, 30) + (" horridness" if i % 3 == 0 else "")) for i in range(300)] + [(None, None), (5, "copy"), (5, "copy")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    results = []
    for flip in (0, 1):
        labels = [(i, 1, int(i % 3 == 0) ^ (flip if i in held else 0)) for i in range(300)]
        path = f"{tmp_path}/{flip}"
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        results.append(sorted((tuple(r) for r in queries.op7_toxicity(spark, path).select("doc_id", "held_out", "score", "predicted").collect()), key=repr))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    for doc_id, out, score, predicted in results[0]:
        assert out == (zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1) and predicted == int(score >= 0.7)
    caught = [p for i, out, _, p in results[0] if out and i is not None and i % 3 == 0]
    assert sum(caught) > 0.9 * len(caught)


def test_toxicity_scores_do_not_follow_the_sample_size(spark):
    rng = random.Random(15)
    bad = ["vile", "scumlike", "horridness"]
    # One marker word is in all toxic texts and in some others, so the share of toxic texts matters.
    train = [(f"{prose(rng, 30)} {rng.choice(bad) if i % 9 == 0 or i % 13 == 0 else ''}", int(i % 9 == 0)) for i in range(7200)]
    df = spark.createDataFrame(train, "text string, toxic int").coalesce(1)
    fresh = [f"{prose(rng, 30)} {w}" for w in bad] * 10 + [prose(rng, 30) for _ in range(30)]
    whole = toxicity.train_toxicity(df, per_class=10_000).scores(fresh)
    capped = toxicity.train_toxicity(df, per_class=400).scores(fresh)
    assert 0.3 < whole[:30].mean() < 0.8 and abs(capped[:30].mean() - whole[:30].mean()) < 0.1
    assert abs(capped[30:].mean() - whole[30:].mean()) < 0.02


def test_toxic_words_with_many_endings_are_segments(spark):
    # No single word is frequent, their common beginning is; near copies of one text are no evidence.
    rng = random.Random(16)
    copied = prose(rng, 30)
    train = [(f"{prose(rng, 30)} {'horri' + prose(rng, 1)[:4] if i % 8 == 0 else ''}", int(i % 8 == 0)) for i in range(1600)]
    train += [(f"{copied} {prose(rng, 1)}", 1) for _ in range(12)]
    model = toxicity.train_toxicity(spark.createDataFrame(train, "text string, toxic int"))
    assert b" horri " in model.toxic and copied.split()[7].encode()[:5] not in model.toxic[len(model.toxic) - 40 :]


def test_chat_round_trip(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control + "<\\|<"), (1, 2, "we\nird\\n<|", "\n"), (2, 0, None, None), (3, 0, "a\x00\x01b\\", "\x00\x01"), (3, 1, "\\n\\\\n\n\\", ""), (3, 2, "\\\n<\\|", ""), (None, 1, "assistant", "é\u00a0x"), (None, 1, "assistant", "é\u00a0x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    for key in (1, 2, 3, None):
        mine = [(r or "", t or "") for c, _, r, t in rows if c == key]
        assert [(t.role, t.text) for t in got[key].turns] == mine
        assert "".join(got[key].loss_text) == "".join(t for r, t in mine if r == "assistant")
    mixed = spark.sql(
        f"select 1L conv_id, 0L turn, 'user' role, from_json('[{{\"kind\":\"text\",\"text\":\"see \"}},{{\"kind\":\"image\",\"ref\":\"a.png\",\"tokens\":64}},{{\"kind\":\"audio\",\"ref\":\"b\"}}]', 'array<{chat.PART}>') parts"
    )
    one = chat.format_chats(mixed).first()
    assert "see <|image:1|><|audio:2|>" in one.formatted and [a.ref for a in one.attachments] == ["a.png", "b"] and one.expanded_tokens == 65
