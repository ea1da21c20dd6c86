"""Every stage of the pipeline, and all of them, against plain versions on a small corpus with odd rows."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordkin.llm import queries, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _w string, score double"
LETTERS = "abcdefghijklmnoprstuv"


def sentence(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 8))) for _ in range(n)).capitalize() + "."


def clean(rng, lines=6):
    return "\n".join(sentence(rng, rng.randint(15, 25)) for _ in range(lines))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = {k: clean(rng) for k in range(80)}
    toxic = {100 + k: clean(rng, 3) + "\n" + " ".join(sentence(rng, 4)[:-1] + " horridness vilest" for _ in range(4)) + "." for k in range(60)}
    junk = {200: "Home | About | Contact\n" * 40, 201: "short text.", 202: "same words here again. " * 40, 203: "", 204: " \n\t "}
    passage = " ".join(sentence(rng, 70).split())
    shared = {300 + k: clean(rng, 4) + "\n" + passage + "\n" + clean(rng, 3) for k in range(5)}
    near = {}
    for k in range(4):
        words = texts[k].split(" ")
        words[3 + k] = "changed"
        near[400 + k] = " ".join(words)
    exact = {500: texts[10], 501: texts[10], 502: texts[11]}
    lines = {600: clean(rng) + "\nRead more | click here\n" + clean(rng, 2)}
    every = texts | toxic | junk | shared | near | exact | lines
    rows = [(k, t, "en", "s", len(t), "kept", 0.5) for k, t in every.items()] + [(700, None, None, None, None, None, None), (None, texts[12], "", "", 0, "", 1.0), (9, texts[13], "", "", 0, "", 1.0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k in toxic)) for k in every if k < 200] + [(None, 1, 1), (999, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, spark.read.parquet(f"{folder}/documents.parquet"), toxic


def stage(spark, corpus, name, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, corpus[0])
    if name != "packing":
        assert out.columns == docs.columns
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_toxicity_stage(spark, corpus):
    folder, docs, toxic = corpus
    model = queries.toxicity_model(spark, folder)
    given = docs.collect()
    want = sorted((tuple(r) for r, s in zip(given, model.scores([r.text for r in given])) if s < 0.7), key=repr)
    assert rows_of(stage(spark, corpus, "toxicity", docs)) == want
    kept = {r[0] for r in want}
    assert len(kept & toxic.keys()) <= 0.1 * len(toxic)
    assert set(range(80)) - kept == set()
    assert 700 in kept


def plain_quality(text):
    """(kept, cleaned text) by the rules, line by line."""
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]

    def fails(line):
        w = split(line)
        if not w:
            return False
        symbols = sum(line.count(c) for c in quality.SYMBOLS)
        closes = re.search(quality.CLOSING, re.sub(quality.SPACE, " ", line).rstrip(" "))
        return (
            not closes or re.search(quality.BOILERPLATE, line.lower()) or symbols > 0.2 * len(w)
            or sum(x.endswith("!!") for x in w) > 0.3 * len(w) or (len(w) >= 10 and len(set(w)) < 0.25 * len(w))
        )

    words = split(text)
    covered = set()
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, t in enumerate(triples):
        if triples.count(t) > 1:
            covered |= {i, i + 1, i + 2}
    cleaned = "\n".join(x for x in text.split("\n") if not fails(x))
    ink = lambda t: len(re.sub(quality.SPACE, "", t))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return not failed and ink(text) - ink(cleaned) <= 0.3 * ink(text), cleaned


def test_quality_stage(spark, corpus):
    docs = corpus[1]
    want = []
    for r in docs.collect():
        kept, text = plain_quality(r.text or "")
        if kept:
            want.append((r.doc_id, text, r.lang, r.source, len(text), r._w, r.score))
    assert rows_of(stage(spark, corpus, "quality", docs)) == sorted(want, key=repr)
    assert any(r[0] == 600 and "click here" not in r[1] for r in want) and not {200, 201, 202, 203, 204, 700} & {r[0] for r in want}


def test_near_duplicate_stage(spark, corpus):
    docs = corpus[1]
    given = docs.collect()
    shingles = []
    for r in given:
        w = (r.text or "").lower().split()
        shingles.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()})
    group = list(range(len(given)))
    for a, b in itertools.combinations(range(len(given)), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    out = [(*r[:1], r[1] or "", *r[2:]) for r in rows_of(stage(spark, corpus, "near_dedup", docs))]
    classes = {}
    for r, g in zip(given, group):
        classes.setdefault(g, []).append((r.doc_id, r.text or "", *r[2:]))
    assert len(out) == len(classes)
    for members in classes.values():
        assert sum(m in out for m in set(members)) == 1
    assert len(classes) < len(given) - 8


def test_substring_stage(spark, corpus):
    docs = corpus[1].where("doc_id < 400 or doc_id >= 600").where("doc_id not in (9, 10, 11)")
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in stage(spark, corpus, "substring_dedup", docs).collect()}
    assert before.keys() == after.keys()
    seen = set()
    for k, r in after.items():
        w = (r.text or "").split()
        mine = {tuple(w[i : i + 51]) for i in range(len(w) - 50)}
        assert not mine & seen
        seen |= mine
        assert r.n_chars == (None if r.text is None else len(r.text)) or r.text == before[k].text
    changed = {k for k in before if (before[k].text or "") != (after[k].text or "")} - {202}
    assert changed < set(range(300, 305)) and len(changed) == 4
    for k in changed:
        rest = after[k].text.split()
        # What is left was there, in order; only words of the passage are gone.
        old = iter(before[k].text.split())
        assert all(w in old for w in rest) and 60 <= len(before[k].text.split()) - len(rest) <= 80


def test_packing_stage(spark, corpus):
    from tokenizers import Tokenizer

    docs = corpus[1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want += [(str(r.doc_id), s, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for s in range(0, len(ids), 4096)]
    got = stage(spark, corpus, "packing", docs).collect()
    assert sorted((str(r.doc_id), r.start, r.ids_crc32) for r in got) == sorted(want)
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096 and len(used) <= 1 + -(-sum(used.values()) // 4096)


def test_whole_run(spark, corpus):
    """run() is the stages one after another; clean documents come through, planted ones do not."""
    folder, docs, toxic = corpus
    for name, _ in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, corpus, name, docs)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
    want = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in stage(spark, corpus, "packing", docs).collect())
    got = corpus_pipeline.run(spark, folder)
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in got.collect()) == want
    ids = {r[0] for r in want}
    assert {str(k) for k in range(14, 80)} <= ids and not ids & {"200", "201", "202", "203", "204"} and len(ids & {str(k) for k in toxic}) <= 6
    assert got.where(F.col("length") < 1).count() == 0


def test_empty_tables(spark, corpus, tmp_path):
    folder = corpus[0]
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
