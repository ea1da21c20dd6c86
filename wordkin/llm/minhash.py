"""Near duplicates by ProbMinHash, banding and exact verification.

A text is the weighted set of its five-word shingles, weights being their counts. Every shingle is a
Poisson process whose rate is its weight: each arrival picks one of REGISTERS registers and leaves its
time and its shingle there if it is the earliest so far. A shingle's process ends as soon as its next
arrival is later than every register. Two texts agree in a register with probability equal to their
probability Jaccard similarity.

Bands of ROWS registers make candidates; texts that agree in PREFILTER of all registers are compared
exactly. Inside a bucket every text is first compared with one text only, the one with the most and
largest buckets (copies resemble what they were copied from more than each other); what is then one
component needs no further pair. In buckets that still hold several components, all pairs
between components are compared by signature, block by block inside tasks, and those that agree exactly,
again block by block: a task gets the texts of two blocks once and the pairs between them as lists.
Nothing is capped: a bucket of any size is dealt with in full.

Defined results: texts with equal words (in lower case) are one class, texts without words too; null
texts count as empty; a text of fewer than five words is one shingle; ties cannot occur between distinct
shingles, and equal rows are copies; class_id is the smallest non-null doc_id of the class (null if it
has none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wordkin.llm.copies import Shingler, compare_with_first, components, distinct_texts, mix, probability_jaccard
from wordkin.session import cut, passing_cuts

ROWS = 5
BANDS = 25
REGISTERS = ROWS * BANDS
SIMILAR = 0.8
PREFILTER = 0.6
BLOCK = 512
#: Pairs between components that one task compares exactly, on average.
CELL_PAIRS = 4096
SALTS = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n by registers, unsigned 64-bit shingles) of n weighted sets, all in step.

    hashes, weights and owner describe the elements; the arrivals of an element depend on its hash only.
    """
    best = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    h, rate, own, time = hashes, weights.astype(float), owner.astype(np.int64), np.zeros(len(hashes))
    arrival = 0
    while len(h):
        arrival += 1
        draw = mix(h + np.uint64(int(_GOLD) * 2 * arrival % 2**64))
        time = time - np.log((draw >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54) / rate
        register = own * registers + (mix(draw ^ _GOLD) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, register, time)
        won = best[register] == time
        held[register[won]] = h[won]
        # Early termination: an element goes on only while it can still be first somewhere.
        alive = time < best.reshape(n, registers).max(1)[own]
        h, rate, own, time = h[alive], rate[alive], own[alive], time[alive]
    return held.reshape(n, registers)


def signatures(texts: DataFrame) -> DataFrame:
    """texts(rid, text) -> rid, bands array<long>, sig binary (the lowest byte of every register).

    A text without words has no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every, counts = shingler.batch(part.column(1).to_pylist())
                sets = [np.unique(s, return_counts=True) for s in np.split(every, np.cumsum(counts)[:-1])]
                sizes = np.array([len(s) for s, _ in sets])
                owner = np.repeat(np.arange(len(sets)), sizes)
                found = prob_minhash(np.concatenate([s for s, _ in sets]), np.concatenate([c for _, c in sets]), owner, len(sets))
                bands = []
                for i, signature in enumerate(found):
                    bands.append([xxhash.xxh3_64_intdigest(signature[b : b + ROWS].tobytes(), b) - (1 << 63) for b in range(0, REGISTERS, ROWS)] if sizes[i] else [])
                low = (found & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(bands, pa.list_(pa.int64())), pa.array([x.tobytes() for x in low], pa.binary())],
                    names=["rid", "bands", "sig"],
                )

    return texts.select("rid", "text").mapInArrow(run, "rid long, bands array<long>, sig binary")


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Of pairs(first, rid), those whose signatures agree enough."""
    sig = signed.select("rid", "sig")
    both = pairs.join(sig.withColumnRenamed("sig", "a"), "rid").join(sig.select(F.col("rid").alias("first"), F.col("sig").alias("b")), "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (2, 3))
                keep = pa.array((x == y).mean(1) >= PREFILTER)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["first", "rid"])

    return both.select("first", "rid", "a", "b").mapInArrow(run, "first long, rid long")


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """links(first, rid) among pairs(first, rid) whose exact similarity reaches the threshold."""

    def judge(head: str, head_rid: int, members: list[tuple[int, str]]) -> Iterator[tuple]:
        shingler = Shingler()
        a, wa = np.unique(shingler.shingles(head), return_counts=True)
        for rid, text in members:
            b, wb = np.unique(shingler.shingles(text), return_counts=True)
            if probability_jaccard(a, wa, b, wb) >= similar - 1e-9:
                yield head_rid, rid

    schema = pa.schema([("first", pa.int64()), ("rid", pa.int64())])
    return cut(compare_with_first(cut(pairs), texts, judge, schema, "first long, rid long"))


def near_links(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Verified links(first, rid) that connect all near duplicates among distinct texts(rid, text)."""
    signed = cut(signatures(texts))
    keyed = signed.select(F.explode("bands").alias("key"), "rid")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("value")).where("value > 1")
    weight = _spread(sizes, keyed).groupBy("rid").agg(F.sum("value").alias("weight"))
    weighed = signed.join(weight, "rid").select(F.explode("bands").alias("key"), "rid", "weight")
    top = F.max(F.struct("weight", (-F.col("rid")).alias("minus")))
    heads = weighed.groupBy("key").agg((-top["minus"]).alias("value"), F.count("*").alias("n")).where("n > 1")
    stars = cut(_spread(heads, keyed).where("value <> rid").select(F.col("value").alias("first"), "rid").distinct())
    links = verified(_agreeing(stars, signed), texts, similar)
    # Buckets that still hold several components: their members, once a text, then what is across them.
    roots = components(links, "first", "rid").withColumnRenamed("node", "rid")
    labelled = cut(signed.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    rooted = labelled.select(F.explode("bands").alias("key"), "rid", "root")
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("value")).where("lo <> hi and value > 2")
    apart = _spread(apart, rooted).groupBy("rid").agg(F.collect_list(F.struct("key", F.col("value").alias("n"))).alias("open"))
    members = labelled.join(apart, "rid").select("rid", "root", "sig", "bands", F.explode("open").alias("o"))
    across = cut(_across(members.select("rid", "root", "sig", "bands", "o.key", "o.n")))
    return links.unionAll(_verified_blocks(across, texts, similar))


def _spread(values: DataFrame, keyed: DataFrame) -> DataFrame:
    """(key, value, rid): give every row of keyed(key, rid) the value of its key, if values(key, value) has one.

    A key may be that of very many rows: its value is copied to SALTS places, its rows are dealt to them
    and read in order, so that no task gets all rows of a key.
    """
    given = values.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("value").alias("x"))
    asked = keyed.select("key", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("rid").alias("x"))
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = given.unionAll(asked).repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (np.zeros(1, np.int64), np.full(1, -1, np.int64), np.zeros(1, np.int64))
        for batch in batches:
            key, salt, kind, x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # The last value seen, carried over from the batch before, counts if it is of the same place.
            at = np.maximum.accumulate(np.where(kind == 0, np.arange(1, len(key) + 1), 0))
            keys, salts, values = (np.concatenate([a, b]) for a, b in zip(last, (key, salt, x)))
            found = (kind == 1) & (keys[at] == key) & (salts[at] == salt)
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[found]), pa.array(values[at][found]), pa.array(x[found])], names=["key", "value", "rid"])
            if len(at):
                last = (keys[at[-1] : at[-1] + 1], salts[at[-1] : at[-1] + 1], values[at[-1] : at[-1] + 1])

    return ordered.mapInArrow(run, "key long, value long, rid long")


def _across(members: DataFrame) -> DataFrame:
    """lists(first, rids) of members of one bucket but different components whose signatures agree.

    A bucket is divided into blocks; each pair of blocks is compared in one task, which emits only the
    pairs that agree, so neither a bucket nor its pairs are ever gathered. A pair that shares several
    buckets is emitted in the first of them. (If that one holds nothing else, the pair has been tried.)
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("rid", F.lit(1)), blocks)
    dealt = members.withColumn("x", own).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = dealt.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "rid", "root", "sig", "bands")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cells.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(key: int, cell: list[tuple]) -> Iterator[tuple[int, list[int]]]:
        x, rid, root, sig, bands = zip(*cell)
        x, rid, root, bands = np.array(x), np.array(rid), np.array(root), np.array(bands)
        low = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, REGISTERS)
        diagonal = len(set(x.tolist())) == 1
        for at in range(len(cell)):
            partner = (root != root[at]) & (rid > rid[at]) & (diagonal | (x != x[at]))
            some = np.flatnonzero(partner)
            some = some[(low[some] == low[at]).mean(1) >= PREFILTER]
            if len(some):
                shared = (bands[some] == bands[at]).argmax(1)
                some = some[bands[at][shared] == key]
            if len(some):
                yield int(rid[at]), rid[some].tolist()

    def lists(found: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in found], pa.int64()), pa.array([r for _, r in found], pa.list_(pa.int64()))], names=["first", "rids"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now = [], None
        for batch in batches:
            key, i, j, *rest = (c.to_pylist() for c in batch.columns)
            for at, row in zip(zip(key, i, j), zip(*rest)):
                if at != now and cell:
                    yield lists([*compare(now[0], cell)])
                    cell = []
                now = at
                cell.append(row)
        if cell:
            yield lists([*compare(now[0], cell)])

    return ordered.mapInArrow(run, "first long, rids array<long>")


def _verified_blocks(across: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """links(first, rid) among lists(first, rids) whose exact similarity reaches the threshold.

    Texts are dealt into blocks by number; a cell is a pair of blocks. It gets each text that it
    compares once, however many pairs the text is in, and the pairs as lists. There are enough cells
    for CELL_PAIRS pairs in each.
    """
    pairs = across.agg(F.sum(F.size("rids"))).first()[0] or 0
    blocks = max(1, int(np.ceil(np.sqrt(pairs / CELL_PAIRS))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            rid = batch.column(1).flatten().to_numpy()
            block = [(mix(v.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64) for v in (first, rid)]
            cell = block[0] * blocks + block[1]
            used = np.unique(np.concatenate([np.stack([cell, first]), np.stack([cell, rid])], axis=1), axis=1)
            order = np.lexsort((first, cell))
            cell, first, rid = cell[order], first[order], rid[order]
            starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (first[1:] != first[:-1])]))
            partners = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rid)), pa.int32()), pa.array(rid))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([used[0], cell[starts]])),
                    pa.array(np.concatenate([used[1], first[starts]])),
                    pa.concat_arrays([pa.nulls(used.shape[1], partners.type), partners]),
                ],
                names=["cell", "rid", "partners"],
            )

    dealt = cut(across.mapInArrow(deal, "cell long, rid long, partners array<long>"))
    needed = dealt.where("partners is null").select("cell", "rid").distinct()
    given = needed.join(texts, "rid").select("cell", F.lit(0).alias("kind"), "rid", "text", F.lit(None).cast("array<long>").alias("partners"))
    asked = dealt.where("partners is not null").select("cell", F.lit(1).alias("kind"), "rid", F.lit(None).cast("string").alias("text"), "partners")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = given.unionAll(asked).repartition(parts, "cell").sortWithinPartitions("cell", "kind", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets, now = Shingler(), {}, None
        for batch in batches:
            found = []
            for cell, kind, rid, text, partners in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != now:
                    sets, now = {}, cell
                if kind == 0:
                    sets[rid] = np.unique(shingler.shingles(text), return_counts=True)
                else:
                    found += [(rid, p) for p in partners if probability_jaccard(*sets[rid], *sets[p]) >= similar - 1e-9]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["first", "rid"])

    return cut(ordered.mapInArrow(run, "first long, rid long"))


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows as distinct_texts() gives them, classes(rid, root) of every row.

    root is the smallest row number of the row's class.
    """
    rows, texts, copies = distinct_texts(df, doc_id, text)
    first = rows.select("rid").join(copies, "rid", "left").select("rid", F.coalesce("of", "rid").alias("of"))
    with passing_cuts(df.sparkSession) as stay:
        roots = components(near_links(texts, similar), "first", "rid")
        classes = first.join(roots.withColumnRenamed("node", "of"), "of", "left").select("rid", F.coalesce("root", "of").alias("root"))
        return rows, stay(cut(classes))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, class_size) of every row."""
    rows, classes = near_classes(df, doc_id, text, similar)
    named = cut(classes.join(rows.select("rid", "doc_id"), "rid"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return named.join(ids, "root").select("doc_id", "class_id", "class_size")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of df without near duplicates: the first row of each class stays, with all its columns."""
    rows, classes = near_classes(df, doc_id, text, similar)
    kept = rows.join(classes.where("rid = root").select("rid"), "rid", "left_semi")
    return kept.select(*(F.col("text") if c == text else F.col(f"row.`{c}`") for c in df.columns))
