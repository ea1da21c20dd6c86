"""Exact Lloyd clustering of integer vectors, sharded by dimension.

Vectors are cut into column blocks: one cell holds the components of one block for a run of rows. In a
round every cell computes exact partial squared distances to its slice of the centroids; the partial
distances of a run of rows are added over its blocks, and each row takes the smallest sum (ties: the
smaller centroid). The choices go back to the cells of the run, and every column block sums its own
components per cluster, which gives its slice of the next centroids as floor(sum / count). No task
holds whole vectors or whole centroids; what crosses the network in a round are the partial distances
and one label a row and block. Cells are written once, in buckets by run, so that they are not shuffled
again when labels meet them. Only centroid slices (clusters x width numbers a block) reach the driver.

Numbers are whole and results exact: cells use the narrowest machine integers that hold them, and
Python's unbounded integers where even 64 bits would not hold a sum.

Defined results: vectors that are null, of another size, or hold null, NaN or infinite components are
left out; rows with equal ids are separate vectors; a null id counts as the empty text for the seeds;
seeds with equal hashes are ordered by id and components; fewer vectors than clusters give as many
clusters as vectors, none give an empty table; an empty cluster keeps its centroid; columns beside the
id and the vector are not looked at. Distances beyond 64 bits are reported as the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from wordkin.session import cut, scratch_dir

#: Components of one column block, and rows of one cell.
WIDTH = 32
ROWS = 4_096
#: Rows of the table that one bucket of cells takes at most.
BUCKET_ROWS = 2_000_000
MAX_LONG = 2**63 - 1
#: Components up to this size keep every square sum of a block of up to 2 ** 16 components in 64 bits.
EXACT = 2**22
KINDS = {b"b": np.int8, b"h": np.int16, b"i": np.int32, b"q": np.int64}


def packed(x: np.ndarray) -> bytes:
    """Integers of any size as bytes: the narrowest machine type, or decimal text."""
    if x.dtype == object:
        return b"o" + ",".join(map(str, x.ravel())).encode()
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k, t in KINDS.items() if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return kind + x.astype(KINDS[kind]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The integers again, as 64-bit or unbounded ones."""
    kind = data[:1]
    if kind == b"o":
        return np.array([int(v) for v in data[1:].decode().split(",")], object)
    return np.frombuffer(data, KINDS[kind], offset=1).astype(np.int64)


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() <= EXACT:
        return scaled.astype(np.int64)
    # A power of two scales exactly unless it overflows; whole numbers do the rest.
    return np.array([v.__floor__() if np.isfinite(v) else int(x) * scale for x, v in zip(values.ravel().tolist(), scaled.ravel().tolist())], object).reshape(values.shape)


def _safe(*arrays: np.ndarray) -> list[np.ndarray]:
    """The same arrays, unbounded if one of them is."""
    return [a.astype(object) for a in arrays] if any(a.dtype == object for a in arrays) else list(arrays)


def kept_vectors(df: DataFrame, vector: str, size: int) -> DataFrame:
    finite = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where((F.size(vector) == size) & F.coalesce(finite, F.lit(False)))


def _cells(df: DataFrame, width: int, scale: int) -> DataFrame:
    """(run, block, ids, data): runs of rows of df(id, vector), cut into column blocks."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that is run again gives its runs the same numbers.
        run = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                whole = _whole(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1), scale)
                blocks = range(0, whole.shape[1], width)
                # The first block also carries the ids.
                ids = [part.column(0).to_pylist() if b == 0 else None for b in blocks]
                data = [packed(whole[:, b : b + width]) for b in blocks]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()), pa.array([part.num_rows] * len(data), pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                    names=["run", "block", "rows", "ids", "data"],
                )
                run += 1

    return df.mapInArrow(cut_up, "run long, block int, rows int, ids array<long>, data binary")


def seeds(df: DataFrame, ident: str, vector: str, k: int, salt: str, scale: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt and id, one row each."""
    text = F.concat(F.lit(salt), F.coalesce(F.col(ident).cast("string"), F.lit("")))
    drawn = df.select(F.sha2(text.cast("binary"), 256).alias("h"), F.col(ident).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    got = drawn.orderBy("h", "i", "v").limit(k).collect()
    return _whole(np.array([r["v"] for r in got], float), scale) if got else np.zeros((0, 0), np.int64)


def partial_distances(data: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroid slices, rows x clusters."""
    data, centres = _safe(data, centres)
    return np.stack([((data - c) ** 2).sum(axis=1) for c in centres], axis=1)


def add_blocks(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(label, distance) of the rows of a run from the partial distances of its blocks."""
    total = sum(_safe(*parts))
    best = total.argmin(axis=1) if total.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in total], np.int64)
    return best, total[np.arange(len(total)), best]


def cluster_sums(data: np.ndarray, labels: np.ndarray, k: int) -> list[list[int]]:
    """Exact sums of the rows of every cluster."""
    return [[int(v) for v in data[labels == c].sum(axis=0)] if (labels == c).any() else [0] * data.shape[1] for c in range(k)]


def assign(cells: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """(run, ids, labels, distances) of all runs; labels and distances packed."""
    k = len(centres)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, rows, data in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist(), batch.column("data").to_pylist()):
                x = unpacked(data).reshape(rows, -1)
                out.append(packed(partial_distances(x, centres[:, block * width : block * width + x.shape[1]])))
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("ids"), pa.array(out, pa.binary())], names=["run", "ids", "part"])

    def add(table: pa.Table) -> pa.Table:
        best, distance = add_blocks([unpacked(p).reshape(-1, k) for p in table.column("part").to_pylist()])
        ids = next((v for v in table.column("ids").to_pylist() if v is not None), None)
        return pa.table(
            {"run": table.column("run").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int64())), "labels": pa.array([packed(best)], pa.binary()), "distances": pa.array([packed(distance)], pa.binary())}
        )

    parts = cells.select("run", "block", "rows", "ids", "data").mapInArrow(partial, "run long, ids array<long>, part binary")
    return parts.groupBy("run").applyInArrow(add, "run long, ids array<long>, labels binary, distances binary")


def _update(cells: DataFrame, labels: DataFrame, centres: np.ndarray, width: int) -> np.ndarray:
    """The next centroids: every column block sums its own components per cluster."""
    k = len(centres)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[list[int]], np.ndarray]] = {}
        for batch in batches:
            for block, rows, data, own in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "data", "labels"))):
                x, label = unpacked(data).reshape(rows, -1), unpacked(own)
                got, n = cluster_sums(x, label, k), np.bincount(label, minlength=k)
                if block in held:
                    was, m = held[block]
                    got, n = [[p + q for p, q in zip(a, b)] for a, b in zip(was, got)], n + m
                held[block] = got, n
        out = [(b, c, int(n[c]), [str(v) for v in got[c]]) for b, (got, n) in held.items() for c in range(k)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["block", "cluster", "n", "total"]
            )

    # Whole sums travel as text: they may exceed 64 bits; there are blocks x clusters rows a task.
    parts = cells.join(labels.select("run", "labels"), "run").select("block", "rows", "data", "labels").mapInArrow(sums, "block int, cluster int, n long, total array<string>")
    found: dict[tuple[int, int], list] = {}

    def fold(table: pa.Table) -> pa.Table:
        lists = [[int(v) for v in t] for t in table.column("total").to_pylist()]
        total = [str(sum(column)) for column in zip(*lists)]
        return pa.table({"block": table.column("block").slice(0, 1), "cluster": table.column("cluster").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "total": pa.array([total], pa.list_(pa.string()))})

    for r in parts.groupBy("block", "cluster").applyInArrow(fold, "block int, cluster int, n long, total array<string>").collect():
        found[r["block"], r["cluster"]] = [int(v) // r["n"] for v in r["total"]] if r["n"] else None
    blocks = range(0, centres.shape[1], width)
    rows = [[v for j, b in enumerate(blocks) for v in (found.get((j, c)) or centres[c, b : b + width].tolist())] for c in range(k)]
    fits = all(abs(v) <= EXACT for row in rows for v in row)
    return np.array(rows, np.int64 if fits else object)


def lloyd(
    df: DataFrame, ident: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, salt: str = "3:", scale: int = 1024, width: int = WIDTH
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after the given rounds."""
    spark = df.sparkSession
    kept = kept_vectors(df, vector, size)
    centres = seeds(kept, ident, vector, k, salt, scale)
    if not len(centres):
        return spark.createDataFrame([], f"`{ident}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table = f"wordkin_cells_{uuid4().hex}"
    plain = kept.select(F.col(ident).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(plain.count() / BUCKET_ROWS))
    _cells(plain, width, scale).repartition(buckets, "run").write.bucketBy(buckets, "run").option("path", f"{scratch_dir(spark)}/{table}").saveAsTable(table)
    try:
        cells = spark.table(table)
        for _ in range(rounds):
            labels = cut(assign(cells, centres, width).select("run", "labels"))
            centres = _update(cells, labels, centres, width)
        last = cut(assign(cells, centres, width).select("ids", "labels", "distances"))
    finally:
        spark.sql(f"drop table if exists {table}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, label, distance in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "distances"))):
                held = [min(int(v), MAX_LONG) for v in unpacked(distance).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(unpacked(label), pa.int32()), pa.array(held, pa.int64())], names=["i", "cluster", "distance"])

    found = cut(last.mapInArrow(rows, "i long, cluster int, distance long"))

    def total(c: Column) -> Column:
        return F.least(F.sum(c.cast("decimal(38,0)")), F.lit(MAX_LONG)).cast("long")

    digests = [(c, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c in range(len(centres))]
    # One row a cluster: bounded by k.
    per = found.groupBy("cluster").agg(total(F.col("distance")).alias("cluster_inertia"))
    per = per.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    whole = found.agg(total(F.col("distance")).alias("inertia"))
    sums = [tuple(r) + (whole.first()[0],) for r in per.select("cluster", "cluster_inertia", "centroid_sha256").collect()]
    report = spark.createDataFrame(sums, "cluster int, cluster_inertia long, centroid_sha256 string, inertia long")
    return found.join(F.broadcast(report), "cluster").select(
        F.col("i").alias(ident), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
