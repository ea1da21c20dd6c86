"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only after its rows have been counted against this bound.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = "*", name: str = "wordkin", shuffles: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffles))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def python_ready(spark: SparkSession) -> SparkSession:
    """Ship this package to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="wordkin-ship-"), "wordkin")
        spark.sparkContext.addPyFile(
            shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
        )
        _shipped.add(app)
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordkin-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write to a table in the shared checkpoint folder and read it back.

    Lost executors then cost no replay, columns are pruned on the way back, and the planner
    sees the true size. (A plain checkpoint keeps the estimated size of its plan; over a
    loop of joins those estimates multiply until planning itself takes minutes.)
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with passing_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


_scopes: list[list[str]] = []
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside are deleted with it, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let_go(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written: nothing made from them may be used afterwards."""
    for table in tables:
        _delete(table.sparkSession, _written.pop(table))


@contextmanager
def passing_cuts(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` writes inside are deleted at the end: nothing made from them may be used afterwards.
    Those given to the function that this yields stay."""
    _scopes.append([])

    def stay(table: DataFrame) -> DataFrame:
        _scopes[-1].remove(_written[table])
        if len(_scopes) > 1:
            _scopes[-2].append(_written[table])
        return table

    try:
        yield stay
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def scratch_dir(spark: SparkSession) -> str:
    _ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark for broadcast if the counted rows stay under the bound.

    Above it the frame is returned as it is: the join then shuffles, and adaptive
    execution splits whatever key turns out to be skewed.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def need_at_most(df: DataFrame, rows: int, what: str) -> list:
    """Collect model metadata, refusing to pull anything that grew past its bound."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what}: more than {rows} rows")
    return got
