"""Shared helpers: durable intermediate tables, key search and carrying of caller columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session, whose driver and executors are one process, may go without the setting.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise ``df`` as a checkpoint in the shared folder, so that its lineage ends there (``rows`` as in stored)."""
    shared_dir(df.sparkSession)
    return (df if rows is None else in_files(df, rows)).checkpoint(eager=True)


#: Spark's setting that removes a query's shuffle files when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows for which a stored table or a checkpoint gets a file of its own, where the number of rows has a known bound, and
#: files of a small one (no fewer, so that no single task makes it).
FILE_ROWS, LEAST_FILES = 100_000, 12


def files_for(rows: int) -> int:
    return max(LEAST_FILES, -(-rows // FILE_ROWS))


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows in no more partitions than its rows need, so that small tables make few files."""
    return df.coalesce(files_for(rows))


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back (columns prune, blocks compress).

    ``rows``: a bound on its rows, from which the number of files follows. The table is complete when this returns, so
    the shuffle files of its making are removed with the write.
    """
    df = df if rows is None else in_files(df, rows)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def hash_share(column: Column, share: float) -> Column:
    """Whether a value is in the ``share`` of all values with the smallest hashes: equal values are in or out together."""
    return F.shiftrightunsigned(F.xxhash64(column), 24) < F.lit(min(1 << 40, int(share * (1 << 40))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_columns(df: DataFrame, made: Sequence[str]) -> list[str]:
    """Columns of ``df`` that do not clash with the result columns ``made`` (result columns win)."""
    names = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in names]


def unpack(row: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(row).getField(c).alias(c) for c in columns]


def as_row(df: DataFrame) -> Column:
    """All caller columns in one struct: whatever their names, they cannot clash with working columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


#: Up to this many splitters a nested CASE stays inside generated code.
CASE_SPLITTERS = 256


def range_of(key: Column, splitters: Sequence[int]) -> Column:
    """How many of the ascending ``splitters`` are <= ``key``; null keys count as lowest.

    A balanced CASE tree compares O(log n) times; longer lists take one CASE level over literal arrays.
    """

    def tree(lo: int, hi: int, leaf) -> Column:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(at[mid]), tree(lo, mid, leaf)).otherwise(tree(mid + 1, hi, leaf))

    splitters = list(splitters)
    if len(splitters) <= CASE_SPLITTERS:
        at = splitters
        found = tree(0, len(at), F.lit)
    else:
        step = -(-len(splitters) // CASE_SPLITTERS)
        parts = [splitters[i : i + step] for i in range(0, len(splitters), step)]
        at = [p[0] for p in parts[1:]]
        which = tree(0, len(at), F.lit)
        inside = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), which + 1)
        found = which * step + F.size(F.filter(inside, lambda s: s <= key))
    return F.when(key.isNull(), F.lit(0)).otherwise(found).cast("int")
