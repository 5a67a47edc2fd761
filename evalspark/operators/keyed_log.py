"""A published dataset that grows by the rows of each batch: a base and deltas in hash buckets, merged by key when read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Working columns: the side a row comes from (0 existing, 1 incoming) and its bucket.
SIDE, BUCKET = "log_side", "log_bucket"


class KeyedLog:
    """Rows by ``key`` in ``folder``, of the columns ``schema``.

    A key's row is decided by the rows alone, whatever their order of arrival: incoming rows outrank existing ones, then
    the larger ``order`` counts, then the other columns that can be ordered. Rows with a blank key are all kept.

    ``begin`` writes the existing rows as base 0; ``append`` writes a batch's changed rows as a delta, one row a key and
    bucket by bucket; ``compact`` merges the deltas of the buckets that have any into a new base of these buckets and then
    writes which base and which deltas each bucket has (``state``). A folder counts once Spark has marked its write as
    complete, so what a killed run has left half-done is written again. A batch that is appended twice is the same delta.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str, order: Sequence[str], buckets: int = 16):
        self.spark, self.folder, self.schema, self.key, self.order, self.buckets = spark, folder, schema, key, list(order), buckets
        self.stored = T.StructType([*schema, T.StructField(SIDE, T.IntegerType())])

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self, path: str) -> bool:
        fs, p = self._hadoop(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _numbers(self, path: str, name: str) -> list[int]:
        """Of the folders ``name=n`` in a folder, the numbers in order."""
        fs, p = self._hadoop(path)
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x.removeprefix(f"{name}=")) for x in found if x.startswith(f"{name}="))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _bucketed(self, rows: DataFrame, side: int) -> DataFrame:
        return rows.select(*self.schema.names).withColumns({SIDE: F.lit(side), BUCKET: self._bucket()})

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row a key, and all rows with a blank one. Rows keep the side they come from."""
        blank = F.coalesce(F.trim(F.col(self.key).cast("string")), F.lit("")) == ""
        rest = [c for c in rows.columns if c != self.key]
        orderable = [f.name for f in self.schema if f.name not in (self.key, *self.order) and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
        last = rows.filter(~blank).groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(SIDE, *self.order, *orderable)).alias("r"))
        return last.select(self.key, "r.*").unionByName(rows.filter(blank).select(self.key, *rest))

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.folder}/{path}")

    def begin(self, existing: DataFrame) -> None:
        if not self._complete("base/g=0"):
            self._write(self._bucketed(existing, 0), "base/g=0")

    def append(self, batch: DataFrame, i: int) -> None:
        self._write(self._merged(self._bucketed(batch, 1)), f"delta/b={i}")

    def _state(self) -> tuple[int, dict[int, tuple[int, int]]]:
        """The newest generation, and each compacted bucket's base and last batch in it."""
        for g in reversed(self._numbers("state", "g")):
            if self._complete(f"state/g={g}"):
                rows = self.spark.read.schema("bucket int, base int, upto long").json(f"{self.folder}/state/g={g}").collect()
                return g, {r.bucket: (r.base, r.upto) for r in rows}
        return 0, {}

    def segments(self, upto: int | None = None) -> dict[int, list[str]]:
        """The folders that hold each bucket: its base, then the deltas after it (of batches up to ``upto``)."""
        _, state = self._state()
        out: dict[int, list[str]] = {}
        for b in range(self.buckets):
            base = f"base/g={state.get(b, (0, -1))[0]}/{BUCKET}={b}"
            fs, p = self._hadoop(base)
            out[b] = [base] if fs.exists(p) else []
        for i in self._numbers("delta", "b"):
            if (upto is None or i <= upto) and self._complete(f"delta/b={i}"):
                for b in self._numbers(f"delta/b={i}", BUCKET):
                    if i > state.get(b, (0, -1))[1]:
                        out[b].append(f"delta/b={i}/{BUCKET}={b}")
        return out

    def _rows(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*[f"{self.folder}/{s}" for s in segments])

    def read(self) -> DataFrame:
        """The dataset as of now."""
        return self._merged(self._rows([s for parts in self.segments().values() for s in parts])).select(*self.schema.names)

    def compact(self, upto: int) -> list[int]:
        """Merge what the batches up to ``upto`` have changed into new bases; the buckets that were rewritten."""
        g, state = self._state()
        touched = {b: parts for b, parts in self.segments(upto).items() if any(s.startswith("delta/") for s in parts)}
        if not touched:
            return []
        self._write(self._merged(self._rows([s for parts in touched.values() for s in parts])).withColumn(BUCKET, self._bucket()), f"base/g={g + 1}")
        new = state | {b: (g + 1, upto) for b in touched}
        self.spark.createDataFrame([(b, *x) for b, x in new.items()], "bucket int, base int, upto long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/state/g={g + 1}")
        return sorted(touched)

    def vacuum(self) -> list[str]:
        """Remove bases and deltas that the newest state has replaced (readers of older states lose them)."""
        g, state = self._state()
        merged = max((upto for _, upto in state.values()), default=-1)
        held = {"/".join(s.split("/")[:2]) for parts in self.segments().values() for s in parts} | {"base/g=0"}
        old = [f"base/g={x}" for x in self._numbers("base", "g")] + [f"delta/b={i}" for i in self._numbers("delta", "b") if i <= merged]
        gone = [path for path in old if path not in held]
        gone += [f"state/g={x}" for x in self._numbers("state", "g") if x < g]
        for path in gone:
            fs, p = self._hadoop(path)
            fs.delete(p, True)
        return gone

