"""Places of rows in a total order, found without sorting the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.scratch import stored

#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def numbered(rows: DataFrame, by: Sequence[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1, without gaps) in the rising order of ``by`` over the whole table; rows that are equal
    there stand by their plain columns.

    Spark samples splitters and deals the rows to ``ranges`` ranges of the order (default: the shuffle partitions), each
    range is sorted and numbered by its own task, and a range's first place is the sum of the sizes before it: a table of
    one row per range. Wholly equal rows are parted by a random number, so none of them makes a range too large. The
    numbered rows are stored, so that counts and rows are of the same ranges.
    """
    spark = rows.sparkSession
    plain = [f.name for f in rows.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    keys = {f"k{i}": c for i, c in enumerate([*by, *[F.col(f"`{c}`") for c in plain]])} | {"k_equal": F.rand(7)}
    ranged = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])
    ranged = ranged.repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    at = stored(ranged.select("row", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", ROW_BITS).alias("part")
    sizes = at.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    firsts = sizes.select("part", before.alias("before"))
    placed = at.withColumn("part", part).join(F.broadcast(firsts), "part")  # a row per range
    return placed.select(*[F.col("row").getField(c).alias(c) for c in rows.columns if c != name], (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1).alias(name))
