"""Histogram sort into byte-balanced shards, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import as_row, cut, kept_columns, range_of, unpack

#: The sort key has 40 bits of the text's hash above 23 bits of the row id's hash.
KEY_BITS, ROW_BITS = 63, 23
#: Bits of a histogram's first round, most bits of each later one, and most cells (as bits) that a round brings to the
#: driver: many open splitters are refined in smaller steps.
FIRST_BITS, NEXT_BITS, CELL_BITS = 12, 8, 20
#: Bytes of a key range that one task sorts, and most ranges of all shards.
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 16


@dataclass
class Open:
    """A splitter still being looked for: it lies in the cell ``prefix`` of ``2**shift`` keys."""

    target: float
    slack: float
    prefix: int
    shift: int
    below: int


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]]) -> list[int]:
    """Key boundaries below which each (target, slack) number of bytes lies, from exact histograms.

    ``keys`` has ``key`` (63 bits) and ``size``. Each round counts the exact bytes of the sub-cells of all open cells
    in one aggregation, takes a sub-cell's edge where it meets the tolerance, and else refines the sub-cell that
    holds the target. A cell with one row cannot be refined: its nearer edge is taken.
    """
    found: dict[int, int] = {}
    still = {i: Open(t, s, 0, KEY_BITS, 0) for i, (t, s) in enumerate(targets)}
    while still:
        shift = next(iter(still.values())).shift
        inside = sorted({o.prefix for o in still.values()})
        bits = min(shift, FIRST_BITS if shift == KEY_BITS else max(1, min(NEXT_BITS, CELL_BITS - len(inside).bit_length())))
        lower = shift - bits
        rows = (
            keys.filter(F.shiftright("key", shift).isin(inside) if shift < KEY_BITS else F.lit(True))
            .groupBy(F.shiftright("key", lower).alias("cell"))
            .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            .collect()
        )
        cells: dict[int, list] = {p: [] for p in inside}
        for r in sorted(rows, key=lambda r: r["cell"]):
            cells[r["cell"] >> bits].append(r)
        nxt = {}
        for i, o in still.items():
            below, last = o.below, None
            for r in cells[o.prefix]:
                if below + r["bytes"] >= o.target or r is cells[o.prefix][-1]:
                    last = r
                    break
                below += r["bytes"]
            if last is None:
                found[i] = o.prefix << shift
                continue
            left, right = o.target - below, below + last["bytes"] - o.target
            lo, hi = last["cell"] << lower, (last["cell"] + 1) << lower
            if min(left, right) <= o.slack or last["rows"] == 1 or lower == 0:
                found[i] = lo if left <= right else hi
            else:
                nxt[i] = Open(o.target, o.slack, last["cell"], lower, below)
        still = nxt
    out: list[int] = []
    for i in range(len(targets)):
        out.append(min(max(found[i], out[-1] if out else 0), (1 << KEY_BITS) - 1))
    return out


def histogram_shards(df: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, ranges_per_shard: int | None = None) -> DataFrame:
    """Put every row into one of ``n_shards`` shards of near equal bytes by one global histogram sort.

    Rows sort by the hash of their text, then by the hash of their id, so equal texts lie together and stay in one
    shard, except where a group is so large that a boundary within ``tolerance`` (a share of a shard) must cut it.
    Each shard is made of ``ranges_per_shard`` key ranges, found by the same histograms, so that no task sorts a
    whole shard: by default as many as keep a range near RANGE_BYTES (8 at least). Rows move once.

    Returns the caller's columns with ``size`` (UTF-8 bytes plus 1; null and empty texts: 1), ``shard`` (0 to
    n_shards-1) and ``slot`` (its place in the shard, gapless from 0); these win over columns of the same names.
    Null ids hash like a value of their own. Repeated rows each get a slot. An empty table gives an empty result.
    """
    made = ["size", "shard", "slot"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 24), ROW_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(id_col)), 64 - ROW_BITS))
    size = F.octet_length(text).cast("long") + 1
    keys = cut(df.select(key.alias("key"), size.alias("size")))
    total = keys.agg(F.sum("size")).first()[0] or 0
    if ranges_per_shard is None:
        ranges_per_shard = max(8, min(MOST_RANGES // n_shards, total // (n_shards * RANGE_BYTES)))
    n = n_shards * ranges_per_shard
    share = total / n
    # only the shards' own boundaries must be precise
    targets = [(share * j, share * ranges_per_shard * tolerance / 2 if j % ranges_per_shard == 0 else share / 2) for j in range(1, n)]
    splitters = find_splitters(keys, targets) if total else [0] * (n - 1)
    counts = {r[0]: r[1] for r in keys.groupBy(range_of(F.col("key"), splitters)).count().collect()}
    starts, at = [], 0
    for r in range(n):
        at = 0 if r % ranges_per_shard == 0 else at
        starts.append(at)
        at += counts.get(r, 0)
    within = Window.partitionBy("range").orderBy("key", "id")
    return (
        df.select(as_row(df).alias("row"), key.alias("key"), size.alias("size"), F.col(id_col).alias("id"))
        .withColumn("range", range_of(F.col("key"), splitters))
        .withColumn("nth", F.row_number().over(within))
        .select(
            *unpack("row", kept_columns(df, made)),
            "size",
            F.floor(F.col("range") / ranges_per_shard).cast("int").alias("shard"),
            (F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("range") + 1) + F.col("nth") - 1).alias("slot"),
        )
    )
