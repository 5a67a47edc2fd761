"""Near-duplicate vectors by randomly rotated binary codes with correction factors and confidence bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored
from evalspark.llm.components import components

#: Probability with which a pair right at the threshold may meet in no bucket.
MISS = 1e-3
#: Width of the confidence bounds, in standard deviations of the estimate.
SIGMAS = 5.0
#: Vectors that a bucket should hold on average, and rows of half a block of a larger bucket.
BUCKET, BLOCK = 16, 1024
#: Groups up to this size are gone through place by place over a whole batch, larger ones by matrix products: two ways
#: to the same pairs.
SMALL = 48
#: Pairs handled at a time.
STEP = 1 << 15


def plan_bands(n: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket key and number of bands: buckets stay small as ``n`` grows, pairs at ``least`` still meet."""
    bits = min(40, max(6, math.ceil(math.log2(max(2, n / BUCKET)))))
    meet = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def rotations(dims: int, count: int, seed: int = 5) -> np.ndarray:
    r = np.random.default_rng([seed, dims])
    return np.stack([np.linalg.qr(r.normal(size=(dims, dims)))[0] for _ in range(count)])


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(unit: np.ndarray, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors (n, D): packed sign bits after all rotations (the first D are the code, the first bits * bands the
    bucket keys) and the code's correction factor."""
    dims = unit.shape[1]
    turned = np.einsum("nd,rde->nre", unit, rotations(dims, -(-bits * bands // dims)))
    factor = np.abs(turned[:, 0, :]).sum(1) / math.sqrt(dims)
    return np.packbits((turned > 0).reshape(len(unit), -1), axis=1), factor


def keys_of(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Bucket keys per band from packed sign bits."""
    flat = np.unpackbits(signs, axis=1, count=bits * bands).reshape(len(signs), bands, bits)
    return flat @ (1 << np.arange(bits, dtype=np.int64))


def widths(factor: np.ndarray, dims: int, least: float) -> np.ndarray:
    """How far an estimate may lie under the inner product of a pair that reaches ``least``.

    <code, q> / <code, o> = <o, q> + sqrt(1 - f^2) / f * <r, q> for a unit r orthogonal to o in a random direction, and
    |<r, q>| <= sqrt(1 - <o, q>^2): that is the bound where SIGMAS deviations, 1 / sqrt(D - 1) of it each, reach as far.
    """
    most = math.sqrt(1 - least * least) if least > 0 else 1.0
    return min(1.0, SIGMAS / math.sqrt(max(1, dims - 1))) * most * np.sqrt(np.maximum(0, 1 - factor**2)) / factor + 1e-4


def encoded(nodes: DataFrame, bits: int, bands: int, kind: str) -> DataFrame:
    """``group``, ``node``, ``rows``, ``keys``, ``signs``, ``factor`` and ``vector`` (raw, of the numpy type ``kind``) of
    each row of ``group``, ``node``, ``rows``, ``vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            for dims in np.unique(sizes):
                take = pa.array(np.flatnonzero(sizes == dims))
                x = column.take(take).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(take), dims)
                signs, factor = encode(units(x), bits, bands)
                keys = keys_of(signs, bits, bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                raw = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
                kept = [batch.column(c).take(take) for c in ("group", "node", "rows")]
                yield pa.RecordBatch.from_arrays([*kept, lists, raw(signs), pa.array(factor), raw(x.astype(kind))], names=["group", "node", "rows", "keys", "signs", "factor", "vector"])

    return nodes.select("group", "node", "rows", "vector").mapInArrow(run, "group long, node long, rows long, keys array<long>, signs binary, factor double, vector binary")


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each place's smallest place of its class) after the classes of the pairs (i, j) are joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while not np.array_equal(nxt := label[label], label):
            label = nxt


def block_sums(rows: DataFrame, least: float, bits: int, bands: int, kind: str) -> DataFrame:
    """Per row of a block that has links in it: ``node``, ``around`` (rows of the nodes linked) and ``root`` (a node of
    its class in the block).

    ``rows`` (block, band, node, rows, signs, factor, vector, left, right) lie together by block; ``left``/``right`` say
    in which half of the block a row is (both: it is compared with every row). A pair counts in the first band that it
    shares only. Bounds on its estimates decide whether its cosine is computed.
    """

    def compare(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n, dims = x["vector"].shape
        unit = units(x["vector"])
        query = (unit @ rotations(dims, 1)[0]).astype(np.float32)
        code = (2 * np.unpackbits(x["signs"], axis=1, count=dims).astype(np.float32) - 1) / np.float32(math.sqrt(dims)) / x["factor"].astype(np.float32)[:, None]
        floor = least - widths(x["factor"], dims, least).astype(np.float32)
        vector = x["vector"] / np.abs(x["vector"]).max(1, keepdims=True)  # squares of any finite components stay finite
        keys, norm = keys_of(x["signs"], bits, bands), np.linalg.norm(vector, axis=1)
        around, label = np.zeros(n, np.int64), np.arange(n)

        def settle(i: np.ndarray, j: np.ndarray) -> None:
            """Links among pairs that the bounds leave open."""
            nonlocal around, label
            for at in range(0, len(i), STEP):
                a, b = i[at : at + STEP], j[at : at + STEP]
                ok = (x["node"][a] != x["node"][b]) & ((x["left"][a] & x["right"][b]) | (x["left"][b] & x["right"][a]))
                a, b = a[ok], b[ok]
                new = ((keys[a] == keys[b]) & (np.arange(bands) < x["band"][a][:, None])).sum(1) == 0
                a, b = a[new], b[new]
                near = np.einsum("nd,nd->n", vector[a], vector[b]) / (norm[a] * norm[b]) >= least
                a, b = a[near], b[near]
                around += np.bincount(a, x["rows"][b], n).astype(np.int64) + np.bincount(b, x["rows"][a], n).astype(np.int64)
                label = joined(label, a, b)

        def test(i: np.ndarray, j: np.ndarray) -> None:
            for at in range(0, len(i), STEP):
                a, b = i[at : at + STEP], j[at : at + STEP]
                open_ = np.einsum("nd,nd->n", code[a], query[b]) >= floor[a]
                a, b = a[open_], b[open_]
                open_ = np.einsum("nd,nd->n", code[b], query[a]) >= floor[b]
                settle(a[open_], b[open_])

        starts = np.flatnonzero(np.concatenate([[True], x["block"][1:] != x["block"][:-1]]))
        ends = np.append(starts[1:], n)
        size = ends - starts
        end_of = np.repeat(ends, size)
        i = np.flatnonzero(np.repeat(size <= SMALL, size))
        for step in range(1, SMALL):
            i = i[i + step < end_of[i]]
            if not len(i):
                break
            test(i, i + step)
        for g in np.flatnonzero(size > SMALL):
            for a in range(starts[g], ends[g], 256):
                one, two = slice(a, min(a + 256, ends[g])), slice(a, ends[g])
                open_ = (code[one] @ query[two].T >= floor[one, None]) & (query[one] @ code[two].T >= floor[None, two])
                r, c = np.nonzero(np.triu(open_, 1))
                settle(r + a, c + a)
        return around, label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            raw = {c: table.column(c).to_pylist() for c in ("vector", "signs")}
            lengths = np.array([len(v) for v in raw["vector"]])
            for length in np.unique(lengths):
                part = np.flatnonzero(lengths == length)
                x = {c: table.column(c).to_numpy()[part] for c in ("block", "band", "node", "rows", "factor", "left", "right")}
                flat = lambda c, t: np.frombuffer(b"".join(raw[c][k] for k in part), t).reshape(len(part), -1)  # noqa: E731, B023
                x |= {"vector": flat("vector", kind).astype(np.float64), "signs": flat("signs", np.uint8)}
                around, label = compare(x)
                linked = np.flatnonzero(around)
                yield pa.RecordBatch.from_arrays([pa.array(x["node"][linked]), pa.array(around[linked]), pa.array(x["node"][label[linked]])], names=["node", "around", "root"])

        for batch in batches:
            if len(batch):
                # what is held ends within a block; compare it once it is large and the block has ended
                block = batch.column("block").to_numpy()
                change = np.flatnonzero(block[1:] != block[:-1])
                cut = int(change[-1]) + 1 if len(change) else 0
                if held and not cut and held[-1].column("block")[-1].as_py() != block[0]:
                    yield from flush()
                if cut:
                    held.append(batch.slice(0, cut))
                    yield from flush()
                held.append(batch.slice(cut))
        if held:
            yield from flush()

    return rows.mapInArrow(run, "node long, around long, root long")


def vector_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, least: float = 0.93, miss: float = MISS) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component_id`` and ``kept`` (see below).

    Vectors are compared when their labels are equal and not null (and they are as long). Two are linked when their
    cosine in double precision is at least ``least``. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: n_links 0, a component of their own. ``n_links``: other rows linked directly;
    ``component_id``: smallest id reachable by links; ``kept``: id = component_id. Null ids come last among ids.

    Equal vectors of a label (by two hashes) are one node with a count. Unit vectors are turned by random rotations;
    sign bits make bucket keys in several bands (see plan_bands: a pair at the threshold is missed with probability
    ``miss``). In a bucket, the codes' unbiased estimates with their correction factors and bounds rule out most pairs;
    the others' cosines are computed exactly, each pair's in the first band it shares. Buckets over BLOCK rows are
    compared block by block. Blocks return counts and classes of their rows, never pairs.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & F.col(label_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    kind = "<f4" if df.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"
    group = F.xxhash64(F.col(label_col), F.size(x))
    base = df.select(F.col(id_col).alias("id"), F.when(F.coalesce(usable, F.lit(False)), x.cast("array<double>")).alias("vector"), group.alias("group"))
    base = base.withColumns({"h": F.when(F.col("vector").isNotNull(), F.xxhash64("group", "vector")), "g": F.xxhash64(F.lit(1), "group", "vector")})
    nodes = base.filter("h is not null").groupBy("h", "g").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("id"), F.first("group").alias("group"), F.first("vector").alias("vector"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = nodes.count()
    most = nodes.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan_bands(most, least, miss)
    codes = stored(encoded(nodes, bits, bands, kind), "codes")
    keyed = codes.select("node", "group", F.posexplode("keys").alias("band", "key")).select("node", "band", F.xxhash64("group", "band", "key").alias("bucket"))
    sizes = stored(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets", n * bands)
    placed = (
        keyed.join(sizes, "bucket")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "band", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("block"), (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"))
    )
    rows = placed.join(codes.select("node", "rows", "signs", "factor", "vector"), "node").repartition("block").sortWithinPartitions("block", "node")
    sums = stored(block_sums(rows, least, bits, bands, kind), "link_sums")
    ends = sums.groupBy("node").agg(F.sum("around").alias("around"))
    label = components(sums.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), n).withColumnRenamed("node", "of")
    named = stored(nodes.join(label, nodes["node"] == label["of"], "left").select("node", "h", "g", "id", "rows", F.coalesce("label", "node").alias("label")), "named", n)
    least_id = stored(named.groupBy("label").agg(F.min("id").alias("component_id")), "least_ids", n)
    known = named.join(least_id, "label").join(ends, "node", "left").select("h", "g", "component_id", (F.coalesce("around", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = base.select("id", "h", "g").join(known, ["h", "g"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
