"""Product codes of integer vectors: nearest codebook entries by exact matrix products of limbs."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from evalspark.llm.common import stored

#: Parts of a vector, entries of a part's codebook, rounds of refinement, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a double's significand: products of limbs are added up below 2^EXACT.
EXACT = 53


def most_component(width: int) -> int:
    """Largest integer component with which squared distances over ``width`` places fit a long."""
    return math.isqrt((2**63 - 1) // (4 * max(1, width)))


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs of ``bits`` bits, lowest first; the last one keeps the sign."""
    out, most = [], int(np.abs(x).max(initial=0))
    while most >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
        most = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    return [*out, x.astype(np.float64)]


def dot_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact x @ y.T of integer matrices whose products fit a long.

    Limbs are so short that every sum of their products stays below 2^53, where float64 adds whole numbers exactly; the
    sums are shifted and added as 64-bit integers.
    """
    bits = (EXACT - max(0, x.shape[1] - 1).bit_length()) // 2
    out = np.zeros((len(x), len(y)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``x`` the first of the entries of ``book`` with the smallest squared distance, and that distance."""
    far = (x * x).sum(1)[:, None] - 2 * dot_products(x, book) + (book * book).sum(1)[None, :]
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Integer rows of a batch, filled up with zeros to ``dims`` places."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _assigned(column: pa.ListArray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: parts (rows, PARTS, width), codes and distances (rows, PARTS)."""
    parts, _, width = books.shape
    x = _matrix(column, parts * width).reshape(-1, parts, width)
    found = [nearest(np.ascontiguousarray(x[:, p]), books[p]) for p in range(parts)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def part_sums(rows: DataFrame, books: np.ndarray) -> dict[int, int]:
    """Sums by slot over all rows: slot (part * entries + entry) * (width + 1) holds how many parts the entry is nearest
    to, the slots after it their components. A task adds up its rows, Spark the tasks; the result is as large as the
    codebooks."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            x, codes, _ = _assigned(batch.column("ints"), books)
            for p in range(parts):
                one_hot = np.zeros((len(x), entries), np.int64)
                one_hot[np.arange(len(x)), codes[:, p]] = 1
                at = slice(p * entries, (p + 1) * entries)
                total[at, 0] += one_hot.sum(0)
                total[at, 1:] += dot_products(one_hot.T.copy(), np.ascontiguousarray(x[:, p].T))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total.ravel()[slots])], names=["slot", "total"])

    sums = rows.select("ints").mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    return {r.slot: int(r.total) for r in sums.collect()}


def refined(books: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """Codebooks with every used entry replaced by the floor of its parts' mean."""
    out = books.copy()
    parts, entries, width = books.shape
    for p in range(parts):
        for e in range(entries):
            at = (p * entries + e) * (width + 1)
            if n := sums.get(at):
                out[p, e] = [sums.get(at + 1 + k, 0) // n for k in range(width)]
    return out


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id``, ``label`` and ``ints`` (floor of SCALE times each component) of the usable vectors: those that are not
    null and hold no null and no number that is not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(batch.column("vector").is_valid().to_numpy(zero_copy_only=False))))
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            owner = np.repeat(np.arange(len(sizes)), sizes)
            usable = np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) == 0
            with np.errstate(over="ignore"):
                scaled = np.floor(flat[usable[owner]] * SCALE)
            if np.abs(scaled).max(initial=0) > most_component(1):
                raise ValueError("a component is too large for exact distances in a long")
            kept = pa.array(np.flatnonzero(usable))
            ints = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[usable])]).astype(np.int32)), pa.array(scaled.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(kept), batch.column("label").take(kept), ints], names=["id", "label", "ints"])

    renamed = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    kinds = dict(renamed.dtypes)
    return renamed.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, ints array<long>")


def first_books(firsts: list[Row], width: int) -> np.ndarray:
    x = np.zeros((len(firsts), PARTS * width), np.int64)
    for i, r in enumerate(firsts):
        x[i, : len(r.ints)] = r.ints
    return np.ascontiguousarray(x.reshape(len(firsts), PARTS, width).transpose(1, 0, 2))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id``, ``label``, ``code`` (an entry per part, two hex digits each), ``error`` (squared distance to the entries,
    whole numbers), ``label_error`` (summed over equal labels, nulls together) and ``codebooks_sha256`` of every usable
    vector (see integer_vectors).

    Every part's codebook starts with that part of the ENTRIES smallest ids (nulls last; of equal ids the smaller
    vectors first; fewer vectors give fewer entries) and is refined ROUNDS times: parts go to their nearest entry, ties
    to the lower one, and a used entry becomes the floor of their mean. Vectors are filled up with zeros to the longest
    one and that to a multiple of PARTS. Components so large that a squared distance may not fit a long are an error.

    Integers are stored once in the shared folder and read once a round. The driver holds the codebooks, PARTS * ENTRIES
    entries of a part's width, and their sums.
    """
    ints = stored(integer_vectors(vectors, id_col, vec_col, label_col), "vector-ints")
    longest, most = ints.agg(F.max(F.size("ints")), F.max(F.greatest(F.array_max("ints"), -F.array_min("ints")))).first()
    width = max(1, -(-(longest or 0) // PARTS))
    if (most or 0) > most_component(width):
        raise ValueError("a component is too large for exact distances in a long")
    books = first_books(ints.orderBy(F.col("id").asc_nulls_last(), "ints").limit(ENTRIES).collect(), width)
    if not books.shape[1]:
        books = np.zeros((PARTS, 1, width), np.int64)  # no vectors, so no code
    for _ in range(ROUNDS):
        books = refined(books, part_sums(ints, books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, far = _assigned(batch.column("ints"), books)
            texts = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(far.sum(1))], names=["id", "label", "code", "error"])

    kinds = dict(ints.dtypes)
    coded = stored(ints.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "vector-codes")
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(per, F.col("label").eqNullSafe(F.col("of")))
    return out.select("id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
