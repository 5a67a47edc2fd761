"""A linear text classifier over character n-grams scaled by naive Bayes log-count ratios, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.arrow_text import strips, utf8

#: Lengths of the n-grams, in code points; their hashed space.
SIZES, BITS = (3, 4, 5), 20
#: Bytes of text handled at a time.
STRIP = 1 << 18
_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(1_000_003)


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a flat UTF-8 array (A to Z in lower case) and the values' offsets in code points."""
    part = data[offsets[0] : offsets[-1]]
    starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    points = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((points >= 65) & (points <= 90), points + 32, points), starts[offsets - offsets[0]]


def hashes(points: np.ndarray, size: int) -> np.ndarray:
    """Hashed n-grams that start at each code point but the last size-1."""
    n = max(0, len(points) - size + 1)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h *= _FOLD
        h += points[j : j + n]
    return ((h * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def present(points: np.ndarray, at: np.ndarray, slot: np.ndarray, width: int) -> np.ndarray:
    """Distinct (text, feature) pairs as text*width + feature, for the n-grams whose ``slot`` is not negative."""
    found = []
    for size in SIZES:
        s = slot[hashes(points, size)]
        where = np.flatnonzero(s >= 0)
        text = np.searchsorted(at, where, "right") - 1
        whole = where + size <= at[text + 1]
        found.append((text * width + s[where])[whole])
    return np.unique(np.concatenate(found))


@dataclass
class NgramLinear:
    """``slot``: feature of each hashed n-gram or -1; ``weight``: what a present feature adds to the log odds."""

    slot: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text, from all its n-grams; empty texts get the bias."""
        points, at = folded(data, offsets)
        n, width = len(offsets) - 1, max(1, len(self.weight))
        pairs = present(points, at, self.slot, width)
        z = self.bias + np.bincount(pairs // width, self.weight[pairs % width] if len(self.weight) else None, n)[:n]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_counts(sample: DataFrame) -> DataFrame:
    """``gram`` and in how many texts of label 1 (``n1``) and 0 (``n0``) of ``sample`` it occurs, counted in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(1 << BITS, dtype=np.int64)
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            labels = batch.column("label").to_numpy()
            for a, b in strips(offsets, STRIP):
                pairs = present(*folded(data, offsets[a : b + 1]), every, 1 << BITS)
                counts += np.bincount((labels[a:b][pairs >> BITS] << BITS) + (pairs & ((1 << BITS) - 1)), minlength=2 << BITS).reshape(2, -1)
        seen = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["gram", "n0", "n1"])

    return sample.select("label", "text").mapInArrow(run, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def feature_bits(sample: DataFrame, slot: np.ndarray, width: int) -> DataFrame:
    """``id``, ``label`` and one bit per feature of each text of ``sample``."""
    shared = sample.sparkSession.sparkContext.broadcast(slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            bits: list[bytes] = []
            for a, b in strips(offsets, STRIP):
                there = np.zeros((b - a) * width, bool)
                there[present(*folded(data, offsets[a : b + 1]), shared.value, width)] = True
                bits.extend(x.tobytes() for x in np.packbits(there.reshape(b - a, width), axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(bits, pa.binary())], names=["id", "label", "bits"])

    return sample.select("id", "label", "text").mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, label int, bits binary")


def fit(sample: DataFrame, *, features: int = 4096, smoothing: float = 1.0, penalty: float = 1e-5, steps: int = 400) -> NgramLinear:
    """Fit on the rows (``id``, ``label`` 0 or 1, ``text``) of ``sample``.

    Features: the n-grams whose document counts differ most between the labels (largest chi-square), in at least three
    texts. Each feature, present or not, is scaled by its log-count ratio; logistic regression with an L2 penalty then
    weighs them. With one class only, the model answers that class. The driver gets ``features`` counts and one bit per
    text and feature, whatever the texts' length.
    """
    of = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = of.get(0, 0), of.get(1, 0)
    none = np.full(1 << BITS, -1, np.int32)
    if not n0 or not n1:
        return NgramLinear(none, np.zeros(0), 8.0 * ((n1 > 0) - (n0 > 0)))
    share = (F.col("n0") + F.col("n1")) / (n0 + n1)
    surprise = F.pow(F.col("n1") - n1 * share, 2) / F.greatest(share * (1 - share), F.lit(1 / (n0 + n1)))
    chosen = document_counts(sample).filter("n0 + n1 >= 3").orderBy(surprise.desc(), "gram").limit(features).collect()
    slot, width = none, len(chosen)
    slot[[r["gram"] for r in chosen]] = np.arange(width)
    ratio = np.array([np.log((r["n1"] + smoothing) / (n1 + 2 * smoothing)) - np.log((r["n0"] + smoothing) / (n0 + 2 * smoothing)) for r in chosen], np.float32)
    rows = sorted(feature_bits(sample, slot, width).collect(), key=lambda r: r["id"]) if width else []
    y = np.array([r["label"] for r in rows], np.float32)
    x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, :width].astype(np.float32)
    x *= ratio
    w, b = np.zeros(width, np.float32), float(np.log(n1 / n0))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, (steps if width else 0) + 1):
        d = (1 / (1 + np.exp(-np.clip(b + x @ w, -30, 30))) - y) / len(y)
        g = np.append(d @ x + penalty * w, d.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = 0.05 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1].astype(np.float32)
        b -= float(move[-1])
    return NgramLinear(slot, (w * ratio).astype(np.float64), b)
