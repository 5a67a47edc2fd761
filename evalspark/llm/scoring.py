"""Training samples and distributed scoring for the text classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.arrow_text import strips, utf8
from evalspark.llm.common import hash_share, kept_columns, stored


def training_sample(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str, text_col: str, label_col: str, most_rows: int) -> DataFrame:
    """``id``, ``label`` and whole ``text`` of at most ``most_rows`` labelled rows that are not held out.

    The rows with the smallest hashes of their ids are taken. One row per id: an id with two different labels is left
    out, of repeated documents the smallest text counts. Null ids and labels other than 0 and 1 are left out, null
    texts are empty. The sample is written to the shared folder; only its ids were joined with the texts.
    """
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out)
    n = usable.count()
    # of many labels, those with the smallest hashes are enough to take the smallest from
    near = usable.filter(hash_share(F.col(id_col), 2 * most_rows / n)) if n > 4 * most_rows else usable
    picked = (
        near.groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other"))
        .filter("label = other")
        .select("id", "label")
        .orderBy(F.shiftrightunsigned(F.xxhash64("id"), 24), "id")
        .limit(most_rows)
    )
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    # the sample is bounded by most_rows, so this side always fits a broadcast
    found = docs.select(F.col(id_col).alias("id"), text).join(F.broadcast(picked), "id")
    return stored(found.groupBy("id", "label").agg(F.min("text").alias("text")).coalesce(max(1, most_rows // 500)), "training")


def collected(sample: DataFrame, most_bytes: int) -> tuple[list[bytes], list[int]]:
    """Whole texts of a sample and their labels, in the order of the ids' hashes, as far as ``most_bytes`` go; a text
    that no longer fits is passed over."""
    sizes = sample.select("id", F.octet_length("text").alias("size"), F.xxhash64("id").alias("order")).collect()
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["order"], r["id"])):
        if total + r["size"] <= most_bytes:
            chosen.append(r["id"])
            total += r["size"]
    if len(chosen) < len(sizes):
        kept = sample.sparkSession.createDataFrame([(i,) for i in chosen], f"id {sample.schema['id'].dataType.simpleString()}")
        sample = sample.join(F.broadcast(kept), "id", "left_semi")
    rows = sorted(sample.collect(), key=lambda r: r["id"])
    return [r["text"].encode() for r in rows], [r["label"] for r in rows]


def score_texts(docs: DataFrame, model, strip: int, text_col: str, score_col: str) -> DataFrame:
    """``docs`` with ``model.score`` of every whole text, in strips of about ``strip`` bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text_col))
            scores = np.empty(len(batch), np.float64)
            for a, b in strips(offsets, strip):
                scores[a:b] = shared.value.score(data, offsets[a : b + 1])
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], names=[*keep, score_col])

    keep = kept_columns(docs, [score_col])
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)
