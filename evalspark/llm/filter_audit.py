"""How filters of a document pipeline interact, over every order in which they could be applied."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the audit adds up per mask: documents, and those with either mark.
COUNTS = ("n", "good", "toxic")


def lehmer_rank(prefix: Sequence[int], n: int) -> int:
    """Lexicographic rank of the first permutation of ``n`` that begins with ``prefix``."""
    free, rank = list(range(n)), 0
    for k, x in enumerate(prefix):
        place = free.index(x)
        rank += place * factorial(n - 1 - k)
        free.pop(place)
    return rank


def removal_intervals(mask: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the permutations in which a document that fails the filters in
    ``mask`` is removed at that step: passing filters stand before it, a failing one at it, the rest in any order."""
    passing, failing = [f for f in range(n) if not mask >> f & 1], [f for f in range(n) if mask >> f & 1]
    for before in range(len(passing) + 1 if failing else 0):
        for head in permutations(passing, before):
            for f in failing:
                start = lehmer_rank((*head, f), n)
                yield before, start, start + factorial(n - 1 - before)


def audit_part(masks: np.ndarray, counts: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Columns (orders in rank order, steps inside) of the audit of one part: documents per mask (``counts``: len(masks)
    by COUNTS) go into difference arrays at the ends of their intervals of ranks, whose prefix sums are the totals."""
    orders = np.array(list(permutations(range(n))))
    change = np.zeros((n, len(orders) + 1, counts.shape[1]), np.int64)
    for mask, c in zip(masks.tolist(), counts, strict=True):
        for step, first, after in removal_intervals(mask, n):
            change[step, first] += c
            change[step, after] -= c
    removed = np.cumsum(change[:, :-1], axis=1).transpose(1, 0, 2)  # order, step, what is counted
    fails = np.array([counts[(masks >> f & 1) == 1, 0].sum() for f in range(n)], np.int64)[orders]
    only = np.array([counts[masks == 1 << f, 0].sum() for f in range(n)], np.int64)[orders]
    here = removed[:, :, 0]
    whole = np.array([here[orders == f].sum() for f in range(n)], np.int64)
    columns = {"kept": counts[:, 0].sum() - np.cumsum(here, axis=1), "removed": here, "redundant": fails - here, "unique_fails": only, "good_lost": removed[:, :, 1], "toxic_lost": removed[:, :, 2], "shapley": whole[orders]}
    return {k: v.ravel() for k, v in columns.items()}


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """The audit of documents counted per ``part`` and ``mask`` (bit k: the filter of letter k fails it): a row per part,
    order of the filters and step. ``masks``: ``part``, ``mask``, ``n``, ``good``, ``toxic``.

    Rows that share part and mask are added up first, so a part has at most 2^filters rows in one task. An empty table
    gives no rows.
    """
    n = len(letters)
    names = ["".join(letters[f] for f in order) for order in permutations(range(n))]
    grouped = masks.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = audit_part(rows["mask"].to_numpy(np.int64), rows[list(COUNTS)].to_numpy(np.int64), n)
        return pd.DataFrame({"part": rows["part"].iloc[0], "filter_order": np.repeat(names, n), "step": np.tile(np.arange(1, n + 1), len(names)).astype(np.int32)} | made)

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return grouped.groupBy("part").applyInPandas(run, f"part string, filter_order string, step int, {longs}")


def text_filters(text: Column) -> Mapping[str, Column]:
    """Failure conditions of whole texts by letter (A, few words; B, repeated words; C, capitals; D, markup)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (``doc_id``, ``text``, ``lang``) counted by ``part`` (lang; null: '') and ``mask`` of the filters that
    fail them (see audit): text_filters, then E, a text that some document with a smaller id has as well.

    Null texts are empty. A null id is larger than all others; rows with one id are no copies of each other, so of equal
    texts all rows with the smallest id pass E. Marks come from ``labels`` (``doc_id``, ``quality``, ``toxic``; an id
    counts as marked if any of its rows is); null ids have none. Texts are told apart by their SHA-256.

    Texts themselves are never shuffled. Rows of equal texts are added up before they meet, each with its smallest id
    and how many rows have it, so a text with a third of all rows costs a row per task.
    """
    text = F.coalesce("text", F.lit(""))
    fails = text_filters(F.col("text"))
    d = docs.select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    mask = sum((c.cast("int") * (1 << k) for k, c in enumerate(fails.values())), F.lit(0))
    d = d.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of_text, mark = ("digest", "mask", "part", "good", "toxic"), lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = d.filter("doc_id is not null").join(marks, "doc_id", "left").select("doc_id", "digest", "mask", "part", mark("good"), mark("toxic"))
    known = known.groupBy("doc_id", *of_text).agg(F.count(F.lit(1)).alias("rows"))
    nameless = d.filter("doc_id is null").groupBy("doc_id", "digest", "mask", "part").agg(F.count(F.lit(1)).alias("rows")).withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    kinds = known.unionByName(nameless).groupBy(*of_text).agg(F.min("doc_id").alias("first"), F.coalesce(F.min_by("rows", "doc_id"), F.sum("rows")).alias("rows"), F.sum("rows").alias("n"))
    # a text's rows are few here: one per part and pair of marks
    per = kinds.groupBy("digest").agg(F.min("first").alias("least"), F.collect_list(F.struct("mask", "part", "good", "toxic", "first", "rows", "n")).alias("kinds")).select("least", F.explode("kinds").alias("k")).select("least", "k.*")
    unique = F.when(F.col("first").eqNullSafe(F.col("least")), F.col("rows")).otherwise(F.lit(0))
    split = F.array(F.struct(F.col("mask"), unique.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(fails))).alias("mask"), (F.col("n") - unique).alias("n")))
    return (
        per.select("part", "good", "toxic", F.explode(split).alias("x")).filter("x.n > 0")
        .groupBy("part", "x.mask").agg(F.sum("x.n").alias("n"), F.sum(F.col("good") * F.col("x.n")).alias("good"), F.sum(F.col("toxic") * F.col("x.n")).alias("toxic"))
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of document_masks."""
    return audit(document_masks(docs, labels), "ABCDE")
