"""Merkle fingerprints over sections and paragraphs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import hash_share, range_of

#: Paragraphs of a section; most code points of a leaf.
SECTION, LEAF = 4, 48
#: A leaf's code keeps its length in its lowest bits.
LENGTH_BITS = 6
#: Ids sampled per bucket to find the buckets' edges.
PER_BUCKET = 20
#: A leaf ends at a sentence's end or is cut at LEAF code points; leaves cover every code point.
LEAF_PATTERN = rf"(?s)[^.!?]{{0,{LEAF - 1}}}[.!?]|[^.!?]{{1,{LEAF}}}"


def numbered(leaves: Column) -> Column:
    """``leaves`` with every further occurrence of a leaf told from the one before; lengths stay in the lowest bits."""
    low = F.lit((1 << LENGTH_BITS) - 1).cast("long")

    def label(x: Column, k: Column) -> Column:
        return F.when(k == 0, x).otherwise(F.shiftleft(F.shiftright(F.xxhash64(x, k), LENGTH_BITS), LENGTH_BITS).bitwiseOR(x.bitwiseAND(low)))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        one = lambda t: lambda a, j: F.transform(F.sequence(a, F.coalesce(F.get(t, j + 1), F.size(s)) - 1), lambda i: label(F.get(s, i), i - a))
        return F.element_at(F.transform(F.array(starts), lambda t: F.flatten(F.transform(t, one(t)))), 1)

    sort = lambda x: F.element_at(F.transform(F.array(F.sort_array(x)), runs), 1)
    return F.element_at(F.transform(F.array(leaves), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), x).otherwise(sort(x))), 1)


def merkle(text: Column) -> Column:
    """The hash tree of a text as a struct: ``root``, ``size`` (code points under leaves) and ``sections``, each with its
    ``digest``, the digests of its ``paragraphs`` and the codes of its ``leaves``.

    Leaves are parts of paragraphs, paragraphs are lines, a section is SECTION consecutive paragraphs. Every digest is
    the SHA-256 of a letter for its level and of what stands below it: a leaf's of its text, the others' of their
    children's digests. So equal roots mean equal texts. A leaf's code is a 64-bit hash that keeps its length.
    """
    digest = lambda level, parts: F.sha2(F.concat(F.lit(level), F.array_join(parts, "")), 256)
    code = lambda x: F.shiftleft(F.shiftright(F.xxhash64(x), LENGTH_BITS), LENGTH_BITS).bitwiseOR(F.length(x).cast("long"))
    # a lambda's variable is computed once, where a repeated expression could be computed for every use
    once = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)

    def paragraph(line: Column) -> Column:
        return once(
            F.regexp_extract_all(line, F.lit(LEAF_PATTERN), F.lit(0)),
            lambda leaves: F.struct(digest("p", F.transform(leaves, lambda x: F.sha2(F.concat(F.lit("l"), x), 256))).alias("digest"), F.transform(leaves, code).alias("leaves")),
        )

    def section(paragraphs: Column) -> Column:
        digests = F.transform(paragraphs, lambda p: p["digest"])
        return F.struct(digest("s", digests).alias("digest"), digests.alias("paragraphs"), F.flatten(F.transform(paragraphs, lambda p: p["leaves"])).alias("leaves"))

    def sections(paragraphs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(paragraphs) - 1) / SECTION).cast("int")), lambda i: section(F.slice(paragraphs, i * SECTION + 1, F.lit(SECTION))))

    def tree(sections: Column) -> Column:
        size = F.aggregate(sections, F.lit(0).cast("long"), lambda n, s: n + weight(s["leaves"]))
        return F.struct(digest("r", F.transform(sections, lambda s: s["digest"])).alias("root"), size.alias("size"), sections.alias("sections"))

    return once(once(F.transform(F.split(text, "\n", -1), paragraph), sections), tree)


def weight(leaves: Column) -> Column:
    """Code points under leaves."""
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two trees' leaves, repeats and all, by code points: 1 for equal roots, 0 without a common leaf.

    Found down the branches: sections at the same place with equal digests have all their leaves in common, and only the
    leaves of the other sections are held against each other.
    """
    other = F.filter(F.zip_with(a["sections"], b["sections"], lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda s: ~s["x"]["digest"].eqNullSafe(s["y"]["digest"]))
    rest = lambda side: F.flatten(F.transform(other, lambda s: F.coalesce(s[side]["leaves"], F.array().cast("array<long>"))))
    both = a["size"] + b["size"]
    same = lambda x, y: a["size"] - weight(x) + weight(F.array_intersect(numbered(x), numbered(y)))
    sides = F.array(F.struct(rest("x").alias("x"), rest("y").alias("y")))
    common = F.element_at(F.transform(sides, lambda s: same(s["x"], s["y"])), 1)
    return F.when(a["root"] == b["root"], 1.0).when(both == 0, 0.0).otherwise(2.0 * common / both)


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first paragraph in which two trees differ, found down the first differing section; null if none."""
    unequal = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int") - 1
    digests = lambda t: F.transform(t["sections"], lambda s: s["digest"])
    section = unequal(digests(a), digests(b))
    part = lambda t: F.coalesce(F.get(t["sections"], section)["paragraphs"], F.array().cast("array<string>"))
    return F.when(section >= 0, section * SECTION + unequal(part(a), part(b)))


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rows_per_bucket: int = 2000, most_buckets: int = 1 << 15) -> DataFrame:
    """``id``, ``text`` (null: empty) and ``bucket`` of every row, plus a copy (``ghost`` true) of each bucket's first
    row in the bucket before it (the very first in the last): then the next row is always in a row's own bucket.

    Buckets are ranges of ids, of any type that sorts, between ids of a bounded sample (about PER_BUCKET a bucket).
    """
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = d.count()
    buckets = max(1, min(most_buckets, n // rows_per_bucket))
    cuts: list = []
    if buckets > 1:
        sample = d.select("id").filter(F.col("id").isNotNull() & hash_share(F.col("id"), PER_BUCKET * buckets / n)).distinct()
        cuts = sorted(r["id"] for r in sample.collect())
        cuts = cuts[:: max(1, len(cuts) // buckets)][1:]
    d = d.withColumn("bucket", range_of(F.col("id"), cuts))
    heads = {r["bucket"]: r for r in d.groupBy("bucket").agg(F.min("id").alias("id"), F.bool_or(F.col("id").isNull()).alias("null")).collect()}
    order = sorted(heads)
    before = [0] * (len(cuts) + 1)
    for i, b in enumerate(order):
        before[b] = order[i - 1]
    ids = [r["id"] for r in heads.values() if not r["null"]]
    first = F.col("id").isin(ids) if ids else F.lit(False)
    if any(r["null"] for r in heads.values()):
        first = F.coalesce(first, F.lit(True))
    ghosts = d.filter(F.coalesce(first, F.lit(False))).groupBy("bucket", "id").agg(F.min("text").alias("text"))
    ghosts = ghosts.select("id", "text", F.element_at(F.array(*map(F.lit, before)), F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("ghost"))
    return d.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited form (its last quarter replaced by the next row's first code points).

    The next row is the one with the next id (nulls first; the first row follows the last; equal ids go by text).
    Ids may be of any type that sorts. Returns per row: ``id``, ``text``, ``edited``, ``tree``, ``edited_tree`` (see merkle), ``near_edited`` and
    ``near_next`` (see likeness) and ``first_edit`` (paragraph index, null if the edit changes nothing). Null texts
    count as empty; two empty texts are equal. Other columns are not carried. An empty table gives an empty result.
    """
    rows = with_next(df, id_col, text_col).repartition("bucket").withColumn("tree", merkle(F.col("text")))
    w = Window.partitionBy("bucket").orderBy(F.col("ghost"), F.col("id").asc_nulls_first(), F.col("text"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    return (
        rows.withColumns({"next_text": F.lead("text").over(w), "next_tree": F.lead("tree").over(w)})
        .filter(~F.col("ghost"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter)))
        .withColumn("edited_tree", merkle(F.col("edited")))
        .select(
            "id",
            "text",
            "edited",
            "tree",
            "edited_tree",
            likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
            likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
            first_difference(F.col("tree"), F.col("edited_tree")).alias("first_edit"),
        )
    )
