"""Near-duplicate lines over a corpus by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import as_row, stored
from evalspark.llm.near_dup import mixed

#: Lines of fewer characters must be equal to be repeats by default; from here on one edit is allowed.
SHORT = 12
#: Ratio of neighbouring length classes; parts of a line in the two blocking passes.
RATIO, COARSE, FINE = 1.125, 2, 8
#: What counts as white space.
SPACES = " \t\n\v\f\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(line: Column) -> Column:
    """What is compared: lower case, white space runs as one space, trimmed."""
    low = F.lower(line)
    # most lines hold single spaces only: a search for bytes costs far less than the pattern, which matches nowhere
    spaced = low.contains("  ")
    for c in SPACES[1:]:
        spaced |= low.contains(c)
    return F.trim(F.when(spaced, F.regexp_replace(low, r"\s{2,}|[^\S ]", " ")).otherwise(low))


def blank(line: Column) -> Column:
    """Whether nothing is left of the normal form, without making it."""
    return F.ltrim(line, F.lit(SPACES)) == ""


def length_class(n: Column) -> Column:
    """The class of a length. Lines whose lengths differ by one share a class of n or n-1."""
    return F.floor(F.log(n.cast("double")) / float(np.log(RATIO))).cast("int")


def block_keys(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with ``keys`` of their ``line``, such that any two lines within one edit share one: all but one of
    ``parts`` pieces, the first ones counted from the line's start and the others from its end. With each key, the places
    [lo, hi) that it leaves open.

    Written out instead of as a lambda over the classes, which Spark would interpret for every line.
    """
    n, kept = F.col("__n"), [F.col(f"`{c}`") for c in rows.columns]
    sized = rows.select(*kept, F.length("line").alias("__n"))
    sized = sized.select(*kept, n, length_class(n).alias("__c0"), F.when(n > 1, length_class(n - 1)).alias("__c1"))
    size = lambda c: F.floor(F.floor(F.pow(F.lit(RATIO), F.col(c).cast("double"))) / parts).cast("int")
    sized = sized.select(*kept, n, "__c0", "__c1", size("__c0").alias("__p0"), size("__c1").alias("__p1"))

    def of(c: str, piece: Column) -> Column:
        one = lambda i: F.struct(
            F.xxhash64(c, F.lit(i), F.substring("line", F.lit(1), piece * i), F.substring("line", n - piece * (parts - 1 - i) + 1, piece * (parts - 1 - i))).alias("key"),
            (piece * i).alias("lo"),
            (n - piece * (parts - 1 - i)).alias("hi"),
        )
        return F.array(*[one(i) for i in range(parts)])

    first = of("__c0", F.col("__p0"))
    return sized.select(*kept, F.when(F.col("__c1") != F.col("__c0"), F.concat(first, of("__c1", F.col("__p1")))).otherwise(first).alias("keys"))


def deletion_variants(lines: DataFrame) -> DataFrame:
    """Hashed variants of each line (``at``, ``line``, ``spans``): itself (``place`` -1) and, for every place in its
    spans, the line without the character there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("line"), batch.column("spans")
            for begin in range(0, len(batch), 256):
                rows, hashes, places = [], [], []
                for r in range(begin, min(begin + 256, len(batch))):
                    c = np.frombuffer(texts[r].as_py().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
                    n = len(c)
                    power = np.full(n + 1, _BASE, np.uint64)
                    power[0] = 1
                    power = np.multiply.accumulate(power)
                    head = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * power[:n], dtype=np.uint64)])
                    inside = np.zeros(n, bool)
                    for s in spans[r].as_py():
                        inside[max(0, s["lo"]) : s["hi"]] = True
                    at = np.flatnonzero(inside)
                    back = np.uint64(pow(int(_BASE), -1, 1 << 64))
                    without = head[at] + (head[n] - head[at + 1]) * back
                    h = np.append(without + np.uint64(n - 1) * _BASE, head[n] + np.uint64(n) * _BASE)
                    rows.append(np.full(len(h), r))
                    hashes.append(mixed(h).view(np.int64))
                    places.append(np.append(at, -1))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column("at").take(take), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places).astype(np.int32))], names=["at", "variant", "place"])

    kind = lines.schema["at"].dataType.simpleString()
    return lines.mapInArrow(run, f"at {kind}, variant long, place int")


def with_lines(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the text's lines: as a lambda's variable they are split once, however often they are used."""
    return F.element_at(F.transform(F.array(F.split(text, "\n", -1)), use), 1)


def without(lines: Column, drop: Column) -> Column:
    """``lines`` but those at the ascending places ``drop``: the slices between these places."""

    def pieces(d: Column) -> Column:
        start = lambda k: F.when(k == 0, 0).otherwise(F.get(d, k - 1) + 1)
        return F.transform(F.sequence(F.lit(0), F.size(d)), lambda k: F.slice(lines, start(k) + 1, F.coalesce(F.get(d, k), F.size(lines)) - start(k)))

    return F.flatten(F.element_at(F.transform(F.array(drop), pieces), 1))


def repeated_lines(docs: DataFrame, short: int) -> DataFrame:
    """``id``, ``node`` and ``drop`` (ascending line numbers) of the rows of ``id``, ``node``, ``text`` with repeats."""
    each = docs.select("id", "node", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    each = each.filter(~blank(F.col("raw"))).select(F.struct("id", "node", "pos").alias("at"), normal(F.col("raw")).alias("line"))
    coarse = F.when(F.length("line") >= short, F.col("keys")["key"]).alias("keys")
    seen = stored(block_keys(each, COARSE).select("at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), coarse), "lines")
    n = seen.count()
    distinct = stored(seen.groupBy("h", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"), F.first("keys").alias("keys")), "distinct_lines", n)

    keys = distinct.filter("keys is not null").select("first", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").count().filter("count > 1").select("key")
    near = keys.join(shared, "key").select("first").distinct()
    by_doc = near.groupBy("first.id", "first.node").agg(F.collect_list("first.pos").alias("places"))
    wanted = with_lines(F.col("text"), lambda lines: F.transform("places", lambda i: F.struct(i.alias("pos"), F.get(lines, i).alias("raw"))))
    lines = docs.join(by_doc, docs["id"].eqNullSafe(by_doc["id"]) & (docs["node"] == by_doc["node"])).select(docs["id"], docs["node"], F.explode(wanted).alias("x"))
    lines = lines.select(F.struct("id", "node", F.col("x.pos").alias("pos")).alias("at"), normal(F.col("x.raw")).alias("line")).dropDuplicates(["at"])
    lines = stored(lines, "near_lines", n)

    fine = block_keys(lines, FINE).select("at", F.explode("keys").alias("k")).select("at", "k.*")
    shared = fine.groupBy("key").count().filter("count > 1").select("key")
    spans = fine.join(shared, "key").groupBy("at").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    variants = stored(deletion_variants(lines.join(spans, "at")), "variants")
    cut = variants.filter("place >= 0")
    best = cut.groupBy("variant", "place").agg(F.min("at").alias("witness"))
    same_place = cut.join(best, ["variant", "place"]).filter("witness < at").select("at", "witness")
    whole = variants.filter("place < 0").select("variant", F.col("at").alias("other"))
    inserted = cut.join(whole, "variant").select(F.greatest("at", "other").alias("at"), F.least("at", "other").alias("witness")).filter("witness < at")
    pairs = same_place.union(inserted).distinct()
    side = lambda c: lines.select(F.col("at").alias(c), F.col("line").alias(f"{c}_line"))
    distance = F.levenshtein("at_line", "witness_line", 1)
    late = pairs.join(side("at"), "at").join(side("witness"), "witness").filter(distance.between(0, 1)).select(F.col("at").alias("first")).distinct()

    known = distinct.join(late.withColumn("late", F.lit(True)), "first", "left").filter("rows > 1 or late").select("h", "g", "first", "late")
    gone = seen.select("at", "h", "g").join(known, ["h", "g"]).filter(F.col("late").isNotNull() | (F.col("at") != F.col("first")))
    return gone.groupBy("at.id", "at.node").agg(F.array_sort(F.collect_set("at.pos")).alias("drop"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, short: int = SHORT) -> DataFrame:
    """``df`` with every line left out of its text that repeats an earlier line of any row, and ``lines_dropped``.

    Lines are compared in normal form (see normal). A line goes if an equal line, or (from ``short`` characters on) a line
    within one insertion, deletion or substitution, comes earlier: in ascending id, then text hash, then place. Blank
    lines stay. The order does not depend on what was dropped: a line goes also if the earlier one goes too.

    Method: equal lines are one line. Two lossless blocking passes (see block_keys) leave the lines, and the places in
    them, that could be within one edit of another line. For those all deletion variants are emitted as hashed keys
    and equal variants joined, each place with its earliest line, so no group of lines makes all its pairs; the edit
    distance of what meets is verified.

    Null texts stay null, empty ones empty. Rows that repeat both id and text are treated as one and keep the same
    lines. ``text_col`` is replaced; ``lines_dropped`` wins over a column of that name; other columns stay.
    """
    text = F.col(text_col)
    node = F.xxhash64(F.coalesce(text, F.lit("")))
    docs = df.select(F.col(id_col).alias("id"), node.alias("node"), text.alias("text")).filter("text is not null")
    drops = repeated_lines(docs, short).select(F.col("id").alias("__id"), F.col("node").alias("__node"), "drop")
    rows = df.select(as_row(df).alias("row"), F.col(id_col).alias("__id"), node.alias("__node"), text.alias("__text"))
    joined = rows.join(drops, rows["__id"].eqNullSafe(drops["__id"]) & (rows["__node"] == drops["__node"]), "left")
    kept = F.array_join(with_lines(F.col("__text"), lambda lines: without(lines, F.col("drop"))), "\n")
    new = F.when(F.col("drop").isNull(), F.col("__text")).otherwise(kept)
    columns = [new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c.lower() != "lines_dropped"]
    return joined.select(*columns, F.coalesce(F.size("drop"), F.lit(0)).alias("lines_dropped"))
