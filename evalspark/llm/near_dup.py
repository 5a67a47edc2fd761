"""Near-duplicate documents by order MinHash over word shingles, verified by banded alignment."""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.arrow_text import strips, utf8
from evalspark.llm.common import as_row, files_for, stored
from evalspark.llm.components import components

#: Words of a shingle; likeness from which documents are near-duplicates.
WORDS, LEAST = 5, 0.8
#: Sketches of a document, and how many must agree before a pair is compared. A sketch is the two smallest
#: occurrence-labelled shingles in text order: at likeness 0.8 two documents agree in it with probability 0.64, so a
#: pair is missed with a probability of 2e-6.
SKETCHES, AGREE = 16, 2
#: Bytes of text whose words are hashed at a time.
STRIP = 1 << 18
#: Most shingles that are put last in the order of prefixes for being common (a bounded list; it only saves work).
COMMON = 1 << 16
#: Nodes that share a prefix shingle up to which their pairs are joined; rows and bytes of half a block of a larger
#: group. Either way the same pairs are compared.
PAIRED, BLOCK, BLOCK_BYTES = 32, 512, 1 << 20
_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Order MinHash sketches of many texts at once."""

    def __init__(self, n: int = SKETCHES, words: int = WORDS, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        self.words = words
        self.multipliers = r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = r.integers(1, 1 << 63, n, dtype=np.uint64)
        letter = r.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        letter[65:91] = letter[97:123]
        self.letter, self.power = letter, np.ones(1, np.uint64)

    def word_hashes(self, part: np.ndarray, space: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the words of ``part``; a word also begins at each of the ascending ``edges``."""
        begins = ~space
        begins[1:] &= space[:-1]
        begins[edges] = ~space[edges]
        start = np.flatnonzero(begins)
        if not len(start):
            return start, np.zeros(0, np.uint64)
        place = np.arange(len(part)) - start[np.maximum(np.cumsum(begins) - 1, 0)]
        longest = int(place[~space].max()) + 1
        if len(self.power) < longest:
            self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(longest, _BASE, np.uint64)]))
        value = self.letter[part] * self.power[np.where(space, 0, place)]
        value[space] = 0
        return start, mixed(np.add.reduceat(value, start))

    def words_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words (runs without ASCII white space, A to Z folded) and each text's first word.

        Longer stretches are taken in pieces that end at white space.
        """
        part, ends = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        space = (part == 32) | ((part >= 9) & (part <= 13))
        gaps = np.flatnonzero(space) if len(part) > STRIP else np.zeros(0, int)
        starts, hashes, at = [np.zeros(0, int)], [np.zeros(0, np.uint64)], 0
        while at < len(part):
            gap = np.searchsorted(gaps, at + STRIP)
            until = int(gaps[gap]) if gap < len(gaps) else len(part)
            inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, until)] - at
            start, h = self.word_hashes(part[at:until], space[at:until], inner)
            starts.append(start + at)
            hashes.append(h)
            at = until
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrence-labelled shingle hashes in text order, and each text's first one. A text of fewer words than a
        shingle has one shingle; a text without words has none."""
        word, first = self.words_of(data, offsets)
        n_words = np.diff(first)
        n = np.where(n_words == 0, 0, np.maximum(1, n_words - self.words + 1))
        at = np.concatenate([[0], np.cumsum(n)])
        text = np.repeat(np.arange(len(n)), n)
        begin = np.arange(at[-1]) - at[text] + first[:-1][text]
        until = first[1:][text]
        h = np.zeros(at[-1], np.uint64)
        for j in range(self.words):
            k = begin + j
            there = k < until
            h = h * _BASE + np.where(there, word[np.minimum(k, len(word) - 1)], np.uint64(0)) if len(word) else h
        h = mixed(h)
        order = np.lexsort((h, text))
        same = np.zeros(len(h), bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
        place = np.arange(len(h))
        run = np.maximum.accumulate(np.where(same, 0, place))
        nth = np.empty(len(h), np.uint64)
        nth[order] = (place - run).astype(np.uint64)
        return mixed(h + nth * _M2), at

    def sketch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, sketches) and the number of shingles of each text; rows of texts without words mean nothing."""
        h, at = self.shingles(data, offsets)
        n = np.diff(at)
        full = np.flatnonzero(n)
        out = np.zeros((len(n), len(self.multipliers)), np.uint64)
        if len(full):
            starts, text = at[full], np.repeat(np.arange(len(full)), n[full])
            top = np.uint64(0xFFFFFFFFFFFFFFFF)
            for i, (a, salt) in enumerate(zip(self.multipliers, self.salts, strict=True)):
                x = h * a
                one = np.minimum.reduceat(x, starts)
                hit = x == one[text]
                x[hit] = top
                two = np.minimum.reduceat(x, starts)
                where_one, where_two = np.zeros(len(full), np.int64), np.zeros(len(full), np.int64)
                p = np.flatnonzero(hit)
                where_one[text[p]] = p
                p = np.flatnonzero(x == two[text])
                where_two[text[p]] = p
                lo, hi = h[np.minimum(where_one, where_two)], h[np.maximum(where_one, where_two)]
                out[full, i] = mixed(mixed(lo + salt) * _BASE + hi)
        return out, n


def banded_common(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence of ``a`` and ``b`` by matches within ``band`` of the diagonal.

    Where items seldom repeat, matches are threaded in order of ``b`` (a longest rising run); else see banded_bits.
    """
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    matches = [places.get(y, ()) for y in b]
    if sum(map(len, matches)) > 4 * (len(a) + len(b)):
        return banded_bits(a, b, band)
    tails: list[int] = []
    for j, found in enumerate(matches):
        for i in reversed(found):
            if abs(i - j) <= band:
                at = bisect.bisect_left(tails, i)
                if at == len(tails):
                    tails.append(i)
                else:
                    tails[at] = i
    return len(tails)


def banded_bits(a: list, b: list, band: int) -> int:
    """The same for items that repeat often.

    Bit-parallel: bit i of ``open_`` is 0 where place i of ``a`` ends a longer common subsequence; each item of ``b``
    updates only the bits of its band.
    """
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    n = len(a)
    open_ = (1 << n) - 1
    for j, y in enumerate(b):
        match = places.get(y)
        if not match:
            continue
        lo, hi = max(0, j - band), min(n, j + band + 1)
        if lo >= hi:
            continue
        mask = (1 << (hi - lo)) - 1
        window, match = (open_ >> lo) & mask, (match >> lo) & mask
        hit = window & match
        window2 = ((window + hit) | (window & ~match)) & mask
        open_ ^= (window ^ window2) << lo
    return n - open_.bit_count()


def shingle_list(text: bytes, words: int = WORDS) -> list:
    w = text.lower().split()
    return list(zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else [tuple(w)] if w else []


def aligned_likeness(a: bytes, b: bytes, least: float = LEAST) -> float:
    """Shingles that the best banded alignment has in common, over all shingles of both; 0 if it is under ``least``."""
    return list_likeness(shingle_list(a), shingle_list(b), least) if a != b else 1.0


def list_likeness(x: list, y: list, least: float) -> float:
    total = len(x) + len(y)
    if not x or not y:
        return float(x == y)
    needed = least * total / (1 + least)
    if min(len(x), len(y)) < needed - 1e-9:
        return 0.0
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    band = int(total - 2 * needed + 1e-9) + 1
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    # what both hold at all bounds every alignment
    if head + tail + (Counter(x) & Counter(y)).total() < needed - 1e-9:
        return 0.0
    common = head + tail + banded_common(x, y, band)
    return common / (total - common) if common >= needed - 1e-9 else 0.0


def overlaps(shingled: list[np.ndarray]) -> np.ndarray:
    """How many labelled shingles every two texts share, from products of 0/1 matrices."""
    n = len(shingled)
    every, text = np.concatenate(shingled), np.repeat(np.arange(n), [len(x) for x in shingled])
    token, column, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    text, column = text[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (first, first + 4096))
        x = np.zeros((n, 4096), np.float32)
        x[text[lo:hi], column[lo:hi] - first] = 1
        total += x @ x.T
    return total


def block_links(rows: DataFrame, least: float) -> DataFrame:
    """Links (``a``, ``b``) that join the classes of a block's nodes as far as likeness allows.

    ``rows`` (block, node, label, text, sketch, left, right) lie together by block. Shared shingles of all pairs are
    counted at once; only pairs that reach ``least`` thereby, agree in AGREE sketches and whose classes are not joined
    yet are aligned.
    """

    def links(block: pa.Table, sketcher: Sketcher) -> tuple[list[int], list[int]]:
        data, offsets = utf8(block.column("text").combine_chunks())
        node, label, left, right = (block.column(c).to_numpy() for c in ("node", "label", "left", "right"))
        sketch = block.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        parts, size = [], np.zeros(len(node), np.int64)
        for a, b in strips(offsets, STRIP):
            h, at = sketcher.shingles(data, offsets[a : b + 1])
            parts.extend(h[at[i] : at[i + 1]] for i in range(b - a))
            size[a:b] = np.diff(at)
        good = np.triu(overlaps(parts) * (1 + least) >= least * (size[:, None] + size[None, :]) - 1e-3, 1)
        good &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
        good &= label[:, None] != label[None, :]
        of = {x: x for x in label.tolist()}
        shingled: dict[int, list] = {}

        def root(x: int) -> int:
            while of[x] != x:
                of[x] = of[of[x]]
                x = of[x]
            return x

        def items(i: int) -> list:
            if i not in shingled:
                shingled[i] = shingle_list(data[offsets[i] : offsets[i + 1]].tobytes())
            return shingled[i]

        one, two = [], []
        for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            x, y = root(int(label[i])), root(int(label[j]))
            if x != y and np.count_nonzero(sketch[i] == sketch[j]) >= AGREE and list_likeness(items(i), items(j), least) >= least:
                of[x] = y
                one.append(int(node[i]))
                two.append(int(node[j]))
        return one, two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            one, two = links(pa.Table.from_batches(held), sketcher)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])

        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and hi > lo and held[0].column("block")[0].as_py() != block[lo]:
                    yield close()
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield close()

    return rows.mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (token, node, ...) of large groups, each in all blocks of its group's block pairs; together by block."""
    need = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)
    size = stored(rows.groupBy("token").agg(F.ceil(need).cast("int").alias("blocks")), "block_counts")
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int").alias("mine")
    each = rows.join(size, "token").select("*", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")).alias("block")
    placed = each.select(block, "node", "label", "text", "sketch", (F.col("mine") <= F.col("other")).alias("left"), (F.col("mine") >= F.col("other")).alias("right"))
    return placed.repartition("block").sortWithinPartitions("block", "node")


def identity(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes by which texts are taken as equal."""
    return F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")


def sketches(docs: DataFrame) -> DataFrame:
    """``id``, ``h`` and ``g`` (see identity), ``n`` (shingles) and ``sketch`` of each row of ``id``, ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows, sizes = np.empty((len(batch), SKETCHES), np.uint64), np.empty(len(batch), np.int64)
            for a, b in strips(offsets, STRIP):
                rows[a:b], sizes[a:b] = sketcher.sketch(data, offsets[a : b + 1])
            values = pa.array(rows.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * SKETCHES), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h", "g")), pa.array(sizes), lists], names=["id", "h", "g", "n", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, h long, g long, n long, sketch array<long>")


def _tokens(batch: pa.RecordBatch, sketcher: Sketcher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8(batch.column("text"))
    for a, b in strips(offsets, STRIP):
        h, at = sketcher.shingles(data, offsets[a : b + 1])
        yield a, b, h.view(np.int64), at


def common_shingles(texts: DataFrame, most: int = COMMON) -> list[tuple[int, int]]:
    """Up to ``most`` (labelled shingle, count) that occur most, as far as strips of rows show them more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in batches:
            for _, _, h, _ in _tokens(batch, sketcher):
                token, count = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token[count > 1]), pa.array(count[count > 1])], names=["token", "n"])

    counted = texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in counted.orderBy(F.col("n").desc(), "token").limit(most).collect()]


def prefixes(texts: DataFrame, common: list[tuple[int, int]], least: float) -> DataFrame:
    """The shingles of each text's prefix: ``node``, ``label``, ``token``, ``n`` (shingles of the text) and ``at`` (the
    shingle's place in the order).

    All texts order their shingles alike: first those not in ``common``, then by rising count. Two texts with likeness
    of at least ``least`` share a shingle among their first n - ceil(least * n) + 1, whatever that order is; this one
    keeps what many texts share out of the prefixes.
    """
    known = sorted(common)
    shared = texts.sparkSession.sparkContext.broadcast((np.array([t for t, _ in known], np.int64), np.array([n for _, n in known], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        token, count = shared.value
        for batch in batches:
            for a, b, h, at in _tokens(batch, sketcher):
                place = np.minimum(np.searchsorted(token, h), max(0, len(token) - 1))
                rank = np.where(token[place] == h, count[place], 0) if len(token) else np.zeros(len(h), np.int64)
                n = np.diff(at)
                text = np.repeat(np.arange(b - a), n)
                order = np.lexsort((h, rank, text))
                length = n - np.ceil(least * n - 1e-9).astype(np.int64) + 1
                place = np.arange(len(h)) - np.repeat(at[:-1], n)
                first = place < np.repeat(length, n)
                chosen = order[first]
                take = pa.array(text[chosen] + a)
                columns = [batch.column("node").take(take), batch.column("label").take(take), *map(pa.array, (h[chosen], n[text[chosen]], place[first]))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "token", "n", "at"])

    return texts.select("node", "label", "text").mapInArrow(run, "node long, label long, token long, n long, at long")


def may_reach(least: float) -> Column:
    """Whether two texts (``na``, ``nb`` shingles) that share the shingles at ``ata`` and ``atb`` of their orders, and
    none before them, can have enough in common: what they share lies at these places or behind them. Two texts whose
    likeness reaches ``least`` pass at the first shingle they share, though perhaps not at later ones. If that one's
    group is large, its blocks compare them."""
    behind = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    return behind >= (F.col("na") + F.col("nb")) * F.lit(least / (1 + least)) - F.lit(1e-6)


def agreeing(rows: DataFrame, least: float) -> DataFrame:
    """The pairs (``a`` < ``b``) of nodes of ``rows`` (token, node, label, n, at, sketch) that share a token, differ in label,
    may reach ``least`` and agree in AGREE sketches. All of it is the join's own condition, so that a group's pairs are
    counted off where they meet and only candidates leave the join."""
    side = lambda s: rows.select("token", *[F.col(c).alias(x) for c, x in (("node", s), ("label", f"l{s}"), ("n", f"n{s}"), ("at", f"at{s}"), ("sketch", f"s{s}"))])
    # written out: a lambda over both arrays would be interpreted for every pair
    agree = sum(((F.col("sa")[i] == F.col("sb")[i]).cast("int") for i in range(SKETCHES)), F.lit(0))
    return side("a").join(side("b"), "token").filter(F.expr("a < b and la <> lb") & may_reach(least) & (agree >= AGREE)).select("a", "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (``a``, ``b``) of nodes whose texts align with at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("text_a"), batch.column("text_b")
            good = [aligned_likeness(x[i].as_py().encode(), y[i].as_py().encode(), least) >= least for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good))], names=["a", "b"])

    side = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose numbers of shingles allow the likeness and that agree in enough sketches, with that number."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    agree: Column = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * least)
        .withColumn("agree", agree)
        .filter(F.col("agree") >= AGREE)
        .select("a", "b", "agree")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = LEAST) -> DataFrame:
    """One row per input row: ``id``, ``node`` (a number of its text), ``class_id`` (smallest id of its class), ``kept``.

    Rows are of one class when a chain of equal texts and of pairs with likeness of at least ``least`` joins them.
    Likeness: shingles of five words that a banded alignment has in common, over all shingles of both.

    Equal texts (by two hashes) are one node. Nodes that share a sketch meet in buckets. First every node is aligned
    with the bucket centre it agrees with most. Then the nodes of buckets that still hold several classes are compared
    between classes: an exact prefix filter groups them by rare shingles; in a group, small or large, the pairs that
    agree in AGREE sketches and whose shared shingles allow ``least`` are aligned. Large groups go block by block. So
    texts that merely share a passage make few pairs, a large group makes no pairs outside its blocks, and no pair that
    could join two classes is left out. Tables that a hot key meets are stored first, so that a skewed side of the join
    can be split.

    Null texts count as empty; empty texts are one class. Null ids never are a class's id unless it has no other (the
    class id is then null). ``kept`` is true for the row with the class's id (rows that repeat id and text: for each of
    them). Other columns are not carried.
    """
    return classes(docs, id_col, text_col, least).drop("h", "g")


def classes(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """near_duplicates with the hashes ``h`` and ``g`` of each row's text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), *identity(text))
    rows = stored(sketches(base), "sketches")
    n = rows.count()
    nodes = rows.groupBy("h", "g").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", n)
    keys = nodes.filter("n > 0").select("node", F.explode("sketch").alias("key"))
    buckets = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets", n * SKETCHES)
    shared = stored(keys.join(buckets, "key"), "shared", n * SKETCHES)
    # a bucket's centre is its node with the most company over all its buckets: the text that the others derive from
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    centres = stored(shared.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("most")).select("key", F.col("most.node").alias("a")), "centres", n * SKETCHES)
    members = stored(shared.join(centres, "key").select("key", "a", F.col("node").alias("b")), "members", n * SKETCHES)
    stars = members.filter("a <> b").select("a", "b").distinct()
    first = stored(_likely(stars, nodes, least).groupBy("b").agg(F.max(F.struct("agree", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "first", n)
    wanted = members.select(F.col("b").alias("node")).distinct().join(nodes.select("node", "id", "h", "g"), "node")
    wanted = wanted.select("node", F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("g").alias("__g"))
    one = base.join(wanted, (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g")) & F.col("id").eqNullSafe(F.col("__id")))
    texts = stored(one.groupBy("node").agg(F.first("text").alias("text")), "texts")
    # few rows come out of much work: they are dealt out once more, into few files
    few = lambda links: links.repartition(files_for(n))
    found = stored(few(verified(first, texts, least)), "links")
    label = components(found, n)
    placed = stored(members.select("key", F.col("b").alias("node")).join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "placed", n * SKETCHES)
    split = stored(placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"), "split", n * SKETCHES)
    open_ = placed.join(split, "key").select("node", "label").distinct().join(texts, "node")
    open_ = stored(open_.join(nodes.select("node", "sketch"), "node"), "open")
    tokens = stored(prefixes(open_, common_shingles(open_), least), "prefixes")
    m = tokens.count()
    mixed = stored(tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("token", "size"), "mixed", m)
    sides = stored(tokens.join(mixed, "token"), "sides", m)
    small = stored(sides.filter(F.col("size") <= PAIRED).join(open_.select("node", "sketch"), "node"), "small", m)
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(few(verified(agreeing(small, least).join(tried, ["a", "b"], "left_anti"), texts, least)), "links")
    large = sides.filter(F.col("size") > PAIRED).select("token", "node").join(open_, "node")
    more = pairs.unionByName(stored(few(block_links(in_blocks(large), least)), "links"))
    label = components(found.unionByName(more), n)
    named = nodes.join(label, "node", "left").select("h", "g", "node", F.coalesce("label", "node").alias("label"))
    classed = stored(rows.select("id", "h", "g").join(named, ["h", "g"]).select("id", "h", "g", "node", "label"), "classed", n)
    first_row = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("keeper")
    of_class = stored(classed.groupBy("label").agg(first_row), "classes", n)
    kept = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("node") == F.col("keeper.node"))
    return classed.join(of_class, "label").select("id", "h", "g", "node", F.col("keeper.id").alias("class_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least: float = LEAST) -> DataFrame:
    """``docs`` with one row left of each class of near_duplicates: the one with the smallest id.

    Of rows that repeat that id and text, one stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keepers = classes(docs, id_col, text_col, least).filter("kept").select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("g").alias("__g")).distinct()
    h, g = identity(text)
    rows = docs.select(as_row(docs).alias("row"), F.col(id_col).alias("__id"), h.alias("__h"), g.alias("__g"))
    same = rows["__id"].eqNullSafe(keepers["__id"]) & (rows["__h"] == keepers["__h"]) & (rows["__g"] == keepers["__g"])
    return rows.join(keepers, same, "left_semi").dropDuplicates(["__id", "__h", "__g"]).select("row.*")
