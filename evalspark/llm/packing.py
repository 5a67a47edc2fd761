"""Token packing with a bounded number of open windows per partition."""

from __future__ import annotations

import bisect
import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.arrow_text import strips, utf8
from evalspark.llm.common import stored

#: Tokens of a sequence; windows kept open per partition.
LENGTH, OPEN = 4096, 64
#: Words whose ids a worker remembers (twice as many at most); bytes of text handled at a time.
REMEMBERED, STRIP = 400_000, 1 << 20
#: How tokens that end a run of letters, a digit or a run of marks are written in the vocabulary; marks that follow words.
END, MARKS = "</w>", b".,!?;:|*$#%&)"
#: Partitions whose leftover windows are merged together.
MERGED = 64
PIECES = "id {0}, start long, length long, ids binary, doc_tokens long, sequence long, offset long, closed boolean"


def of_words(tokenizer: dict) -> bool:
    """Whether a tokenizer's definition is of the kind that WordIds takes apart: case folded, words split off by a pattern
    that drops white space, ends of words marked, nothing added around a text."""
    normal, split = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    steps = [x.get("type") for x in normal.get("normalizers", [normal])]
    first = split.get("pretokenizers", [split])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    by_words = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"[^\s" in pattern
    ends = tokenizer["model"].get("end_of_word_suffix") == END and not tokenizer.get("truncation") and not tokenizer.get("post_processor")
    return "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"} and by_words and ends


def ends_in_letter(core: bytes) -> bool:
    """Whether a letter or digit ends what stands before a word's marks; otherwise these and the marks may be one run to
    the tokenizer."""
    return core[-1:].isalnum() or (core[-1:] > b"\x7f" and core.decode("utf-8", "replace")[-1].isalnum())


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes, word by word.

    For tokenizers that treat white space as a mere separator, fold case, keep letters and punctuation apart and mark
    the end of a run (see END): a text's ids are its words' ids in turn. Unknown words of letters are encoded many at
    a time and parted at the marks. Texts with a mark that could begin a special token are encoded whole, and with any
    other kind of tokenizer all texts are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = of_words(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of ``words``. Those of letters are encoded many at a time, with or without the marks at their
        end; the others one by one, with their marks."""
        known = self.known
        letters, marked, rest = {}, [], []
        for w in words:
            c = w.rstrip(MARKS)
            if len(c) < len(w):
                if not ends_in_letter(c):
                    rest.append(w)
                    continue
                marked.append((w, c))
            if c not in known and c not in letters:
                if c.isalpha() or (not c.isascii() and c.decode("utf-8", "replace").isalpha()):
                    letters[c] = len(c) == len(w)
                elif len(c) == len(w):
                    rest.append(w)
            elif len(c) == len(w) and c in letters:
                letters[c] = True
        every = list(letters)
        for a in range(0, len(every), 2048):
            part = every[a : a + 2048]
            ids = np.frombuffer(self.encode([b" ".join(part).decode("utf-8", "replace")])[0], "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), (4 * cuts).tolist()
                known.update((w, raw[i:j]) for w, i, j in zip(part, [0, *at], at))
            else:
                rest.extend(w for w in part if letters[w])
        rest.extend(w for w, c in marked if c not in known)
        marks = list({w[len(c) :] for w, c in marked if c in known}.difference(known))
        single = [*rest, *marks]
        known.update(zip(single, self.encode([w.decode("utf-8", "replace") for w in single]), strict=True))
        known.update((w, known[c] + known[w[len(c) :]]) for w, c in marked if w not in known)

    def texts(self, raw: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self.encode([t.decode("utf-8", "replace") for t in raw])
        words = [None if b"<|" in t else t.lower().split() for t in raw]
        every = set().union(*(ws for ws in words if ws))
        unknown = every.difference(self.known)  # looks up what is in `every`; its keys would be walked as a whole
        if len(self.known) + len(unknown) > REMEMBERED:
            self.older, self.known = self.known, {}
            unknown = every
        again = unknown & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.learn(list(unknown - again))
        get = self.known.__getitem__
        return [self.encode([t.decode("utf-8", "replace")])[0] if ws is None else b"".join(map(get, ws)) for t, ws in zip(raw, words, strict=True)]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker: what a task has learnt serves the worker's later tasks."""
    return WordIds(path)


class OpenWindows:
    """Best-fit placement into at most ``most`` open windows of ``length`` tokens."""

    def __init__(self, first: int, length: int, most: int) -> None:
        self.next, self.length, self.most = first, length, most
        self.free: list[tuple[int, int]] = []  # (free tokens, sequence), ascending
        self.rows: dict[int, list[tuple]] = {}

    def full(self, row: tuple) -> Iterator[tuple]:
        """A piece that is a whole sequence."""
        yield (*row, self.next, 0, True)
        self.next += 1

    def place(self, size: int, row: tuple) -> Iterator[tuple]:
        """Put a piece into the fullest window it fits; yields the rows of windows that close thereby."""
        at = bisect.bisect_left(self.free, (size, -1))
        if at < len(self.free):
            free, sequence = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                yield from self.close(self.free.pop(0)[1], True)
            free, sequence = self.length, self.next
            self.next += 1
        self.rows.setdefault(sequence, []).append((*row, sequence, self.length - free))
        if free == size:
            yield from self.close(sequence, True)
        else:
            bisect.insort(self.free, (free - size, sequence))

    def close(self, sequence: int, closed: bool) -> Iterator[tuple]:
        yield from ((*r, closed) for r in self.rows.pop(sequence))

    def leftovers(self) -> Iterator[tuple]:
        for _, sequence in self.free:
            yield from self.close(sequence, False)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = LENGTH, open_windows: int = OPEN) -> DataFrame:
    """Pack every document's tokens, with ``end_id`` after them, into sequences of at most ``length``.

    Each partition keeps ``open_windows`` windows open: a document's whole multiples of ``length`` are sequences of
    their own, its rest goes best-fit into an open window, and the fullest window is emitted when none fits. What is
    left open at the end of the partitions is laid end to end, MERGED partitions at a time, and cut at ``length``.

    Returns pieces: ``id``, ``start`` (the document's tokens before it), ``length``, ``ids`` (little-endian 32-bit),
    ``doc_tokens``, ``sequence`` (a number, not gapless) and ``offset`` (in the sequence). Null and empty texts have
    the one token ``end_id``. Repeated rows are packed each on their own. Other columns are not carried.
    The pieces of the first pass are written once to the shared folder: packing depends on the order of arrival.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        windows = OpenWindows(TaskContext.get().partitionId() << 32, length, open_windows)
        out: list[tuple] = []
        held = 0
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence", "offset", "closed"])

        for batch in batches:
            id_type = batch.column("id").type
            keys = batch.column("id").to_pylist()
            data, offsets = utf8(batch.column("text"))
            for a, b in strips(offsets, STRIP):
                raw = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                for key, ids in zip(keys[a:b], words.texts(raw), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        row = (key, start, size, ids[4 * start : 4 * (start + size)], n)
                        out.extend(windows.full(row) if size == length else windows.place(size, row))
                    held += n
                if held > 1 << 20:
                    yield batch_of(out)
                    out, held = [], 0
        out.extend(windows.leftovers())
        if out:
            yield batch_of(out)

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES.format(kind)), "packed")
    left = pieces.filter(~F.col("closed"))
    group = F.shiftright("sequence", 32 + MERGED.bit_length() - 1)
    in_order = Window.partitionBy("group").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        left.groupBy("sequence")
        .agg(F.sum("length").alias("fill"))
        .withColumn("group", group)
        .select("sequence", "group", F.coalesce(F.sum("fill").over(in_order), F.lit(0)).alias("base"))
    )
    at = F.col("base") + F.col("offset")
    cut_at = (F.floor(at / length) + 1) * length - at
    part = lambda skip, size: F.struct(skip.cast("long").alias("skip"), size.cast("long").alias("size"))
    parts = F.when(F.col("length") <= cut_at, F.array(part(F.lit(0), F.col("length")))).otherwise(F.array(part(F.lit(0), cut_at), part(cut_at, F.col("length") - cut_at)))
    place = at + F.col("part.skip")
    merged = (
        left.join(base, "sequence")
        .withColumn("part", F.explode(parts))
        .select(
            "id",
            (F.col("start") + F.col("part.skip")).alias("start"),
            F.col("part.size").alias("length"),
            F.expr("substring(ids, cast(4 * part.skip + 1 as int), cast(4 * part.size as int))").alias("ids"),
            "doc_tokens",
            F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(F.shiftleft("group", 32)).bitwiseOR(F.floor(place / length)).alias("sequence"),
            (place % length).alias("offset"),
        )
    )
    return pieces.filter("closed").drop("closed").unionByName(merged)
