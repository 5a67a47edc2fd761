"""JSON objects of damaged files, found by many tasks per file."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The state of the scan: how deep it is in objects, and whether in plain text, a string, or behind a string's backslash.
PLAIN, QUOTED, SKIP = 0, 1, 2
_MARKS = re.compile(r'["\\{}]')
_RAW = re.compile("[\n\r\t]")
_NAMES = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def stepped(depth: int, mode: int, mark: str, adjacent: bool, ground: bool) -> tuple[int, int]:
    """The state after one of the marks. ``adjacent``: no other character came since the last one. ``ground``: at depth 0
    strings and closing braces mean nothing; without it the depth is a change and may fall."""
    if mode == SKIP:
        if adjacent:
            return depth, QUOTED
        mode = QUOTED
    if mode == QUOTED:
        return depth, {'"': PLAIN, "\\": SKIP}.get(mark, QUOTED)
    if ground and depth == 0:
        return (1, PLAIN) if mark == "{" else (0, PLAIN)
    return depth + {"{": 1, "}": -1}.get(mark, 0), QUOTED if mark == '"' else PLAIN


class Group:
    """Scans that are in one state and so go on as one. A group that has joined another names it in ``to``."""

    __slots__ = ("to",)

    def __init__(self) -> None:
        self.to: Group | None = None

    def root(self) -> Group:
        g = self
        while g.to is not None:
            if g.to.to is not None:
                g.to = g.to.to
            g = g.to
        return g


class Depths:
    """Groups above depth 0 in one mode, the deepest first: they move together, so only ``shift`` changes."""

    def __init__(self) -> None:
        self.shift, self.items = 0, []

    def joined(self, other: Depths) -> Depths:
        """Both, the smaller put into the larger; groups of one depth become one."""
        few, many = (self, other) if len(self.items) < len(other.items) else (other, self)
        for k, g in few.items:
            k += few.shift - many.shift
            at = bisect.bisect_left(many.items, -k, key=lambda x: -x[0])
            if at < len(many.items) and many.items[at][0] == k:
                g.to = many.items[at][1]
            else:
                many.items.insert(at, (k, g))
        return many


class Transition:
    """What a stretch of text does to every state in which it could be met.

    ``far``: per mode, the change of depth and the mode at the end if the scan never comes back to depth 0. A stretch
    that can close d objects is met by less than that, too: ``near`` has, per mode and run of d (its last one), the group
    of a scan that is at depth 0 behind the brace that closes them. Scans that are in one state go on as one, so a mark
    costs the same however many objects came before it.
    """

    def __init__(self) -> None:
        self.far = {m: (0, m) for m in (PLAIN, QUOTED, SKIP)}
        self.least = dict.fromkeys(self.far, 0)
        self.near: dict[int, list[tuple[int, Group]]] = {m: [] for m in self.far}
        self.start = Group()
        self.ground: Group | None = self.start
        self.inside = {m: Depths() for m in self.far}

    def _meet(self, mode: int, d: int) -> None:
        """A scan that closed ``d`` objects since the stretch began joins those at depth 0."""
        runs = self.near[mode]
        if self.ground is None:
            self.ground = Group()
        while len(runs) > 1 and runs[-1][1].root() is runs[-2][1].root():
            runs[-2:] = [runs[-1]]
        if runs and runs[-1][1].root() is self.ground:
            runs.pop()
        runs.append((d, self.ground))

    def _move(self, mark: str, adjacent: bool) -> None:
        plain, quoted, skip, kept = *self.inside.values(), None
        if skip.items:
            if adjacent:
                kept = skip
            else:
                quoted = quoted.joined(skip)
            skip = Depths()
        if mark == '"':
            plain, quoted = quoted, plain
        elif mark == "\\":
            quoted, skip = skip, quoted
        elif mark == "{":
            plain.shift += 1
            if self.ground is not None:
                plain.items.append((1 - plain.shift, self.ground))
                self.ground = None
        else:
            plain.shift -= 1
            if plain.items and plain.items[-1][0] + plain.shift == 0:
                g = plain.items.pop()[1]
                if self.ground is None:
                    self.ground = g
                else:
                    g.to = self.ground
        self.inside = {PLAIN: plain, QUOTED: quoted.joined(kept) if kept else quoted, SKIP: skip}

    def take(self, text: str) -> None:
        last = -1
        for found in _MARKS.finditer(text):
            mark, adjacent = found[0], found.start() == last + 1
            last = found.start()
            self._move(mark, adjacent)
            for m, (depth, mode) in self.far.items():
                self.far[m] = depth, mode = stepped(depth, mode, mark, adjacent, False)
                if depth < self.least[m]:
                    self.least[m] = depth
                    self._meet(m, -depth)
        if last < len(text) - 1:  # a backslash has skipped the character behind it
            self.far = {m: (d, QUOTED if mode == SKIP else mode) for m, (d, mode) in self.far.items()}
            if self.inside[SKIP].items:
                self.inside = {PLAIN: self.inside[PLAIN], QUOTED: self.inside[QUOTED].joined(self.inside[SKIP]), SKIP: Depths()}

    def table(self) -> dict:
        state = {id(g): (k + x.shift, m) for m, x in self.inside.items() for k, g in x.items}
        if self.ground is not None:
            state[id(self.ground)] = (0, PLAIN)
        near = []
        for runs in self.near.values():
            ends: list[tuple] = []
            for d, g in runs:
                if ends and ends[-1][1:] == state[id(g.root())]:
                    ends.pop()
                ends.append((d, *state[id(g.root())]))
            near.append(ends)
        return {"far": list(self.far.values()), "least": list(self.least.values()), "start": state[id(self.start.root())], "near": near}


def after(table: dict, depth: int, mode: int) -> tuple[int, int, bool]:
    """The state behind a stretch met in a state, and whether the scan was at depth 0 in it or before it."""
    if depth == 0:
        return (*table["start"], True)
    if depth <= -table["least"][mode]:
        runs = table["near"][mode]
        return (*runs[bisect.bisect_left(runs, depth, key=lambda x: x[0])][1:], True)
    change, end = table["far"][mode]
    return depth + change, end, False


def pieces(text: str, depth: int, mode: int) -> tuple[list[tuple[str, bool, bool]], int, int]:
    """The parts of objects in a stretch met in a state (text with raw line ends and tabs in strings escaped, whether the
    object begins here, whether it ends here), and the state behind it."""
    out, at, part, begins = [], 0, [], depth == 0

    def copy(until: int) -> None:
        chunk = text[at:until]
        part.append(_RAW.sub(lambda x: _NAMES[x[0]], chunk) if mode != PLAIN else chunk)

    last = -1
    for found in _MARKS.finditer(text):
        i, mark = found.start(), found[0]
        adjacent, last = i == last + 1, i
        new = stepped(depth, mode, mark, adjacent, True)
        if depth:
            copy(i)
            part.append(mark)
        elif new[0]:
            part, begins = ["{"], True
        at = i + 1
        if depth and new[0] == 0:
            out.append(("".join(part), begins, True))
            part, begins = [], True
        depth, mode = new
    if depth:
        copy(len(text))
        out.append(("".join(part), begins, False))
    if mode == SKIP and last < len(text) - 1:
        mode = QUOTED
    return out, depth, mode


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path`` with the file and the split of it in which they lie; a split's lines stand
    together in one partition, in their order."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    for b in batches:
        edge = (b["file"] != b["file"].shift()) | (b["block"] != b["block"].shift())
        for _, part in b.groupby(edge.cumsum(), sort=False):
            yield (part["file"].iloc[0], int(part["block"].iloc[0])), part


def salvage_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per JSON object in the files under ``path``, however damaged they are: ``file``, ``block`` (the place in the
    file of the split where it begins), ``place`` (its place among those) and ``json``.

    Several objects may share a line and one may span lines and splits; raw line ends and tabs in strings are escaped;
    what lies between objects, and an object that the file's end cuts short, is left out. Every split is scanned by a
    task of its own for what it does to each state in which it could be met; these transitions are followed through each
    file, a row per split; then every split is cut with the state in which it is met, and parts of one object are joined.
    """

    def transitions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, scan = None, Transition()
        for k, part in _stretches(batches):
            if key not in (None, k):
                yield pd.DataFrame([(*key, json.dumps(scan.table()))], columns=["file", "block", "does"])
                scan = Transition()
            key = k
            for line in part["value"]:
                scan.take(line + "\n")
        if key is not None:
            yield pd.DataFrame([(*key, json.dumps(scan.table()))], columns=["file", "block", "does"])

    def followed(rows: pd.DataFrame) -> pd.DataFrame:
        depth, mode, begun, out = 0, PLAIN, -1, []
        for file, block, does in rows.sort_values("block")[["file", "block", "does"]].itertuples(index=False):
            out.append((file, block, depth, mode, begun))
            depth, mode, grounded = after(json.loads(does), depth, mode)
            begun = block if grounded else begun
        return pd.DataFrame(out, columns=["file", "block", "depth", "mode", "begun"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, depth, mode, begun, place, open_ = None, 0, PLAIN, -1, 0, []
        columns = ["file", "block", "place", "part", "json", "whole", "ends"]
        for k, part in _stretches(batches):
            out = []
            if k != key:
                if open_:
                    out.append((key[0], begun, place if begun == key[1] else -1, key[1], "".join(open_), False, False))
                first = part.iloc[0]
                key, depth, mode, begun, place, open_ = k, int(first["depth"]), int(first["mode"]), int(first["begun"]), 0, []
            for line in part["value"]:
                found, depth, mode = pieces(line + "\n", depth, mode)
                for text, begins, ends in found:
                    if begins:
                        begun = k[1]
                    open_.append(text)
                    if ends:
                        mine = begun == k[1]
                        out.append((k[0], begun, place if mine else -1, k[1], "".join(open_), mine, True))
                        place, open_ = place + mine, []
            yield pd.DataFrame(out, columns=columns)
        if open_:
            yield pd.DataFrame([(key[0], begun, place if begun == key[1] else -1, key[1], "".join(open_), False, False)], columns=columns)

    lines = _lines(spark, path)
    does = lines.mapInPandas(transitions, "file string, block long, does string")
    states = does.groupBy("file").applyInPandas(followed, "file string, block long, depth int, mode int, begun long")
    met = lines.join(F.broadcast(states), ["file", "block"])  # a row per split
    found = met.select("file", "block", "value", "depth", "mode", "begun").mapInPandas(cut, "file string, block long, place long, part long, json string, whole boolean, ends boolean")
    # parts of an object that spans splits: the first has its place, all name the split where it begins
    spanning = found.filter("not whole").groupBy("file", "block").agg(F.max("place").alias("place"), F.array_sort(F.collect_list(F.struct("part", "json"))).alias("xs"), F.bool_or("ends").alias("ends"))
    joined = spanning.filter("ends").select("file", "block", "place", F.array_join(F.transform("xs", lambda x: x["json"]), "").alias("json"))
    return found.filter("whole").select("file", "block", "place", "json").unionByName(joined)
