"""Chat texts from event logs: streamed deltas, edits and regenerations folded into messages and rendered with a loss
mask, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events, in the order in which those with one number count. All but a delta begin a message's text anew.
KINDS = ("message", "regenerate", "edit", "delta")
#: A turn is HEAD, the role, a line end, the text and END.
HEAD, END = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    """``text`` without a line that begins like a turn and without a turn's end: a backslash comes before the one and
    into the other, after those that stand there already, so that none is taken for one of ours."""
    return F.regexp_replace(F.regexp_replace(text, r"(^|\n)(\\*)### ", r"$1\\$2### "), r"<(\\*)/turn>", r"<\\$1/turn>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(^|\n)\\(\\*)### ", "$1$2### "), r"<\\(\\*)/turn>", "<$1/turn>")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (``conv``, ``message``, ``role``, ``text``) of a log of ``conv``, ``message`` (which one of the
    conversation; messages stand in the order of these), ``seq``, ``kind``, ``role`` and ``text``.

    By ``seq``, a ``message`` opens a message with a role and a first text, a ``delta`` adds to its text, an ``edit``
    replaces it, a ``regenerate`` empties it (or begins it with the event's text) and drops the later messages that were
    opened before. Only what follows a message's last opening counts. An event given twice counts once; different
    openings of one message with one number and kind are joined; a null ``seq`` comes first, a null text is empty, a
    message without a ``message`` event has a null role, events of other kinds are left out. Nulls of ``conv`` are a
    conversation, nulls of ``message`` its first message. Columns of other names are left out.

    A message's events are gathered by conversation and message, so a long conversation is folded by many tasks.
    """
    rank = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int")
    event = F.struct(F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    known = events.filter(F.col("kind").isin(*KINDS)).select("conv", "message", "role", event.alias("e"))
    at, kind = F.struct("e.seq", "e.rank"), lambda k: F.col("e.rank") == KINDS.index(k)
    folded = known.groupBy("conv", "message").agg(
        F.sort_array(F.collect_list("e")).alias("es"),
        F.max(F.when(~kind("delta"), at)).alias("opened"),
        F.max(F.when(kind("regenerate"), F.col("e.seq"))).alias("redone"),
        F.max_by("role", F.when(kind("message"), at)).alias("role"),
    )
    counts = lambda x, i: F.coalesce(F.struct(x["seq"], x["rank"]) >= F.col("opened"), F.lit(True)) & ((i == 0) | (x != F.get("es", i - 1)))
    text = F.array_join(F.transform(F.filter("es", counts), lambda x: x["text"]), "")
    above = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce("opened.seq", F.get("es", F.lit(0))["seq"])
    out = folded.select("conv", "message", "role", text.alias("text"), since.alias("since"), F.max("redone").over(above).alias("redone"))
    return out.filter("redone is null or since >= redone").select("conv", "message", "role", "text")


def render(messages: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """One chat text per conversation of ``conv``, ``message`` (their order), ``role`` and ``text`` (null: empty both):
    ``conv``, ``formatted`` and ``loss``, the places of the texts of the roles ``learn`` in it as ``start`` and
    ``length`` in UTF-8 bytes. Roles are URL-encoded, so they can hold anything. A conversation is one value.
    """
    head = F.concat(F.lit(HEAD), F.url_encode(F.coalesce("role", F.lit(""))), F.lit("\n"))
    p = messages.select("conv", "message", F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("learn"), head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    size = lambda c: F.octet_length(c).cast("long")
    above = Window.partitionBy("conv").orderBy("message", "head", "body").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size(F.col("head")) + size(F.col("body")) + F.lit(len(END))).over(above), F.lit(0)) + size(F.col("head"))
    turn = F.struct(start.alias("start"), size(F.col("body")).alias("length"), "learn", F.concat("head", "body", F.lit(END)).alias("text"))
    g = p.select("conv", turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t["learn"]), lambda t: F.struct(t["start"], t["length"]))
    return g.select("conv", F.array_join(F.transform("ts", lambda t: t["text"]), "").alias("formatted"), spans.alias("loss"))


def read_back(chats: DataFrame) -> DataFrame:
    """What chat texts hold: ``conv``, ``formatted``, ``turns`` (``role``, ``text``) and ``learnt``, the texts under the
    mask, all unescaped."""
    once = lambda x, use: F.element_at(F.transform(F.array(x), use), 1)  # noqa: E731  a lambda's variable is computed once

    def turn(x: Column) -> Column:
        return once(F.substring_index(x, "\n", 1), lambda line: F.struct(F.url_decode(F.substr(line, F.lit(len(HEAD) + 1))).alias("role"), unescaped(F.substr(x, F.length(line) + 2)).alias("text")))

    turns = once(F.split("formatted", END, -1), lambda xs: F.transform(F.slice(xs, 1, F.size(xs) - 1), turn))
    part = lambda raw: lambda s: unescaped(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))
    learnt = once(F.col("formatted").cast("binary"), lambda raw: F.transform("loss", part(raw)))
    return chats.select("conv", "formatted", turns.alias("turns"), learnt.alias("learnt"))


def turn_events(turns: DataFrame) -> DataFrame:
    """The log (see fold_events) as which finished turns (``conv_id``, ``turn``, ``role``, ``text``) would have come in.

    Answers are streamed in two deltas; of those at every third place a draft and the turn after it came first and went
    with a regeneration; other turns at every fourth place were half as long before an edit. Turns stand by ``turn``,
    then role and text; repeated rows are turns of their own.
    """
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    t = turns.select(F.col("conv_id").alias("conv"), at.alias("at"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    left, right = F.substr("text", F.lit(1), half), F.substr("text", half + 1)

    def event(k: int, kind: str, text: Column, role: Column = F.lit(None).cast("string"), later: int = 0) -> Column:
        return F.struct((F.col("at") + later).alias("message"), (F.col("at") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    none, role = F.lit(""), F.col("role")
    opened = event(0, "message", none, role)
    streamed = lambda k: [event(k, "delta", left), event(k + 1, "delta", right)]
    redone = F.array(opened, event(1, "delta", right), event(2, "message", left, F.lit("user"), 1), event(3, "regenerate", none), *streamed(4))
    edited = F.array(event(0, "message", left, role), event(1, "edit", F.col("text")))
    answer = F.when(F.col("at") % 3 == 0, redone).otherwise(F.array(opened, *streamed(1)))
    other = F.when(F.col("at") % 4 == 0, edited).otherwise(F.array(event(0, "message", F.col("text"), role)))
    return t.select("conv", F.explode(F.when(role == "assistant", answer).otherwise(other)).alias("e")).select("conv", "e.*")
