"""Batch model and judge calls, prompts, and parsing of what comes back."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import error_kind, is_retryable, strip
from evalspark.scratch import stored

# The wording of rows that cannot be graded.
SOURCE_ERROR = "Cannot grade response with source error: "
EMPTY_TEXT = "Cannot grade empty response_text."
BAD_SCORE = ("Invalid judge score ", " for this row; allowed scores: ")


def grading_error(source_error: Column, text: Column) -> Column:
    """Why a response cannot be graded; null if it can. Such rows stay, as error rows."""
    failed = F.coalesce(F.trim(source_error), F.lit("")) != ""
    empty = F.coalesce(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit("")) == ""
    return F.when(failed, F.concat(F.lit(SOURCE_ERROR), source_error)).when(empty, EMPTY_TEXT)


def score_error(score: Column, control: Column, hinted: bool = True) -> Column:
    """Why a judge's score is not allowed; null if it is. Controls take 0 and 3 (any score without the hint), other
    questions 0 to 2."""
    controls, others = ((0, 3) if hinted else (0, 1, 2, 3)), (0, 1, 2)
    listed = lambda xs: ",".join(map(str, xs))
    bad = ~F.when(control, score.isin(*controls)).otherwise(score.isin(*others))
    return F.when(bad, F.concat(F.lit(BAD_SCORE[0]), score.cast("string"), F.lit(BAD_SCORE[1]), F.when(control, listed(controls)).otherwise(listed(others))))


def rendered(template: Column, fields: Mapping[str, Column]) -> Column:
    """The template with ``{name}`` replaced literally, one field after the other: a value may bring in later names."""
    for name, value in fields.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return template


def messages(system: Column, user: Column) -> Column:
    """Request messages; without a system text there is only the user's."""
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.filter(F.array(one("system", system), one("user", user)), lambda m: (m["role"] == "user") | (F.coalesce(F.trim(m["content"]), F.lit("")) != ""))


def dry_response(question_id: Column, model: Column) -> Column:
    return F.concat(F.lit("DRY RUN response for question="), question_id, F.lit(" model="), model)


def dry_grade(control: Column, hinted: bool = True) -> Column:
    return F.when(control & F.lit(hinted), 3).otherwise(1)


def call(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], made: str = "response_text") -> DataFrame:
    """``rows`` with a text from ``fn`` (a batch's columns to texts) per row; a failing batch is tried row by row, and
    a failing row has the error's text in ``error``. Partitions bound how many calls run at once."""
    keep = [f for f in rows.schema if f.name not in (made, "error")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[f.name for f in keep]]
            try:
                yield batch.assign(**{made: list(fn(batch)), "error": ""})
            except Exception:  # noqa: BLE001
                texts, errors = [], []
                for i in range(len(batch)):
                    try:
                        texts.append(list(fn(batch.iloc[i : i + 1]))[0])
                        errors.append("")
                    except Exception as e:  # noqa: BLE001
                        texts.append("")
                        errors.append(f"{type(e).__name__}: {e}")
                yield batch.assign(**{made: texts, "error": errors})

    return rows.mapInPandas(run, T.StructType([*keep, T.StructField(made, T.StringType()), T.StructField("error", T.StringType())]))


def _failure(e: Exception) -> dict:
    """What a failed call tells: a client's error may carry ``status_code`` and ``retry_after_seconds``."""
    status = getattr(e, "status_code", None)
    return {"error": str(e) or type(e).__name__, "error_http_status": status, "error_retry_after_seconds": getattr(e, "retry_after_seconds", None)}


class _Budget:
    """Starts at most ``per_second`` calls a second; without a number it lets all pass."""

    def __init__(self, per_second: float | None):
        self.step, self.lock, self.next = 1 / per_second if per_second else 0.0, threading.Lock(), 0.0

    def wait(self) -> None:
        if self.step:
            with self.lock:
                at = max(time.monotonic(), self.next)
                self.next = at + self.step
            time.sleep(max(0.0, at - time.monotonic()))


#: Columns that answered adds to its rows.
ANSWER = "response_payload string, response_latency_ms long, error string, error_http_status int, error_retry_after_seconds double"


def answered(rows: DataFrame, ask: Callable[[dict], Mapping | str], workers: int = 4, per_second: float | None = None) -> DataFrame:
    """``rows`` with what ``ask`` (a row's columns to a payload, an object or its JSON text) gives for each: the payload
    as JSON, the milliseconds that the call took, and the error, HTTP status and waiting time of one that failed.

    ``workers`` calls of a task run at once, and a task starts ``per_second`` of them at most; rows come back in their
    order. How many tasks run is up to the partitions of ``rows``.
    """
    made = T.StructType.fromDDL(ANSWER)
    keep = [f for f in rows.schema if f.name not in made.names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        budget = _Budget(per_second)

        def one(row: dict) -> dict:
            budget.wait()
            start = time.perf_counter()
            try:
                payload = ask(row)
                out = {"response_payload": payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False), "error": ""}
            except Exception as e:  # noqa: BLE001
                out = _failure(e)
            return out | {"response_latency_ms": int((time.perf_counter() - start) * 1000)}

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                batch = batch[[f.name for f in keep]]
                got = pd.DataFrame(list(pool.map(one, batch.to_dict("records"))), columns=made.names, index=batch.index)
                yield pd.concat([batch, got.astype({"error_http_status": "Int32", "error_retry_after_seconds": "float64"})], axis=1)

    return rows.mapInPandas(run, T.StructType([*keep, *made]))


# The text and the warnings of answers without one.
EMPTY_ANSWER = "[Model returned an empty response.]"
FROM_REFUSAL = "response_text_fallback=message.refusal"
FROM_PLACEHOLDER = "response_text_fallback=empty_placeholder"
EMPTY_REASON = "empty_response_finish_reason="
TRUNCATED = "response_finish_reason=length (possible truncation)"


def collected(rows: DataFrame) -> DataFrame:
    """Responses from answered rows: ``response_text``, ``response_id``, ``response_usage`` (JSON), ``response_created``,
    ``response_finish_reason``, ``warnings`` and the error columns.

    A refusal stands in for an empty text, a placeholder for an empty answer, each with a warning; a payload without an
    answer is an error of its own.
    """
    t = model_text(rows.withColumnRenamed("error", "__call"), "response_payload")
    failed = F.coalesce(F.nullif(F.col("__call"), F.lit("")), F.col("error"), F.lit(""))
    at = lambda path: F.get_json_object("response_payload", path)
    empty, refused = F.col("text") == "", F.col("refusal") != ""
    text = F.when(~empty, F.col("text")).when(refused, F.col("refusal")).otherwise(EMPTY_ANSWER)
    reason = F.col("finish_reason")
    told = [F.when(empty & refused, FROM_REFUSAL), F.when(empty & ~refused, FROM_PLACEHOLDER), F.when(empty & ~refused, F.concat(F.lit(EMPTY_REASON), reason)), F.when(reason.isin("length", "max_output_tokens"), TRUNCATED)]
    out = t.withColumn("__failed", failed).withColumns(
        {
            "response_text": F.when(F.col("__failed") == "", text).otherwise(""),
            "response_id": F.coalesce(at("$.id"), F.lit("")),
            "response_usage": F.coalesce(at("$.usage"), F.lit("{}")),
            "response_created": F.coalesce(at("$.created"), at("$.created_at")),
            "response_finish_reason": F.when(F.col("__failed") == "", reason),
            "warnings": F.when(F.col("__failed") == "", F.array_compact(F.array(*told))).otherwise(F.array().cast("array<string>")),
            "error_kind": F.when(F.col("__failed") == "", "").otherwise(error_kind(F.col("error_http_status"))),
            "error_retryable": F.when(F.col("error_http_status").isNotNull(), is_retryable(F.col("error_http_status"))),
        }
    )
    return out.withColumn("error", F.col("__failed")).drop("__failed", "__call", "text", "refusal", "finish_reason", "response_payload")


def graded(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], most: int) -> DataFrame:
    """``rows`` with a judge's text (``raw``, see call) read by judged; rows whose text is empty or does not parse are
    asked again, ``most`` times at most. ``asked`` is the number of the last time, from 0.

    Every round's answers are stored, so no row is asked more often than that. What is empty at last scores 0.
    """
    columns, done = rows.columns, []
    for again in range(most + 1):
        answers = stored(judged(call(rows.withColumn("asked", F.lit(again)), fn, "raw").withColumnRenamed("error", "call_error")))
        settled = (F.coalesce(F.trim("raw"), F.lit("")) != "") & (F.col("error") == "") if again < most else F.lit(True)
        done.append(answers.filter(settled))
        rows = answers.filter(~settled).select(*columns)
    out = reduce(DataFrame.unionByName, done)
    return out.withColumn("error", F.when(F.col("call_error") != "", F.col("call_error")).otherwise(F.col("error"))).drop("call_error")


def first_object(text: Column) -> Column:
    """The first balanced JSON object in a text, quotes and escapes observed; null if there is none.

    From the first brace on, the text is cut behind every brace, quote and backslash, and these pieces are folded: how
    deep they stand, whether inside a string, whether after a backslash, and where the object ends.
    """
    rest = F.substr(text, F.nullif(F.instr(text, "{"), F.lit(0)))
    pieces = F.regexp_extract_all(rest, F.lit(r'[^{}"\\]*[{}"\\]'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("skip"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        mark, size = F.right(piece, F.lit(1)), F.length(piece)
        skipped = s["skip"] & (size == 1)
        opens, closes = ~skipped & ~s["quoted"] & (mark == "{"), ~skipped & ~s["quoted"] & (mark == "}")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        new = F.struct(
            depth.alias("depth"),
            F.when(~skipped & (mark == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (~skipped & s["quoted"] & (mark == "\\")).alias("skip"),
            (s["at"] + size).alias("at"),
            F.when(closes & (depth == 0), s["at"] + size).otherwise(0).alias("end"),
        )
        return F.when(s["end"] > 0, s).otherwise(new)

    end = F.aggregate(pieces, start, step)["end"]
    return F.when(end > 0, F.substr(rest, F.lit(1), end))


# Why a judge's output gives no score.
NO_OBJECT = "Judge output parse error. Expected strict JSON object with `score` and `justification`."
NO_SCORE = "Judge JSON `score` must be integer in {0,1,2,3}."
NO_REASON = "Judge JSON `justification` must be a non-empty string."


def judged(rows: DataFrame, text: str = "raw") -> DataFrame:
    """``score``, ``justification``, ``parse_mode`` and ``error`` of judge outputs.

    The first of these that is a JSON object counts: the text itself, a fenced block, the first balanced object in it. A
    JSON string is read once more (``parse_mode`` ends in ``_double_encoded``). Its score must be a whole number from 0 to
    3 (true and 2.0 are none) and its justification a text that is not blank. Empty output scores 0. The balanced object
    is looked for only where the others are no objects.
    """
    whole = strip(F.coalesce(F.col(text), F.lit("")))
    fence = strip(F.regexp_extract(whole, r"(?is)```(?:json)?\s*(.*?)\s*```", 1))

    def read(c: Column, mode: str) -> Column:
        v = F.try_parse_json(c)
        again = F.schema_of_variant(v) == "STRING"
        v = F.when(again, F.try_parse_json(strip(F.try_variant_get(v, "$", "string")))).otherwise(v)
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(F.when(again, f"{mode}_double_encoded").otherwise(mode).alias("mode"), v.alias("v")))

    found = F.coalesce(read(whole, "direct"), read(fence, "markdown_fence"), read(first_object(whole), "first_object"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("__p.v", path, "variant"))
    score, reason = F.try_variant_get("__p.v", "$.score", "int"), strip(F.try_variant_get("__p.v", "$.justification", "string"))
    good_score = F.coalesce((kind("$.score") == "BIGINT") & score.between(0, 3), F.lit(False))
    good_reason = F.coalesce((kind("$.justification") == "STRING") & (reason != ""), F.lit(False))
    empty = F.coalesce(strip(F.col(text)), F.lit("")) == ""
    error = F.when(empty, "").when(F.col("__p").isNull(), NO_OBJECT).when(~good_score, NO_SCORE).when(~good_reason, NO_REASON).otherwise("")
    out = rows.withColumn("__p", found).withColumn("__e", error)
    fine = F.col("__e") == ""
    return out.withColumns(
        {
            "score": F.when(empty, 0).when(fine, score),
            "justification": F.when(empty, "").when(fine, reason),
            "parse_mode": F.when(empty, "fallback_empty_judge_output").when(fine, F.col("__p.mode")).otherwise(""),
            "error": F.col("__e"),
        }
    ).drop("__p", "__e")


# The errors of payloads without an answer.
ERROR_PAYLOAD = "API returned error payload: "
NO_CONTENT = "API response missing both output and choices content."
BAD_CHOICE = "API response first choice is not an object."
BAD_MESSAGE = "API response choice.message is not an object."
NOT_JSON = "API response is not a JSON object."
#: JSON values that count as nothing.
NOTHING = ("null", "false", "0", "0.0", '""', "[]", "{}")


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _object(v: Column) -> Column:
    return _at(v, "$", "map<string,variant>")


def content_text(v: Column) -> Column:
    """The text of a message's content: a text trimmed, a list's parts with a text joined by line ends, null as ''."""
    texts = F.transform(F.filter(_at(v, "$", "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(_at(x, "$.text")) == "STRING", F.lit(False))), lambda x: _at(x, "$.text", "string"))
    return F.coalesce(strip(F.coalesce(F.array_join(texts, "\n"), _at(v, "$", "string"))), F.lit(""))


def model_text(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``text``, ``refusal``, ``finish_reason`` and ``error`` of model payloads in either of two shapes.

    Texts of the ``output`` messages come first, then the first choice's message. A payload that is no object, holds an
    error, or has neither output text nor a proper first choice has an error and no text. The finish reason is the status
    in lower case (of an ``incomplete`` one its reason, if it has one), else the first choice's.
    """
    v, none = F.col("__v"), F.lit("")
    output = F.coalesce(_at(v, "$.output", "array<variant>"), F.array().cast("array<variant>"))
    messages_ = F.filter(output, lambda m: F.coalesce(_at(m, "$.type", "string") == "message", F.lit(False)))
    parts = F.flatten(F.transform(messages_, lambda m: F.coalesce(_at(m, "$.content", "array<variant>"), F.array().cast("array<variant>"))))

    def joined(kind: str, field: str) -> Column:
        mine = F.filter(parts, lambda x: F.coalesce(_at(x, "$.type", "string") == kind, F.lit(False)))
        return strip(F.array_join(F.filter(F.transform(mine, lambda x: content_text(_at(x, f"$.{field}"))), lambda t: t != ""), "\n"))

    first = F.get(_at(v, "$.choices", "array<variant>"), F.lit(0))
    message = _at(first, "$.message")
    failure = F.to_json(_at(v, "$.error"))
    p = rows.withColumn("__v", F.try_parse_json(payload)).withColumns({"__out": joined("output_text", "text"), "__refused": joined("refusal", "refusal")})
    error = (
        F.when(_object(v).isNull(), NOT_JSON)
        .when(failure.isNotNull() & ~failure.isin(*NOTHING), F.concat(F.lit(ERROR_PAYLOAD), failure))
        .when(F.col("__out") != "", none)
        .when(F.coalesce(F.size(_at(v, "$.choices", "array<variant>")), F.lit(0)) <= 0, NO_CONTENT)
        .when(_object(first).isNull(), BAD_CHOICE)
        .when(message.isNotNull() & _object(message).isNull(), BAD_MESSAGE)
        .otherwise(none)
    )
    status, detail = F.lower(strip(_at(v, "$.status", "string"))), _at(v, "$.incomplete_details.reason", "string")
    reason = F.coalesce(F.when(status == "incomplete", detail), F.nullif(status, none), _at(first, "$.finish_reason", "string"))
    return p.withColumns(
        {
            "error": error,
            "text": F.when(error != "", none).when(F.col("__out") != "", F.col("__out")).otherwise(content_text(_at(message, "$.content"))),
            "refusal": F.when(F.col("__refused") != "", F.col("__refused")).otherwise(content_text(_at(message, "$.refusal"))),
            "finish_reason": reason,
        }
    ).drop("__v", "__out", "__refused")
