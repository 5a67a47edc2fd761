"""Readers and writers of evaluation files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import strip, unquoted
from evalspark.operators.integrity import require_empty
from evalspark.operators.order import numbered as placed_rows
from evalspark.sources.damaged import PLAIN, pieces


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; anything else fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; lines that are none are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def grade_set(spark: SparkSession, path: str, schema: T.StructType, judge_idx: int) -> DataFrame:
    """A judge's grades: at least one row, and one per sample."""
    rows = strict_jsonl(spark, path, schema)
    per = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    n, repeated = per.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max_by("sample_id", F.when(F.col("n") > 1, F.col("n")))).first()
    if not n:
        raise ValueError(f"no grades in {path}")
    if repeated is not None:
        raise ValueError(f"repeated samples in {path}: {repeated}")
    return rows.withColumn("judge_idx", F.lit(judge_idx))


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted CSV with a header; a missing file is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def run_history(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """All files of one name under ``root``, with the folder each row came from."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    return df.withColumn("run_id", F.element_at(F.split("_metadata.file_path", "/"), -2))


def objects_in(text: str) -> list[str]:
    """JSON objects of a damaged text: several on a line or one over many, raw line ends in strings escaped, what lies
    between them left out."""
    return [part for part, _, ends in pieces(text, 0, PLAIN)[0] if ends]


#: Characters of JSON that a task holds before it hands them on.
SALVAGED = 1 << 20


def salvaged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects in the texts of the last column, a row each, with the other columns and their places."""
    for batch in batches:
        texts, size = batch.column(batch.num_columns - 1), 0
        rows, places, found = [], [], []
        for r in range(len(batch)):
            objects = objects_in(texts[r].as_py() or "")
            rows.extend([r] * len(objects))
            places.extend(range(len(objects)))
            found.extend(objects)
            size += sum(map(len, objects))
            if rows and (size >= SALVAGED or r == len(batch) - 1):
                keys = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(places, pa.int64()), pa.array(found, pa.string())], names=[*batch.schema.names[:-1], "place", "json"])
                rows, places, found, size = [], [], [], 0


def salvaged(texts: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """A row per JSON object found in each text: ``keys``, its place and its JSON."""
    fields = [texts.schema[k] for k in keys]
    return texts.select(*keys, text).mapInArrow(salvaged_rows, T.StructType([*fields, T.StructField("place", T.LongType()), T.StructField("json", T.StringType())]))


QUESTION = "struct<id:string,question:string,nonsensical_element:string,domain:string,domain_group:string,difficulty:string,technique:string,is_control:boolean>"
BANK = f"techniques array<struct<technique:string,description:string,questions:array<{QUESTION}>>>"


def flat_questions(bank: DataFrame, techniques: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """Questions of a nested bank in order, without controls; the first ``limit`` if it is given."""
    t = bank.select(F.posexplode("techniques").alias("p1", "t")).filter(F.col("t.technique") != "control_legitimate")
    if techniques:
        t = t.filter(F.col("t.technique").isin(list(techniques)))
    q = t.select("p1", F.col("t.technique").alias("technique"), F.col("t.description").alias("technique_description"), F.posexplode("t.questions").alias("p2", "q"))
    q = q.filter(~F.coalesce("q.is_control", F.lit(False))).select("p1", "p2", "technique", "technique_description", "q.id", "q.question", "q.nonsensical_element", "q.domain")
    return q if limit is None else q.orderBy("p1", "p2").limit(limit)


def nested_bank(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """Questions nested by technique: ``technique``, ``part``, an ordered array of ``questions`` and its size
    (``question_count``). A row holds ``most`` questions at most: a larger technique goes on in further rows, whose
    ``part`` rises. The order is that of the columns beside the technique; questions that repeat are all kept."""
    rest = [c for c in rows.columns if c != "technique"]
    placed = placed_rows(rows, [F.col("technique"), *[F.col(f"`{c}`") for c in rest]], "__place")
    part = F.floor((F.col("__place") - 1) / most).cast("long").alias("part")
    one = F.struct("__place", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("q"))
    g = placed.groupBy("technique", part).agg(F.array_sort(F.collect_list(one)).alias("qs"))
    return g.select("technique", "part", F.transform("qs", lambda x: x["q"]).alias("questions"), F.size("qs").alias("question_count"))


def question_counts(rows: DataFrame) -> DataFrame:
    """Questions in all, by domain and by technique, in one pass."""
    g = rows.groupingSets([["domain"], ["technique"], []], "domain", "technique").agg(F.grouping("domain").alias("gd"), F.grouping("technique").alias("gt"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("gd") == 0, "domain").when(F.col("gt") == 0, "technique").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("domain", "technique", F.lit("")).alias("name"), "n")


# The sections of a draft, and the techniques that codes in headings stand for.
DOMAINS = ("legal", "medical", "software", "finance", "physics")
TECHNIQUES = {
    "L1": "jargon_soup",
    "L2": "wrong_relationship",
    "L3": "subtle_premise_violation",
    "pnf": "plausible_nonexistent_framework",
    "mm": "misapplied_mechanism",
    "af": "authoritative_framing",
    "fg": "false_granularity",
    "wua": "wrong_unit_of_analysis",
    "tce": "temporal_category_error",
    "rm": "reified_metaphor",
    "cds": "cross_domain_stitching",
    "st": "specificity_trap",
    "fa": "fabricated_authority",
    "scf": "sunk_cost_framing",
    "ce": "confident_extrapolation",
    "nn": "nested_nonsense",
}
# Fixed patterns: a draft's domain and technique headings and question ids, and the names of its fields.
DOMAIN_HEADING, TECHNIQUE_HEADING, QUESTION_ID = r"^##\s+([A-Z]+)$", r"^###\s+(L[123]|[a-z]{2,4})\s+[—\-]\s+(.+)$", r"^\*\*([a-z]+_(?:L[123]|[a-z]{2,4})_\d{2})\*\*$"
FIELDS = {"question": "Question:", "nonsensical_element": "What's wrong:", "domain": "Domain:"}


def markdown_bank(lines: DataFrame) -> DataFrame:
    """Questions of markdown drafts (``file``, ``n`` line number, ``line``), with what is wrong with each (``problem``).

    A domain heading and a technique heading (code and label) hold for the questions after them, a new domain has no
    technique yet; a heading ends the question before it. In a question a field goes on over plain lines until the next
    one; a value's quotes go where they stand around its first line; of a field that is given twice the last one counts.
    Lines that are none of these, and lines outside a question, are left out. Headings are carried by windows inside each
    file.
    """
    here = Window.partitionBy("file").orderBy("n")
    line = strip(F.coalesce("line", F.lit("")))
    mark = lambda pattern, k=1: F.nullif(F.regexp_extract("x", pattern, k), F.lit(""))
    c = lines.select("file", "n", line.alias("x")).filter("x <> ''")
    c = c.select("*", F.lower(mark(DOMAIN_HEADING)).alias("d"), mark(TECHNIQUE_HEADING).alias("t"), mark(TECHNIQUE_HEADING, 2).alias("l"), mark(QUESTION_ID).alias("q"))
    heading = F.col("d").isNotNull() | F.col("t").isNotNull()
    technique = F.when(F.col("d").isNotNull(), F.struct(F.lit("").alias("code"), F.lit("").alias("label"))).when(F.col("t").isNotNull(), F.struct(F.col("t").alias("code"), F.col("l").alias("label")))
    begun = F.lit(None).cast("string")
    for name, start in FIELDS.items():
        begun = F.when(F.col("x").startswith(start), name).otherwise(begun)
    run = F.when(heading | F.col("q").isNotNull(), F.struct(F.lit("").alias("field"), F.col("n").alias("since"))).when(begun.isNotNull(), F.struct(begun.alias("field"), F.col("n").alias("since")))
    fill = lambda c: F.last(c, ignorenulls=True).over(here)
    question = F.when(heading, F.struct(F.lit(-1).cast("long").alias("at"), F.lit("").alias("id"))).when(F.col("q").isNotNull(), F.struct(F.col("n").cast("long").alias("at"), F.col("q").alias("id")))
    held = c.select("file", "n", "x", F.col("q").isNotNull().alias("named"), heading.alias("heading"), fill("d").alias("group"), fill(technique).alias("technique"), fill(question).alias("question"), fill(run).alias("run"))
    body = held.filter(F.col("named") | (~F.col("heading") & (F.col("question.at") >= 0) & (F.col("run.field") != "")))
    value = F.col("x")
    for name, start in FIELDS.items():
        value = F.when((F.col("run.field") == name) & (F.col("run.since") == F.col("n")), unquoted(F.substr("x", F.lit(len(start) + 1)))).otherwise(value)
    facts = F.struct(F.coalesce("group", F.lit("")).alias("group"), "technique", "question.id")
    fields = body.groupBy("file", F.col("question.at").alias("at"), F.col("run.field").alias("field"), F.col("run.since").alias("since")).agg(
        F.max(F.when(F.col("named"), facts)).alias("facts"), F.array_sort(F.collect_list(F.when(~F.col("named"), F.struct("n", value.alias("v"))))).alias("vs")
    )
    fields = fields.withColumn("v", strip(F.array_join(F.filter(F.transform("vs", lambda y: y["v"]), lambda y: y != ""), " ")))
    per = fields.groupBy("file", "at").agg(F.max("facts").alias("f"), *[F.coalesce(F.max_by("v", F.when(F.col("field") == name, F.col("since"))), F.lit("")).alias(name) for name in FIELDS])
    names = F.create_map(*[F.lit(x) for pair in TECHNIQUES.items() for x in pair])
    code = F.coalesce("f.technique.code", F.lit(""))
    out = per.select("file", F.col("f.id").alias("id"), *FIELDS, F.col("f.group").alias("domain_group"), code.alias("difficulty"), F.coalesce("f.technique.label", F.lit("")).alias("difficulty_label"), F.coalesce(names[code], code).alias("technique"), F.lit(False).alias("is_control"))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(name) == "", name) for name in FIELDS])), ", ")
    problem = (
        F.when(~F.col("domain_group").isin(*DOMAINS), F.concat(F.lit("Question "), "id", F.lit(" is outside a known domain section.")))
        .when(F.col("difficulty") == "", F.concat(F.lit("Question "), "id", F.lit(" is outside a technique/level section.")))
        .when(missing != "", F.concat(F.lit("Incomplete question block for "), "id", F.lit(": missing "), missing))
    )
    return out.withColumn("problem", F.coalesce(problem, F.lit("")))


def sound_bank(questions: DataFrame) -> DataFrame:
    """The questions of markdown_bank without their problems; fails if there are any, or an id of several questions."""
    require_empty(questions.filter("problem <> ''").select("problem"), "draft")
    require_empty(questions.groupBy("id").count().filter("count > 1").select("id"), "repeated question ids")
    return questions.drop("problem")


def incomplete(questions: DataFrame) -> DataFrame:
    """Questions with a blank field, or an id of several questions; must be empty."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = blank("id") | blank("question") | blank("nonsensical_element") | blank("domain") | blank("technique")
    twice = questions.groupBy("id").count().filter("count > 1").select("id")
    return questions.filter(bad).select("id").unionByName(twice)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def append_events(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The named columns as text; missing values and columns are empty."""
    have = set(df.columns)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    df.select(*[cell(c).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# The columns of the two review exports.
COLLECT_REVIEW = [
    "status",
    "error",
    "sample_id",
    "model",
    "model_id",
    "model_org",
    "model_name",
    "model_provider",
    "model_reasoning_level",
    "model_row",
    "response_reasoning_effort",
    "run_index",
    "question_id",
    "technique",
    "is_control",
    "response_latency_ms",
    "response_prompt_tokens",
    "response_completion_tokens",
    "response_total_tokens",
    "response_reasoning_tokens",
    "response_cached_prompt_tokens",
    "response_cache_write_tokens",
    "response_cost_usd",
    "response_upstream_inference_cost_usd",
    "response_upstream_inference_prompt_cost_usd",
    "response_upstream_inference_completions_cost_usd",
    "response_usage_is_byok",
    "response_char_count",
    "response_tokens_per_second",
    "error_kind",
    "error_http_status",
    "error_retryable",
    "error_retry_after_seconds",
    "response_finish_reason",
    "warnings",
    "response_text",
]
GRADE_REVIEW = [
    "status",
    "error",
    "sample_id",
    "model",
    "model_id",
    "model_org",
    "model_name",
    "model_provider",
    "model_reasoning_level",
    "model_row",
    "response_reasoning_effort",
    "run_index",
    "question_id",
    "technique",
    "is_control",
    "judge_model",
    "judge_provider",
    "judge_score",
    "judge_justification",
    "source_response_error",
    "response_text",
]


def review_columns(df: DataFrame, columns: Sequence[str] = COLLECT_REVIEW) -> DataFrame:
    """Rows of a review export as texts: the columns (missing ones and values blank), warnings joined, and a status
    from the error."""
    kinds = {f.name: f.dataType for f in df.schema}
    failed = F.coalesce(F.trim("error"), F.lit("")) != "" if "error" in kinds else F.lit(False)

    def cell(c: str) -> Column:
        if c == "status":
            return F.when(failed, "error").otherwise("ok")
        if c not in kinds:
            return F.lit("")
        value = F.array_join(c, "; ") if isinstance(kinds[c], T.ArrayType) else F.col(c).cast("string")
        return F.coalesce(value, F.lit(""))

    return df.select(*[cell(c).alias(c) for c in columns])


def write_dataset(tables: dict[str, DataFrame], path: str, dimensions: dict[str, T.StructType] | None = None, spark: SparkSession | None = None) -> None:
    """Every table in a folder of its own; a dimension that is absent is written empty, with its columns."""
    spark = spark or next(iter(tables.values())).sparkSession
    absent = {n: spark.createDataFrame([], schema) for n, schema in (dimensions or {}).items() if n not in tables}
    for name, df in {**tables, **absent}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def dataset_files(spark: SparkSession, path: str) -> DataFrame:
    """The data files of a dataset folder (``table``, ``file`` below it, ``bytes``); their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    below = F.regexp_extract("path", r"/([^/]+/[^/]+)$", 1)
    return found.select(F.split_part(below, F.lit("/"), F.lit(1)).alias("table"), below.alias("file"), F.col("length").alias("bytes"))


def numbered(text: Column) -> Column:
    """Lines of a text as (n, line)."""
    return F.posexplode(F.split(text, "\n", -1))
