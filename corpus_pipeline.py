"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, mixing and packing of ``documents``.

Each stage works on all its predecessor kept; all but the last return the columns of documents. A stage's result is
written and read again as the next one's documents. Null ids and texts, repeated rows and an empty table pass through
every stage (see the operators); a text without words is a document like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import stored, table
from evalspark.llm.line_dedup import dedup_lines
from evalspark.llm.mixing import mix
from evalspark.llm.near_dup import keep_one
from evalspark.llm.packing import pack
from evalspark.llm.quality import fit_quality, score_quality
from evalspark.llm.queries import WEIGHTS, id_fold, mix_levels, packed_digest, tokenizer_path

#: Score from which a document stays.
GOOD = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network scores as good; those it rejects go."""
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_fold("doc_id", 3, 1))
    return score_quality(docs, model, score_col="quality_score").filter(F.col("quality_score") >= GOOD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document of nothing but repeats goes."""
    out = dedup_lines(docs).filter((F.col("lines_dropped") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of all tokens, by the target weights of the source tree; no document is taken twice."""
    return mix(docs, mix_levels(), WEIGHTS, max_epochs=1).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packed_digest(pack(docs, tokenizer_path()))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]

#: Learnt scores and sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
