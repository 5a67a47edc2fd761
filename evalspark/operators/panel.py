"""Judge panels: alignment of several judges' scores per sample and consensus over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.exact import half_up, quotient

#: Consensus scores are whole numbers of ten-thousandths.
UNIT = 10_000
# The wording of row errors.
MISSING = "Missing row for sample_id in this grade dir."
MISMATCH = "Identity mismatch across judge rows; consensus skipped for this sample."
NO_SCORES = "no_valid_scores"
TIE = "majority_tie:"
NO_TIEBREAK = "primary_disagreement_without_tiebreak"
TOO_FEW = "primary_tiebreak_requires_3_judges"
TIEBREAK_MISSING = "Synthetic tiebreaker row missing while primary judges disagreed."
TIEBREAK_IMPOSSIBLE = "Synthetic tiebreaker row could not assign score because primary judges had no valid score."


def align(grades: DataFrame, judges: int, identity: Sequence[str], key: str = "sample_id") -> DataFrame:
    """One row per sample: the identity columns of its first judge, ``mismatch`` and ``judges``.

    ``judges`` is an array, judge by judge, of (present, score, error). One shuffle, with partial aggregation; a sample
    that any judge has gets a row. A row of a judge appears once per sample (see integrity.duplicates).
    """
    who = F.struct(*identity)
    one = lambda k, c: F.max(F.when(F.col("judge_idx") == k, c))
    wide = grades.groupBy(key).agg(
        F.min_by(who, "judge_idx").alias("base"),
        (F.min(who) != F.max(who)).alias("mismatch"),
        *[one(k, F.lit(True)).alias(f"p{k}") for k in range(1, judges + 1)],
        *[one(k, F.col("score")).alias(f"s{k}") for k in range(1, judges + 1)],
        *[one(k, F.col("error")).alias(f"e{k}") for k in range(1, judges + 1)],
    )
    each = [F.struct(F.coalesce(f"p{k}", F.lit(False)).alias("present"), F.col(f"s{k}").alias("score"), F.when(F.col(f"p{k}").isNull(), MISSING).otherwise(F.coalesce(f"e{k}", F.lit(""))).alias("error")) for k in range(1, judges + 1)]
    return wide.select(key, "base.*", "mismatch", F.array(*each).alias("judges"))


def valid_score(judge: Column) -> Column:
    return F.when((judge["error"] == "") & judge["score"].isNotNull(), judge["score"])


def valid_scores(judges: Column) -> Column:
    """Scores of the judges that gave one without error, in judge order."""
    return F.array_compact(F.transform(judges, valid_score))


def total(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x)


def _majority(scores: Column) -> tuple[Column, Column]:
    count = lambda v: F.size(F.filter(scores, lambda x: x == v))
    most = F.array_max(F.transform(scores, count))
    winners = F.array_sort(F.array_distinct(F.filter(scores, lambda x: count(x) == most)))
    score = F.when(F.size(winners) == 1, F.element_at(winners, 1))
    return score, F.when(F.size(winners) > 1, F.concat(F.lit(TIE), F.array_join(winners.cast("array<string>"), ",")))


def _primary(judges: Column) -> tuple[Column, Column]:
    a, b, third = (valid_score(F.element_at(judges, k)) for k in (1, 2, 3))
    enough = F.size(judges) >= 3
    both = a.isNotNull() & b.isNotNull()
    score = F.when(both & (a == b), a).otherwise(F.coalesce(third, F.when(~both, F.coalesce(a, b))))
    error = F.when(both & (a != b) & third.isNull(), NO_TIEBREAK).when(score.isNull(), NO_SCORES)
    return F.when(enough, score), F.when(enough, error).otherwise(TOO_FEW)


#: Name to (score in ten-thousandths, error) of (judges, valid scores); add one to have a new method.
METHODS = {
    "mean": lambda j, s: (half_up(UNIT * total(s), F.size(s).cast("long")), F.lit(None).cast("string")),
    "majority": lambda j, s: (lambda r: (r[0].cast("long") * UNIT, r[1]))(_majority(s)),
    "min": lambda j, s: (F.array_min(s).cast("long") * UNIT, F.lit(None).cast("string")),
    "max": lambda j, s: (F.array_max(s).cast("long") * UNIT, F.lit(None).cast("string")),
    "primary_tiebreak": lambda j, s: (lambda r: (r[0].cast("long") * UNIT, r[1]))(_primary(j)),
}


def consensus(panel: DataFrame, method: str = "mean") -> DataFrame:
    """The panel with ``valid`` (scores used), ``c4`` (consensus in ten-thousandths), ``consensus_error``, ``status``
    and ``error``. An identity mismatch empties the scores, which primary_tiebreak alone does not read."""
    used = F.when(F.col("mismatch"), F.array().cast("array<int>")).otherwise(valid_scores(F.col("judges")))
    p = panel.withColumn("valid", used)
    c4, error = METHODS[method](F.col("judges"), F.col("valid"))
    none = F.lit(False) if method == "primary_tiebreak" else F.size("valid") == 0
    p = p.withColumns({"c4": F.when(~none, c4), "consensus_error": F.when(none, NO_SCORES).otherwise(error)})
    judge_errors = F.transform("judges", lambda j, i: F.when(j["error"] != "", F.concat(F.lit("judge_"), (i + 1).cast("string"), F.lit(": "), j["error"])))
    errors = F.array_compact(F.concat(judge_errors, F.array(F.when(F.col("mismatch"), MISMATCH), F.col("consensus_error"))))
    return p.withColumns({"status": F.when(F.size(errors) > 0, "error").otherwise("ok"), "error": F.array_join(errors, " | ")})


def bucket(c4: Column) -> Column:
    """Ten-thousandths to 0..3, halves up, clamped; null stays null (greatest alone would skip it)."""
    return F.when(c4.isNotNull(), quotient(2 * F.least(F.greatest(c4, F.lit(0).cast("long")), F.lit(3 * UNIT).cast("long")) + UNIT, F.lit(2 * UNIT).cast("long"))).cast("int")


def disagreements(panel: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """Samples that either judge has, where a score is invalid or missing or the two differ."""
    a, b = F.element_at("judges", first), F.element_at("judges", second)
    same = valid_score(a) == valid_score(b)
    return panel.filter((a["present"] | b["present"]) & ~F.coalesce(same, F.lit(False)))


def valid_and_different() -> Column:
    """The publish rule: both scores valid and not equal."""
    a, b = valid_score(F.element_at("judges", 1)), valid_score(F.element_at("judges", 2))
    return F.coalesce(a != b, F.lit(False))


def synthetic_tiebreaks(source: DataFrame, panel: DataFrame, rejudged: DataFrame) -> DataFrame:
    """A third judge's row for every source row: its own where it judged, else copied from the two that agree or the
    one that is there, else an error. ``rejudged``: sample_id, score, error of the subset it judged."""
    a, b = valid_score(F.element_at("judges", 1)), valid_score(F.element_at("judges", 2))
    both = a.isNotNull() & b.isNotNull()
    made = F.when(~both | (a == b), F.coalesce(a, b))
    error = F.when(both & (a != b), TIEBREAK_MISSING).when(
        a.isNull() & b.isNull(), TIEBREAK_IMPOSSIBLE
    )
    own = rejudged.select("sample_id", F.col("score").alias("own_score"), F.col("error").alias("own_error"), F.lit(True).alias("own"))
    joined = source.join(panel.select("sample_id", "judges"), "sample_id", "left").join(own, "sample_id", "left")
    mine = F.coalesce("own", F.lit(False))
    out_error = F.when(mine, F.coalesce("own_error", F.lit(""))).otherwise(F.coalesce(error, F.lit("")))
    return joined.select(*source.columns, F.when(mine, F.col("own_score")).otherwise(made).alias("judge_score"), out_error.alias("judge_error"), (~mine).alias("synthetic")).withColumn("status", F.when(F.col("judge_error") != "", "error").otherwise("ok"))
