"""Model inventories and strict judging of launch evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import clean, iso_date, model_key, model_specific, url_domain
from evalspark.operators.leaderboard import last_by

# Evidence that counts, and the wording of the judge's findings.
EVIDENCE_TYPES = ("announcement_blog", "newsroom", "docs_release_note", "changelog")
NO_DATE = "Missing proposed launch date."
BAD_DATE = "{} must be YYYY-MM-DD."
FUTURE_DATE = "{} cannot be in the future."
NO_URL = "Missing evidence_url."
NO_DOMAIN = "Missing evidence_domain (or parseable domain from evidence_url)."
FOREIGN_DOMAIN = ("Evidence domain '", "' is not first-party for org '", "'.")
NO_TITLE = "Missing evidence_title."
BAD_TYPE = "evidence_type must be one of: announcement_blog|newsroom|docs_release_note|changelog."
NO_PUBLISHED = "Missing evidence_published_date."
UNEQUAL_DATES = "proposed_launch_date must match evidence_published_date under strict policy."
NO_SNIPPET = "Missing supporting_snippet with key launch evidence."
NOT_SPECIFIC = "Evidence not model-specific enough; include explicit model name in title/snippet/url."
ACCEPTED = "Accepted: date and evidence pass strict checks."
NOT_JUDGED = "No judged row available."
NO_SOURCE = "No source row/evidence provided for this model yet."
CONFIDENCE = {"accepted": "0.95", "rejected": "0.90", "needs_retry": "0.60", "unresolved": "0.75"}


def inventory(observations: DataFrame) -> DataFrame:
    """Models seen in configuration, latest results or run history; ids without an organisation are left out."""
    seen = lambda s: F.bool_or(F.col("source") == s)
    return (
        observations.filter(F.col("model_id").contains("/"))
        .groupBy("model_id")
        .agg(
            F.first(F.split_part("model_id", F.lit("/"), F.lit(1))).alias("org"),
            seen("latest").alias("present_in_latest"),
            seen("config").alias("present_in_config"),
            seen("runs").alias("present_in_runs_history"),
            F.array_join(F.array_sort(F.collect_set("variant")), ";").alias("variants"),
            F.count_distinct("variant").alias("variant_count"),
        )
    )


def bucketed(models: DataFrame, collectors: Mapping[str, Sequence[str]], default: str) -> DataFrame:
    """Each model's collector by its organisation."""
    who = F.coalesce(*[F.when(F.col("org").isin(list(orgs)), F.lit(name)) for name, orgs in collectors.items()], F.lit(default))
    return models.withColumn("collector_agent", who)


def first_party(org: Column, domain: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """Whether the domain is one of the organisation's, or under it."""
    ok = F.lit(False)
    for name, domains in allowed.items():
        for d in domains:
            ok = ok | ((org == name) & ((domain == d) | domain.endswith(f".{d}")))
    return ok


def judge(rows: DataFrame, allowed: Mapping[str, Sequence[str]], as_of: str, max_attempts: int, attempt: Column | None = None) -> DataFrame:
    """Judge launch evidence by strict rules.

    Hard failures reject, missing things ask for a retry; what is not accepted is unresolved at the last attempt.
    Adds evidence_domain, judge_status, judge_reason (the first), required_fix (all) and judge_confidence.
    """
    today = F.lit(as_of).cast("date")
    t = {c: clean(F.col(c)) for c in ("model_id", "org", "proposed_launch_date", "evidence_url", "evidence_title", "evidence_published_date", "evidence_type", "supporting_snippet")}
    given = F.lower(clean(F.col("evidence_domain"))) if "evidence_domain" in rows.columns else F.lit("")
    domain = F.coalesce(F.nullif(given, F.lit("")), url_domain(t["evidence_url"]))
    proposed, published = iso_date(t["proposed_launch_date"]), iso_date(t["evidence_published_date"])

    def date_rules(name: str, text: Column, day: Column) -> tuple[list[Column], Column]:
        hard = F.when((text != "") & day.isNull(), BAD_DATE.format(name)).when(day > today, FUTURE_DATE.format(name))
        return [hard], text == ""

    hard_a, none_a = date_rules("proposed_launch_date", t["proposed_launch_date"], proposed)
    hard_b, none_b = date_rules("evidence_published_date", t["evidence_published_date"], published)
    foreign = F.when((domain != "") & ~first_party(t["org"], domain, allowed), F.concat(F.lit(FOREIGN_DOMAIN[0]), domain, F.lit(FOREIGN_DOMAIN[1]), t["org"], F.lit(FOREIGN_DOMAIN[2])))
    unequal = F.when(proposed != published, UNEQUAL_DATES)
    hard = F.array_compact(F.array(*hard_a, foreign, *hard_b, unequal))
    retry = F.array_compact(
        F.array(
            F.when(none_a, NO_DATE),
            F.when(t["evidence_url"] == "", NO_URL),
            F.when(domain == "", NO_DOMAIN),
            F.when(t["evidence_title"] == "", NO_TITLE),
            F.when(~t["evidence_type"].isin(*EVIDENCE_TYPES), BAD_TYPE),
            F.when(none_b, NO_PUBLISHED),
            F.when(t["supporting_snippet"] == "", NO_SNIPPET),
            F.when(~model_specific(t["model_id"], [t["evidence_url"], t["evidence_title"], t["supporting_snippet"]]), NOT_SPECIFIC),
        )
    )
    j = rows.withColumns({"evidence_domain": domain, "__hard": hard, "__retry": retry})
    status = F.when(F.size("__hard") > 0, "rejected").when(F.size("__retry") > 0, "needs_retry").otherwise("accepted")
    last = (attempt if attempt is not None else F.lit(1)) >= max_attempts
    j = j.withColumn("judge_status", F.when((status != "accepted") & last, "unresolved").otherwise(status)).withColumn("__all", F.concat("__hard", "__retry"))
    confidence = F.lit(None).cast("string")
    for name, text in CONFIDENCE.items():
        confidence = F.when(F.col("judge_status") == name, text).otherwise(confidence)
    reason = F.coalesce(F.get("__all", F.lit(0)), F.lit(ACCEPTED))
    return j.withColumns({"judge_reason": reason, "required_fix": F.array_join("__all", " | "), "judge_confidence": confidence}).drop("__hard", "__retry", "__all")


def attempts(rows: DataFrame, allowed: Mapping[str, Sequence[str]], as_of: str, max_attempts: int) -> DataFrame:
    """Every judged attempt: sources don't change within a run, so an accepted row has one attempt, others all."""
    first = judge(rows, allowed, as_of, max_attempts + 1)
    tries = F.sequence(F.lit(1), F.when(F.col("judge_status") == "accepted", 1).otherwise(max_attempts))
    again = first.withColumn("attempt_count", F.explode(tries))
    last = (F.col("judge_status") != "accepted") & (F.col("attempt_count") == max_attempts)
    return again.withColumns({"judge_confidence": F.when(last, CONFIDENCE["unresolved"]).otherwise(F.col("judge_confidence")), "judge_status": F.when(last, "unresolved").otherwise(F.col("judge_status"))})


def final_rows(tried: DataFrame) -> DataFrame:
    """The last attempt of every model's last source row."""
    return last_by(tried.withColumn("__o", F.struct("pos", "attempt_count")), ("model_id",), "__o").drop("__o")


def review(models: DataFrame, final: DataFrame) -> DataFrame:
    """Every inventory model with its outcome; models without a judged row are unresolved."""
    j = models.select("model_id", "org").join(final.drop("org"), "model_id", "left")
    date = F.when(F.col("judge_status") == "accepted", F.col("proposed_launch_date")).otherwise("")
    return j.select("model_id", "org", date.alias("launch_date"), F.coalesce("evidence_url", F.lit("")).alias("evidence_url"), F.coalesce("judge_status", F.lit("unresolved")).alias("judge_status"), F.coalesce("judge_reason", F.lit(NOT_JUDGED)).alias("judge_reason"))


def candidates(reviewed: DataFrame) -> DataFrame:
    return reviewed.filter(F.col("judge_status").isin("accepted", "unresolved"))


def canonical(final: DataFrame) -> DataFrame:
    """Accepted rows with a date and a url."""
    good = (F.col("judge_status") == "accepted") & (F.trim("proposed_launch_date") != "") & (F.trim("evidence_url") != "")
    return final.filter(good).select("model_id", "org", F.col("proposed_launch_date").alias("launch_date"), "evidence_url", "evidence_title", "evidence_published_date", "evidence_type", "judge_status")


def by_model(sources: DataFrame, order: str = "pos") -> DataFrame:
    """The last source row of every model, whose ids are compared without reasoning part and level ending."""
    named = sources.withColumn("model_id", model_key(F.col("model_id"))).filter("model_id <> ''")
    return last_by(named, ("model_id",), order)


def collected(models: DataFrame, sources: DataFrame, attempt: int, collected_at: str, order: str = "pos") -> DataFrame:
    """Every model (model_id, org, collector_agent) with its source row (see by_model) as far as there is one: missing
    texts are blank, a blank domain is the url's, and collector and time have defaults."""
    have = lambda c: clean(F.col(f"s.{c}")) if c in sources.columns else F.lit("")
    j = models.alias("m").join(by_model(sources, order).alias("s"), F.col("m.model_id") == F.col("s.model_id"), "left")
    url, domain, notes = have("evidence_url"), F.lower(have("evidence_domain")), have("notes")
    filled = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    return j.select(
        "m.model_id",
        "m.org",
        *[have(c).alias(c) for c in ("proposed_launch_date", "evidence_url", "evidence_title", "evidence_published_date", "evidence_type", "supporting_snippet")],
        F.when((domain == "") & (url != ""), url_domain(url)).otherwise(domain).alias("evidence_domain"),
        F.when((notes == "") & (url == ""), NO_SOURCE).otherwise(notes).alias("notes"),
        filled(have("collector_agent"), F.col("m.collector_agent")).alias("collector_agent"),
        filled(have("collected_at_utc"), F.lit(collected_at)).alias("collected_at_utc"),
        F.lit(attempt).alias("attempt_count"),
    )


def status_totals(final: DataFrame) -> DataFrame:
    """One row: accepted, unresolved and all models."""
    of = lambda name: F.count_if(F.col("judge_status") == name).alias(name)
    return final.agg(of("accepted"), of("unresolved"), F.count(F.lit(1)).alias("total"))


def sources_template(models: DataFrame) -> DataFrame:
    """A blank evidence row per model, with its collector."""
    blank = ("proposed_launch_date", "evidence_url", "evidence_domain", "evidence_title", "evidence_published_date", "evidence_type", "supporting_snippet", "notes")
    return models.select("model_id", "org", *[F.lit("").alias(c) for c in blank], "collector_agent")
