"""Small string, number and date rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that count as reasoning levels (fixed values).
LEVELS = ("default", "none", "minimal", "low", "medium", "high", "xhigh")


def clean(c: Column) -> Column:
    """Trimmed text; missing is ''."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


#: White space at the ends of a text.
SPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def to_int(c: Column) -> Column:
    """Text or number to a long: whole values only ('12.0' is 12, '3.5' and 'true' are null)."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(d == F.floor(d), d.cast("long"))


def to_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def to_bool(c: Column) -> Column:
    """true/1/yes and false/0/no in text; anything else is null."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def iso_date(c: Column) -> Column:
    """Strict YYYY-MM-DD, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def slug(c: Column) -> Column:
    """File-name-safe text: other characters become one '_', none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def tag(c: Column) -> Column:
    """Lower-case words joined by '_'; 'unknown' if there are none."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, n)


def sample_id(run_id: Column, question: Column, label: Column, run_index: Column) -> Column:
    """run__question__model_hash__runN."""
    part = lambda c, default: F.coalesce(F.nullif(slug(c), F.lit("")), F.lit(default))
    return F.concat(part(run_id, "run"), F.lit("__"), question, F.lit("__"), part(label, "model"), F.lit("_"), short_hash(label, 10), F.lit("__run"), run_index.cast("string"))


def base_model(c: Column) -> Column:
    """Model name without its ``@reasoning=`` part."""
    return F.regexp_replace(c, r"@reasoning=[^@]+$", "")


def model_key(c: Column) -> Column:
    """Model name without reasoning part or level ending."""
    return F.regexp_replace(base_model(clean(c)), rf"(?i)-({'|'.join(LEVELS)})$", "")


def level_of(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"@reasoning=([^@]+)$", 1), F.lit("")), F.lit("default"))


def org_of(c: Column) -> Column:
    """The part before '/', with one organisation under its newer name."""
    org = F.when(c.contains("/"), F.split_part(c, F.lit("/"), F.lit(1))).otherwise(F.lit("unknown"))
    return modern_org(org)


def modern_org(c: Column) -> Column:
    return F.when(c == "meta-llama", "meta").otherwise(c)


def url_domain(c: Column) -> Column:
    """Authority of a URL in lower case (port included) without a leading 'www.'."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(c, F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")


def excerpt(c: Column, most: int = 140) -> Column:
    t = F.trim(F.regexp_replace(clean(c), r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 3)), F.lit("...")))


def unquoted(c: Column) -> Column:
    """Trimmed, without one pair of straight or curly double quotes."""
    t = strip(c)
    return F.when(t.rlike('(?s)^(".*"|“.*”)$') & (F.length(t) >= 2), strip(F.regexp_replace(t, r"(?s)^.(.*).$", "$1"))).otherwise(t)


def utc_time(c: Column) -> Column:
    """An ISO time; one without a zone counts as UTC. Anything else is null."""
    t = F.trim(c)
    zoned = F.when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), t).otherwise(F.concat(t, F.when(t.contains(":"), "Z").otherwise("T00:00:00Z")))
    return F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), zoned))


def first_time(*columns: Column) -> Column:
    """The first of several texts that is an ISO time."""
    return F.coalesce(*[utc_time(c) for c in columns])


def utc_text(c: Column) -> Column:
    """A time as text in UTC, to the second; missing is ''."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def variant_label(model: Column, level: Column) -> Column:
    """Base name and reasoning level as one label."""
    return F.concat(base_model(clean(model)), F.lit("@reasoning="), F.coalesce(F.nullif(clean(level), F.lit("")), F.lit("default")))


def variant_of(model: Column, level: Column) -> Column:
    """The variant of a normalised model name (see model_key); '' without a name."""
    key = model_key(model)
    return F.when(key == "", "").otherwise(F.concat(key, F.lit("@reasoning="), F.coalesce(F.nullif(clean(level), F.lit("")), F.lit("default"))))


def is_control(flag: Column, technique: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | (F.coalesce(technique, F.lit("")) == "control_legitimate")


def is_rate_limit(kind: Column, status: Column, error: Column) -> Column:
    text = F.lower(F.coalesce(error, F.lit("")))
    return F.coalesce(kind == "rate_limit", F.lit(False)) | F.coalesce(status == 429, F.lit(False)) | text.contains("http 429") | text.contains("rate limit")


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(408, 409, 425, 429) | status.between(500, 599), F.lit(False))


def error_kind(status: Column) -> Column:
    return F.when(status == 429, "rate_limit").when(status.isNotNull(), "api_error").otherwise("runtime_error")


def status_of(status: Column, error: Column) -> Column:
    given = F.nullif(F.lower(clean(status)), F.lit(""))
    return F.coalesce(given, F.when(clean(error) != "", "error").otherwise("ok"))


def benchmark_version(path: Column) -> Column:
    """v1 or v2 from a dataset's path, else a tag of its folder's name."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.element_at(F.split(p, "/"), -1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1), F.lit("")), F.regexp_replace(path, r"\.[^.]*$", ""))
    return F.when(p.contains("/data/v2/") | name.contains("v2"), "v2").when(p.contains("/data/latest/") | name.contains("v1"), "v1").otherwise(tag(folder))


def identity_defaults(columns: Sequence[str]) -> dict[str, Column]:
    """Identity columns of a row with older names as fallbacks; columns that the table lacks count as missing."""
    have = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    model = have("model")
    return {
        "model_id": F.coalesce(have("model_id"), model),
        "model_org": F.coalesce(have("model_org"), F.lit("unknown")),
        "model_name": F.coalesce(have("model_name"), have("model_id"), model),
        "model_reasoning_level": F.coalesce(have("model_reasoning_level"), F.lit("default")),
        "model_row": F.coalesce(have("model_row"), model),
    }


def redacted(c: Column) -> Column:
    """Local user paths replaced by a mark."""
    return F.regexp_replace(c, r"/Users/[^\s\"']+", "[local-path]")


def words_only(c: Column, joint: str = " ") -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", joint))


def model_specific(model_id: Column, context: Sequence[Column]) -> Column:
    """Whether the model's name occurs in the texts, spaced or run together."""
    tail = F.regexp_replace(model_id, r"^[^/]*/", "")
    text = F.concat_ws(" ", *context)
    spaced, compact = words_only(tail), words_only(tail, "")
    return (spaced == "") | words_only(text).contains(spaced) | words_only(text, "").contains(compact)
