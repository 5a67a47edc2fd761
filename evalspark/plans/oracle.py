"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

from evalspark.views import DOMAIN_NAMES, LEVEL_NAMES

SQL: dict[str, str] = {}


def _list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def ratio(num: str, den: str, places: int = 4) -> str:
    s = 10**places
    return f"((2 * {s} * ({num})::bigint + ({den})::bigint) // nullif(2 * ({den})::bigint, 0)) / {s}.0::double"


RESPONSES = f"""
responses as (
    select doc_id as pos, 's' || doc_id as sample_id,
        'org' || (doc_id % 20 % 5) || '/m' || (doc_id % 20) as model_id,
        model_id || case when doc_id % 4 = 3 then '' else '@reasoning=' || {_list(LEVEL_NAMES)}[doc_id % 20 % 4 + 1] end as model,
        case when doc_id % 50 = 7 then '' when doc_id % 6 = 0 then 'alt' else 'org' || (doc_id % 20 % 5) end as model_org,
        {_list(LEVEL_NAMES)}[doc_id % 20 % 4 + 1] as model_reasoning_level,
        (1 + (doc_id // 20) % 3)::int as run_index, 'q' || (doc_id // 20) as question_id, 'tech' || ((doc_id // 20) % 13) as technique,
        {_list(DOMAIN_NAMES)}[(doc_id // 20) % 5 + 1] as domain, (doc_id // 20) % 11 = 0 as is_control,
        text as response_text, n_chars, case when doc_id % 37 = 0 then 'HTTP 429 rate limit' else '' end as error
    from documents)"""

GRADES = (
    RESPONSES
    + """,
raws as (
    select r.*, case when toxic = 1 then 0 when quality = 1 then 2 when quality = 0 then 1 else n_chars % 3 end as r1,
        (n_chars + pos) % 3 as r2, (7 * n_chars + pos) % 3 as r3
    from responses r left join labels l on r.pos = l.doc_id),
grades as (
    select pos, sample_id, model, model_id, model_org, question_id, technique, domain, is_control, k as judge_idx, 'judge' || k as judge_model,
        case when k = 2 and pos % 41 = 0 then run_index + 1 else run_index end as run_index,
        case when k = 3 and pos % 29 = 0 then null when is_control then 3 * (r % 2) else r end::int as score,
        case when k = 3 and pos % 29 = 0 then 'parse' else '' end as error
    from (select *, unnest([1, 2, 3]) as k, unnest([r1, r2, r3]) as r from raws) where not (k = 2 and pos % 23 = 0))"""
)

PANEL = (
    GRADES
    + """,
panel as (
    select pos, sample_id, model, question_id, technique, domain, is_control, min_by(run_index, judge_idx)::int as run_index,
        min(run_index) <> max(run_index) as mismatch,
        max(score) filter (where judge_idx = 1) as s1, max(score) filter (where judge_idx = 2) as s2, max(score) filter (where judge_idx = 3) as s3,
        case when count(*) filter (where judge_idx = 2) = 0 then 'Missing row for sample_id in this grade dir.' else '' end as e2,
        coalesce(max(error) filter (where judge_idx = 3), '') as e3
    from grades group by all),
valid as (select *, case when mismatch then []::int[] else list_filter([s1, s2, s3], lambda x: x is not null) end as v from panel)"""
)

_COUNTS = "[len(list_filter(v, lambda x: x = 0)), len(list_filter(v, lambda x: x = 1)), len(list_filter(v, lambda x: x = 2)), len(list_filter(v, lambda x: x = 3))]"
_WINNERS = f"list_filter([0, 1, 2, 3], lambda w: len(v) > 0 and {_COUNTS}[w + 1] = list_max({_COUNTS}))"


def scored(method: str = "mean") -> str:
    """CTEs up to ``agg``: consensus rows."""
    if method == "primary_tiebreak":
        score = "case when s1 is not null and s2 is not null then case when s1 = s2 then s1 else s3 end else coalesce(s3, s1, s2) end"
        c4 = f"10000 * ({score})"
        err = f"case when s1 is not null and s2 is not null and s1 <> s2 and s3 is null then 'primary_disagreement_without_tiebreak' when ({score}) is null then 'no_valid_scores' end"
    else:
        c4 = {
            "mean": "(20000 * list_sum(v) + len(v)) // (2 * len(v))",
            "min": "10000 * list_min(v)",
            "max": "10000 * list_max(v)",
            "majority": f"case when len({_WINNERS}) = 1 then 10000 * ({_WINNERS})[1] end",
        }[method]
        tie = f"when len({_WINNERS}) > 1 then 'majority_tie:' || array_to_string({_WINNERS}, ',')" if method == "majority" else ""
        c4 = f"case when len(v) > 0 then {c4} end"
        err = f"case when len(v) = 0 then 'no_valid_scores' {tie} end"
    return f"""with {PANEL},
consensus as (select *, ({c4})::bigint as c4, {err} as consensus_error from valid),
agg as (
    select *, case when c4 is null then null else ((2 * least(greatest(c4, 0), 30000) + 10000) // 20000)::int end as bucket,
        array_to_string(list_filter([case when e2 <> '' then 'judge_2: ' || e2 end, case when e3 <> '' then 'judge_3: ' || e3 end,
            case when mismatch then 'Identity mismatch across judge rows; consensus skipped for this sample.' end, consensus_error], lambda x: x is not null), ' | ') as error,
        case when e2 <> '' or e3 <> '' or mismatch or consensus_error is not null then 'error' else 'ok' end as status
    from consensus)"""


MEAN4 = "((2 * sum({0})::bigint + count({0})) // nullif(2 * count({0}), 0)) / 10000.0::double"


def summary(by: str) -> str:
    plain = "case when not is_control then c4 end"
    return f"""
    select *, {ratio("score_2", "nonsense_count")} as detection_rate_score_2, {ratio("score_0", "nonsense_count")} as full_engagement_rate_score_0,
        {ratio("score_3", "control_count")} as control_correct_rate_score_3
    from (select {by}, count(*) as count, count(*) filter (where status = 'error') as error_count, count(c4) as scored_count,
        count(c4) filter (where not is_control) as nonsense_count, count(c4) filter (where is_control) as control_count,
        count(*) filter (where bucket = 0 and not is_control) as score_0, count(*) filter (where bucket = 1 and not is_control) as score_1,
        count(*) filter (where bucket = 2 and not is_control) as score_2, count(*) filter (where bucket = 3) as score_3,
        {MEAN4.format(plain)} as avg_score from agg group by {by})"""


BOARD = f"board as (select *, row_number() over (order by avg_score desc nulls last, detection_rate_score_2 desc nulls last, model) as rank from ({summary('model')}))"
SQL["leaderboard"] = f"{scored()}, {BOARD} select * from board"
for _m in ("mean", "majority", "min", "max", "primary_tiebreak"):
    SQL[f"consensus_{_m}"] = f"{scored(_m)} select sample_id, c4, consensus_error, status from agg"
SQL["aggregate_rows"] = f"{scored()} select sample_id, model, run_index, question_id, technique, domain, is_control, mismatch, c4, consensus_error, status, error, array_to_string(v, ',') as judge_valid_scores from agg"

_CELLS = ", ".join(f"count(*) filter (where score = {v} and {'not ' if n == 'nonsense' else ''}is_control) as {n}_score_{v}" for n in ("nonsense", "control") for v in range(4))
_SCORES = ", ".join(f"count(*) filter (where score = {v}) as score_{v}" for v in range(4))
SQL["judge_summary"] = f"""with {GRADES} select *, {ratio("nonsense_score_1 + 2 * nonsense_score_2", "nonsense_count")} as avg_score,
    {ratio("nonsense_score_2", "nonsense_count")} as detection_rate_score_2, {ratio("nonsense_score_0", "nonsense_count")} as full_engagement_rate_score_0,
    {ratio("control_score_3", "control_count")} as control_correct_rate_score_3
    from (select judge_model, model, count(*) as count, count(*) filter (where error <> '') as error_count, count(score) as scored_count,
        count(score) filter (where not is_control) as nonsense_count, count(score) filter (where is_control) as control_count, {_CELLS}, {_SCORES} from grades group by all)"""


def breakdown(by: str, where: str = "true") -> str:
    return f"select {by}, count(*) as n, {MEAN4.format('c4')} as avg_score from agg where c4 is not null and {where} group by {by}"


SQL["technique_breakdown"] = f"{scored()} {breakdown('model, technique')}"
SQL["technique_difficulty"] = f"{scored()} {breakdown('technique')}"
SQL["run_averages"] = f"{scored()} {breakdown('model, run_index', 'not is_control')}"
SQL["run_stddev"] = f"{scored()} select model, count(*) as runs, case when count(*) >= 2 then round(stddev_pop(avg_score), 4) end as run_average_stddev from ({breakdown('model, run_index', 'not is_control')}) group by model"
SQL["domain_mix"] = f"""{scored()} select model, domain, n, {ratio("b2", "n")} as green, {ratio("b1", "n")} as amber, {ratio("b0", "n")} as red
    from (select model, domain, count(*) as n, count(*) filter (where bucket = 2) as b2, count(*) filter (where bucket = 1) as b1, count(*) filter (where bucket = 0) as b0
        from agg where c4 is not null and not is_control group by all)"""
SQL["question_saturation"] = f"""{scored()}, {BOARD} select *, {ratio("solved", "models")} as solved_share, solved = (select count(*) from board where rank <= 5) as saturated
    from (select question_id, count(*) as models, count(*) filter (where bucket = 2) as solved from agg
        where c4 is not null and not is_control and model in (select model from board where rank <= 5) group by all)"""
SQL["judge_pair_agreement"] = f"""with {PANEL} select judge_a, judge_b, count(*) as compared, count(*) filter (where a = b) as agreed, {ratio("count(*) filter (where a = b)", "count(*)", 6)} as agreement_rate
    from (select unnest([1, 1, 2])::int as judge_a, unnest([2, 3, 3])::int as judge_b, unnest([s1, s1, s2]) as a, unnest([s2, s3, s3]) as b from panel) where a is not null and b is not null group by all"""
SQL["krippendorff_alpha"] = f"""with {PANEL},
    units as (select sample_id, list_filter([s1, s2, s3], lambda x: x is not null) as u from panel),
    vals as (select sample_id, len(u) as n, unnest(u) as c from units where len(u) >= 2),
    cnt as (select sample_id, n, c, count(*) as nc from vals group by all),
    o as (select a.c as c, b.c as k, sum(case when a.c = b.c then a.nc * (a.nc - 1) else a.nc * b.nc end / (a.n - 1)::double) as o from cnt a join cnt b using (sample_id) group by all),
    m as (select c, sum(o) as m, row_number() over (order by c) - 1 as r from o group by c),
    seen as (select sum(o * (x.r - y.r) * (x.r - y.r)) as s from o join m x on o.c = x.c join m y on o.k = y.c),
    expect as (select sum(x.m * y.m * (x.r - y.r) * (x.r - y.r)) / ((select sum(m) from m) - 1) as e from m x, m y)
    select (select count(*) from units where len(u) >= 2) as units, round(1 - s / e, 6) as alpha from seen, expect"""
_DIFFER = "(s1 is null or s2 is null or s1 <> s2)"
SQL["disagreement_samples"] = f"with {PANEL} select sample_id, model, question_id from panel where {_DIFFER}"
SQL["panel_disagreement_rate"] = f"with {PANEL} select count(*) as rows, count(*) filter (where {_DIFFER}) as disagreements, {ratio(f'count(*) filter (where {_DIFFER})', 'count(*)')} as rate from panel"
SQL["publish_disagreement"] = f"with {PANEL} select count(*) as rows, count(*) filter (where s1 <> s2) as disagreements, {ratio('count(*) filter (where s1 <> s2)', 'count(*)')} as rate from panel"
SQL["synthetic_tiebreak"] = f"""with {PANEL} select *, case when judge_error <> '' then 'error' else 'ok' end as status from (
    select sample_id, model, question_id, run_index <> 1 as synthetic,
        case when run_index = 1 then s3 when s1 is not null and s2 is not null then case when s1 = s2 then s1 end else coalesce(s1, s2) end as judge_score,
        case when run_index = 1 then e3 when s1 <> s2 then 'Synthetic tiebreaker row missing while primary judges disagreed.'
            when s1 is null and s2 is null then 'Synthetic tiebreaker row could not assign score because primary judges had no valid score.' else '' end as judge_error
    from panel)"""
SQL["report_rows"] = f"""{scored()} select a.sample_id, a.model, a.question_id, r.error as response_error, c4, consensus_error,
    'judge1:' || coalesce(s1::varchar, '-') || ':' || '|judge2:' || coalesce(s2::varchar, '-') || ':' || e2 || '|judge3:' || coalesce(s3::varchar, '-') || ':' || e3 as judges,
    array_to_string(list_filter([nullif(r.error, ''), 'judge2: ' || nullif(e2, ''), 'judge3: ' || nullif(e3, ''), 'consensus: ' || consensus_error], lambda x: x is not null), ' | ') as report_error, case when report_error <> '' then 'error' else 'ok' end as status
    from agg a join responses r using (sample_id)"""
SQL["report_errors"] = f"""{scored()} select sample_id, model, question_id, 'collect' as phase, '' as judge_model, error from responses where error <> ''
    union all select sample_id, model, question_id, 'aggregate', '', consensus_error from agg where consensus_error is not null
    union all select sample_id, model, question_id, 'grade', 'judge2', e2 from agg where e2 <> ''
    union all select sample_id, model, question_id, 'grade', 'judge3', e3 from agg where e3 <> ''"""

USAGE = f"""with u as (
    select o_orderkey as sample_id, o_orderpriority as model, 10 + o_orderkey % 2000 as prompt_tokens, o_custkey % 700 as completion_tokens, prompt_tokens + completion_tokens as total_tokens,
        case when o_orderstatus <> 'O' then o_orderkey % 300 end as reasoning_tokens, prompt_tokens % 7 as cached_prompt_tokens,
        case when o_orderkey % 5 <> 0 then round(o_totalprice * 100)::bigint end as cents, cents / 100000.0::double as cost_usd, o_orderkey % 5000 as latency,
        case when o_orderkey % 31 = 0 then 'HTTP 500' else '' end as error, completion_tokens % 5 as cache_write_tokens, length('answer ' || o_orderkey) as char_count,
        case o_orderkey % 4 when 0 then true when 1 then false end as is_byok,
        case when latency > 0 then {ratio("1000 * (10 + o_orderkey % 2000 + o_custkey % 700)", "o_orderkey % 5000")} end as tokens_per_second
    from orders)"""
SQL["usage_metrics"] = f"{USAGE} select sample_id, model, prompt_tokens, completion_tokens, total_tokens, reasoning_tokens, cached_prompt_tokens, cache_write_tokens, cost_usd, cost_usd as upstream_cost_usd, is_byok, char_count, tokens_per_second from u"
_SUMS = ", ".join(f"coalesce(sum({c}), 0)::bigint as {c}_total" for c in ("prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens", "cached_prompt_tokens", "cache_write_tokens", "char_count"))
PRICED = f"""{USAGE}, p as (select * from (values ('1-URGENT', 25000, 2500, 100000), ('2-HIGH', 12500, 1250, 50000), ('5-LOW', 1500, 150, 6000)) t(model, i, c, o)),
    est as (select *, greatest(prompt_tokens - cached_prompt_tokens, 0) * i + cached_prompt_tokens * c + completion_tokens * o as units, coalesce(cents * 100000, units)::hugeint as paid from u left join p using (model))"""
SQL["usage_summary"] = f"""{PRICED} select coalesce(model, 'ALL') as model, count(*) as rows, count(*) filter (where error <> '') as error_rows, count(*) filter (where error = '') as success_rows,
    count(*) as rows_with_usage, count(total_tokens) as rows_with_total_tokens, count(paid) as rows_with_cost, count(latency) as rows_with_latency, count(tokens_per_second) as rows_with_tokens_per_second,
    count(*) filter (where is_byok) as rows_with_byok_true, {_SUMS}, coalesce(sum(paid), 0)::bigint / 1e10::double as cost_usd_total, coalesce(sum(cents), 0)::bigint / 100000.0::double as upstream_cost_usd_total,
    0.0::double as upstream_prompt_cost_usd_total, 0.0::double as upstream_completions_cost_usd_total, sum(round(tokens_per_second * 10000)::bigint)::bigint / 10000.0::double as tokens_per_second_total, sum(latency)::bigint as latency_ms_total, {ratio("sum(total_tokens)", "count(total_tokens)")} as avg_total_tokens,
    {ratio("sum(latency)", "count(latency)", 2)} as avg_latency_ms,
    ((2 * sum(round(tokens_per_second * 10000)::bigint)::bigint + count(tokens_per_second)) // nullif(2 * count(tokens_per_second), 0)) / 10000.0::double as avg_tokens_per_second
    from est group by grouping sets ((model), ())"""
SQL["estimated_cost"] = f"""{USAGE}, p as (select * from (values ('1-URGENT', 25000, 2500, 100000), ('2-HIGH', 12500, 1250, 50000), ('5-LOW', 1500, 150, 6000)) t(model, i, c, o))
    select sample_id, cost_usd, est as estimated_cost_usd, coalesce(cost_usd, est) as final_cost_usd
    from (select *, (greatest(prompt_tokens - cached_prompt_tokens, 0) * i + cached_prompt_tokens * c + completion_tokens * o) / 1e10::double as est from u left join p using (model))"""

EVENTS = """e as (
    select event_id as pos, ts, 'm' || (user_id % 10) as model, user_id as sample_id,
        case when event_type = 'error' then 'task_rate_limit_requeue' when event_type = 'signup' then 'start' else 'task_complete' end as event,
        case when value > 400 then 'error' else 'ok' end as status, value as cooldown from events)"""
_TRIES = "event in ('start', 'task_rate_limit_requeue')"
SQL["collection_stats"] = f"""with {RESPONSES}, {EVENTS}, t as (select sample_id, count(*) filter (where {_TRIES}) as n, count(*) filter (where event = 'task_rate_limit_requeue') as q from e group by all)
    select (select count(*) from responses) as rows, (select count(*) from responses where error <> '') as errors, (select count(*) from responses where error = '') as successes,
        (select count(*) from responses where lower(error) like '%rate limit%') as final_rate_limit_errors, sum(n)::bigint as attempts, max(n) as max_attempt, sum(q)::bigint as requeues from t"""

MODELS = f"""with {RESPONSES}, models as (select distinct model_id, (pos % 20)::int as i from responses),
    routed as (select *, case when model_id = 'org1/m6' then 'direct' when model_id like 'org1/%' then 'azure' when model_id like 'org2/%' then 'vertex' else 'router' end as provider from models),
    variants as (
        select model_id, e as response_reasoning_effort, split_part(model_id, '/', 1) as model_org, split_part(model_id, '/', 2) as model_name, coalesce(e, 'default') as model_reasoning_level,
            provider as model_provider, model_name || '@reasoning=' || model_reasoning_level as model_row, model_org || '/' || model_row as model_label
        from (select *, unnest(case i % 3 when 0 then ['low', 'high'] when 1 then ['none'] else [null] end) as e from routed)),
    questions as (select 'q' || item_id as question_id, text as question, item_id % 11 = 0 as is_control from benchmark),
    grid as (select * from variants, questions, (select unnest([1, 2])::int as run_index))"""
SQL["model_variants"] = f"{MODELS} select * from variants"
SQL["provider_routing"] = f"{MODELS} select model_id, provider from routed"
SQL["task_grid"] = f"{MODELS} select run_index, model_label, question_id, model_provider, is_control from grid"
SQL["sample_ids"] = f"""{MODELS} select 'run_1__' || question_id || '__' || trim(regexp_replace(model_label, '[^A-Za-z0-9._-]+', '_', 'g'), '_') || '_' || left(sha1(model_label), 10) || '__run' || run_index as sample_id from grid"""
SQL["override_cascade"] = f"""{MODELS}, r as (select * from (values
        (0, '*', 'reasoning.effort', '"low"'), (0, '*', 'reasoning.enabled', 'true'), (0, '*', 'temperature', '0'),
        (1, 'org1/', 'reasoning.effort', '"high"'), (1, 'org1/', 'provider.only', '["a"]'), (1, 'org2/', 'reasoning', '"off"'),
        (2, 'org1/m6', 'provider', '"none"'), (2, 'org1/m6', 'temperature', '1')) t(rank, pattern, path, value)),
    held as (select model_id, rank, path, value from models, r where pattern = '*' or (rank = 1 and starts_with(model_id, pattern)) or (rank = 2 and model_id = pattern))
    select model_id, path, value from held x where not exists (select 1 from held y where y.model_id = x.model_id and y.rank > x.rank
        and (y.path = x.path or starts_with(y.path, x.path || '.') or starts_with(x.path, y.path || '.')))"""

TASKS = f"""with {RESPONSES}, tasks as (select sample_id from responses union all select 'x' || pos from responses where is_control),
    ckpt as (select sample_id from responses where run_index = 1 union all select 'old' || pos from responses where error <> '' union all select sample_id from responses where run_index = 1 and is_control)"""
SQL["resume_antijoin"] = f"{TASKS} select sample_id from tasks where sample_id not in (select sample_id from ckpt)"
SQL["stale_checkpoint"] = f"{TASKS} select distinct 'stale' as kind, sample_id from ckpt where sample_id not in (select sample_id from tasks) union all select 'duplicate', sample_id from ckpt group by sample_id having count(*) > 1"
SQL["integrity_report"] = f"""{TASKS}, b as (select w.n as want, h.n as have from (select sample_id, count(*) as n from tasks group by all) w full join (select sample_id, count(*) as n from ckpt group by all) h using (sample_id))
    select sum(want)::bigint as expected_rows, sum(have)::bigint as actual_rows, count(*) filter (where have > 1) as duplicate_ids, count(*) filter (where have is null) as missing_ids, count(*) filter (where want is null) as unexpected_ids from b"""
_DRY = "'DRY RUN response for question=' || question_id || ' model=' || model_id"
SQL["dry_run_collect"] = f"{MODELS} select model_id, question_id, {_DRY} as response_text from models, questions"
SQL["dry_run_grade"] = f"{MODELS} select model_id, question_id, case when is_control then 3 else 1 end as judge_score, 'Dry run placeholder grade.' as judge_justification from models, questions"
SQL["prompt_render"] = f"""{MODELS} select model_id, question_id, replace(case when is_control then 'Legitimate: ' || question || ' ' || ({_DRY}) || ' Answer: ' || ({_DRY})
    else 'Q: ' || question || ' ' || ({_DRY}) || ' Wrong: ' || model_id || ' A: ' || ({_DRY}) end, '', '') as prompt from models, questions"""
SQL["grading_guard"] = f"""with {RESPONSES} select sample_id, case when error <> '' then 'Cannot grade response with source error: ' || error
    when pos % 17 = 0 or regexp_matches(response_text, '^\\s*$') then 'Cannot grade empty response_text.' end as error from responses"""
_SCORE = "(score + pos % 2)"
SQL["score_checks"] = f"""with {GRADES} select sample_id, judge_idx,
    case when is_control and {_SCORE} not in (0, 3) then 'Invalid judge score ' || {_SCORE} || ' for this row; allowed scores: 0,3'
        when not is_control and {_SCORE} > 2 then 'Invalid judge score ' || {_SCORE} || ' for this row; allowed scores: 0,1,2' end as hinted,
    case when is_control and {_SCORE} > 3 then 'Invalid judge score ' || {_SCORE} || ' for this row; allowed scores: 0,1,2,3'
        when not is_control and {_SCORE} > 2 then 'Invalid judge score ' || {_SCORE} || ' for this row; allowed scores: 0,1,2' end as unhinted from grades"""
SQL["version_comparison"] = f"""{scored()}, h as (select model, substring(question_id, 2)::bigint % 2 as half, {MEAN4.format("case when not is_control then c4 end")} as a from agg group by all)
    select x.model, x.a as first_avg, y.a as second_avg, round((y.a - x.a) * 10000) / 10000.0::double as delta from h x join h y on x.model = y.model and x.half = 0 and y.half = 1"""
_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_NO_OBJECT = "Judge output parse error. Expected strict JSON object with `score` and `justification`."
SQL["judge_output_parse"] = f"""with d as (select *, doc_id % 14 as k, {_STRIP.format("'because {it} \\ \"is\" ' || coalesce(text, '')")} as said from documents)
    select doc_id, case when k in (0, 1, 2, 3, 11, 13) then doc_id % 3 when k = 6 then 0 end::int as score,
        case when k = 13 then md5('a') when k in (0, 1, 2, 3, 11) then md5(said) when k = 6 then md5('') end as justification_md5,
        case k when 0 then 'direct' when 13 then 'direct' when 1 then 'markdown_fence' when 2 then 'first_object' when 3 then 'direct_double_encoded' when 11 then 'markdown_fence_double_encoded' when 6 then 'fallback_empty_judge_output' else '' end as parse_mode,
        case when k in (5, 12) then '{_NO_OBJECT}' when k in (4, 9, 10) then 'Judge JSON `score` must be integer in {{0,1,2,3}}.' when k in (7, 8) then 'Judge JSON `justification` must be a non-empty string.' else '' end as error from d"""
SQL["chat_text_extract"] = f"""with c as (select *, (conv_id + turn) % 12 as k, {_STRIP.format("coalesce(text, '')")} as t from conversations)
    select conv_id, turn, md5(case k when 0 then trim(t || chr(10) || 'more', chr(10)) when 1 then t when 2 then {_STRIP.format("coalesce(text, '') || chr(10) || 'end'")} when 3 then 'plain' else '' end) as text_md5,
        case k when 0 then 'completed' when 2 then 'length' when 3 then 'max_output_tokens' when 11 then 'incomplete' when 1 then 'stop' when 4 then 'stop' end as finish_reason,
        md5(case when k = 3 then t else '' end) as refusal_md5,
        case k when 4 then 'API returned error payload: "rate limited"' when 5 then 'API returned error payload: {{"code":1}}' when 6 then 'API response missing both output and choices content.' when 7 then 'API response is not a JSON object.'
            when 8 then 'API response first choice is not an object.' when 9 then 'API response choice.message is not an object.' when 10 then 'API response is not a JSON object.' else '' end as error from c"""

LINES = """with l as (select case when l_orderkey % 97 = 0 then '' else l_orderkey::varchar end as key, l_linenumber, l_partkey, l_suppkey, l_quantity as qty, l_extendedprice as price from lineitem),
    both_sides as (select *, 0 as side from l where l_linenumber <= 4 union all select *, 1 from l where l_linenumber >= 3)"""
SQL["supplemental_merge"] = f"""{LINES} select * from both_sides where key = '' union all
    select * exclude (n) from (select *, row_number() over (partition by key order by side desc, l_linenumber desc, l_partkey desc, l_suppkey desc, qty desc, price desc) as n from both_sides where key <> '') where n = 1"""
SQL["merge_counts"] = f"""{LINES}, k as (select key, count(*) filter (where side = 0) as o, count(*) filter (where side = 1) as n from both_sides group by key)
    select count(*) filter (where key <> '' and o = 0) as added, count(*) filter (where key <> '' and o > 0 and n > 0) as replaced, coalesce(sum(n) filter (where key = ''), 0)::bigint as blank_appended from k"""
SQL["redact_paths"] = "select doc_id as pos, md5('see [local-path]\" then ' || text) as note_md5 from documents"
SQL["slim_rows"] = f"with {RESPONSES} select sample_id, case when pos % 3 = 0 then 'snap' else model_id end as response_model_snapshot from responses"
_COLUMNS = ("pos", "sample_id", "model", "model_id", "model_org", "model_reasoning_level", "run_index", "question_id", "technique", "domain", "is_control", "response_text", "n_chars", "error")
_TEXTS = set(_COLUMNS) - {"pos", "run_index", "is_control", "n_chars"}
SQL["column_coverage"] = f"with {RESPONSES} " + " union all ".join(f"""select '{c}' as "column", count(*) as rows, count(*) filter (where {c} is not null {f"and trim({c}) <> ''" if c in _TEXTS else ""}) as filled, 0::bigint as objects from responses""" for c in _COLUMNS) + """
    union all select 'response_usage', count(*), count(*) filter (where pos % 4 < 3), count(*) filter (where pos % 4 = 0) from responses union all select 'raw', count(*), count(*) filter (where pos % 3 = 0), count(*) filter (where pos % 3 = 0) from responses"""
_TIME = "'%Y-%m-%d %H:%M:%S.%f'"
SQL["recent_additions"] = f"""with {EVENTS},
    now as (select 'model' as kind, model || '@reasoning=' || event as name, min(ts) as seen from e where status = 'ok' group by all union all select 'base', model, min(ts) from e where status = 'ok' group by all),
    saved as (select 'base' as kind, model as name, min(ts) as seen from e where status <> 'ok' group by all),
    f as (select n.kind, n.name, least(n.seen, coalesce(s.seen, n.seen)) as first_seen from now n left join saved s using (kind, name))
    select kind, name, strftime(first_seen, {_TIME}) as first_seen, first_seen >= timestamp '2024-01-31' - interval 7 days as recent from f"""
SQL["attempt_numbers"] = f"with {EVENTS} select pos, sample_id, row_number() over (partition by sample_id order by ts, pos)::int as attempt from e where {_TRIES}"
SQL["requeue_stats"] = f"with {EVENTS} select model, count(*) as requeues, max(cooldown) as max_cooldown from e where event = 'task_rate_limit_requeue' group by model"
SQL["event_milestones"] = f"with n as (select row_number() over (order by ts, event_id) as milestone, event_id as pos, strftime(ts, {_TIME}) as ts from events) select * from n where milestone in (1, 10, 100, 1000, 10000, 100000)"
SQL["cumulative_daily"] = "select strftime(day, '%Y-%m-%d') as day, n, (sum(n) over (order by day))::bigint as total from (select ts::date as day, count(*) as n from events group by all)"

VOTES = """votes as (select model, arg_max(org, (votes, -first)) as org, max(votes) as votes from
    (select model, model_org as org, count(*) as votes, min(pos) as first from responses where model_org <> '' group by all) group by model)"""
SQL["org_vote"] = f"with {RESPONSES}, {VOTES} select * from votes"
ENRICHED = f"""{scored()}, {BOARD}, {VOTES},
    dims as (select 'org' || (p_partkey % 20 % 5) || '/m' || (p_partkey % 20) as model_id, arg_max(date '2024-01-01' + p_size, p_partkey) as launch_date,
        arg_max((case when p_partkey % 3 <> 0 then p_retailprice else -1 end), p_partkey) as size from part group by all),
    enriched as (select b.*, regexp_replace(model, '@reasoning=[^@]+$', '') as model_id, v.org, case when model like '%@%' then split_part(model, '=', 2) else 'default' end as reasoning,
        d.launch_date, case when d.launch_date <= date '2024-06-30' then (date '2024-06-30' - d.launch_date)::int end as model_age_days, case when size >= 0 then size end as total_params_b
        from board b left join votes v using (model) left join dims d on d.model_id = regexp_replace(b.model, '@reasoning=[^@]+$', ''))"""
SQL["leaderboard_enriched"] = f"{ENRICHED} select rank, model, model_id, org, reasoning, avg_score, strftime(launch_date, '%Y-%m-%d') as launch_date, model_age_days, total_params_b from enriched"
SQL["release_trend"] = f"""{ENRICHED} select org, strftime(launch_date, '%Y-%m') as month, sum(score_2)::bigint as score_2, sum(nonsense_count)::bigint as n,
    {ratio("sum(score_2)", "sum(nonsense_count)")} as green_rate from enriched group by org, month"""
SQL["size_vs_score"] = f"{ENRICHED} select model, total_params_b, detection_rate_score_2, avg_score from enriched where total_params_b is not null"
SQL["cost_vs_score"] = f"""{scored()}, a2 as (select *, split_part(model, '/', 1) as org from agg), x as ({PRICED} select * from est),
    y as (select 'org' || (left(model, 1)::int - 1) as org, sum(reasoning_tokens) as r, count(reasoning_tokens) as n, sum(paid)::bigint as cost, count(paid) as paid from x group by all)
    select org, detection_rate_score_2, {ratio("r", "n")} as avg_reasoning_tokens, ((cost // paid + 50) // 100) / 1e8::double as avg_cost_usd from ({summary("org").replace("from agg", "from a2")}) join y using (org)"""
SQL["model_inventory"] = """with o as (select case when c_custkey % 13 = 0 then 'm' || (c_custkey % 50) else 'org' || (c_custkey % 50 % 5) || '/m' || (c_custkey % 50) end as model_id,
        case c_mktsegment when 'AUTOMOBILE' then 'config' when 'BUILDING' then 'latest' else 'runs' end as source, model_id || '@reasoning=' || ['none', 'low', 'high', 'default'][c_custkey % 4 + 1] as variant from customer)
    select model_id, split_part(model_id, '/', 1) as org, bool_or(source = 'latest') as present_in_latest, bool_or(source = 'config') as present_in_config, bool_or(source = 'runs') as present_in_runs_history,
        array_to_string(list_sort(list(distinct variant)), ';') as variants, count(distinct variant) as variant_count,
        case when org in ('org0', 'org1') then 'collector_a' when org = 'org2' then 'collector_b' else 'collector_c' end as collector_agent
    from o where contains(model_id, '/') group by model_id"""

_DOMAIN = "regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"
SQL["page_domains"] = f"select page_id, {_DOMAIN.format('url')} as domain from pages"
EVIDENCE = f"""with x as (select page_id as pos, 'org' || (page_id % 3) as org, 'org' || (page_id % 3) || '/m' || (page_id % 70) as model_id,
        case when page_id % 31 = 0 then '' else url end as evidence_url, {_DOMAIN.format("case when page_id % 31 = 0 then '' else url end")} as evidence_domain, 'Release of M' || (page_id % 140) as evidence_title,
        case when page_id % 11 = 0 then '' when page_id % 13 = 0 then '2024-1-5' when page_id % 17 = 0 then '2025-01-01' else strftime(date '2024-01-01' + (page_id % 150)::int, '%Y-%m-%d') end as proposed,
        case when page_id % 23 = 0 then '' when page_id % 19 = 0 then '2024-02-02' else proposed end as published,
        ['announcement_blog', 'newsroom', 'docs_release_note', 'changelog', 'tweet'][page_id % 5 + 1] as evidence_type, case when page_id % 29 = 0 then '' else 'now available' end as snippet from pages),
    y as (select *, proposed not in ('', '2024-1-5') as p_ok, published not in ('', '2024-1-5') as q_ok,
        regexp_replace(lower(evidence_url || ' ' || evidence_title || ' ' || snippet), '[^a-z0-9]+', ' ', 'g') as spaced, regexp_replace(spaced, ' ', '', 'g') as compact, 'm' || (pos % 70) as tail from x),
    z as (select *, list_filter([
            case when proposed = '2024-1-5' then 'proposed_launch_date must be YYYY-MM-DD.' when p_ok and proposed > '2024-06-30' then 'proposed_launch_date cannot be in the future.' end,
            case when evidence_domain <> '' and not coalesce(regexp_matches(evidence_domain, case org when 'org0' then '(^|\\.)example\\.(com|net)$' when 'org1' then '(^|\\.)example\\.(net|org)$' else '(^|\\.)example\\.(com|org)$' end), false)
                then 'Evidence domain ''' || evidence_domain || ''' is not first-party for org ''' || org || '''.' end,
            case when published = '2024-1-5' then 'evidence_published_date must be YYYY-MM-DD.' when q_ok and published > '2024-06-30' then 'evidence_published_date cannot be in the future.' end,
            case when p_ok and q_ok and proposed <> published then 'proposed_launch_date must match evidence_published_date under strict policy.' end], lambda m: m is not null) as hard,
        list_filter([case when proposed = '' then 'Missing proposed launch date.' end, case when evidence_url = '' then 'Missing evidence_url.' end,
            case when evidence_domain = '' then 'Missing evidence_domain (or parseable domain from evidence_url).' end,
            case when evidence_type = 'tweet' then 'evidence_type must be one of: announcement_blog|newsroom|docs_release_note|changelog.' end,
            case when published = '' then 'Missing evidence_published_date.' end, case when snippet = '' then 'Missing supporting_snippet with key launch evidence.' end,
            case when not contains(spaced, tail) and not contains(compact, tail) then 'Evidence not model-specific enough; include explicit model name in title/snippet/url.' end], lambda m: m is not null) as retry from y),
    judged as (select *, case when len(hard) > 0 then 'rejected' when len(retry) > 0 then 'needs_retry' else 'accepted' end as st, hard || retry as reasons from z),
    tries as (select *, unnest(range(1, case when st = 'accepted' then 2 else 4 end))::int as attempt_count from judged),
    attempts as (select *, case when st <> 'accepted' and attempt_count = 3 then 'unresolved' else st end as status from tries),
    final as (select * from (select *, row_number() over (partition by model_id order by pos desc, attempt_count desc) as n from attempts) where n = 1)"""
_CONFIDENCE = "case {0} when 'accepted' then '0.95' when 'rejected' then '0.90' when 'needs_retry' then '0.60' else '0.75' end"
_REASON = "coalesce(reasons[1], 'Accepted: date and evidence pass strict checks.')"
SQL["evidence_judge"] = f"{EVIDENCE} select pos, evidence_domain, st as judge_status, {_REASON} as judge_reason, array_to_string(reasons, ' | ') as required_fix, {_CONFIDENCE.format('st')} as judge_confidence from judged"
SQL["attempts_table"] = f"{EVIDENCE} select pos, attempt_count, status as judge_status, {_CONFIDENCE.format('status')} as judge_confidence from attempts"
SQL["canonical_launch"] = f"{EVIDENCE} select model_id, org, proposed as launch_date, evidence_url, evidence_title, published as evidence_published_date, evidence_type, status as judge_status from final where status = 'accepted' and proposed <> '' and evidence_url <> ''"
SQL["launch_review"] = f"""{EVIDENCE}, inv as (select distinct 'org' || (c_custkey % 50 % 5) || '/m' || (c_custkey % 50) as model_id from customer where c_custkey % 13 <> 0)
    select * from (select i.model_id, split_part(i.model_id, '/', 1) as org, case when f.status = 'accepted' then f.proposed else '' end as launch_date, coalesce(f.evidence_url, '') as evidence_url,
        coalesce(f.status, 'unresolved') as judge_status, case when f.model_id is null then 'No judged row available.' else {_REASON} end as judge_reason from inv i left join final f on i.model_id = f.model_id)
    where judge_status in ('accepted', 'unresolved')"""

PAIRS = f"""{scored()}, s as (select question_id, model, c4, technique, domain, sample_id from agg where c4 is not null),
    pairs as (select a.question_id, a.model as system_a, b.model as system_b, case when a.c4 > b.c4 then 'system_a' when a.c4 < b.c4 then 'system_b' else 'tie' end as winner,
        abs(a.c4 - b.c4) / 10000.0::double as score_margin, 'benchmark_v1,question_' || a.question_id || ',technique_' || a.technique || ',domain_' || a.domain as tags, a.sample_id as sample_a, b.sample_id as sample_b
        from s a join s b on a.question_id = b.question_id and a.model < b.model)"""
SQL["pairwise_events"] = f"{PAIRS} select * from pairs"
SQL["pairwise_topn"] = f"{PAIRS} select * exclude (tags) from pairs order by question_id, system_a, system_b limit 100"
SQL["pairwise_summary"] = f"{PAIRS} select (select count(distinct question_id) from s) as questions, (select count(*) from s) as rows, count(*) as events, count(*) filter (where winner = 'tie') as ties, (select count(distinct model) from s) as models from pairs"

SQL["jsonl_lenient"] = "select doc_id, lang, md5(text) as text_md5 from documents where doc_id % 7 <> 3"
SQL["salvage_json"] = "select 0::bigint as place, doc_id, null as lang, md5(text) as text_md5 from documents union all select 1, doc_id, lang, null from documents"
SQL["salvage_files"] = "select doc_id, null as lang, md5(text) as text_md5 from documents union all select doc_id, lang, null from documents"
SQL["markdown_bank"] = f"""with d as (select doc_id, regexp_replace(coalesce(text, ''), '[*#:"'']', '', 'g') as f, translate(doc_id::varchar, '0123456789', 'abcdefghij') as name, ['pnf', 'mm', 'L2', 'zz'][doc_id // 5 % 4 + 1] as code from documents),
    x as (select *, name || '_' || code || '_' || lpad((doc_id % 100)::varchar, 2, '0') as id, list_filter(list_transform(string_split('"x' || f || 'y"', chr(10)), lambda l: {_STRIP.format("l")}), lambda l: l <> '') as ls from d)
    select id, md5(case when contains(f, chr(10)) then array_to_string(ls, ' ') else {_STRIP.format("'x' || f || 'y'")} end) as question_md5, 'w continued ' || name as nonsensical_element, case when doc_id % 17 = 3 then '' else (doc_id % 5)::varchar end as domain,
        ['legal', 'medical', 'software', 'finance', 'physics'][doc_id // 10 % 5 + 1] as domain_group, code as difficulty, 'The ' || code || ' kind' as difficulty_label,
        case code when 'pnf' then 'plausible_nonexistent_framework' when 'mm' then 'misapplied_mechanism' when 'L2' then 'wrong_relationship' else code end as technique,
        case when doc_id % 17 = 3 then 'Incomplete question block for ' || id || ': missing domain' else '' end as problem from x"""
# a table of one file is one batch, whose newest time closes windows and ends what is recent
SQL["stream_progress"] = f"""with {EVENTS}, d as (select date_trunc('minute', ts) as s, model, status from e where event = 'task_complete'),
    w as (select date_trunc('millisecond', max(ts)) - interval 1 hour as w from e where event = 'task_complete')
    select strftime(s, '%Y-%m-%d %H:%M:%S') as start, model, status, count(*) as n, case when s + interval 1 minute <= w then 'closed' else 'open' end as state from d, w group by all"""
SQL["stream_requeues"] = SQL["requeue_stats"]
SQL["stream_due_again"] = f"""with {EVENTS}, w as (select epoch_ms(max(ts)) as w from e where event in ('task_rate_limit_requeue', 'task_complete')),
    q as (select sample_id, model, max(ts) as ts, max_by(epoch_us(ts) + (coalesce(cooldown, 0) * 1000000)::bigint, (ts, cooldown)) as retry from e where event = 'task_rate_limit_requeue' group by all),
    d as (select sample_id, model, max(ts) as done from e where event = 'task_complete' group by all)
    select sample_id, model, strftime(make_timestamp(retry), {_TIME}) as retry_at, case when done >= ts then 'done' when ceil(retry / 1000.0) > w then 'waiting' else 'due' end as state
    from q left join d using (sample_id, model), w"""
SQL["stream_first_seen"] = f"""with {EVENTS}, n as (select model || '/' || day(ts) as name, ts from e union all select model || '/' || day(ts), ts - interval 2 days from e where status = 'error'),
    w as (select date_trunc('millisecond', max(ts)) as w from e)
    select name, strftime(min(ts), {_TIME}) as first_seen, min(ts) + interval 7 days > any_value(w) as recent from n, w group by name"""
SQL["stream_dedup"] = f"with {EVENTS} select sample_id, 1::bigint as completed, 'first' as state from e where event = 'task_complete' group by sample_id"
SQL["stream_publish"] = """select o_orderkey::varchar as key, case when o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 then -o_custkey else o_custkey end as cust, o_orderstatus from orders"""
