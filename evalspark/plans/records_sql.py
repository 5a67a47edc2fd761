"""DuckDB SQL for the queries of ``records``."""

from __future__ import annotations

from evalspark.plans.oracle import _COLUMNS, _DOMAIN, _TEXTS, BOARD, EVENTS, EVIDENCE, GRADES, MODELS, RESPONSES, SQL, VOTES, _list, scored
from evalspark.sources.files import COLLECT_REVIEW, GRADE_REVIEW
from evalspark.views import DOMAIN_NAMES

R = f"with {RESPONSES}"
SQL["jsonl_roundtrip"] = f"{R} select sample_id, model, run_index, is_control, error from responses"
SQL["csv_roundtrip"] = f"{R} select sample_id, run_index, length(model) + 7 as n, '' as note from responses"
SQL["run_history"] = f"{R} select sample_id, model, 'run=' || run_index as run_id from responses"
SQL["event_log"] = f"with {EVENTS} select event, model, count(*) as n from e group by all"
SQL["pairwise_event_log"] = f"""select question_id, score_margin, system_a, system_b, winner, 'question_id,sample_a,sample_b,score_margin,system_a,system_b,tags,winner' as keys from ({SQL["pairwise_events"]})"""
SQL["grade_set"] = f"with {GRADES} select sample_id, score, judge_model, 1 as judge_idx from grades where judge_idx = 1"
_BANK = f"with bank as (select 'tech' || (item_id % 4) as technique, 'q' || item_id as id, text as question, {_list(DOMAIN_NAMES)}[item_id % 5 + 1] as domain, item_id % 11 = 0 as is_control from benchmark)"
SQL["nested_questions"] = f"{_BANK} select technique, 'd' as technique_description, id, question, domain from bank where not is_control"
SQL["question_counts"] = f"""{_BANK} select case when grouping(domain) = 0 then 'domain' when grouping(technique) = 0 then 'technique' else 'all' end as kind, coalesce(domain, technique, '') as name, count(*) as n
    from bank group by grouping sets ((domain), (technique), ())"""
SQL["incomplete_questions"] = f"""{_BANK}, q as (select * from bank union all select * from bank where domain = 'legal')
    select id from q where technique = 'tech1' or trim(question) = '' union all select id from q group by id having count(*) > 1"""


def _review(columns: list[str], have: dict[str, str]) -> str:
    return ", ".join(f"coalesce(({have[c]})::varchar, '') as {c}" if c in have else f"'' as {c}" for c in columns)


_NAMES = {c: c for c in ("error", "sample_id", "model", "model_id", "model_org", "run_index", "question_id", "technique", "is_control")}
_WARNED = "case when pos % 9 = 0 then 'slow; cut' end"
_STATUS = {"status": "case when error <> '' then 'error' else 'ok' end"}
SQL["collect_review"] = f"{R} select {_review(COLLECT_REVIEW, _NAMES | _STATUS | {'model_reasoning_level': 'model_reasoning_level', 'warnings': _WARNED})} from responses"
SQL["grade_review"] = f"with {GRADES} select {_review(GRADE_REVIEW, _NAMES | _STATUS | {'judge_model': 'judge_model', 'judge_score': 'score'})} from grades"
_FILLED = "select '{0}' as \"table\", '{1}' as \"column\", count(*) as rows, count(*) filter (where {1} is not null {2}) as filled, 0::bigint as objects from {3}"
_TEXT = "and trim({0}) <> ''"
SQL["dataset_manifest"] = f"{scored()} " + " union all ".join(
    [_FILLED.format("responses", c, _TEXT.format(c) if c in _TEXTS else "", "responses") for c in _COLUMNS] + [_FILLED.format("aggregate", c, _TEXT.format(c) if c != "c4" else "", "agg") for c in ("sample_id", "model", "c4", "status")]
)
SQL["published_dataset"] = """select 'responses' as "table", count(*) as rows, 14 as columns from documents union all select 'aggregate', count(*), 4 from documents union all select 'model_params', 0, 3"""
SQL["leaderboard_csv"] = f"""{scored()}, {BOARD}, {VOTES} select rank, b.model, coalesce(v.org, split_part(b.model, '/', 1)) as org, case when b.model like '%@%' then split_part(b.model, '=', 2) else 'default' end as reasoning, avg_score,
    detection_rate_score_2 as green_rate, full_engagement_rate_score_0 as red_rate, score_2, score_1, score_0, nonsense_count, error_count from board b left join votes v on b.model = v.model"""
SQL["canonical_order"] = f"{R} select sample_id, model, row_number() over (order by model, run_index, question_id) as place from responses"
SQL["collect_order"] = f"{R} select sample_id, model, row_number() over (order by model, case when model_reasoning_level = 'default' then '' else model_reasoning_level end, run_index, question_id) as place from responses"
SQL["usage_order"] = f"select row_number() over (order by model <> 'ALL', total_tokens_total desc, model) as place, model, total_tokens_total from ({SQL['usage_summary']})"
SQL["reliability_bundle"] = f"""select p.*, a.* from (select count(*) as pairs, round(avg(agreement_rate), 6) as average_pairwise_agreement from ({SQL["judge_pair_agreement"]})) p, ({SQL["krippendorff_alpha"]}) a"""
SQL["report_input_guard"] = f"{R} select 'sample' as kind, 'z' || sample_id as id from responses where pos % 50 = 3 union all select 'grade_set', 'judge2'"
SQL["grade_resume"] = f"""{R} select case when pos % 23 = 0 then 'to do' else 'other judge' end as kind, sample_id from responses where pos % 23 = 0 or pos % 7 = 0"""
SQL["grade_sources"] = f"""with {GRADES} select judge_idx, count(distinct case when judge_idx = 1 then 'a' else model_org end) as sources, sources <= 1 as single from grades group by judge_idx"""
SQL["first_responses"] = f"{R} select model, technique, arg_min(sample_id, pos) as sample_id from responses group by all"
SQL["shuffled_tasks"] = f"{R} select sample_id, model, row_number() over (order by md5('7:' || sample_id), sample_id) as place from responses"
SQL["control_rows"] = f"{R} select sample_id, (pos % 3 = 0 and is_control) or technique = 'tech5' as control from responses"
_CODE = "case when pos % 37 = 0 then 429 when pos % 41 = 0 then 503 when pos % 43 = 0 then 404 end"
SQL["error_classes"] = f"""{R}, c as (select *, {_CODE} as code from responses) select sample_id, case when code = 429 then 'rate_limit' when code is not null then 'api_error' else 'runtime_error' end as kind,
    coalesce(code in (429, 503), false) as retryable, case when pos % 5 = 0 then 'done' when error <> '' then 'error' else 'ok' end as status from c"""
SQL["identity_rows"] = f"""{R} select sample_id, model, case when pos % 2 = 0 then model_id else model end as model_id, 'unknown' as model_org, case when pos % 2 = 0 then model_id else model end as model_name,
    'default' as model_reasoning_level, model as model_row from responses"""
_OBSERVED = "select case when c_custkey % 13 = 0 then 'm' || (c_custkey % 50) else 'org' || (c_custkey % 50 % 5) || '/m' || (c_custkey % 50) end as model_id from customer"
SQL["known_settings"] = f"""{MODELS}, o as ({_OBSERVED}), p as (select distinct unnest([model_id, split_part(model_id, '/', 1) || '/*', '*']) as pattern from o)
    select pattern from p where pattern = '*' or exists (select 1 from models m where m.model_id = pattern or (pattern like '%/*' and starts_with(m.model_id, left(pattern, length(pattern) - 1))))"""
SQL["request_messages"] = """select conv_id, turn, case when turn % 2 = 0 and trim(coalesce(role, '')) <> '' then 2 else 1 end as n, case when turn % 2 = 0 and trim(coalesce(role, '')) <> '' then 'system,user' else 'user' end as roles, md5(text) as last_md5 from conversations"""
SQL["dataset_versions"] = """select doc_id, case when doc_id % 4 = 0 or doc_id % 3 = 0 then 'v2' when doc_id % 4 = 1 then 'v1' when doc_id % 4 = 2 then 'set_a' else 'old' end as version from documents"""
SQL["collected_rows"] = f"""{R}, f as (select *, case when pos % 97 = 0 then 'no answer' when pos % 89 = 0 then 'HTTP 429' when pos % 83 = 0 then 'API returned error payload: {{"message":"overloaded"}}' else '' end as failure from responses),
    x as (select *, case when failure <> '' then '' when pos % 7 = 0 then 'I will not.' when pos % 7 = 1 then '[Model returned an empty response.]' else 'answer to ' || question_id end as txt, case when pos % 11 = 0 then 'length' else 'stop' end as reason from f)
    select sample_id, txt as response_text, case when failure = '' then 'r' || pos else '' end as response_id, case when failure = '' then reason end as response_finish_reason, case when failure = '' then pos % 50 end as total_tokens, length(txt) as char_count,
        failure as error, case when failure = '' then '' when pos % 97 <> 0 and pos % 89 = 0 then 'rate_limit' else 'runtime_error' end as error_kind, case when failure = 'HTTP 429' then 429 end as error_http_status, case when failure = 'HTTP 429' then true end as error_retryable,
        case when failure = 'HTTP 429' then 2.5::double end as error_retry_after_seconds,
        case when failure <> '' then '' else array_to_string(list_filter([case when pos % 7 = 0 then 'response_text_fallback=message.refusal' when pos % 7 = 1 then 'response_text_fallback=empty_placeholder' end,
            case when pos % 7 = 1 then 'empty_response_finish_reason=' || reason end, case when reason = 'length' then 'response_finish_reason=length (possible truncation)' end], lambda w: w is not null), ',') end as warnings,
        true as timed, case when failure <> '' then 'error' else 'ok' end as status from x"""
SQL["graded_rows"] = f"""{R} select sample_id, case when pos % 5 < 3 then 1 when pos % 5 = 4 then 0 end as score, case when pos % 5 < 3 then 'direct' when pos % 5 = 4 then 'fallback_empty_judge_output' else '' end as parse_mode,
    case when pos % 5 = 3 then 'Judge output parse error. Expected strict JSON object with `score` and `justification`.' else '' end as error, case when pos % 5 < 3 then pos % 5 else 2 end::int as asked from responses"""
_ENDING = "['', '-HIGH', '-none', '-x', '-minimal'][pos % 5 + 1]"
SQL["model_keys"] = f"{R} select sample_id, model_id || case when pos % 5 = 3 then '-x' else '' end as model_key, model_id || case when pos % 5 = 3 then '-x' else '' end || '@reasoning=' || case when pos % 3 = 0 then 'low' else 'default' end as variant from responses"
SQL["excerpts"] = f"""{R}, x as (select sample_id, trim(regexp_replace(trim(coalesce(response_text, '')), '\\s+', ' ', 'g')) as t from responses)
    select sample_id, md5(case when length(t) <= 140 then t else rtrim(substring(t, 1, 137)) || '...' end) as excerpt_md5 from x"""
SQL["first_times"] = """select event_id as pos, strftime(case when event_id % 4 = 1 then date_trunc('second', ts) - interval 2 hours when event_id % 3 < 2 then date_trunc('second', ts) else ts::date::timestamp end, '%Y-%m-%dT%H:%M:%SZ') as first from events"""
SQL["model_sets"] = f"{R} select distinct 'model' as kind, model as name from responses union all select distinct 'base', model_id from responses"
SQL["accumulated_stats"] = f"""with {EVENTS}, s as (select ts >= timestamp '2024-01-16' as late, count(*) filter (where event <> 'task_complete') as a, count(*) filter (where event = 'task_rate_limit_requeue') as q, count(*) filter (where status = 'error') as f, max(pos % 10) as m from e group by all),
    o as (select * from s where not late), n as (select * from s where late), r as (select count(*) as total_records, count(*) filter (where doc_id % 37 = 0) as error_count, count(*) filter (where doc_id % 37 <> 0) as success_count, max(doc_id % 7) as seen from documents)
    select 'merge' as kind, o.a + n.a as attempt_count, o.q + n.q as rate_limit_requeue_count, o.f + n.f as final_rate_limit_error_count, total_records, error_count, success_count, seen as max_attempt_observed, 5 as new_rows_processed from o, n, r
    union all select 'nothing new', o.a, o.q, o.f, total_records, error_count, success_count, greatest(o.m, n.m), 0 from o, n, r
    union all select 'replace', n.a, n.q, n.f, total_records, error_count, success_count, seen, 5 from o, n, r"""
_FILE = """'{"file":"[local-path] b","n":' || doc_id || '}'"""
SQL["redact_nested"] = f"""select doc_id as pos, '[' || {_FILE} || ']' as list, '{{"k":"[local-path] b"}}' as map, case when doc_id % 2 = 0 then '{{"deep":' || {_FILE} || '}}' end as tree from documents"""
_AGENT = "case when org in ('org0', 'org1') then 'collector_a' when org = 'org2' then 'collector_b' else 'collector_c' end as collector_agent"
_INVENTORY = f"inv as (select distinct model_id, split_part(model_id, '/', 1) as org, {_AGENT} from ({_OBSERVED}) where contains(model_id, '/'))"
_BLANK = ", ".join(f"'' as {c}" for c in ("proposed_launch_date", "evidence_url", "evidence_domain", "evidence_title", "evidence_published_date", "evidence_type", "supporting_snippet", "notes"))
SQL["sources_template"] = f"with {_INVENTORY} select model_id, org, {_BLANK}, collector_agent from inv"
SQL["collected_sources"] = f"""{EVIDENCE}, {_INVENTORY}, l as (select * from (select *, row_number() over (partition by model_id order by pos desc) as n from x) where n = 1)
    select inv.model_id, inv.org, coalesce(proposed, '') as proposed_launch_date, coalesce(evidence_url, '') as evidence_url, coalesce(evidence_title, '') as evidence_title, coalesce(published, '') as evidence_published_date,
        coalesce(evidence_type, '') as evidence_type, coalesce(snippet, '') as supporting_snippet, coalesce({_DOMAIN.format("nullif(evidence_url, '')")}, '') as evidence_domain,
        case when coalesce(evidence_url, '') = '' then 'No source row/evidence provided for this model yet.' else '' end as notes, collector_agent, '2024-06-30T00:00:00Z' as collected_at_utc, 1 as attempt_count
    from inv left join l on inv.model_id = l.model_id"""
SQL["launch_totals"] = f"{EVIDENCE} select count(*) filter (where status = 'accepted') as accepted, count(*) filter (where status = 'unresolved') as unresolved, count(*) as total from final"
SQL["observed_models"] = f"""with {RESPONSES}, {EVENTS}, o as (select model_id, 'latest' as source, model as variant from responses union all select model_id, 'config', model_id || '@reasoning=none' from responses
        union all select 'org9/' || model, 'runs', 'org9/' || model from e)
    select model_id, split_part(model_id, '/', 1) as org, bool_or(source = 'latest') as present_in_latest, bool_or(source = 'config') as present_in_config, bool_or(source = 'runs') as present_in_runs_history,
        array_to_string(list_sort(list(distinct variant)), ';') as variants, count(distinct variant) as variant_count from o group by model_id"""
