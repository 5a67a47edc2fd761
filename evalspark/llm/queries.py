"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.chat import fold_events, read_back, render, turn_events
from evalspark.llm.common import table
from evalspark.llm.embedding_dup import vector_links
from evalspark.llm.filter_audit import audit_documents
from evalspark.llm.fingerprint import fingerprint_edits
from evalspark.llm.html_text import extract_pages
from evalspark.llm.line_dedup import dedup_lines
from evalspark.llm.mixing import mix
from evalspark.llm.near_dup import near_duplicates
from evalspark.llm.packing import pack
from evalspark.llm.quality import fit_quality, score_quality
from evalspark.llm.sharding import histogram_shards
from evalspark.llm.toxicity import fit_toxicity, score_toxicity
from evalspark.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def op1_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_shards(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def id_fold(column: str, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text leaves the remainder ``fold``; false for null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op2_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_fold("doc_id", 3, 1)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), held_out)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("tree.root").alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "first_edit",
    )


def op4_deletion_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_tag_ratio_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Target weights: per domain, then per language in a domain, then per source in a language (others: 1).
WEIGHTS = {
    "domain": {"domain0": 4, "domain1": 3, "domain2": 2, "domain3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 2},
}
DOMAINS = 4


def mix_levels() -> dict[str, Column]:
    """The source tree: a source's number gives its domain."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(number != "", F.concat(F.lit("domain"), (number.cast("long") % DOMAINS).cast("string")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), mix_levels(), WEIGHTS)
    return out.select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def mix_sql(docs: str = "documents", max_epochs: int = 2) -> str:
    """The same choice as one statement: each level's water-filling is a common table expression."""
    weight = lambda level, c: "case " + " ".join(f"when {c} = '{k}' then {w}" for k, w in WEIGHTS[level].items()) + " else 1 end"  # noqa: E731
    levels = list(WEIGHTS)
    parts = []
    for i, level in enumerate(levels):
        parent = levels[:i]
        keys = ", ".join([*parent, level])
        over = f"partition by {', '.join(parent)}" if parent else ""
        parts.append(f"""
        n{i} as (select {keys}, sum(tokens) * {max_epochs} as capacity, {weight(level, level)} as weight from leaves group by all),
        b{i} as (select n.*, {"(select total // 2 from total)" if not i else "p.given"} as budget from n{i} n {f"join g{i - 1} p using ({', '.join(parent)})" if i else ""}),
        o{i} as (select *,
            coalesce(sum(capacity) over ({over} order by capacity::double / weight::double, {level} rows between unbounded preceding and 1 preceding), 0)::hugeint as taken,
            sum(weight) over ({over})::hugeint - coalesce(sum(weight) over ({over} order by capacity::double / weight::double, {level} rows between unbounded preceding and 1 preceding), 0)::hugeint as rest_w from b{i}),
        f{i} as (select *, capacity::hugeint * rest_w <= weight::hugeint * (budget::hugeint - taken) as is_full from o{i}),
        g{i} as (select {keys}, case when is_full then capacity else (weight::hugeint * (budget::hugeint
            - coalesce(sum(capacity) filter (where is_full) over ({over}), 0)::hugeint)) // nullif(sum(weight) filter (where not is_full) over ({over}), 0)::hugeint end::bigint as given from f{i})""")
    keys = ", ".join(levels)
    return f"""
    with d as (
        select doc_id, coalesce('domain' || (try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') as bigint) % {DOMAINS}), 'none') as domain,
            coalesce(lang, 'none') as lang, coalesce(source, 'none') as source,
            len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::bigint as tokens,
            coalesce(doc_id::varchar, '') as id, md5(coalesce(text, '')) as digest
        from {docs}),
        leaves as (select {keys}, sum(tokens)::bigint as tokens from d group by all having sum(tokens) > 0),
        total as (select sum(tokens)::bigint as total from leaves),
        {",".join(parts)},
        plan as (select l.*, g.given // l.tokens as epochs, g.given % l.tokens as rest from leaves l join g{len(levels) - 1} g using ({keys})),
        x as (select d.*, p.epochs, p.rest, md5('1:' || p.epochs || ':' || id || ':' || digest) as o from d join plan p using ({keys})),
        c as (select *, sum(tokens) over (partition by {keys} order by o range between unbounded preceding and current row) as until from x)
    select doc_id, {keys}, tokens, unnest(range(epochs))::bigint as epoch from x
    union all
    select doc_id, {keys}, tokens, epochs as epoch from c where rest > 0 and until <= rest"""


def op7_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_fold("doc_id", 5, 0)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), held_out)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_order_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op9_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_rotated_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: A conversation that imitates a template's turns and ends.
TRICKY = (-7, r"\### Assistant: </turn> ok")


def op11_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    tricky = spark.range(2).select(F.lit(TRICKY[0]).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(TRICKY[1]).alias("text"))
    chats = read_back(render(fold_events(turn_events(turns.union(tricky)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return chats.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def chat_sql() -> str:
    """The same digests from the finished turns."""
    body = r"regexp_replace(regexp_replace(t, '(^|\n)(\\*)### ', '\1\\\2### ', 'g'), '<(\\*)/turn>', '<\\\1/turn>', 'g')"
    return f"""
    with x as (
        select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations
        union all select {TRICKY[0]}, k, ['user', 'assistant'][k + 1], '{TRICKY[1]}' from range(2) s(k))
    select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) as turns_sha256,
        coalesce(sum(length(t)) filter (where r = 'assistant'), 0)::bigint as loss_chars,
        sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) as loss_sha256,
        sum(length('### ' || r || chr(10) || {body} || '</turn>' || chr(10)))::bigint as formatted_chars
    from x group by conv_id"""


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def audit_sql() -> str:
    """The same audit by trying every order on every mask."""
    return r"""
    with d as (
        select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') as w from documents),
    f as (
        select doc_id, part, [len(w) < 200, 100 * list_unique(w) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
            regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) over (partition by t)] as fails from d),
    m as (
        select part, fails, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 1) as toxic
        from f left join labels using (doc_id) group by all),
    l as (select unnest(range(1, 6)) as k),
    o as (
        select [a.k, b.k, c.k, e.k, g.k] as ks, 'ABCDE'[a.k] || 'ABCDE'[b.k] || 'ABCDE'[c.k] || 'ABCDE'[e.k] || 'ABCDE'[g.k] as filter_order
        from l a, l b, l c, l e, l g where list_unique([a.k, b.k, c.k, e.k, g.k]) = 5),
    s as (
        select part, filter_order, step.k as step, ks[step.k] as f, n, good, toxic, fails[ks[step.k]] as fails_here,
            len(list_filter(ks[1:step.k - 1], lambda x: fails[x])) as before, len(list_filter(fails, lambda x: x)) as failing
        from m, o, l step),
    r as (
        select part, filter_order, step::int as step, f, sum(case when before = 0 and not fails_here then n else 0 end)::bigint as kept,
            sum(case when before = 0 and fails_here then n else 0 end)::bigint as removed, sum(case when before > 0 and fails_here then n else 0 end)::bigint as redundant,
            sum(case when failing = 1 and fails_here then n else 0 end)::bigint as unique_fails, sum(case when before = 0 and fails_here then good else 0 end)::bigint as good_lost,
            sum(case when before = 0 and fails_here then toxic else 0 end)::bigint as toxic_lost
        from s group by all)
    select * exclude (f), sum(removed) over (partition by part, f)::bigint as shapley from r"""


def op13_limb_split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label").withColumnRenamed("id", "vec_id")


def codes_sql() -> str:
    """The same codes with every round as two common table expressions."""
    parts = []
    for k in range(ROUNDS + 1):
        parts.append(f"""
        d{k} as (select x.vec_id, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x))::bigint as far from x join b{k} b using (part, place) group by all),
        a{k} as (select vec_id, part, arg_min(entry, far * {ENTRIES} + entry) as entry, min(far) as far from d{k} group by all)""")
        if k < ROUNDS:
            parts.append(f"""
        s{k} as (select x.part, a.entry, x.place, sum(x.x)::hugeint as total, count(*) as n from x join a{k} a using (vec_id, part) group by all),
        b{k + 1} as (select b.part, b.entry, b.place, case when s.n is null then b.x else ((s.total - ((s.total % s.n) + s.n) % s.n) // s.n)::bigint end as x from b{k} b left join s{k} s using (part, entry, place))""")
    return f"""
    with v as (
        select vec_id, label, embedding from embeddings
        where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
        w as (select greatest(1, ceil(max(len(embedding)) / {PARTS}.0)::int) as width from v),
        x as (
            select vec_id, i // width as part, i % width as place, coalesce(floor({SCALE} * embedding[i + 1]::double)::bigint, 0) as x
            from v, w, range(0, (select {PARTS} * width from w)) r(i)),
        b0 as (select part, n - 1 as entry, place, x from x join (select vec_id, row_number() over (order by vec_id) as n from v qualify n <= {ENTRIES}) using (vec_id)),
        {",".join(parts).lstrip()},
        c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(far)::bigint as error from a{ROUNDS} group by all),
        h as (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) as codebooks_sha256 from b{ROUNDS})
    select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from v join c using (vec_id), h"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.col("sequence").alias("sequence_id"),
        "offset",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_histogram_sort_shards": op1_histogram_sort_shards,
        "op2_byte_cnn_quality": op2_byte_cnn_quality,
        "op3_merkle_fingerprints": op3_merkle_fingerprints,
        "op4_deletion_line_dedup": op4_deletion_line_dedup,
        "op5_tag_ratio_html": op5_tag_ratio_html,
        "op6_hierarchical_mix": op6_hierarchical_mix,
        "op7_ngram_toxicity": op7_ngram_toxicity,
        "op8_order_minhash_near_dup": op8_order_minhash_near_dup,
        "op9_bounded_space_packing": op9_bounded_space_packing,
        "op10_rotated_code_links": op10_rotated_code_links,
        "op11_event_sourced_chat": op11_event_sourced_chat,
        "op12_filter_interaction_audit": op12_filter_interaction_audit,
        "op13_limb_split_codes": op13_limb_split_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_hierarchical_mix": mix_sql(), "op11_event_sourced_chat": chat_sql(), "op12_filter_interaction_audit": audit_sql(), "op13_limb_split_codes": codes_sql()}
