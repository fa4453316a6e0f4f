"""Registered queries of the operators and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.llm import ann, audit, exact_dedup, jaccard, packing, pieces, quality, repair, secrets, substring, toxicity, warc, wrappers
from passbook.llm.common import table


def op1_co_training(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_pruned_graph(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_grace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op4_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op5_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


def op6_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    return substring.substring_dedup(table(spark, folder, "documents"), with_text=False)


def op7_secret_structure(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op8_piece_rounds(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encode_decode(table(spark, folder, "documents"), path, with_ids=False)


def op9_kernel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_order_filters(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, folder, "documents"))


def op11_host_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


def op12_removal_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_run_length_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_audit(repair.damage(table(spark, folder, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_co_training,
        op2_pruned_graph,
        op3_grace_dedup,
        op4_best_fit,
        op5_warc_segments,
        op6_seed_extend,
        op7_secret_structure,
        op8_piece_rounds,
        op9_kernel_toxicity,
        op10_order_filters,
        op11_host_wrappers,
        op12_removal_ranks,
        op13_run_length_repair,
    )
}

#: The other operators learn, search, pack or count shingle by shingle; tests compare them with brute force.
ORACLES = {
    "op3_grace_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
    "op12_removal_ranks": r"""
        with flags as (
            select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
            from labels where doc_id is not null group by doc_id),
        texts as (
            select d.doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from documents d left join flags l on d.doc_id = l.doc_id),
        masks as (
            select part, good, toxic,
                   case when len(words) < 200 then 1 else 0 end
                   + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
                   + case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 4 else 0 end
                   + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
                   + case when doc_id > min(doc_id) over (partition by text) then 16 else 0 end as mask
            from texts),
        counts as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masks group by all),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
        orders as (
            select a.f || b.f || c.f || d.f || e.f as filter_order
            from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        ranks as (
            select filter_order, m as mask, min(case when m & bit > 0 then instr(filter_order, f) else 6 end) as rank
            from orders, letters, range(32) r(m) group by all),
        steps as (
            select part, filter_order, instr(filter_order, f) as step, f,
                   sum(case when rank > instr(filter_order, f) then n else 0 end) as kept,
                   sum(case when rank = instr(filter_order, f) then n else 0 end) as removed,
                   sum(case when rank < instr(filter_order, f) and mask & bit > 0 then n else 0 end) as redundant,
                   sum(case when mask = bit then n else 0 end) as unique_fails,
                   sum(case when rank = instr(filter_order, f) then good else 0 end) as good_lost,
                   sum(case when rank = instr(filter_order, f) then toxic else 0 end) as toxic_lost
            from counts join ranks using (mask), letters group by all)
        select part, filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
               unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
               (sum(removed) over (partition by part, f))::bigint as shapley
        from steps""",
}
