"""Evaluation, traces, cleaning, lifecycle and scheduling over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import cleaning as C
from ..operators import evaluation as E
from ..operators import lifecycle as L
from ..operators import scope as S
from .registry import Family

family = Family()
query = family.query

# results: lineitem as ranked lists (order = query, part = chunk); judgments: another view of the same orders
_EVAL_SQL = """res as (select l_orderkey as query_id, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) as rank, l_partkey % 20 as chunk_id from lineitem),
 jud as (select l_orderkey as query_id, l_partkey % 20 as chunk_id, l_linenumber % 4 as grade, case l_returnflag when 'A' then 'gold_manual' when 'R' then 'business_import' else 'llm_assisted' end as source, case when l_quantity > 45 then 0.5 end as weight from lineitem where l_discount > 0.03),
 rel as (select query_id, chunk_id, sum(case when grade >= 2 then w else 0 end) as rel, sum(grade * w) as gain from (select *, coalesce(weight, case source when 'gold_manual' then 1.0 when 'business_import' then 0.7 else 0.4 end)::double as w from jud) group by 1, 2),
 hit as (select * from (select *, row_number() over (partition by query_id, chunk_id order by rank) as nth from res where rank <= 5) where nth = 1),
 sc as (select h.query_id, h.rank, coalesce(r.rel, 0) as rel, coalesce(r.gain, 0) as gain from hit h left join rel r on h.query_id = r.query_id and h.chunk_id = r.chunk_id),
 ru as (select *, sum(rel) over (partition by query_id order by rank rows unbounded preceding) as so_far from sc),
 got as (select query_id, sum(rel) as s, min(case when rel > 0 then rank end) as first, sum(case when rel > 0 then rel * so_far / rank else 0 end) as ap, sum(gain / log2(rank + 1)) as dcg from ru group by 1),
 ide as (select query_id, sum(rel) as total, sum(case when pos <= 5 then gain / log2(pos + 1) else 0 end) as idcg from (select *, row_number() over (partition by query_id order by gain desc, chunk_id) as pos from rel) group by 1),
 met as (select g.query_id, case when coalesce(total, 0) > 0 then s / 5 else 0 end as precision, case when coalesce(total, 0) > 0 then s / total else 0 end as recall, case when s > 0 then 1.0 else 0.0 end::double as hit_rate, case when first > 0 then 1.0 / first else 0 end::double as mrr, case when coalesce(total, 0) > 0 then ap / total else 0 end as ap, case when coalesce(idcg, 0) > 0 then dcg / idcg else 0 end as ndcg from got g left join ide on g.query_id = ide.query_id)"""


def _metrics(t):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    results = t.lineitem.select(F.col("l_orderkey").alias("query_id"), rank.alias("rank"), (F.col("l_partkey") % 20).alias("chunk_id"))
    source = F.when(F.col("l_returnflag") == "A", "gold_manual").when(F.col("l_returnflag") == "R", "business_import").otherwise("llm_assisted")
    judgments = t.lineitem.filter("l_discount > 0.03").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 20).alias("chunk_id"), (F.col("l_linenumber") % 4).alias("grade"), source.alias("source"), F.when(F.col("l_quantity") > 45, 0.5).alias("weight"))
    return E.query_metrics(results, judgments, 5)


@query(f"with {_EVAL_SQL} select query_id, round(precision, 6) as precision, round(recall, 6) as recall, hit_rate, round(mrr, 6) as mrr, round(ap, 6) as ap, round(ndcg, 6) as ndcg from met")
def evl01_to_evl08_query_metrics(t):
    m = _metrics(t)
    return m.select("query_id", *[F.round(c, 6).alias(c) if c != "hit_rate" else "hit_rate" for c in m.columns[1:]])


@query(f"with {_EVAL_SQL} select metric, round(avg(v), 6) as mean, round(quantile_disc(v, 0.95), 6) as p95 from (unpivot (select precision::double as precision, recall::double as recall, hit_rate, mrr, ap::double as ap, ndcg::double as ndcg from met) on precision, recall, hit_rate, mrr, ap, ndcg into name metric value v) group by metric")
def evl09_evl15_run_summary(t):
    return E.summarise(_metrics(t)).select("metric", F.round("mean", 6).alias("mean"), F.round("p95", 6).alias("p95"))


@query("""with a as (select avg(l_discount) as recall, avg(l_tax) as ndcg, avg(l_quantity) / 50 as mrr, quantile_disc(l_extendedprice, 0.95) as p95 from lineitem where l_orderkey % 2 = 0), c as (select avg(l_discount) as recall, avg(l_tax) as ndcg, avg(l_quantity) / 50 as mrr, quantile_disc(l_extendedprice, 0.95) as p95 from lineitem where l_orderkey % 2 = 1)
 select 'recall' as metric, a.recall - c.recall <= 0.02 as passed from a, c union all select 'ndcg', a.ndcg - c.ndcg <= 0.02 from a, c union all select 'mrr', a.mrr - c.mrr <= 0.02 from a, c union all select 'p95_ms', c.p95 <= a.p95 * 1.2 from a, c union all select 'leaks', (select count(*) from customer where c_nationkey > 24) = 0""")
def evl11_quality_gate(t):
    side = lambda r: t.lineitem.filter(F.col("l_orderkey") % 2 == r).select(F.col("l_discount").alias("recall"), F.col("l_tax").alias("ndcg"), (F.col("l_quantity") / 50).alias("mrr"), F.col("l_extendedprice").alias("latency_ms"))
    return E.quality_gate(side(0), side(1), t.customer.filter("c_nationkey > 24")).select("metric", "passed")


@query("select l_shipmode_stage as stage, round(avg(hit), 6) as recall from (select case when l_linenumber <= 2 then 'dense' when l_linenumber <= 4 then 'fused' else 'reranked' end as l_shipmode_stage, (l_returnflag = 'A')::int as hit from lineitem) group by 1")
def evl07_stage_recall(t):
    stage = F.when(F.col("l_linenumber") <= 2, "dense").when(F.col("l_linenumber") <= 4, "fused").otherwise("reranked")
    return t.lineitem.groupBy(stage.alias("stage")).agg(F.round(F.avg((F.col("l_returnflag") == "A").cast("int")), 6).alias("recall"))


@query("select user_id, count(*) as spans, count(*) filter (event_type = 'error') as errors, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) as duration_ms from events where event_type is not null group by 1")
def evl13_evl14_trace_summary(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.groupBy("user_id").agg(F.count("*").alias("spans"), F.count_if(F.col("event_type") == "error").alias("errors"), V.duration_ms(F.min(ts), F.max(ts)).alias("duration_ms"))


# --- cleaning ----------------------------------------------------------------------------------


@query("select doc_id, strlen(text) as size_bytes, count(*) over (partition by source) as n_same from documents")
def cln01_manifest(t):
    return C.manifest(t.documents, "doc_id", "source", "text").select("doc_id", F.col("size_bytes").cast("long").alias("size_bytes"), "n_same")


@query("select doc_id, sha256(text) as text_sha256, length(text) as char_count, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) as non_empty_lines from documents")
def cln02_encoding_report(t):
    return C.encoding_report(t.documents, "doc_id", "text").select("doc_id", "text_sha256", "char_count", "non_empty_lines")


_CLEAN_SQL = """l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
 k as (select *, trim(line, ' ') = '' as blank, regexp_matches(trim(line, ' '), '^(?:[-_=*]{3,}|第?\\s*\\d+\\s*页|\\d+\\s*/\\s*\\d+|- ?\\d+ ?-)$') as sep from l),
 p as (select *, coalesce(lag(blank) over (partition by doc_id order by pos), true) as pb from k where not sep),
 s as (select *, sum(case when blank then 0 else 1 end) over (partition by doc_id order by pos) as nth, regexp_replace(regexp_replace(trim(line, ' '), '^#{1,6}\\s+', ''), '\\s+', '', 'g') as title from p where not (blank and pb)),
 f as (select *, max(case when nth = 1 and not blank then title end) over (partition by doc_id) as ft from s),
 c as (select doc_id, trim(string_agg(rtrim(line, ' '), chr(10) order by pos), ' ') as clean, 0 as x from f where not (nth = 2 and not blank and title = ft and title <> '') group by 1)"""


@query(f"with {_CLEAN_SQL} select d.doc_id, md5(coalesce(c.clean, '')) as clean_md5, coalesce((select count(*) from k where k.doc_id = d.doc_id and sep), 0) as removed_separator from documents d left join c on c.doc_id = d.doc_id")
def cln03_cln04_clean_lines(t):
    return C.clean_lines(t.documents, "doc_id", "text").select("doc_id", F.md5("clean").alias("clean_md5"), "removed_separator")


@query(f"""with {_CLEAN_SQL}, xx as (select d.doc_id, coalesce(c.clean, '') as clean, length(regexp_replace(coalesce(c.clean, ''), '\\s+', '', 'g')) as n from documents d left join c on c.doc_id = d.doc_id),
 re as (select *, case when n = 0 then 'empty' when n < 20 then 'too_short' end as why, sha256(clean) as clean_sha256 from xx),
 fi as (select clean_sha256, min(doc_id) as first_id from re where why is null group by 1)
 select doc_id, case when why is null and first_id = doc_id then 'kept' else 'dropped' end as decision, coalesce(why, case when first_id <> doc_id then 'duplicate' else 'ok' end) as reason, case when why is null and first_id <> doc_id then first_id end as kept_by, clean_sha256
 from re left join fi using (clean_sha256)""")
def cln05_cln06_decisions(t):
    cleaned = C.clean_lines(t.documents, "doc_id", "text")
    return C.decide(cleaned, "doc_id", "doc_id").select("doc_id", "decision", "reason", "kept_by", "clean_sha256")


@query("select doc_id from (select doc_id, row_number() over (partition by sha256(text) order by doc_id) as r from documents where not exists (select 1 from benchmark b where b.text = documents.text)) where r = 1")
def cln07_cross_corpus_dedupe(t):
    from pyspark.sql import Window as W

    rest = t.documents.select("doc_id", F.sha2("text", 256).alias("h")).join(t.benchmark.select(F.sha2("text", 256).alias("h")), "h", "left_anti")
    return rest.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("doc_id"))).filter("r = 1").select("doc_id")


@query("""with d as (select doc_id, case when n_chars <= 800 then 'short' when n_chars <= 3000 then 'medium' when n_chars <= 8000 then 'long' else 'very_long' end as bucket, contains(text, '|') as risk, sha256('7|' || doc_id) as h from documents), r as (select *, row_number() over (partition by bucket order by h, doc_id) as nth from d)
 select doc_id, bucket, tier from (select *, case when nth <= 20 then 0 when risk then 1 else 2 end as tier from r) order by tier, h, doc_id limit 120""")
def cln08_stratified_sample(t):
    from ..functions.text import length_bucket

    d = t.documents.select("doc_id", length_bucket(F.col("n_chars")).alias("bucket"), F.contains("text", F.lit("|")).alias("risk"))
    return C.stratified_sample(d, "doc_id", "bucket", "risk", 20, 120, "7").select("doc_id", "bucket", "tier")


@query("select doc_id, len(f) as n_flags from (select doc_id, list_filter([case when length(regexp_replace(text, '\\s+', '', 'g')) = 0 then 'empty' when length(regexp_replace(text, '\\s+', '', 'g')) < 100 then 'short' end], lambda x: x is not null) as f from documents)")
def cln09_review_flags(t):
    return t.documents.select("doc_id", F.size(C.review_flags(F.col("text"), F.col("n_chars"))).alias("n_flags"))


@query("""with c as (select doc_id, len(regexp_extract_all(text, '第[一二三四五六七八九十百0-9]+条|Article [0-9]+')) as laws, len(regexp_extract_all(text, '操作|步骤|点击|Step [0-9]+|Chapter [0-9]+')) as steps from documents), k as (select case when laws >= 3 then 'laws' when steps >= 3 then 'manual' else 'general' end as category, case when laws >= 8 or steps >= 8 then 'high' when laws >= 3 or steps >= 3 or laws + steps = 0 then 'medium' else 'low' end as confidence from c)
 select category, confidence, count(*) as n, round(100.0::double * count(*) / (select count(*) from k), 2) as percent from k group by 1, 2""")
def cln10_cln11_classification(t):
    return C.distribution(C.classify(t.documents, "doc_id", "text"), ["category", "confidence"])


# --- lifecycle and scheduling ------------------------------------------------------------------


@query("""select 'missing_files' as check, count(*) as failures from customer where c_custkey not in (select o_custkey from orders) union all select 'orphan_chunks', 0 union all select 'chunks_without_vector', count(*) from orders where o_orderkey not in (select vec_id from embeddings) union all select 'vectors_without_chunk', count(*) from embeddings where vec_id not in (select o_orderkey from orders) union all select 'duplicate_chunk_ids', 0 union all select 'empty_texts', 0 union all select 'invalid_vectors', 0
 union all select 'count_mismatch', count(*) from (select o_custkey from orders group by 1 having count(*) <> 10)""")
def idx01_validation_report(t):
    files = t.customer.select(F.col("c_custkey").alias("file_id"), F.lit(10).alias("expected"))
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("text"))
    vectors = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return L.validation_report(files, chunks, vectors, V.valid_vector(F.col("embedding"), 64)).select("check", "failures")


@query("""with a as (select c_custkey as id, md5(c_name) as h from customer where c_custkey % 10 <> 0), b as (select c_custkey as id, case when c_custkey % 7 = 0 then md5('x') else md5(c_name) end as h from customer where c_custkey % 9 <> 0) select coalesce(a.id, b.id) as id, case when a.id is null then 'new' when b.id is null then 'gone' when a.h = b.h then 'same' else 'stale' end as state from a full join b on a.id = b.id""")
def idx02_change_scan(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("h"))
    return L.change_scan(c.filter("id % 10 <> 0"), c.filter("id % 9 <> 0").withColumn("h", F.when(F.col("id") % 7 == 0, F.md5(F.lit("x").cast("binary"))).otherwise(F.col("h"))), "id", "h")


@query("select o_orderstatus, count(*) filter (o_orderdate < timestamp '1996-01-01') as built, count(*) filter (o_orderdate >= timestamp '1996-01-01') as lag, count(*) = count(distinct o_orderkey) as complete from orders group by 1")
def idx03_idx06_build_lag(t):
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    d = F.col("o_orderdate").cast("timestamp_ntz")
    return t.orders.groupBy("o_orderstatus").agg(F.count_if(d < cut).alias("built"), F.count_if(d >= cut).alias("lag"), (F.count("*") == F.countDistinct("o_orderkey")).alias("complete"))


@query("select o_orderkey as generation_id from orders where o_orderstatus = 'F' and o_orderdate < timestamp '1997-01-01' - interval 30 day and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def idx04_retention(t):
    g = t.orders.select(F.col("o_orderkey").alias("generation_id"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("state"), F.col("o_orderdate").cast("timestamp_ntz").alias("retired_at"))
    return L.retention(g, t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("generation_id")), F.lit("1997-01-01").cast("timestamp_ntz"), 30).select("generation_id")


@query("select page_id from pages where not (starts_with(url, 'https://') and page_id % 3 = 0)")
def idx07_stm06_delete_watermark(t):
    at = F.when(F.col("page_id") % 3 == 0, F.lit("2024-01-01").cast("timestamp")).when(F.col("page_id") % 3 == 1, F.lit("2024-02-01").cast("timestamp"))
    marked = L.soft_delete(t.pages.select("page_id", F.col("url").alias("uri"), at.alias("deleted_at")), "https:/", F.lit("2024-03-01").cast("timestamp"))
    return L.purge(marked, "https:/", F.lit("2024-01-15").cast("timestamp")).select("page_id")


@query("""with p as (select c_nationkey as workspace, count(*) as pending, (1 + c_nationkey % 4)::double as weight, 8 as free from customer group by 1), a as (select *, least(pending, free) as cap from p where least(pending, free) > 0), f as (select *, (row_number() over (order by weight desc, workspace) <= 60)::int as base from a), q as (select *, least(cap, base + floor(greatest(60 - sum(base) over (), 0) * weight / sum(weight) over ())) as quota from f)
 select workspace, quota::bigint as quota, round(case when quota > 0 then weight * 0.8 else weight end, 6) as next_weight from q""")
def sch01_fair_quotas(t):
    p = t.customer.groupBy(F.col("c_nationkey").alias("workspace")).agg(F.count("*").alias("pending")).withColumn("weight", (1 + F.col("workspace") % 4).cast("double")).withColumn("free", F.lit(8))
    return L.fair_quotas(p, 60).withColumn("next_weight", F.round("next_weight", 6))


@query("select event_id, case when event_type in ('click', 'view') and ts < timestamp '2024-01-15' - interval 10 minute then 'pending' when event_type = 'click' then 'assigned' when event_type = 'view' then 'started' else 'done' end as status from events")
def sch02_stm04_recover_timeouts(t):
    status = F.when(F.col("event_type") == "click", "assigned").when(F.col("event_type") == "view", "started").otherwise("done")
    tasks = t.events.select("event_id", status.alias("status"), F.col("ts").cast("timestamp").alias("heartbeat_at"), F.lit(0).alias("retries"))
    return L.recover_timeouts(tasks, F.lit("2024-01-15").cast("timestamp")).select("event_id", "status")


@query("select doc_id, case when n_chars < 1000 then 'fast' when n_chars < 10000 then 'normal' else 'slow' end as queue, case when n_chars < 1000 then 8 when n_chars < 10000 then 5 else 2 end as priority, case when lang = 'en' then 10 when lang = 'de' then 5 when lang = 'fr' then 3 else 5 end as by_role from documents")
def sch03_priorities(t):
    queue, priority = L.size_priority(F.col("n_chars") * 1000)
    role = F.when(F.col("lang") == "en", "admin").when(F.col("lang") == "de", "member").when(F.col("lang") == "fr", "viewer")
    return t.documents.select("doc_id", queue.alias("queue"), priority.alias("priority"), L.role_priority(role).alias("by_role"))


@query("select doc_id, source from documents where source in ('src1', 'src2') and lang is not null")
def evl13_optional_filters(t):
    return t.documents.filter(S.condition({"source": ["src1", "src2"], "lang": None})).filter("lang is not null").select("doc_id", "source")
