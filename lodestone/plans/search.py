"""Chunks, recall, fusion, reranking, tags and the flagship hybrid search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import chunking as C
from ..operators import retrieval as R
from ..sources.durable import durable
from .registry import Family

family = Family()
query = family.query

_W = r"[\p{L}\p{N}_]+"
#: The query sets of these searches: all words of the benchmark passages, and the vectors, whose id is divisible by this.
ONE_IN = 50


def _query_terms(t):
    return t.benchmark.filter(F.col("item_id") % ONE_IN == 0).select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))


def _query_vectors(t):
    return t.embeddings.filter(F.col("vec_id") % ONE_IN == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_TERMS_SQL = f"""w as materialized (select doc_id as id, regexp_extract_all(lower(text), '{_W}') as ws from documents),
 terms as materialized (select id, unnest(ws) as term, len(ws) as dl from w),
 tf as materialized (select id, term, count(*) as tf, any_value(dl) as dl from terms group by id, term),
 st as materialized (select count(*) as n, avg(len(ws)) as avgdl from w),
 qw as materialized (select item_id as query_id, regexp_extract_all(lower(text), '{_W}') as ws from benchmark where item_id % {ONE_IN} = 0),
 q as materialized (select distinct query_id, unnest(ws) as term from qw),
 df as materialized (select term, count(*) as df from tf group by term),
 bm as materialized (select q.query_id, tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from q join tf on tf.term = q.term join df on df.term = q.term cross join st group by 1, 2)"""
_DENSE_SQL = f"""qv as (select vec_id as query_id, embedding as q from embeddings where vec_id % {ONE_IN} = 0),
 de as (select query_id, vec_id, list_cosine_similarity(embedding::double[], q::double[]) as score from embeddings, qv)"""


@query(f"with {_DENSE_SQL} select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from de) where rank <= 10")
def ret01_dense_topk(t):
    return R.dense_topk(t.embeddings, _query_vectors(t), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_DENSE_SQL} select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from de where score >= 0.3 and vec_id in (select vec_id from embeddings where label < 5)) where rank <= 10")
def ret02_ret03_dense_scoped(t):
    scope = t.embeddings.filter("label < 5").select("vec_id")
    return R.dense_topk(t.embeddings, _query_vectors(t), 10, scope, 0.3).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _bm25(t, scope=None):
    return R.scan_bm25(t.documents, "doc_id", "text", _query_terms(t), scope)


@query(f"with {_TERMS_SQL} select query_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from bm) where rank <= 10")
def ret04_bm25_topk(t):
    scored = _bm25(t).withColumn("score", F.round("score", 9))
    return R.topk(scored, 10, "id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"with {_TERMS_SQL} select query_id, id, round(score + case when exact then 8 else 0 end, 6) as score from (select bm.*, d.source = 'src1' as exact from bm join documents d on d.doc_id = bm.id) where exact or score > 3")
def ret05_exact_boost(t):
    exact = t.documents.select(F.col("doc_id").alias("id"), (F.col("source") == "src1").alias("exact"))
    s = _bm25(t).join(exact, "id")
    return s.filter("exact or score > 3").select("query_id", "id", F.round(F.col("score") + F.when(F.col("exact"), R.EXACT_BOOST).otherwise(0), 6).alias("score"))


@query(f"with {_TERMS_SQL}, n as (select query_id, row_number() over (order by query_id) - 1 as k, count(*) over () as m from (select distinct query_id from q)), wanted as (select query_id, doc_id as id from n join documents on doc_id % m = k) select x.query_id, x.id, round(coalesce(bm.score, 0), 6) as score from wanted x left join bm on bm.query_id = x.query_id and bm.id = x.id")
def ret06_bounded_scores(t):
    """Each document is asked for by one query; what a query does not meet scores 0."""
    asked = _query_terms(t).select("query_id").distinct()
    numbered = asked.withColumns({"k": F.row_number().over(Window.orderBy("query_id")) - 1, "m": F.count("*").over(Window.partitionBy(F.lit(0)))})  # the stated queries
    docs = t.documents.select(F.col("doc_id").alias("id"))
    wanted = docs.join(F.broadcast(numbered.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("k", "query_id"))).alias("qs")))).select("id", F.expr("qs[cast(id % m as int)].query_id as query_id"))
    return wanted.join(_bm25(t, docs), ["query_id", "id"], "left").select("query_id", "id", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@query(f"""with q as (select p_partkey as query_id, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) as qw from part where p_partkey % {ONE_IN} = 0), d as (select p_partkey as id, string_split(lower(p_name), ' ') as f1, string_split(lower(p_type), ' ') as f2 from part)
 select query_id, id, greatest(10.0 * len(list_intersect(qw, f1)), 2.0 * len(list_intersect(qw, f2)))::double as score from q, d where len(list_intersect(qw, list_concat(f1, f2)))::double / len(qw) >= 0.3""")
def ret07_multi_field(t):
    """Every fiftieth part's words as a query over the names and types of all parts."""
    field = lambda c: F.split(F.lower(c), " ")
    q = t.part.filter(F.col("p_partkey") % ONE_IN == 0).select(F.col("p_partkey").alias("query_id"), F.explode(F.array_distinct(field(F.concat_ws(" ", "p_name", "p_type")))).alias("term"))
    d = t.part.select(F.col("p_partkey").alias("id"), field("p_name").alias("name"), field("p_type").alias("type"))
    return R.multi_field(d, {"name": 10.0, "type": 2.0}, q, 0.3)


_HYBRID_SQL = f"""{_TERMS_SQL}, {_DENSE_SQL},
 s as (select dense_rank() over (order by query_id) as qn, id, row_number() over (partition by query_id order by round(score, 9) desc, id) as sr from bm),
 d as (select dense_rank() over (order by query_id) as qn, vec_id as id, row_number() over (partition by query_id order by score desc, vec_id) as dr from de),
 f as (select coalesce(s.qn, d.qn) as query_id, coalesce(s.id, d.id) as id, dr, sr, coalesce(0.7 / (60 + dr), 0) + coalesce(0.3 / (60 + sr), 0) as score, least(coalesce(dr, 1000000), coalesce(sr, 1000000)) as best from (select * from s where sr <= 50) s full join (select * from d where dr <= 50) d on s.qn = d.qn and s.id = d.id)"""


def _hybrid(t, k: int):
    number = Window.orderBy("query_id")  # over the stated queries only
    s = R.topk(_bm25(t).withColumn("score", F.round("score", 9)), 50, "id")
    d = R.dense_topk(t.embeddings, _query_vectors(t), 50).withColumnRenamed("vec_id", "id")
    ids = lambda df: df.select("query_id").distinct().withColumn("qn", F.row_number().over(number))
    by_number = lambda hits, queries: hits.join(F.broadcast(ids(queries)), "query_id").select(F.col("qn").alias("query_id"), "id", "rank")
    return R.weighted_rrf(by_number(d, _query_vectors(t)), by_number(s, _query_terms(t)), "id", 0.7, limit=k)


@query(f"with {_HYBRID_SQL} select query_id::int as query_id, id, round(score, 9) as score, rank from (select *, row_number() over (partition by query_id order by score desc, best, id) as rank from f) where rank <= 10")
def ret11_weighted_rrf(t):
    return _hybrid(t, 10).select("query_id", "id", F.round("score", 9).alias("score"), "rank")


@query(f"with {_HYBRID_SQL} select r.query_id::int as query_id, r.id, d.source, d.lang, round(r.score, 9) as score, r.rank from (select *, row_number() over (partition by query_id order by score desc, best, id) as rank from f) r join documents d on d.doc_id = r.id where r.rank <= 10")
def flagship_hybrid_search(t):
    return _hybrid(t, 10).join(t.documents.select(F.col("doc_id").alias("id"), "source", "lang"), "id").select("query_id", "id", "source", "lang", F.round("score", 9).alias("score"), "rank")


@query(f"with {_TERMS_SQL}, x as (select *, id % 7 / 7.0::double as v, min(score) over (partition by query_id) as lo, max(score) over (partition by query_id) as hi from bm) select query_id, id, round(0.7 * v + 0.3 * case when hi = lo then 0.5 else (score - lo) / (hi - lo) end, 6) as score from x")
def ret12_blend(t):
    h = _bm25(t).withColumnRenamed("score", "text").withColumn("vector", F.col("id") % 7 / 7.0)
    return R.blend(h, "vector", "text", 0.7, ["query_id"]).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""with qv as (select vec_id as query_id, embedding as q from embeddings where vec_id % {ONE_IN} = 0),
 ly as (select label::bigint as file_id, vec_id % 2 = 0 as even, embedding, row_number() over (partition by label, vec_id % 2 = 0 order by vec_id) as r from embeddings),
 s as (select query_id, file_id, even, list_cosine_similarity(embedding::double[], q::double[]) as raw from ly, qv where r = 1),
 t0 as (select *, row_number() over (partition by query_id order by raw desc, file_id) as k from s where even),
 l0 as (select query_id, file_id, case when max(raw) over w = min(raw) over w then 0.5 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) end as l0 from t0 where k <= 80 window w as (partition by query_id)),
 t1 as (select *, row_number() over (partition by query_id order by raw desc, file_id) as k from s where not even and file_id in (select file_id from l0)),
 l1 as (select query_id, file_id, case when max(raw) over w = min(raw) over w then 0.5 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) end as l1 from t1 where k <= 5 window w as (partition by query_id)),
 c as (select l0.query_id, l0.file_id, e.vec_id, l0, l1, list_cosine_similarity(e.embedding::double[], q::double[]) as raw from l0 join l1 on l0.query_id = l1.query_id and l0.file_id = l1.file_id join embeddings e on e.label = l0.file_id join qv on qv.query_id = l0.query_id),
 n as (select *, row_number() over (partition by query_id, file_id order by raw desc, vec_id) as k from c),
 m as (select query_id, file_id, vec_id, 0.2 * l0 + 0.3 * l1 + 0.5 * case when max(raw) over w = min(raw) over w then 0.5 else (raw - min(raw) over w) / (max(raw) over w - min(raw) over w) end as score from n where k <= 20 window w as (partition by query_id))
 select query_id, file_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from m) where rank <= 10""")
def ret13_contextual(t):
    e = t.embeddings
    layers = e.select(F.col("label").cast("long").alias("file_id"), F.when(F.col("vec_id") % 2 == 0, "l0").otherwise("l1").alias("layer"), "embedding", "vec_id")
    one = Window.partitionBy("file_id", "layer").orderBy("vec_id")
    layers = layers.withColumn("r", F.row_number().over(one)).filter("r = 1")
    chunks = e.select("vec_id", F.col("label").cast("long").alias("file_id"), "embedding")
    return R.contextual(layers, chunks, _query_vectors(t), 10, 5, 20).withColumn("score", F.round("score", 6))


@query("""with h as (select l_orderkey as query_id, l_linenumber as id, l_extendedprice / 100000.0 as retrieval, l_discount as m, l_partkey, l_suppkey from lineitem), x as (select *, min(m) over (partition by query_id) as lo, max(m) over (partition by query_id) as hi from h)
 select query_id, id, l_partkey, l_suppkey, round(0.6 * case when hi = lo then 0.5 else (m - lo) / (hi - lo) end + 0.4 * retrieval, 6) as score from x""")
def ret18_rerank(t):
    h = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), (F.col("l_extendedprice") / 100000.0).alias("score"), "l_discount", "l_partkey", "l_suppkey")
    return R.rerank(h, F.col("l_discount")).select("query_id", "id", "l_partkey", "l_suppkey", F.round("score", 6).alias("score"))


@query(f"""with q as materialized (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{_W}'))) as tok from benchmark where item_id % {ONE_IN} = 0), d as materialized (select doc_id as id, unnest(list_distinct(regexp_extract_all(lower(text), '{_W}'))) as tok from documents)
 select q.query_id, d.id, round(count(*) / any_value(n)::double, 6) as similarity from q join d using (tok) join (select query_id, count(*) as n from q group by 1) using (query_id) group by 1, 2""")
def ret17_token_similarity(t):
    q = t.benchmark.filter(F.col("item_id") % ONE_IN == 0).select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("tok"), F.lit(1.0).alias("weight"))
    d = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("tok"))
    return R.token_similarity(q, d).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


_RERANK_SQL = f"""{_TERMS_SQL},
 top as (select query_id, id from (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as r from bm) where r <= 64),
 c as (select doc_id as id, list_concat(list_filter(ws, lambda x, i: list_position(ws, x) = i), [lang, source], [lang, source], [source], [source], [source], [source], [source], [lang], [lang], [lang], [lang], [lang], [lang]) as every,
   [lang, source] as tags, case when doc_id % 5 = 0 then [] else [1.0 + doc_id % 3, 2.0] end as tag_weights, (doc_id % 7)::double / 10 as pagerank from (select *, regexp_extract_all(lower(text), '{_W}') as ws from documents)),
 g as (select id, list_distinct(list_concat(every, list_transform(range(1, len(every)), lambda i: every[i] || every[i + 1]))) as grams, tags, tag_weights, pagerank from c),
 kw as (select query_id, w, i, 1.0::double / (1 + i % 4) as weight from (select query_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select query_id, list_filter(ws, lambda x, i: list_position(ws, x) = i) as ws from qw))),
 qg as (select query_id, tok, sum(x) as x from (select query_id, w as tok, 0.4 * weight as x from kw union all
   select query_id, w || lead(w) over o, 0.6 * greatest(weight, lead(weight) over o) from kw window o as (partition by query_id order by i)) where tok is not null group by 1, 2),
 tk as (select t.query_id, t.id, (1e-9 + coalesce(sum(case when list_contains(grams, tok) then x end), 0)) / (1e-9 + sum(x)) as tk from top t join g using (id) join qg on qg.query_id = t.query_id group by 1, 2),
 vt as (select t.query_id, t.id, coalesce(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0) as vt from top t left join embeddings e on e.vec_id = t.id left join embeddings q on q.vec_id = t.query_id),
 parts as (select t.query_id, t.id, tk, vt, sum(vt) over (partition by t.query_id) = 0 as none, pagerank,
   case when len(tag_weights) = 0 then 0 else 10 * (case when list_contains(tags, 'en') then 3.0 * tag_weights[list_position(tags, 'en')] else 0 end + case when list_contains(tags, 'src0') then 4.0 * tag_weights[list_position(tags, 'src0')] else 0 end) / sqrt(tag_weights[1] ** 2 + tag_weights[2] ** 2) / 5 end as feature
   from tk t join vt v on v.query_id = t.query_id and v.id = t.id join g on g.id = t.id)"""


@query(f"with {_RERANK_SQL} select query_id, id, round(case when none then tk else 0.7 * vt + 0.3 * tk end + feature + pagerank, 6) as score, round(tk, 6) as token_part, round(vt, 6) as vector_part from parts")
def ret17_hybrid_rerank(t):
    """The 64 best of each query, scored by words, vectors, tags (of language and source) and rank; for most queries no vector is known."""
    hits = durable(R.topk(_bm25(t).withColumn("score", F.round("score", 9)), 64, "id").select("query_id", "id"), "hits")
    d = R.of_hits(t.documents, "doc_id", hits)
    tags = F.when(F.col("doc_id") % 5 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).otherwise(F.map_from_arrays(F.array("lang", "source"), F.array(1.0 + F.col("doc_id") % 3, F.lit(2.0))))
    grams = R.field_grams(T.words(F.col("text")), title=F.array("lang", "source"), important=F.array("source"), question=F.array("lang"))
    chunks = d.select(F.col("doc_id").alias("id"), grams.alias("grams"), tags.alias("tags"), ((F.col("doc_id") % 7).cast("double") / 10).alias("pagerank"))
    chunks = chunks.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    q = t.benchmark.filter(F.col("item_id") % ONE_IN == 0).select(F.col("item_id").alias("query_id"), F.posexplode(F.array_distinct(T.words(F.col("text")))).alias("pos", "tok"))
    keywords = q.withColumn("weight", 1.0 / (1 + (F.col("pos") + 1) % 4))
    asked = R.query_grams(keywords).join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "left")
    wanted = F.create_map(F.lit("en"), F.lit(3.0), F.lit("src0"), F.lit(4.0))
    found = R.hybrid_rerank(hits, chunks, asked.withColumn("tags", wanted))
    return found.select("query_id", "id", *(F.round(c, 6).alias(c) for c in ("score", "token_part", "vector_part")))


@query("select p_partkey, round(p_retailprice * 0.4 + p_size * 0.01 + p_partkey % 10, 6) as score from part order by p_retailprice * 0.4 + p_size * 0.01 + p_partkey % 10 desc, p_partkey limit 500")
def ret19_score_fusion(t):
    parts = t.part.withColumns({"dense": F.col("p_retailprice"), "sparse": F.col("p_size").cast("double"), "rank": (F.col("p_partkey") % 10).cast("double")})
    return R.score_fusion(parts, {"dense": 0.4, "sparse": 0.01}, 500, "p_partkey", "rank").select("p_partkey", F.round("score", 6).alias("score"))


@query("select p_partkey, round(atan(p_retailprice) / 1.5707963267948966, 6) as normal from part")
def ret19_normal_scores(t):
    return t.part.select("p_partkey", F.round(F.atan("p_retailprice") / 1.5707963267948966, 6).alias("normal"))


@query("""with pr as (select p_brand as tag, round((count(*) + 1) / ((select count(*) from part) + 1000)::double, 9) as portion from part group by 1), c as (select l_suppkey as id, p_brand as tag, count(*) as c from lineitem join part on l_partkey = p_partkey group by 1, 2), n as (select *, sum(c) over (partition by id) as n from c)
 select id, tag, score::int as score from (select id, tag, round_even(0.1 * (c + 1) / (n + 1000) / greatest(1e-6, portion), 0) as score, row_number() over (partition by id order by round_even(0.1 * (c + 1) / (n + 1000) / greatest(1e-6, portion), 0) desc, tag) as r from n join pr using (tag)) where r <= 3""")
def ret20_srt07_tag_content(t):
    priors = R.tag_portions(t.part.select(F.col("p_brand").alias("tag")))
    m = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("tag"))
    return R.tag_items(m, priors, 3)


@query(f"""with s as (select vec_id as sentence_id, embedding as s from embeddings where vec_id % {ONE_IN} = 0), c as (select vec_id as chunk_id, embedding as c from embeddings), p as (select *, max(sim) over (partition by sentence_id) as best from (select sentence_id, chunk_id, list_cosine_similarity(s::double[], c::double[]) as sim from s, c)),
 l as (select coalesce(max(case when best * 0.99 >= 0.63 then 0.63 when best * 0.99 >= 0.504 then 0.504 when best * 0.99 >= 0.4032 then 0.4032 when best * 0.99 >= 0.32256 then 0.32256 end), 9) as level from p)
 select sentence_id, chunk_id from (select *, row_number() over (partition by sentence_id order by sim desc, chunk_id) as r from p, l where best * 0.99 >= level and sim >= best * 0.99) where r <= 4""")
def ret21_citations(t):
    s = t.embeddings.filter(F.col("vec_id") % ONE_IN == 0).select(F.col("vec_id").alias("sentence_id"), F.col("embedding").alias("s"))
    c = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("c"))
    return R.cite(s, c)


@query("""with h as (select o_orderkey as id, o_custkey as doc, o_totalprice / 1000000 as score from orders where o_orderstatus = 'F'),
 d as (select doc from h group by 1 order by round(sum(score), 9) desc, doc limit 1),
 g as (select o_orderkey as id, o_custkey as doc, (o_orderkey % 10) / 10.0 as gain from orders where o_orderkey % 2 = 1 and o_custkey in (select doc from d))
 select id, doc, round(s, 6) as score from (select coalesce(h.id, g.id) as id, coalesce(h.doc, g.doc) as doc, coalesce(score, 0) + coalesce(gain, 0) as s from h full join g on h.id = g.id) order by s desc, id limit 1000""")
def ret22_toc_boost(t):
    """Finished orders as hits, those with odd keys as what the contents of a customer name."""
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("doc"), (F.col("o_totalprice") / 1000000).alias("score"), (F.col("o_orderkey") % 10 / 10.0).alias("gain"), "o_orderstatus")
    hits = orders.filter("o_orderstatus = 'F'").select("id", "doc", "score")
    return R.toc_boost(hits, orders.filter("id % 2 = 1").select("doc", "id", "gain"), orders.select("id", "doc"), 1000).select("id", "doc", F.round("score", 6).alias("score"))


@query("""with k as (select c_nationkey as ws, c_custkey as item, c_acctbal as score, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as r from customer) select item, score, ws from k where r <= 5 order by score desc, item limit 20""")
def ret23_ret24_multi_workspace(t):
    h = t.customer.select(F.col("c_nationkey").alias("ws"), F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("score"))
    return R.multi_scope(h, "ws", "item", 5, 20)


@query("select event_type, count(*) as n from events where contains(props, '\"k\": 1') group by 1 order by n desc limit 3")
def ret26_sql_passthrough(t):
    from ..sources.store import run_sql

    return run_sql(t.spark, "select event_type, count(*) as n from {events} where contains(props, '\"k\": 1') group by 1 order by n desc", {"events": t.events}, limit=3)


@query("select p_brand, count(*) as n from (select p_brand, string_split(lower(p_name || ' ' || p_type), ' ') as ws from part) where len(list_intersect(ws, ['green', 'small', 'steel', 'brass'])) >= 1 group by 1")
def ret26_token_conditions(t):
    """A text written for a search dialect, its conditions on tokens as matches."""
    from ..sources.store import rewrite_token_conditions, run_sql

    parts = t.part.withColumn("content_ltks", F.concat_ws(" ", "p_name", "p_type"))
    return run_sql(t.spark, rewrite_token_conditions("select p_brand, count(*) as n from {parts} where content_ltks like '%green small steel brass%' group by 1"), {"parts": parts})


@query("""with a as (select l_orderkey as q, count(*) as n from lineitem where l_returnflag = 'A' group by 1), c as (select l_orderkey as q, count(*) as n from lineitem where l_returnflag = 'R' group by 1) select coalesce(a.q, c.q) as q, coalesce(a.n, 0) as active, coalesce(c.n, 0) as candidate from a full join c on a.q = c.q where ('0x' || substr(sha256(coalesce(a.q, c.q)::varchar), 1, 8))::bigint / 4294967295.0::double < 0.2""")
def ret27_shadow_comparison(t):
    side = lambda flag, name: t.lineitem.filter(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("q")).agg(F.count("*").alias(name))
    j = side("A", "active").join(side("R", "candidate"), "q", "full_outer").fillna(0, ["active", "candidate"])
    return j.filter(V.hash_sampled(F.col("q").cast("string"), 0.2))


# --- chunks ------------------------------------------------------------------------------------


@query("""with p as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx from documents), q as (select *, coalesce(sum(length(raw) + 1) over (partition by doc_id order by idx rows between unbounded preceding and 1 preceding), 0) as pos from p)
 select doc_id, idx::int as idx, md5(trim(raw, ' ')) as text_md5, (pos + length(raw) - length(ltrim(raw, ' ')))::int as start, (pos + length(raw) - length(ltrim(raw, ' ')) + length(trim(raw, ' ')))::int as stop from q where trim(raw, ' ') <> ''""")
def chk01_src03_paragraphs(t):
    return C.paragraphs(t.documents, "doc_id", "text", "\n").select("doc_id", "idx", F.md5("text").alias("text_md5"), "start", "stop")


@query("""select doc_id, idx::int as idx, start::int as start, md5(trim(substr(text, (start + 1)::bigint, 300), ' ')) as text_md5 from (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 40) / 260.0), 1)::bigint)) as idx, unnest(range(0, greatest(ceil((length(text) - 40) / 260.0), 1)::bigint)) * 260 as start from documents where length(text) > 0) where trim(substr(text, (start + 1)::bigint, 300), ' ') <> ''""")
def chk02_fixed_windows(t):
    return C.fixed_windows(t.documents, "doc_id", "text").select("doc_id", "idx", "start", F.md5("text").alias("text_md5"))


@query(r"""select doc_id, len(p) as n, md5(array_to_string(p, '|')) as parts from (select doc_id, list_filter(regexp_extract_all(text, '[^.;]*[.;]?'), lambda x: x <> '') as p from documents)""")
def chk04_keep_delimiter(t):
    p = C.keep_delimiter(F.col("text"), ".;")
    return t.documents.select("doc_id", F.size(p).alias("n"), F.md5(F.array_join(p, "|")).alias("parts"))


@query("""with b as (select conv_id, turn, trim(text, ' ') as text from conversations where trim(text, ' ') <> '') select conv_id, turn, coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as start from b""")
def chk18_canonical_source(t):
    return C.canonical_source(t.conversations, "conv_id", "turn", "text").select("conv_id", "turn", F.col("start").cast("long").alias("start"))


@query("select conv_id, md5(string_agg(text, chr(10) order by turn)) as body, count(*) as n from conversations group by 1")
def chk17_one_chunk(t):
    return C.whole_document(t.conversations, "conv_id", "turn", "text").select("conv_id", F.md5("text").alias("body"), "n")


@query("select conv_id, md5(substr(string_agg('- ' || string_split(text, chr(10))[1], chr(10) order by turn), 1, 2000)) as l1 from conversations group by 1")
def chk20_hierarchy(t):
    return C.hierarchy(t.conversations, "conv_id", "turn", "text").select("conv_id", F.md5("l1").alias("l1"))


@query("select source, md5(substr(string_agg(substr(text, 1, 100), chr(10) order by doc_id), 1, 2000)) as abstract, count(*) as n from (select *, row_number() over (partition by source order by doc_id) as r from documents) where r <= 5 group by 1")
def chk20_roll_up(t):
    d = t.documents.select("source", "doc_id", F.substring("text", 1, 100).alias("head"))
    return C.roll_up(d, "source", "doc_id", "head").select("source", F.md5("abstract").alias("abstract"), "n")


@query("select page_id, list_transform(range(1, greatest(len(p) - 1, 1) + 1), lambda i: array_to_string(p[1:i], '/')) as up from (select page_id, string_split(url, '/') as p from pages)")
def chk21_ancestors(t):
    from ..operators.scope import ancestors

    return t.pages.select("page_id", ancestors(F.col("url")).alias("up"))


@query()
def chk03_naive_merge(t):
    return C.chunk_each(t.documents, "doc_id", "text", lambda x: C.merge_sections(x.split("\n"), 128, 10, C.LEAST))


@query()
def chk08_recursive_chunks(t):
    return C.chunk_each(t.documents, "doc_id", "text", lambda x: C.split_recursive(x, C.SIZE))


@query()
def chk09_chk13_structured_chunks(t):
    marked = t.documents.select("doc_id", F.regexp_replace("text", r"(?m)^([A-Z]\w{2,8})\.$", "# $1").alias("text"))
    return C.chunk_each(marked, "doc_id", "text", lambda x: [c for _, c in C.chunk_structured(x.split("\n"), C.SIZE)])


@query()
def win05_win07_pack_and_paths(t):
    def task(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                lines = (text or "").split("\n")
                levels = [1 + len(x) % 3 if len(x) < 40 else 0 for x in lines]
                bins = C.pack([max(1, len(x) // 4) for x in lines], 256)
                rows += [(doc, i, b, p) for i, (b, p) in enumerate(zip(bins, C.heading_paths(levels, lines), strict=True))]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "bin", "path"])

    return t.documents.select("doc_id", "text").mapInPandas(task, "doc_id long, line int, bin int, path string")


@query(f"""with w as (select item_id as query_id, regexp_extract_all(lower(text), '{_W}') as ws from benchmark), t as (select query_id, unnest(ws) as term, generate_subscripts(ws, 1) as pos from w), p as (select query_id, term, lead(term) over (partition by query_id order by pos) as nxt from t)
 select query_id, term, max(weight) as weight from (select query_id, term, 1.0::double as weight from t union all select query_id, 'syn-' || term, 0.25 from t where length(term) > 5 union all select query_id, term || ' ' || nxt, 2.0 from p where nxt is not null) group by 1, 2 qualify row_number() over (partition by query_id order by max(weight) desc, term) <= 256""")
def ret08_ret09_expansion(t):
    from ..operators.expansion import expand_query

    terms = t.benchmark.select(F.col("item_id").alias("query_id"), F.posexplode(T.words(F.col("text"))).alias("pos", "term")).withColumn("weight", F.lit(1.0))
    synonyms = terms.filter("length(term) > 5").select("term", F.concat(F.lit("syn-"), "term").alias("synonym"), F.lit(1).alias("rank")).distinct()
    return expand_query(terms, synonyms).select("query_id", "term", "weight")


@query()
def clu01_cluster_tree(t):
    from ..operators.clustering import cluster_tree

    nodes = t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("string").alias("text"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    mean = F.transform(F.get("embeddings", F.lit(0)), lambda x, i: F.aggregate("embeddings", F.lit(0.0), lambda s, v: s + F.get(v, i)) / F.size("embeddings"))
    return cluster_tree(nodes, lambda g: g.select("cluster", F.get("texts", F.lit(0)).alias("text"), mean.alias("embedding")), levels=3)
