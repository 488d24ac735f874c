"""Filters, projections, joins, aggregates, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scope as S
from .registry import Family

family = Family()
query = family.query


# --- filters -----------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def flt01_condition_dict(t):
    return t.orders.filter(S.condition({"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": None})).select("o_orderkey", "o_totalprice")


@query("select doc_id, coalesce(quality, 1) >= 1 as available from documents left join labels using (doc_id)")
def flt02_available(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", S.available(F.col("quality")).alias("available"))


@query("select count(*) as n, count(*) filter (quality is null) as missing from documents left join labels using (doc_id)")
def flt03_exists(t):
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("missing"))


@query("select o_custkey from (select o_custkey, list(distinct o_orderpriority) as k from orders group by o_custkey) where list_has_any(k, ['1-URGENT', '5-LOW'])")
def flt04_array_any(t):
    k = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("k"))
    return k.filter(F.arrays_overlap("k", F.array(F.lit("1-URGENT"), F.lit("5-LOW")))).select("o_custkey")


@query("""select event_id from events where (json_extract_string(props, '$.k')::decimal(20,10) >= 50 and json_extract_string(props, '$.k') <> '') or contains(lower(coalesce(json_extract_string(props, '$.k'), '')), '7')""")
def flt05_metadata_json(t):
    return S.metadata_filter(t.events, "props", [("k", ">=", "50"), ("k", "contains", "7")], "or").select("event_id")


@query("""select event_id from events where json_extract_string(props, '$.k')::decimal(20,10) > 10 and json_extract_string(props, '$.k')::decimal(20,10) <= 40 and not contains(json_extract_string(props, '$.k'), '3')""")
def flt06_flt07_typed_metadata(t):
    return S.metadata_filter(t.events, "props", [("k", ">", "10"), ("k", "<=", "40"), ("k", "not contains", "3")]).select("event_id")


@query("select event_id from events where false")
def flt08_manual_empty(t):
    return S.metadata_filter(t.events, "props", [], manual=True).select("event_id")


@query("select page_id from pages where starts_with(url, 'https://') or url = 'https:/' or starts_with(url, 'http:/x/') or url = 'http:/x'")
def flt09_path_scope(t):
    return S.path_scope(t.pages.select("page_id", "url"), "url", ["https:/", "http:/x"]).select("page_id")


@query("""with p as (select distinct regexp_replace(url, '/+$', '') as url from pages) select a.url from p a where not exists (select 1 from p b where b.url <> a.url and starts_with(a.url, b.url || '/'))""")
def flt10_compact_paths(t):
    return S.compact_paths(t.pages, "url")


@query("select c_custkey from customer where contains(lower(c_name), '#00000001')")
def flt11_name_search(t):
    return t.customer.filter(S.name_contains(F.col("c_name"), "#00000001")).select("c_custkey")


@query("select doc_id, source, n_chars from documents where lang = 'en' and n_chars between 500 and 5000 order by n_chars desc, doc_id limit 25 offset 25")
def flt12_file_list(t):
    return t.documents.filter("lang = 'en' and n_chars between 500 and 5000").orderBy(F.desc("n_chars"), "doc_id").offset(25).limit(25).select("doc_id", "source", "n_chars")


_MEMBERS = """m as (select c_custkey as usr, c_nationkey as workspace, case when c_acctbal > 0 then 'write' else 'read' end as role from customer),
 g as (select s_suppkey as usr, s_nationkey as workspace, s_acctbal > 1000 as active, case when s_suppkey % 2 = 0 then 'write' else 'read' end as permission from supplier)"""


def _membership(t):
    members = t.customer.select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("workspace"), F.when(F.col("c_acctbal") > 0, "write").otherwise("read").alias("role"))
    grants = t.supplier.select(F.col("s_suppkey").alias("user"), F.col("s_nationkey").alias("workspace"), (F.col("s_acctbal") > 1000).alias("active"), F.when(F.col("s_suppkey") % 2 == 0, "write").otherwise("read").alias("permission"))
    return members, grants


@query(f"""with {_MEMBERS} select distinct usr as user_id, workspace from (select usr, workspace from m where role = 'write' union all select usr, workspace from g where active and permission = 'write' union all select usr, workspace from m where usr % 100 = 0)""")
def flt13_jn06_set01_permissions(t):
    members, grants = _membership(t)
    admins = members.filter(F.col("user") % 100 == 0).select("user")
    return S.permitted(members.select("user", "workspace"), members, grants, admins, "write").withColumnRenamed("user", "user_id")


@query("select e.event_id, e.user_id from events e where e.user_id in (select c_custkey from customer where c_acctbal > 0)")
def flt14_flt15_jn07_authorised_hits(t):
    hits = t.events.select("event_id", F.col("user_id").cast("string").try_cast("bigint").alias("user_id")).filter("user_id is not null")
    return hits.join(t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")), "user_id", "left_semi").select("event_id", "user_id")


@query("""select l_orderkey, l_linenumber from (select *, l_quantity > 45 as keep, max(l_quantity > 45) over (partition by l_orderkey) as anyk from lineitem) where keep or not anyk""")
def flt16_restrict_or_all(t):
    any_kept = F.max(F.col("l_quantity") > 45).over(Window.partitionBy("l_orderkey"))
    return t.lineitem.withColumn("any_kept", any_kept).filter((F.col("l_quantity") > 45) | ~F.col("any_kept")).select("l_orderkey", "l_linenumber")


@query("""select event_id from events where event_type = 'view' or (event_type = 'error' and ts + interval 2 minute <= timestamp '2024-01-15')""")
def flt17_ready_tasks(t):
    due = F.col("ts").cast("timestamp") + F.expr("interval 2 minutes") <= F.lit("2024-01-15").cast("timestamp")
    return t.events.filter((F.col("event_type") == "view") | ((F.col("event_type") == "error") & due)).select("event_id")


@query("select c_custkey::varchar as id, coalesce(c_name, '')::varchar as name, round(c_acctbal, 2)::varchar is not null as shown from customer")
def prj01_prj03_fields(t):
    return t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.coalesce("c_name", F.lit("")).alias("name"), F.col("c_acctbal").cast("string").isNotNull().alias("shown"))


@query("select l_orderkey, l_linenumber, o_orderdate, c_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_quantity >= 49")
def prj02_enrich_hits(t):
    hits = t.lineitem.filter("l_quantity >= 49").select("l_orderkey", "l_linenumber")
    return hits.join(t.orders, hits["l_orderkey"] == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("l_orderkey", "l_linenumber", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "c_name")


@query("""select source, string_agg(doc_id::varchar, ',' order by n_chars desc, doc_id) as context, count(*) as n from (select *, sum(greatest(1, length(text) // 4)) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) as used from documents) where used <= 0.97 * 20000 group by source""")
def prj04_win04_prompt_context(t):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    kept = t.documents.withColumn("used", F.sum(T.token_count(F.col("text"))).over(w)).filter(F.col("used") <= 0.97 * 20000)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("k"), "doc_id")))
    return kept.groupBy("source").agg(F.array_join(F.transform(ordered, lambda x: x["doc_id"].cast("string")), ",").alias("context"), F.count("*").alias("n"))


@query("""select conv_id, turn, substr(text, 1, 4 * greatest(0, 200 - 0)::int) as text from (select *, max(turn) over (partition by conv_id) as last from conversations) where turn = last or role = 'system'""")
def prj05_message_fit(t):
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return t.conversations.withColumn("last", last).filter("turn = last or role = 'system'").select("conv_id", "turn", T.truncate_tokens(F.col("text"), 200).alias("text"))


# --- joins -------------------------------------------------------------------------------------


@query("select r_name, n_name from region join nation on r_regionkey = n_regionkey")
def jn01_inner(t):
    return t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")


@query("select c.c_custkey, n.n_name, count(o.o_orderkey) as n_orders from customer c left join nation n on c.c_nationkey = n.n_nationkey left join orders o on o.o_custkey = c.c_custkey group by 1, 2")
def jn02_left_joins(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))  # pre-aggregated, so the join adds no rows
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(counts, "c_custkey", "left")
    return j.select("c_custkey", "n_name", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("""with b as (select o_custkey as k, avg(o_totalprice) as m from orders where o_orderkey % 2 = 0 group by 1), c as (select o_custkey as k, avg(o_totalprice) as m from orders where o_orderkey % 2 = 1 group by 1)
 select coalesce(b.k, c.k) as k, b.k is not null as in_baseline, c.k is not null as in_candidate, case when b.k is null then 'missing_baseline' when c.k is null then 'missing_candidate' when c.m is null or b.m is null then 'missing_metric' when c.m - b.m >= 1000 then 'improved' when c.m - b.m <= -1000 then 'regressed' else 'unchanged' end as change_type from b full join c on b.k = c.k""")
def jn03_evl10_evl12_compare_runs(t):
    from ..operators.evaluation import compare_metric

    half = lambda r: t.orders.filter(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("m"))
    return compare_metric(half(0), half(1), "k", "m", 1000.0).select("k", "in_baseline", "in_candidate", "change_type")


@query("""with m as (select doc_id, source from documents), e as (select doc_id, quality from labels) select m.doc_id, m.source, e.quality, e.doc_id is not null as both_sides from m left join e on m.doc_id = e.doc_id""")
def jn05_manifest_join(t):
    e = t.labels.select("doc_id", "quality", F.lit(True).alias("both_sides"))
    return t.documents.select("doc_id", "source").join(e, "doc_id", "left").withColumn("both_sides", F.coalesce("both_sides", F.lit(False)))


@query("""select 'missing' as kind, count(*) as n from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) union all select 'orphan', count(*) from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id) union all select 'deleted_present', count(*) from labels l where l.toxic = 1 and exists (select 1 from documents d where d.doc_id = l.doc_id)""")
def jn08_set02_coverage(t):
    d, x = t.documents.select("doc_id"), t.labels
    kinds = {"missing": d.join(x, "doc_id", "left_anti"), "orphan": x.join(d, "doc_id", "left_anti"), "deleted_present": x.filter("toxic = 1").join(d, "doc_id", "left_semi")}
    out = None
    for kind, rows in kinds.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""select case when e.user_id is null then 'malformed' when c.c_custkey is null then 'unknown_file' when c.c_acctbal < 0 then 'deleted' when c.c_nationkey >= 20 then 'out_of_scope' else 'valid' end as reason, count(*) as n from events e left join customer c on e.user_id = c.c_custkey group by 1""")
def jn09_ret16_validate_hits(t):
    j = t.events.select("user_id").join(t.customer, F.col("user_id") == F.col("c_custkey"), "left")
    reason = F.when(F.col("user_id").isNull(), "malformed").when(F.col("c_custkey").isNull(), "unknown_file").when(F.col("c_acctbal") < 0, "deleted").when(F.col("c_nationkey") >= 20, "out_of_scope").otherwise("valid")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""with s as (select doc_id, i * 300 as c0, i * 300 + 340 as c1 from (select doc_id, unnest(range(0, 3)) as i from documents)), b as (select doc_id, i as blk, i * 200 as b0, i * 200 + 200 as b1 from (select doc_id, unnest(range(0, 6)) as i from documents))
 select s.doc_id, s.c0, b.blk, least(c1, b1) - greatest(c0, b0) as overlap from s join b on s.doc_id = b.doc_id and greatest(c0, b0) < least(c1, b1)""")
def jn11_interval_overlap(t):
    from ..operators.chunking import overlap_join

    s = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("doc_id", (F.col("i") * 300).cast("long").alias("c0"), (F.col("i") * 300 + 340).cast("long").alias("c1"))
    b = t.documents.select("doc_id", F.explode(F.expr("sequence(0L, 5L)")).alias("blk")).select("doc_id", "blk", (F.col("blk") * 200).alias("b0"), (F.col("blk") * 200 + 200).alias("b1"))
    return overlap_join(s, b, "doc_id", ("c0", "c1"), ("b0", "b1")).select("doc_id", "c0", "blk", "overlap")


@query("""select l_orderkey, m as media, l_linenumber as nearest from (select a.l_orderkey, a.l_linenumber as m, b.l_linenumber, row_number() over (partition by a.l_orderkey, a.l_linenumber order by abs(a.l_quantity - b.l_quantity), b.l_linenumber) as rn from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber where a.l_returnflag = 'R') where rn = 1""")
def jn12_nearest_text(t):
    a = t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("media"), F.col("l_quantity").alias("q"))
    j = a.join(t.lineitem, "l_orderkey").filter("media <> l_linenumber")
    return j.groupBy("l_orderkey", "media").agg(F.min_by("l_linenumber", F.struct(F.abs(F.col("q") - F.col("l_quantity")), "l_linenumber")).alias("nearest"))


@query("select conv_id, turn, lag(turn) over w as prev_turn, lead(turn) over w as next_turn from conversations window w as (partition by conv_id order by turn)")
def jn13_neighbours(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn"), F.lead("turn").over(w).alias("next_turn"))


@query("select c.conv_id, c.turn, p.text as parent_context from conversations c left join conversations p on p.conv_id = c.conv_id and p.turn = 0")
def jn14_parent_context(t):
    p = t.conversations.filter("turn = 0").select("conv_id", F.col("text").alias("parent_context"))
    return t.conversations.select("conv_id", "turn").join(p, "conv_id", "left")


@query("select o_orderkey, round(avg(l_quantity), 6) as similarity, string_agg(l_linenumber::varchar, ' ' order by l_linenumber) as children, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def jn15_collapse_children(t):
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.avg("l_quantity"), 6).alias("similarity"), F.array_join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda x: x.cast("string")), " ").alias("children"), F.count("*").alias("n"))
    return t.orders.select("o_orderkey").join(c, "o_orderkey")


@query("""with m as (select md5(text) as mom_id, min(doc_id) as first_doc, count(*) as n from documents group by 1), c as (select distinct md5(text) as mom_id, unnest(string_split(text, chr(10))) as child from documents)
 select mom_id, first_doc, n, count(*) as n_children, min(md5(child)) as least_child from c join m using (mom_id) group by 1, 2, 3""")
def jn19_snk09_mother_chunks(t):
    """Mother chunks once each, by the hash of their text, and their children linked to them by that hash."""
    mothers = t.documents.groupBy(F.md5("text").alias("mom_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    children = t.documents.select(F.md5("text").alias("mom_id"), F.explode(F.split("text", "\n")).alias("child")).distinct()
    return children.join(mothers, "mom_id").groupBy("mom_id", "first_doc", "n").agg(F.count("*").alias("n_children"), F.min(F.md5("child")).alias("least_child"))


# --- aggregates --------------------------------------------------------------------------------


@query("select event_type as term, count(*) as n from events group by 1")
def agg01_facets(t):
    return t.events.groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("n"))


@query("select tag, count(*) as n from (select unnest(string_split(regexp_replace(p_type, ' ', '###', 'g'), '###')) as tag from part) group by tag")
def agg02_delimited_facets(t):
    tags = F.explode(F.split(F.regexp_replace("p_type", " ", "###"), "###")).alias("tag")
    return t.part.select(tags).groupBy("tag").agg(F.count("*").alias("n"))


@query("select l_partkey as file_id, count(*) as hits, max(l_extendedprice) as best, round(min(l_discount), 4) as low, round(avg(l_quantity), 6) as mean from lineitem group by 1")
def agg03_agg04_agg06_hits_per_file(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("file_id")).agg(F.count("*").alias("hits"), F.max("l_extendedprice").alias("best"), F.round(F.min("l_discount"), 4).alias("low"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("select source, doc_id as best_doc from (select source, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn = 1")
def agg05_best_per_file(t):
    return t.documents.groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best_doc"))


@query("select p_brand as tag, round((count(*) + 1) / ((select count(*) from part) + 1000)::double, 9) as portion from part group by 1")
def agg07_tag_portion(t):
    from ..operators.retrieval import tag_portions

    return tag_portions(t.part.select(F.col("p_brand").alias("tag")))


@query("select event_type, user_id % 4 as status, count(*) as n, count(distinct user_id) as workers from events group by 1, 2")
def agg08_agg09_gauges(t):
    return t.events.groupBy("event_type", (F.col("user_id") % 4).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("workers"))


@query("select event_type, k as metric, round(avg(try_cast(v as double)), 6) as mean from (select event_type, unnest(json_keys(props)) as k, json_extract_string(props, '$.' || unnest(json_keys(props))) as v from events) where try_cast(v as double) is not null group by 1, 2")
def agg10_mean_metrics(t):
    e = t.events.select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("metric", "v")).withColumn("x", F.col("v").try_cast("double")).filter("x is not null")
    return e.groupBy("event_type", "metric").agg(F.round(F.avg("x"), 6).alias("mean"))


@query("select event_type, round(quantile_disc(value, 0.95), 6) as p95 from events group by 1")
def agg11_percentile(t):
    return t.events.groupBy("event_type").agg(F.round(F.expr("percentile_disc(0.95) within group (order by value)"), 6).alias("p95"))


@query("select coalesce(p_brand, 'untyped') as query_type, count(*) as n, round(avg(case when p_size > 10 then p_retailprice end), 4) as mean, round(avg((p_size > 25)::int), 6) as fp_rate from part group by 1")
def agg12_evl09_summary(t):
    return t.part.groupBy(F.coalesce("p_brand", F.lit("untyped")).alias("query_type")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("p_size") > 10, F.col("p_retailprice"))), 4).alias("mean"), F.round(F.avg((F.col("p_size") > 25).cast("int")), 6).alias("fp_rate"))


@query("select count(*) as n, count(*) filter (lang = 'en') as english, count(*) filter (contains(text, '|')) as tables, sum(case when n_chars > 3000 then 1 else 0 end)::bigint as long_docs from documents")
def agg13_conditional_counts(t):
    return t.documents.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.contains("text", F.lit("|"))).alias("tables"), F.sum(F.when(F.col("n_chars") > 3000, 1).otherwise(0)).alias("long_docs"))


@query("""with v as (select 'o_orderkey' as col, o_orderkey::varchar as x from orders union all select 'o_totalprice', o_totalprice::varchar from orders union all select 'o_orderdate', strftime(o_orderdate, '%Y-%m-%d') from orders union all select 'o_orderpriority', o_orderpriority from orders),
 k as (select col, case when regexp_matches(x, '^[+-]?\\d{1,18}$') then 'int' when regexp_matches(x, '^[+-]?\\d+(\\.\\d+)?([eE][+-]?\\d+)?$') then 'float' when regexp_matches(lower(x), '^(true|false|yes|no)$') then 'bool' when regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}') then 'datetime' else 'text' end as kind, count(*) as n from v group by 1, 2)
 select col, max_by(kind, n) as kind from k group by col""")
def agg14_column_types(t):
    from ..sources.tables import infer_types

    o = t.orders
    return infer_types(o.select(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority"))


@query("select l_orderkey as doc, 1 as page, min(l_quantity) as x0, min(l_discount) as y0, max(l_quantity) as x1, max(l_discount) as y1 from lineitem group by 1")
def agg18_bbox_union(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc")).agg(F.lit(1).alias("page"), F.min("l_quantity").alias("x0"), F.min("l_discount").alias("y0"), F.max("l_quantity").alias("x1"), F.max("l_discount").alias("y1"))


@query("select source, min(tk) as low, max(tk) as high, round(avg(tk), 6) as mean, count(*) filter (tk < 32) as short, count(*) filter (n_chars = 0) as empty from (select *, greatest(1, length(text) // 4)::int as tk from documents) group by 1")
def agg19_chunk_stats(t):
    d = t.documents.withColumn("tk", T.token_count(F.col("text")))
    return d.groupBy("source").agg(F.min("tk").alias("low"), F.max("tk").alias("high"), F.round(F.avg("tk"), 6).alias("mean"), F.count_if(F.col("tk") < 32).alias("short"), F.count_if(F.col("n_chars") == 0).alias("empty"))


@query("select l_suppkey as sheet, min(l_linenumber) as first_row, max(l_linenumber) as last_row, count(distinct l_orderkey) as n_chunks from lineitem group by 1")
def agg20_sheet_overview(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("sheet")).agg(F.min("l_linenumber").alias("first_row"), F.max("l_linenumber").alias("last_row"), F.countDistinct("l_orderkey").alias("n_chunks"))


@query("select l_orderkey, l_linenumber as level from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by n desc, l_linenumber) as rn from (select l_orderkey, l_linenumber, count(*) as n from lineitem where l_linenumber < 5 group by 1, 2)) where rn = 1")
def agg21_title_level(t):
    n = t.lineitem.filter("l_linenumber < 5").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return n.groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("n", -F.col("l_linenumber"))).alias("level"))


@query("select distinct doc_id from (select doc_id, line, count(*) as n from (select doc_id, trim(unnest(string_split(text, chr(10))), ' ') as line from documents) where line <> '' and length(line) <= 30 group by 1, 2) where n >= 4")
def agg22_repeated_lines(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line")).filter("line <> '' and length(line) <= 30")
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 4").select("doc_id").distinct()


@query("select user_id, running, pending, greatest(0, 10 - running) as available, round(100.0 * running / 10, 2)::double as pct from (select user_id, count(*) filter (event_type = 'click') as running, count(*) filter (event_type = 'view') as pending from events group by 1)")
def agg23_quota_usage(t):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("running"), F.count_if(F.col("event_type") == "view").alias("pending"))
    return g.select("user_id", "running", "pending", F.greatest(F.lit(0), 10 - F.col("running")).alias("available"), F.round(100.0 * F.col("running") / 10, 2).alias("pct"))


@query("select vec_id, round(list_avg(embedding::double[]), 6) as mean from embeddings order by mean desc, vec_id limit 20")
def agg24_array_mean(t):
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("embedding")
    return t.embeddings.select("vec_id", F.round(mean, 6).alias("mean")).orderBy(F.desc("mean"), "vec_id").limit(20)


@query("""with a as (select distinct user_id from events where event_type = 'click'), b as (select distinct user_id from events where event_type = 'purchase') select count(*) filter (a.user_id is not null and b.user_id is not null) as both_sides, count(*) filter (b.user_id is null) as only_a, count(*) filter (a.user_id is null) as only_b, count(*) as any_side from a full join b on a.user_id = b.user_id""")
def agg25_overlap_counts(t):
    side = lambda k, name: t.events.filter(F.col("event_type") == k).select("user_id").distinct().withColumn(name, F.lit(1))
    j = side("click", "a").join(side("purchase", "b"), "user_id", "full_outer")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count("*").alias("any_side"))


# --- windows, order, sets ----------------------------------------------------------------------


@query("select user_id, event_id, rank from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rank, row_number() over (partition by user_id, event_type order by ts, event_id) as nth from events) where nth = 1")
def win01_win03_ranked_unique(t):
    from ..operators.retrieval import ranked_unique

    return ranked_unique(t.events, "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", F.col("rank"))


@query("select doc_id, source, round(case when hi = lo then 0.5 else (n_chars - lo) / (hi - lo)::double end, 6) as score from (select *, min(n_chars) over (partition by source) as lo, max(n_chars) over (partition by source) as hi from documents)")
def win02_minmax(t):
    from ..operators.retrieval import minmax

    return minmax(t.documents.select("doc_id", "source", "n_chars"), "n_chars", ["source"]).select("doc_id", "source", F.round("score", 6).alias("score"))


@query("select l_orderkey, l_linenumber, sum(case when l_returnflag = 'R' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding)::bigint as section from lineitem")
def win06_section_ids(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).over(w).alias("section"))


@query("select doc_id, first_value(doc_id) over (partition by sha256(text) order by doc_id) as kept_by, row_number() over (partition by sha256(text) order by doc_id) = 1 as kept from documents")
def win08_first_seen(t):
    w = Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")
    return t.documents.select("doc_id", F.first("doc_id").over(w).alias("kept_by"), (F.row_number().over(w) == 1).alias("kept"))


@query("select user_id, event_id as latest from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def win09_latest_row(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("select l_partkey, max(l_extendedprice) as best from lineitem group by 1")
def win10_best_duplicate(t):
    return t.lineitem.groupBy("l_partkey").agg(F.max("l_extendedprice").alias("best"))


@query("select conv_id, turn, p as page from (select conv_id, turn, unnest(range(turn, coalesce(lead(turn) over (partition by conv_id order by turn), turn + 1))) as p from (select conv_id, turn from conversations where turn % 2 = 0))")
def win11_fill_ranges(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    h = t.conversations.filter("turn % 2 = 0").select("conv_id", "turn").withColumn("nxt", F.coalesce(F.lead("turn").over(w), F.col("turn") + 1))
    return h.select("conv_id", "turn", F.explode(F.sequence("turn", F.col("nxt") - 1)).alias("page"))


@query("select c_custkey, c_mktsegment, c_acctbal from customer order by c_mktsegment, c_acctbal desc nulls last, c_custkey limit 50 offset 100")
def srt01_srt02_srt05_ordering(t):
    return t.customer.orderBy("c_mktsegment", F.desc_nulls_last("c_acctbal"), "c_custkey").offset(100).limit(50).select("c_custkey", "c_mktsegment", "c_acctbal")


@query("select o_orderkey, o_totalprice from orders where (o_totalprice, -o_orderkey) < (200000, 0) order by o_totalprice desc, o_orderkey limit 64")
def srt03_keyset_page(t):
    after = (F.col("o_totalprice") < 200000) | ((F.col("o_totalprice") == 200000) & (F.col("o_orderkey") > 0))
    return t.orders.filter(after).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(64).select("o_orderkey", "o_totalprice")


@query("select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rn from lineitem) where rn <= 5")
def srt04_srt06_srt08_topk_per_scope(t):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return t.lineitem.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders")
def set02_set03_intersect(t):
    return t.customer.filter("c_acctbal > 0").select("c_custkey").intersect(t.orders.select(F.col("o_custkey").alias("c_custkey")))


@query("select kind, id, score from (select 'c' as kind, c_custkey as id, c_acctbal as score from customer union all select 's', s_suppkey, s_acctbal from supplier) order by score desc, kind, id limit 30")
def set04_scatter_gather(t):
    a = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return a.unionByName(b).orderBy(F.desc("score"), "kind", "id").limit(30)


@query("select batch, count(*) as n, min(doc_id) as first_id from (select doc_id, (row_number() over (partition by source order by doc_id) - 1) // 16 as batch from documents) group by batch")
def set06_set07_batches(t):
    w = Window.partitionBy("source").orderBy("doc_id")
    b = t.documents.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 16))
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
