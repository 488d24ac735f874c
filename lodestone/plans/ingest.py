"""Sources, sinks and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import html, store, tables
from ..streaming import jobs
from .registry import Family

family = Family()
query = family.query


@query(r"""select page_id, length(t) as n_chars, md5(t) as text_md5 from (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g'), ' ') as t from pages)""")
def src06_html_text(t):
    text = html.visible_text(F.col("html"))
    return t.pages.select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"))


@query()
def src06_src07_html_blocks(t):
    return html.blocks(t.pages, "page_id", "html", 512)


@query()
def src04_src05_markdown_elements(t):
    from ..sources import markdown

    return markdown.elements(t.documents, "doc_id", "text")


@query()
def src08_json_split(t):
    from ..sources import jsonl

    packed = t.conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role", "text"))).alias("doc"))
    return jsonl.split(packed, "conv_id", "doc", 2000)


@query("select o_custkey % 100 as sheet, strategy, count(distinct grp) as groups, count(*) as n from (select o_custkey, case when n <= 50 then 'small' when n <= 1000 then 'medium' else 'large' end as strategy, (row_number() over (partition by o_custkey % 100 order by o_orderkey) - 1) // case when n <= 50 then n when n <= 1000 then 20 else 100 end as grp from (select *, count(*) over (partition by o_custkey % 100) as n from orders)) group by 1, 2")
def src09_src10_sheet_groups(t):
    g = tables.sheet_groups(t.orders.withColumn("sheet", F.col("o_custkey") % 100), "sheet", "o_orderkey")
    return g.groupBy("sheet", "strategy").agg(F.countDistinct("group").alias("groups"), F.count("*").alias("n"))


@query("select md5('- s_suppkey: ' || s_suppkey || chr(10) || '- s_name: ' || s_name) as chunk_md5 from supplier")
def src11_row_chunks(t):
    return t.supplier.select(F.md5(tables.row_chunks(t.supplier, ["s_suppkey", "s_name"])).alias("chunk_md5"))


@query("select conv_id, turn, text as question, nt as answer from (select *, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nr = 'assistant'")
def src12_question_pairs(t):
    return tables.question_pairs(t.conversations, "conv_id", "turn", "role", "text")


@query("select p_partkey, list_transform(string_split(p_type, ' '), lambda x: lower(trim(x, ' '))) as tags from part")
def src13_tag_corpus(t):
    return t.part.select("p_partkey", F.transform(F.split("p_type", " "), lambda x: F.lower(F.trim(x))).alias("tags"))


@query("select o_orderkey::varchar as id, md5('- o_orderpriority: ' || o_orderpriority || chr(10) || '- o_orderstatus: ' || o_orderstatus) as text_md5 from orders where o_orderdate > timestamp '1995-01-01' and o_orderdate <= timestamp '1995-06-30'")
def src18_src19_rdbms_poll(t):
    rows = tables.poll_window(t.orders, "o_orderdate", "1995-01-01", "1995-06-30")
    return tables.rdbms_documents(rows, ["o_orderpriority", "o_orderstatus"], ["o_custkey"], "o_orderkey").select("id", F.md5("text").alias("text_md5"))


@query("""with e as (select c_custkey as id, c_nationkey as v from customer where c_custkey % 5 <> 0), i as (select c_custkey as id, c_nationkey + (c_custkey % 11 = 0)::int as v from customer where c_custkey % 6 <> 0) select action, count(*) as n from (select case when e.id is null then 'added' when i.id is null then 'removed' when e.v = i.v then 'same' else 'updated' end as action from e full join i on e.id = i.id) group by 1""")
def src22_src24_sync_plan(t):
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("v"))
    incoming = c.filter("id % 6 <> 0").withColumn("v", F.col("v") + (F.col("id") % 11 == 0).cast("int"))
    return tables.sync_plan(c.filter("id % 5 <> 0"), incoming, "id", "v").groupBy("action").agg(F.count("*").alias("n"))


@query("select s_suppkey, case when s_nationkey < 10 then 'low' else s_name end as s_name, nullif(least(greatest(s_suppkey % 120 - 10, 0), 100), 0) as pagerank from supplier")
def snk07_snk08_conditional_update(t):
    name = F.when(F.col("s_nationkey") < 10, "low").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", name.alias("s_name"), store.adjust_pagerank(F.col("s_suppkey") % 120, F.lit(-10)).alias("pagerank"))


@query("select event_type, max(ts) as high_watermark, count(*) as n from events group by 1")
def stm02_high_watermark(t):
    return t.events.groupBy("event_type").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("high_watermark"), F.count("*").alias("n"))


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stm01_stm03_windowed_stream(t):
    return jobs.windowed_counts(t.spark, t.folder)


@query("select user_id, count(*) as n, max(event_id) as last_event from events group by 1")
def stm05_stm09_upsert_stream(t):
    return jobs.latest_state(t.spark, t.folder)


@query("select event_type, count(*) as n from events group by 1")
def stm07_deduplicated_stream(t):
    return jobs.deduplicated(t.spark, t.folder)


@query("select event_type, count(*) as n, sum(case when event_id % 7 = 0 then 1 else 0 end)::bigint as again from events group by 1")
def stm07_acknowledged_stream(t):
    """A consumer that acknowledges every seventh event at its second delivery only."""
    done = jobs.acknowledged(t.spark, t.folder, lambda messages: messages.filter("event_id % 7 > 0 or deliveries > 1"))
    return done.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("deliveries") > 1).cast("long")).alias("again"))
