"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .registry import Family

family = Family()
query = family.query

_W = r"[\p{L}\p{N}_]+"
_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


@query(f"""select doc_id, len(regexp_extract_all(text, '{_TOK}')) as n_tokens, md5(array_to_string(regexp_extract_all(text, '{_TOK}'), ' ')) as tokens_md5 from documents""")
def str01_tokenize(t):
    tok = T.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tok).alias("n_tokens"), F.md5(F.array_join(tok, " ")).alias("tokens_md5"))


@query(r"""select page_id, md5(array_to_string(regexp_extract_all(regexp_replace(html, '</?(table|td|caption|tr|th)( [^<>]{0,12})?>', ' ', 'g'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), ' ')) as tokens_md5 from pages""")
def str02_token_fields(t):
    return t.pages.select("page_id", F.md5(F.array_join(T.tokens(T.strip_markup(F.col("html"))), " ")).alias("tokens_md5"))


@query("select p_partkey, p_name as half_width, lower(trim(regexp_replace(p_name || ' ' || p_brand, '\\s+', ' ', 'g'))) as exact_term from part")
def str03_str05_normalize_terms(t):
    wide = F.translate("p_name", T.HALF_WIDTH, T.FULL_WIDTH)
    return t.part.select("p_partkey", T.half_width(wide).alias("half_width"), T.exact_term(F.concat_ws("  ", wide, "p_brand")).alias("exact_term"))


@query(r"""select p_partkey, regexp_replace(p_type || '类' || p_size, '([A-Za-z0-9]+)([\x{4E00}-\x{9FFF}]+)([A-Za-z0-9]+)', '\1 \2 \3') as spaced,
  regexp_replace(p_name || '(' || p_brand || ')*', '([(){}\[\]/:*"|+~^-])', '\\\1', 'g') as escaped from part""")
def str07_str08_query_text(t):
    return t.part.select(
        "p_partkey",
        T.space_latin_cjk(F.concat("p_type", F.lit("类"), "p_size")).alias("spaced"),
        T.escape_query(F.concat("p_name", F.lit("("), "p_brand", F.lit(")*"))).alias("escaped"),
    )


@query(r"""select doc_id, 0.0::double as cjk, round((length(text) - length(regexp_replace(text, '[a-zA-Z0-9 ,.?:;''"!\n-]', '', 'g'))) / length(text)::double, 6) as latin from documents where length(text) > 0""")
def str09_str10_script_ratios(t):
    return t.documents.filter(F.length("text") > 0).select("doc_id", T.cjk_ratio(F.col("text")).alias("cjk"), T.latin_ratio(F.col("text")).alias("latin"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(text, '\s+([,.;:!?)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g')) as tight, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) as collapsed from documents""")
def str11_str15_clean_spaces(t):
    return t.documents.select("doc_id", F.md5(T.tight_punctuation(F.col("text"))).alias("tight"), F.md5(T.collapse_space(F.col("text"))).alias("collapsed"))


@query("select item_id, trim(text, ' ') as body, text as untagged from benchmark where text not like '%`%'")
def str12_str13_unwrap_markdown(t):
    fenced = F.concat(F.lit("```markdown\n"), "text", F.lit("\n```"))
    tagged = F.concat("text", F.lit("@@1\t10.5\t20.5##"))
    return t.benchmark.filter(~F.col("text").contains("`")).select("item_id", F.trim(T.strip_code_fence(fenced)).alias("body"), T.strip_position_tags(tagged).alias("untagged"))


@query("select doc_id, greatest(1, length(text) // 4)::int as tokens, md5(substr(text, 1, 128)) as head from documents")
def str16_str17_token_budget(t):
    return t.documents.select("doc_id", T.token_count(F.col("text")).alias("tokens"), F.md5(T.truncate_tokens(F.col("text"), 32)).alias("head"))


@query("select doc_id, cut, strlen(cut)::int as n_bytes from (select doc_id, substr(text, 1, list_max(list_filter(range(0, 102), lambda k: strlen(substr(text, 1, k)) <= 101))) as cut from documents)")
def str18_utf8_truncate(t):
    cut = T.utf8_truncate(F.col("text"), 101)
    return t.documents.select("doc_id", cut.alias("cut"), F.octet_length(cut).alias("n_bytes"))


@query(r"""select c_custkey, regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, upper(trim(regexp_replace(c_mktsegment, '["\x00-\x1f]', '', 'g'))) as entity, substr(sha1(c_name), 1, 8) as guard from customer""")
def str19_str20_names(t):
    return t.customer.select("c_custkey", T.slug(F.col("c_name")).alias("slug"), T.entity_name(F.col("c_mktsegment")).alias("entity"), F.substring(F.sha1("c_name"), 1, 8).alias("guard"))


@query(r"""select doc_id, len(p) as n_parts, p[1] as first_part from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\.|;|\n'), lambda x: trim(x, ' ')), lambda x: x <> '') as p from documents)""")
def str21_split_markers(t):
    parts = T.split_markers(F.col("text"), [".", ";", "\n"])
    return t.documents.withColumn("p", parts).select("doc_id", F.size("p").alias("n_parts"), F.get("p", F.lit(0)).alias("first_part"))


@query(r"""select doc_id, h as highlighted from (select doc_id, array_to_string(list_transform(list_filter(list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\n]+'), lambda x: trim(x, ' ')), lambda x: x <> ''),
  lambda x: regexp_matches(x, '(?i)\b(the|and)\b')), lambda x: regexp_replace(x, '(?i)\b(the|and)\b', '<em>\1</em>', 'g')), '...') as h from documents) where h <> ''""")
def str22_highlight(t):
    return t.documents.select("doc_id", T.highlight(F.col("text"), ["the", "and"]).alias("highlighted")).filter("highlighted <> ''")


@query(r"""select doc_id, pos::int as line_no, length(regexp_extract(line, '^(#{1,6})\s', 1))::int as heading, case when regexp_matches(line, '^第[0-9]+章') then 1 when regexp_matches(line, '^第[0-9]+节') then 2 when regexp_matches(line, '^[0-9]{0,2}[. 、]') then 3 when regexp_matches(line, '^[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]') then 4 when regexp_matches(line, '^[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}') then 5 end::int as bullet
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)""")
def str25_heading_lines(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.heading_level(F.col("line")).alias("heading"), T.bullet_level(F.col("line"), 1).alias("bullet"))


@query(r"""select conv_id, turn, case when q = '' then 'deep' when contains(q, '```') or regexp_matches(q, '\b(def|class|import|function)\b') then 'precise' when length(q) < 18 and not regexp_matches(q, '[？?\n]') then 'light' else 'deep' end as strategy from (select *, trim(coalesce(text, ''), ' ') as q from conversations)""")
def str26_retrieval_strategy(t):
    return t.conversations.select("conv_id", "turn", T.retrieval_strategy(F.col("text")).alias("strategy"))


@query(r"""select doc_id, case when n_chars <= 800 then 'short' when n_chars <= 3000 then 'medium' when n_chars <= 8000 then 'long' else 'very_long' end as bucket, (length(text) - length(replace(text, '€', '')) + length(text) - length(replace(text, chr(65533), '')))::int as markers,
  regexp_replace(lower(source), '([_-]\d+)+$', '') as dup_key from documents""")
def str27_file_traits(t):
    return t.documents.select("doc_id", T.length_bucket(F.col("n_chars")).alias("bucket"), T.mojibake_count(F.col("text")).alias("markers"), T.duplicate_key(F.concat("source", F.lit("_"), F.col("doc_id") % 3)).alias("dup_key"))


@query(r"""select item_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 60) as preview, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) as query_hash, md5(text) as content_id from benchmark""")
def str28_str29_hashes(t):
    return t.benchmark.select("item_id", F.substring(T.collapse_space(F.col("text")), 1, 60).alias("preview"), T.query_hash(F.col("text")).alias("query_hash"), F.md5("text").alias("content_id"))


@query(f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), '{_W}')) as term from documents), s as (select term, count(*) as tf, count(distinct doc_id) as df from w group by term)
  select term, round((0.3 * log10(10 + (1e7 - tf + 0.5) / (tf + 0.5)) + 0.7 * log10(10 + (1e9 - df + 0.5) / (df + 0.5))), 6) as weight from s""")
def str32_lexical_weights(t):
    w = t.documents.select("doc_id", F.explode(T.words(F.col("text"))).alias("term"))
    s = w.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    return s.select("term", F.round(0.3 * T.lexical_idf(F.col("tf"), 1e7) + 0.7 * T.lexical_idf(F.col("df"), 1e9), 6).alias("weight"))


@query(f"""with b as (select item_id, unnest(regexp_extract_all(lower(text), '{_W}')) as w, generate_subscripts(regexp_extract_all(lower(text), '{_W}'), 1) as i from benchmark),
  p as (select item_id, w, lead(w) over (partition by item_id order by i) as nxt from b)
  select item_id, tok, round(sum(x), 6) as weight from (select item_id, w as tok, 0.4::double as x from p union all select item_id, w || ' ' || nxt, 0.6::double from p where nxt is not null) group by item_id, tok""")
def str33_bigram_weights(t):
    b = t.benchmark.select("item_id", F.posexplode(T.words(F.col("text"))).alias("i", "w"))
    from pyspark.sql import Window

    p = b.withColumn("nxt", F.lead("w").over(Window.partitionBy("item_id").orderBy("i")))
    one = p.select("item_id", F.col("w").alias("tok"), F.lit(0.4).alias("x"))
    two = p.filter("nxt is not null").select("item_id", F.concat_ws(" ", "w", "nxt").alias("tok"), F.lit(0.6).alias("x"))
    return one.unionByName(two).groupBy("item_id", "tok").agg(F.round(F.sum("x"), 6).alias("weight"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as shown, epoch_us(ts) // 1000 as ms, date_trunc('second', ts) as whole, greatest(0, epoch_us(ts) // 1000 - epoch_ms(timestamp '2024-01-01')) as since_ms from events""")
def dt01_dt03_times(t):
    start = F.lit("2024-01-01").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("shown"), F.unix_millis(ts).alias("ms"), F.date_trunc("second", ts).cast("timestamp_ntz").alias("whole"), V.duration_ms(start, ts).alias("since_ms"))


@query("""select o_orderkey, date_trunc('month', o_orderdate)::timestamp as month_start, o_orderdate::date::timestamp as full_date, [30, 120, 300][least(greatest(o_orderkey % 5, 1), 3)]::int as delay from orders""")
def dt02_dt04_dt05_dates(t):
    d = F.col("o_orderdate").cast("timestamp")
    return t.orders.select(
        "o_orderkey",
        V.partial_date(F.date_format(d, "yyyy.M")).cast("timestamp_ntz").alias("month_start"),
        V.free_timestamp(F.date_format(d, "yyyy/MM/dd")).cast("timestamp_ntz").alias("full_date"),
        V.retry_delay(F.col("o_orderkey") % 5).alias("delay"),
    )


@query("""select a.vec_id, round(list_cosine_similarity(a.embedding::double[], q.embedding::double[]), 6) as cos, len(a.embedding) = 64 as valid, round(list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda x: x[1]::double * 0.1 + x[2]::double * 0.9)), 4) as blended
  from embeddings a, (select embedding from embeddings where vec_id = 0) q""")
def mth01_mth02_mth03_vectors(t):
    q = F.broadcast(t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    a, b = F.col("embedding"), F.col("q")
    total = F.aggregate(V.blend(F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double")), 0.1), F.lit(0.0), lambda s, x: s + x)
    return t.embeddings.join(q).select("vec_id", F.round(V.cosine(a, b), 6).alias("cos"), V.valid_vector(a, 64).alias("valid"), F.round(total, 4).alias("blended"))


@query("""select event_id, coalesce(try_cast(value::varchar as double), '-infinity'::double) as number, least(greatest(trunc(case when value > 0 and value < 1 then value * 100 else value end)::int, 0), 90) as percent, greatest(0, least(event_id + 10, 500) - greatest(event_id, 100))::bigint as overlap from events where value is not null""")
def mth04_mth05_mth09_numbers(t):
    e = F.col("event_id")
    return t.events.filter("value is not null").select(
        "event_id", V.number_or_lowest(F.col("value").cast("string")).alias("number"), V.overlap_percent(F.col("value")).alias("percent"), V.overlap_length(e, e + 10, F.lit(100), F.lit(500)).cast("long").alias("overlap")
    )


@query("""select l_orderkey, l_linenumber, round(case when l_returnflag = 'A' then 0.1 when l_returnflag = 'N' then case l_linenumber when 1 then 0.08 when 2 then 0.06 when 3 then 0.04 else 0.02 end else 0 end, 6)::double as hierarchy,
  round(0.05::double / (1 + (l_linenumber - 1) * 0.2::double) + case when l_extendedprice > 48000 then least(1.0::double, l_extendedprice / 240000::double) * 0.1::double * 0.5::double else 0 end, 3) as place from lineitem""")
def mth06_mth07_boosts(t):
    kind = F.when(F.col("l_returnflag") == "A", "title").when(F.col("l_returnflag") == "N", "heading")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(V.hierarchy_boost(F.col("l_linenumber"), kind), 6).alias("hierarchy"), F.round(V.position_boost(F.col("l_linenumber"), F.col("l_extendedprice")), 3).alias("place")
    )


@query(f"""select d.doc_id, round(len(list_intersect(list_distinct(q.ws), list_distinct(regexp_extract_all(lower(d.text), '{_W}')))) / len(list_distinct(q.ws))::double, 6) as overlap
  from documents d, (select regexp_extract_all(lower(text), '{_W}') as ws from benchmark where item_id = (select min(item_id) from benchmark)) q""")
def mth08_keyword_overlap(t):
    q = F.broadcast(t.benchmark.orderBy("item_id").limit(1).select(T.words(F.col("text")).alias("q")))  # one row
    return t.documents.join(q).select("doc_id", F.round(V.keyword_overlap(F.col("q"), T.words(F.col("text"))), 6).alias("overlap"))


@query("select event_id, ('0x' || substr(sha256(event_id::varchar), 1, 8))::bigint / 4294967295.0::double < 0.1 as sampled from events")
def mth10_hash_sample(t):
    return t.events.select("event_id", V.hash_sampled(F.col("event_id").cast("string"), 0.1).alias("sampled"))


@query("""select o_custkey, list_sort(list_distinct(list(o_orderpriority))) as kinds, list_transform(list_sort(list(o_orderkey)), lambda x: x + 1) as shifted from orders group by o_custkey""")
def arr01_arr02_arrays(t):
    g = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("k"), F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    return g.select("o_custkey", F.sort_array(F.array_distinct("k")).alias("kinds"), F.transform("o", lambda x: x + 1).alias("shifted"))


@query("""select vec_id, list_sum(from_json(to_json(embedding::double[]), '["DOUBLE"]')) is not null as parsed, embedding[2]::double as second from embeddings""")
def arr03_arr04_coerce(t):
    parsed = F.from_json(F.to_json(F.transform("embedding", lambda x: x.cast("double"))), "array<double>")
    m = V.sparse_map(F.sequence(F.lit(1), F.size("embedding")), F.col("embedding"))
    return t.embeddings.select("vec_id", F.aggregate(parsed, F.lit(0.0), lambda s, x: s + x).isNotNull().alias("parsed"), F.element_at(m, 2).cast("double").alias("second"))


@query("""select c_custkey, c_mktsegment || case when c_nationkey % 2 = 0 then ',all' else '' end as tags, 'N' || c_nationkey as nation, case when c_custkey % 3 = 0 then 'late' end as late from customer""")
def map01_merge_metadata(t):
    a = F.create_map(F.lit("tags"), F.array("c_mktsegment"), F.lit("nation"), F.array(F.concat(F.lit("N"), "c_nationkey")))
    more = F.when(F.col("c_nationkey") % 2 == 0, F.array("c_mktsegment", F.lit("all"))).otherwise(F.array("c_mktsegment", "c_mktsegment"))
    b = F.map_concat(F.create_map(F.lit("tags"), more), F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("late"), F.array(F.lit("late")))).otherwise(F.create_map().cast("map<string,array<string>>")))
    m = V.merge_metadata(a, b)
    return t.customer.select("c_custkey", *(F.array_join(m[k], ",").alias(k) for k in ("tags", "nation", "late")))


@query("""with k as (select source, count(*) as n, list(distinct lang order by lang) as langs from documents group by 1)
 select '{"type":"object","properties":{' || string_agg('"' || source || '":{"description":"' || n || ' documents","enum":["' || array_to_string(langs, '","') || '"],"type":"string"}', ',' order by source) || '},"additionalProperties":false}' as schema from k""")
def jsn03_metadata_schema(t):
    """The languages of each source as the enumeration of a metadata key."""
    keys = t.documents.groupBy(F.col("source").alias("key")).agg(F.concat(F.count("*").cast("string"), F.lit(" documents")).alias("description"), F.sort_array(F.collect_set("lang")).alias("enum"))
    return V.metadata_schema(keys)


@query("""select s_suppkey, round(10 * (s_suppkey % 7 * 2.0) / (sqrt(s_suppkey % 7 * (s_suppkey % 7) + 9.0) * sqrt(5.0)) + 10 * 3.0 / (sqrt(s_suppkey % 7 * (s_suppkey % 7) + 9.0) * sqrt(5.0)), 6) as score from supplier""")
def map02_tag_similarity(t):
    f = F.create_map(F.lit("a"), (F.col("s_suppkey") % 7).cast("double"), F.lit("b"), F.lit(3.0))
    q = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0))
    return t.supplier.select("s_suppkey", F.round(V.tag_similarity(q, f), 6).alias("score"))


@query("""select event_id, k as metric, json_extract_string(props, '$.' || k) as value from (select event_id, props, unnest(json_keys(props)) as k from events)""")
def jsn01_jsn02_flatten_json(t):
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", F.explode(m).alias("metric", "value"))


@query("""select distinct event_type, sha256('{"event_type":"' || event_type || '"}') as fingerprint from events""")
def jsn05_fingerprint(t):
    return t.events.select("event_type").distinct().select("event_type", F.sha2(F.to_json(F.struct("event_type")), 256).alias("fingerprint"))


@query(r"""select o_orderkey, [split_part(lower(o_orderpriority), ' ', 1), 'ord-' || o_orderkey || '_a'] as terms from orders""")
def str04_exact_terms(t):
    from ..functions.terms import exact_terms

    return t.orders.select("o_orderkey", exact_terms(F.concat_ws(" ", "o_orderpriority", F.concat(F.lit("see ORD-"), "o_orderkey", F.lit("_A")), F.lit("now"))).alias("terms"))


@query(r"""select conv_id, turn, case when x = '' then text else x end as bare from (select *, regexp_replace(regexp_replace(text, '(?i)(^| )(what|who|how|which|where|why)(''re|''s)? ', ' ', 'g'), '(?i)(^| )(is|are|the|a|an|of|to|and|in|on|at|for|with|by|as|so|be|or|if|it''s|do|has|have|was|were|there|you|me|my|i|up|out|go|your|mine|just|please|may|did|does|done|will|would|should|down|they) ', ' ', 'g') as x from conversations where role = 'user')""")
def str06_question_words(t):
    from ..functions.terms import without_question_words

    return t.conversations.filter("role = 'user'").select("conv_id", "turn", without_question_words(F.col("text")).alias("bare"))


@query("select p_partkey, p_size::bigint as digits, p_size::bigint as words, p_size::bigint as chinese, (1 + p_size % 10)::bigint as roman from part")
def str30_numerals(t):
    """Sizes written as digits, English words, Chinese and Roman numerals, and read back."""
    from ..functions.terms import number_of

    pick = lambda words, at: f"element_at(split('{words}', ' ', -1), cast({at} as int) + 1)"
    ones = " one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    words = f"trim(if(p_size < 20, {pick(ones, 'p_size')}, concat({pick('  twenty thirty forty fifty sixty seventy eighty ninety', 'p_size div 10')}, ' ', {pick(ones, 'p_size % 10')})))"
    digits = " 一 二 三 四 五 六 七 八 九"
    chinese = f"concat(if(p_size < 20, '', {pick(digits, 'p_size div 10')}), if(p_size < 10, '', '十'), {pick(digits, 'p_size % 10')})"
    written = {"digits": "cast(p_size as string)", "words": words, "chinese": chinese, "roman": pick("I II III IV V VI VII VIII IX X", "p_size % 10")}
    return t.part.select("p_partkey", *(number_of(F.expr(w)).cast("long").alias(name) for name, w in written.items()))


@query(f"""with w as (select doc_id, regexp_extract_all(lower(text), '{_W}') as ws from documents), s as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from w)),
  k as (select min(doc_id) as id, gs, len(gs) as n from (select doc_id, list_sort(list(g)) as gs from s group by 1) group by gs), e as (select id, n, unnest(gs) as g from k)
  select a.id as left_id, b.id as right_id, round(count(*) / (a.n + b.n - count(*))::double, 6) as jaccard from e a join e b on a.g = b.g and a.id < b.id group by a.id, b.id, a.n, b.n having count(*) >= 0.6 * (a.n + b.n - count(*))""")
def str35_str36_shingle_jaccard(t):
    """Documents of which three fifths of the three-word shingles are common; equal sets as one."""
    from ..operators.cleaning import similar_sets

    found = similar_sets(t.documents.withColumn("gs", T.shingles(F.col("text"), 3)), "doc_id", "gs", 0.6)
    return found.withColumn("jaccard", F.round("jaccard", 6))


@query("""with a as (select p_brand as id, list_sort(list_distinct(list(p_name))) as vs from part where p_size > 5 group by 1), k as (select min(id) as id, vs from a group by vs)
  select x.id as left_id, y.id as right_id, round(len(list_intersect(x.vs, y.vs)) / len(list_distinct(list_concat(x.vs, y.vs)))::double, 6) as jaccard from k x join k y on x.id < y.id where len(list_intersect(x.vs, y.vs)) >= 0.5 * len(list_distinct(list_concat(x.vs, y.vs)))""")
def str36_outline_overlap(t):
    """Brands whose lists of names overlap, as outlines of documents do."""
    from ..operators.cleaning import similar_sets

    outlines = t.part.filter("p_size > 5").groupBy("p_brand").agg(F.collect_set("p_name").alias("lines"))
    return similar_sets(outlines, "p_brand", "lines", 0.5).withColumn("jaccard", F.round("jaccard", 6))


@query()
def str37_title_similarity(t):
    from ..functions.terms import title_similarity

    return t.part.select("p_partkey", F.round(title_similarity("p_name", "p_type"), 6).alias("similarity"))
