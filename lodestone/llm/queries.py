"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, cross_tokens, materialise, media, mixing, ngram_join, periodic_runs, quality_rules, secret_scan, sharding, suffix_dedup, toxicity
from .common import give_way
from .training_rows import held_out, labelled_sample

#: The vocabularies stay where the tokenizer package has them; their paths are parameters of the operators.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
ORDER_VOCABULARY, END_ID, ORDER_KEY = "byte_bpe_50k.tiktoken", 50256, 20240607
SCORE_THRESHOLD = 0.3
ALIGNED_VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the page images that Spark renders from ``pages``."""
    return media.image_copies(media.render_pages(_read(spark, sf_dir, "pages")), "page_id", "image")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality_rules.apply_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.histogram_shards(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return materialise.materialise(docs, public_tokenizers.path(ORDER_VOCABULARY), public_tokenizers.PATTERN, END_ID, ORDER_KEY)


#: Repeated passages are runs of 50 words or more under repeated strings of so many bytes (50 words of the test tables have 239 at least).
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
#: Of the passages that op5 counts beside its own strings: the least for which windows are as wide as for these.
COUNTED_BYTES = 3 * suffix_dedup.WINDOW + suffix_dedup.GRAM - 1


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns n_passages: maximal runs of bytes under strings of COUNTED_BYTES (231) that also start anywhere
    else, which shows repeated passages of 50 words and more that are shorter than 400 bytes, too."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.cut_spans(docs, suffix_dedup.repeated_spans(docs, also=(COUNTED_BYTES,)))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.when(F.col(f"spans_{COUNTED_BYTES}").isNull(), 0).otherwise(F.size(f"spans_{COUNTED_BYTES}")).cast("long").alias("n_passages"),
    )


def _scored(docs: DataFrame, labels: DataFrame, module, label: str, parts: int, part: int) -> DataFrame:
    sample = labelled_sample(docs, labels, label, held_out(parts, part), module.MAX_TRAINING_ROWS)
    scored = module.score(give_way(docs, "held_out", "predicted"), module.train(sample))
    return scored.withColumn("held_out", held_out(parts, part)).withColumn("predicted", (F.col("score") >= SCORE_THRESHOLD).cast("int"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return _scored(docs, labels, toxicity, "toxic", 4, 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_scores(docs, _read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_members", "n_links")


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    mixed = mixing.pfair_mix(docs, mixing.even_tempered_weights(docs))
    return mixed.select("doc_id", "source", "block", "position", "release", "deadline", "on_target")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    both = bpe.decode(encoded, path, drop=("text",))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(docs, _read(spark, sf_dir, "labels"), classifier, "quality", 5, 0).select("doc_id", "held_out", "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = cross_tokens.aligned_tokens(docs, public_tokenizers.path(ALIGNED_VOCABULARIES[0]), public_tokenizers.path(ALIGNED_VOCABULARIES[1]))
    return found.select("doc_id", *cross_tokens.COLUMNS)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"), drop=("text",))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as bigint) as n_{kind}") for k, kind in enumerate(secret_scan.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text("base"), 256).alias("base_sha256"), secret_scan.span_text("spans").alias("spans"))


def cycled_text(docs: DataFrame) -> DataFrame:
    """``docs`` whose text repeats itself from word a on, every p words, in a tenth of the rows (by the crc32 of the id)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("ws", F.when(F.col("g").isNotNull(), F.expr(r"filter(split(text, '[ \\t-\\r]+'), w -> w <> '')")))
    docs = docs.withColumn("a", F.expr("if(size(ws) > 0, cast(g % size(ws) as int), null)")).withColumn("p", F.expr("1 + cast((size(ws) - a) div (3 + g % 8) as int)"))
    again = F.expr("array_join(transform(ws, (w, i) -> if(i < a, w, ws[a + (i - a) % p])), ' ')")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(cycled_text(_read(spark, sf_dir, "documents")), drop=("text",))
    # of the longest runs the first, of those the one of the smallest period
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_image_copies, op2_quality_rules, op3_histogram_shards, op4_training_order, op5_repeated_spans, op6_toxicity, op7_ngram_join, op8_pfair_mix, op9_byte_bpe, op10_quality_classifier, op11_token_alignment, op12_secret_scan, op13_periodic_runs)}


def _op2_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    rules = []
    for r in quality_rules.RULES:
        top, _, bottom = r.measure.partition(" / ")
        measure = f"{top}::double / nullif({bottom}, 0)" if bottom else f"{top}::double"
        rules.append(f"coalesce({measure} between {r.low!r} and {r.high!r}, true)")
    breaks = r"[ \t-\r]"
    return f"""
with words as (
  select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '{breaks}+'), lambda w: w <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as ls
  from documents),
grams as (
  select doc_id, i, count(*) over (partition by doc_id, a, b, c) as times
  from (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from words where len(ws) > 2) s,
       lateral (select ws[i] as a, ws[i + 1] as b, ws[i + 2] as c)),
repeats as (select doc_id, count(distinct i + j) as n from grams, (values (0), (1), (2)) as s(j) where times > 1 group by doc_id),
counts as (
  select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '{breaks}', '', 'g'))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls)::bigint as n_lines,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(list_filter(ws, lambda w: lower(w) in ({stops})))::bigint as n_stop_words,
         coalesce(r.n, 0)::bigint as n_repeat_words
  from words w left join repeats r on r.doc_id = w.doc_id),
base as (select *, n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {' and '.join(rules)} as kept from base"""


_OP7_SQL = r"""
with recursive norm as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') as ws
  from documents),
shingles as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from norm where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b
  from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) as b from reach group by a),
degrees as (select a, count(*) as k from links group by a)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id,
       count(*) over (partition by least(d.doc_id, coalesce(l.b, d.doc_id)))::bigint as n_members,
       coalesce(g.k, 0)::bigint as n_links
from documents d left join sizes s using (doc_id) left join low l on l.a = d.doc_id left join degrees g on g.a = d.doc_id"""


#: crc32 bit by bit; pairs of equal words q apart; stretches of such pairs; those without a smaller period.
_OP13_SQL = r"""
with hashed as (
  select doc_id, coalesce(text, '') as text,
         xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
             lambda x, c: list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end)), 4294967295) as h
  from documents),
split as (select doc_id, h // 10 as g, h % 10 = 0 as cycled, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda w: w <> '') as ws from hashed),
cut as (select *, case when cycled and len(ws) > 0 then g % len(ws) end as a from split),
words as (
  select doc_id, i, ws[1 + case when a is null or i < a then i else a + (i - a) % (1 + (len(ws) - a) // (3 + g % 8)) end] as w
  from cut, unnest(range(len(ws))) as s(i)),
equal as (select x.doc_id, x.i, y.i - x.i as q from words x join words y on y.doc_id = x.doc_id and y.w = x.w and y.i > x.i),
islands as (select doc_id, q, min(i) as s, count(*) + q as n from (select *, i - row_number() over (partition by doc_id, q order by i) as island from equal) group by doc_id, q, island),
stretches as (select * from islands where n >= greatest(12, 2 * q)),
runs as (select * from stretches x where not exists (select 1 from stretches y where y.doc_id = x.doc_id and y.q < x.q and y.s <= x.s and y.s + y.n >= x.s + x.n)),
listed as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as lines,
         max(row(n, -s, -q)) as best
  from runs group by doc_id),
dropped as (select distinct doc_id, unnest(range(s + q, s + n)) as i from runs),
kept as (select doc_id, string_agg(w, ' ' order by i) as t from words anti join dropped using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, (-best[2])::bigint as start, best[1]::bigint as length, (-best[3])::bigint as period,
       (1000 * best[1] // -best[3])::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from documents d left join listed using (doc_id) left join kept using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _op2_sql(), "op7_ngram_join": _OP7_SQL, "op13_periodic_runs": _OP13_SQL}
