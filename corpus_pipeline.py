"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

1. toxicity: documents that the compression-distance classifier rejects go (clean ones stay; without labels of both
   classes, all).
2. near copies: one document of each group of the n-gram Jaccard join stays, that of the smallest id.
3. repeated passages: runs of 50 words or more under 200-byte strings that occur twice go from the text
   (50 words of prose have 240 bytes or more, so every passage of over 50 words holds such strings;
   shorter repeats stay; a character cut in part goes as a whole; n_chars follows; no document is dropped).
4. mixing: documents stand in the order of their block in the Pfair mix, over files in order.
5. byte-level BPE: ids of the text, and the text read back from the ids (a null text comes back empty); other columns stay.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, mixing, ngram_join, queries, suffix_dedup
from lodestone.llm.common import give_way, scratch_dir, set_aside

#: Blocks of the mix that one output file holds.
BLOCKS_PER_FILE = 128


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, named = set_aside(docs, "doc_id", "text")
    scored = queries.toxicity_scores(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return named(scored.filter("predicted = 0"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_component(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = suffix_dedup.repeated_spans(docs, threshold=queries.PASSAGE_BYTES)
    cut = suffix_dedup.cut_text(docs, spans, min_words=queries.PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, named = set_aside(docs, "doc_id", "text", "source")
    mixed = mixing.pfair_mix(plain, mixing.even_tempered_weights(plain))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes = max(mixing.BLOCK_BYTES, -(-n_bytes // mixing.MAX_BLOCKS))
    files = n_bytes // (block_bytes * BLOCKS_PER_FILE) + docs.select("source").distinct().count() // BLOCKS_PER_FILE + 2
    placed = mixed.withColumn("_file", F.least(F.expr(f"cast(position div {BLOCKS_PER_FILE} as int)"), F.lit(files - 1)))
    return named(placed.repartitionById(files, F.col("_file")).sortWithinPartitions("position", "doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(queries.VOCABULARY)
    docs = give_way(docs, "n_tokens", "ids")
    plain, named = set_aside(docs, "text")
    decoded = bpe.decode(bpe.encode(plain, path, public_tokenizers.PATTERN), path, drop=("text", "n_split"))
    return named(decoded.withColumn("text", F.decode("decoded", "UTF-8")), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixing", mix), ("byte_bpe", encode)]

#: The stages on learned scores, components and byte positions have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/lodestone/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
