"""Query-side work: expansion with synonyms and phrases, strategy and degradation rules, hybrid retry, research loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TERMS, MAX_KEYWORDS = 256, 32
SYNONYM_SHARE, PHRASE_BOOST, TOP_SYNONYMS = 0.25, 2.0, 8


def expand_query(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, term, weight, kind): each query's weighted words, their synonyms at a quarter of the weight, and
    neighbouring pairs as phrases at twice the larger; at most 256 a query.

    terms: query_id, pos, term, weight; synonyms: term, synonym, rank (a dictionary table)."""
    words = terms.select("query_id", "term", "weight", F.lit("word").alias("kind"))
    near = terms.join(synonyms.filter(F.col("rank") <= TOP_SYNONYMS), "term").select("query_id", F.col("synonym").alias("term"), (F.col("weight") * SYNONYM_SHARE).alias("weight"), F.lit("synonym").alias("kind"))
    w = Window.partitionBy("query_id").orderBy("pos")
    pairs = terms.withColumn("nxt", F.lead("term").over(w)).withColumn("nw", F.lead("weight").over(w)).filter("nxt is not null")
    phrases = pairs.select("query_id", F.concat_ws(" ", "term", "nxt").alias("term"), (F.greatest("weight", "nw") * PHRASE_BOOST).alias("weight"), F.lit("phrase").alias("kind"))
    every = words.unionByName(near).unionByName(phrases).groupBy("query_id", "term").agg(F.max("weight").alias("weight"), F.min("kind").alias("kind"))
    best = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return every.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= MAX_TERMS).drop("r")


def keywords(terms: DataFrame, top: int = MAX_KEYWORDS) -> DataFrame:
    """The heaviest words of each paragraph as a query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return terms.dropDuplicates(["query_id", "term"]).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).drop("r")


@dataclass(frozen=True)
class SearchPlan:
    """What a request comes to: channels, limit and dense weight."""

    dense: bool
    sparse: bool
    limit: int
    dense_weight: float


def plan_search(top_k: int, dense_weight: float, rerank: bool, strategy: str, scope: list | None, has_text_store: bool = True, max_k: int = 100) -> SearchPlan:
    """Builder rules: reranking triples the candidates, precise questions double them; an empty scope searches
    nothing; without a text store, over a global scope, or at weight 1 only vectors; at weight 0 only words."""
    limit = min(top_k * 3 if rerank else top_k, max_k)
    if strategy == "precise":
        limit = min(2 * limit, max_k)
    if scope is not None and not scope:
        return SearchPlan(False, False, 0, dense_weight)
    sparse = has_text_store and scope is not None and dense_weight < 1
    return SearchPlan(dense_weight > 0 or not sparse, sparse, limit, dense_weight if sparse else 1.0)


def search_with_retry(search: Callable[[float, float], DataFrame], first: tuple[float, float] = (0.3, 0.2), relaxed: tuple[float, float] = (0.1, 0.17)) -> DataFrame:
    """Search by (minimum share of words, minimum similarity); if that finds nothing, once more with looser bounds."""
    found = search(*first)
    return found if found.limit(1).count() else search(*relaxed)


def research(question: str, search: Callable[[str], DataFrame], decompose: Callable[[str, DataFrame], list[str]], key: str, depth: int = 3) -> DataFrame:
    """Search, let ``decompose`` (a model or rules) ask follow-ups on what was found, down to a depth; new rows only."""
    found = search(question)
    for follow_up in decompose(question, found) if depth > 1 else []:
        more = research(follow_up, search, decompose, key, depth - 1)
        found = found.unionByName(more.join(found.select(key), key, "left_anti"))
    return found
