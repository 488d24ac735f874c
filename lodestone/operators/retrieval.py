"""Retrieval: dense and sparse recall, fusion, reranking, tags, multi-scope search.

Top-k ends in TakeOrderedAndProject: each task keeps k rows, and only those meet. Scopes are
semi-joins before the top-k. Query-side tables are a stated query set of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..sources.durable import durable
from .nearest import near_vectors

# Full-text defaults and the constants of fusion and exact matches.
K1, B = 1.2, 0.75
RRF_K = 60
EXACT_BOOST = 8.0
#: Terms, or queries, of one search call (a query is at most this many terms).
MAX_TERMS = 256
#: Query vectors, and queries of a scan of texts (about as many), that are broadcast at once.
QUERY_BLOCK, SCAN_QUERIES = 4096, 512


def ranked_unique(hits: DataFrame, scope: str, item: str, order: list[str]) -> DataFrame:
    """First occurrence of each item with its original rank (gaps stay where repeats were)."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))
    first = Window.partitionBy(scope, item).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).filter(F.col(item).isNotNull()).drop("_n")


def minmax(df: DataFrame, value: str, scope: list[str]) -> DataFrame:
    """score: value scaled to 0..1 in its scope, 0.5 where all are equal."""
    w = Window.partitionBy(*scope)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("score", F.when(high == low, 0.5).otherwise((F.col(value) - low) / (high - low)))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, scope: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine top-k. queries: query_id, q — a stated set, broadcast in blocks of
    QUERY_BLOCK at most."""
    rows = vectors if scope is None else vectors.join(scope, "vec_id", "left_semi")
    return topk(near_vectors(rows, queries, k, QUERY_BLOCK, threshold), k, "vec_id")


def topk(scored: DataFrame, k: int, item: str) -> DataFrame:
    """The k best of each query with their rank; Spark's window group limit keeps k a task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def term_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted rows (id, term, tf, dl): the index that sparse search reads; write it bucketed by term."""
    d = docs.select(F.col(id_col).alias("id"), T.words(F.col(text_col)).alias("w")).withColumn("dl", F.size("w"))
    return d.select("id", "dl", F.explode("w").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n documents, mean length in words."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.words(F.col(text_col)))).alias("avgdl"))


def bm25(terms: DataFrame, stats: DataFrame, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of documents that have any query term. queries: query_id, term (a stated set).

    Document frequencies count the whole index, the scope only limits hits."""
    wanted = queries.distinct()
    rows = terms.join(F.broadcast(wanted.select("term").distinct()), "term")
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    if scope is not None:
        rows = rows.join(scope, "id", "left_semi")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    j = rows.join(F.broadcast(df), "term").join(F.broadcast(stats)).join(F.broadcast(wanted), "term")
    return j.groupBy("query_id", "id").agg(F.sum(weight).alias("score"))


def scan_bm25(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) as :func:`bm25` gives them, straight from the texts, for a stated set of queries
    (query_id, term): all term counts of a document are worked out inside its row, so that nothing but one row a
    query term is shuffled, and the top-k that follows keeps k rows a task.

    Two passes over the texts for each block of SCAN_QUERIES queries, whose terms are all that is broadcast: document frequencies
    and lengths, then scores. A null text has no words."""
    parts = -(-queries.select("query_id").distinct().count() // SCAN_QUERIES)
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts)))
    blocks = [queries] if parts <= 1 else [queries.filter(block == i) for i in range(parts)]
    return reduce(DataFrame.unionByName, (_scan_block(docs, id_col, text_col, b, scope) for b in blocks))


def _scan_block(docs: DataFrame, id_col: str, text_col: str, queries: DataFrame, scope: DataFrame | None) -> DataFrame:
    terms = queries.select("query_id", "term").distinct()
    wanted = terms.agg(F.array_sort(F.collect_set("term")).alias("wanted"))
    words = F.coalesce(T.words(F.col(text_col)), F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w")).join(F.broadcast(wanted)).select("id", "w", F.size("w").alias("dl"), F.array_intersect("w", "wanted").alias("hit"))
    counted = rows.select("dl", F.explode(F.concat(F.array(F.lit(None).cast("string")), "hit")).alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("dl").alias("total"))
    every = F.col("term").isNull()
    stats = counted.agg(F.max(F.when(every, F.col("c"))).alias("n"), F.max(F.when(every, F.col("total") / F.col("c"))).alias("avgdl"), F.map_from_entries(F.collect_list(F.when(~every, F.struct("term", "c")))).alias("dfs"))
    asked = terms.groupBy("query_id").agg(F.collect_list("term").alias("terms")).agg(F.collect_list(F.struct("query_id", "terms")).alias("asked"))
    plan = stats.join(F.broadcast(asked)).join(F.broadcast(wanted)).select(
        "avgdl",
        F.expr("transform(wanted, t -> ln(1 + (n - coalesce(dfs[t], 0) + 0.5D) / (coalesce(dfs[t], 0) + 0.5D)))").alias("idf"),
        "wanted",
        F.expr("transform(asked, q -> struct(q.query_id as query_id, transform(q.terms, t -> cast(array_position(wanted, t) as int)) as places))").alias("asked"),
    )
    if scope is not None:
        rows = rows.join(scope, "id", "left_semi")
    length = f"{K1} * (1 - {B} + {B} * dl / avgdl)"
    weights = f"transform(wanted, (t, i) -> if(array_contains(hit, t), transform(array(dl - size(array_remove(w, t))), tf -> idf[i] * tf * ({K1} + 1) / (tf + {length}))[0], 0D))"
    scored = rows.filter(F.size("hit") > 0).join(F.broadcast(plan)).select("id", "asked", F.expr(weights).cast("array<double>").alias("weights"))
    each = scored.select("id", F.explode(F.expr("transform(asked, q -> struct(q.query_id as query_id, aggregate(q.places, 0D, (s, p) -> s + weights[p - 1]) as score))")).alias("s"))
    return each.select("s.query_id", "id", "s.score").filter("score > 0")


#: Ids of one row of the lists that pairs are made from: what many documents or queries share has many rows.
LIST_IDS = 1024
#: Tasks a core that rows which stand for many are dealt to.
SPREAD = 8


def _id_lists(rows: DataFrame, keys: list[str], id_col: str, name: str) -> DataFrame:
    """(keys, ``name``: ids with these keys), in lists of about LIST_IDS ids."""
    counts = rows.groupBy(*(F.col(c).alias(f"_of_{c}") for c in keys)).agg(F.ceil(F.count("*") / LIST_IDS).alias("_lists"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    placed = rows.join(counts, same).select(*keys, id_col, F.pmod(F.xxhash64(id_col), "_lists").alias("_list"))
    return placed.groupBy(*keys, "_list").agg(F.collect_list(id_col).alias(name)).drop("_list")


def multi_field(docs: DataFrame, fields: dict[str, float], queries: DataFrame, min_match: float) -> DataFrame:
    """(query_id, id, score): the best field counts, each with its boost times the query terms it has; documents must have
    ``min_match`` of the terms in all fields together. docs: id and arrays of words; queries: query_id, term (a stated set).

    Words meet terms, so documents without a term are never paired; documents with the same words, and queries with the same terms,
    are matched once. A match then carries the ids on both sides in short lists, and its pairs are spelled out last, in all
    tasks: no pair is shuffled."""
    asked = queries.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    kinds = asked.select("_terms").distinct().select("_terms", F.size("_terms").alias("asked"), F.explode("_terms").alias("term"))
    words = docs.select(*fields).distinct().select(*fields, F.explode(F.array_distinct(F.flatten(F.array(*fields)))).alias("term"))
    held = lambda f: F.sum(F.array_contains(f, F.col("term")).cast("int")).alias(f"_{f}")
    met = words.join(kinds, "term").groupBy("_terms", "asked", *fields).agg(F.count("*").alias("met"), *map(held, fields))
    best = F.greatest(*(F.col(f"_{f}") * b for f, b in fields.items())) if len(fields) > 1 else F.col(f"_{next(iter(fields))}") * next(iter(fields.values()))
    found = met.filter(F.col("met") / F.col("asked") >= min_match).select("_terms", *fields, best.cast("double").alias("score"))
    both = found.join(_id_lists(asked, ["_terms"], "query_id", "_queries"), "_terms").drop("_terms")
    both = both.join(_id_lists(docs.select("id", *fields), list(fields), "id", "_ids"), list(fields)).select("_queries", "_ids", "score")
    # few rows stand for many pairs: they are dealt out by number, as their bytes would put them into one task
    both = both.repartition(max(SPREAD * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return both.select(F.explode("_queries").alias("query_id"), "_ids", "score").select("query_id", F.explode("_ids").alias("id"), "score")


def retry_where_empty(hits: DataFrame, strict: Column) -> DataFrame:
    """Of each query's hits under loose bounds, those under the strict ones, or all where it has none of these: a search with
    its retry as one plan."""
    marked = hits.withColumn("_strict", F.coalesce(strict, F.lit(False)))
    found = marked.groupBy("query_id").agg(F.max("_strict").alias("_any"))
    return marked.join(found, "query_id").filter(F.col("_strict") | ~F.col("_any")).drop("_strict", "_any")


def similarity_bound(threshold: float, vector_weight: float, ids_given: bool) -> float:
    """The least score of a result: none for searches by words only, and for documents that were asked for by id."""
    return 0.0 if vector_weight <= 0 or ids_given else threshold


def weighted_rrf(dense: DataFrame, sparse: DataFrame, item: str, dense_weight: float, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Fused (query_id, item, score, dense_rank, sparse_rank, rank) of ranked lists (query_id, item, rank).

    A channel of weight zero adds no candidates. Ties go to the better rank, then the id."""
    d = dense.select("query_id", item, F.col("rank").alias("dense_rank")) if dense_weight > 0 else dense.limit(0).select("query_id", item, F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", item, F.col("rank").alias("sparse_rank")) if dense_weight < 1 else sparse.limit(0).select("query_id", item, F.col("rank").alias("sparse_rank"))
    j = d.join(s, ["query_id", item], "full_outer")
    part = lambda c, w: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    j = j.withColumn("score", part("dense_rank", dense_weight) + part("sparse_rank", 1 - dense_weight)).withColumn("best", F.least("dense_rank", "sparse_rank"))
    ranked = j.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best", item)))
    return (ranked.filter(F.col("rank") <= limit) if limit else ranked).drop("best")


def blend(hits: DataFrame, vector: str, text: str, weight: float, scope: list[str]) -> DataFrame:
    """weight x vector + rest x min-max of the text score (missing: 0); weight 1 leaves the vector score."""
    if weight >= 1:
        return hits.withColumn("score", F.col(vector))
    scaled = minmax(hits.withColumn("_t", F.coalesce(F.col(text), F.lit(0.0))), "_t", scope)
    return scaled.withColumn("score", weight * F.col(vector) + (1 - weight) * F.col("score")).drop("_t")


def rerank(hits: DataFrame, scorer: Column, original_weight: float = 0.4, boosts: Column | None = None) -> DataFrame:
    """Model score (min-max per query) and retrieval score mixed, plus boosts. ``scorer`` is any Column (built-in or a pandas UDF)."""
    base = hits.withColumnRenamed("score", "retrieval").withColumn("_m", scorer)
    scaled = minmax(base, "_m", ["query_id"]).withColumnRenamed("score", "_model")
    mixed = (1 - original_weight) * F.col("_model") + original_weight * F.col("retrieval")
    return scaled.withColumn("score", mixed + (boosts if boosts is not None else F.lit(0.0))).drop("_m", "_model")


def token_similarity(query: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of the query's token weight that a document has. query: query_id, tok, weight; docs: id, tok (distinct).

    Tokens meet by an equi-join, whose sides Spark broadcasts if their size allows it; each query row carries its own share."""
    total = query.groupBy("query_id").agg(F.sum("weight").alias("total"))
    shares = query.join(total, "query_id").select("query_id", "tok", (F.col("weight") / F.col("total")).alias("share"))
    return docs.join(shares, "tok").groupBy("query_id", "id").agg(F.sum("share").alias("similarity"))


# Shares of a token and of it with the next one, how often each field counts, and what the parts of a score weigh.
TOKEN_SHARE, PAIR_SHARE = 0.4, 0.6
FIELD_TIMES = {"title": 2, "important": 5, "question": 6}
TOKEN_WEIGHT, VECTOR_WEIGHT, FEATURE_WEIGHT = 0.3, 0.7, 10.0


def query_grams(keywords: DataFrame) -> DataFrame:
    """(query_id, grams): of each query a map from tokens, and from neighbours written together, to weights. keywords: query_id, pos,
    tok, weight. A query is one row of at most as many terms as it has."""
    items = F.array_sort(F.collect_list(F.struct("pos", "tok", F.col("weight").cast("double").alias("weight"))))
    pairs = f"""concat(transform(items, x -> struct(x.tok as tok, {TOKEN_SHARE}D * x.weight as w)),
        transform(sequence(1, greatest(size(items) - 1, 1)), i -> struct(if(i < size(items), items[i - 1].tok || items[i].tok, null) as tok, {PAIR_SHARE}D * greatest(items[i - 1].weight, if(i < size(items), items[i].weight, 0D)) as w)))"""
    flat = keywords.groupBy("query_id").agg(items.alias("items")).select("query_id", F.explode(F.expr(pairs)).alias("g")).filter("g.tok is not null")
    summed = flat.groupBy("query_id", F.col("g.tok").alias("tok")).agg(F.sum("g.w").alias("w"))
    return summed.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tok", "w")))).alias("grams"))


def field_grams(content: Column, **fields: Column) -> Column:
    """The tokens of a chunk, and its neighbours written together: the content's different tokens, then each field's as often
    as FIELD_TIMES says."""
    lists = [F.array_distinct(content), *(F.coalesce(c, F.array().cast("array<string>")) for name, c in fields.items() for _ in range(FIELD_TIMES[name]))]
    every = F.concat(*lists)
    after = F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))
    return F.array_distinct(F.concat(every, F.zip_with(F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0))), after, lambda a, b: F.concat(a, b))))


def of_hits(rows: DataFrame, id_col: str, hits: DataFrame) -> DataFrame:
    """``rows`` that the best hits (id) of a stated set of queries name. Taken before anything is worked out of a row: Spark does not
    move a semi-join below such columns by itself. The hits are broadcast; have them written (:func:`durable`) if they are read again."""
    return rows.join(F.broadcast(hits.select(F.col("id").alias(id_col)).distinct()), id_col, "left_semi")


def hybrid_rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, token_weight: float = TOKEN_WEIGHT, vector_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """(query_id, id, score, token_part, vector_part) of a search's hits (query_id, id).

    Token part: the share of the query's gram weight that the chunk has. Vector part: the cosine, 0 for a chunk without a vector; where
    it is 0 for all hits of a query together, tokens alone count, unscaled. Tags: the cosine of the query's and the chunk's tag
    weights (0 without any, and where the query has none), times FEATURE_WEIGHT; the page rank is added.
    The hits are broadcast; chunks should be those of :func:`of_hits`.
    chunks: id, grams (array), embedding, tags (map to weights), pagerank; queries: query_id, grams (map), q, tags (map)."""
    rows = chunks.join(F.broadcast(hits), "id").join(queries.select("query_id", F.col("grams").alias("asked"), "q", F.col("tags").alias("wanted")), "query_id")
    token = "aggregate(array_intersect(map_keys(asked), grams), 1e-9D, (s, k) -> s + asked[k]) / aggregate(map_values(asked), 1e-9D, (s, w) -> s + w)"
    square = lambda m: f"aggregate(map_values({m}), 0D, (s, w) -> s + w * w)"
    common = "aggregate(array_intersect(map_keys(wanted), map_keys(tags)), 0D, (s, k) -> s + wanted[k] * tags[k])"
    feature = f"if(coalesce(size(tags), 0) <= 0 or coalesce(size(wanted), 0) <= 0, 0D, {FEATURE_WEIGHT}D * coalesce({common} / sqrt({square('tags')}) / sqrt({square('wanted')}), 0D))"
    parts = rows.select("query_id", "id", F.expr(token).alias("token_part"), F.coalesce(V.cosine(F.col("embedding"), F.col("q")), F.lit(0.0)).alias("vector_part"), F.expr(feature).alias("_feature"), F.coalesce("pagerank", F.lit(0.0)).alias("_rank"))
    none = F.sum("vector_part").over(Window.partitionBy("query_id")) == 0
    mixed = F.when(none, F.col("token_part")).otherwise(vector_weight * F.col("vector_part") + token_weight * F.col("token_part"))
    return parts.select("query_id", "id", (mixed + F.col("_feature") + F.col("_rank")).alias("score"), "token_part", "vector_part")


def score_fusion(hits: DataFrame, parts: dict[str, float], k: int, item: str, pagerank: str | None = None) -> DataFrame:
    """The k best rows by ``score``: the weighted sum of score columns (a missing one counts 0), and the page rank."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in parts.items()), F.lit(0.0))
    if pagerank:
        total = total + F.coalesce(F.col(pagerank), F.lit(0.0))
    return hits.withColumn("score", total).orderBy(F.desc("score"), item).limit(k)


def toc_boost(hits: DataFrame, chosen: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(id, doc, score): hits with the chunks that a table of contents names. Only the document whose hits have the largest sum
    (of equal ones the smallest) is looked at: its chosen chunks gain their score, those that were not found join with it.

    hits: id, doc, score; chosen: doc, id, gain (what a model picked from each document's contents); chunks: id, doc."""
    best = hits.groupBy("doc").agg(F.sum("score").alias("s")).orderBy(F.desc(F.round("s", 9)), "doc").limit(1).select("doc")
    gains = chosen.join(F.broadcast(best), "doc").groupBy("id").agg(F.sum("gain").alias("gain"))  # best is one row
    named = chunks.join(gains, "id").select("id", "doc", "gain")
    both = hits.select("id", "doc", "score").join(named.withColumnRenamed("doc", "_doc"), "id", "full_outer")
    scored = both.select("id", F.coalesce("doc", "_doc").alias("doc"), (F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def tag_portions(tags: DataFrame, smoothing: int = 1000) -> DataFrame:
    """(tag, portion): (count + 1) / (all + smoothing)."""
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"))
    total = tags.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("tag", F.round((F.col("n") + 1) / (F.col("total") + smoothing), 9).alias("portion"))


def tag_items(matches: DataFrame, priors: DataFrame, top: int, smoothing: int = 1000) -> DataFrame:
    """(id, tag, score): tags of matched rows against their portion in the corpus. matches: id, tag."""
    c = matches.groupBy("id", "tag").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("id")))
    s = c.join(priors, "tag").withColumn("score", F.bround(0.1 * (F.col("c") + 1) / (F.col("n") + smoothing) / F.greatest(F.lit(1e-6), F.col("portion"))).cast("int"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "tag")
    return s.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("id", "tag", "score")


# The similarity a citation needs at first, how the bound falls, where it ends, and how near to the best others must be.
CITE_FIRST, CITE_STEP, CITE_LEAST, CITE_NEAR = 0.63, 0.8, 0.3, 0.99


def cite(sentences: DataFrame, chunks: DataFrame, most: int = 4) -> DataFrame:
    """(sentence_id, chunk_id): chunks whose similarity reaches .99 of the sentence's best, if that passes the
    threshold, which falls from .63 by a fifth at a time down to .3. Every sentence of a stated set meets every chunk.

    One search for each sentence's ``most`` best: the best of them gives the bounds, and those that come near to it are the citations."""
    rows = chunks.select(F.col("chunk_id").alias("vec_id"), F.col("c").alias("embedding"))
    found = dense_topk(rows, sentences.select(F.col("sentence_id").alias("query_id"), F.col("s").alias("q")), most)
    found = found.withColumn("near", F.max("score").over(Window.partitionBy("query_id")) * CITE_NEAR)
    levels, t = [], CITE_FIRST
    while t > CITE_LEAST:
        levels.append(t)
        t *= CITE_STEP
    # the highest level that some sentence passes holds for all
    level = F.coalesce(F.greatest(*(F.max(F.when(F.col("near") >= x, x)) for x in levels)), F.lit(9.0))
    best = durable(found, "citations")
    passing = best.join(F.broadcast(best.agg(level.alias("level")))).filter("near >= level and score >= near")  # level is one row
    return passing.select(F.col("query_id").alias("sentence_id"), F.col("vec_id").alias("chunk_id"))


def contextual(layers: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, top_files: int, per_file: int) -> DataFrame:
    """Three layers: best files by abstract, then by overview, then their chunks; scores mix .2 / .3 / .5.

    layers: file_id, layer (l0, l1), embedding; chunks: vec_id, file_id, embedding."""
    def layer(name: str, n: int, scope: DataFrame | None):
        rows = layers.filter(F.col("layer") == name).select(F.col("file_id").alias("vec_id"), "embedding")
        return minmax(dense_topk(rows, queries, n, scope).withColumnRenamed("score", "raw"), "raw", ["query_id"]).select("query_id", F.col("vec_id").alias("file_id"), F.col("score").alias(name))

    l0 = layer("l0", max(4 * top_files, 80), None)
    l1 = layer("l1", top_files, l0.select(F.col("file_id").alias("vec_id")).distinct())
    files = l0.join(l1, ["query_id", "file_id"])
    asked = durable(files.join(queries, "query_id").select("query_id", "file_id", "l0", "l1", "q"), "asked")
    found = near_vectors(chunks, asked.select("query_id", "file_id", "q"), per_file, QUERY_BLOCK, group="file_id").withColumnRenamed("score", "raw")
    w = Window.partitionBy("query_id", "file_id").orderBy(F.desc("raw"), "vec_id")
    kept = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_file).join(asked.drop("q"), ["query_id", "file_id"])
    near = minmax(kept, "raw", ["query_id"])
    return topk(near.select("query_id", "file_id", "vec_id", (0.2 * F.col("l0") + 0.3 * F.col("l1") + 0.5 * F.col("score")).alias("score")), k, "vec_id")


def multi_scope(hits: DataFrame, scope: str, item: str, per_scope: int, k: int) -> DataFrame:
    """Limit each scope, keep the best of repeated items, order all (hits: scope, item, score)."""
    w = Window.partitionBy(scope).orderBy(F.desc("score"), item)
    kept = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_scope)
    best = kept.groupBy(item).agg(F.max("score").alias("score"), F.min_by(scope, F.struct(-F.col("score"), F.col(scope))).alias(scope))
    return best.orderBy(F.desc("score"), item).limit(k)
