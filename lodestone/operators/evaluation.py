"""Retrieval metrics set-at-a-time: all queries of a run in one plan.

results: query_id, rank (1-based, duplicates keep their rank), chunk_id.
judgments: query_id, chunk_id, grade (0-3), source, weight (null: by source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of judgment sources, and the grade from which a chunk is relevant.
SOURCE_WEIGHTS = {"gold_manual": 1.0, "business_import": 0.7, "llm_assisted": 0.4}
RELEVANT_GRADE = 2


def judgment_weight(scope: str = "weighted_all") -> Column:
    """1 within one source's scope; over all sources the explicit weight or that of the source."""
    if scope != "weighted_all":
        return F.when(F.col("source") == scope, 1.0)
    by_source = F.coalesce(*[F.when(F.col("source") == s, F.lit(w)) for s, w in SOURCE_WEIGHTS.items()])
    return F.when(by_source.isNotNull(), F.coalesce(F.col("weight"), by_source))


def relevance(judgments: DataFrame, scope: str = "weighted_all") -> DataFrame:
    """(query_id, chunk_id, rel, gain): weights of relevant judgments and weighted grades; repeated judgments add up."""
    w = judgments.withColumn("w", judgment_weight(scope)).filter("w is not null")
    grade = F.least(F.greatest(F.col("grade"), F.lit(0)), F.lit(3))
    return w.groupBy("query_id", "chunk_id").agg(F.sum(F.when(F.col("grade") >= RELEVANT_GRADE, F.col("w")).otherwise(0.0)).alias("rel"), F.sum(grade * F.col("w")).alias("gain"))


def query_metrics(results: DataFrame, judgments: DataFrame, k: int, scope: str = "weighted_all") -> DataFrame:
    """precision, recall, hit rate, reciprocal rank, average precision and nDCG at k for every query of the results."""
    rel = relevance(judgments, scope)
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    hits = results.filter(F.col("rank") <= k).withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    scored = hits.join(rel, ["query_id", "chunk_id"], "left").fillna(0.0, ["rel", "gain"])
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    scored = scored.withColumn("so_far", F.sum("rel").over(running))
    got = scored.groupBy("query_id").agg(
        F.sum("rel").alias("s"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") > 0, F.col("rel") * F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"), "chunk_id")
    ideal = rel.withColumn("at", F.row_number().over(order)).groupBy("query_id").agg(F.sum("rel").alias("total"), F.sum(F.when(F.col("at") <= k, F.col("gain") / F.log2(F.col("at") + 1)).otherwise(0.0)).alias("idcg"))
    j = results.select("query_id").distinct().join(got, "query_id", "left").join(ideal, "query_id", "left").fillna(0.0)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return j.select(
        "query_id",
        F.when(F.col("total") > 0, F.col("s") / k).otherwise(0.0).alias("precision"),
        share("s", "total").alias("recall"),
        F.when(F.col("s") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        F.when(F.coalesce("first", F.lit(0)) > 0, 1.0 / F.col("first")).otherwise(0.0).alias("mrr"),
        share("ap", "total").alias("ap"),
        share("dcg", "idcg").alias("ndcg"),
    )


def summarise(metrics: DataFrame) -> DataFrame:
    """(metric, mean, p95) over the queries; p95 by nearest rank."""
    names = [c for c in metrics.columns if c != "query_id"]
    long = metrics.select(F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("metric", "v"))
    return long.groupBy("metric").agg(F.avg("v").alias("mean"), F.expr("percentile_disc(0.95) within group (order by v)").alias("p95"))


def change_type(delta: Column, threshold: float) -> Column:
    return F.when(delta.isNull() | F.isnan(delta), "missing_metric").when(delta >= threshold, "improved").when(delta <= -threshold, "regressed").otherwise("unchanged")


def compare_metric(baseline: DataFrame, candidate: DataFrame, key: str, metric: str, threshold: float = 0.01) -> DataFrame:
    """Full outer comparison of a metric: both values, delta, presence and one of six kinds of change."""
    b = baseline.select(key, F.col(metric).alias("before"), F.lit(True).alias("b"))
    c = candidate.select(key, F.col(metric).alias("after"), F.lit(True).alias("c"))
    j = b.join(c, key, "full_outer").withColumn("delta", F.col("after") - F.col("before"))
    kind = F.when(F.col("b").isNull(), "missing_baseline").when(F.col("c").isNull(), "missing_candidate").otherwise(change_type(F.col("delta"), threshold))
    return j.select(key, "before", "after", "delta", F.col("b").isNotNull().alias("in_baseline"), F.col("c").isNotNull().alias("in_candidate"), kind.alias("change_type"))


# How far a candidate index may fall behind the active one.
MAX_REGRESSION, MAX_P95_GROWTH, MAX_LEAKS = 0.02, 0.20, 0


#: Parts of a column between which a rank is looked for.
RANK_PARTS = 64


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row (``value``): the percentile by nearest rank, exactly. Counts between bounds (approximate, of RANK_PARTS parts) tell in
    which part the rank is, and only the different values of this part meet in one task."""
    counts = df.select(value).filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    quantiles = [i / RANK_PARTS for i in range(1, RANK_PARTS)]
    bounds = counts.agg(F.array_distinct(F.percentile_approx(value, quantiles, 10 * RANK_PARTS)).alias("bounds"))
    placed = counts.join(F.broadcast(bounds)).withColumn("part", F.expr(f"size(filter(coalesce(bounds, array()), b -> b < `{value}`))")).drop("bounds")  # one row
    sums = placed.groupBy("part").agg(F.sum("n").alias("n"))  # RANK_PARTS rows at most
    so_far = sums.withColumns({"upto": F.sum("n").over(Window.orderBy("part")), "all": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    wanted = F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(share)))
    chosen = so_far.withColumn("rank", wanted - (F.col("upto") - F.col("n"))).filter("rank between 1 and n").select("part", "rank")
    inside = placed.join(F.broadcast(chosen), "part").withColumn("upto", F.sum("n").over(Window.orderBy(value)))  # chosen is one row
    return inside.filter(F.col("upto") >= F.col("rank")).agg(F.min(value).alias(value))


def quality_gate(active: DataFrame, candidate: DataFrame, leaks: DataFrame) -> DataFrame:
    """One row per check (metric, before, after, passed): mean recall, ndcg, mrr and the p95 of latency_ms; leaks must be none."""
    means = ["recall", "ndcg", "mrr"]
    row = lambda df, tag: df.agg(*[F.avg(m).alias(f"{m}_{tag}") for m in means]).crossJoin(nearest_rank(df, "latency_ms", 0.95).withColumnRenamed("latency_ms", f"p95_{tag}"))
    both = row(active, "a").crossJoin(row(candidate, "c")).crossJoin(leaks.agg(F.count("*").alias("leaks")))  # one-row tables
    checks = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("before"), F.col(f"{m}_c").alias("after"), (F.col(f"{m}_a") - F.col(f"{m}_c") <= MAX_REGRESSION).alias("passed")) for m in means]
    checks.append(F.struct(F.lit("p95_ms").alias("metric"), F.col("p95_a").cast("double").alias("before"), F.col("p95_c").cast("double").alias("after"), (F.col("p95_c") <= F.col("p95_a") * (1 + MAX_P95_GROWTH)).alias("passed")))
    checks.append(F.struct(F.lit("leaks").alias("metric"), F.lit(0.0).alias("before"), F.col("leaks").cast("double").alias("after"), (F.col("leaks") <= MAX_LEAKS).alias("passed")))
    return both.select(F.inline(F.array(*checks)))
