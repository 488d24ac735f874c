"""Nearest vectors by products of blocks: the same as all pairs, also for odd vectors, and no row a pair."""

import random

import pytest
from lodestone.functions import values as V
from lodestone.operators import nearest as N
from lodestone.operators import retrieval as R
from pyspark.sql import Window
from pyspark.sql import functions as F


def plain(rows, queries, k, least=None, by=("query_id",)):
    met = rows.join(F.broadcast(queries), "file_id") if "file_id" in by else rows.crossJoin(F.broadcast(queries))
    scored = met.select(*by, "vec_id", V.cosine(F.col("embedding"), F.col("q")).alias("score"))
    scored = scored if least is None else scored.filter(F.col("score") >= least)
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return sorted(map(repr, scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank").collect()))


def table(spark, n, seed, key="bigint", odd=True):
    draw = random.Random(seed)
    vectors = [[draw.gauss(0, 1) for _ in range(5)] for _ in range(n)]
    if odd:
        for i in range(0, n, 4):  # copies, and vectors that hardly differ
            vectors[i] = list(vectors[0]) if i % 8 else [x + 1e-9 * i for x in vectors[0]]
        vectors[1:9] = [None, [0.0] * 5, [1.0, 2.0], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 1.0, 0.0, 0.0, 0.0], [], [1e-170, 0.0, 0.0, 0.0, 0.0]]
    name = (lambda i: i) if key == "bigint" else (lambda i: f"ä{i}")
    return spark.createDataFrame([(name(i), v, i % 3) for i, v in enumerate(vectors)], f"vec_id {key}, embedding array<double>, file_id bigint")


@pytest.mark.parametrize("key", ["bigint", "string"])
@pytest.mark.parametrize(("k", "least"), [(3, None), (40, None), (7, 0.1), (500, None)])
def test_as_all_pairs(spark, monkeypatch, key, k, least):
    monkeypatch.setattr(N, "VECTORS_AT_ONCE", 64)
    monkeypatch.setattr(N, "QUERIES_AT_ONCE", 5)
    monkeypatch.setattr(N, "PAIRS_AT_ONCE", 50)
    rows = table(spark, 300, 1, key)
    queries = table(spark, 24, 2).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = R.dense_topk(rows.drop("file_id"), queries, k, threshold=least).drop("rank")
    assert sorted(map(repr, got.collect())) == plain(rows, queries, k, least)


def test_groups_as_all_pairs(spark):
    rows, queries = table(spark, 300, 3), table(spark, 24, 4).select(F.col("vec_id").alias("query_id"), "file_id", F.col("embedding").alias("q"))
    found = N.near_vectors(rows, queries, 6, 10, group="file_id")
    w = Window.partitionBy("query_id", "file_id").orderBy(F.desc("score"), "vec_id")
    got = found.withColumn("r", F.row_number().over(w)).filter("r <= 6").select("query_id", "file_id", "vec_id", "score")
    assert sorted(map(repr, got.collect())) == plain(rows, queries, 6, by=("query_id", "file_id"))


def test_no_row_a_pair(spark):
    """Before, Spark made and scored a row a pair of query and vector; 4 million pairs are a second's work as products."""
    vectors = spark.range(20000).select(F.col("id").alias("vec_id"), F.expr("transform(sequence(1, 64), d -> cast(randn(7) as float))").alias("embedding"))
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = R.dense_topk(vectors, queries, 10)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan
