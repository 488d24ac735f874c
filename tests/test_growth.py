"""Steps whose work must not grow faster than their input or result."""

import random

from lodestone.operators import evaluation as E
from lodestone.operators import retrieval as R
from pyspark.sql import functions as F


def test_nearest_rank_is_percentile_disc(spark, monkeypatch):
    monkeypatch.setattr(E, "RANK_PARTS", 10)
    draw = random.Random(5)
    for values in ([], [None], [3.0], [2.0] * 50, [float(draw.randrange(40)) for _ in range(400)] + [None] * 9, [draw.gauss(0, 1) for _ in range(500)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        want = df.agg(F.expr("percentile_disc(0.95) within group (order by v)")).first()[0]
        found = E.nearest_rank(df, "v", 0.95)
        assert [r[0] for r in found.collect()] == [want]
        assert "percentile_disc" not in found._jdf.queryExecution().executedPlan().toString()


def test_equal_documents_are_matched_once(spark):
    """Before, every pair of a document and a query was a row a shared term, and these were grouped."""
    docs = spark.range(200).select("id", F.array(F.lit("red"), F.lit("ring")).alias("a"), F.array(F.when(F.col("id") % 2 == 0, "old").otherwise("new")).alias("b"))
    asked = spark.range(30).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("ring"), F.lit("old"))).alias("term"))
    found = R.multi_field(docs, {"a": 3.0, "b": 2.0}, asked, 0.6)
    assert sorted(map(tuple, found.collect())) == [(q, d, 3.0) for q in range(30) for d in range(0, 200, 2)]
    plan = R.multi_field(docs, {"a": 3.0, "b": 2.0}, asked, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # the pairs come from a join above all aggregates
