"""Cluster trees over vectors: projection, Gaussian mixtures chosen by BIC, summaries, and again on the summaries.

Principal components stand in for the manifold projection, which Spark does not have."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLUSTERS, DIMENSIONS = 8, 8
#: Probability that makes a vector a member of a cluster; the first such cluster is the one it goes to.
MEMBERSHIP = 0.1
STRUCTURED = ("xls", "xlsx", "csv", "tsv")


def skip_clustering(extension: Column, tabular: Column) -> Column:
    """Spreadsheets and table-like PDFs are not clustered."""
    e = F.regexp_replace(F.lower(extension), r"^\.", "")
    return e.isin(*STRUCTURED) | ((e == "pdf") & tabular)


def best_clusters(vectors: DataFrame, id_col: str, vector_col: str, most: int = MAX_CLUSTERS, seed: int = 7) -> DataFrame:
    """(id, cluster, memberships) of the mixture with the lowest BIC for 2 to ``most`` components, or one cluster for fewer than four
    vectors. ``memberships``: the probability of each cluster; ``cluster``: the first of more than MEMBERSHIP, which
    may not be the likeliest where clusters overlap."""
    data = vectors.select(id_col, array_to_vector(F.transform(vector_col, lambda x: x.cast("double"))).alias("v"))
    n, width = data.count(), (vectors.select(F.size(vector_col)).first() or [0])[0]
    k = min(DIMENSIONS, n - 1, width)
    if n < 4:
        return vectors.select(id_col, F.lit(0).alias("cluster"), F.array(F.lit(1.0)).alias("memberships"))
    reduced = PCA(k=k, inputCol="v", outputCol="features").fit(data).transform(data).select(id_col, "features").persist()
    best = None
    for size in range(2, min(most, n - 1) + 1):
        model = GaussianMixture(k=size, seed=seed, featuresCol="features", predictionCol="cluster").fit(reduced)
        free = size * (k + k * (k + 1) / 2) + size - 1
        bic = free * math.log(n) - 2 * model.summary.logLikelihood
        if best is None or bic < best[0]:
            best = (bic, model)
    soft = best[1].transform(reduced).select(id_col, vector_to_array("probability").alias("memberships"))
    first = F.expr(f"cast(array_position(transform(memberships, p -> p > {MEMBERSHIP}), true) - 1 as int)")
    return soft.select(id_col, first.alias("cluster"), "memberships")


def cluster_tree(nodes: DataFrame, summarise: Callable[[DataFrame], DataFrame], levels: int = 3) -> DataFrame:
    """(id, level, parent) of all levels: cluster, summarise each cluster to a new node, repeat until one is left.

    nodes: id string, text, embedding. ``summarise``: (cluster, texts, embeddings) -> (cluster, text, embedding)."""
    out, level = None, 0
    while level < levels:
        placed = nodes.join(best_clusters(nodes, "id", "embedding").select("id", "cluster"), "id")
        name = F.concat_ws("-", F.lit(f"L{level + 1}"), F.col("cluster").cast("string"))
        rows = placed.select("id", F.lit(level).alias("level"), name.alias("parent"))
        out = rows if out is None else out.unionByName(rows)
        groups = placed.groupBy("cluster").agg(F.sort_array(F.collect_list("text")).alias("texts"), F.collect_list("embedding").alias("embeddings"))
        nodes = summarise(groups).select(name.alias("id"), "text", "embedding")
        level += 1
        if nodes.limit(2).count() < 2:
            break
    return out
