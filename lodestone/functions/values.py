"""Numbers, vectors, dates, arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length or the dimensions differ."""
    lengths = norm(a) * norm(b)
    return F.when((lengths == 0) | (F.size(a) != F.size(b)), 0.0).otherwise(dot(a, b) / lengths)


def valid_vector(a: Column, dimensions: int) -> Column:
    """Right dimension, all finite, not zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(a) == dimensions) & finite & (norm(a) > 1e-12), F.lit(False))


def blend(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * weight + y * (1 - weight))


def number_or_lowest(c: Column) -> Column:
    """A double, or minus infinity for what is none."""
    return F.coalesce(c.try_cast("double"), F.lit(float("-inf")))


def overlap_percent(c: Column) -> Column:
    """Shares below 1 become percent; whole, between 0 and 90."""
    x = c.cast("double")
    return F.least(F.greatest(F.when((x > 0) & (x < 1), x * 100).otherwise(x).cast("int"), F.lit(0)), F.lit(90))


def overlap_length(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def hierarchy_boost(level: Column, kind: Column, boost: float = 0.1) -> Column:
    share = F.when(kind == "title", 1.0).when(
        (kind == "heading") & level.isNotNull(), F.when(level == 1, 0.8).when(level == 2, 0.6).when(level == 3, 0.4).otherwise(0.2)
    )
    return F.coalesce(share * boost, F.lit(0.0))


def position_boost(page: Column, area: Column, boost: float = 0.1) -> Column:
    """Early pages and large boxes (over 48000) score up to half the boost each."""
    early = F.coalesce(boost * 0.5 / (1 + (page - 1) * 0.2), F.lit(0.0))
    large = F.when(area > 48000, F.least(F.lit(1.0), area / 240000) * boost * 0.5).otherwise(0.0)
    return early + F.coalesce(large, F.lit(0.0))


def keyword_overlap(query_words: Column, text_words: Column) -> Column:
    """Share of the query's distinct words that the text has."""
    q = F.array_distinct(query_words)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, text_words)) / F.size(q))


def hash_sampled(key: Column, rate: float) -> Column:
    """True for a fixed share of keys, by the first 32 bits of their SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / 4294967295.0 < rate


def duration_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_millis(end) - F.unix_millis(start))


# Seconds to wait before the first, second and later retries.
RETRY_SECONDS = (30, 120, 300)


def retry_delay(count: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), F.least(F.greatest(count, F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int"))


def free_timestamp(c: Column) -> Column:
    """The first of the usual formats that reads the text."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "dd.MM.yyyy")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def partial_date(c: Column) -> Column:
    """First day of a date given as year, year and month, or in full."""
    part = lambda i: F.regexp_extract(c, r"(\d{4})(?:[./年-](\d{1,2}))?(?:[./月-](\d{1,2}))?", i)
    number = lambda i: F.when(part(i) == "", "1").otherwise(part(i)).cast("int")
    return F.when(part(1) != "", F.make_date(part(1).cast("int"), number(2), number(3)))


def merge_metadata(a: Column, b: Column) -> Column:
    """Maps of arrays joined key by key, values in order without repeats."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty)))


def metadata_schema(keys: DataFrame) -> DataFrame:
    """One row: the JSON schema of metadata keys (key, description, enum, one row each; keys without a name are left out).
    A key with an enumeration is a string; other keys are not allowed."""
    known = F.size(F.coalesce("enum", F.array().cast("array<string>"))) > 0
    prop = F.struct(F.coalesce("description", F.lit("")).alias("description"), F.when(known, F.col("enum")).alias("enum"), F.when(known, F.lit("string")).alias("type"))
    every = keys.filter("key <> ''").agg(F.array_sort(F.collect_list(F.struct("key", prop.alias("p")))).alias("all"))
    properties = F.map_from_entries("all")
    return every.select(F.to_json(F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.lit(False).alias("additionalProperties"))).alias("schema"))


def sparse_map(indices: Column, values: Column) -> Column:
    return F.map_from_arrays(indices, values)


def tag_similarity(query: Column, features: Column) -> Column:
    """Ten times the cosine of two tag weight maps; 0 where either is empty."""
    keys = F.map_keys(query)
    shared = F.aggregate(keys, F.lit(0.0), lambda t, k: t + F.element_at(query, k) * F.coalesce(F.element_at(features, k), F.lit(0.0)))
    length = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda t, x: t + x * x))
    product = length(query) * length(features)
    return F.when((product == 0) | product.isNull(), 0.0).otherwise(10 * shared / product)
