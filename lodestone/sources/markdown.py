"""Markdown lines as elements: headings, code fences, lists, quotes, tables, text runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elements(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, element, kind, level, text): runs of lines of one kind (gaps and islands); a fence runs to its end."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line"))
    w = Window.partitionBy(id_col).orderBy("at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(so_far)).withColumn("fence", fence)
    kind = (
        F.when(F.col("fence") | (F.col("fences") % 2 == 1), "code")
        .when(F.col("line").rlike(r"^#{1,6}\s"), "heading")
        .when(F.col("line").rlike(r"^\s*([-*+]|\d+\.)\s"), "list")
        .when(F.col("line").rlike(r"^\s*>"), "quote")
        .when(F.contains("line", F.lit("|")), "table")
        .when(F.trim("line") == "", "blank")
        .otherwise("text")
    )
    lines = lines.withColumn("kind", kind)
    opens = F.when((F.col("kind") != F.lag("kind").over(w)) | (F.col("kind") == "heading") | (F.col("fence") & (F.col("fences") % 2 == 1)) | F.lag("kind").over(w).isNull(), 1).otherwise(0)
    lines = lines.withColumn("opens", opens).withColumn("element", F.sum("opens").over(so_far))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    out = lines.filter("kind <> 'blank'").groupBy(id_col, "element").agg(F.first("kind").alias("kind"), text.alias("text"))
    return out.withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", r"^(#{1,6})\s", 1))))
