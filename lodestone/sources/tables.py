"""Tables as document sources: type inference, row chunks, incremental reads and sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as each type, in order of preference.
TYPE_PATTERNS = (
    ("int", r"^[+-]?\d{1,18}$"),
    ("float", r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"),
    ("bool", r"(?i)^(true|false|yes|no)$"),
    ("datetime", r"^\d{4}-\d{2}-\d{2}"),
)


def value_type(c: Column) -> Column:
    """int, float, bool, datetime or text; whole numbers beyond 64 bits are float."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(name)) for name, p in TYPE_PATTERNS], F.lit("text"))


def infer_types(df: DataFrame) -> DataFrame:
    """(col, kind): the commonest type of each text column's values."""
    cells = df.select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c))])).alias("col", "x")).filter("x is not null")
    kinds = cells.groupBy("col", value_type(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))
    return kinds.groupBy("col").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))


def row_chunks(df: DataFrame, columns: list[str]) -> Column:
    """A row as "- field: value" lines, null fields left out."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")) for c in columns])


def rdbms_documents(df: DataFrame, content: list[str], metadata: list[str], id_col: str | None = None) -> DataFrame:
    """(id, text, metadata): content columns joined, the others as JSON, id from a column or the text's md5."""
    text = row_chunks(df, content)
    key = F.col(id_col).cast("string") if id_col else F.md5(text)
    return df.select(key.alias("id"), text.alias("text"), F.to_json(F.struct(*metadata)).alias("metadata"))


def poll_window(df: DataFrame, column: str, after, until) -> DataFrame:
    """Rows of the half-open window (after, until]."""
    c = F.col(column).cast("timestamp")
    return df.filter((c > F.lit(after).cast("timestamp")) & (c <= F.lit(until).cast("timestamp")))


def sync_plan(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """(key, action): added, updated, removed or same, by a full outer join."""
    e = existing.select(key, F.col(version).alias("v0"), F.lit(True).alias("in0"))
    i = incoming.select(key, F.col(version).alias("v1"), F.lit(True).alias("in1"))
    j = e.join(i, key, "full_outer")
    return j.select(key, F.when(F.col("in0").isNull(), "added").when(F.col("in1").isNull(), "removed").when(F.col("v0").eqNullSafe(F.col("v1")), "same").otherwise("updated").alias("action"))


def sheet_groups(rows: DataFrame, sheet: str, order: str, small: int = 50, large: int = 1000) -> DataFrame:
    """Rows with strategy and group: small sheets whole, medium by 20 rows, large by 100."""
    w = Window.partitionBy(sheet)
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    strategy = F.when(n <= small, "small").when(n <= large, "medium").otherwise("large")
    size = F.when(n <= small, n).when(n <= large, 20).otherwise(100)
    return rows.withColumn("strategy", strategy).withColumn("group", F.floor(at / size).cast("int"))


def question_pairs(turns: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """(conv, turn, question, answer): a user's turn and the assistant's next one."""
    w = Window.partitionBy(conv).orderBy(order)
    t = turns.withColumn("next_role", F.lead(role).over(w)).withColumn("answer", F.lead(text).over(w))
    return t.filter((F.col(role) == "user") & (F.col("next_role") == "assistant")).select(conv, order, F.col(text).alias("question"), "answer")
