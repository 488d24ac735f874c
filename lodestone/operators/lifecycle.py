"""Index lifecycle, retention, deletion, quotas and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Queues and priorities by size (bytes) and role, heartbeat minutes.
SIZE_CLASSES = ((1_000_000, "fast", 8), (10_000_000, "normal", 5))
SLOWEST = ("slow", 2)
ROLES = {"admin": ("fast", 10), "member": ("normal", 5), "viewer": ("slow", 3)}
HEARTBEAT_MINUTES, ACTIVE_MINUTES = 10, 15
DECAY = 0.8


def change_scan(indexed: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): new, stale, same or gone, by content hash."""
    i = indexed.select(key, F.col(digest).alias("h0"))
    c = current.select(key, F.col(digest).alias("h1"))
    return i.join(c, key, "full_outer").select(key, F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "gone").when(F.col("h0") == F.col("h1"), "same").otherwise("stale").alias("state"))


def check(name: str, failures: DataFrame) -> DataFrame:
    """One row (check, failures, passed)."""
    return failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures", (F.col("failures") == 0).alias("passed"))


def validation_report(files: DataFrame, chunks: DataFrame, vectors: DataFrame, valid: Column) -> DataFrame:
    """Rows of checks: coverage both ways, vectors both ways, duplicates, empty texts, invalid vectors, counts.

    files: file_id, expected; chunks: chunk_id, file_id, text; vectors: chunk_id, and what ``valid`` reads."""
    per_file = chunks.groupBy("file_id").agg(F.count("*").alias("n"))
    checks = {
        "missing_files": files.join(chunks, "file_id", "left_anti"),
        "orphan_chunks": chunks.join(files, "file_id", "left_anti"),
        "chunks_without_vector": chunks.join(vectors, "chunk_id", "left_anti"),
        "vectors_without_chunk": vectors.join(chunks, "chunk_id", "left_anti"),
        "duplicate_chunk_ids": chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1"),
        "empty_texts": chunks.filter(F.trim(F.coalesce("text", F.lit(""))) == ""),
        "invalid_vectors": vectors.filter(~valid),
        "count_mismatch": files.join(per_file, "file_id").filter(F.col("n") != F.col("expected")),
    }
    out = None
    for name, failures in checks.items():
        row = check(name, failures)
        out = row if out is None else out.unionByName(row)
    return out


def retention(generations: DataFrame, routes: DataFrame, now: Column, keep_days: int) -> DataFrame:
    """Generations that may go: retired longer than the period and routed to by no workspace."""
    return generations.filter((F.col("state") == "retired") & (F.col("retired_at") < now - F.expr(f"interval {keep_days} days"))).join(routes.select("generation_id").distinct(), "generation_id", "left_anti")


def soft_delete(files: DataFrame, prefix: str, when: Column) -> DataFrame:
    """Mark a subtree as deleted; rows deleted before keep their time."""
    below = (F.col("uri") == prefix) | F.col("uri").startswith(prefix.rstrip("/") + "/")
    return files.withColumn("deleted_at", F.when(below, F.coalesce("deleted_at", when)).otherwise(F.col("deleted_at")))


def purge(files: DataFrame, prefix: str, watermark: Column) -> DataFrame:
    """What stays after physical deletion up to a watermark: later deletions survive."""
    below = (F.col("uri") == prefix) | F.col("uri").startswith(prefix.rstrip("/") + "/")
    return files.filter(~(below & F.coalesce(F.col("deleted_at") <= watermark, F.lit(False))))


def fair_quotas(pending: DataFrame, total: int) -> DataFrame:
    """(workspace, quota, next_weight): one slot each while they last (highest weight first), the rest in proportion
    to weight, never above what is free or pending; weights that got a slot decay.

    pending: workspace, pending, weight, free — one row a workspace."""
    able = pending.withColumn("cap", F.least("pending", "free")).filter("cap > 0")
    order = Window.orderBy(F.desc("weight"), "workspace")  # one row a workspace
    first = able.withColumn("at", F.row_number().over(order)).withColumn("base", (F.col("at") <= total).cast("long"))
    left = first.agg(F.greatest(F.lit(total) - F.sum("base"), F.lit(0)).alias("rest"), F.sum("weight").alias("weights"))
    q = first.join(F.broadcast(left)).withColumn("quota", F.least("cap", F.col("base") + F.floor(F.col("rest") * F.col("weight") / F.col("weights"))))
    return q.select("workspace", F.col("quota").cast("long").alias("quota"), F.when(F.col("quota") > 0, F.col("weight") * DECAY).otherwise(F.col("weight")).alias("next_weight"))


def recover_timeouts(tasks: DataFrame, now: Column) -> DataFrame:
    """Assigned or started tasks without a heartbeat in time go back to pending."""
    late = F.col("status").isin("assigned", "started") & (F.coalesce("heartbeat_at", F.lit("1970-01-01").cast("timestamp")) < now - F.expr(f"interval {HEARTBEAT_MINUTES} minutes"))
    return tasks.withColumn("retries", F.col("retries") + late.cast("int")).withColumn("status", F.when(late, "pending").otherwise(F.col("status")))


def size_priority(size: Column) -> tuple[Column, Column]:
    queue, priority = F.lit(SLOWEST[0]), F.lit(SLOWEST[1])
    for bound, name, level in reversed(SIZE_CLASSES):
        queue, priority = F.when(size < bound, name).otherwise(queue), F.when(size < bound, level).otherwise(priority)
    return queue, priority


def role_priority(role: Column) -> Column:
    return F.coalesce(*[F.when(role == r, F.lit(p)) for r, (_, p) in ROLES.items()], F.lit(ROLES["member"][1]))
