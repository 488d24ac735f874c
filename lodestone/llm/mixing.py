"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in hash order, are cut into blocks of equal bytes. With the exact
rational weight w of a source (weights over their sum, no rounding), its block j has release time
``floor(j / w)`` and deadline ``ceil((j + 1) / w)``; each slot goes to the released block with the
earliest deadline. Sorting by deadline alone would not do: a heavy source would run ahead of
many light ones. The schedule is worked out on the driver over numbers of blocks and is broadcast,
one short row a block; documents only look up their block's row. Its size is bounded: a block has
256 KiB, or more where the mix would have over MAX_BLOCKS of them, plus one a source. A slot whose source has run out is not filled, and positions close up.

Up to the slot where the first source runs out, each source is within one block of its weight at
every moment; then the others keep their proportions. Every document is placed exactly once.
A null source is a source of its own (weights name it None), apart from the empty name. Equal ids
keep a fixed order by text. An input column named like a new one gives way to it.
"""

from __future__ import annotations

import heapq
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, give_way

BLOCK_BYTES = 256 * 1024
#: Blocks of a mix, besides one a source; larger mixes have larger blocks.
MAX_BLOCKS = 200_000
#: Ranges of a source's documents (by hash) are summed on their own, so that a hot source is many tasks: at least
#: SPLITS, and so many that none holds much more than SPLIT_ROWS documents even if one source has them all.
SPLITS, SPLIT_ROWS = 64, 100_000


def _name(source: str | None) -> str:
    """A source as a key of the schedule: null apart from every name."""
    return "" if source is None else f"={source}"


def exact_weights(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Weights as whole numbers in their exact proportions, and the sum of these."""
    if bad := sorted(s for s, w in weights.items() if not w > 0):
        raise ValueError(f"weights must be positive: {bad[:5]}")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: x.numerator * (scale // x.denominator) for s, x in exact.items()}
    return whole, sum(whole.values())


def block_schedule(weights: dict[str, float], n_blocks: dict[str, int]) -> tuple[dict[str, array], int]:
    """Per block in the order of the mix its source (an index into the sorted names), block, release, deadline
    and slot, and the first slot that a source which ran out leaves empty.

    Earliest deadline first among released blocks; after its last block a source has one more, which only
    marks where it runs out."""
    whole, total = exact_weights(weights)
    names = sorted(whole)
    width, counts = [whole[s] for s in names], [n_blocks.get(s, 0) for s in names]
    out = {c: array("q") for c in ("source", "block", "release", "deadline", "slot")}
    waiting = [(0, i, 0) for i in range(len(names))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slot, runs_out = 0, None
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            if j < counts[i] or runs_out is None:
                heapq.heappush(ready, (-(-(j + 1) * total // width[i]), i, j, release))
        if not ready:
            continue
        deadline, i, j, release = heapq.heappop(ready)
        if j < counts[i]:
            for c, x in zip(out.values(), (i, j, release, deadline, slot), strict=True):
                c.append(x)
            heapq.heappush(waiting, ((j + 1) * total // width[i], i, j + 1))
        elif runs_out is None:
            runs_out = slot
        else:
            continue
        slot += 1
    return out, runs_out or 0


def even_tempered_weights(docs: DataFrame, source_col: str = "source", text_col: str = "text", power: float = 0.5) -> dict[str | None, float]:
    """Target weights by temperature: bytes of a source to the given power (a source report: one row a source)."""
    rows = docs.groupBy(F.col(source_col).alias("s")).agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).alias("b")).orderBy("s").collect()
    return {r["s"]: max(1.0, float(r["b"] or 0)) ** power for r in rows}


def pfair_mix(docs: DataFrame, weights: dict[str | None, float], source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with block (of its source), position (of the block in the mix, gapless), release and
    deadline (slots) and on_target (the block stands before the first source runs out).

    Sources without a weight are not allowed; weights without rows take no slots."""
    spark = docs.sparkSession
    docs = give_way(docs, "block", "position", "release", "deadline", "on_target")
    weights = {_name(s): w for s, w in weights.items()}
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    n_rows, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    splits = max(SPLITS, -(-n_rows // SPLIT_ROWS))
    block_bytes = max(block_bytes, -(-n_bytes // MAX_BLOCKS))
    keyed = docs.withColumns({"_s": source, "_size": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "_h": F.xxhash64(F.col(id_col), F.col(text_col))}).withColumn("_split", F.pmod(F.shiftright("_h", 20), F.lit(splits)).cast("int"))
    # bytes before each document in its source: those of earlier splits, and those before it in its own
    sums = keyed.groupBy("_s", "_split").agg(F.sum("_size").alias("_sum"))
    earlier = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # of a source, the last block also takes documents without bytes that follow its last byte
    n_blocks = F.ceil(F.greatest(F.lit(1), F.sum("_sum").over(Window.partitionBy("_s"))) / F.lit(int(block_bytes)))
    earlier = durable(earlier.withColumn("_blocks", n_blocks), "splits")
    counts = {r["_s"]: r["n"] for r in earlier.groupBy("_s").agg(F.max("_blocks").alias("n")).collect()}
    if missing := sorted(set(counts) - set(weights)):
        raise ValueError(f"no weight for sources {[s[1:] or None for s in missing[:5]]}")
    inside = F.coalesce(F.sum("_size").over(Window.partitionBy("_s", "_split").orderBy("_h", id_col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("_in", inside).join(earlier.select("_s", "_split", "_base", "_blocks"), ["_s", "_split"])
    placed = placed.withColumn("block", F.least(F.expr(f"(_base + _in) div {int(block_bytes)}"), F.col("_blocks") - 1))
    plan, runs_out = block_schedule(weights, counts)
    index, n = pa.array(plan["source"], pa.int64()), len(plan["source"])
    columns = {
        "_s": pa.array(sorted(weights), pa.string()).take(index),
        "block": pa.array(plan["block"], pa.int64()),
        "position": pa.array(range(n), pa.int64()),
        "release": pa.array(plan["release"], pa.int64()),
        "deadline": pa.array(plan["deadline"], pa.int64()),
        "on_target": pa.array([t < runs_out for t in plan["slot"]], pa.bool_()),
    }
    table = F.broadcast(spark.createDataFrame(pa.table(columns)))  # a row a block
    out = placed.join(table, ["_s", "block"])
    return out.select(*docs.columns, "block", "position", "release", "deadline", "on_target")
