"""Sharding by histogram sort: near-equal bytes a shard.

Rows are ordered by (hash of the text, hash of the id), so equal texts are neighbours. Splitters
are found by counting: each round sets probes inside the interval that still holds a splitter,
every partition counts the exact bytes and rows between probes, and only these sums (bounded by
splitters x probes) come back. An interval is left once its cut is within tolerance, or once it
has shrunk to one text; a group of equal texts larger than the tolerance is then cut by the id
hash in the same way. A shard of many small rows (null texts, say) is cut again at equal numbers of rows,
so that no task gets more than PART_ROWS and a little. Rows are exchanged once, with the splitters known; the slot of a row is the
exact number of rows below its part plus its place there, so no later count is needed.

Law: bytes. Shards differ by the tolerance (0.2 % of a shard) or one row, whichever is larger;
rows that agree in id and text cannot be told apart and stay together. A null text has 8 bytes. An
input column named like a new one gives way to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, give_way

SHARDS = 24
ROW_BYTES = 8
#: Of a shard's mean size.
TOLERANCE = 0.002
PROBES = 16
#: Rows that one part of a shard should hold at most; a shard is made of whole parts.
PART_ROWS = 2_000_000

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _below(keys: DataFrame, probes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) of the keys below each probe; probes are (k1, k2), sorted."""
    k1 = np.array([p[0] for p in probes], dtype=np.int64)
    k2 = np.array([p[1] for p in probes], dtype=np.int64)

    def count(batches):
        size, rows = np.zeros(len(k1) + 1), np.zeros(len(k1) + 1, dtype=np.int64)
        for pdf in batches:
            at = _place(k1, k2, pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
            size += np.bincount(at, weights=pdf["size"].to_numpy(), minlength=len(size))
            rows += np.bincount(at, minlength=len(rows))
        yield pd.DataFrame({"at": np.arange(len(k1) + 1), "size": size.astype(np.int64), "rows": rows})

    sums = {r["at"]: (r["b"], r["r"]) for r in keys.select("k1", "k2", "size").mapInPandas(count, "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("b"), F.sum("rows").alias("r")).collect()}
    out, total = [], (0, 0)
    for i in range(len(probes)):
        got = sums.get(i, (0, 0))
        total = (total[0] + got[0], total[1] + got[1])
        out.append(total)
    return out


def _place(p1: np.ndarray, p2: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Number of probes at or below each key (so probe i has the keys with place <= i below it)."""
    low, high = np.searchsorted(p1, k1, side="left"), np.searchsorted(p1, k1, side="right")
    at = low.astype(np.int64)
    for i in np.flatnonzero(high > low):
        at[i] = low[i] + np.searchsorted(p2[low[i] : high[i]], k2[i], side="right")
    return at


def splitters(keys: DataFrame, goals: list[tuple[int, float]], tolerance: tuple[float, float], total: int, n_rows: int) -> list[tuple[int, int, int, int]]:
    """A cut (k1, k2, bytes below, rows below) of the keys for each goal (0: bytes, 1: rows; so many below); tolerance: of both."""
    goal = [g for _, g in goals]
    of = [1 + measure for measure, _ in goals]
    # per splitter: lower and upper end as ((k1, k2), bytes, rows)
    state = [[((_LOW, _LOW), 0, 0), ((_HIGH, _HIGH), total, n_rows)] for _ in goal]
    done: list[tuple | None] = [None] * len(goal)
    while None in done:
        probes: set[tuple[int, int]] = set()
        for i, (low, high) in enumerate(state):
            if done[i] is None:
                probes.update(_between(low[0], high[0]))
        ordered = sorted(probes)
        counts = dict(zip(ordered, _below(keys, ordered), strict=True)) if ordered else {}
        for i, (low, high) in enumerate(state):
            if done[i] is not None:
                continue
            for p in (p for p in ordered if low[0] < p < high[0]):
                here = (p, *counts[p])
                if here[of[i]] <= goal[i]:
                    low = here
                else:
                    high = here
                    break
            nearer = min(low, high, key=lambda x: abs(x[of[i]] - goal[i]))
            state[i] = [low, high]
            if abs(nearer[of[i]] - goal[i]) <= tolerance[of[i] - 1] or not _between(low[0], high[0]) or low[2] + 1 >= high[2]:
                done[i] = nearer
    return [(d[0][0], d[0][1], d[1], d[2]) for d in done]


def _between(low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int]]:
    """Evenly set probes strictly between two keys: by k1 while it differs by more than one, else by k2 inside one k1."""
    width = high[0] - low[0]
    if width > 1:
        return sorted({(low[0] + max(1, width * j // (PROBES + 1)), _LOW) for j in range(1, PROBES + 1)} - {low, high})
    if width == 1 and low[1] == _LOW and high[1] == _LOW or width == 0:
        a, b = low[1], high[1] if width == 0 else _HIGH
        return sorted({(low[0], a + (b - a) * j // (PROBES + 1)) for j in range(1, PROBES + 1)} - {low, high} - {(low[0], a)})
    if width == 1 and high[1] > _LOW:  # the interval reaches into the next k1
        return [(high[0], _LOW)]
    return sorted({(low[0], low[1] + (_HIGH - low[1]) * j // (PROBES + 1)) for j in range(1, PROBES + 1)} - {low, high, (low[0], low[1])})


def histogram_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot (gapless from 0 in each shard)."""
    docs = give_way(docs, "size", "text_crc32", "shard", "slot")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumns({"size": (F.octet_length(text) + ROW_BYTES).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.col(id_col))})
    keys = durable(sized.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "size"), "keys")
    total, n_rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tolerance = (TOLERANCE * total / shards, PART_ROWS / 50)
    # cuts between shards, and of each shard the rows below it; then cuts inside shards of many rows
    between = splitters(keys, [(0, total * i / shards) for i in range(1, shards)], tolerance, total, n_rows) if n_rows else []
    below = [0, *(c[3] for c in between)] if n_rows else [0] * shards
    inner: list[tuple[int, float]] = []
    for low, high in zip(below, [*below[1:], n_rows], strict=True):
        pieces = -(-(high - low) // PART_ROWS)
        inner += [(1, low + (high - low) * i / pieces) for i in range(1, pieces)]
    cuts = [(*c, i + 1) for i, c in enumerate(between)]
    for c in splitters(keys, inner, tolerance, total, n_rows) if inner else []:
        if c[:2] not in {k[:2] for k in cuts}:
            cuts.append((*c, sum(b[:2] <= c[:2] for b in between)))
    cuts.sort()
    p1 = np.array([c[0] for c in cuts], dtype=np.int64)
    p2 = np.array([c[1] for c in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(_place(p1, p2, k1.to_numpy(), k2.to_numpy()).astype(np.int32))

    # rows below each part, less the rows below its shard: the first slot of the part
    shard = [0, *(c[4] for c in cuts)]
    first = [rows - below[s] for rows, s in zip([0, *(c[3] for c in cuts)], shard, strict=True)]
    placed = sized.withColumn("_part", part_of("_k1", "_k2"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_k1", "_k2"))
    starts = docs.sparkSession.createDataFrame(pa.table({"_part": pa.array(range(len(shard)), pa.int32()), "_shard": pa.array(shard, pa.int32()), "_start": pa.array(first, pa.int64())}))
    placed = placed.join(F.broadcast(starts), "_part")  # a row a part, of PART_ROWS rows or a shard each
    return placed.withColumn("slot", (inside - 1 + F.col("_start")).cast("long")).withColumn("shard", F.col("_shard")).select(*docs.columns, "size", "text_crc32", "shard", "slot")
