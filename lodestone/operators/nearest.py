"""Exact nearest vectors of a stated set of queries, as products of blocks.

Rows stay in Spark's partitions; each task is given a block of queries with its first row and multiplies batches of vectors with
it in single precision. What lies within the rounding of these products of the k-th best is scored again as
:func:`lodestone.functions.values.cosine` scores it, so that the results are those of all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sides of one product, and pairs that are scored again at once.
VECTORS_AT_ONCE, QUERIES_AT_ONCE, PAIRS_AT_ONCE = 2048, 1024, 1 << 16


class Vectors:
    """A list column as rows of one width: sizes, lengths, unit vectors, and the rows that only exact scores can judge."""

    def __init__(self, lists: pa.Array):
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        self.missing = lists.is_null().to_numpy(zero_copy_only=False)
        self.sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        inside = np.arange(self.sizes.max(initial=0)) < self.sizes[:, None]
        self.values = np.zeros(inside.shape)
        self.values[inside] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
        gaps = np.zeros(inside.shape, bool)
        gaps[inside] = flat.is_null().to_numpy(zero_copy_only=False)
        self.gaps = gaps.any(axis=1)
        with np.errstate(all="ignore"):
            self.lengths = np.sqrt(_dots(self.values, self.values))
            usual = np.isfinite(self.lengths) & (self.lengths > 1e-140) & (self.lengths < 1e140)
            self.odd = ~self.missing & (self.gaps | ~usual & (self.lengths != 0))
            self.unit = np.where((usual & ~self.odd)[:, None], self.values / self.lengths[:, None], 0.0).astype(np.float32)

    def at(self, rows: np.ndarray) -> Vectors:
        part = object.__new__(Vectors)
        for name, x in vars(self).items():
            setattr(part, name, x[rows])
        return part

    def widened(self, width: int) -> np.ndarray:
        return self.unit if self.unit.shape[1] == width else np.pad(self.unit, ((0, 0), (0, width - self.unit.shape[1])))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first dimension on."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total = total + a[:, d] * b[:, d]
    return total


def cosines(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, nulls) of the pairs (i, j), as the column function gives them."""
    width = min(a.values.shape[1], b.values.shape[1])
    with np.errstate(all="ignore"):
        lengths = a.lengths[i] * b.lengths[j]
        differ = a.sizes[i] != b.sizes[j]
        gaps = a.gaps[i] | b.gaps[j]
        scores = np.where(differ | (lengths == 0) & ~gaps, 0.0, _dots(a.values[i, :width], b.values[j, :width]) / lengths)
    return scores, a.missing[i] | b.missing[j] | gaps & ~differ


def _numbers(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, equal for equal ones."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)


class _Best:
    """The k best rows of each query so far (all from a threshold on, if k is None)."""

    def __init__(self, queries: Vectors, k: int | None, least: float | None):
        self.queries, self.k, self.least = queries, k, least
        self.bound = np.full(len(queries.sizes), -np.inf if least is None else least)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, asked: np.ndarray, rows: Vectors, ids: pa.Array) -> None:
        """The queries numbered ``asked`` with vectors and their ids."""
        if self.k is not None and len(ids) > self.k:  # of equal vectors the k smallest ids are enough
            order = np.argsort(_numbers(ids), kind="stable")
            keys = np.concatenate([rows.values, rows.sizes[:, None], rows.missing[:, None], rows.gaps[:, None]], axis=1)[order]
            _, same = np.unique(np.ascontiguousarray(keys).view(np.dtype((np.void, keys.shape[1] * 8))).ravel(), return_inverse=True)
            grouped = np.argsort(same, kind="stable")
            kept = np.sort(order[grouped[_places(same[grouped]) < self.k]])
            if len(kept) < len(ids):
                rows, ids = rows.at(kept), ids.take(pa.array(kept))
        width = max(rows.unit.shape[1], self.queries.unit.shape[1])
        near = (width + 16) * 2.5e-7  # more than twice what single precision may be off
        units, uneven = rows.widened(width), self.queries.sizes.min() != rows.sizes.max(initial=0) or rows.sizes.min(initial=0) != self.queries.sizes.max()
        for v in range(0, len(ids), VECTORS_AT_ONCE):
            some = slice(v, v + VECTORS_AT_ONCE)
            for c in range(0, len(asked), QUERIES_AT_ONCE):
                q = asked[c : c + QUERIES_AT_ONCE]
                product = self.queries.at(q).widened(width) @ units[some].T
                if uneven:
                    product[self.queries.sizes[q][:, None] != rows.sizes[some]] = 0
                product[self.queries.missing[q]] = -np.inf
                product[:, rows.missing[some] | rows.odd[some]] = -np.inf
                bound = (self.bound[q] - near).astype(np.float32)
                if self.k is not None and self.k < product.shape[1]:
                    many = np.flatnonzero(np.count_nonzero(product >= bound[:, None], axis=1) > 2 * self.k)
                    if len(many):
                        kth = np.partition(product[many], -self.k, axis=1)[:, -self.k]
                        bound[many] = np.maximum(bound[many], kth - np.float32(near))
                product[:, rows.odd[some]] = np.inf
                bound[self.queries.odd[q]] = -np.inf
                i, j = np.nonzero(product >= bound[:, None])
                for at in range(0, len(i), PAIRS_AT_ONCE):
                    self._take(q[i[at : at + PAIRS_AT_ONCE]], j[at : at + PAIRS_AT_ONCE] + v, rows, ids)

    def _take(self, i: np.ndarray, j: np.ndarray, rows: Vectors, ids: pa.Array) -> None:
        scores, nulls = cosines(self.queries, i, rows, j)
        if self.least is not None:
            good = ~nulls & ((scores >= self.least) | np.isnan(scores))
            i, j, scores, nulls = i[good], j[good], scores[good], nulls[good]
        self.parts.append((i, ids.take(pa.array(j)), scores, nulls))
        self.waiting += len(i)
        if self.k is not None and self.waiting > max(PAIRS_AT_ONCE, 2 * self.k * len(self.bound)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """What is kept: (query numbers, ids, scores, nulls)."""
        i, scores, nulls = (np.concatenate([p[n] for p in self.parts]) for n in (0, 2, 3))
        ids = pa.concat_arrays([p[1] for p in self.parts])
        if self.k is not None:
            key = np.where(nulls, -np.inf, np.where(np.isnan(scores), np.inf, scores))
            order = np.lexsort((_numbers(ids), -key, i))
            place = _places(i[order])
            order, place = order[place < self.k], place[place < self.k]
            last = order[place == self.k - 1]
            self.bound[i[last]] = np.maximum(self.bound[i[last]], key[last])
            i, scores, nulls, ids = i[order], scores[order], nulls[order], ids.take(pa.array(order))
        self.parts, self.waiting = [(i, ids, scores, nulls)], 0
        return self.parts[0]


def _places(groups: np.ndarray) -> np.ndarray:
    """Places, from 0, in runs of equal numbers."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, int)
    return np.arange(len(groups)) - np.repeat(starts, np.diff(np.r_[starts, len(groups)]))


def near_vectors(rows: DataFrame, queries: DataFrame, k: int | None, at_once: int, least: float | None = None, group: str | None = None) -> DataFrame:
    """(query_id, [group,] vec_id, score): of each task and row of ``queries`` the ``k`` best by cosine and id (all with k None), from
    ``least`` on: the top k of all are among them. With ``group``, rows and queries meet where this column is equal.

    rows: vec_id, embedding, [group]; queries: query_id, q, [group], a stated set, of which about ``at_once`` are broadcast at once.
    The rows are dealt out to all cores, as each costs the work of all queries."""
    kinds = dict(rows.dtypes) | dict(queries.dtypes)
    columns = ["query_id", *([group] if group else []), "vec_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = asked = numbers = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if best is None:
                asked = batch.column("asked").slice(0, 1).flatten()
                if not len(asked):
                    return
                best = _Best(Vectors(asked.field("q")), k, least)
                if group:
                    numbers = {}
                    for n, g in enumerate(asked.field(group).to_pylist()):
                        numbers.setdefault(g, []).append(n)
            ids, lists = batch.column("vec_id"), batch.column("embedding")
            if not group:
                best.meet(np.arange(len(asked)), Vectors(lists), ids)
            else:
                found = pc.dictionary_encode(batch.column(group))
                codes = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                cuts = np.searchsorted(codes[order], np.arange(len(found.dictionary) + 1))
                for code, g in enumerate(found.dictionary.to_pylist()):
                    if g in numbers:
                        at = pa.array(order[cuts[code] : cuts[code + 1]])
                        best.meet(np.array(numbers[g]), Vectors(lists.take(at)), ids.take(at))
            if k is None and best.parts:
                yield result(best, asked)
                best.parts, best.waiting = [], 0
        if best is not None and best.parts:
            yield result(best, asked)

    def result(best: _Best, asked: pa.Array) -> pa.RecordBatch:
        i, ids, scores, nulls = best.settle()
        keys = [asked.field(c).take(pa.array(i)) for c in columns[:-1]]
        return pa.RecordBatch.from_arrays([*keys, ids, pa.array(scores, pa.float64(), mask=nulls)], names=[*columns, "score"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double"
    parts = max(1, -(-queries.count() // at_once))
    block = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    dealt = rows.select("vec_id", "embedding", *([group] if group else [])).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of a partition: it brings the queries along

    def meet(some: DataFrame) -> DataFrame:
        one = some.agg(F.collect_list(F.struct("query_id", "q", *([group] if group else []))).alias("_asked"))
        joined = dealt.withColumn("_first", first).join(F.broadcast(one))  # one row of a block of queries
        return joined.select(*dealt.columns, F.when(F.col("_first"), F.col("_asked")).alias("asked")).mapInArrow(task, schema)

    return reduce(DataFrame.unionByName, (meet(queries if parts == 1 else queries.filter(block == n)) for n in range(parts)))
