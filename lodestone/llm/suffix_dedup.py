"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

A byte goes when a string of ``threshold`` bytes that also starts anywhere else covers it. Ranking
the suffixes at every byte would shuffle the corpus many times; the doubling runs over *anchors*,
positions that their own bytes choose (minimisers: each window of grams has its smallest gram as
anchor), so that equal strings have equal anchors inside. The bytes from an anchor to the end of
the next one's gram are a phrase. Any string of the threshold's length holds ``base`` whole phrases.

1. *First ranks.* A suffix that starts at an anchor is ranked by its first ``base`` phrases.
   Suffixes whose rank is unique drop out.
2. *Doubling.* In round r Spark sorts the pairs (rank of a suffix, rank of the one ``base * 2**r``
   phrases later, where the first rank ends) by a sort-merge join with the pairs that occur twice
   or more; a pair is the suffix's next rank, unique ones drop out. A suffix whose next rank would reach past the
   threshold stops. Rounds go on until no pair is left. Ranks only need to tell equal from
   different, so the name of a pair (128 bits) is its rank.
3. *Threshold.* A string that starts at byte p lies inside a sequence of phrases around it; two
   overlapping ranks of the same length cover that sequence. Where such a pair occurs twice, every
   string inside is repeated. Of other starts, the sequence of phrases inside the string (again two
   overlapping ranks) must occur twice; these lie near the ends of repeats, and are compared by
   names of all their bytes, together with one occurrence of each repeated pair around.

Strings never cross documents. Names have 90 bits or more, of polynomials modulo a prime with bases of their
own, so that no pattern of bytes makes two strings alike. A text is known by two hashes of 64 bits, so
that equal texts are ranked as one; all strings of a text that stands in two rows or more are
repeated, whatever the ids. A key that a task meets twice is settled there and then, and only one
of it is sent on, so a passage in a third of all documents makes no large bucket.

A null text counts as empty; texts under the threshold are kept whole; an empty table gives none.
An input column named like a column that ``cut_spans`` adds gives way to it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, bound_batches, drop_durable, durable, give_back, give_way, gram_hashes, mix, span_hashes, text_slices
from .exchange import BLOB_SCHEMA, Packer, bucket_bits, reduce_buckets

#: Bytes of a repeated string.
THRESHOLD = 400
GRAM = 16
#: Windows of grams are at most so wide; a threshold must hold three windows and a gram.
WINDOW = 72


@dataclass(frozen=True)
class Shape:
    """A threshold, and what follows from the least threshold of a run: the window, and the phrases of a first rank."""

    threshold: int
    least: int

    def __post_init__(self):
        if self.least < 64:
            raise ValueError("a repeated string must have 64 bytes at least")

    @property
    def base(self) -> int:
        return 4 if self.least >= 5 * WINDOW + GRAM - 1 else 2

    @property
    def window(self) -> int:
        # a string's first and last window differ by so much that base phrases lie between their anchors
        return min(WINDOW, (self.least - GRAM + 1) // (self.base + 1))

    @property
    def far(self) -> int:
        """No sequence of phrases around a string is longer."""
        return self.threshold + 2 * self.window + GRAM


_FIRST = [("pos", np.uint32), ("gap", np.uint8), ("low", np.uint8), ("low_next", np.uint8), ("last", np.uint8), ("last_gap", np.uint8), ("end_low", np.uint8), ("end_next", np.uint8), ("r2", np.uint32)]
_SPAN = "array<struct<start:int,stop:int>>"
_KEY = ["k1", "k2"]


def _minimisers(data: np.ndarray, window: int) -> np.ndarray:
    """For every window of grams the position of its smallest gram (of equal ones the last)."""
    n = len(data) + 1 - GRAM
    if n < window:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(n, dtype=np.int64)
    place = (1 << int(n).bit_length()) - 1
    low = gram_hashes(data, GRAM) & np.uint64(~place & 0xFFFFFFFFFFFFFFFF) | (place - at).astype(np.uint64)
    width = 1
    while width * 2 <= window:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    return place - (low & np.uint64(place)).astype(np.int64)


def _first_ranks(data: np.ndarray, offsets: np.ndarray, shape: Shape):
    """Suffixes with a first rank: (row, name, and the item columns of _FIRST).

    The items: the position; the gap to the next; how far
    before it the first window starts whose minimum it is; how far before it (plus 1) that of the
    next anchor; the distance to the last phrase of the rank, and that phrase's gap; of the anchor
    where the rank ends, the same two distances of windows; a second name."""
    least = _minimisers(data, shape.window)
    # a window lies inside one text if it starts at most `last` there
    last = np.minimum(offsets[1:] - (shape.window + GRAM - 1), len(least) - 1)
    opens = np.zeros(len(least) + 1, dtype=np.int64)
    held = last >= offsets[:-1]
    np.add.at(opens, offsets[:-1][held], 1)
    np.add.at(opens, last[held] + 1, -1)
    windows = np.flatnonzero(np.cumsum(opens[:-1]) > 0)
    row = np.searchsorted(offsets, windows, side="right") - 1
    at = least[windows]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    low, at, row = windows[new], at[new], row[new]
    b = shape.base
    if len(at) <= b:
        return row[:0], row[:0].astype(np.uint64), [row[:0]] * len(_FIRST)
    final = np.ones(len(at), dtype=bool)
    final[:-1] = row[1:] != row[:-1]
    next_low = np.where(final, last[row] + 1, np.roll(low, -1))
    k = np.flatnonzero(row[b:] == row[:-b])
    end = at[k + b] + GRAM
    names = span_hashes(data, at[k], end)
    second = span_hashes(data, at[k], end, second=True) >> np.uint64(32)
    items = [(at - offsets[row])[k], (at[1:] - at[:-1])[k], (at - low)[k], (at + 1 - next_low)[k], at[k + b - 1] - at[k], at[k + b] - at[k + b - 1], at[k + b] - low[k + b], at[k + b] + 1 - next_low[k + b], second]
    return row[k], names, items


def _pieces(data: np.ndarray, offsets: np.ndarray, shape: Shape, size: int):
    """:func:`_first_ranks`, of one long text piece by piece: a suffix's items depend on the bytes near its anchor only."""
    if len(offsets) > 2 or len(data) <= size:
        yield _first_ranks(data, offsets, shape)
        return
    reach = (shape.base + 3) * (shape.window + GRAM)
    for core in range(0, len(data), size):
        low, high = max(0, core - reach), min(len(data), core + size + reach)
        row, names, items = _first_ranks(data[low:high], np.array([0, high - low]), shape)
        pos = items[0] + low
        keep = (pos >= core) & (pos < core + size)
        yield row[keep], names[keep], [pos[keep], *(x[keep] for x in items[1:])]


def text_key(text_col: str) -> list[Column]:
    """The 128 bits that a text is known by."""
    return [F.xxhash64(F.col(text_col)).alias("k1"), F.xxhash64(F.col(text_col), F.lit(1)).alias("k2")]


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    return bound_batches(docs).select(*text_key(text_col), F.col(text_col).alias("text"))


def _repeated(rank: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Mask of the (rank, check) that occur twice or more."""
    order = np.lexsort((check, rank))
    equal = (rank[order][1:] == rank[order][:-1]) & (check[order][1:] == check[order][:-1])
    same = np.zeros(len(rank), dtype=bool)
    same[1:] |= equal
    same[:-1] |= equal
    out = np.zeros(len(rank), dtype=bool)
    out[order] = same
    return out


def _settled(rank: np.ndarray, check: np.ndarray, repeated: np.ndarray, prefer: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The mask itself, and of its items the first of each (rank, check), a preferred one if there is any."""
    k = np.flatnonzero(repeated)
    last = np.zeros(len(k)) if prefer is None else -prefer[k].astype(np.int64)
    k = k[np.lexsort((last, check[k], rank[k]))]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (rank[k][1:] != rank[k][:-1]) | (check[k][1:] != check[k][:-1])
    sent = np.zeros(len(rank), dtype=bool)
    sent[k[new]] = True
    return repeated, sent


def _ranked(texts: DataFrame, n_bytes: int, shape: Shape) -> DataFrame:
    """Per text with repeated first ranks: its key, n (bytes), suffixes (struct array by position), and
    copies: it stands in two rows or more, so that each of its suffixes came more than once."""
    types, owners = [t for _, t in _FIRST], [np.int64, np.int64, np.uint32]
    bits = bucket_bits(2 * n_bytes // shape.window)

    def task(batches):
        own = Packer(bits, owners, types, key_bytes=7, settle=lambda keys, items, _: _settled(keys, items[-1], _repeated(keys, items[-1])))
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, end, data, offsets in text_slices(batch, "text"):
                for row, names, items in _pieces(data, offsets, shape, PIECE_BYTES):
                    if len(row):
                        own.add(names, row, items, [k1[first:end], k2[first:end], np.diff(offsets)])
                    yield from own.flush()
        yield from own.flush(force=True)

    def reducer(blobs: pd.DataFrame) -> pd.DataFrame:
        rank, (k1, k2, n), items, settled, sent = Packer(bits, owners, types, key_bytes=7).open(blobs)
        keep = settled | (~sent & _repeated(rank, items[-1]))
        names = [c for c, _ in _FIRST]
        return pd.DataFrame({"k1": k1[keep], "k2": k2[keep], "n": n[keep].astype(np.int64), "r1": rank[keep]} | {c: x[keep].astype(np.int64 if c == "r2" else np.int32) for c, x in zip(names, items, strict=True)})

    columns = ", ".join(f"{c} {'long' if c == 'r2' else 'int'}" for c, _ in _FIRST)
    rows = reduce_buckets(texts.mapInArrow(task, BLOB_SCHEMA), reducer, "k1 long, k2 long, n long, r1 long, " + columns)
    suffixes = F.collect_set(F.struct(*(c for c, _ in _FIRST[:-1]), "r1", "r2"))
    return rows.groupBy("k1", "k2", "n").agg(F.sort_array(suffixes).alias("suffixes"), (F.count("*") > F.size(suffixes)).alias("copies"))


_GAP = 1 << 34


def _flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An array-of-struct column as row numbers and one flat numpy array a field."""
    lists = batch.column(batch.schema.get_field_index(column))
    values = lists.flatten()
    fields = values.flatten()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    return rows, {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(values.type, fields, strict=True)}


def _names(a1, a2, b1, b2, apart) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of pairs of ranks that start ``apart`` from each other."""
    a1, a2, b1, b2, apart = (np.asarray(x).astype(np.int64).view(np.uint64) for x in (a1, a2, b1, b2, apart))
    first = mix(mix(a1) + mix(b1 ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3) + apart)
    second = mix(mix(a2 ^ np.uint64(0x2545F4914F6CDD1D)) * np.uint64(5) + mix(b2 + np.uint64(0x9E3779B97F4A7C15)) + mix(a1 + np.uint64(1)) * apart + mix(b1 + np.uint64(7)))
    return first, second


def _doubled(state: DataFrame, most: int) -> DataFrame:
    """One round: per text (k1, k2, next), the suffixes whose pair of ranks, its own and that of the suffix where its
    rank ends, is repeated.

    state: k1, k2, now (struct array pos, end, r1, r2, by pos; end is the anchor where the rank ends)."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("end", pa.int32()), ("r1", pa.int64()), ("r2", pa.int64()), ("known", pa.bool_())])

    def pairs(batches):
        for batch in batches:
            rows, x = _flat(batch, "now")
            place, goal = rows * _GAP + x["pos"], rows * _GAP + x["end"]
            other = np.searchsorted(place, goal)
            other[other == len(place)] = 0
            k = np.flatnonzero(place[other] == goal) if len(place) else np.zeros(0, dtype=np.int64)
            o = other[k]
            near = x["end"][o].astype(np.int64) + GRAM - x["pos"][k] <= most
            k, o = k[near], o[near]
            r1, r2 = _names(x["r1"][k], x["r2"][k], x["r1"][o], x["r2"][o], x["pos"][o] - x["pos"][k])
            k1, k2 = (batch.column(c).to_numpy()[rows[k]] for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1, k2, x["pos"][k], x["end"][o], r1.view(np.int64), r2.view(np.int64), _repeated(r1, r2))], schema=schema)
        give_back()

    ranks = state.select("k1", "k2", "now").mapInArrow(pairs, "k1 long, k2 long, pos int, end int, r1 long, r2 long, known boolean")
    again = ranks.groupBy("r1", "r2").agg(F.count("*").alias("times")).filter("times > 1").select("r1", "r2")
    # a pair that a batch meets twice is repeated: those rows need no sorting, and a hot pair makes no hot task
    kept = ranks.filter("known").unionByName(ranks.filter("not known").join(again.hint("merge"), ["r1", "r2"], "left_semi"))
    return kept.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("pos", "end", "r1", "r2"))).alias("next"))


def _levels(ranked: DataFrame, shape: Shape) -> tuple[DataFrame, int]:
    """``ranked`` with ``levels`` (struct array level, pos, end, r1, r2), the ranks of all rounds, and the number of rounds."""
    first = F.expr("transform(suffixes, x -> struct(x.pos as pos, x.pos + x.last + x.last_gap as end, x.r1 as r1, x.r2 as r2))")
    state, found = ranked.select(*_KEY, first.alias("now")), []
    while True:
        table = durable(_doubled(state, shape.far), "ranks")
        if table.isEmpty():
            drop_durable(table)
            break
        found.append(table)
        state = table.withColumnRenamed("next", "now")
    every = [t.select(*_KEY, F.expr(f"transform(next, x -> struct({r} as level, x.pos as pos, x.end as end, x.r1 as r1, x.r2 as r2))").alias("ranks")) for r, t in enumerate(found, 1)]
    out = ranked.withColumn("levels", F.expr("cast(null as array<struct<level:int,pos:int,end:int,r1:bigint,r2:bigint>>)"))
    if every:
        every = functools.reduce(DataFrame.unionByName, every).groupBy(*_KEY).agg(F.flatten(F.collect_list("ranks")).alias("levels"))
        out = ranked.join(every, _KEY, "left")
    out = durable(out, "levels")
    for table in found:
        drop_durable(table)
    return out, len(found)


def _overlay(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
    """Common parts of two sorted families of disjoint half-open intervals: starts, stops, index in a, index in b."""
    cuts = np.unique(np.concatenate([*a, *b]))
    starts, stops, index, good = cuts[:-1], cuts[1:], [], np.ones(max(0, len(cuts) - 1), dtype=bool)
    for s, e in (a, b):
        i = np.searchsorted(s, starts, side="right") - 1
        good &= (i >= 0) & (e[np.maximum(i, 0)] > starts) if len(s) else False
        index.append(i)
    return starts[good], stops[good], index[0][good], index[1][good]


def _proper(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.flatnonzero(stop > start)
    return start[k], stop[k], k


class _Suffixes:
    """The ranked suffixes of a batch of texts, flat, with their ranks at all levels (starts, ends, two names)."""

    def __init__(self, batch: pa.RecordBatch, n_levels: int):
        self.rows, self.x = _flat(batch, "suffixes")
        self.n = batch.column(batch.schema.get_field_index("n")).to_numpy()
        self.place = self.rows * _GAP + self.x["pos"]
        self.end = self.place + self.x["last"] + self.x["last_gap"]
        self.ranks = [(self.place, self.end, self.x["r1"], self.x["r2"])]
        rows, x = _flat(batch, "levels")
        for r in range(1, n_levels + 1):
            k = np.flatnonzero(x["level"] == r)
            place = rows[k] * _GAP + x["pos"][k]
            order = np.argsort(place, kind="stable")
            k = k[order]
            self.ranks.append((place[order], rows[k] * _GAP + x["end"][k], x["r1"][k], x["r2"][k]))

    def starts(self, side: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix the starts p of strings of which it is, around the string (out), the one that begins at
        the last anchor at or before p, and the one whose first rank ends at the first anchor whose gram reaches the
        string's end; or inside the string (in), the one that begins at the minimum of p's own window, and the one
        whose first rank ends at the minimum of the string's last window. The inner ones depend on the string only."""
        x, t, w = {c: v.astype(np.int64) for c, v in self.x.items() if c not in ("r1", "r2")}, shape.threshold, shape.window
        base, pos = self.rows * _GAP, x["pos"]
        most = np.maximum(self.n[self.rows] - t + 1, 0)
        last, end, reach, inner = pos + x["last"], pos + x["last"] + x["last_gap"], t - GRAM, t - (w + GRAM - 1)
        a, b = {
            "left_out": (pos, pos + x["gap"]),
            "right_out": (last - reach + 1, end - reach + 1),
            "left_in": (pos - x["low"], pos + 1 - x["low_next"]),
            "right_in": (end - x["end_low"] - inner, end + 1 - x["end_next"] - inner),
        }[side]
        return base + np.clip(a, 0, most), base + np.clip(b, 0, most)

    def sequences(self, left: str, right: str, shape: Shape):
        """Starts, stops, the first suffix, and two names of the sequence of phrases from it on, for sequences that
        two overlapping ranks cover."""
        (ls, le, lk), (rs, re, rk) = (_proper(*self.starts(side, shape)) for side in (left, right))
        starts, stops, i, j = _overlay((ls, le), (rs, re))
        i, j = lk[i], rk[j]
        left, right = self.place[i], self.end[j]
        apart = right - left
        first, second = np.zeros(len(i), dtype=np.uint64), np.zeros(len(i), dtype=np.uint64)
        open_ = apart > 0
        for r, (place, end, r1, r2) in reversed(list(enumerate(self.ranks))):
            k = np.flatnonzero(open_)
            if not len(k) or not len(place):
                continue
            u, v = np.minimum(np.searchsorted(place, left[k]), len(place) - 1), np.minimum(np.searchsorted(end, right[k]), len(end) - 1)
            # the longest rank inside the sequence from its start on, and the one of that length up to its end
            fits = (place[u] == left[k]) & (end[u] <= right[k])
            open_[k[fits]] = False
            whole = fits & (end[v] == right[k]) & (place[v] >= left[k]) & (place[v] <= end[u])
            k, u, v = k[whole], u[whole], v[whole]
            first[k], second[k] = _names(r1[u], r2[u], r1[v], r2[v], apart[k] + (r << 40))
        known = first != 0
        return starts[known], stops[known], i[known], first[known], second[known]


def _apart(names: np.ndarray, which: int) -> np.ndarray:
    """Keys of the names that are not alike for two thresholds."""
    return names + np.uint64(which) * np.uint64(0x9E3779B97F4A7C15)


def _listed(rows: DataFrame, n_shapes: int, name: str, *columns: str) -> DataFrame:
    """(k1, k2, name_0, ...): per text the columns of the rows of each threshold (number ``which``), sorted."""
    return rows.groupBy(*_KEY).agg(*(F.sort_array(F.collect_set(F.when(F.col("which") == c, F.struct(*columns)))).alias(f"{name}_{c}") for c in range(n_shapes)))


def _sure_starts(levels: DataFrame, n_levels: int, n_keys: int, shapes: list[Shape]) -> DataFrame:
    """(k1, k2, which, start, stop, lead): starts of strings that lie in a sequence of phrases found twice or more;
    lead marks one occurrence of each sequence at least. All thresholds share one pass over the ranks."""
    bits, owners, types = bucket_bits(n_keys * len(shapes)), [np.int64, np.int64], [np.uint32, np.uint8, np.uint8, np.uint8, np.uint8, np.uint32]

    def lead(rank, check, shift, length):
        # one occurrence of each sequence and of each part of it that its surroundings leave
        columns = (rank, check, shift, length)
        order = np.lexsort(columns[::-1])
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
        out = np.zeros(len(rank), dtype=bool)
        out[order[new]] = True
        return out

    def settle(keys, items, _):
        start, length, shift, _, _, check = items
        items[3][lead(keys, check, shift, length)] = 1
        return _settled(keys, check, _repeated(keys, check))

    def task(batches):
        own = Packer(bits, owners, types, key_bytes=7, settle=settle)
        for batch in batches:
            s, keys = _Suffixes(batch, n_levels), [batch.column(c).to_numpy() for c in (0, 1)]
            for c, shape in enumerate(shapes):
                starts, stops, i, first, second = s.sequences("left_out", "right_out", shape)
                own.add(_apart(first, c), starts // _GAP, [starts % _GAP, stops - starts, starts % _GAP - s.x["pos"][i], np.zeros(len(starts)), np.full(len(starts), c), second >> np.uint64(32)], keys)
                yield from own.flush()
        yield from own.flush(force=True)

    def reducer(blobs: pd.DataFrame) -> pd.DataFrame:
        rank, (k1, k2), (start, length, shift, first, which, check), settled, sent = Packer(bits, owners, types, key_bytes=7).open(blobs)
        keep = settled | (~sent & _repeated(rank, check))
        leads = np.where(settled, first > 0, lead(rank, check, shift, length))
        return pd.DataFrame({"k1": k1[keep], "k2": k2[keep], "which": which[keep].astype(np.int32), "start": start[keep].astype(np.int32), "stop": (start[keep] + length[keep]).astype(np.int32), "lead": leads[keep]})

    return reduce_buckets(levels.mapInArrow(task, BLOB_SCHEMA), reducer, "k1 long, k2 long, which int, start int, stop int, lead boolean")


def _open_starts(ranked: DataFrame, n_levels: int, n_keys: int, shapes: list[Shape]) -> DataFrame:
    """(k1, k2, which, start, stop, open): starts to compare byte by byte, open ones and what may equal them.
    ranked: levels with sure_0, ... (the sure starts by threshold)."""
    bits, owners, types = bucket_bits(n_keys * len(shapes)), [np.int64, np.int64], [np.uint32, np.uint8, np.uint8, np.uint8, np.uint32]

    def alike(rank, check, is_open) -> np.ndarray:
        order = np.lexsort((check, rank))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (check[order][1:] != check[order][:-1])
        group = np.zeros(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        return (np.bincount(group)[group] > 1) & (np.bincount(group, weights=is_open)[group] > 0)

    def task(batches):
        own = Packer(bits, owners, types, key_bytes=7, settle=lambda keys, items, _: _settled(keys, items[4], alike(keys, items[4], items[2]), items[2]))
        for batch in batches:
            suffixes, keys = _Suffixes(batch, n_levels), [batch.column(c).to_numpy() for c in (0, 1)]
            for c, shape in enumerate(shapes):
                starts, stops, _, first, second = suffixes.sequences("left_in", "right_in", shape)
                sure_rows, s = _flat(batch, f"sure_{c}")
                ss, se = sure_rows * _GAP + s["start"], sure_rows * _GAP + s["stop"]
                lead = s["lead"].astype(bool) if len(sure_rows) else np.zeros(0, dtype=bool)
                # the gaps between sure starts, over all rows at once
                gs, ge, _ = _proper(np.append(0, se), np.append(ss, len(batch) * _GAP))
                for family, is_open in (((ss[lead], se[lead]), 0), ((gs, ge), 1)):
                    a, b, k, _ = _overlay((starts, stops), family)
                    own.add(_apart(first[k], c), a // _GAP, [a % _GAP, b - a, np.full(len(a), is_open), np.full(len(a), c), second[k] >> np.uint64(32)], keys)
                yield from own.flush()
        yield from own.flush(force=True)

    def reducer(blobs: pd.DataFrame) -> pd.DataFrame:
        rank, (k1, k2), (start, length, is_open, which, check), settled, sent = Packer(bits, owners, types, key_bytes=7).open(blobs)
        keep = settled | ~sent & alike(rank, check, is_open)
        return pd.DataFrame({"k1": k1[keep], "k2": k2[keep], "which": which[keep].astype(np.int32), "start": start[keep].astype(np.int32), "stop": (start[keep] + length[keep]).astype(np.int32), "open": is_open[keep] > 0})

    return reduce_buckets(ranked.mapInArrow(task, BLOB_SCHEMA), reducer, "k1 long, k2 long, which int, start int, stop int, open boolean")


def _union(rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge intervals of each row that touch: rows, starts, stops."""
    a, b = rows * _GAP + start, rows * _GAP + stop
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] > b[:-1]
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(a)) - 1 if len(a) else firsts
    return a[firsts] // _GAP, a[firsts] % _GAP, b[lasts] - (a[firsts] // _GAP) * _GAP


def _span_lists(n_rows: int, rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n_rows + 1)).astype(np.int32)), spans)


def _exact_starts(texts: DataFrame, n_keys: int, shapes: list[Shape]) -> DataFrame:
    """(k1, k2, starts_0, ...) of open starts whose string occurs at a second place, by threshold.
    texts: k1, k2, text, checks_0, ... (one row a text)."""
    bits, owners, types = bucket_bits(n_keys), [np.int64, np.int64], [np.uint32, np.uint8, np.uint8, np.uint32]

    def task(batches):
        own = Packer(bits, owners, types, key_bytes=7, settle=lambda keys, items, _: _settled(keys, items[3], _repeated(keys, items[3])))
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat = [_flat(batch, f"checks_{c}") for c in range(len(shapes))]
            for first, end, data, offsets in text_slices(batch, "text"):
                for c, ((rows, x), shape) in enumerate(zip(flat, shapes, strict=True)):
                    a, b = np.searchsorted(rows, [first, end])
                    start, length, row = x["start"][a:b].astype(np.int64), (x["stop"][a:b] - x["start"][a:b]).astype(np.int64), rows[a:b] - first
                    place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
                    row = np.repeat(row, length)
                    if len(place):
                        at = place + offsets[row]
                        check = span_hashes(data, at, at + shape.threshold, second=True) >> np.uint64(32)
                        own.add(span_hashes(data, at, at + shape.threshold), row, [place, np.repeat(x["open"][a:b].astype(np.uint8), length), np.full(len(place), c), check], [k1[first:end], k2[first:end]])
                yield from own.flush()
        yield from own.flush(force=True)

    def reducer(blobs: pd.DataFrame) -> pd.DataFrame:
        rank, (k1, k2), (start, is_open, which, check), settled, sent = Packer(bits, owners, types, key_bytes=7).open(blobs)
        keep = (settled | ~sent & _repeated(rank, check)) & (is_open > 0)
        return pd.DataFrame({"k1": k1[keep], "k2": k2[keep], "start": start[keep].astype(np.int32), "which": which[keep].astype(np.int32)})

    found = reduce_buckets(texts.mapInArrow(task, BLOB_SCHEMA), reducer, "k1 long, k2 long, start int, which int")
    return found.groupBy("k1", "k2").agg(*(F.collect_set(F.when(F.col("which") == c, F.col("start"))).alias(f"starts_{c}") for c in range(len(shapes))))


def repeated_spans(docs: DataFrame, text_col: str = "text", threshold: int = THRESHOLD, also: tuple[int, ...] = ()) -> DataFrame:
    """(k1, k2, spans): for each text with repeats the maximal byte runs to remove, in order (null: none).

    ``k1``, ``k2`` are :func:`text_key`; texts without repeats have no row. For each further threshold in
    ``also`` there is a column ``spans_<threshold>``, from the same ranks."""
    thresholds = [threshold, *also]
    shapes = [Shape(t, min(thresholds)) for t in thresholds]
    texts = _keyed(docs.filter(F.octet_length(text_col) >= min(thresholds)), text_col)
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranked = durable(_ranked(texts, n_bytes, shapes[0]), "suffixes")
    levels, n_levels = _levels(ranked, max(shapes, key=lambda s: s.far))
    drop_durable(ranked)
    n_pairs = 2 * (levels.agg(F.sum(F.size("suffixes"))).first()[0] or 0)
    found = _listed(_sure_starts(levels, n_levels, n_pairs, shapes), len(shapes), "found", "start", "stop", "lead")
    sure = levels.select(*_KEY, "n", "copies").join(found, _KEY, "left")
    for c, shape in enumerate(shapes):
        # all strings of a text that stands twice are repeated, and stand for what other texts share with it
        whole = F.array(F.struct(F.lit(0).alias("start"), (F.col("n") - (shape.threshold - 1)).cast("int").alias("stop"), F.lit(True).alias("lead")))
        sure = sure.withColumn(f"sure_{c}", F.when(F.col("copies") & (F.col("n") >= shape.threshold), whole).otherwise(F.col(f"found_{c}"))).drop(f"found_{c}")
    sure = durable(sure.drop("n", "copies"), "sure")
    open_ = _open_starts(levels.drop("copies").join(sure, _KEY, "left"), n_levels, n_pairs, shapes)
    checks = durable(_listed(open_, len(shapes), "checks", "start", "stop", "open"), "checks")
    drop_durable(levels)
    total = sum(F.coalesce(F.expr(f"aggregate(checks_{c}, 0L, (t, x) -> t + x.stop - x.start)"), F.lit(0)) for c in range(len(shapes)))
    n_checks = checks.agg(F.sum(total)).first()[0] or 0
    # equal texts are compared once: of each key the first row
    once = texts.join(checks, _KEY).groupBy(*_KEY).agg(F.first("text").alias("text"), *(F.first(f"checks_{c}").alias(f"checks_{c}") for c in range(len(shapes))))
    exact = _exact_starts(once, n_checks, shapes)
    names = ["spans", *(f"spans_{t}" for t in also)]

    def merge(batches):
        for batch in batches:
            lists = []
            for name, shape in zip(names, shapes, strict=True):
                rows, x = _flat(batch, name)
                r, s, e = _union(rows, x["start"].astype(np.int64), x["stop"].astype(np.int64) + shape.threshold - 1)
                lists.append(_span_lists(len(batch), r, s, e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=[*_KEY, *names])
        give_back()

    none = F.array().cast(_SPAN)
    both = sure.join(exact, _KEY, "left").select(
        *_KEY,
        *(
            F.concat(F.coalesce(F.expr(f"transform(sure_{c}, x -> struct(x.start as start, x.stop as stop))"), none), F.coalesce(F.expr(f"transform(starts_{c}, x -> struct(x as start, cast(x + 1 as int) as stop))"), none)).alias(name)
            for c, name in enumerate(names)
        ),
    )
    some = " or ".join(f"size({name}) > 0" for name in names)
    spans = both.filter(some).mapInArrow(merge, "k1 long, k2 long, " + ", ".join(f"{name} {_SPAN}" for name in names))
    spans = durable(spans.select(*_KEY, *(F.when(F.size(name) > 0, F.col(name)).alias(name) for name in names)), "spans")
    drop_durable(sure)
    drop_durable(checks)
    return spans


def _with_spans(docs: DataFrame, spans: DataFrame, text_col: str) -> DataFrame:
    k1, k2 = text_key(text_col)
    found = [c for c in spans.columns if c not in _KEY]
    keys = spans.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), *(F.col(c).alias(f"_{c}") for c in found))
    return docs.withColumns({"_k1": k1, "_k2": k2}).join(keys, ["_k1", "_k2"], "left")


def cut_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of spans (null where nothing goes) and ``kept``, the bytes that stay without ``spans`` (binary)."""
    found = [c for c in spans.columns if c not in _KEY]
    docs = give_way(docs, *found, "kept")
    joined = _with_spans(docs, spans, text_col).withColumn("_bytes", F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    # the bytes between the end of each span and the start of the next; Latin-1 maps bytes to characters one to one
    pieces = "zip_with(concat(array(0), _spans.stop), concat(_spans.start, array(octet_length(_bytes))), (a, b) -> decode(substring(_bytes, a + 1, b - a), 'ISO-8859-1'))"
    kept = F.when(F.col("_spans").isNull(), F.col("_bytes")).otherwise(F.expr(f"encode(array_join({pieces}, ''), 'ISO-8859-1')"))
    return joined.select(*docs.columns, *(F.col(f"_{c}").alias(c) for c in found), kept.alias("kept"))


def cut_text(docs: DataFrame, spans: DataFrame, text_col: str = "text", min_words: int = 0) -> DataFrame:
    """``docs`` with the spans cut out of the text column, those with fewer than ``min_words`` whole words left in.

    A character that a span covers only in part goes too, so that the text stays valid; texts without spans are
    untouched (null stays null). Columns keep their names and order, whatever the names."""
    fields = [f for f in docs.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def long_enough(part: bytes) -> bool:
        # words with a break before and after them inside the span, or at its ends
        return len(part.split()) >= min_words if min_words else True

    def task(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text_col)).to_pylist()
            for i, found in enumerate(batch.column(len(names) - 1).to_pylist()):
                if found:
                    raw, at, kept = texts[i].encode(), 0, []
                    for span in found:
                        if long_enough(raw[span["start"] : span["stop"]]):
                            kept.append(raw[at : span["start"]].decode(errors="ignore"))
                            at = span["stop"]
                    texts[i] = "".join([*kept, raw[at:].decode(errors="ignore")])
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(j) for j, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        give_back()

    return _with_spans(docs, spans, text_col).select(*docs.columns, "_spans").mapInArrow(task, schema)
