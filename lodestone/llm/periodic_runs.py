"""Maximal periodic runs of words by a descending-LCP Kruskal.

A run is a stretch of words with smallest period q and a length of at least ``max(12, 2 * q)`` that no
neighbouring word extends. Two suffixes a period apart share ``length - q`` words, which is never under six,
so only suffixes whose first six words occur twice in their document take part:

1. Words become numbers by a table, not by hashes; positions whose 2, 4, then 6 words are unique drop out.
2. The stretches around the others are sorted as suffixes by prefix doubling (numpy, all documents of a slice
   at once; a document's number is part of its words, so none meets another's). Neighbours' LCPs come from the
   ranks of the rounds.
3. *Kruskal.* Neighbours are joined by decreasing LCP. A class is an ordered set of positions under union-find;
   the smaller set goes into the larger one. Positions that become adjacent have exactly that LCP in common: if
   they are no farther apart, they seed a run with their distance as period. All seeds of one run end at the
   same word; the first of them is its start. Adjacency makes the distance the smallest period.

Documents are rows, nothing is shuffled. A document is worked on as a whole: about 60 bytes a word, and where
nearly all of it repeats itself about 4 more a word and doubling round.

A null text has no words; an empty table gives none; repeated rows are worked on each for itself. An input
column named like one of the new ones gives way to it.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, give_back, give_way, text_slices

#: A run has so many words at least, and two periods.
MIN_LENGTH = 12
#: Words that two suffixes of a run share at least: max(12, 2q) - q.
SHARED = MIN_LENGTH // 2
#: Sets of more positions are merged as a whole, not position by position.
SMALL = 64

_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_SCHEMA = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys from 0, and how often the key of each rank occurs."""
    _, rank, times = np.unique(key, return_inverse=True, return_counts=True)
    return rank, times


def _repeating(word: np.ndarray, doc: np.ndarray, n_words: int) -> np.ndarray:
    """Positions whose first SHARED words occur twice or more in their document."""
    n = len(word)
    at = np.arange(n)
    two = np.full(n + 2 * SHARED, -1, dtype=np.int64)
    at = at[:-1][doc[1:] == doc[:-1]]
    rank, times = _ranks((doc[at] * n_words + word[at]) * n_words + word[at + 1])
    again = times[rank] > 1
    at = at[again]
    two[at] = rank[again]
    left = two
    for step in range(2, SHARED, 2):  # 4 and 6 words: the words so far, and two more
        right = two[at + step]
        at, right = at[right >= 0], right[right >= 0]
        rank, times = _ranks(left[at] * (n + 1) + right)
        again = times[rank] > 1
        at = at[again]
        left = np.full_like(two, -1)
        left[at] = rank[again]
    return at


def _suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the order of the suffixes: (position, position, words in common)."""
    rank, _ = _ranks(text)
    n, levels, width = len(rank), [rank.astype(np.int32)], 1
    while rank.max() + 1 < n:
        later = np.full(n, 0, dtype=np.int64)
        later[: n - width] = rank[width:] + 1
        rank, _ = _ranks(rank * (n + 1) + later)
        levels.append(rank.astype(np.int32))
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(np.maximum(a, b) + common < n)
        fits = fits[levels[k][a[fits] + common[fits]] == levels[k][b[fits] + common[fits]]]
        common[fits] += 1 << k
    return a, b, common


def _merge(large: list[int], small: list[int], common: int, seeds: list[tuple[int, int, int]]) -> list[int]:
    """Both sets in order; pairs of one of each that are adjacent now and no farther apart than ``common`` are seeds."""
    if len(small) > SMALL:
        both = sorted(large + small)  # two ordered stretches: one pass
        of_small = np.isin(np.array(both), np.array(small))
        at = np.flatnonzero(of_small[1:] != of_small[:-1])
        seeds.extend((both[i], both[i + 1] - both[i], common) for i in at if both[i + 1] - both[i] <= common)
        return both
    last = -1
    for i, x in enumerate(small):
        k = bisect_left(large, x)
        if k and large[k - 1] != last and x - large[k - 1] <= common:
            seeds.append((large[k - 1], x - large[k - 1], common))
        if k < len(large) and large[k] - x <= common and (i + 1 == len(small) or small[i + 1] > large[k]):
            seeds.append((x, large[k] - x, common))
        large.insert(k, x)
        last = x
    return large


def _seeds(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """(position, period, words in common) of the pairs that become adjacent within their LCP. a, b, common: edges."""
    order = np.argsort(-common, kind="stable")
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, sets, seeds = list(range(len(nodes))), [[x] for x in nodes.tolist()], []
    for u, v, l in zip(ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist(), common[order].tolist(), strict=True):
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if len(sets[u]) < len(sets[v]):
            u, v = v, u
        parent[v] = u
        sets[u] = _merge(sets[u], sets[v], l, seeds)
        sets[v] = []
    return np.array(seeds, dtype=np.int64).reshape(-1, 3)


def find_runs(word: np.ndarray, doc: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (index into ``word``), length and period of every run, by start, then period.

    ``word``: numbers under ``n_words``; ``doc``: the document of each, not decreasing. Runs stay inside documents."""
    none = np.zeros(0, dtype=np.int64)
    if len(word) < MIN_LENGTH:
        return none, none, none
    at = _repeating(word, doc, n_words)
    if not len(at):
        return none, none, none
    # the words that two such suffixes share, and the one after: the rest of the text cannot matter
    cover = np.zeros(len(word) + SHARED + 2, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + SHARED + 1, -1)
    kept = np.flatnonzero(np.cumsum(cover[: len(word)]) > 0)
    gaps = np.flatnonzero((np.diff(kept) > 1) | (doc[kept][1:] != doc[kept][:-1])) + 1
    # each stretch ends with a word of its own
    ends = np.append(gaps, len(kept))
    symbols = np.insert(doc[kept] * n_words + word[kept], ends, -1 - np.arange(len(ends)))
    places = np.insert(kept, ends, -1)
    a, b, common = _suffix_order(symbols)
    wide = common >= SHARED
    seeds = _seeds(places[a[wide]], places[b[wide]], common[wide])
    start, period, stop = seeds[:, 0], seeds[:, 1], seeds[:, 0] + seeds[:, 2]
    order = np.lexsort((start, period, stop))
    start, period, stop = start[order], period[order], stop[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = (stop[1:] != stop[:-1]) | (period[1:] != period[:-1])
    start, period, length = start[first], period[first], (stop - start + period)[first]
    long = length >= np.maximum(MIN_LENGTH, 2 * period)
    start, period, length = start[long], period[long], length[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _of_slice(texts: list[bytes]) -> tuple[list[list[tuple]], list[bytes]]:
    """Runs of each text, and its words, without those that repeat a run's first period, joined by one space."""
    words = [t.split() for t in texts]  # bytes: at 0x20 and 0x09 to 0x0D only
    table: dict[bytes, int] = {}
    word = np.array([table.setdefault(w, len(table)) for ws in words for w in ws], dtype=np.int64)
    sizes = np.array([len(ws) for ws in words], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    start, length, period = find_runs(word, np.repeat(np.arange(len(words)), sizes), len(table))
    doc = np.searchsorted(first + sizes, start, side="right")
    runs: list[list[tuple]] = [[] for _ in texts]
    for d, s, n, q in zip(doc.tolist(), (start - first[doc]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs[d].append((s, n, q))
    joined = []
    for ws, found in zip(words, runs, strict=True):
        if found:
            gone = np.zeros(len(ws) + 1, dtype=np.int64)
            for s, n, q in found:
                gone[s + q] += 1
                gone[s + n] -= 1
            ws = [w for w, g in zip(ws, np.cumsum(gone).tolist(), strict=False) if not g]
        joined.append(b" ".join(ws))
    return runs, joined


def periodic_runs(docs: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, with ``runs`` (start and length in words, period; by start, then period)
    and ``collapsed``, the text's words without those a run holds after its first period, joined by one space."""
    docs = give_way(docs, "runs", "collapsed")
    fields = [f for f in docs.schema.fields if f.name not in drop]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"runs {RUNS_SCHEMA}, collapsed string"

    def task(batches):
        for batch in batches:
            runs, collapsed = [], []
            for _, _, data, offsets in text_slices(batch, text_col):
                raw = data.tobytes()
                found, joined = _of_slice([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                runs += [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found]
                collapsed += joined
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(runs, _RUN), pa.array(collapsed, pa.binary()).cast(pa.string())], names=[*(f.name for f in fields), "runs", "collapsed"])
        give_back()

    return bound_batches(docs).mapInArrow(task, schema)
