"""Secrets in texts: three fixed patterns, and strings that pass a battery of randomness tests.

*Patterns.* A value assigned to a name like password or token, an access key, a long string of hex digits. These
spans stand whatever the battery says.

*Battery.* Of the runs of 20 or more letters, digits and ``+/_=-`` outside those spans the encoding is inferred, the
first of ENCODINGS that has all its characters (padding apart). Three tests ask whether the characters look drawn at
random from that alphabet: chi-squared of their frequencies, the number of runs above and below the alphabet's middle,
and the correlation of each character with the next (all two-sided, of their order in the alphabet). Fisher's sum joins the
three into one p-value, whose logarithm, in steps of a tenth, is the string's score: near 0 for a random string, far
below for words, paths and counters.

*False discoveries.* Short strings of ordinary text may look random by chance, long ones hardly ever, so scores only
mean something beside ordinary strings of like length and encoding. Every document gives one such string for every
encoding and length class: letters of its words in a row, cased as names in programs are, from a place that the text itself chooses, without what is not of the
alphabet (candidates and patterns left out).
A candidate's p-value is the share of ordinary strings of its cell (encoding, length class) with at least its score; the
step-up rule of Benjamini and Hochberg over all candidates of the table holds the share of false ones at ``rate``.

Only counts by (encoding, length class, score) are aggregated and sent to the driver: at most a number fixed by these
three, whatever the size of the table. Texts are read once; the scores travel in a durable table without the texts.

A null text counts as empty; an empty table gives none; a repeated row counts each time, as text and as source of ordinary
strings. An input column named like a new one gives way to it. A text is searched as a whole, however long.
"""

from __future__ import annotations

import math
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, durable, give_back, give_way

# The patterns and the least lengths (of group 2, or of all).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_B64 = string.ascii_uppercase + string.ascii_lowercase + string.digits
#: Alphabets in their order; a string has the first that holds all its characters.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base62": string.digits + string.ascii_uppercase + string.ascii_lowercase,
    "base64": _B64 + "+/",
    "base64url": _B64 + "-_",
}
_PLACE = {name: {c: i for i, c in enumerate(letters)} for name, letters in ENCODINGS.items()}
_OTHERS = {name: bytes(b for b in range(256) if chr(b) not in letters) for name, letters in ENCODINGS.items()}
#: Least lengths of the length classes.
CLASSES = (20, 28, 40, 64, 128)
#: Scores are tenths of log10 p, down to this.
LEAST_SCORE = -400
#: Share of false ones among the added spans.
RATE = 0.01

_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
_SCORED = pa.list_(pa.struct([("cell", pa.int32()), ("score", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
SPANS_SCHEMA, SCORED_SCHEMA = "array<struct<kind:int,start:int,stop:int>>", "array<struct<cell:int,score:int,start:int,stop:int>>"
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _cell(encoding: int, length: int) -> int:
    return encoding * len(CLASSES) + sum(length >= c for c in CLASSES) - 1


def scores(places: np.ndarray, n_letters: int) -> np.ndarray:
    """Scores of strings of one length (rows of places in an alphabet of ``n_letters``)."""
    n_rows, n = places.shape
    counts = np.bincount((np.arange(n_rows)[:, None] * n_letters + places).ravel(), minlength=n_rows * n_letters).reshape(n_rows, n_letters)
    free = n_letters - 1
    square = ((counts - n / n_letters) ** 2).sum(1) * n_letters / n
    # a chi-squared value's cube root is nearly normal
    z = [(np.cbrt(square / free) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))]
    high = places >= n_letters / 2
    above = high.sum(1).astype(float)
    below = n - above
    mean = 1 + 2 * above * below / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 0))
    z.append(np.where(spread > 0, ((high[:, 1:] != high[:, :-1]).sum(1) + 1 - mean) / np.where(spread > 0, spread, 1), 40.0))
    centred = places - (n_letters - 1) / 2
    # products of neighbours under a uniform law: mean 0, deviation (k * k - 1) / 12 each
    z.append((centred[:, 1:] * centred[:, :-1]).sum(1) / (math.sqrt(n - 1) * (n_letters * n_letters - 1) / 12))
    fisher = -2 * sum(np.log(np.maximum(_erfc(np.abs(x) / math.sqrt(2)).astype(float), 1e-300)) for x in z)
    # the upper tail of chi-squared with six degrees of freedom
    log_p = -fisher / 2 + np.log1p(fisher / 2 + fisher**2 / 8)
    return np.maximum(np.floor(log_p / math.log(10) * 10), LEAST_SCORE).astype(np.int32)


def infer(text: str) -> tuple[int, list[int]] | None:
    """The number of the encoding, and the places of the characters in its alphabet; None for none, or digits alone."""
    body = text.rstrip("=")
    if len(body) < CLASSES[0] or body.isdigit():
        return None
    for i, places in enumerate(_PLACE.values()):
        if all(c in places for c in body):
            return i, [places[c] for c in body]
    return None


def _overlaps(spans: list[tuple[int, int, int]], start: int, stop: int) -> bool:
    return any(a < stop and start < b for _, a, b in spans)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Pattern spans (kind, start, stop) by start, then kind; candidates (start, stop) beside them; all long runs."""
    spans = []
    if ":" in text or "=" in text:
        spans = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    long = [m.span() for m in _CANDIDATE.finditer(text)]  # holds all access keys and hex strings that count
    for a, b in long:
        spans += [(1, m.start(), m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= MIN_ACCESS]
        spans += [(2, m.start(), m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= MIN_HEX]
    spans.sort(key=lambda s: (s[1], s[0]))
    return spans, [(a, b) for a, b in long if not _overlaps(spans, a, b)], long


def _ordinary(texts: list[str]) -> list[list[tuple[int, int]]]:
    """For each text (cell, score) of one ordinary string of each cell, as far as its words reach."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    raw = [t.encode("ascii", "ignore") for t in texts]
    capitals, titles = [t.upper() for t in raw], [t.title() for t in raw]
    for e, (name, letters) in enumerate(ENCODINGS.items()):
        table = np.zeros(256, dtype=np.int64)
        for i, c in enumerate(letters):
            table[ord(c)] = i
        # names in program texts are words in capitals or with capitals first; hex digits of either case are hardly words
        cased = raw if letters.lower() == letters else capitals if letters.upper() == letters else titles
        kept = [t.translate(None, _OTHERS[name]) for t in cased]
        sums = [zlib.crc32(k) for k in kept]
        for length in CLASSES:
            rows = [i for i, k in enumerate(kept) if len(k) >= length]
            if rows:
                # from a place in the whole text that its own letters choose
                at = [sums[i] % (len(kept[i]) - length + 1) for i in rows]
                places = table[np.frombuffer(b"".join(kept[i][k : k + length] for i, k in zip(rows, at, strict=True)), dtype=np.uint8)].reshape(len(rows), length)
                for i, s in zip(rows, scores(places, len(letters)).tolist(), strict=True):
                    out[i].append((_cell(e, length), s))
    return out


def _scanned(docs: DataFrame, text_col: str, drop: tuple[str, ...]) -> DataFrame:
    fields = [f for f in docs.schema.fields if f.name not in drop]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + f"_base {SPANS_SCHEMA}, _found {SCORED_SCHEMA}, _ordinary {SCORED_SCHEMA}"

    def task(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("").to_pylist()
            base, found, rest = [], [], []
            for text in texts:
                spans, candidates, long = scan(text)
                base.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans])
                known = [(a, b, infer(text[a:b])) for a, b in candidates]
                found.append(
                    [{"cell": _cell(i[0], len(i[1])), "score": int(scores(np.array([i[1]]), len(list(ENCODINGS.values())[i[0]]))[0]), "start": a, "stop": b} for a, b, i in known if i]
                )
                # the words without candidates and patterns
                cuts = sorted([*long, *((a, b) for _, a, b in spans)])
                at, kept = 0, []
                for a, b in cuts:
                    kept.append(text[at:a])
                    at = max(at, b)
                rest.append("".join([*kept, text[at:]]))
            ordinary = [[{"cell": c, "score": s, "start": None, "stop": None} for c, s in row] for row in _ordinary(rest)]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(base, _SPANS), pa.array(found, _SCORED), pa.array(ordinary, _SCORED)], names=[*(f.name for f in fields), "_base", "_found", "_ordinary"])
        give_back()

    return bound_batches(docs).mapInArrow(task, schema)


def accepted(found: dict[tuple[int, int], int], ordinary: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """The least accepted score of each cell, by the step-up rule over all candidates.

    found, ordinary: numbers of strings by (cell, score). A cell without ordinary strings accepts none."""
    ranked = []
    for cell in {c for c, _ in found}:
        null = sorted(((s, n) for (c, s), n in ordinary.items() if c == cell), reverse=True)
        total, k, at = sum(n for _, n in null), 0, 0
        for score, n in sorted(((s, n) for (c, s), n in found.items() if c == cell), reverse=True):
            while at < len(null) and null[at][0] >= score:
                k, at = k + null[at][1], at + 1
            ranked.append(((1 + k) / (1 + total), cell, score, n))
    m, below, limit = sum(r[3] for r in ranked), 0, -1.0
    ranked.sort()
    for i, (p, _, _, n) in enumerate(ranked):
        below += n
        if (i + 1 == len(ranked) or ranked[i + 1][0] > p) and p <= rate * below / m:
            limit = p
    least: dict[int, int] = {}
    for p, cell, score, _ in ranked:
        if p <= limit:
            least[cell] = min(score, least.get(cell, score))
    return least


def _counts(table: DataFrame, column: str) -> dict[tuple[int, int], int]:
    rows = table.select(F.explode(column).alias("x")).groupBy("x.cell", "x.score").count().collect()  # cells x scores at most
    return {(r[0], r[1]): r[2] for r in rows}


def secret_spans(docs: DataFrame, text_col: str = "text", rate: float = RATE, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without the columns ``drop``, with ``base`` and ``spans``: arrays of (kind, start, stop; code points, stop
    exclusive; the kind's number in KINDS) by start, then kind. ``base`` has the patterns' spans, ``spans`` also those of kind random."""
    docs = give_way(docs, "base", "spans", "_base", "_found", "_ordinary")
    table = durable(_scanned(docs, text_col, drop), "scanned")
    least = accepted(_counts(table, "_found"), _counts(table, "_ordinary"), rate)
    added = F.array().cast(SPANS_SCHEMA)
    if least:
        limits = F.create_map(*(F.lit(x) for item in sorted(least.items()) for x in item))
        passed = F.filter("_found", lambda x: F.coalesce(x.score >= limits[x.cell], F.lit(False)))
        added = F.transform(passed, lambda x: F.struct(F.lit(len(KINDS) - 1).alias("kind"), x.start.alias("start"), x.stop.alias("stop")))
    every = F.concat("_base", added)
    by_start = F.transform(F.array_sort(F.transform(every, lambda x: F.struct(x.start, x.kind, x.stop))), lambda x: F.struct(x.kind.alias("kind"), x.start.alias("start"), x.stop.alias("stop")))
    return table.select(*(c for c in table.columns if c not in ("_base", "_found", "_ordinary")), F.col("_base").alias("base"), by_start.alias("spans"))


def span_text(spans: str) -> Column:
    """``kind:start:stop`` of a column of spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.kind], x.start, x.stop)), ",")
