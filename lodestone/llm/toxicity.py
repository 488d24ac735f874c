"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. Both share the
commonest ordinary words; each then holds the word openings that its own class uses most in
excess of the other. A window is one word with its neighbouring spaces; what it says is how many
bytes shorter it compresses with the toxic dictionary. Every byte is written as four fixed
bytes first, so that a window's length counts the dictionary matches it is made of, and not
the literals between them (with plain text the two lengths of short windows differed by noise:
held-out area under the curve .55 to .80 against .94 in this form). Scores come from how many
and how large these differences are in a document, by a logistic regression on labelled rows
that the dictionaries have not seen.

A task compresses each different word once. A text without words (null, empty) has score from
all-zero features. Scores depend on the text alone. An input column ``score`` gives way to the new one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import bound_batches, give_back, give_way, span_hashes, text_slices, word_spans
from .training_rows import logistic, logistic_score

LEVEL = 12
COMMON_WORDS = 1500
CLASS_BYTES = 1024
#: Labelled rows that the model is fitted on at most.
MAX_TRAINING_ROWS = 12_000
#: Words that a task keeps the result of.
TABLE_WORDS = 150_000
#: Differences from which windows are counted, in bytes.
STEPS = (2, 3, 5, 8, 12)

_CODE = np.random.default_rng(7).integers(0, 256, (256, 4), dtype=np.uint8)
# letters are lower-cased, all other ASCII separates words
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _fold(text: str) -> bytes:
    return _FOLD[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes()


def _openings(words: set[bytes]) -> set[bytes]:
    return {(b" " + w + b" ")[:k] for w in words for k in range(4, min(len(w) + 2, 12) + 1)}


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple | None = None

    def _packers(self) -> list:
        """Compressors with the ordinary and the toxic dictionary, made once a process."""
        if not hasattr(self, "_made"):
            self._made = []
            for content in (self.ordinary, self.toxic):
                zdict = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                zdict.precompute_compress(level=LEVEL)
                self._made.append(zstandard.ZstdCompressor(dict_data=zdict, level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False))
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def differences(self, words: list[bytes]) -> np.ndarray:
        """How many bytes shorter each word compresses with the toxic dictionary."""
        coded = [_CODE[np.frombuffer(b" " + w + b" ", dtype=np.uint8)].tobytes() for w in words]
        lengths = []
        for packer in self._packers():
            packed = packer.multi_compress_to_buffer(coded, threads=1) if coded else []
            lengths.append(np.array([len(packed[i]) for i in range(len(coded))], dtype=np.int32))
        return lengths[0] - lengths[1]


def features(rows: np.ndarray, difference: np.ndarray, n_rows: int) -> np.ndarray:
    """Per document: mean and largest difference, and by step how many windows reach it (log) and what share."""
    n = np.bincount(rows, minlength=n_rows)
    top = np.zeros(n_rows)
    np.maximum.at(top, rows, difference)
    columns = [np.bincount(rows, weights=difference, minlength=n_rows) / np.maximum(n, 1), top]
    for step in STEPS:
        hits = np.bincount(rows[difference >= step], minlength=n_rows)
        columns += [np.log1p(hits), hits / np.maximum(n, 1)]
    return np.array(columns).T


def train(rows: list[tuple[str, int]]) -> ToxicityModel:
    """Dictionaries from two thirds of the rows, calibration from the rest (from all rows where either lacks a class).

    Without rows of both classes nothing is known: every score is 0 (but for rounding), and no text is taken for toxic.
    Texts are folded one at a time, in passes, so that memory is that of the counts."""
    fit = [(t, y) for t, y in rows if zlib.crc32(t.encode()) % 3]
    rest = [(t, y) for t, y in rows if not zlib.crc32(t.encode()) % 3]
    fit, rest = (part if len({y for _, y in part}) == 2 else rows for part in (fit, rest))
    n = Counter(y for _, y in fit)
    common: Counter = Counter()
    toxic: Counter = Counter()
    for t, y in fit:
        words = set(_fold(t).split())
        if y:
            toxic.update(_openings(words))
        else:
            common.update(words)
    usual = [w for w, _ in sorted(common.items(), key=lambda x: (x[1], x[0]))[-COMMON_WORDS:]]
    wanted = {p for p, k in toxic.items() if k >= 5} | _openings({w for w, k in common.items() if k >= 5})
    del common, toxic
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for t, y in fit:
        seen[y].update(_openings(set(_fold(t).split())) & wanted)

    def excess(y: int) -> bytes:
        score = {}
        for piece, k in seen[y].items():
            own, other = k / (n[y] + 2), (seen[1 - y][piece] + 0.5) / (n[1 - y] + 2)
            if k >= 5 and own > other:
                score[piece] = (own - other) * math.log(own / other)
        chosen: list[bytes] = []
        for piece in sorted(score, key=lambda p: (-score[p], p)):
            if sum(map(len, chosen)) >= CLASS_BYTES:
                break
            if not any(piece in c for c in chosen):
                chosen.append(piece)
        return b"".join(chosen[::-1])[-CLASS_BYTES:].rjust(CLASS_BYTES)

    shared = b" " + b" ".join(usual) + b" "
    expand = lambda b: _CODE[np.frombuffer(b, dtype=np.uint8)].tobytes()
    model = ToxicityModel(expand(shared + excess(1)), expand(shared + excess(0)))
    y = np.array([y for _, y in rest], dtype=float)
    if len(set(y)) == 2:
        known: dict[bytes, int] = {}
        parts = []
        for t, _ in rest:
            words = _fold(t).split()
            new = sorted(set(words).difference(known))
            known.update(zip(new, model.differences(new).tolist(), strict=True))
            parts.append(features(np.zeros(len(words), dtype=np.int64), np.array([known[w] for w in words], dtype=float), 1))
        model.weights = logistic(np.concatenate(parts), y)
    else:
        model.weights = (np.array([-30.0] + [0.0] * (2 + 2 * len(STEPS))), 0.0, 1.0)
    return model


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1)."""
    docs = give_way(docs, "score")
    fields = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the dictionaries: about 60 KB

    def task(batches):
        known: dict[int, int] = {}
        for batch in batches:
            out = []
            for first, end, data, offsets in text_slices(batch, text_col):
                data = _FOLD[data]
                starts, ends, rows = word_spans(data, offsets)
                names, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                if len(known) > TABLE_WORDS:
                    known.clear()
                names = names.tolist()
                new = [i for i, x in enumerate(names) if x not in known]
                raw = data.tobytes()
                known.update(zip([names[i] for i in new], shared.value.differences([raw[starts[at[i]] : ends[at[i]]] for i in new]).tolist(), strict=True))
                value = np.fromiter(map(known.__getitem__, names), np.float64, len(names))
                out.append(logistic_score(features(rows, value[inverse] if len(value) else np.zeros(0), end - first), shared.value.weights))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*batch.schema.names, "score"])
        give_back()

    return bound_batches(docs).mapInArrow(task, schema)
