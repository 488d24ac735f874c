"""Quality by supervised subword embeddings.

Each word has hashed features: itself and its character n-grams of 3 to 5 (with word ends
marked). A document is the average of the vectors of all its features; a softmax over it gives
the classes. Vectors and output layer are learned by plain stochastic gradient descent in
numpy, on a bounded sample of labelled rows.

Since the average and the output layer are linear, a word's share of both class sums needs to
be worked out only once per task. A text without words has the average zero, so its score is
that of the output layer's bias. An input column ``score`` gives way to the new one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RollingHash, bound_batches, give_back, give_way, mix, span_hashes, text_slices, word_spans

BUCKETS = 1 << 16
DIMENSIONS = 8
GRAMS = (3, 4, 5)
#: Passes over the rows: so many that rows are visited VISITS times at least.
EPOCHS, VISITS = 4, 16_000
RATE = 2.0
BATCH = 16
#: Labelled rows that the model is fitted on at most.
MAX_TRAINING_ROWS = 4_000
TABLE_WORDS = 150_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.uint64(0xA0761D6478BD642F)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words in a row, and how many each word has."""
    marked = b"".join(b"<" + w + b">" for w in words)
    data = np.frombuffer(marked, dtype=np.uint8)
    lengths = np.array([len(w) + 2 for w in words], dtype=np.int64)
    offsets = np.append(0, np.cumsum(lengths))
    rolling = RollingHash(data)
    owner, ids = [np.arange(len(words))], [rolling.spans(offsets[:-1], offsets[1:]) ^ _SEED]
    row = np.repeat(np.arange(len(words)), lengths)
    for k in GRAMS:
        starts = np.flatnonzero(np.arange(len(data)) + k <= offsets[row + 1]) if len(data) else np.zeros(0, dtype=np.int64)
        owner.append(row[starts])
        ids.append(rolling.spans(starts, starts + k))
    owner, ids = np.concatenate(owner), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    return (mix(ids[order]) % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner, minlength=len(words))


@dataclass
class SubwordModel:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def word_sums(self, words: list[bytes]) -> np.ndarray:
        """Per word: the sum over its features of output . vector (a class a column), and their number."""
        ids, counts = word_features(words)
        per_feature = (self.vectors @ self.output.T)[ids]
        bounds = np.append(0, np.cumsum(counts))[:-1]
        return np.c_[np.add.reduceat(per_feature, bounds, axis=0), counts] if len(words) else np.zeros((0, 3))

    def probability(self, sums: np.ndarray) -> np.ndarray:
        z = sums[:, :2] / np.maximum(sums[:, 2:], 1) + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))


def train(rows: list[tuple[str, int]], seed: int = 11) -> SubwordModel:
    """Learn from (text, label 0 or 1) rows; the order of steps is fixed by ``seed``.

    Without rows of both classes nothing is known: every score is 0 (but for rounding)."""
    if len({y for _, y in rows}) < 2:
        return SubwordModel(np.zeros((BUCKETS, DIMENSIONS)), np.zeros((2, DIMENSIONS)), np.array([30.0, 0.0]))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    output, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    docs = []
    for text, y in rows:
        data = _LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        raw = data.tobytes()
        ids, _ = word_features([raw[a:b] for a, b in zip(starts, ends, strict=True)])
        found, times = np.unique(ids, return_counts=True)
        docs.append((found.astype(np.int32), (times / max(1, len(ids))).astype(np.float32), y))
    epochs = max(EPOCHS, -(-VISITS // max(1, len(docs))))
    steps = epochs * -(-len(docs) // BATCH)
    step = 0
    for _ in range(epochs if docs else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            part = [docs[i] for i in order[at : at + BATCH]]
            rate = RATE * (1 - step / steps)
            step += 1
            grad_vectors, grad_output, grad_bias = [], np.zeros_like(output), np.zeros(2)
            for ids, share, y in part:
                hidden = share @ vectors[ids]
                z = output @ hidden + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                grad_output += np.outer(p, hidden)
                grad_bias += p
                grad_vectors.append((ids, np.outer(share, p @ output)))
            for ids, g in grad_vectors:
                vectors[ids] -= rate * g
            output -= rate * grad_output / len(part)
            bias -= rate * 0.1 * grad_bias / len(part)
    return SubwordModel(vectors, output, bias)


def score(docs: DataFrame, model: SubwordModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    docs = give_way(docs, "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", score double"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMENSIONS doubles: 4 MB

    def task(batches):
        known: dict[int, int] = {}
        sums = np.zeros((0, 3))
        for batch in batches:
            out = []
            for first, end, data, offsets in text_slices(batch, text_col):
                data = _LOWER[data]
                starts, ends, rows = word_spans(data, offsets)
                names, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                if len(known) > TABLE_WORDS:
                    known, sums = {}, np.zeros((0, 3))
                names = names.tolist()
                new = [i for i, x in enumerate(names) if x not in known]
                raw = data.tobytes()
                if new:
                    known.update(zip([names[i] for i in new], range(len(known), len(known) + len(new)), strict=True))
                    sums = np.concatenate([sums, shared.value.word_sums([raw[starts[at[i]] : ends[at[i]]] for i in new])])
                index = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[inverse] if names else np.zeros(0, dtype=np.int64)
                total = np.array([np.bincount(rows, weights=sums[index, c], minlength=end - first) for c in range(3)]).T
                out.append(shared.value.probability(total))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*batch.schema.names, "score"])
        give_back()

    return bound_batches(docs).mapInArrow(task, schema)
