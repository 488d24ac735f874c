"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

The rank file (base64 token, rank) becomes a ``tokenizers`` BPE model: every byte is shown as
one printable character, and every split of a token into two tokens is listed as a merge in
rank order, which makes the model merge exactly the lowest-ranked pair, as rank-based encoders
do. Texts are cut by the tokenizer's pattern; each *different* piece of a task is encoded once
and kept in a bounded table, and the ids of whole texts are gathered from it.

Decoding maps ids to the characters that stand for bytes and reverses the byte table; the bytes
of a text are joined before they are read as UTF-8, so characters split over tokens come back.
A null text counts as empty (no ids). Any input gives back its own bytes. An input column named
like a new one gives way to it.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bound_batches, give_back, give_way, text_slices

#: Pieces that a task keeps; beyond, the table starts anew.
TABLE_PIECES = 150_000


def byte_table() -> dict[int, str]:
    """A printable character for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The ``tokenizers`` model of a rank file, for single pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, models, pre_tokenizers

    ranks, table = load_ranks(path), byte_table()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = [(shown[token[:i]], shown[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return model


@functools.lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens in id order, and their offsets, by way of the reversed byte table."""
    table = byte_table()
    reverse = {c: b for b, c in table.items()}
    shown = {rank: "".join(table[b] for b in token) for token, rank in load_ranks(path).items()}
    tokens = [bytes(reverse[c] for c in shown.get(i, "")) for i in range(max(shown) + 1)]
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum([0, *map(len, tokens)])


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    return values[np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]


class _Pieces:
    """Ids of the pieces met so far."""

    def __init__(self, path: str):
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each piece has."""
        if len(self.index) > TABLE_PIECES:
            self.clear()
        new = list(set(pieces).difference(self.index))
        if new:
            found = [e.ids for e in tokenizer(self.path).encode_batch_fast(new, add_special_tokens=False)]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.lengths = np.append(self.lengths, np.fromiter(map(len, found), np.int64, len(found)))
            self.ids = np.append(self.ids, np.fromiter((i for ids in found for i in ids), np.int32))
            self.starts = np.cumsum(self.lengths) - self.lengths
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        return _gather(self.ids, self.starts[at], self.lengths[at]), self.lengths[at]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_split`` (tokens that start inside a character).

    With ``offsets`` also ``starts``: the character at which each token starts."""
    docs = give_way(docs, "ids", "n_split", *["starts"] * offsets)
    fields = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", ids array<int>, n_split int" + ", starts array<int>" * offsets

    def task(batches):
        found, pieces = regex.compile(pattern).findall, _Pieces(path)
        sizes = np.diff(_token_bytes(path)[1])
        for batch in batches:
            for first, end, data, cuts in text_slices(batch, text_col):
                raw = data.tobytes()
                texts = [found(raw[a:b].decode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                ids, lengths = pieces.encode([p for t in texts for p in t])
                ends = np.append(0, np.cumsum(lengths))[np.cumsum([0, *map(len, texts)])]
                # bytes to characters: a character starts at each byte that continues none
                heads = np.append((data & 0xC0) != 0x80, True)
                at = np.cumsum(sizes[ids]) - sizes[ids]
                inside = np.append(0, np.cumsum(~heads[at]))
                bounds = pa.array(ends.astype(np.int32))
                added = [pa.ListArray.from_arrays(bounds, pa.array(ids)), pa.array((inside[ends[1:]] - inside[ends[:-1]]).astype(np.int32))]
                if offsets:
                    chars = np.cumsum(heads) - 1
                    starts = chars[at] - np.repeat(chars[cuts[:-1]], np.diff(ends))
                    added.append(pa.ListArray.from_arrays(bounds, pa.array(starts.astype(np.int32))))
                # a slice at a time, so that the next step holds little at once
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, *added], names=[*batch.schema.names, "ids", "n_split", *["starts"] * offsets])
        give_back()

    return bound_batches(docs).mapInArrow(task, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """``encoded`` with ``decoded`` (binary: the bytes of the ids; ``decode(decoded, 'UTF-8')`` reads them)."""
    encoded = give_way(encoded, "decoded")
    kept = [f for f in encoded.schema.fields if f.name not in drop]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", decoded binary"

    def task(batches):
        values, bounds = _token_bytes(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids, out, first, at = column.flatten().to_numpy(zero_copy_only=False), [], 0, 0
            ends = np.cumsum(counts)
            while first < len(counts):  # about a million tokens at a time
                last = max(first + 1, int(np.searchsorted(ends, at + (1 << 20), side="right")))
                part = ids[at : ends[last - 1]]
                lengths = bounds[part + 1] - bounds[part]
                data = _gather(values, bounds[part], lengths).tobytes()
                cuts = np.append(0, np.cumsum(lengths))[np.append(at, ends[first:last]) - at]
                out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                first, at = last, int(ends[last - 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), pa.array(out, type=pa.binary())], names=[*(f.name for f in kept), "decoded"])
        give_back()

    return encoded.mapInArrow(task, schema)
