"""Packed key exchange: the shuffle behind suffix-array dedup and the n-gram join.

Both operators must compare a 64-bit key per text position, far too many for one Spark row
each. A task therefore packs its keys into one binary row per *key range* (bucket); Spark
shuffles these rows by bucket and each bucket is sorted with numpy. Buckets are ranges of a
uniform hash and their number follows the data (:func:`bucket_bits`). A key that many items hold
would still make its bucket large: an operator that only asks whether a key comes twice lets the
packing task *settle* the items whose key it has met twice. These travel in blobs of their own,
spread over tasks, and one of them a key is *sent* to the key's bucket, so that a bucket gets each
key at most once a chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back

#: Keys that one bucket should hold, and keys that a map task packs at a time.
BUCKET_KEYS = 1_500_000
CHUNK_KEYS = 1_000_000

BLOB_SCHEMA = "bucket int, n_items int, n_owners int, items binary, owners binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("n_items", pa.int32()), ("n_owners", pa.int32()), ("items", pa.binary()), ("owners", pa.binary())])


def bucket_bits(n_keys: int) -> int:
    """Bits of the key that name its bucket: at least 6, about BUCKET_KEYS keys a bucket."""
    return max(6, int(np.ceil(np.log2(max(1, n_keys) / BUCKET_KEYS)) if n_keys > BUCKET_KEYS else 0))


def _planes(column: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize)[:, :width].T.tobytes()


def pack(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """Unsigned columns as compressed byte planes of the given widths."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(c, w) for c, w in zip(columns, widths, strict=True)))


def unpack(blob: bytes, n: int, dtypes: list, widths: list[int]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    out, at = [], 0
    for dtype, width in zip(dtypes, widths, strict=True):
        full = np.zeros((n, np.dtype(dtype).itemsize), dtype=np.uint8)
        full[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(full.view(dtype).ravel())
        at += n * width
    return out


class Packer:
    """Collects keyed items of a task and cuts them into one blob per bucket.

    ``owner_types`` are the columns known once per document (its key first), ``item_types``
    the columns known per item. ``key_bytes`` of each key are kept below the bucket's bits, of many buckets what is
    left of 64 bits.
    ``settle(keys, items, owner keys)`` gives the masks of settled and of sent items of a chunk
    (sent ones are settled, too); it may write to the items."""

    def __init__(self, bits: int, owner_types: list, item_types: list, key_bytes: int = 5, settle=None):
        self.bits, self.owner_types, self.item_types, self.key_bytes, self.settle = bits, owner_types, [*item_types, np.uint8], key_bytes, settle
        self.low = min(8 * key_bytes, 64 - bits)
        self._items: list[tuple] = []
        self._owners: list[tuple] = []
        self.n_items = self.n_owners = self.n_chunks = 0

    def add(self, keys: np.ndarray, owner: np.ndarray, items: list[np.ndarray], owners: list[np.ndarray]) -> None:
        self._items.append((keys, (owner + self.n_owners).astype(np.uint32), *(x.astype(t) for x, t in zip(items, self.item_types, strict=False))))
        self._owners.append(tuple(x.astype(t) for x, t in zip(owners, self.owner_types, strict=True)))
        self.n_items += len(keys)
        self.n_owners += len(owners[0])

    def _widths(self, bucket: int) -> list[int]:
        return [8 if bucket < 0 else self.key_bytes, 4, *(np.dtype(t).itemsize for t in self.item_types)]

    def _blob(self, bucket: int, keys, owner, items, owners) -> tuple:
        used, local = np.unique(owner, return_inverse=True)
        columns = [np.diff(keys, prepend=np.uint64(0)), local.astype(np.uint32), *items]
        return bucket, len(keys), len(used), pack(columns, self._widths(bucket)), pack([x[used] for x in owners], [x.itemsize for x in owners])

    def flush(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.n_items or not force and self.n_items < CHUNK_KEYS:
            return
        keys, owner, *items = (np.concatenate(x) for x in zip(*self._items, strict=True))
        owners = [np.concatenate(x) for x in zip(*self._owners, strict=True)]
        self._items, self._owners, self.n_items, self.n_owners = [], [], 0, 0
        order = np.argsort(keys)
        keys, owner, items = keys[order] >> np.uint64(64 - self.bits - self.low), owner[order], [x[order] for x in items]
        items.append(np.zeros(len(keys), dtype=np.uint8))
        rows: list[tuple] = []
        if self.settle:
            settled, sent = self.settle(keys, items[:-1], owners[0][owner])
            spread = -1 - zlib.crc32(b"%d %d" % (TaskContext.get().partitionId(), self.n_chunks)) % (1 << 30)
            if settled.any():
                rows.append(self._blob(spread, keys[settled], owner[settled], [x[settled] for x in items], owners))
            items[-1][sent] = 1
            left = ~settled | sent
            keys, owner, items = keys[left], owner[left], [x[left] for x in items]
        self.n_chunks += 1
        bucket = (keys >> np.uint64(self.low)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        keys = keys & np.uint64((1 << self.low) - 1)
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if b > a:
                rows.append(self._blob(int(bucket[a]), keys[a:b], owner[a:b], [x[a:b] for x in items], owners))
        del keys, owner, items, owners, bucket, order
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def open(self, blobs: pd.DataFrame) -> tuple:
        """Of all blobs of one bucket: keys (int64, bucket included), owner and item columns, and the masks of settled and sent items."""
        keys, items, owners, settled = [], [], [], []
        for bucket, n, m, i, o in blobs[["bucket", "n_items", "n_owners", "items", "owners"]].itertuples(index=False):
            delta, local, *rest = unpack(i, n, [np.uint64, np.uint32, *self.item_types], self._widths(bucket))
            keys.append((np.cumsum(delta, dtype=np.uint64) | np.uint64(int(bucket) << self.low if bucket >= 0 else 0)).view(np.int64))
            items.append(rest)
            owners.append([x[local] for x in unpack(o, m, self.owner_types, [np.dtype(t).itemsize for t in self.owner_types])])
            settled.append(np.full(n, bucket < 0))
        *columns, sent = (np.concatenate(x) for x in zip(*items, strict=True))
        settled = np.concatenate(settled)
        return np.concatenate(keys), [np.concatenate(x) for x in zip(*owners, strict=True)], columns, settled, (sent > 0) & ~settled


def reduce_buckets(blobs: DataFrame, reducer, schema: str) -> DataFrame:
    """``reducer(pandas blobs of one bucket) -> pandas`` for every bucket."""

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        out = reducer(pdf)
        give_back()
        return out

    return blobs.groupBy("bucket").applyInPandas(reduced, schema)
