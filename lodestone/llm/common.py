"""Shared helpers of the training-data operators.

Two kinds of helper live here: durable intermediate tables (lineage is cut by a Parquet
table in the folder that ``spark.checkpoint.dir`` names, so a lost executor never costs more
than its own tasks), and vectorised byte arithmetic for Arrow batches (word spans, rolling
polynomial hashes modulo a prime, bit mixing).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most text bytes that a task turns into numpy arrays at once (a longer text is one slice).
SLICE_BYTES = 1 << 19

#: Bytes that are hashed, or looked through for anchors, at once: a longer text is taken in pieces.
PIECE_BYTES = 1 << 20

_WORD_BREAK = np.zeros(256, dtype=bool)
_WORD_BREAK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Multiplier of sums of few hashes, modulo 2**64.
_STEP = 0x9E3779B97F4A7C15
#: Rolling hashes are polynomials modulo this prime (so that folding the high bits onto the low ones reduces), each lane
#: with a base and byte codes of its own, drawn at random once.
PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_DRAWN = np.random.default_rng(20240229)
_BASES = [int(x) for x in _DRAWN.integers(1 << 20, PRIME - 1, 4)]
_BYTE_CODES = [_DRAWN.choice(PRIME - 1, 256, replace=False).astype(np.uint64) + np.uint64(1) for _ in range(4)]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``, or a
    fresh local folder when none is set and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: its cleaner goes by the
    driver's garbage collection, which a long job with little on the driver's heap hardly ever needs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    free_shuffles(spark)
    path = f"{scratch_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`durable` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/lodestone/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_way(df: DataFrame, *added: str) -> DataFrame:
    """``df`` without columns of the names that an operator adds (Spark compares names without case): in all
    operators an input column of such a name gives way to the new one."""
    names = {c.lower() for c in added}
    return df.drop(*(c for c in df.columns if c.lower() in names))


def set_aside(df: DataFrame, *used: str):
    """``df`` with its columns renamed, but for those in ``used``, so that none clashes; and how to name
    them back (further columns follow)."""
    names = [c if c in used else f"_column_{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), lambda out, *more: out.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)), *more)


#: Rows of an Arrow batch: texts make rows large, and each task holds a few batches on both sides.
BATCH_ROWS = 500


def bound_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, after its session's Arrow batches are limited to BATCH_ROWS rows (a smaller limit stays)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return freed memory of this Python worker to the system: Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about ``max_bytes``: (first row, end row, bytes, offsets).

    A null text counts as empty. ``offsets`` has one entry more than the run has rows."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        end = min(max(end, first + 1), len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~_WORD_BREAK[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _folded(x: np.ndarray) -> np.ndarray:
    """Equal modulo PRIME, and under 2**32 for what is under 2**62."""
    return (x & _P) + (x >> _BITS)


class RollingHash:
    """Hashes of arbitrary spans of a byte array from prefix sums: two polynomials, 62 bits together.

    Two different spans of n bytes agree in both for n * n in 2**62 of the bases at most, whatever their bytes."""

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray, second: bool = False):
        """``second``: hashes by other bases and codes, independent of the usual ones."""
        n = len(data)
        self.lanes = (2, 3) if second else (0, 1)
        self.prefixes = []
        for lane in self.lanes:
            prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_folded(_BYTE_CODES[lane][data] * self._table(lane, n, 1)[:n]), out=prefix[1:])
            self.prefixes.append(prefix)

    @classmethod
    def _table(cls, lane: int, n: int, sign: int) -> np.ndarray:
        """Powers of a lane's base (sign -1: of its inverse), n + 1 at least."""
        key = sign * (lane + 1)
        table = cls._powers.get(key, np.ones(1, dtype=np.uint32))
        if len(table) <= n:
            base = pow(_BASES[lane], sign, PRIME)
            while len(table) <= n:
                step = np.uint64(pow(base, len(table), PRIME))
                table = np.concatenate([table, (table * step % _P).astype(np.uint32)])
            cls._powers[key] = table
        return table

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        both = np.zeros(len(starts), dtype=np.uint64)
        for lane, prefix in zip(self.lanes, self.prefixes, strict=True):
            raw = _folded(_folded(prefix[ends] - prefix[starts]))
            raw = _folded(_folded(raw * self._table(lane, len(prefix), -1)[starts]))
            raw -= (raw >= _P) * _P
            both = (both << _BITS) | raw
        return mix(both + np.asarray(ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """:class:`RollingHash` of spans in the order of their starts, a piece of the bytes at a time (a longer span is one piece)."""
    out, at = np.zeros(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE_BYTES)))
        low, high = int(starts[at]), int(ends[at:stop].max())
        out[at:stop] = RollingHash(data[low:high], second).spans(starts[at:stop] - low, ends[at:stop] - low)
        at = stop
    return out


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A number for every window of ``width`` bytes (a power of two), to order windows by: equal bytes, equal numbers."""
    x, done, steps = _BYTE_CODES[0][data], 1, np.random.default_rng(7)
    while done < width:
        x = x[:-done] + x[done:] * np.uint64(int(steps.integers(1 << 60, 1 << 62)) * 2 + 1) if len(x) > done else x[:0]
        done *= 2
    return mix(x)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of all word shingles (A-Z lower-cased, repeats kept).

    A text with 1 to width - 1 words has one shingle, all its words; one without words none."""
    data = _LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    if len(starts) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    words = span_hashes(data, starts, ends)
    steps = [np.uint64(pow(_STEP, 2 * k + 3, 1 << 64)) for k in range(width)]
    out_rows, out = [], []
    if len(words) >= width:
        n = len(words) - width + 1
        whole = rows[:n] == rows[width - 1 :]
        total = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            total += words[k : k + n] * steps[k]
        out_rows.append(rows[:n][whole])
        out.append(mix(total[whole]))
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        total = counts[short].astype(np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            total[has] += words[first[short[has]] + k] * steps[k]
        out_rows.append(short)
        out.append(mix(mix(total)))
    return np.concatenate(out_rows), np.concatenate(out)
