"""Training-order materialisation of token sequences in fixed-stride shards.

Texts become token ids (``tiktoken``; little-endian, two bytes each, four if the vocabulary has
ids above 65535), each followed by an end-of-text id; a task joins them to one stream and cuts it
into sequences of equal length, the last one padded with the end id. The sequences get a gapless
number, and a keyed Feistel network over the next power of four, walked along its cycle until it
lands inside, permutes the numbers: the slot of a sequence is known without sorting or a table,
and the key alone gives the order back. One exchange by ranges of slots, each of whole shards,
puts a shard's slots into one task, in order, which writes a file of ``sequences x stride`` bytes;
slot s is at byte ``(s mod per_shard) * stride`` of shard ``s div per_shard``, so that a reader
resumes anywhere. Before the files, ids travel compressed, with a dictionary trained on a few
sequences (it changes the size on the way only, not what is written).

Files are written under another name and renamed, so a lost or repeated task leaves whole files;
any store that ``pyarrow.fs`` opens will do. A null or empty text is one end id. The same rows over
other partitions give another numbering, but every token is written exactly once; an empty table
writes nothing. Only the text column is read: other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import bound_batches, drop_durable, durable, scratch_dir

SEQUENCE_TOKENS = 1024
PER_SHARD = 4096
ROUNDS = 6
#: Ranges of the exchange: one a shard, and several shards each once there are more shards than this.
RANGES = 20_000
#: Of the dictionary that ids are compressed with on the way: texts it is trained on, their most bytes, its size, and the level.
DICTIONARY_TEXTS, DICTIONARY_TEXT_BYTES, DICTIONARY_BYTES, LEVEL = 400, 1 << 14, 1 << 16, 6


def feistel_slots(index: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..n-1: balanced Feistel rounds, repeated while the result is n or more."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) % (1 << 64)) for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def id_type(path: str, end_id: int) -> np.dtype:
    """The narrowest type of two or four bytes that holds all ids of a vocabulary."""
    return np.dtype("<u2" if max(end_id, *load_ranks(path).values()) < 1 << 16 else "<u4")


def travel_dictionary(docs: DataFrame, path: str, pattern: str, end_id: int, text_col: str) -> bytes:
    """A zstandard dictionary of ids from the DICTIONARY_TEXTS texts of the smallest hashes among those of DICTIONARY_TEXT_BYTES
    at most, whole; empty if these are too few. It changes the bytes in flight, not the result."""
    import tiktoken

    encoder = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    short = docs.select(F.col(text_col).alias("t")).filter(F.octet_length("t").between(1, DICTIONARY_TEXT_BYTES))
    rows = short.orderBy(F.xxhash64("t"), "t").limit(DICTIONARY_TEXTS).collect()
    kind = id_type(path, end_id)
    samples = [encoder.encode_to_numpy(r["t"], disallowed_special=()).astype(kind).tobytes() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _learned(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    if not dictionary:
        return None
    learned = zstandard.ZstdCompressionDict(dictionary)
    learned.precompute_compress(level=LEVEL)
    return learned


def token_sequences(docs: DataFrame, path: str, pattern: str, end_id: int, length: int = SEQUENCE_TOKENS, text_col: str = "text", dictionary: bytes = b"") -> DataFrame:
    """(part, seq_no, n_tokens, tokens): the streams of all tasks in sequences of ``length`` ids, compressed."""
    kind = id_type(path, end_id)
    schema = pa.schema([("part", pa.int32()), ("seq_no", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.binary())])

    def task(batches):
        import tiktoken
        from pyspark import TaskContext

        encoder = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_learned(dictionary))
        part, number, rest, end = TaskContext.get().partitionId(), 0, np.zeros(0, dtype=kind), np.array([end_id], dtype=kind)

        def rows(sequences: list[np.ndarray], used: int) -> pa.RecordBatch:
            k = len(sequences)
            packed = [packer.compress(s.tobytes()) for s in sequences]
            return pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(number, number + k), pa.int64()), pa.array([used] * k, pa.int32()), pa.array(packed, pa.binary())], schema=schema)

        for batch in batches:
            texts = batch.column(0)
            for at in range(0, len(texts), 256):
                parts = [rest]
                for text in texts.slice(at, 256):
                    parts += [encoder.encode_to_numpy(text.as_py() or "", disallowed_special=()).astype(kind), end]
                stream = np.concatenate(parts)
                k = len(stream) // length
                if k:
                    yield rows([stream[i * length : (i + 1) * length] for i in range(k)], length)
                rest, number = stream[k * length :].copy(), number + k
        if len(rest):
            padded = np.full(length, end_id, dtype=kind)
            padded[: len(rest)] = rest
            yield rows([padded], len(rest))

    return bound_batches(docs).select(text_col).mapInArrow(task, "part int, seq_no long, n_tokens int, tokens binary")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    url = urlparse(path)
    return (fs.LocalFileSystem(), url.path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def materialise(docs: DataFrame, path: str, pattern: str, end_id: int, key: int, length: int = SEQUENCE_TOKENS, per_shard: int = PER_SHARD, out_dir: str | None = None, text_col: str = "text") -> DataFrame:
    """Write the shards; one row per sequence: slot, shard, byte_offset, part, seq_no, n_tokens, crc32, file."""
    spark = docs.sparkSession
    folder = out_dir or f"{scratch_dir(spark)}/lodestone/shards-{uuid.uuid4().hex}"
    kind = id_type(path, end_id)
    dictionary = travel_dictionary(docs, path, pattern, end_id, text_col)
    sequences = durable(token_sequences(docs, path, pattern, end_id, length, text_col, dictionary), "sequences")
    counts = sequences.groupBy("part").agg(F.count("*").alias("n"))
    # one row a task of the scan
    offsets = durable(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), "n"), "offsets")
    n = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    @F.pandas_udf("long")
    def slot_of(index):
        import pandas as pd

        return pd.Series(feistel_slots(index.to_numpy(), n, key))

    shards = max(1, -(-n // per_shard))
    wide = -(-shards // RANGES)  # shards of a range
    numbered = sequences.join(offsets.select("part", "base"), "part").withColumn("slot", slot_of(F.col("base") + F.col("seq_no")))
    ranged = numbered.select("slot", F.expr(f"cast(slot div {per_shard} as int)").alias("shard"), "part", "seq_no", "n_tokens", "tokens")
    stride = kind.itemsize * length
    schema = pa.schema([("slot", pa.int64()), ("shard", pa.int32()), ("byte_offset", pa.int64()), ("part", pa.int32()), ("seq_no", pa.int64()), ("n_tokens", pa.int32()), ("crc32", pa.int64()), ("file", pa.string())])

    def write(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        reader = zstandard.ZstdDecompressor(dict_data=_learned(dictionary))
        shard, file, temporary = -1, None, ""

        def close():
            if file is not None:
                file.close()
                store.move(temporary, f"{base}/shard-{shard:06d}.bin")

        for batch in batches:
            rows = batch.to_pydict()
            sums = []
            for s, packed in zip(rows["shard"], rows["tokens"], strict=True):
                if s != shard:
                    close()
                    shard, temporary = s, f"{base}/.{uuid.uuid4().hex}"
                    file = store.open_output_stream(temporary)
                tokens = reader.decompress(packed)
                file.write(tokens)
                sums.append(zlib.crc32(tokens))
            slot = np.array(rows["slot"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(rows["shard"], pa.int32()), pa.array(slot % per_shard * stride), pa.array(rows["part"], pa.int32()), pa.array(rows["seq_no"], pa.int64()), pa.array(rows["n_tokens"], pa.int32()), pa.array(sums, pa.int64()), pa.array([f"shard-{s:06d}.bin" for s in rows["shard"]], pa.string())],
                schema=schema,
            )
        close()

    dealt = ranged.repartitionById(-(-shards // wide), F.expr(f"shard div {wide}").cast("int")).sortWithinPartitions("slot")
    written = durable(dealt.mapInArrow(write, "slot long, shard int, byte_offset long, part int, seq_no long, n_tokens int, crc32 long, file string"), "shard-rows")
    drop_durable(sequences)
    drop_durable(offsets)
    return written


def read_slots(folder: str, first: int, count: int, length: int = SEQUENCE_TOKENS, per_shard: int = PER_SHARD, kind: str = "<u2") -> np.ndarray:
    """Resume reading at a slot: ``count`` sequences as an array of ids, straight from the files."""
    store, base = _store(folder)
    stride = np.dtype(kind).itemsize * length
    out = []
    while count > 0:
        inside = first % per_shard
        k = min(count, per_shard - inside)
        with store.open_input_file(f"{base}/shard-{first // per_shard:06d}.bin") as f:
            f.seek(inside * stride)
            out.append(np.frombuffer(f.read(k * stride), dtype=kind).reshape(-1, length))
        first, count = first + k, count - k
    return np.concatenate(out)
