"""Findings of round 4 on the training-data operators, one test each."""

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import exchange, suffix_dedup


@pytest.mark.parametrize("bits", [6, 7, 8, 9, 20])
def test_keys_survive_any_number_of_buckets(bits):
    """with seven bytes a key, 128 buckets were the most: larger tables (192 million keys) failed by an overflow."""
    keys = np.array([1, 5, 1 << 56, (1 << 63) + 9, (1 << 64) - 1, (1 << 64) - 1], dtype=np.uint64)
    packer = exchange.Packer(bits, [np.int64], [np.uint32], key_bytes=7)
    packer.add(keys, np.zeros(len(keys), dtype=np.int64), [np.arange(len(keys))], [np.array([7])])
    blobs = pd.concat([b.to_pandas() for b in packer.flush(force=True)])
    found = {}
    for _, one in blobs.groupby("bucket"):
        names, _, (item,), _, _ = packer.open(one)
        found |= dict(zip(item.tolist(), names.tolist(), strict=True))
    assert len(found) == len(keys)
    kept = keys >> np.uint64(max(0, 8 - bits))
    assert [found[i] == found[j] for i in range(6) for j in range(6)] == [bool(kept[i] == kept[j]) for i in range(6) for j in range(6)]


def test_repeats_do_not_depend_on_the_number_of_buckets(spark, monkeypatch):
    """the same spans from hundreds of buckets, as tables of many GB have them."""
    draw = np.random.default_rng(4)
    word = lambda: "".join(map(chr, draw.integers(97, 123, 6)))
    shared = " ".join(word() for _ in range(90))
    texts = [" ".join(word() for _ in range(60)) + f" {shared[7 * i :]} " + " ".join(word() for _ in range(60)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda: sorted(map(str, suffix_dedup.repeated_spans(docs, threshold=200, also=(231,)).collect()))
    want = rows()
    monkeypatch.setattr(exchange, "BUCKET_KEYS", 1)
    assert exchange.bucket_bits(2 * sum(map(len, texts)) // 72) > 8
    assert len(want) == 12 and rows() == want
