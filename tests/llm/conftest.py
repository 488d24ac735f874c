import random

import pytest
from pyspark.sql import functions as F

CLASHING = "n_words Kept base_failed size text_crc32 shard slot block position release n_shingles component_id n_links hot ids starts n_split decoded held_out predicted n_bytes k1 r1 bucket".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, spans int, score double"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, equal texts, and columns whose names clash with the operators' own."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    long = " ".join(rng.choice(words) for _ in range(30000))
    near = " ".join(rng.choice(words) for _ in range(300))
    edited = near.split()
    edited[100] = "ä€𝄞"
    texts = [None, "", " \t\n", "one", "One  two\nthree four", long, near, near, " ".join(edited), near[:1200], "é" * 900, near.upper(), "x " * 500]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i == 4 else f"s{i % 2}", len(t or ""), "k", 7, 1, 0.5) for i, t in enumerate(texts)]
    rows += [rows[6], (None, near, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
