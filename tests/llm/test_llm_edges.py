"""Words made to collide, missing labels, long texts, many small rows, ids of other types."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import classifier, common, media, ngram_join, queries, sharding, suffix_dedup, toxicity
from lodestone.llm.training_rows import held_out, labelled_sample


def thue_morse(n):
    """The sequence of n letters, and its complement: equal under any polynomial modulo 2**64 from 1024 letters on."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("second", [False, True])
def test_hashes_tell_made_words_apart(second):
    rng = np.random.default_rng(1)
    for n in (512, 1024, 2048, 4096):
        data = np.frombuffer("".join(thue_morse(n)).encode(), dtype=np.uint8)
        a, b = common.RollingHash(data, second).spans(np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    starts = np.arange(4000)
    names = common.RollingHash(data, second).spans(starts, starts + 24)
    raw = data.tobytes()
    assert len(set(names.tolist())) == len({raw[i : i + 24] for i in range(4000)})


def test_hashes_by_pieces(monkeypatch):
    data = np.random.default_rng(2).integers(97, 101, 3000).astype(np.uint8)
    starts = np.arange(0, 2900, 3)
    ends = starts + 1 + starts % 97
    whole = common.RollingHash(data).spans(starts, ends)
    monkeypatch.setattr(common, "PIECE_BYTES", 100)
    assert np.array_equal(common.span_hashes(data, starts, ends), whole)


@pytest.mark.parametrize("size", [300, 1500])
def test_anchors_by_pieces(size):
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 4000).astype(np.uint8)
    data = np.concatenate([base, base[:500], np.full(300, 97, dtype=np.uint8), base[100:900]])
    for threshold in (400, 64):
        shape = suffix_dedup.Shape(threshold, threshold)
        _, names, items = suffix_dedup._first_ranks(data, np.array([0, len(data)]), shape)
        parts = list(suffix_dedup._pieces(data, np.array([0, len(data)]), shape, size))
        assert np.array_equal(np.concatenate([p[1] for p in parts]), names)
        assert all(np.array_equal(np.concatenate([p[2][c] for p in parts]), x) for c, x in enumerate(items))


def test_made_words_neither_link_nor_go(spark):
    rows = [(i, w) for i, w in enumerate(w for n in (512, 1024, 2048, 4096) for w in thue_morse(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["component_id"], r["n_links"]) for r in ngram_join.ngram_components(df).collect()} == {(i, 0) for i in range(8)}
    one = spark.createDataFrame([(0, thue_morse(1024)[0]), (1, thue_morse(1024)[1])], "doc_id long, text string")
    assert suffix_dedup.repeated_spans(one, threshold=1024).count() == 0


def test_ids_of_other_types(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([("b", text), ("a", text + " x"), (None, text), ("c", "other words here")], "name string, text string")
    found = {r["id"]: r["component_id"] for r in ngram_join.ngram_components(df, "name").collect()}
    assert found == {"a": "a", "b": "a", None: "a", "c": "c"}


def labels_of(docs, column, value):
    return docs.select("doc_id", F.lit(value).alias(column))


@pytest.mark.parametrize(("module", "label", "parts", "part"), [(toxicity, "toxic", 4, 2), (classifier, "quality", 5, 0)])
def test_without_labels_of_both_classes(module, label, parts, part, docs):
    few = docs.limit(30)
    for labels in (labels_of(few, label, 1).limit(0), labels_of(few, label, 1), labels_of(few, label, 0), labels_of(few, label, None)):
        rows = queries._scored(few, labels, module, label, parts, part).collect()
        assert len(rows) == 30 and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in rows)


def test_pipeline_keeps_the_corpus_without_labels(spark, docs, tmp_path):
    docs.select("doc_id", F.lit(0).alias("quality"), F.lit(1).alias("toxic")).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == docs.count()


def test_sample_passes_over_what_does_not_fit(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.training_rows.MAX_SAMPLE_BYTES", 1000)
    rows = [(i, "x" * (5000 if i % 2 else 20) + str(i)) for i in range(40)] + [(0, "again")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1)], "doc_id long, toxic int")
    found = labelled_sample(docs, labels, "toxic", held_out(1, 5), 100)
    assert len(found) == len(set(found)) and sum(len(t) for t, _ in found) <= 1000
    assert {t for t, _ in found} == {t for i, t in rows if len(t) < 1000}  # the long ones are passed over, repeated rows count once
    assert len(labelled_sample(docs, labels, "toxic", held_out(1, 5), 7)) <= 7


def test_parts_of_small_rows(spark, monkeypatch):
    """Rows without text gather in few shards by the law of bytes; a task still gets PART_ROWS rows and a little at most."""
    rows = [(i, None if i % 20 else "t" * 700 + str(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.histogram_shards(df, 6).collect()}
    monkeypatch.setattr(sharding, "PART_ROWS", 250)
    placed = sharding.histogram_shards(df, 6)
    found = {r["doc_id"]: (r["shard"], r["slot"]) for r in placed.collect()}
    assert found == plain
    by_shard = {}
    for shard, slot in found.values():
        by_shard.setdefault(shard, []).append(slot)
    assert max(map(len, by_shard.values())) > 1000 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_null_pages_stand_alone(spark):
    pages = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "")], "page_id long, html string")
    images = media.render_pages(pages)
    assert images.filter("image is null").count() == 3
    found = {r["page_id"]: r["component_id"] for r in media.image_copies(images, "page_id", "image").collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4}


def test_last_stage_keeps_all_columns(spark, awkward):
    docs = awkward.drop("lang", "n_chars").withColumns({"N_Tokens": F.lit(1), "extra": F.lit("e")})
    out = corpus_pipeline.encode(spark, docs, "")
    assert out.columns == [c for c in docs.columns if c.lower() not in ("n_tokens", "ids")] + ["n_tokens", "ids"] and out.count() == docs.count()
    assert {r["extra"] for r in out.collect()} == {"e"}
