"""The registered queries as they are registered: contract columns and types, and plain versions of what SQL does not express."""

import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import classifier, mixing, queries, toxicity
from lodestone.llm.training_rows import held_out, labelled_sample, logistic_score

COLUMNS = {
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_histogram_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_repeated_spans": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(name, spark, sf_dir, docs):
    got = queries.queries()[name](spark, sf_dir)
    assert [f"{n} {t}" for n, t in got.dtypes][: COLUMNS[name].count(",") + 1] == COLUMNS[name].split(", ")
    assert got.count() == docs.count()


def test_op1_rows(spark, sf_dir):
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect()}
    rows = queries.op1_image_copies(spark, sf_dir).collect()
    assert {r["page_id"] for r in rows} == ids and len(rows) == len(ids)
    sizes = {}
    for r in rows:
        assert r["component_id"] <= r["page_id"]
        sizes[r["component_id"]] = sizes.get(r["component_id"], 0) + 1
    assert all(r["n_members"] == sizes[r["component_id"]] for r in rows)


def test_op3_is_a_cut_of_the_sorted_table(spark, sf_dir):
    """Shards are ranges of the rows in key order, slots the places inside, cuts within the tolerance or a row."""
    rows = {r["doc_id"]: r for r in queries.op3_histogram_shards(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("a"), F.xxhash64("doc_id").alias("b")).collect()
    at, place = -1, 0
    sizes = [0] * 24
    for d in sorted(docs, key=lambda d: (d["a"], d["b"])):
        r = rows[d["doc_id"]]
        place = place + 1 if r["shard"] == at else 0
        assert r["shard"] in (at, at + 1) or r["shard"] > at
        at = r["shard"]
        assert r["slot"] == place and r["size"] == len(d["text"].encode()) + 8 and r["text_crc32"] == zlib.crc32(d["text"].encode()) and r["law"] == "bytes"
        sizes[at] += r["size"]
    total, run = sum(sizes), 0
    largest = max(r["size"] for r in rows.values())
    for k, size in enumerate(sizes[:-1], 1):
        run += size
        assert abs(run - total * k / 24) <= max(largest, 0.002 * total / 24)


def plain_schedule(weights, counts, n_slots):
    """Earliest deadline first, slot by slot, by the definition."""
    total = sum(Fraction(w) for w in weights.values())
    share = {s: Fraction(w) / total for s, w in weights.items()}
    done, out = dict.fromkeys(weights, 0), []
    for slot in range(n_slots):
        ready = []
        for s in sorted(weights):
            j = done[s]
            if j / share[s] < slot + 1:  # released: floor(j / w) <= slot
                ready.append((-((-(j + 1) / share[s]) // 1), s, j))
        if ready:
            _, s, j = min(ready)
            out.append((s, j))
            done[s] += 1
            if done[s] > counts[s]:
                break
    return out


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 2**0.5, "b": 3**0.5, "c": 5**0.5, "d": 0.01}])
def test_op8_schedule_equals_a_plain_loop(weights):
    counts = dict.fromkeys(weights, 400)
    plan, runs_out = mixing.block_schedule(weights, counts)
    names = sorted(weights)
    want = plain_schedule(weights, counts, 400)
    got = [(names[i], j) for i, j in zip(plan["source"], plan["block"], strict=True)][: min(len(want), runs_out)]
    assert got == want[: len(got)] and len(got) > 300


def test_op8_rows(spark, sf_dir, docs):
    """The registered query: every document in the block that its bytes fall in, deadlines by the exact weights."""
    rows = queries.op8_pfair_mix(spark, sf_dir).collect()
    texts = docs.select("doc_id", "source", F.octet_length("text").alias("n"), F.xxhash64("doc_id", "text").alias("h")).collect()
    weights = mixing.even_tempered_weights(docs)
    total = sum(Fraction(w) for w in weights.values())
    assert sorted(r["doc_id"] for r in rows) == sorted(t["doc_id"] for t in texts)
    splits = mixing.SPLITS
    order = sorted(texts, key=lambda t: ((t["h"] >> 20) % splits, t["h"], t["doc_id"]))
    before, block = {}, {}
    bytes_of = {s: sum(t["n"] for t in texts if t["source"] == s) for s in weights}
    for t in order:
        s = t["source"]
        last = -(-max(1, bytes_of[s]) // mixing.BLOCK_BYTES) - 1
        block[t["doc_id"]] = min(before.get(s, 0) // mixing.BLOCK_BYTES, last)
        before[s] = before.get(s, 0) + t["n"]
    for r in rows:
        w = Fraction(weights[r["source"]]) / total
        assert r["block"] == block[r["doc_id"]] and r["release"] == r["block"] / w // 1 and r["deadline"] == -(-(r["block"] + 1) / w // 1)


def test_mix_of_null_and_empty_sources(spark):
    rows = [(i, "x" * 9, s) for i, s in enumerate(["a", "", None] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = mixing.even_tempered_weights(df)
    assert set(weights) == {None, "", "a"}
    got = mixing.pfair_mix(df, weights, block_bytes=9).collect()
    assert len({r["position"] for r in got}) == 120 and {(r["source"], r["block"]) for r in got} == {(s, b) for s in ("a", "", None) for b in range(40)}


def test_mix_has_a_bounded_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 10)
    df = spark.createDataFrame([(i, "x" * 100, "s") for i in range(1000)], "doc_id long, text string, source string")
    assert mixing.pfair_mix(df, {"s": 1.0}, block_bytes=1).agg(F.max("position")).first()[0] == 9


@pytest.mark.parametrize(("name", "module", "label", "parts", "part"), [("op6_toxicity", toxicity, "toxic", 4, 2), ("op10_quality_classifier", classifier, "quality", 5, 0)])
def test_scores_equal_a_plain_scorer(name, module, label, parts, part, spark, sf_dir, docs):
    """Each text on its own, word after word, by the model that the same rows give."""
    rows = labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label, held_out(parts, part), module.MAX_TRAINING_ROWS)
    model = module.train(rows)
    texts = dict(docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, sf_dir).collect()}
    for d, text in texts.items():
        if module is toxicity:
            words = toxicity._fold(text).split()
            difference = np.array([model.differences([w])[0] for w in words], dtype=float)
            want = logistic_score(toxicity.features(np.zeros(len(words), dtype=np.int64), difference, 1), model.weights)[0]
        else:
            lower = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
            total, n = np.zeros(2), 0
            for word in lower.split():
                ids, _ = classifier.word_features([word])
                total += (model.vectors[ids] @ model.output.T).sum(0)
                n += len(ids)
            z = total / max(n, 1) + model.bias
            want = 1 / (1 + np.exp(z[0] - z[1]))
        assert abs(got[d]["score"] - want) < 1e-9 and got[d]["predicted"] == int(got[d]["score"] >= 0.3)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % parts == part)
