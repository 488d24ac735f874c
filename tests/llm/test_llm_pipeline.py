"""The pipeline, each stage against brute force on its own input."""

import corpus_pipeline
from test_llm_text import brute_components, brute_runs

from lodestone.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        results[name] = (before, spark.read.parquet(f"{tmp_path}/{name}"))
        before = results[name][1]
        if name != "byte_bpe":
            assert before.columns == columns
    was, now = results["toxicity"]
    toxic = {r["doc_id"] for r in queries.toxicity_scores(was, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in was.collect()} - toxic
    was, now = results["near_copies"]
    rows = [(r["doc_id"], r["text"]) for r in was.collect()]
    assert {r["doc_id"] for r in now.collect()} == {d for d, _, c in brute_components(rows) if d == c}
    was, now = results["repeated_passages"]
    rows = [(r["doc_id"], r["text"]) for r in was.collect()]
    long_runs = {d: [x for x in runs if len(x.split()) >= 50] for d, runs in brute_runs(rows, 200)}
    got = {r["doc_id"]: r for r in now.collect()}
    assert got.keys() == long_runs.keys() and any(long_runs.values())
    for d, text in rows:
        left = len(text.encode()) - sum(map(len, long_runs[d]))
        # only the bytes of characters that a cut splits may be missing besides
        assert left - 6 * len(long_runs[d]) <= len(got[d]["text"].encode()) <= left and got[d]["n_chars"] == len(got[d]["text"])
        assert long_runs[d] or got[d]["text"] == text
    was, now = results["mixing"]
    assert sorted(map(str, was.collect())) == sorted(map(str, now.collect()))
    was, now = results["byte_bpe"]
    texts = {r["doc_id"]: r["text"] for r in was.collect()}
    assert {r["doc_id"]: r["text"] for r in now.collect()} == texts
    assert all(r["n_tokens"] == len(r["ids"]) for r in now.collect())


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows(spark, awkward, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows and columns of clashing names through all stages."""
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        last = name == "byte_bpe"
        assert docs.columns == [c for c in awkward.columns if not (last and c == "ids")] + ["n_tokens", "ids"] * last
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() > 0
