"""Golden vectors of operators that SQL does not express, and edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import values as V
from lodestone.operators import chunking as C
from lodestone.operators import cleaning as CL
from lodestone.operators import evaluation as E
from lodestone.operators import graph as G
from lodestone.operators import lifecycle as L
from lodestone.operators import retrieval as R
from lodestone.operators import scope as S
from lodestone.sources import connectors, files, html, jsonl, markdown
from lodestone.sources.store import Store
from lodestone.streaming import jobs


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, item string, rank int")


def test_rrf_union_ties_and_zero_weight(spark):
    d, s = hits(spark, [(1, "a", 1), (1, "b", 2)]), hits(spark, [(1, "b", 1), (1, "c", 2)])
    fused = {r["item"]: r["score"] for r in R.weighted_rrf(d, s, "item", 0.7).collect()}
    assert fused == pytest.approx({"a": 0.7 / 61, "b": 0.7 / 62 + 0.3 / 61, "c": 0.3 / 62})
    assert {r["item"] for r in R.weighted_rrf(d, s, "item", 1.0).collect()} == {"a", "b"}
    assert {r["item"] for r in R.weighted_rrf(d, s, "item", 0.0).collect()} == {"b", "c"}
    tie = R.weighted_rrf(hits(spark, [(1, "y", 1)]), hits(spark, [(1, "x", 1)]), "item", 0.5).orderBy("rank").collect()
    assert [r["item"] for r in tie] == ["x", "y"]


def test_ranked_unique_keeps_gaps(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, None, 3), (1, "b", 4)], "q int, item string, pos int")
    assert sorted((r["item"], r["rank"]) for r in R.ranked_unique(df, "q", "item", ["pos"]).collect()) == [("a", 1), ("b", 4)]


def test_metrics_count_duplicates_once(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "query_id int, rank int, chunk_id string")
    judged = spark.createDataFrame([(1, "a", 3, "gold_manual", None), (1, "b", 2, "business_import", None), (1, "c", 1, "gold_manual", None)], "query_id int, chunk_id string, grade int, source string, weight double")
    m = E.query_metrics(results, judged, 3).first()
    assert m["precision"] == pytest.approx(1.7 / 3) and m["recall"] == pytest.approx(1.0) and m["mrr"] == 1.0
    assert m["ap"] == pytest.approx((1.0 * 1.0 / 1 + 0.7 * 1.7 / 3) / 1.7)
    none = E.query_metrics(results, judged.limit(0), 3).first()
    assert none["recall"] == none["ndcg"] == none["mrr"] == 0.0


def test_strategies_and_terms(spark):
    rows = [("",), ("def f",), ("为什么",), ("short",), ("a much longer question that goes on?",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.retrieval_strategy(F.col("t"))).collect()]
    assert got == ["deep", "precise", "deep", "light", "deep"]
    assert spark.range(1).select(T.half_width(F.lit("ＡＢ１　x"))).first()[0] == "AB1 x"
    cut = spark.range(1).select(T.utf8_truncate(F.lit("aéé"), 4).alias("c"), T.utf8_truncate(F.lit("ab"), 9).alias("d")).first()
    assert (cut["c"], cut["d"]) == ("aé", "ab")


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_scopes(spark):
    df = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c",)], "uri string")
    assert {r[0] for r in S.path_scope(df, "uri", ["/a"]).collect()} == {"/a", "/a/b"}
    assert S.path_scope(df, "uri", []).count() == 0 and S.path_scope(df, "uri", None).count() == 4
    assert {r[0] for r in S.compact_paths(df, "uri").collect()} == {"/a", "/ab", "/c"}
    with pytest.raises(ValueError):
        S.path_scope(df, "uri", ["/a/../b"])
    meta = spark.createDataFrame([('{"k":"5"}',), ('{"k":"x"}',), ("{}",)], "m string")
    # a conjunction whose first condition matches nothing stays empty
    assert S.metadata_filter(meta, "m", [("k", "=", "zzz"), ("k", ">", "1")]).count() == 0
    assert S.metadata_filter(meta, "m", [("k", "empty")]).count() == 1


def test_chunkers():
    assert C.merge_sections(["a" * 40, "b" * 40, "c" * 40], 15) == ["a" * 40 + "\n" + "b" * 40, "c" * 40]
    assert C.merge_sections([], 10) == []
    parts = C.split_recursive("one two three. " * 200, 50)
    assert "".join(parts) == "one two three. " * 200 and all(len(p) // 4 <= 50 for p in parts)
    chunks = C.chunk_structured(["# A", "x " * 300, "# B", "y"], 100)
    assert {t for t, _ in chunks} == {"A", "B"} and not any("x" in c and "y" in c for _, c in chunks)
    assert C.chunk_structured(["no heading"], 50)[0][0] == ""
    assert C.heading_paths([1, 2, 0, 1], ["a", "b", "t", "c"]) == ["a", "a > b", "a > b", "c"]
    assert C.pack([3, 3, 9, 1], 6) == [0, 0, 1, 2]


def test_cleaning_block_and_title(spark):
    text = "# T\nT\n来源: x\n附件：\n\n1. file\nbody\n\n\nend\n第 3 页"
    r = CL.clean_lines(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text").orderBy("id").collect()
    assert r[0]["clean"] == "# T\nbody\n\nend" and r[0]["removed_title"] == 1
    assert (r[0]["removed_source"], r[0]["removed_attachment"], r[0]["removed_separator"]) == (1, 2, 1)
    assert r[1]["clean"] == ""
    same = spark.createDataFrame([(1, "b", "some text that is long enough"), (2, "a", "some text that is long enough")], "id int, name string, text string")
    d = {x["id"]: x for x in CL.decide(CL.clean_lines(same, "id", "text").join(same.select("id", "name"), "id"), "id", "name").collect()}
    assert d[1]["reason"] == "duplicate" and d[1]["kept_by"] == 2 and d[2]["decision"] == "kept"


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("x", "y", 2.0)], "src string, dst string, weight double")
    assert dict(G.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    pr = dict(G.pagerank(e).collect())
    assert sum(pr.values()) == pytest.approx(1.0) and pr["b"] > pr["a"]
    assert {tuple(r["path"]) for r in G.paths(e, spark.createDataFrame([("a",)], "name string"), 3).collect()} == {("a", "b"), ("a", "b", "c")}
    names = spark.createDataFrame([("ALPHA 1", "T"), ("ALPHA 2", "T"), ("BETAS", "T"), ("BETA", "T")], "name string, type string")
    assert [tuple(r) for r in G.resolution_candidates(names).collect()] == [("BETA", "BETAS")]


def test_resolution_equals_all_pairs(spark):
    rng = random.Random(5)
    names = ["TIM", "JIM", "CATHERINE", "KATHERINE", "", "A", "AB", "BA", "AAAA", "AAA", "A1", "B1", "1", "PART 12", "KART 12", "KART 13", "x\ty", "王伟", "王伟明", "伟王", "李", "北京大学医院", "北京大学医学院", "Ægir", "Ægirs", "Agir", "ABé", "ABC"]
    names += ["".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["".join(rng.choice("abé1") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = sorted({(x, "T") for x in names} | {(x, "U") for x in names[:20]})
    n = spark.createDataFrame(rows, "name string, type string")
    pairs = n.withColumnRenamed("name", "a").join(n.withColumnRenamed("name", "b"), "type").filter("a < b")
    want = sorted(tuple(r) for r in pairs.filter(G.similar_names(F.col("a"), F.col("b"))).select("a", "b").collect())
    got = sorted(tuple(r) for r in G.resolution_candidates(n).collect())
    assert got == want
    assert {("JIM", "TIM"), ("CATHERINE", "KATHERINE"), ("KART 12", "PART 12"), ("王伟", "王伟明")} <= set(got) and ("KART 12", "KART 13") not in got


def test_quotas_and_deletion(spark):
    p = spark.createDataFrame([(1, 10, 3.0, 5), (2, 10, 1.0, 5), (3, 1, 1.0, 5), (4, 5, 9.0, 0)], "workspace int, pending long, weight double, free long")
    q = {r["workspace"]: r["quota"] for r in L.fair_quotas(p, 8).collect()}
    assert q == {1: 4, 2: 2, 3: 1} and sum(q.values()) <= 8
    f = spark.createDataFrame([("/a/x", None), ("/ab", None)], "uri string, deleted_at timestamp")
    marked = L.soft_delete(f, "/a", F.lit("2024-01-01").cast("timestamp"))
    assert [r["uri"] for r in L.purge(marked, "/a", F.lit("2024-02-01").cast("timestamp")).collect()] == ["/ab"]


def test_parsers(spark, tmp_path):
    assert html.parse_blocks("<h2>T</h2><p>a<script>x</script> b</p><table><tr><td>1</td><td>2</td></tr></table>") == [("heading", "## T"), ("text", "a b"), ("table", "1 | 2")]
    assert html.split_table(["h", "a" * 40, "b" * 40], 10) == ["h\n" + "a" * 40, "h\n" + "b" * 40]
    assert jsonl.is_jsonl('{"a":1}\n{"b":2}') and not jsonl.is_jsonl('{"a":\n1}')
    parts = jsonl.split_value({"a": "x" * 50, "b": {"c": "y" * 50}}, 70)
    assert len(parts) == 2 and parts[1]["b"]["c"] == "y" * 50
    md = markdown.elements(spark.createDataFrame([(1, "# H\ntext\n\n- a\n- b\n```\n# no\n```")], "id int, t string"), "id", "t").orderBy("element").collect()
    assert [(r["kind"], r["level"]) for r in md] == [("heading", 1), ("text", None), ("list", None), ("code", None)]
    (tmp_path / "m.eml").write_bytes(b"Subject: S\nFrom: a@b\nTo: c@d\n\nhello")
    (tmp_path / "g.txt").write_bytes("中文".encode("gb18030"))
    read = files.read_files(spark, str(tmp_path))
    mail = read.filter("parser = 'mail'").select(files.parse_mail("content").alias("m")).first()["m"]
    assert mail["subject"] == "S" and mail["body"].strip() == "hello"
    assert read.filter("parser = 'text'").select(files.decode_text("content")).first()[0] == "中文"


def test_store_and_connector(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c")], "id int, file int, t string")
    store = Store(spark, f"file://{tmp_path}/store", "id", "file")
    assert store.insert(rows) == 3
    store.replace_files(spark.createDataFrame([(4, 10, "d")], "id int, file int, t string"))
    store.update(F.col("id") == 3, {"t": F.lit("z")})
    before = store._pointer()
    store.delete(F.col("id") == 4)
    assert [(r["id"], r["file"], r["t"]) for r in store.read().collect()] == [(3, 11, "z")]
    now = store._pointer()
    with pytest.raises(RuntimeError):
        store.switch(now, expected="v-other")
    assert store.switch(before, expected=now) == now
    assert {r["id"] for r in store.read().collect()} == {3, 4}
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "page-0.jsonl").write_text(json.dumps({"id": 1, "text": "x", "updated_at": 5}) + "\nbroken\n")
    (pages / "page-1.jsonl").write_text(json.dumps({"id": 2, "text": "y", "updated_at": 9}) + "\n")
    connectors.register(spark)
    got = spark.read.format("paged").option("path", str(pages)).option("after", "5").load().collect()
    assert sorted(r["id"] or "" for r in got) == ["", "2"]


def test_stream_equals_batch(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert jobs.windowed_counts(spark, sf_dir).agg(F.sum("n")).first()[0] == n


def test_stream_goes_on_from_its_state(spark, sf_dir, tmp_path):
    """Two runs with one folder, more files for the second: the state counts each file once."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    table, out = f"{tmp_path}/t/events.parquet", f"file://{tmp_path}/job"
    rows.filter("event_id % 2 = 0").write.parquet(table)
    jobs.latest_state(spark, f"{tmp_path}/t", out)
    rows.filter("event_id % 2 = 1").write.mode("append").parquet(table)
    got = {r["user_id"]: (r["n"], r["last_event"]) for r in jobs.latest_state(spark, f"{tmp_path}/t", out).collect()}
    want = {r["user_id"]: (r["n"], r["m"]) for r in rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("m")).collect()}
    assert got == want
    again = {r["user_id"]: (r["n"], r["last_event"]) for r in jobs.latest_state(spark, f"{tmp_path}/t", out).collect()}
    assert again == want


def test_scan_bm25_equals_the_index(spark, sf_dir):
    """Scores straight from the texts are those of the inverted rows, and no document crosses an exchange before the top-k."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(-1, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    q = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id < 4").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size(T.words(F.col("text"))), F.lit(0))).alias("avgdl"))
    want = {(r["query_id"], r["id"]): r["score"] for r in R.bm25(R.term_table(docs, "doc_id", "text"), stats, q).collect()}
    scan = R.scan_bm25(docs, "doc_id", "text", q)
    got = {(r["query_id"], r["id"]): r["score"] for r in scan.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) > 10
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(doc_id" not in plan


def test_terms(spark):
    from lodestone.functions import terms as X

    texts = ["see GB/T 19001-2016, a-b_c and A1B2C, ＡB-12; word", "", None, "x/y/z-1 GB/T  7-8.9 gb/t 7-8.9 ab12 abc12 12345", "v1.2.", "y" * 130 + "-1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.exact_terms(F.col("t"))).collect()]
    assert got == [["gb/t 19001-2016", "a-b_c", "a1b2c", "ab-12"], [], [], ["x/y/z-1", "gb/t 7-8.9", "abc12"], ["v1.2"], []]
    numbers = {"42": 42, "-3": -3, "twenty one": 21, "two hundred and five": 205, "十二": 12, "一百零三": 103, "两万三千": 23000, "XIV": 14, "none": -1, "": -1}
    assert {t: X.read_number(t) for t in numbers} == numbers
    df = spark.createDataFrame([("what is the plan",), ("is the",), (None,)], "q string")
    assert [r[0] for r in df.select(X.without_question_words(F.col("q"))).collect()][0] == " the plan"  # one pass: the blank before "the" is used up
    fixed = spark.createDataFrame([("```json\n{\"a\": [1,],}\n```",), ("none",)], "t string").select(X.repair_json("t")).collect()
    assert [r[0] for r in fixed] == ['{"a": [1]}', None]


def test_search_rules(spark):
    from lodestone.operators import expansion as X

    assert X.plan_search(10, 0.7, True, "light", [1]).limit == 30
    assert X.plan_search(10, 0.7, False, "precise", [1]).limit == 20
    assert X.plan_search(10, 0.7, False, "deep", []).limit == 0
    assert not X.plan_search(10, 0.7, False, "deep", None).sparse and X.plan_search(10, 0.0, False, "deep", [1]).dense is False
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    calls = []

    def search(share, similarity):
        calls.append(share)
        return rows.filter(F.lit(share < 0.2))

    assert X.search_with_retry(search).count() == 2 and calls == [0.3, 0.1]
    found = X.research("q", lambda q: rows.filter(F.col("id") <= len(q)), lambda q, _: [q + "x"], "id")
    assert sorted(r["id"] for r in found.collect()) == [1, 2]


def test_clusters_of_two_clouds(spark):
    import numpy as np

    from lodestone.operators import clustering as K

    rng = np.random.default_rng(0)
    rows = [(str(i), [float(x) for x in rng.normal(8 * (i % 2), 1, 4)]) for i in range(60)]
    got = {r["id"]: r["cluster"] for r in K.best_clusters(spark.createDataFrame(rows, "id string, embedding array<double>"), "id", "embedding", 3).collect()}
    even = {got[i] for i in got if int(i) % 2 == 0}
    assert even.isdisjoint({got[i] for i in got if int(i) % 2})
    assert K.best_clusters(spark.createDataFrame(rows[:2], "id string, embedding array<double>"), "id", "embedding").count() == 2
    # overlapping clouds: the first cluster of more than a tenth, not the likeliest
    rng = random.Random(2)
    near = spark.createDataFrame([(f"{c}{i}", [rng.gauss(2.6 * c, 1.0), rng.gauss(0, 1.0)]) for c in range(2) for i in range(150)], "id string, embedding array<double>")
    soft = K.best_clusters(near, "id", "embedding", 2).collect()
    assert all(abs(sum(r["memberships"]) - 1) < 1e-6 and r["cluster"] == next(k for k, p in enumerate(r["memberships"]) if p > K.MEMBERSHIP) for r in soft)
    assert any(r["memberships"][r["cluster"]] < max(r["memberships"]) for r in soft)
    skipped = spark.createDataFrame([(".XLSX", False), ("pdf", True), ("pdf", False), ("txt", True)], "e string, t boolean").select(K.skip_clustering(F.col("e"), F.col("t"))).collect()
    assert [r[0] for r in skipped] == [True, True, False, False]


def test_expiring_cache(spark, tmp_path):
    rows = [("k", "v1", "2024-01-01 00:00:00"), ("k", "v2", "2024-01-01 12:00:00"), ("k", "v3", "2024-01-03 00:00:00")]
    spark.createDataFrame(rows, "key string, value string, ts string").selectExpr("key", "value", "cast(ts as timestamp) as ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, value string, ts timestamp").parquet(f"{tmp_path}/in").withWatermark("ts", "10 days")
    q = jobs.expiring_cache(stream).writeStream.format("memory").queryName("cache").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["value"], r["hit"]) for r in spark.sql("select * from cache").collect()) == [("v1", False), ("v1", True), ("v3", False)]


def test_registry_and_embedding(spark):
    from lodestone.operators.pipeline import Pipeline, Registry, embed_once

    chunkers = Registry("chunker")
    chunkers.register("one")(lambda df: df.withColumn("n", F.lit(1)))
    with pytest.raises(KeyError):
        chunkers.get("two")
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    assert Pipeline(chunkers.get("one"), lambda d: d.filter("t is not null"))(df).count() == 2
    assert [r["embedding"] for r in embed_once(df, "t", lambda texts: [[float(len(x))] for x in texts]).orderBy("t").collect()] == [None, [1.0], [1.0]]
