"""Whole results and even work, one test a finding."""

import duckdb

from lodestone import plans
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R


def test_paths_follow_all_edges_of_a_hub(spark):
    """paths followed the 64 (in jn18 the 16) heaviest edges of a node."""
    edges = [("a", "hub", 1.0)] + [("hub", f"n{i:03}", float(i % 7)) for i in range(300)] + [("n000", "z", 2.0)]
    found = G.paths(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([("a",)], "name string"), 3).collect()
    want = {("a", "hub"): 1.0, ("a", "hub", "n000", "z"): 3.0} | {("a", "hub", f"n{i:03}"): 1.0 + i % 7 for i in range(300)}
    assert {tuple(r["path"]): r["weight"] for r in found} == want and len(found) == len(want)


def test_matches_are_spelled_out_in_all_tasks(spark):
    """few matches stand for many pairs; all of them were made in one task, as the matches themselves are small."""
    docs = spark.range(3000).selectExpr("id", "array('a', if(id % 3 = 0, 'b', 'c')) as name", "array('t') as type")
    asked = spark.range(40).selectExpr("id as query_id", "explode(array('a', if(id % 2 = 0, 'b', 'd'), 'e')) as term")
    found = R.multi_field(docs, {"name": 10.0, "type": 2.0}, asked, 0.3)
    assert found.rdd.getNumPartitions() >= R.SPREAD * spark.sparkContext.defaultParallelism
    assert "Exchange RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in found.collect())
    assert got == [(q, d, 20.0 if q % 2 == 0 and d % 3 == 0 else 10.0) for q in range(40) for d in range(3000)]


def test_sections_by_type_on_odd_lines(spark, tmp_path):
    """lines that the operator takes for headings and the SQL does not, other white space, documents without a heading."""
    odd = ["\nsecond line\nthird", "# head\nbody\n## two", "Q: what\nanswer", "step1 x:\nline", "1.2.3 three\nbody\n1.2. x", "7 节 abc\n第三章 title", "a\tb\n\tc d\t\n\u00a0e", "toc ...... 12\nbody\r\n目录", "x：\nbody:", "\u3000wide\u3000\nend", "1.\tx\n1.  y\n2  x"]
    texts = [front + s for s in odd for front in ("", "first\n", "first\nsecond here\nthird\nfourth\n")]
    rows = [(3 * i + k, s, "en", "s", len(s)) for i, s in enumerate(texts) for k in range(3)]
    spark.createDataFrame([*rows, (3 * len(texts), None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    name = "chk06_chk10_sections_by_type"
    got = plans.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({plans.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
