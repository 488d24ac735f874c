"""Golden cases of the chunkers over block rows, and what they keep of whole tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import plans
from lodestone.operators import blocks as B
from lodestone.operators import retrieval as R


def frame(spark, items, columns="text string, kind string"):
    return spark.createDataFrame([(7, i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)], f"doc long, ord int, {columns}")


def texts(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("idx").collect()]


def test_split_marked():
    block = lambda t, k="text": {"text": t, "kind": k}
    assert B.split_marked([block("a"), block("t", "table"), block(" b ")], []) == [block("a"), block("\nt", "table"), block("b")]
    # with marks a piece runs on over blocks, also past a table, until the next mark
    assert B.split_marked([block("a"), block("t", "table"), block("b##c")], ["##"]) == [block("\nt", "table"), block("a\nb"), block("c")]


def test_docx_chunks(spark):
    rows = frame(spark, [("a" * 40, "text"), ("T", "table"), ("b" * 40, None), ("c" * 80, "text"), ("d" * 8, "text"), (None, "text"), ("I", "image")])
    assert texts(B.docx_chunks(rows, "doc", "ord", 20), "kind", "text") == [("text", "a" * 40 + "b" * 40), ("table", "\nT"), ("text", "c" * 80 + "d" * 8)[:1] + ("c" * 80,), ("text", "d" * 8), ("image", "\nI")]
    # texts under the least size join even a full chunk
    assert texts(B.docx_chunks(rows, "doc", "ord", 20, least=5), "text") == ["a" * 40 + "b" * 40, "\nT", "c" * 80 + "d" * 8, "\nI"]


def test_media_context():
    pieces = [{"text": "One two. Three four five six. Seven eight.", "kind": "text"}, {"text": "t", "kind": "table"}, {"text": "Nine ten. Eleven.", "kind": "text"}, {"text": "Twelve thirteen. Fourteen.", "kind": "text"}]
    B.media_context(pieces, 6)
    assert pieces[1]["above"] == "Three four five six. Seven eight." and pieces[1]["below"] == "Nine ten. Eleven.Twelve thirteen. "
    assert "above" not in pieces[0]
    assert B.take_sentences("a! b? c", 1, False) == "a!" and B.take_sentences("a! b? c", 1, True) == " c"


def test_token_chunks(spark):
    rows = frame(spark, [("a" * 40, "text"), ("b" * 40, "text"), ("c" * 40, "text"), ("T", "table"), ("d", "text"), (None, "text")])
    assert texts(B.token_chunks(rows, "doc", "ord", 15), "kind", "text") == [("text", "a" * 40 + "\n" + "b" * 40), ("text", "c" * 40), ("table", "T"), ("text", "d")]
    assert texts(B.token_chunks(rows, "doc", "ord", 12, 50), "text")[:3] == ["a" * 40, "a" * 20 + "b" * 40, "a" * 0 + "b" * 30 + "c" * 40]


def test_manual_chunks(spark):
    rows = frame(spark, [("a", "x" * 400, "text"), ("a", "y" * 40, "text"), ("b", "z" * 40, "text"), ("c", "t", "table"), ("c", "w" * 4000, "text"), ("c", "v", "text"), ("c", "u", "image")], "section string, text string, kind string")
    got = texts(B.manual_chunks(rows, "doc", "ord"), "section", "kinds", "text")
    assert got == [("a", "text", "x" * 400 + "\n" + "y" * 40), ("b", "table,text", "\n".join(["z" * 40, "t", "w" * 4000])), ("c", "image,text", "v\nu")]


def test_articles(spark):
    rows = frame(spark, ["preamble", "第一条 a", "b", "第一千零二十条 c", "第十万条 d", "第百条 e", "f"], "text string")
    assert texts(B.article_chunks(rows, "doc", "ord"), "text") == ["第一条 a\nb\n第一千零二十条 c", "第十万条 d", "第百条 e\nf"]


def test_tree_chunks(spark):
    lines = [(99, "intro"), (1, "H1"), (99, "body one"), (2, "H1.1"), (99, "body two"), (3, "deep"), (2, "H1.2"), (1, "H2"), (99, "7")]
    rows = frame(spark, lines, "level int, text string")
    assert texts(B.tree_chunks(rows, "doc", "ord", 2), "text") == ["intro", "H1\nbody one\nH1.1\nbody two\ndeep", "H1\nbody one\nH1.2", "H2"]
    assert texts(B.tree_chunks(rows, "doc", "ord", 1), "text") == ["intro", "H1\nbody one\nH1.1\nbody two\ndeep\nH1.2", "H2"]
    assert B.tree_chunks(frame(spark, [(99, "1")], "level int, text string"), "doc", "ord", 2).count() == 0


def test_pack_lines(spark):
    rows = frame(spark, ["a" * 400, "b" * 400, "c" * 400, "d\ne", "f"], "text string")
    assert texts(B.pack_lines(rows, "doc", "ord"), "text") == ["a" * 400 + "\n" + "b" * 400, "c" * 400, "d\ne", "f"]


def test_contents(spark):
    lines = ["Title", "c o n t e n t s", "", "Intro .... 1", "Methods .... 2", "Intro", "text", "目录", "第一章 甲 1", "第二章 乙 2", "第一章 甲", "end"]
    assert texts(B.without_contents(frame(spark, lines, "text string"), "doc", "ord"), "text") == ["Title", "Intro", "text", "第一章 甲", "end"]
    assert texts(B.without_contents(frame(spark, ["contents"], "text string"), "doc", "ord"), "text") == []


def test_sheet_parts():
    headers = ["k", "v"]
    small = B.sheet_parts("S", headers, [(2, ["a", "b"]), (3, ["c", None])], 40)
    assert small == [("rows", 2, 3, 1, 2, "Sheet: S\nRows: 2-3\nk | v\na | b\nc | ")]
    parts = B.sheet_parts("S", headers, [(2, ["a", "x" * 300]), (3, ["c", "d"])], 30)
    assert [p[0] for p in parts] == ["columns", *["value"] * 4, "rows"] and all(B.tokens(p[5]) <= 30 for p in parts)
    assert "".join(p[5].split("\n\n", 1)[1] for p in parts if p[0] == "value") == "x" * 300 and "Fragment: 1/4" in parts[1][5] and "Cell: B2" in parts[1][5]
    long = B.sheet_parts("S", ["h" * 200], [(2, ["y" * 50])], 30)
    assert {p[0] for p in long} == {"header", "value"} and "".join(p[5].split("\n\n", 1)[1] for p in long if p[0] == "header") == "h" * 200
    assert B.sheet_parts("S", headers, [], 40)[0][0] == "columns"
    with pytest.raises(ValueError):
        B.sheet_parts("S" * 500, headers, [(2, ["a", "b"])], 30)
    assert [B._letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_semantic_and_final(spark):
    rows = spark.createDataFrame(
        [(1, 0, "alpha " * 20, "text"), (1, 1, "T1", "table"), (1, 2, "omega", "text"), (2, 0, "plain one", None), (2, 1, "plain two", None), (3, 0, "w" * 700, "text")], "doc long, ord int, text string, kind string"
    )
    got = {(r["doc"], r["idx"]): (r["kind"], r["text"]) for r in B.semantic_chunks(rows, "doc", "ord", 300, 40).collect()}
    assert got[1, 0] == ("text", ("alpha " * 20).strip() + "omega") and got[1, 1] == ("table", "\nT1")
    assert got[2, 0] == ("text", "plain one\nplain two") and [len(got[3, k][1]) for k in range(3)] == [300, 300, 180]
    boxes = rows.withColumns({"page": F.lit(4) + F.col("ord"), "x0": F.col("ord") * 1.0, "y0": F.lit(0.0), "x1": F.lit(9.0) + F.col("ord"), "y1": F.lit(5.0)})
    chunks = spark.createDataFrame([(2, 0, "plain one\nplain two"), (2, 1, "nowhere")], "doc long, idx int, text string")
    a, b = B.finalise(chunks, boxes, "doc", "ord").orderBy("idx").collect()
    assert (a["start"], a["stop"], a["first_block"], a["n_blocks"], a["page"], a["x0"], a["x1"]) == (0, 19, 0, 2, 4, 0.0, 9.0)
    assert b["start"] == 19 and b["n_blocks"] is None
    kids = B.children(chunks.limit(1), "doc", "\n").collect()
    assert [k["text"].strip() for k in kids] == ["plain one", "plain two"] and kids[0]["parent"] == "plain one\nplain two"


def test_whole_tables_keep_their_words(spark, sf_dir):
    """Every word of every document comes back, in order, from the chunkers that drop nothing."""
    docs = {r["doc_id"]: "".join(r["text"].split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for name in ("chk12_token_chunks", "chk10_manual_chunks", "chk14_chk17_packed_lines"):
        got: dict = {}
        for r in plans.queries()[name](spark, sf_dir).orderBy("doc_id", "idx").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        joined = {d: "".join("".join(x).split()) for d, x in got.items()}
        if name == "chk12_token_chunks":  # with overlaps
            assert all(len(joined[d]) >= len(t) for d, t in docs.items())
        else:
            assert joined == docs, name


def test_retry(spark):
    hits = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1), (2, "c", 0.1), (2, "d", None)], "query_id int, id string, s double")
    assert sorted(r["id"] for r in R.retry_where_empty(hits, F.col("s") >= 0.3).collect()) == ["a", "c", "d"]
    assert (R.similarity_bound(0.2, 0.0, False), R.similarity_bound(0.2, 0.5, True), R.similarity_bound(0.2, 0.5, False)) == (0.0, 0.0, 0.2)


def test_dense_topk_in_blocks(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = sorted(map(tuple, R.dense_topk(vectors, asked, 5).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, R.dense_topk(vectors, asked, 5).collect())) == want and len(want) == 5 * asked.count()
    assert R.dense_topk(vectors, asked.limit(0), 5).count() == 0


def test_one_document_at_a_time():
    """Before, a task turned a whole batch of documents into Python rows before it passed anything on."""
    folded = []

    def fold(items):
        folded.append(len(items))
        return [(i, x["text"]) for i, x in enumerate(items)]

    items = pa.array([[{"ord": i, "text": "x"} for i in range(3)]] * 4000, pa.list_(pa.struct([("ord", pa.int32()), ("text", pa.string())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), items], names=["doc", "items"])
    found = B.folded_batches([batch], "doc", fold, "idx int, text string")
    first = next(found)
    assert 0 < len(folded) < 2000 and first.num_rows == 3 * len(folded)
    rest = [r for b in [first, *found] for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert rest == [(d, i, "x") for d in range(4000) for i in range(3)]
