"""Sections, chunkers by document type, relocation, the sweep over spans, and merging by levels."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocks as B
from lodestone.operators import profiles as P


def frame(spark, items, columns="text string, kind string, level int"):
    return spark.createDataFrame([(7, i, *x) for i, x in enumerate(items)], f"doc long, ord int, {columns}")


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("doc", "idx").collect()]


def test_open_headings_equal_a_stack(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for doc in range(20):
        stack = []
        for i in range(60):
            level = rng.choice([0, 0, 1, 2, 3, 4, 12])
            if level:
                while stack and stack[-1][0] >= min(level, P.DEPTH):
                    stack.pop()
                stack.append((min(level, P.DEPTH), f"h{i}"))
            rows.append((doc, i, level or None, f"h{i}"))
            want[doc, i] = [t for _, t in stack]
    found = P.with_sections(spark.createDataFrame(rows, "doc int, ord int, level int, text string"), "doc", "ord", "level", "text")
    assert {(r["doc"], r["ord"]): [s["title"] for s in r["sections"]] for r in found.collect()} == want


@pytest.mark.parametrize(
    ("text", "level"),
    [("第一章 总则", 1), ("第三节、范围", 2), ("Q: why", 2), ("问：为何", 2), ("Overview:", 1), ("概述：", 1), ("1. Start", 1), ("1.2 Scope", 2), ("1.2.3.4 Deep", 3), ("Step 3 turn it", None), ("步骤一：开机", None), ("plain words", None), ("", None), ("12 " + "x" * 70, None)],
)
def test_manual_levels(spark, text, level):
    assert spark.createDataFrame([(text,)], "t string").select(P.manual_level(F.col("t"))).first()[0] == level


def test_law_headings(spark):
    cases = [("第一章 总则", 1, False), ("第二节 范围", 2, False), ("第一千零三条 内容", None, None), ("第十条 内容", 3, True), ("## 附则", 2, False), ("### 附则", 2, False), ("1. 总则", 1, False), ("1.2 范围", 2, True), ("1.2.3 范围", 3, True), ("（一）款", None, None), ("正文", None, None)]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string")
    level, article = P.law_heading(F.col("t"))
    assert [(r["t"], r["l"], r["a"] if r["l"] else None) for r in df.select("t", level.alias("l"), article.alias("a")).collect()] == cases


def test_types_take_their_own_chunkers(spark):
    """Laws by articles, manuals by levels or rules, general ones around media or packed; those without headings as general ones."""
    law = ["封面", "目录", "第一章 总则 .... 1", "第一章 总则", "章下的话", "第一条 甲", "（一）款", "第二条 乙", "第二章 附则", "第三条 丙"]
    manual = [("Intro", None, 1), ("a" * 200, None, 0), ("Part", None, 2), ("t", "table", 0), ("b" * 200, None, 0), ("End", None, 1), ("c" * 200, None, 0)]
    by_rule = [("1. First", None, None), ("x" * 200, None, None), ("1.1 Second", None, None), ("y" * 200, None, None)]
    general = [("alpha " * 20, None, 3), ("T1", "table", None), ("omega", None, None)]
    docs = {1: [(t, None, None) for t in law], 2: manual, 3: by_rule, 4: general, 5: [("no heading here", None, None), ("none", None, None)], 6: general}
    blocks = spark.createDataFrame([(d, i, *x) for d, items in docs.items() for i, x in enumerate(items)], "doc long, ord int, text string, kind string, level int")
    types = spark.createDataFrame([(1, " LAWS"), (2, "manual"), (3, "manual"), (4, "general"), (5, "laws")], "doc long, document_type string")
    found = P.chunks_by_type(blocks, types, "doc", "ord", 300, 40)
    got = rows_of(found, "doc", "text", "node", "section_path", "document_type")
    assert [g for g in got if g[0] == 1] == [
        (1, "第一章 总则\n章下的话", "section", ["第一章 总则"], "laws"),
        (1, "第一条 甲\n（一）款", "article", ["第一章 总则", "第一条 甲"], "laws"),
        (1, "第二条 乙", "article", ["第一章 总则", "第二条 乙"], "laws"),
        (1, "第三条 丙", "article", ["第二章 附则", "第三条 丙"], "laws"),
    ]
    assert [g[1:4] for g in got if g[0] == 2] == [("Intro\n" + "a" * 200, "section", ["Intro"]), ("Part\nt\n" + "b" * 200, "section", ["Intro", "Part"]), ("End\n" + "c" * 200, "section", ["End"])]
    assert [g[1:4] for g in got if g[0] == 3] == [("1. First\n" + "x" * 200, "section", ["1. First"]), ("1.1 Second\n" + "y" * 200, "section", ["1. First", "1.1 Second"])]
    for d, kind in ((4, "general"), (6, "general")):
        assert [g[1:] for g in got if g[0] == d] == [(("alpha " * 20).strip() + "omega", None, None, kind), ("\nT1", None, None, kind)]
    assert [g[1:] for g in got if g[0] == 5] == [("no heading here\nnone", None, None, "laws")]
    spans = {r["doc"]: (r["first_block"], r["last_block"], r["n_blocks"]) for r in found.filter("idx = 1 and node is not null").collect()}
    assert spans == {1: (5, 6, 2), 2: (2, 4, 3), 3: (2, 3, 2)}
    plain = B.semantic_chunks(blocks.filter("doc = 4").drop("level"), "doc", "ord", 300, 40)
    assert rows_of(plain, "text") == [g[1:2] for g in got if g[0] == 4]
    with pytest.raises(Exception, match="no such document type"):
        P.chunks_by_type(blocks, spark.createDataFrame([(1, "poem")], "doc long, document_type string"), "doc", "ord").collect()


def test_locate():
    full = "one  two\nthree four one two three"
    assert B.locate(full, ["one two", "three  four", "three", "gone", "one  two"]) == [(20, 27), (9, 20), (28, 33), (33, 37), (0, 8)]
    assert B.locate("", ["a", ""]) == [(0, 1), (0, 0)]
    text, places = B.collapsed(" a \n b  ")
    assert text == " a b " and places == [0, 1, 2, 5, 6]


def test_spans_and_pieces_equal_all_pairs(spark):
    rng = random.Random(9)
    pieces, spans, want = [], [], {}
    for doc in range(6):
        at, own = 0, []
        for number in range(1, 40):
            at += rng.randint(0, 3)
            own.append((number, at, at + rng.randint(1, 9)))
            at = own[-1][2]
        pieces += [(doc, *p) for p in own]
        for idx in range(60):
            a = rng.randint(0, at)
            b = a + rng.randint(1, 40)
            spans.append((doc, idx, a, b))
            met = [n for n, s, e in own if s < b and a < e]
            want[doc, idx] = (met[0], met[-1]) if met else (None, None)
    found = B.covered(spark.createDataFrame(spans, "doc int, idx int, start int, stop int"), spark.createDataFrame(pieces, "doc int, number long, p_start int, p_stop int"), "doc", "idx")
    assert {(r["doc"], r["idx"]): (r["low"], r["high"]) for r in found.collect()} == want


def test_a_document_of_many_lines(spark):
    """Ten thousand lines with doubled blanks, looked for line by line: each meets its own line."""
    n = 10_000
    blocks = spark.range(n).selectExpr("id div 10000 as doc", "cast(id as int) as ord", "concat('line ', id, ' of words') as text", "'text' as kind", "cast(id div 50 as int) as page", "0.0D as x0", "0.0D as y0", "1.0D as x1", "1.0D as y1")
    chunks = blocks.selectExpr("doc", "ord as idx", "if(ord % 2 = 0, text, concat('line  ', ord, '   of words')) as text")
    found = B.finalise(chunks, blocks, "doc", "ord")
    assert found.filter("first_block = idx and page = idx div 50").count() >= n - n // 50 and found.count() == n
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_hierarchical_merge(spark):
    lines = [(1, "Chapter"), (5, "first body"), (3, "Section"), (5, "second body"), (4, "title"), (3, "Empty section"), (2, "Part"), (5, "42"), (5, "x"), (1, "Last")]
    df = frame(spark, [(t, lv) for lv, t in lines], "text string, level int")
    got = [r["text"] for r in P.hierarchical_merge(df, "doc", "ord", 3, 5).orderBy("idx").collect()]
    # body lines first, each with what stands above it; then titles and sections that stand above none
    assert got == ["Chapter\nfirst body", "Chapter\nSection\nsecond body", "Chapter\nSection\ntitle", "Chapter\nEmpty section"]
    singles = frame(spark, [("a" * 400, 5), ("b" * 400, 5), ("c" * 400, 5)], "text string, level int")
    assert [len(r["text"]) for r in P.hierarchical_merge(singles, "doc", "ord", 3, 5).orderBy("idx").collect()] == [801, 400]
    assert P.hierarchical_merge(df.limit(0), "doc", "ord", 3, 5).count() == 0


def test_fragments_number_themselves():
    frame_of = lambda p, k, n: f"{k}/{n}\n\n{p}"
    for size in (0, 1, 9, 10, 100, 999, 5000):
        parts = B._fragments("x" * size, frame_of, 4)
        assert "".join(p.split("\n\n", 1)[1] for p in parts) == "x" * size and all(B.tokens(p) <= 4 for p in parts)
        assert [p.split("\n")[0] for p in parts] == [f"{k}/{len(parts)}" for k in range(1, len(parts) + 1)]
    with pytest.raises(ValueError, match="no room"):
        B._fragments("x", lambda p, k, n: "f" * 99 + p, 4)


def test_similar_sets_equal_all_pairs(spark):
    from lodestone.operators.cleaning import similar_sets

    rng = random.Random(6)
    base = [f"v{i}" for i in range(30)]
    rows = [(i, sorted({"hot", *rng.sample(base, rng.randint(1, 9))} - ({"hot"} if i % 4 == 0 else set()))) for i in range(120)]
    rows += [(200, rows[5][1]), (201, [])]
    classes = {}
    for i, vs in rows:
        if vs:
            classes[tuple(vs)] = min(i, classes.get(tuple(vs), i))
    sets = sorted((i, set(vs)) for vs, i in classes.items())
    for threshold in (0.2, 0.5, 1.0):
        want = {(i, j, round(len(a & b) / len(a | b), 9)) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if len(a & b) >= threshold * len(a | b)}
        found = similar_sets(spark.createDataFrame(rows, "id int, vs array<string>"), "id", "vs", threshold)
        assert {(r["left_id"], r["right_id"], round(r["jaccard"], 9)) for r in found.collect()} == want
