"""Plans that must not send texts more often than the work needs, and shortcuts that must not change results."""

from lodestone.operators import blocks as B


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _blocks(spark, n=30):
    rows = [(d, k, f" block {k} of {d} ", "table" if k % 4 == 3 else "text", k // 3, 1.0 * k, 2.0, 3.0 * k, None if k % 5 else 4.0) for d in range(3) for k in range(n)]
    return spark.createDataFrame([*rows, (9, 0, "  ", "text", 0, 1.0, 1.0, 1.0, 1.0)], "doc long, ord int, text string, kind string, page int, x0 double, y0 double, x1 double, y1 double")


def test_finalise_meets_a_document_once(spark):
    """blocks and chunks of a document are two rows that meet once; chunks were found twice and carried the whole text."""
    blocks = _blocks(spark)
    chunks = spark.createDataFrame([(0, 0, "block 1 of 0\nblock 2 of 0"), (0, 1, "of 0\nblock  3 of 0\nblock 4"), (0, 2, ""), (1, 5, "nowhere"), (9, 0, "x"), (7, 0, "y")], "doc long, idx int, text string")
    found = B.finalise(chunks, blocks, "doc", "ord")
    text = plan(found)
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") <= 2
    got = {(r["doc"], r["idx"]): tuple(r)[2:] for r in found.collect()}
    assert got == {
        (0, 0): ("block 1 of 0\nblock 2 of 0", 13, 38, 1, 2, "text", 0, 1.0, 2.0, 6.0, None),
        (0, 1): ("of 0\nblock  3 of 0\nblock 4", 34, 60, 2, 3, "table,text", 0, 2.0, 2.0, 6.0, None),
        (0, 2): ("", 34, 34, None, None, None, None, None, None, None, None),
        (1, 5): ("nowhere", 0, 7, 0, 1, "text", 0, 0.0, 2.0, 0.0, 4.0),
    }


def test_semantic_chunks_gather_a_document_once(spark):
    """media, packed and windowed documents come from one fold; each used to read and fold the blocks several times."""
    long = "word " * 100
    rows = [(1, 0, "one", "text"), (1, 1, "T", "table"), (1, 2, "two", "text"), (2, 0, " plain ", "text"), (2, 1, "text", None), (3, 0, long, "text"), (4, 0, "  ", "text"), (5, 0, "\t", "text"), (6, 0, "I", "image"), (6, 1, long, "text")]
    found = B.semantic_chunks(spark.createDataFrame(rows, "doc long, ord int, text string, kind string"), "doc", "ord", 300, 40)
    text = plan(found)
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning") == 1
    got = {(r["doc"], r["idx"]): (r["kind"], r["text"]) for r in found.collect()}
    windows = {(3, k): ("text", long[a : a + 300].strip()) for k, a in enumerate((0, 260))}
    assert got == windows | {(1, 0): ("text", "onetwo"), (1, 1): ("table", "\nT"), (2, 0): ("text", "plain\ntext"), (6, 0): ("image", "\nI"), (6, 1): ("text", long.strip())}


def test_windows_of_a_text_are_fixed_windows(spark):
    from lodestone.operators import chunking as C

    texts = ["", "a", "x" * 40, "x" * 41, "x" * 300, "x" * 301, "ab cd " * 200, " " * 700 + "z", "é" * 560, "é" * 561]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = sorted((r["id"], r["idx"], r["text"]) for r in C.fixed_windows(df, "id", "text").collect())
    assert [(i, k, w) for i, t in enumerate(texts) for k, w in C.text_windows(t)] == want


def test_sections_by_type_are_made_once(spark):
    """sections are worked out once, though their documents are needed, too; units go along with their numbers."""
    from lodestone.operators import profiles as P

    rows = [(d, k, f"{k + 1}. head {k}" if k % 4 == 0 else f"line {k} of {d}", "text", 0) for d in range(4) for k in range(9)]
    types = spark.createDataFrame([(0, "manual"), (1, "laws"), (2, None)], "doc long, document_type string")
    found = P.chunks_by_type(spark.createDataFrame(rows, "doc long, ord int, text string, kind string, level int"), types, "doc", "ord")
    text = plan(found)
    assert text.count("MapInArrow") == 1 and text.count("Window") == 0
    assert {r["doc"]: r["document_type"] for r in found.collect()} == {0: "manual", 1: "laws", 2: "general", 3: "general"}


def test_rerank_works_out_the_chunks_of_hits_only(spark, sf_dir):
    """the grams of every document were worked out and sent before the hits were looked at."""
    from lodestone import plans

    found = plans.queries()["ret17_hybrid_rerank"](spark, sf_dir)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < text.find("array_distinct(concat(array_distinct(regexp_extract_all") < text.find("Join LeftSemi")


def test_outline_takes_the_same_titles_with_few_comparisons(monkeypatch):
    """F16: every entry was compared in full with every title of its page."""
    import difflib
    import random

    from lodestone.operators import headings as H

    draw = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    titles = [{"order": k, "text": draw.choice(["", f"{k}. ", "Chapter 2 "]) + " ".join(draw.choices(words, k=draw.choice([1, 2, 12]))), "page": draw.choice([None, k // 20])} for k in range(120)]
    damage = lambda s: "".join(c for c in s if draw.random() < 0.95)
    entries = [{"order": k, "text": draw.choice([str, damage])(t["text"]), "level": 1, "page": draw.choice([None, t["page"]])} for k, t in enumerate(titles[::3])] + [{"order": 99, "text": "!", "level": 1, "page": None}]
    free, want = {t["order"]: t for t in titles}, []
    for e in entries:
        near = [t for t in free.values() if e["page"] is None or t["page"] == e["page"]]
        score, at = max(((H.title_score(e["text"], t["text"]), -t["order"]) for t in near), default=(0.0, 0))
        if score >= (H.ON_PAGE if e["page"] is not None else H.ANYWHERE):
            want.append((-at, 1, score))
            del free[-at]
    calls, matcher = [], difflib.SequenceMatcher
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *a: calls.append(a) or matcher(*a))
    assert H.align_outline(entries, titles) == want and len(want) > 20
    assert len(calls) < 5 * len(entries)
