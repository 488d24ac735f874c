"""Quality rules, n-gram join, suffix dedup and BPE against brute force."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe, exchange, ngram_join, quality_rules, queries, suffix_dedup
from lodestone.llm import components as cc

WORDS = re.compile("[^\x20\x09-\x0D]+")


def collect(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- quality rules -----------------------------------------------------------------------------


def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_quality_counts(table, request):
    df = request.getfixturevalue(table)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.apply_rules(df).collect()
    assert len(got) == df.count()
    for r in got:
        want = counts(r["text"])
        assert tuple(r[c] for c in names) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])


def test_quality_plan_is_native(docs):
    plan = quality_rules.apply_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_quality_empty(empty):
    assert quality_rules.apply_rules(empty).count() == 0


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_ngram_join"])
def test_sql_agrees(name, spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = queries.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(object).values.tolist()))
    assert key(got) == key(want)


# --- n-gram join -------------------------------------------------------------------------------


def shingle_set(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                    parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(low[r], d)
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("table", ["awkward", "docs"])
def test_join_against_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()]
    assert order(got) == order(brute_components(collect(df)))


def test_join_of_a_family_with_chains(spark):
    """Copies that are edited step by step: neighbours link, ends do not, and blocks see all of it."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        if i:
            words = list(words)
            for p in rng.integers(0, len(words), 5):
                words[p] = f"n{i}_{p}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()]
    assert order(got) == order(brute_components(rows))


@pytest.mark.parametrize(("short", "block", "hot"), [(1, 4, 40), (3, 16, 3), (48, 512, 2)])
def test_join_by_lists_blocks_and_hot_shingles(spark, short, block, hot, monkeypatch):
    """Families of copies of all sizes, a line that most hold, and equal sets: components and numbers of links as brute force has them."""
    for name, value in (("LIST_DOCS", short), ("BLOCK_DOCS", block), ("HOT_ROWS", hot)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 3000)}"
    line = " ".join(word() for _ in range(12))
    rows = []
    for family in range(8):
        base = [word() for _ in range(int(rng.integers(6, 120)))]
        for _ in range(int(rng.integers(1, 14))):
            words = list(base)
            for p in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[p] = word()
            rows.append((len(rows), " ".join(words) + (" " + line if family % 2 else "")))
    rows += [(len(rows), rows[3][1]), (len(rows) + 1, line), (len(rows) + 2, line)]
    sets = [shingle_set(t) for _, t in rows]
    links = [sum(i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert order((r["id"], r["n_shingles"], r["component_id"]) for r in got) == order(brute_components(rows))
    assert {r["id"]: r["n_links"] for r in got} == dict(enumerate(links)) and max(links) > 3


def test_one_per_component(awkward):
    kept = ngram_join.one_per_component(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and 7 not in ids and 8 not in ids and 11 not in ids


def test_join_empty(empty):
    assert ngram_join.ngram_components(empty).count() == 0 and ngram_join.one_per_component(empty).count() == 0


def test_prefix_never_loses_a_link(spark):
    """A linked pair shares as many prefix shingles as the smaller of both requirements."""
    base = [f"t{i}" for i in range(300)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:150] + ["zz"] + base[151:])), (2, " ".join(base[20:]))]
    got = {r["id"]: r["component_id"] for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (700, 700)]
    got = dict(cc.component_labels(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


# --- suffix dedup ------------------------------------------------------------------------------


def brute_cut(rows, size=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + size] for _, b in data for p in range(len(b) - size + 1))
    out = []
    for d, b in data:
        edge = np.zeros(len(b) + 1, dtype=int)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                edge[p] += 1
                edge[p + size] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def spark_cut(df, size=400):
    cut = suffix_dedup.cut_spans(df.select("doc_id", "text"), suffix_dedup.repeated_spans(df, threshold=size))
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = cut.select("doc_id", n.alias("n"), (n - F.octet_length("kept")).alias("r"), F.coalesce(F.size("spans"), F.lit(0)).alias("s"), F.sha2("kept", 256).alias("h")).collect()
    return [(r["doc_id"], r["n"], r["r"], max(r["s"], 0), r["h"]) for r in rows]


@pytest.mark.parametrize(("table", "size"), [("awkward", 400), ("docs", 400), ("awkward", 200), ("docs", 200), ("docs", 64), ("docs", 1000)])
def test_dedup_against_brute_force(table, size, request):
    df = request.getfixturevalue(table)
    assert order(spark_cut(df, size)) == order(brute_cut(collect(df), size))


def test_dedup_of_two_thresholds(docs):
    spans = suffix_dedup.repeated_spans(docs, also=(200, 700)).collect()
    texts = {t: None for _, t in collect(docs)}
    for name, size in (("spans", 400), ("spans_200", 200), ("spans_700", 700)):
        want = Counter((sum(map(len, runs)), len(runs)) for t, runs in dict(brute_runs([(t, t) for t in texts], size)).items() if runs)
        copies = Counter(t for _, t in collect(docs))
        if max(copies.values()) == 1:
            assert Counter((sum(s["stop"] - s["start"] for s in r[name]), len(r[name])) for r in spans if r[name]) == want


@pytest.mark.parametrize("chunk", [1_000_000, 50])
def test_dedup_boundaries(spark, chunk, monkeypatch):
    """Shared strings around the threshold, next to each other, overlapping, periodic and inside one text; tasks that
    settle all repeats by themselves, and hardly any."""
    monkeypatch.setattr(exchange, "CHUNK_KEYS", chunk)
    rng = np.random.default_rng(1)
    piece = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    a, b, c = piece(399), piece(400), piece(401)
    rows = [piece(300) + a + piece(50), a + piece(10), piece(70) + b, b + piece(70), piece(5) + c + piece(5) + c, b[:200] + c[200:], "ab" * 600, "ab" * 450 + piece(40), piece(90) + a + b, a[100:] + b + c[:150]]
    rows += [b[:390] + piece(400), piece(400) + c[11:], "q" * 1000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert order(spark_cut(df)) == order(brute_cut(list(enumerate(rows))))


def brute_runs(rows, size):
    """Per row the runs under repeated strings."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + size] for _, b in data for p in range(len(b) - size + 1))
    for d, b in data:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p + 1 : p + size + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        yield d, [b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)]


def test_op5_equals_brute_force(spark, sf_dir):
    """The registered query with its further column."""
    docs = collect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = queries.op5_repeated_spans(spark, sf_dir).collect()
    assert order(tuple(r)[:5] for r in got) == order(brute_cut(docs))
    # a run of first ranks is a window (71 bytes) shorter at each end at most; what stands in no repeated string of 160 bytes is none
    n = {r["doc_id"]: r["n_passages"] for r in got}
    assert n == {d: len(runs) for d, runs in brute_runs(docs, queries.COUNTED_BYTES)} and 0 in n.values() and max(n.values()) > 0


def test_columns_of_clashing_names(awkward):
    cut = suffix_dedup.cut_spans(awkward, suffix_dedup.repeated_spans(awkward))
    assert cut.columns == [c for c in awkward.columns if c not in ("spans", "Kept")] + ["spans", "kept"]
    assert suffix_dedup.cut_text(awkward, suffix_dedup.repeated_spans(awkward)).columns == awkward.columns


def test_dedup_of_repeated_rows(spark):
    """Equal rows (id and text) whose text stands nowhere else, whole or in part, and texts that share a part with them."""
    rng = np.random.default_rng(2)
    piece = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    lone, short, edge, no_id, shared = piece(1000), piece(399), piece(400), piece(700), piece(1500)
    rows = [(0, lone), (0, lone), (1, short), (1, short), (2, edge), (2, edge), (2, edge), (None, no_id), (None, no_id), (3, shared), (3, shared)]
    rows += [(4, piece(90) + shared[:430] + piece(80)), (5, shared[-405:] + piece(300)), (6, piece(200) + shared[500:915] + piece(200)), (7, shared[700:1099]), (8, piece(900))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = order(spark_cut(df))
    assert got == order(brute_cut(rows))
    assert [r[2] for r in got if r[0] == 0] == [1000, 1000]


def test_cut_text_keeps_valid_characters(spark):
    shared = "é" * 300
    rows = [(0, "x" + shared + "ab"), (1, "yy" + shared + "cd"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(suffix_dedup.cut_text(df, suffix_dedup.repeated_spans(df)).collect())
    assert got == {0: "xab", 1: "yycd", 2: None}


def test_dedup_empty(empty):
    assert suffix_dedup.repeated_spans(empty).count() == 0


# --- byte-level BPE ----------------------------------------------------------------------------


@pytest.mark.parametrize("table", ["awkward", "docs", "empty"])
def test_bpe_equals_reference_encoder_and_round_trips(table, request):
    path = public_tokenizers.path(queries.VOCABULARY)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    df = request.getfixturevalue(table)
    encoded = bpe.encode(df, path, public_tokenizers.PATTERN, offsets=True)
    for r in bpe.decode(encoded, path).collect():
        text = r["text"] or ""
        assert list(r["ids"]) == encoder.encode_ordinary(text)
        assert bytes(r["decoded"]).decode() == text
        _, starts = encoder.decode_with_offsets(list(r["ids"]))
        inside = {i for i, token in enumerate(r["ids"]) if encoder.decode_single_token_bytes(token)[:1] and 0x80 <= encoder.decode_single_token_bytes(token)[0] < 0xC0}
        assert r["n_split"] == len(inside)
        assert [s for i, s in enumerate(r["starts"]) if i not in inside] == [s for i, s in enumerate(starts) if i not in inside]


def test_bpe_odd_characters(spark):
    path = public_tokenizers.path(queries.VOCABULARY)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = [(i, t) for i, t in enumerate(["𝄞𝄞 a", "\u0000\u0001", "  \n\n x", "it's we'LL", "日本語テキスト", "á‍👨‍👩‍👧", "<|endoftext|>"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path).collect():
        assert list(r["ids"]) == encoder.encode_ordinary(r["text"]) and bytes(r["decoded"]).decode() == r["text"]
