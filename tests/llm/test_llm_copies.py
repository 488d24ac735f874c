"""Votes by leaders come from the exchange that finds shared values; thresholds of repeated spans share their passes."""

import numpy as np
import pandas as pd

from lodestone.llm import media, suffix_dedup


def corners(rows):
    names = ("id", "n_keypoints", *media._CORNER)
    return {c: np.array([r[i] for r in rows], dtype=np.int64) for i, c in enumerate(names)}


def test_leader_votes_by_value_and_chunk(monkeypatch):
    monkeypatch.setattr(media, "PAIRS_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    n = 300
    rows = [(int(rng.integers(1, 9)), 20, int(rng.integers(0, 40)), int(rng.integers(0, 40)), int(rng.choice([1, 2])), int(rng.integers(0, 24))) for _ in range(n)]
    key, chunk = rng.integers(0, 12, n), rng.integers(-1, 2, n)
    got = media._leader_votes(chunk, key, corners(rows)).groupby(["a", "b", "place"])["votes"].sum().to_dict()
    rank = dict(zip(range(1, 9), media.mix(np.arange(1, 9).astype(np.uint64)).tolist(), strict=True))
    want = {}
    for g in set(zip(chunk.tolist(), key.tolist(), strict=True)):
        own = [r for r, c, k in zip(rows, chunk.tolist(), key.tolist(), strict=True) if (c, k) == g]
        lead = min((r[0] for r in own), key=rank.get)
        for r in own:
            for x in own:
                if x[0] == lead != r[0]:
                    p, q = sorted((r, x))[:2] if r[0] != x[0] else (r, x)
                    place = media._place(*({c: np.array([v]) for c, v in zip(media._CORNER, z[2:], strict=True)} for z in (p, q)))
                    at = (p[0], q[0], int(place[0]))
                    want[at] = want.get(at, 0) + 1
    assert got == want and got


def test_entries_hold_each_vote_once(spark, monkeypatch):
    # small chunks: values that a task finds twice are settled there, others meet in buckets
    rng = np.random.default_rng(8)
    shape = [dict(x=int(x), y=int(y), scale=1, turn=0, d0=i, d1=i, d2=i, d3=i) for i, (x, y) in enumerate(rng.integers(0, 900, (20, 2)))]
    images = [(i, shape) for i in range(1, 7)]
    schema = f"id long, keypoints {media.KEYPOINTS}"
    for parts in (1, 2, 6):
        rows = media._entries(spark.createDataFrame(images, schema).repartition(parts, "id"), 480).toPandas()
        assert len(rows[rows["other"].isna()]) == 6 * 80
        votes = rows[rows["other"].notna()].groupby(["id", "other"])["repeats"].sum()
        # five images have the leader, if not a leader of their task, in all of their 80 values
        assert votes.max() <= 80 and votes.sum() == 5 * 80


def test_thresholds_share_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    long, short = word(500), word(300)
    docs = spark.createDataFrame([(i, word(199) + chr(65 + i) + (long if i % 2 else short) + chr(75 + i) + word(250)) for i in range(6)], "doc_id long, text string")
    calls = []
    for name in ("_sure_starts", "_open_starts"):
        plain = getattr(suffix_dedup, name)
        monkeypatch.setattr(suffix_dedup, name, lambda *a, plain=plain, name=name: calls.append(name) or plain(*a))
    both = suffix_dedup.cut_spans(docs, suffix_dedup.repeated_spans(docs, also=(231,))).toPandas().set_index("doc_id")
    assert sorted(calls) == ["_open_starts", "_sure_starts"]
    alone = suffix_dedup.cut_spans(docs, suffix_dedup.repeated_spans(docs, threshold=231)).toPandas().set_index("doc_id")
    for i in range(6):
        found = both.loc[i, "spans"]
        assert [(s["start"], s["stop"]) for s in found] == [(200, 700)] if i % 2 else found is None
        assert [tuple(s) for s in both.loc[i, "spans_231"]] == [tuple(s) for s in alone.loc[i, "spans"]]
        assert pd.notna(both.loc[i, "kept"])
