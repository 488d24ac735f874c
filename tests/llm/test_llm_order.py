"""Sharding, materialisation, mixing, media and the classifiers."""

import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import classifier, materialise, media, mixing, queries, sharding, toxicity
from lodestone.llm.training_rows import held_out, labelled_sample

# --- sharding ----------------------------------------------------------------------------------


def shards_of(df, n):
    rows = sharding.histogram_shards(df, n).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        by.setdefault(r["shard"], []).append(r)
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    return by


def test_shards_near_equal_and_gapless(docs):
    by = shards_of(docs, 6)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    largest = max(r["size"] for v in by.values() for r in v)
    assert len(by) == 6 and max(sizes) - min(sizes) <= 2 * largest + 0.01 * max(sizes)


def test_hot_group_is_split(spark):
    rows = [(i, "copy " * 20) for i in range(3000)] + [(3000 + i, f"text {i} " * 10) for i in range(3000)]
    by = shards_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 8)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(by) == 8 and max(sizes) <= 1.02 * min(sizes)


def test_sharding_edges(awkward, empty):
    shards_of(awkward, 24)
    assert sharding.histogram_shards(empty).count() == 0


# --- training order ----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = materialise.feistel_slots(np.arange(n), n, 42)
    assert sorted(slots.tolist()) == list(range(n))
    if n >= 1000:
        assert slots.tolist() != materialise.feistel_slots(np.arange(n), n, 43).tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def test_materialised_shards_hold_every_token(spark, docs, tmp_path):
    path = public_tokenizers.path(queries.ORDER_VOCABULARY)
    folder = f"file://{tmp_path}/shards"
    rows = materialise.materialise(docs, path, public_tokenizers.PATTERN, queries.END_ID, 5, length=128, per_shard=64, out_dir=folder).collect()
    n = len(rows)
    assert sorted(r["slot"] for r in rows) == list(range(n))
    data = materialise.read_slots(folder, 0, n, 128, 64)
    for r in rows:
        assert zlib.crc32(data[r["slot"]].tobytes()) == r["crc32"] and r["byte_offset"] == r["slot"] % 64 * 256
    streams = {}
    for r in sorted(rows, key=lambda r: (r["part"], r["seq_no"])):
        streams.setdefault(r["part"], []).append(data[r["slot"]][: r["n_tokens"]])
    texts = []
    import tiktoken

    from lodestone.llm.bpe import load_ranks

    encoder = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    for s in streams.values():
        ids = np.concatenate(s).tolist()
        at = 0
        while at < len(ids):
            end = ids.index(queries.END_ID, at)
            texts.append(encoder.decode(ids[at:end]))
            at = end + 1
    assert sorted(texts) == sorted(r["text"] for r in docs.select("text").collect())
    assert np.array_equal(materialise.read_slots(folder, 60, 10, 128, 64), data[60:70])


def plain_slot(i, n, key, rounds=materialise.ROUNDS):
    """The permutation of one number by plain integer arithmetic."""
    half = 1
    while 4**half < n:
        half += 1
    wrap, mask = (1 << 64) - 1, (1 << half) - 1
    x = i
    while True:
        left, right = x >> half, x & mask
        for r in range(rounds):
            k = (key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) & wrap
            f = (right + k) * 0xBF58476D1CE4E5B9 & wrap
            f = (f ^ (f >> 29)) * 0x94D049BB133111EB & wrap
            left, right = right, left ^ ((f >> 32) & mask)
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 5, 63, 1000])
def test_feistel_equals_a_plain_loop(n):
    assert materialise.feistel_slots(np.arange(n), n, 77).tolist() == [plain_slot(i, n, 77) for i in range(n)]


def test_op4_rows_equal_a_plain_loop(spark, sf_dir):
    """The registered query: numbers of the sequences by part and place, slots by the plain loop, no shard in two tasks."""
    rows = sorted(queries.op4_training_order(spark, sf_dir).collect(), key=lambda r: (r["part"], r["seq_no"]))
    n = len(rows)
    assert n > 100
    for i, r in enumerate(rows):
        slot = plain_slot(i, n, queries.ORDER_KEY)
        assert (r["slot"], r["shard"], r["byte_offset"]) == (slot, slot // 4096, slot % 4096 * 2048)


def test_ids_of_four_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(materialise, "id_type", lambda path, end_id: np.dtype("<u4"))
    df = spark.createDataFrame([(i, f"text {i} äöü 𝄞") for i in range(200)], "doc_id long, text string")
    path = public_tokenizers.path(queries.ORDER_VOCABULARY)
    rows = materialise.materialise(df, path, public_tokenizers.PATTERN, queries.END_ID, 3, length=16, per_shard=8, out_dir=str(tmp_path / "s")).collect()
    data = materialise.read_slots(str(tmp_path / "s"), 0, len(rows), 16, 8, "<u4")
    assert all(zlib.crc32(data[r["slot"]].tobytes()) == r["crc32"] for r in rows)


def test_materialise_edges(awkward, empty):
    path = public_tokenizers.path(queries.ORDER_VOCABULARY)
    assert materialise.materialise(awkward, path, public_tokenizers.PATTERN, queries.END_ID, 1).count() > 0
    assert materialise.materialise(empty, path, public_tokenizers.PATTERN, queries.END_ID, 1).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def test_mix_places_every_document_once(docs):
    mixed = mixing.pfair_mix(docs, mixing.even_tempered_weights(docs), block_bytes=4096)
    rows = mixed.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    blocks = {(r["source"], r["block"]): r["position"] for r in rows}
    assert len(set(blocks.values())) == len(blocks)
    for source in {s for s, _ in blocks}:
        own = sorted((b, p) for (s, b), p in blocks.items() if s == source)
        assert [p for _, p in own] == sorted(p for _, p in own)


def test_mix_follows_its_targets(spark):
    rows = [(i, "x" * 100, f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    mixed = mixing.pfair_mix(df, weights, block_bytes=500).select("source", "block", "position", "on_target").distinct().orderBy("position").collect()
    got = dict.fromkeys(weights, 0)
    for t, r in enumerate(mixed, 1):
        if not r["on_target"]:
            break
        got[r["source"]] += 1
        assert all(abs(weights[s] * t - got[s]) < 1.01 for s in weights)
    assert t > 300


@pytest.mark.parametrize("weights", [{"a": 0.7, "b": 0.2, "c": 0.1}, {f"s{i}": (1 + i * 37 % 101) ** 0.5 for i in range(40)}, {"big": 30, **{f"s{i}": 1 for i in range(30)}}, {"x": 1e6, "y": 1}])
def test_schedule_keeps_to_the_given_weights(weights):
    """Over many thousand slots, against the exact weights."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total for s, w in weights.items()}
    plan, runs_out = mixing.block_schedule(weights, {s: int(20000 * w) + 2 for s, w in exact.items()})
    assert runs_out > 20_000
    names, got = sorted(weights), dict.fromkeys(weights, 0)
    for t, (i, j, release, deadline, slot) in enumerate(zip(*plan.values(), strict=True)):
        if slot >= runs_out:
            break
        s = names[i]
        # each block inside its window, and none in between: got stays within one block of its weight
        assert slot == t and j == got[s] and release <= slot < deadline
        assert abs(exact[s] * t - got[s]) < 1
        got[s] += 1
        assert abs(exact[s] * (t + 1) - got[s]) < 1
    assert all(abs(exact[s] * runs_out - n) < 1 for s, n in got.items())


def test_mix_keeps_to_uneven_weights(spark):
    weights = {"s0": 0.7, "s1": 0.2, "s2": 0.1}
    rows = [(i, "x" * 100, "s0" if i % 10 < 7 else "s1" if i % 10 < 9 else "s2") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.pfair_mix(df, weights, block_bytes=100).select("source", "position", "on_target").orderBy("position").collect()
    got, n = dict.fromkeys(weights, 0), 0
    for t, r in enumerate(mixed, 1):
        assert r["position"] == t - 1
        if r["on_target"]:
            n, got[r["source"]] = t, got[r["source"]] + 1
            assert all(abs(weights[s] * t - got[s]) < 1 + 1e-9 for s in weights)
    assert n > 5900


def test_mix_of_many_sources(spark):
    rows = [(i, "x" * (1 + i % 7), f"s{i % 1500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.pfair_mix(df, mixing.even_tempered_weights(df), block_bytes=4).collect()
    assert sorted(r["doc_id"] for r in mixed) == list(range(3000))
    assert all(r["release"] < r["deadline"] for r in mixed)


def test_mix_edges(awkward, empty):
    weights = mixing.even_tempered_weights(awkward)
    assert mixing.pfair_mix(awkward, weights).count() == awkward.count()
    assert mixing.pfair_mix(empty, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.pfair_mix(awkward, {"s0": 1.0})


# --- media -------------------------------------------------------------------------------------


def picture(seed, h=160, w=200):
    rng = np.random.default_rng(seed)
    image = np.full((h, w), 128.0)
    for _ in range(60):
        y, x, a, b = rng.integers(0, h - 20), rng.integers(0, w - 20), rng.integers(6, 40), rng.integers(6, 40)
        image[y : y + a, x : x + b] = rng.integers(0, 256)
    return image


def test_crops_and_edits_are_found(spark):
    rows, truth = [], {}
    for i in range(20):
        base = picture(i)
        edited = base.copy()
        edited[40:70, 50:90] = 255
        for k, image in enumerate([base, base[20:150, 30:190], edited, base, np.clip(base * 0.8 + 20, 0, 255)]):
            rows.append((10 * i + k, media.write_map(image)))
            truth[10 * i + k] = 10 * i
    rows += [(900, None), (901, b""), (902, b"P5 broken"), (903, media.write_map(np.zeros((4, 4))))]
    got = {r["image_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert len(got) == len(rows) and all(got[i] == i for i in (900, 901, 902, 903))
    right = sum(got[i] == truth[i] for i in truth)
    assert right >= 0.9 * len(truth), right
    assert all(got[i] // 10 == i // 10 for i in truth)  # no false links


def plain_links(images):
    """Links by comparing every pair of images on all their corners."""
    found, described = set(), {i: media.describe(media.read_map(d)) for i, d in images.items()}
    for a in described:
        for b in described:
            votes = {}
            for t in range(4):
                for p in described[a] if a < b and images[a] != images[b] else []:
                    for q in described[b][described[b][:, 4 + t] == p[4 + t]]:
                        turned, ratio = (q[3] - p[3]) % media.TURNS, q[2] / p[2]
                        c, s = np.cos(turned * (2 * np.pi / media.TURNS)), np.sin(turned * (2 * np.pi / media.TURNS))
                        place = (np.floor((q[0] - ratio * (c * p[0] - s * p[1])) / 8 + 0.5), np.floor((q[1] - ratio * (s * p[0] + c * p[1])) / 8 + 0.5), turned, ratio)
                        votes[place] = votes.get(place, 0) + 1
            if max(votes.values(), default=0) >= max(media.MIN_VOTES, 4 * media.MIN_SHARE * min(len(described[a]), len(described[b]))):
                found.add((a, b))
    return found


@pytest.mark.parametrize("few", [48, 2])
def test_components_are_those_of_all_pairs(spark, few, monkeypatch):
    """Pictures that share parts with several others: whatever the leaders miss is found pair by pair, or in blocks."""
    monkeypatch.setattr(media, "LIST_ENTRIES", few)
    monkeypatch.setattr(media, "BLOCK_ENTRIES", 300)
    rng = np.random.default_rng(4)
    parts = [picture(100 + k, 80, 100) for k in range(5)]
    images = {}
    for i in range(24):
        tiles = [parts[k] if rng.random() < 0.7 else picture(1000 + 4 * i + k, 80, 100) for k in rng.integers(0, 5, 2)]
        images[i] = media.write_map(np.hstack(tiles))
    label = list(range(24))
    for a, b in plain_links(images):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    first = {}
    for i, d in images.items():  # equal pictures are one
        if d in first:
            old, new = max(label[i], label[first[d]]), min(label[i], label[first[d]])
            label = [new if x == old else x for x in label]
        first.setdefault(d, i)
    got = {r["image_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame(list(images.items()), "image_id long, image binary").repartition(3)).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 1


def test_recall_on_rendered_pages(spark, sf_dir):
    """Crops, patches, half size and quarter turns of the pages that the query renders."""
    pages = media.render_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    big = [(r["page_id"], media.read_map(r["image"])) for r in pages]
    big = [(i, m) for i, m in big if m.shape[0] >= 120][:25]
    rows, edits = [], {}
    for i, m in big:
        patched = m.copy()
        patched[20:50, 30:70] = 255
        half = (m[: len(m) // 2 * 2].reshape(len(m) // 2, 2, 64, 2)).mean((1, 3))
        for k, x in enumerate([m, m[10:, 8:-12], patched, np.rot90(m), half]):
            rows.append((10 * i + k, media.write_map(np.rint(x))))
            edits[10 * i + k] = k
    got = {r["image_id"]: r["component_id"] for r in media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    recall = {k: np.mean([got[i] == got[i - k] for i in edits if edits[i] == k]) for k in range(1, 5)}
    assert all(v >= 0.9 for v in recall.values()), recall


def test_descriptors_turn_with_the_image():
    image = picture(3, 120, 120)
    a, b = media.describe(image), media.describe(np.rot90(image).copy())
    bits = lambda d: np.unpackbits(d[:, 4:].astype(">u4").view(np.uint8).reshape(len(d), -1), axis=1)
    near = (bits(a)[:, None, :] != bits(b)[None, :, :]).sum(2).min(1)
    assert (near <= 20).mean() > 0.4


def test_stacked_images_are_described_as_alone(monkeypatch):
    """Images of one width share numpy's calls; small, odd and empty ones among them."""
    images = [picture(300 + i, h, w).astype(np.float32) for i, (h, w) in enumerate([(60, 128), (61, 128), (90, 128), (75, 75), (128, 60), (47, 128)])]
    images += [np.full((h, 128), 9, dtype=np.float32) for h in (1, 22, 23)] + [np.zeros((0, 0), dtype=np.float32)]
    for pixels in (1, 9000, 1 << 18):
        monkeypatch.setattr(media, "STACK_PIXELS", pixels)
        rows, counts = media.describe_all(images)
        assert [len(media.describe(x)) for x in images] == list(counts) and counts.max() > 0
        assert np.array_equal(rows, np.concatenate([media.describe(x) for x in images]))


def test_images_empty(spark):
    assert media.image_copies(spark.createDataFrame([], "image_id long, image binary")).count() == 0


# --- classifiers -------------------------------------------------------------------------------


def auc(score, label):
    order = np.argsort(score, kind="stable")
    _, inverse, counts = np.unique(np.asarray(score)[order], return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    y = np.asarray(label)[order]
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.fixture(scope="module")
def labelled(spark):
    """Made-up documents whose labels show in their words."""
    rng = np.random.default_rng(8)
    usual = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(600)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        words = [usual[k] for k in rng.integers(0, 600, 60)]
        if bad:
            for p in rng.integers(0, 60, 6):
                words[p] = ["zugwart", "kripfel", "mokwash"][p % 3] + "xyz"[i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "parts", "part"), [(toxicity, "toxic", 4, 2), (classifier, "quality", 5, 0)])
def test_held_out_accuracy(module, label, parts, part, labelled):
    docs, labels = labelled
    scored = queries._scored(docs, labels, module, label, parts, part).filter("held_out").join(labels, "doc_id").collect()
    assert auc([r["score"] for r in scored], [r[label] for r in scored]) > 0.95
    assert np.mean([r["predicted"] == r[label] for r in scored]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in scored)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (classifier, "quality")])
def test_scoring_edges(module, label, labelled, awkward, empty):
    docs, labels = labelled
    model = module.train(labelled_sample(docs, labels, label, held_out(4, 2), 300))
    rows = module.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert module.score(empty, model).count() == 0


def test_training_rows_never_held_out(labelled):
    docs, labels = labelled
    known = {t: i for i, t in docs.collect()}
    for text, _ in labelled_sample(docs, labels, "toxic", held_out(4, 2), 10_000):
        assert zlib.crc32(str(known[text]).encode()) % 4 != 2
    assert len(labelled_sample(docs, labels, "toxic", held_out(4, 2), 50)) == 50
    assert docs.filter(held_out(4, 2)).count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(900))
    assert docs.filter(F.col("doc_id").isNull() & held_out(4, 2)).count() == 0
