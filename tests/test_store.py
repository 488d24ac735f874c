"""The store's copy-on-write and pointer, reconciliation, and resumable connectors."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.sources import connectors
from lodestone.sources.store import Store, reconcile


def rows(spark, items):
    return spark.createDataFrame(items, "id int, file int, t string")


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "id", "file")
    store.insert(rows(spark, [(i, i % 12, "a") for i in range(60)]))
    before = store._manifest(store._pointer())[1]
    store.replace_files(rows(spark, [(100, 3, "new")]))
    after = store._manifest(store._pointer())[1]
    changed = {b for b in before if before[b] != after.get(b)}
    assert len(changed) == 1 and len(before) > 3 and set(store.read().filter("file = 3").toPandas()["id"]) == {100} and store.read().count() == 56
    # a key that moves to another file leaves its old one
    store.upsert(rows(spark, [(100, 4, "moved")]))
    assert [tuple(r) for r in store.read().filter("id = 100").collect()] == [(100, 4, "moved")]
    assert len({b for b in after if after[b] != store._manifest(store._pointer())[1].get(b)}) <= 2
    store.delete(F.col("file") == 4)
    store.update(F.col("file") == 5, {"t": F.lit("u")})
    assert {r["t"] for r in store.read().filter("file = 5").collect()} == {"u"} and store.read().filter("file = 4").isEmpty()
    store.delete(F.lit(True))
    assert store.read().count() == 0 and store.read().columns == ["id", "file", "t"]


def test_of_two_writers_one_fails(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "id", "file")
    store.insert(rows(spark, [(1, 1, "a")]))
    first, wins = store._pointer(), []
    store.replace_files(rows(spark, [(2, 1, "b")]))
    number = store._latest()[0]

    def move():
        try:
            store._move(number + 1, first)
            wins.append(1)
        except RuntimeError:
            pass

    racers = [threading.Thread(target=move) for _ in range(6)]
    for r in racers:
        r.start()
    for r in racers:
        r.join()
    assert len(wins) == 1 and store._pointer() == first
    # a pointer that its writer did not finish is passed over, and its number is not used again
    jvm, fs = store._files()
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{store.folder}/CURRENT-{number + 2:012d}"), False).close()
    assert store._pointer() == first and store.switch(first, expected=first) == first and store._latest()[0] == number + 3


def test_reconcile_until_stable(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "id", "file")
    store.insert(rows(spark, [(1, 1, "v1"), (2, 1, "v1"), (9, 3, "v1")]))
    states = [[(1, 1, "v1"), (2, 1, "v2"), (3, 2, "v1")], [(1, 1, "v1"), (2, 1, "v3"), (3, 2, "v1")]]
    looks = []

    def snapshot():
        looks.append(1)
        return rows(spark, states[min(len(looks) - 1, 1)])

    assert reconcile(store, snapshot, "t") == (2, True) and len(looks) == 3
    assert sorted(map(tuple, store.read().collect())) == sorted(states[1])
    turn = iter(range(100))
    assert reconcile(store, lambda: rows(spark, [(1, 1, f"w{next(turn)}")]), "t") == (3, False)


def write(folder, page, items, end="\n"):
    with open(folder / page, "a") as f:
        f.write("".join((x if isinstance(x, str) else json.dumps(x)) + end for x in items))


def test_stream_resumes_inside_a_page(spark, tmp_path):
    """Killed between batches, and with a page that grows: no row twice, none lost; broken rows are failures of their own."""
    folder = tmp_path / "pages"
    folder.mkdir()
    connectors.register(spark)
    write(folder, "page-0.jsonl", [{"id": i, "text": "x", "updated_at": i} for i in range(5)] + ["broken"])

    def run():
        q = spark.readStream.format("paged").option("path", str(folder)).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    write(folder, "page-0.jsonl", [{"id": 5, "text": "x"}])
    write(folder, "page-1.jsonl", [{"id": 6}, {"id": 7}])
    write(folder, "page-1.jsonl", ['{"id": 8'], end="")  # not written to its end yet
    run()
    run()
    write(folder, "page-1.jsonl", ["}", {"id": 9}])
    run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(int(r["id"]) for r in got if r["id"]) == list(range(10)) and sum(r["error"] is not None for r in got) == 1


def test_checkpoints_are_validated(tmp_path):
    for bad in ({}, {"page": "p"}, {"page": 1, "row": 0}, {"page": "p", "row": -1}, {"page": "", "row": 3}, {"page": "p", "row": 1, "x": 0}):
        with pytest.raises(ValueError, match="not a checkpoint"):
            connectors.validate_checkpoint(bad)
    write(tmp_path, "page-0.jsonl", [{"id": 1}])
    reader = connectors._Poll(connectors.Connector({"path": str(tmp_path)}), False)
    assert reader.latestOffset() == {"page": "page-0.jsonl", "row": 1} and [p.stop for p in reader.partitions(reader.initialOffset(), reader.latestOffset())] == [1]
    with pytest.raises(ValueError, match="no longer"):
        reader.partitions(reader.initialOffset(), {"page": "page-0.jsonl", "row": 2})


def test_slim_listing_has_permissions(spark, tmp_path):
    write(tmp_path, "page-0.jsonl", [{"id": 1, "text": "secret", "updated_at": 4, "groups": ["a", "b"]}, {"id": 2, "updated_at": 9}, "broken"])
    connectors.register(spark)
    got = spark.read.format("paged").option("path", str(tmp_path)).option("slim", "true").load()
    assert got.columns == ["id", "updated_at", "groups", "error"]
    assert sorted(((r["id"] or "", r["groups"]) for r in got.collect()), key=str) == [("", None), ("1", ["a", "b"]), ("2", None)]
