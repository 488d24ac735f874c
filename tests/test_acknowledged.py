"""A consumer that acknowledges: redelivery, dead messages, and a batch that fails and comes again."""

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import jobs


def table(spark, folder, ids, mode="append"):
    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in ids], "event_id long, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    rows.write.mode(mode).parquet(f"{folder}/events.parquet")


def test_unacknowledged_messages_come_again(spark, tmp_path):
    table(spark, tmp_path / "in", range(30))
    seen = []

    def handle(messages):
        seen.extend((r["event_id"], r["deliveries"]) for r in messages.collect())
        return messages.filter("event_id % 5 > 0 or deliveries > 2 and event_id > 0")

    done = {r["event_id"]: r["deliveries"] for r in jobs.acknowledged(spark, str(tmp_path / "in"), handle, most=4, out=f"file://{tmp_path}/out").collect()}
    assert done == {i: 1 if i % 5 else 3 for i in range(1, 30)}
    dead = spark.read.parquet(f"file://{tmp_path}/out/dead/*").collect()
    assert [(r["event_id"], r["deliveries"]) for r in dead] == [(0, 4)]
    assert sorted(d for i, d in seen if i == 0) == [1, 2, 3, 4]
    # new files go on; what is done is not delivered again
    before = len(seen)
    table(spark, tmp_path / "in", range(30, 40))
    done = {r["event_id"] for r in jobs.acknowledged(spark, str(tmp_path / "in"), handle, most=4, out=f"file://{tmp_path}/out").collect()}
    assert done == set(range(1, 40)) and {i for i, _ in seen[before:]} == set(range(30, 40))


def test_a_lost_batch_is_delivered_again(spark, tmp_path):
    table(spark, tmp_path / "in", range(10))
    out, fail = f"file://{tmp_path}/out", [True]

    def handle(messages):
        if fail[0]:
            raise RuntimeError("the consumer died")
        return messages

    with pytest.raises(Exception, match="died"):
        jobs.acknowledged(spark, str(tmp_path / "in"), handle, out=out)
    fail[0] = False
    done = jobs.acknowledged(spark, str(tmp_path / "in"), handle, out=out)
    assert sorted((r["event_id"], r["deliveries"]) for r in done.collect()) == [(i, 1) for i in range(10)]
