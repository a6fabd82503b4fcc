"""Keyed state over several micro-batches: values, maps and lists, initial state, timers, expiry, replays."""

from __future__ import annotations

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docvigil.streaming import logs as L

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
DAY = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Each partition of each batch starts a worker; one will do."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write(spark, folder, n, rows, schema=SCHEMA):
    """One file, read as one micro-batch; files are read in the order of their times."""
    path = f"{folder}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)
    for f in os.listdir(path):
        full = f"{path}/{f}"
        if f.startswith("part") and not os.path.exists(f"{folder}/{f}"):
            open(f"{folder}/{f}", "w").close()
            os.utime(full, (1_700_000_000 + n, 1_700_000_000 + n))


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def event(i, user, kind, days=0.0):
    return (i, DAY + timedelta(days=days), user, kind)


def three(spark, folder):
    write(spark, folder, 1, [event(1, 1, "a"), event(2, 2, "b"), event(3, 1, "b", 0.1)])
    write(spark, folder, 2, [event(4, 1, "a", 1), event(5, 2, "b", 1), event(6, 3, "c", 1)])
    write(spark, folder, 3, [event(7, 2, "a", 2), event(8, 3, "c", 2), event(9, 1, "b", 2)])


def test_conflicts_over_three_batches(spark, tmp_path):
    three(spark, tmp_path)
    found = L.drain(L.stream_conflicts(stream(spark, tmp_path), "user_id", "event_type"), "conflicts").collect()
    assert sorted(r.event_id for r in found) == [3, 7, 9]


def test_initial_state_begins_keys(spark, tmp_path):
    three(spark, tmp_path)
    stored = spark.createDataFrame([(1, 7, "head"), (9, 1, "x")], "user_id long, seq long, head string")
    events = stream(spark, tmp_path).withColumnRenamed("event_type", "action")
    found = L.drain(L.stream_chain(events, "user_id", initial=stored), "chain").collect()
    assert sorted((r.user_id, r.event_id, r.seq) for r in found) == [(1, 1, 8), (1, 3, 9), (1, 4, 10), (1, 9, 11), (2, 2, 1), (2, 5, 2), (2, 7, 3), (3, 6, 1), (3, 8, 2)]
    by_event = {r.event_id: r for r in found}
    assert by_event[1].previous_hash == "head" and by_event[2].previous_hash == "" and by_event[9].previous_hash == by_event[4].event_hash
    jobs = spark.createDataFrame([(1, "running", 1)], "job_id long, status string, attempts int")
    life = stream(spark, tmp_path).select("event_id", "ts", F.col("user_id").alias("job_id"), F.when(F.col("event_type") == "a", "fail").otherwise("start").alias("action"))
    found = {r.event_id: r for r in L.drain(L.stream_jobs(life, most=2, initial=jobs), "jobs").collect()}
    assert [(found[i].status, found[i].attempts, found[i].legal) for i in (1, 3, 4, 9)] == [("queued", 1, True), ("running", 2, True), ("failed", 2, True), ("failed", 2, False)]
    assert not found[2].legal


def test_a_horizon_forgets_keys_by_timers(spark, tmp_path):
    write(spark, tmp_path, 1, [event(1, 1, "a"), event(2, 2, "a")])
    write(spark, tmp_path, 2, [event(3, 2, "b", 4)])  # the watermark passes both keys' first events; only key 2 comes back in time
    write(spark, tmp_path, 3, [event(4, 3, "a", 9)])
    write(spark, tmp_path, 4, [event(5, 1, "b", 9.5), event(6, 2, "c", 9.5)])
    run = lambda **k: sorted(r.event_id for r in L.drain(L.stream_conflicts(stream(spark, tmp_path), "user_id", "event_type", **k), "h").collect())
    assert run(horizon="30 days") == [3, 5, 6]
    assert run(horizon="1 day") == [3]  # the keys are new in the last batch


def test_values_expire_by_processing_time(spark, tmp_path):
    """A stream with a time to live goes on for ever, so it is stopped from outside."""
    write(spark, tmp_path, 1, [event(1, 1, "a"), event(2, 1, "b", 0.1)])
    write(spark, tmp_path, 2, [event(3, 1, "b", 1)])
    out = str(tmp_path / "out")
    found = L.stream_conflicts(stream(spark, tmp_path), "user_id", "event_type", ttl=1)
    query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(processingTime="1 second").start()
    try:
        for _ in range(100):
            if query.exception() is not None or (query.lastProgress or {"batchId": 0})["batchId"] >= 2:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r.event_id for r in spark.read.schema(found.schema).parquet(out).collect()] == [2]  # only what one batch holds together


REVIEW = "event_id long, ts timestamp, user_id long, actor long, action string, hash string"


def reviews(rows):
    return [(i, DAY + timedelta(minutes=i), 1, *r) for i, r in rows]


@pytest.mark.parametrize("split", [(4, 8), (6, 6)])
def test_reviews_keep_editors_and_marks_between_batches(spark, tmp_path, split):
    rows = reviews(enumerate([
        (1, "approve", "x"), (1, "edit", "x"), (2, "edit", "y"), (1, "approve", "y"), (3, "approve", "x"), (3, "needs_fix", None), (4, "needs_fix", None), (3, "approve", "y"),
        (5, "edit", "z"), (3, "approve", "z"), (5, "approve", "z"), (None, "edit", "q"), (None, "approve", "z")]))
    for n, part in enumerate((rows[: split[0]], rows[split[0] : split[1]], rows[split[1] :])):
        if part:
            write(spark, tmp_path, n, part, REVIEW)
    got = {r.event_id: r.against for r in L.drain(L.stream_reviews(stream(spark, tmp_path, REVIEW), "user_id"), "reviews").collect()}
    assert got == {0: "no edit", 3: "same actor", 4: "stale text", 7: "needs fix", 9: "", 10: "same actor", 12: ""}


def test_reviews_begin_with_what_was_stored(spark, tmp_path):
    write(spark, tmp_path, 1, reviews([(1, (7, "approve", "x")), (2, (8, "approve", "x"))]), REVIEW)
    write(spark, tmp_path, 2, reviews([(3, (9, "edit", "y")), (4, (8, "approve", "y")), (5, (7, "approve", "x"))]), REVIEW)
    stored = spark.createDataFrame([(1, "x", ["7", "6"], True)], "user_id long, text string, editors array<string>, marked boolean")
    got = {r.event_id: r.against for r in L.drain(L.stream_reviews(stream(spark, tmp_path, REVIEW), "user_id", initial=stored), "reviews").collect()}
    assert got == {1: "needs fix; same actor", 2: "needs fix", 4: "", 5: "same actor; stale text"}


DOCS = "doc_id long, source string"


def test_running_counts_equal_the_batch_after_replays(spark, tmp_path):
    blocks = spark.createDataFrame([(d, b, (d + b) % 3 == 0) for d in range(12) for b in range(d % 4)], "doc_id long, block_id long, requires_review boolean")
    decided = spark.createDataFrame([(3, 0), (3, 0), (9, 0), (5, 1)], "doc_id long, block_id long")
    docs = [(d, "ab"[d % 2]) for d in range(12)]
    folder = str(tmp_path / "counts")

    def counted():
        items = L.review_items(stream(spark, tmp_path, DOCS), blocks, decided)
        return sorted(tuple(r) for r in L.keep_latest(L.running_counts(items, ["source"]), ["source"], "counts", folder).collect())

    def plain(rows):
        out = {}
        for d, s in rows:
            for b in range(d % 4):
                n = out.setdefault(s, [0, 0, 0])
                review = (d + b) % 3 == 0
                n[0], n[1], n[2] = n[0] + 1, n[1] + review, n[2] + (review and (d, b) not in {(3, 0), (9, 0), (5, 1)})
        return sorted((s, *n) for s, n in out.items())

    for n, part in enumerate((docs[:4], docs[4:7])):
        write(spark, tmp_path, n, part, DOCS)
    assert counted() == plain(docs[:7])
    os.remove(f"{folder}/log/commits/1")  # as if the driver had died after the batch's rows were written
    for crc in (f"{folder}/log/commits/.1.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    assert counted() == plain(docs[:7])
    write(spark, tmp_path, 2, docs[7:], DOCS)
    assert counted() == plain(docs)
    assert counted() == plain(docs)  # nothing new


def test_recorded_values_stay_as_they_are(spark, tmp_path):
    """Rows reach the state without a frame: NaN stays NaN beside null, and a long beside null stays a long."""
    schema = "event_id long, ts timestamp, user_id long, value double, n long"
    write(spark, tmp_path, 1, [(1, DAY, 1, float("nan"), 2**60 + 1), (2, DAY, 2, None, None), (3, DAY + timedelta(1), 1, 5.0, None)], schema)
    found = {r.event_id: r for r in L.drain(L.stream_record_once(stream(spark, tmp_path, schema), ["user_id"], ["value", "n"]), "recorded").collect()}
    assert found[3].first_value != found[3].first_value and found[3].first_n == 2**60 + 1 and found[3].repeated
    assert found[2].first_value is None and found[2].first_n is None
