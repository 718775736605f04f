import time

import pytest

from tidelog.streaming import assembly

LINES = ["2026-06-03T14:00:00 ERROR a", "  at x", "2026-06-03T14:00:01 INFO b", "2026-06-03T14:00:02 INFO c"]
SCHEMA = "source string, pos long, line string"


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(query, spark, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    return q


@pytest.fixture
def data_only(spark):
    """No batches without data: with a processing-time timeout they never end, and nor does processAllAvailable()."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_entries_are_assembled_across_batches(spark, tmp_path, data_only):
    path = str(tmp_path / "in")
    feed(spark, path, [("s", 0, LINES[0])], SCHEMA)
    q = run(assembly.assembled(assembly.follow(spark, path, SCHEMA), idle_ms=600_000), spark, "entries")
    try:
        q.processAllAvailable()
        assert spark.table("entries").count() == 0, "the entry is open"
        feed(spark, path, [("s", 1, LINES[1])], SCHEMA)
        q.processAllAvailable()
        feed(spark, path, [("s", 2, LINES[2]), ("s", 3, LINES[3])], SCHEMA)
        q.processAllAvailable()
        got = [(r["n_lines"], r["text"]) for r in spark.table("entries").orderBy("ts_ms").collect()]
        assert got == [(2, "\n".join(LINES[:2])), (1, LINES[2])]
    finally:
        q.stop()


def test_fragments_are_joined(spark, tmp_path, data_only):
    schema = "partial_id string, arrival long, ts_ms long, text string, partial_last boolean"
    path = str(tmp_path / "in")
    feed(spark, path, [("p", 0, 5, "ab", False), ("q", 1, 6, "x", True)], schema)
    q = run(assembly.reassembled(assembly.follow(spark, path, schema)), spark, "parts")
    try:
        q.processAllAvailable()
        feed(spark, path, [("p", 2, 9, "cd", True)], schema)
        q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("parts").collect()) == [("p", 5, "abcd"), ("q", 6, "x")]
    finally:
        q.stop()


def test_shipping_retries_and_stops_on_refusal(spark, tmp_path):
    schema = "store_id string, chunk_seq long, entry_no long, record string"
    path, log = str(tmp_path / "in"), tmp_path / "sent"
    log.mkdir()
    feed(spark, path, [("s", 0, k, f"r{k}") for k in range(10)], schema)
    folder = str(log)

    def send(store, records):
        import os

        n = len(os.listdir(folder))
        with open(f"{folder}/{n}", "w") as f:
            f.write(",".join(records))
        return 503 if n == 0 else 200

    q = assembly.shipped(assembly.follow(spark, path, schema), send, str(tmp_path / "cp"), batch=4)
    q.awaitTermination(60)
    got = [(log / str(k)).read_text() for k in range(len(list(log.iterdir())))]
    assert got == ["r0,r1,r2,r3", "r0,r1,r2,r3", "r4,r5,r6,r7", "r8,r9"]
    feed(spark, path, [("s", 1, 10, "r10")], schema)
    q = assembly.shipped(assembly.follow(spark, path, schema), lambda s, r: 400, str(tmp_path / "cp"))
    with pytest.raises(Exception, match="permanent"):
        q.awaitTermination(60)
    q = assembly.shipped(assembly.follow(spark, path, schema), send, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert (log / "4").read_text() == "r10", "what was refused is sent again, what was delivered is not"


def test_an_idle_source_gives_up_its_entry(spark, tmp_path):
    path = str(tmp_path / "in")
    feed(spark, path, [("s", 0, LINES[0]), ("s", 1, LINES[1])], SCHEMA)
    q = run(assembly.assembled(assembly.follow(spark, path, SCHEMA), idle_ms=500), spark, "idle")
    try:
        end = time.time() + 40
        while time.time() < end and not spark.table("idle").count():
            time.sleep(1)
        assert [r["text"] for r in spark.table("idle").collect()] == ["\n".join(LINES[:2])]
    finally:
        q.stop()
