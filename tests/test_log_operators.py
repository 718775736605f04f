"""The reference behaviours on small fixtures, and laws that must hold for any input."""

import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import text as T
from tidelog.functions import times
from tidelog.operators import chunks as C
from tidelog.operators import entries as E
from tidelog.operators import ingest, manifest, order, standing
from tidelog.operators.predicates import Predicates, chunk_has
from tidelog.operators.stamps import stamp_millis
from tidelog.sources import forward, otlp, records
from tidelog.store import Store, fleet, validate


def lines(spark, rows):
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(rows)], "store_id string, line_no long, line string")
    return df.withColumn("ts_ms", stamp_millis(F.col("line")))


def stamps(spark, rows):
    return [r[0] for r in lines(spark, rows).orderBy("line_no").select("ts_ms").collect()]


def test_stamp_forms(spark):
    t = 1_780_495_200_000  # 2026-06-03T14:00:00Z
    assert stamps(spark, ["2026-06-03T14:00:00 x", "2026.06.03 14:00:00,250 x", "2026-06-03 14:00:00.123456789Z", "2026-06-03T16:00:00+0200 x", "2026-06-03T16:00:00:5+02:00"]) == [t, t + 250, t + 123, t, t + 500]
    assert stamps(spark, ["1.2.3.4 [03/Jun/2026:16:00:00 +0200] GET", "[Wed Jun  3 14:00:00 2026] [error]", "[Wed Jun 03 14:00:00.250000 2026] x", "1780495200 up", "1780495200123 up", "17804952001 no"]) == [t, t, t + 250, t, t + 123, None]
    # The first form that matches decides, even if its value is no time; unbracketed ctime is none; before 1970 is none.
    assert stamps(spark, ["2026-13-03T14:00:00 [03/Jun/2026:16:00:00 +0200]", "Wed Jun  3 14:00:00 2026", "1969-12-31T23:59:59", "no stamp", "x" * 300 + " [03/Jun/2026:16:00:00 +0200]"]) == [None] * 5
    assert stamps(spark, ["2026-06-03T14:00:00 [Thu Jun  4 14:00:00 2026]"]) == [t]
    assert stamps(spark, ["2026-06-03T13:59:60 x", "2026-06-03T13:59:60.25Z x", "a [03/Jun/2026:13:59:60 +0000]", "[Wed Jun  3 13:59:60 2026]", "[Tue Jun  3 14:00:00 2026]", "2026-06-03T13:59:61"]) == [t, t + 250, t, t, None, None]
    assert lines(spark, ["at=20260603/1400 x"]).select(stamp_millis(F.col("line"), r"at=(\S+)", "yyyyMMdd/HHmm")).first()[0] == t
    with pytest.raises(ValueError):
        stamp_millis(F.lit("x"), regex="x")


def test_entries_and_inheritance(spark):
    rows = ["  head", "  less", "2026-06-03T14:00:00 ERROR a", "  at x", "  at y", "2026-06-03T14:00:05 INFO b"]
    got = E.group_entries(lines(spark, rows)).orderBy("entry_no").collect()
    assert [(r["entry_no"], r["n_lines"], r["ts_ms"]) for r in got] == [(0, 2, None), (2, 3, 1780495200000), (5, 1, 1780495205000)]
    assert got[1]["text"] == "\n".join(rows[2:5])
    eff = [r["eff_ms"] for r in E.inherit_stamps(lines(spark, rows)).orderBy("line_no").collect()]
    assert eff == [1780495200000] * 5 + [1780495205000]


def test_carried_is_the_same_for_any_block(spark):
    rng = random.Random(3)
    rows = [("ab"[k % 2], k, rng.choice([None, None, k])) for k in range(300)]
    df = spark.createDataFrame(rows, "store_id string, line_no long, v long")
    want, last = {}, {}
    for s, k, v in rows:
        last[s] = v if v is not None else last.get(s)
        want[k] = last[s]
    for block in (1, 7, 1000):
        assert {r["line_no"]: r["x"] for r in E.carried(df, F.col("v"), "x", block=block).collect()} == want


def test_predicates(spark):
    texts = ["ERROR tenant=FOO\n  at main", "INFO tenant=BAR error", "xERRORx", "a.b*c", "Übergröße", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pick = lambda **k: [texts.index(r[0]) for r in df.where(Predicates(**k).entry(F.col("text"))).collect()]
    assert pick(has=["ERROR"]) == [0] and pick(has_caseless=["error"]) == [0, 1] and pick(substring=["ERROR"]) == [0, 2]
    assert pick(substring=["b*c"]) == [3] and pick(has=["b*c"]) == [3] and pick(substring_caseless=["ÜBER"]) == [4]
    assert pick(regex=["^  at"]) == [0] and pick(any=["FOO", "BAR"]) == [0, 1] and pick(has=["tenant"], not_substring=["BAR"]) == [0]
    assert pick() == list(range(6)) and pick(not_regex=["."]) == [5]
    with pytest.raises(ValueError):
        pick(regex=[r"(?=x)"])
    with pytest.raises(ValueError):
        chunk_has(F.col("tokens"), "--")


def test_pruning_never_hides_a_match(spark):
    rng = random.Random(5)
    words = ["alpha", "beta-7", "user=12", "x", "GET", "/a/b", "ERROR", "tail"]
    rows = [("s", k // 10, k, k, k, k, " ".join(rng.choice(words) for _ in range(4))) for k in range(400)]
    e = spark.createDataFrame(rows, "store_id string, chunk_seq long, entry_no long, ts_ms long, wf_ms long, wl_ms long, text string").cache()
    index = C.chunk_tokens(e).where("seq % 4 <> 1")  # some chunks have no index
    chunks = C.chunk_index(e).join(index, ["store_id", "seq"], "left").cache()
    for p in (Predicates(has=["user=12"]), Predicates(substring=["a-7 u"]), Predicates(substring=[" user=12 "], any=["GET", "x"]), Predicates(any=["tail", "ERROR"], has_caseless=["get"]), Predicates(any=["--", "GET"]), Predicates(not_has=["GET"], regex=["^alpha"])):
        keep = chunks.where(p.chunk(F.col("tokens"))).select("store_id", F.col("seq").alias("chunk_seq"))
        full = {r["entry_no"] for r in e.where(p.entry(F.col("text"))).collect()}
        assert {r["entry_no"] for r in e.join(keep, ["store_id", "chunk_seq"], "left_semi").where(p.entry(F.col("text"))).collect()} == full


def test_interior_tokens_are_whole_tokens_of_any_match():
    rng = random.Random(1)
    for _ in range(3000):
        literal = "".join(rng.choice("ab1-. ") for _ in range(rng.randint(1, 14)))
        text = "".join(rng.choice("ab1-. ") for _ in range(4)) + literal + "".join(rng.choice("ab1-. ") for _ in range(4))
        assert set(T.interior_tokens(literal)) <= set(T.tokens_of(text))


def test_merge_is_that_of_a_head_of_queue(spark):
    rng = random.Random(2)
    src = {s: [rng.randint(0, 30) for _ in range(rng.randint(1, 8))] for s in "abc"}
    rows = [(s, k, t, t) for s, ts in src.items() for k, t in enumerate(ts)]
    at, want = dict.fromkeys(src, 0), []
    while any(at[s] < len(src[s]) for s in src):
        s = min((s for s in src if at[s] < len(src[s])), key=lambda s: (src[s][at[s]], s))
        want.append((s, at[s]))
        at[s] += 1
    c = spark.createDataFrame(rows, "store_id string, seq long, first_write_ms long, last_write_ms long")
    got = order.merge_key(c).orderBy("merge_ms", "store_id", "seq").collect()
    assert [(r["store_id"], r["seq"]) for r in got] == want


def test_stitch_refuses_equal_starts(spark):
    df = spark.createDataFrame([("a", 0, 5), ("b", 0, 3), ("c", 0, None)], "source string, line_no long, ts_ms long")
    assert [r["source"] for r in order.stitch_order(df).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        order.stitch_order(df.union(spark.createDataFrame([("d", 0, 5)], df.schema)))


def test_greedy_chunks(spark):
    rng = random.Random(4)
    rows = [(s, k, "x" * rng.randint(0, 40)) for s in "ab" for k in range(200)]
    want, seq, size, store = {}, 0, 0, None
    for s, k, t in rows:
        if s != store:
            store, seq, size = s, 0, 0
        want[s, k] = seq
        size += len(t) + 1
        if size >= 100:
            seq, size = seq + 1, 0
    df = spark.createDataFrame(rows, "store_id string, entry_no long, text string")
    assert {(r[0], r[1]): r["chunk_seq"] for r in C.greedy_chunks(df, 100).collect()} == want


def test_bloom_has_no_false_negatives_and_few_false_positives():
    words = [f"tok{k}" for k in range(2000)]
    bloom = C.bloom_of(words)
    assert len(bloom) * 8 == 20032 and all(C.bloom_has(bloom, [w]) for w in words)
    assert sum(C.bloom_has(bloom, [f"no{k}"]) for k in range(5000)) < 100
    assert C.bloom_has(C.bloom_of([]), []) and not C.bloom_has(C.bloom_of([]), ["a"])


def test_overlap_dedup_keeps_order_and_counts(spark):
    src = spark.createDataFrame([("s", k, x, t) for k, (x, t) in enumerate([("a", 1), ("b", 2), ("b", 2), ("c", 3), ("b", 9)])], "store_id string, pos long, line string, eff_ms long")
    held = spark.createDataFrame([("s", "a", 1), ("s", "b", 3)], "store_id string, line string, eff_ms long")
    assert [r["pos"] for r in ingest.overlap_dedup(src, held).orderBy("pos").collect()] == [2, 3, 4]
    assert ingest.overlap_dedup(src, src.select("store_id", "line", "eff_ms")).count() == 0
    assert ingest.overlap_dedup(src, held.limit(0)).count() == 5
    late = held.withColumn("eff_ms", F.lit(5).cast("long"))
    assert [r["store_id"] for r in ingest.refused(src, late).collect()] == ["s"] and ingest.refused(src, held).count() == 0


def test_overlap_begins_at_the_source(spark, tmp_path):
    held = spark.createDataFrame([("s", "beat", 1, 0), ("s", "a", 2, 0), ("s", "b", 5, 1), ("s", "c", 7, 1), ("s", "d", 9, 2), ("t", "beat", 1, 0)], "store_id string, line string, eff_ms long, chunk_seq long")
    chunks = held.groupBy("store_id", F.col("chunk_seq").alias("seq")).agg(F.max("eff_ms").alias("last_write_ms"))
    src = spark.createDataFrame([("s", 0, "c", 7), ("s", 1, "beat", 7), ("s", 2, "b", 8), ("s", 3, "d", 9), ("s", 4, "beat", 9), ("t", 0, "beat", 1)], "store_id string, pos long, line string, eff_ms long")
    # The chunk that the source starts in counts whole, those before it not at all.
    assert [(r["store_id"], r["pos"]) for r in ingest.overlap_dedup(src, held, chunks).orderBy("store_id", "pos").collect()] == [("s", 1), ("s", 4)]
    df = lambda rows: spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "pos long, line string")
    at = lambda k: f"2026-06-03T14:{k // 60:02d}:{k % 60:02d} INFO event number {k}"
    s = Store.create(spark, str(tmp_path / "o"))
    assert s.ingest(df([at(0), "  at main", *[at(k) for k in range(1, 600)]]), 2048) == 600
    s.ingest(df([at(500), "  at main", *[at(k) for k in range(501, 600)]]), 2048)
    kept = sum(r["text"].split("\n").count("  at main") for r in s.entries().collect())
    assert kept == 2, "a trace line equal to one stored long before is new"
    with pytest.raises(ValueError, match="before everything"):
        s.ingest(df(["2026-06-03T13:59:59 INFO early"]))


def test_interest_and_retention(spark):
    chunks = spark.createDataFrame([("s", k, 100, 100, k * 10, k * 10 + 5) for k in range(10)], "store_id string, seq long, uncomp_len long, comp_len long, first_write_ms long, last_write_ms long")
    stores = spark.createDataFrame([("s", 10)], "store_id string, next_seq long")
    fol = lambda *rows: spark.createDataFrame([(n, "s", r, q) for n, r, q in rows], "name string, store_id string, retaining boolean, seq long")
    floor = lambda f: standing.interest_floor(f, stores).first()["floor"]
    assert floor(fol(("a", True, 4), ("b", True, 7), ("c", False, 1))) == 4
    assert floor(fol(("a", True, 4), ("b", True, None))) is None and floor(fol(("a", True, 10))) is None and floor(fol(("a", False, 3))) is None
    floors = standing.interest_floor(fol(("a", True, 4)), stores)
    drop = lambda cutoff, budget, fl=floors: tuple(standing.retention_drop(chunks, fl, cutoff, budget, 0).first()[1:])
    assert drop(0, 10**6) == (0, 0, 4, 4) and drop(60, 10**6) == (6, 0, 4, 6) and drop(0, 500) == (0, 6, 4, 6)
    none = standing.interest_floor(fol(("a", True, None)), stores)
    assert drop(0, 10**6, none) == (0, 0, 0, 0)
    drops = standing.retention_drop(chunks, none, 60, 10**6, 0)
    assert tuple(standing.loss_record(chunks, drops, fol(("a", True, 3), ("b", True, 5))).first()) == ("s", "a", 3, 5)
    assert standing.loss_record(chunks, drops, fol(("a", True, 8))).count() == 0
    assert C.leading_run(chunks.withColumn("last_write_ms", F.when(F.col("seq") == 2, 999).otherwise(F.col("last_write_ms"))), 60).count() == 2


def test_resume_of_all_cursors(spark, sf):
    from tidelog.plans import catalog

    e = [("s" if k % 3 else "t", k // 7, k, f"x{k}") for k in range(400)]
    c = [(f"c{k}", "st"[k % 2], k % 61 - 1, k % 5) for k in range(90)]
    got = standing.resume(spark.createDataFrame(e, "store_id string, chunk_seq long, entry_no long, text string"), spark.createDataFrame(c, "consumer string, store_id string, seq long, n long"))
    want = []
    for consumer, store, seq, n in c:
        mine = [x for x in e if x[0] == store]
        first = [x[2] for x in mine if x[1] == seq][:n]
        want += [(consumer, *x) for x in mine if x[1] >= seq and x[2] not in first]
    assert sorted(tuple(r) for r in got.select("consumer", "store_id", "chunk_seq", "entry_no", "text").collect()) == sorted(want)
    # The query leaves out no consumer that has something to read.
    behind = catalog._cursors(spark, sf).join(catalog.vital_signs(spark, sf), "store_id").where("last_seq > seq").select("consumer")
    assert behind.count() > 4 and behind.join(catalog.resume_skip(spark, sf), "consumer", "left_anti").count() == 0


def test_resume_is_dealt_over_tasks(spark):
    """The inputs are small beside the result: no task makes most of it, nor with many consumers of one block of one store."""
    from tidelog.plans import catalog

    d = "/root/testdata/sf0.01"
    got = standing.resume(catalog._entries(spark, d), catalog._cursors(spark, d), per_task=100_000)
    made = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == catalog.resume_skip(spark, d).count() == 783_948 and max(made) < sum(made) / 2

    e = spark.range(600).select(F.lit("s").alias("store_id"), F.floor(F.col("id") / 100).alias("chunk_seq"), F.col("id").alias("entry_no"))
    c = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("consumer"), F.lit("s").alias("store_id"), (F.col("id") % 3).alias("seq"), (F.col("id") % 7).alias("n"))
    got = standing.resume(e, c, per_task=50_000)
    made = [r[1] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == got.distinct().count() == sum(600 - 100 * (k % 3) - k % 7 for k in range(5000)) and max(made) < sum(made) / 2
    assert standing.resume(e.where("entry_no < 0"), c).count() == standing.resume(e, c.where("n < 0")).count() == 0


def test_resume_shuffles_by_its_inputs(spark):
    """Neither consumers are copied for each block of chunks, nor entries for each group of consumers; long chunks come in parts."""
    sc = spark.sparkContext

    def stages():
        listed = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (listed.apply(i) for i in range(listed.size()))}

    # The last chunk, 600, has 700 entries, the others have ten.
    e = spark.range(6700).select(F.lit("s").alias("store_id"), F.least(F.floor(F.col("id") / 10), F.lit(600)).alias("chunk_seq"), F.col("id").alias("entry_no"))
    at = [*((f"c{k}", k % 5, k % 7) for k in range(4000)), ("half", 600, 300), ("almost", 600, 699), ("done", 600, 700), ("never", None, 0), ("gone", 601, 0)]
    c = spark.createDataFrame([(x, "s", seq, n) for x, seq, n in at] + [("other", "t", 0, 0)], "consumer string, store_id string, seq long, n long")
    before, got = stages(), standing.resume(e, c)
    got.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    assert 0 < sum(n for k, n in stages().items() if k not in before) < 2 * (6700 + len(at))
    want = {x: (6700 - first, first, (6700 - first) * (first + 6699) // 2) for x, seq, n in at if seq in range(601) and (first := seq * 10 + n) < 6700}
    made = got.groupBy("consumer").agg(F.count("*"), F.min("entry_no"), F.sum("entry_no")).collect()
    assert len(want) == 4002 and {x[0]: x[1:] for x in map(tuple, made)} == want


def test_times():
    assert times.parse_time("2026-06-03T16:00:00+02:00") == times.parse_time("2026-06-03 14:00") == times.parse_time("1780495200") == times.parse_time("1780495200000")
    assert times.parse_time("2026.06.03") == times.parse_time("2026-06-03T00:00:00Z") and times.parse_duration("1.5h") == 5_400_000 and times.parse_duration("90") == 90_000
    assert times.parse_size("64K") == 65536 and times.parse_size("1.5GiB") == 3 << 29
    for bad in ("soon", "2026-06"):
        with pytest.raises(ValueError):
            times.parse_time(bad)


def test_manifest_checks():
    assert manifest.checked({"index": True, "service": "x"})
    for bad in ({"index": "true"}, {"service": 3}, {"a=b": "x"}, {"retain_unconsumed": True}, {"timestamp_regex": "x"}):
        with pytest.raises(ValueError):
            manifest.checked(bad)


def test_validation():
    validate(1, 2, max_n=3)
    for bad in ({"start": 2, "end": 1}, {"has": ["x"], "follow": True}, {"from_chunk": 1}, {"tail": 1, "max_n": 1}, {"any_": ["x"], "tail": 2}):
        with pytest.raises(ValueError):
            validate(**bad)


ROWS = [("a", 1, 2, 3, 0, b"one\ntwo"), ("b", None, None, None, None, b"\0\x1e\0nul")]


def test_record_stream_round_trip(spark, tmp_path):
    data = records.write_stream(ROWS, [("from", 1), ("has", "x")], stages=["grep"])
    assert records.is_record_stream(data) and records.entries_of(data) == ROWS
    for cut in range(1, len(data)):
        with pytest.raises(records.StreamError):
            records.entries_of(data[:cut])
    with pytest.raises(records.StreamError):
        records.entries_of(data.replace(b"v=1", b"v=2"))
    assert records.entries_of(data.replace(b"\x1estream-end", b"\x1efuture\x1fk=v\0\x1estream-end")) == ROWS
    spark.dataSource.register(records.RecordStreamSource)
    df = spark.createDataFrame(ROWS, records.SCHEMA)
    df.coalesce(1).write.format("tidelog-records").option("path", str(tmp_path / "out")).mode("append").save()
    files = ",".join(str(p) for p in (tmp_path / "out").iterdir())
    got = spark.read.format("tidelog-records").option("paths", files).load().collect()
    assert sorted(map(str, ((*r[1:-1], bytes(r[-1])) for r in got))) == sorted(map(str, ((*r[1:-1], bytes(r[-1])) for r in ROWS)))


def test_forward_modes():
    rec = b"\x82\xa3log\xa3hi\n\xa1k\x01"
    pair = b"\x92\xce\x65\x00\x00\x00" + rec
    t = 0x65000000 * 1000
    assert forward.decode_message(b"\x93\xa3tag\xce\x65\x00\x00\x00" + rec, 0)[1][0][0] == t
    tag, entries, chunk = forward.decode_message(b"\x93\xa3tag\x92" + pair + pair + b"\x81\xa5chunk\xa2id", 0)
    assert (tag, len(entries), chunk, forward.payload(entries[0][1], "log")) == ("tag", 2, "id", "hi")
    packed = forward.decode_message(b"\x92\xa3tag\xc4" + bytes([2 * len(pair)]) + pair + pair, 0)[1]
    assert len(packed) == 2 and forward.payload(packed[0][1], "no") == '{"log":"hi\\n","k":1}'
    ext = forward.decode_message(b"\x93\xa1t\xd7\x00" + struct.pack(">II", 5, 7_000_000) + rec, 0)[1][0][0]
    assert ext == 5007 and forward.time_millis(None, 9) == 9 and forward.time_millis(0, 9) == 9 and forward.time_millis(1.5, 9) == 1500
    with pytest.raises(forward.Unsupported):
        forward.decode_message(b"\x93\xa1t\xc4\x01\x00\x81\xaacompressed\xa4gzip", 0)
    for bad in (b"\xa1t", b"\x91\xa1t", b"\x92\x01\x01", b"\x93\xa1t", b"\x92\xa1t\xc0"):
        with pytest.raises(ValueError):
            forward.decode_message(bad, 0)


def _pb(n, wire, v):
    def varint(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    return varint(n << 3 | wire) + (varint(v) if wire == 0 else v if wire == 1 else varint(len(v)) + v)


def test_otlp_encodings_agree(spark):
    value = lambda s: _pb(1, 2, s)
    kv = lambda k, v: _pb(1, 2, k) + _pb(2, 2, v)
    ns = (1_700_000_000_123_456_789).to_bytes(8, "little")
    rec = _pb(1, 1, ns) + _pb(11, 1, bytes(8)) + _pb(3, 2, b"WARN") + _pb(5, 2, value(b"body")) + _pb(6, 2, kv(b"k", _pb(3, 0, 7))) + _pb(9, 2, b"\x01" * 16) + _pb(10, 2, bytes(8))
    req = _pb(1, 2, _pb(1, 2, _pb(1, 2, kv(b"service.name", value(b"svc")))) + _pb(2, 2, _pb(2, 2, rec) + _pb(2, 2, _pb(3, 2, b"no body"))))
    as_json = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "1700000000123456789", "observedTimeUnixNano": 0, "severityText": "WARN", "body": {"stringValue": "body"}, "attributes": [{"key": "k", "value": {"intValue": "7"}}], "traceId": "01" * 16, "spanId": "0" * 16}, {"severityText": "no body"}]}]}]}
    a = otlp.decode_protobuf(spark.createDataFrame([(bytearray(req),)], "value binary")).drop("request_no").collect()
    b = otlp.decode_json(spark.createDataFrame([(json.dumps(as_json),)], "value string")).drop("value").collect()
    assert a == b and len(a) == 1 and a[0]["attrs"][1]["key"] == "trace_id" and a[0]["time_ms"] == 1_700_000_000_123 and a[0]["observed_ms"] is None
    with pytest.raises(ValueError):
        otlp.decode_request(b"")
    with pytest.raises(ValueError):
        otlp.decode_request(req[:-3])
    assert [otlp.delivery(s) for s in (200, 429, 503, 400)] == ["delivered", "retry", "retry", "permanent"] and otlp.endpoint("h:4318/") == "http://h:4318/v1/logs"


def test_store_ingest_query_export(spark, tmp_path):
    log = [f"2026-06-03T14:{k // 60 % 60:02d}:{k % 60:02d} INFO event number {k}" for k in range(600)]
    log[300] = log[300].replace("INFO", "ERROR") + "\n  at main\n  at x"
    log = "\n".join(log).split("\n")
    df = lambda rows: spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "pos long, line string")
    s = Store.create(spark, str(tmp_path / "a"), service="x")
    assert s.entries().count() == 0 and s.ingest(df(log), 4096) == 600 and s.ingest(df(log), 4096) == 0
    assert s.ingest(df([*log, "2026-06-03T15:30:00 INFO late"]), 4096) == 1 and s.chunks().count() > 5
    a, b = times.parse_time("2026-06-03T14:03:00Z"), times.parse_time("2026-06-03T14:04:00Z")
    assert s.query(a, b).count() == 61
    hit = s.query(predicates=Predicates(has=["main"])).collect()
    assert len(hit) == 1 and hit[0]["text"].count("\n") == 2
    assert s.selected(predicates=Predicates(has=["main"])).count() == 1
    assert s.query(max_n=7).count() == 7 and 3 <= s.query(tail=3).count() < 200
    x = s.export(str(tmp_path / "b"), a, b)
    assert x.facts["derived_from"] == s.facts["id"] and 61 <= x.entries().count() < 601
    empty = s.export(str(tmp_path / "c"), b + 10**10, None)
    assert empty.entries().count() == 0 and empty.facts["derived_op"] == "export"
    assert fleet([s, x]).count() == 601 + x.entries().count()


def test_bundle(spark, tmp_path):
    from tidelog.sources.bundle import read_bundle, write_bundle

    e = spark.createDataFrame([("s", 0, 0, 1, 1, 1, "x")], "store_id string, chunk_seq long, entry_no long, ts_ms long, wf_ms long, wl_ms long, text string")
    write_bundle(str(tmp_path / "x.tar"), e, C.chunk_index(e), {"id": "1"})
    got, chunks, facts = read_bundle(spark, str(tmp_path / "x.tar"), str(tmp_path / "open"))
    assert got.collect() == e.collect() and chunks.count() == 1 and facts == {"id": "1"}


def test_a_decoded_record_carries_no_other_records(spark):
    """Rows that go through Python hold their record and resource, not the whole request; resources and scopes stay with their records."""
    body = lambda s: {"timeUnixNano": "1000000", "body": {"stringValue": s}}
    logs = [
        {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": name}}]}, "scopeLogs": [{"logRecords": [body(f"{name}{s}{k}") for k in range(3)]} for s in range(2)]}
        for name in ("a", "b")
    ] + [{"scopeLogs": [{"logRecords": [body("bare")]}]}]
    got = otlp.decode_json(spark.createDataFrame([(json.dumps({"resourceLogs": logs}),)], "value string")).select(otlp.route(F.col("resource")).alias("stream"), "body", "time_ms")
    assert sorted(map(tuple, got.collect())) == sorted([*[(n, f"{n}{s}{k}", 1) for n in "ab" for s in range(2) for k in range(3)], ("unknown_service", "bare", 1)])
    kept = re.findall(r"Generate explode\(\S+logRecords\), \[(.*?)\], false", got._jdf.queryExecution().sparkPlan().toString())
    assert len(kept) == 1 and kept[0].startswith("__resource#") and "," not in kept[0]


def test_byte_counts_round_halves_to_even_and_stop_at_the_last_unit(spark):
    n = [0, 1023, 1024, 1280, 1792, 1075, 2**20 - 1, 786432 * 5003, 2**30, 5 * 2**40 + 2**38]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select(times.human_bytes(F.col("n")), times.human_bytes(F.col("n"), ("KiB", "MiB"))).collect()
    assert [r[0] for r in rows] == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.8 KiB", "1.0 KiB", "1024.0 KiB", "3.7 GiB", "1.0 GiB", "5.2 TiB"]
    assert [r[1] for r in rows][-3:] == ["3752.2 MiB", "1024.0 MiB", f"{5 * 2**20 + 2**18}.0 MiB"]
