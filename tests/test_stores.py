"""Stores as files: what is read, what writers do to each other, retention, names, streams into and out of stores."""

import http.server
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog import files, forest
from tidelog.functions import times
from tidelog.operators import chunks as C
from tidelog.operators import entries as E
from tidelog.operators import order, standing
from tidelog.operators.predicates import Predicates
from tidelog.sources import evlog, otlp, records
from tidelog.store import Conflict, Store, fleet
from tidelog.streaming import assembly


def at(k):
    return f"2026-06-03T{14 + k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d} INFO event number {k}"


def frame(spark, rows, start=0):
    return spark.createDataFrame([(start + k, x) for k, x in enumerate(rows)], "pos long, line string")


def rows_scanned(df) -> int:
    """Rows that the scans of entries gave, from the metrics of the plan that ran; a sort samples its input, so they count twice."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    assert "block" in plan
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec":
            if "text" in p.toString():
                total += p.metrics().apply("numOutputRows").value()
        else:
            kids = p.children()
            todo += [kids.apply(k) for k in range(kids.size())]
    return total


def test_a_query_reads_the_folders_of_selected_chunks_only(spark, tmp_path):
    log = [at(k % 18000) if k < 18000 else at(18000) for k in range(20000)]
    log[15000] += " needle0815"
    s = Store.create(spark, str(tmp_path / "hay.log"))
    n, body = s._last()
    s._commit({**body, "chunks_per_file": 8}, n)
    assert s.ingest(frame(spark, log), 4096) == 20000
    assert len([x for x in files.listing(spark, s._folder("entries", s.manifest()["batches"][0]["name"])) if x[0].startswith("block=")]) > 20
    p = Predicates(has=["needle0815"])
    cost = s.read_cost(predicates=p).first()
    assert cost["chunks_read"] == 1 and cost["chunks_total"] > 200
    hit = s.query(predicates=p)
    assert rows_scanned(hit) < 2000 and [r["entry_no"] for r in hit.collect()] == [15000]
    a = times.parse_time("2026-06-03T15:00:00Z")
    window = s.query(a, a + 59_000)
    assert rows_scanned(window) < 5000 and window.count() == 60


def test_scans_are_the_same_for_any_block(spark):
    rng = random.Random(4)
    rows = [("ab"[k % 2], k, rng.choice([None, k]), rng.randrange(9), rng.randrange(1000)) for k in range(200)]
    df = spark.createDataFrame(rows, "store_id string, line_no long, v long, w long, m long")
    want, state = {}, {}
    for s, k, v, w, m in rows:
        last, total, most = state.get(s, (None, 0, -1))
        state[s] = want[k] = (v if v is not None else last, total + w, max(most, m))
    for block in (3, 1000):
        got = E.scanned(df, {"x": F.col("v")}, {"y": F.col("w")}, {"z": F.col("m")}, block=block).collect()
        assert {r["line_no"]: (r["x"], r["y"], r["z"]) for r in got} == want


def test_entries_go_on_after_their_cap(spark):
    log = [f"line {k:04d}" for k in range(500)] + ["2026-06-03T14:00:00 INFO x"] + ["  more"] * 200
    df = spark.createDataFrame([("s", k, x, 1780495200000 if k == 500 else None) for k, x in enumerate(log)], "store_id string, line_no long, line string, ts_ms long")
    got = E.group_entries(df, cap=1000).orderBy("entry_no").collect()
    assert "\n".join(r["text"] for r in got) == "\n".join(log) and max(len(r["text"]) for r in got) <= 1100 and len(got) == 5 + 2
    assert [r["ts_ms"] for r in got if r["entry_no"] >= 500] == [1780495200000] * 2
    assert [tuple(r) for r in E.leading(df, 499).collect()] == [("s", 500)] and E.leading(df, 500).isEmpty()


def test_many_lines_before_the_first_stamp_are_refused(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="thousand"):
        s.ingest(frame(spark, ["x"] * 1001 + [at(0)]))
    assert s.ingest(frame(spark, ["  x"] * 3 + [at(0)])) == 2


def test_writers_do_not_undo_each_other(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    n, body = s._last()
    s._commit({**body, "next_seq": 7}, n)
    with pytest.raises(Conflict):
        s._commit({**body, "next_seq": 9}, n)
    # A manifest that is not whole yet does not count.
    (tmp_path / "s" / "manifests" / f"{n + 2:012d}.json").write_text('{"facts"')
    assert s.manifest()["next_seq"] == 7


def test_trim_and_rotate(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), retain="30m")
    n, body = s._last()
    s._commit({**body, "chunks_per_file": 4}, n)
    s.ingest(frame(spark, [at(k) for k in range(3600)]), 2048)
    before, end = s.info(), times.parse_time("2026-06-03T15:00:00Z")
    told = s.trim(end, dry_run=True)
    assert s.info() == before and told["drop"] == told["by_age"] > 10
    assert s.trim(end) == told
    after = s.info()
    assert after["chunks"] == before["chunks"] - told["drop"] and after["dropped_chunks"] == told["drop"] == after["first_seq"]
    assert after["dropped_bytes"] == before["bytes"] - after["bytes"] and s.entries().agg(F.min("chunk_seq")).first()[0] == after["first_seq"]
    left = [x[0] for x in files.listing(spark, s._folder("entries", s.manifest()["batches"][0]["name"])) if x[0].startswith("block=")]
    assert min(int(x[6:]) for x in left) == after["first_seq"] // 4
    followers = spark.createDataFrame([("f", s.facts["id"], True, after["first_seq"] + 5)], "name string, store_id string, retaining boolean, seq long")
    assert s.trim(end, followers)["by_interest"] == 5 and s.info()["first_seq"] == after["first_seq"] + 5
    # What is left moves on; the destination takes numbers from its last.
    old = Store.create(spark, str(tmp_path / "old"))
    rest, cut = s.info(), times.parse_time("2026-06-03T14:50:00Z")
    want = sorted(r["text"] for r in s.entries().collect())
    moved = s.rotate(cut, old)
    assert moved > 5 and s.info()["chunks"] == rest["chunks"] - moved and old.info()["chunks"] == moved and old.info()["first_seq"] == 0
    assert sorted(r["text"] for t in (s, old) for r in t.entries().collect()) == want
    assert s.rotate(cut, old) == 0
    newer = Store.create(spark, str(tmp_path / "newer"))
    newer.ingest(frame(spark, [at(20000)]))
    with pytest.raises(ValueError, match="after the first"):
        s.rotate(end, newer)
    gone = s.rotate(1 << 50)
    assert gone and s.entries().count() == 0 and s.info()["dropped_bytes"] == before["bytes"]
    assert s.ingest(frame(spark, [at(9000)])) == 1 and s.chunks().first()["seq"] == before["next_seq"]


def test_index_is_extended(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"))
    s.ingest(frame(spark, [at(k) for k in range(300)]), 1024)
    tokens = s._folder("tokens", s.manifest()["batches"][0]["name"])
    some = files.saved(s.tokens().where("seq < 5"), "some")
    files.delete(spark, tokens)
    some.write.parquet(tokens)
    n = s.info()["chunks"]
    assert s.info()["indexed_chunks"] == 5 and s.query(predicates=Predicates(has=["297"])).count() == 1
    assert s.reindex() == n - 5 and s.info()["indexed_chunks"] == n and s.reindex() == 0


def test_info_and_facts(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s"), service="x")
    assert s.info()["chunks"] == 0 and s.info()["first_ms"] is None
    s.declare(retain="2d", service=None)
    assert s.facts["retain"] == "2d" and "service" not in s.facts
    s.ingest(frame(spark, [at(k) for k in range(100)]))
    i = s.info()
    assert json.dumps(i) and i["entries"] == 100 and i["bytes"] == sum(len(at(k)) + 1 for k in range(100)) and i["first_ms"] == 1780495200000 and i["ratio"] > 0
    x = s.export(str(tmp_path / "x"), 1)
    assert x.facts["window_from"] == "1" and "window_to" not in x.facts and "retain" not in x.facts


def test_forests(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for p in (a / "web.log", a / "deep" / "db.log", b / "web.log", b / "plain"):
        if p.name != "plain":
            Store.create(spark, str(p)).ingest(frame(spark, [at(1), at(2)]))
    (b / "plain").mkdir()
    (b / "file.log").write_text("x")
    assert [h for h, _ in forest.scan(spark, str(a))] == ["db", "web"] and forest.scan(spark, str(tmp_path / "none")) == []
    assert forest.resolve(spark, "db", [str(a), str(b)]) == str(a / "deep" / "db.log")
    for bad in ("web", "nothing"):
        with pytest.raises(LookupError):
            forest.resolve(spark, bad, [str(a), str(b)])
    for name in (f"{a}/web.log", f"{a}/web.log.rings", f"{a}/web.log.trunk", f"{a}/web.log/manifests/000000000001.json", f"{a}/web.log/"):
        assert forest.resolve_path(name) == f"{a}/web.log" and forest.resolve(spark, name, []) == f"{a}/web.log"
    followers = spark.createDataFrame([("f", Store(spark, f"{a}/web.log").facts["id"], True)], "name string, store_id string, retaining boolean")
    got = forest.catalogue(spark, [str(a), str(b)], followers).collect()
    assert [(r["forest"], r["handle"], r["entries"], r["retaining"]) for r in got] == [(str(a), "db", 2, None), (str(a), "web", 2, 1), (str(b), "web", 2, None)]


def test_inputs_are_told_apart(spark, tmp_path):
    s = Store.create(spark, str(tmp_path / "s.log"))
    s.ingest(frame(spark, [at(1), "  more", at(2)]))
    text, stream = tmp_path / "raw.log", tmp_path / "x.records"
    text.write_text("\n".join([at(1), "  trace", at(2), "  end"]) + "\n")
    stream.write_bytes(records.write_stream([("a", 5, 5, 5, 0, b"from a stream")], dropped=3))
    assert [forest.kind(spark, str(p)) for p in (s.path, text, stream)] == ["store", "text", "records"]
    assert b"dropped=3" in stream.read_bytes()
    p = Predicates(has=["number"])
    assert forest.search(spark, [s.path], p, start=1).count() == 2
    got = forest.search(spark, [str(text)], Predicates(has=["trace"])).collect()
    assert len(got) == 1 and got[0]["text"] == at(1) + "\n  trace"
    assert forest.search(spark, [str(stream), str(text)]).count() == 3
    with pytest.raises(ValueError, match="mix"):
        forest.search(spark, [s.path, str(text)])
    with pytest.raises(ValueError, match="window"):
        forest.search(spark, [str(text)], start=1)


def test_records_are_taken_whole_or_not(spark, tmp_path):
    rows = [("a", 5, 6, 7, 0, b"one\ntwo"), ("a", None, None, None, None, b"three")]
    data = records.write_stream(rows, [("from", 1), ("to", 9)], stages=["grep x", "head"])
    whole, cut = tmp_path / "w", tmp_path / "c"
    whole.write_bytes(data)
    cut.write_bytes(data[:-3])
    s = Store.create(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match="truncated"):
        s.take_records(records.read_records(spark, str(cut)))
    assert s.entries().count() == 0 and s.manifest()["batches"] == []
    assert s.take_records(records.read_records(spark, str(whole)), [records.head_of(data)]) == 2
    assert [r["text"] for r in s.query().collect()] == ["one\ntwo", "three"] and s.facts["stages"] == "grep x; head" and s.facts["window_from"] == "1"


def test_nul_records(spark, tmp_path):
    e = spark.createDataFrame([("s", "a\nb\n"), ("s", "c")], "store_id string, text string").coalesce(1)
    evlog.write_entries(e, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert data == b"a\nb\0c\0" and [r[0] for r in evlog.read_records(spark, str(tmp_path / "out")).collect()] == ["a\nb", "c"]
    evlog.write_entries(e, str(tmp_path / "named"), "store_id")
    assert b"".join(p.read_bytes() for p in (tmp_path / "named").glob("part-*")) == b"s:a\nb\0s:c\0"


def test_a_cap_is_shared_by_the_fleet(spark, tmp_path):
    stores = []
    for k in range(2):
        s = Store.create(spark, str(tmp_path / f"{k}"))
        s.ingest(frame(spark, [at(i) for i in range(k, 40, 2)]), 1)
        stores.append(s)
    got = fleet(stores, max_n=5).collect()
    assert [r["text"] for r in sorted(got, key=lambda r: (r["merge_ms"], r["src_idx"]))] == [at(k) for k in range(5)]
    assert [r["text"] for r in fleet(stores).collect()] == [at(k) for k in range(40)]


def test_standing_of_cursors_by_hand(spark):
    rng = random.Random(6)
    chunks = [(s, k, rng.randrange(1, 99), 1, 10 * k, 10 * k + rng.randrange(40)) for s in "ab" for k in range(3, 40)]
    cursors = [(f"c{k}", rng.choice("abz"), rng.choice([None, rng.randrange(0, 45)]), 2, rng.randrange(500)) for k in range(60)]
    c = spark.createDataFrame(chunks, "store_id string, seq long, uncomp_len long, comp_len long, first_write_ms long, last_write_ms long")
    q = spark.createDataFrame(cursors, "consumer string, store_id string, seq long, n long, wl long")
    for r in standing.standing(q, c).collect():
        _, s, seq, _, wl = next(x for x in cursors if x[0] == r["consumer"])
        mine = [x for x in chunks if x[0] == s]
        ahead = [x for x in mine if seq is not None and x[1] >= seq]
        assert (r["position"], r["behind"], r["behind_bytes"]) == (seq, len(ahead), sum(x[2] for x in ahead))
        assert r["consumed"] == sum(seq is not None and x[1] < seq for x in mine) and r["gap_chunks"] == (3 - seq if mine and seq is not None and seq < 3 else None)
        assert r["behind_ms"] == (max(x[5] for x in mine) - wl if mine else None)
    for r in standing.resolved(q, c).collect():
        _, s, _, _, wl = next(x for x in cursors if x[0] == r["consumer"])
        mine = [x for x in chunks if x[0] == s]
        assert r["seq"] == min((x[1] for x in mine if x[5] >= wl), default=40)


def test_anchors(spark):
    c = spark.createDataFrame([("s", k, 10, 5, 0, 100 + k % 2) for k in range(5, 12)], "store_id string, seq long, uncomp_len long, comp_len long, first_write_ms long, last_write_ms long")
    a = spark.createDataFrame([("here", "s", 10, 5, 0, 100, 8), ("moved", "s", 10, 5, 0, 101, 8), ("gone", "s", 11, 5, 0, 100, 8), ("early", "s", 10, 5, 0, 100, 4)], "consumer string, store_id string, uncomp_len long, comp_len long, first_write_ms long, last_write_ms long, hint long")
    got = {r["consumer"]: (r["seq"], r["overtaken"]) for r in standing.anchored(a, c).collect()}
    assert got == {"here": (9, False), "moved": (8, False), "gone": (12, True), "early": (12, True)}


def test_follow_from_now_and_bounded(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "pos long, line string"
    put = lambda k: spark.createDataFrame([(k, f"x{k}"), (k + 1, f"x{k + 1}")], schema).coalesce(1).write.mode("append").parquet(path)
    put(0)
    q = assembly.follow(spark, path, schema, from_now=True).writeStream.format("memory").queryName("fromnow").start()
    try:
        q.processAllAvailable()
        put(2)
        q.processAllAvailable()
        assert sorted(r["pos"] for r in spark.table("fromnow").collect()) == [2, 3]
    finally:
        q.stop()
    got = []
    q = assembly.bounded(assembly.follow(spark, path, schema), 3, lambda df: got.extend(r["pos"] for r in df.collect()), str(tmp_path / "cp"), ["pos"], processingTime="200 milliseconds")
    end = time.time() + 60
    while q.isActive and time.time() < end:
        time.sleep(0.2)
        if len(got) >= 3 and not q.isActive:
            break
        if len(got) < 3:
            put(4 + len(got))
    assert len(got) == 3 and not q.isActive
    two = assembly.follow_all(spark, {"a": path, "b": path}, schema).writeStream.format("memory").queryName("both").trigger(availableNow=True).start()
    two.awaitTermination(60)
    counts = {r["src"]: r["count"] for r in spark.table("both").groupBy("src").count().collect()}
    assert counts["a"] == counts["b"] >= 4


def test_a_stream_is_appended_once(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "pos long, line string"
    s = Store.create(spark, str(tmp_path / "s"))
    put = lambda rows: frame(spark, rows).coalesce(1).write.mode("append").parquet(path)
    go = lambda cp: assembly.append_stream(s, assembly.follow(spark, path, schema), str(tmp_path / cp), "tail", availableNow=True).awaitTermination(120)
    put([at(1), "  trace", at(2)])
    go("cp")
    assert s.entries().count() == 2 and s.chunks().count() == 1
    now = time.time() * 1000
    assert all(abs(r["wf_ms"] - now) < 200_000 and r["ts_ms"] == times.parse_time(r["text"][:19]) for r in s.entries().collect())
    put([at(3)])
    go("cp")
    assert s.entries().count() == 3 and s.chunks().count() == 2, "each trigger closes its chunk"
    # A writer that lost its checkpoint numbers its batches from the start; those are there already.
    go("other")
    assert s.entries().count() == 3
    # A policy declared while the stream is down holds from the next batch on.
    s.declare(retain="1s")
    time.sleep(2)
    put([at(4)])
    go("cp")
    assert s.entries().count() <= 2 and s.manifest()["dropped_chunks"] >= 2


class _Intake(http.server.BaseHTTPRequestHandler):
    answers: list = []
    seen: list = []

    def do_POST(self):
        import gzip

        body = self.rfile.read(int(self.headers["Content-Length"]))
        _Intake.seen.append((self.path, gzip.decompress(body)))
        status, headers, out = _Intake.answers.pop(0)
        self.send_response(status)
        for k, v in {**headers, "Content-Length": str(len(out))}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


def test_posting_requests():
    server = http.server.HTTPServer(("127.0.0.1", 0), _Intake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"127.0.0.1:{server.server_port}"
    partial = json.dumps({"partialSuccess": {"rejectedLogRecords": "3", "errorMessage": "too old"}}).encode()
    proto = b"\x0a\x06\x08\x03\x12\x02no"
    _Intake.answers = [(503, {"Retry-After": "7"}, b""), (200, {"Content-Type": "application/json"}, partial), (200, {"Content-Type": "application/x-protobuf"}, proto), (400, {}, b"bad")]
    got = [otlp.post(url, b"{}") for _ in range(4)]
    server.shutdown()
    assert got[0] == {"what": "retry", "rejected": 0, "message": None, "after": 7}
    assert (got[1]["what"], got[1]["rejected"], got[1]["message"]) == ("delivered", 3, "too old")
    assert (got[2]["rejected"], got[2]["message"]) == (3, "no") and got[3]["what"] == "permanent"
    assert _Intake.seen[0] == ("/v1/logs", b"{}")
    server.server_close()
    assert otlp.post(url, b"{}", timeout=2)["what"] == "retry"


def test_intake_statuses():
    ok = {"method": "POST", "path": "/v1/logs?x", "kind": "application/json; charset=utf-8"}
    status = lambda **k: otlp.intake_status(**{**ok, **k})
    assert status() == 200 and status(kind="application/x-protobuf", encoding="GZIP", path="/a/v1/logs/") == 200
    assert [status(method="GET"), status(path="/v1/traces"), status(kind="text/plain"), status(encoding="br"), status(length=None), status(length=1 << 30), status(inflated=1 << 30), status(whole=False), status(ready=False)] == [405, 404, 415, 415, 411, 413, 413, 400, 503]


def test_values_of_any_depth(spark):
    text = lambda s: {"stringValue": s}
    deep = {"arrayValue": {"values": [text("a"), {"arrayValue": {"values": [text("b"), {"kvlistValue": {"values": [{"key": "k", "value": {"arrayValue": {"values": [{"intValue": "7"}, {"boolValue": True}]}}}]}}]}}]}}
    want = json.dumps(["a", json.dumps(["b", json.dumps({"k": '["7","true"]'}, separators=(",", ":"))], separators=(",", ":"))], separators=(",", ":"))
    req = {"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"body": deep, "attributes": [{"key": "x", "value": deep}, {"key": "y", "value": text("z")}]}, {"body": text("plain")}]}]}]}
    got = otlp.decode_json(spark.createDataFrame([(json.dumps(req),)], "value string")).collect()
    assert got[0]["body"] == want and [tuple(a) for a in got[0]["attrs"]] == [("x", want), ("y", "z")] and got[1]["body"] == "plain"


def test_batches_number_entries_of_a_store(spark):
    df = spark.createDataFrame([("ab"[k % 3 == 0], k // 10, k) for k in range(100)], "store_id string, chunk_seq long, entry_no long")
    got = order.batches(df, 7).collect()
    for s in "ab":
        assert [r["batch_no"] for r in sorted((r for r in got if r["store_id"] == s), key=lambda r: r["entry_no"])] == [k // 7 for k in range(sum(r["store_id"] == s for r in got))]
    assert C.tail(C.chunk_index(df.withColumns({"wf_ms": F.lit(1), "wl_ms": F.lit(1), "text": F.lit("x")})), 12).count() >= 2


def test_cursors_that_cannot_be_read_are_counted(spark, tmp_path):
    good = json.dumps({"consumer": "a", "store_id": "s", "seq": 3, "n": 1})
    (tmp_path / "c.json").write_text("\n".join([good, "{no json", json.dumps({"consumer": "b"}), good.replace('"s"', '"t"')]) + "\n")
    got, bad = standing.read_cursors(spark, str(tmp_path / "c.json"))
    stores = spark.createDataFrame([("s", 9)], "store_id string, next_seq long")
    assert bad == 2 and got.count() == 2 and [r["consumer"] for r in standing.at_stores(got, stores).collect()] == ["a"]
    followers = spark.createDataFrame([("f", "s", True, 4)], "name string, store_id string, retaining boolean, seq long")
    assert standing.interest_floor(followers, stores).first()["floor"] == 4 and standing.interest_floor(followers, stores, unreadable=1).first()["floor"] is None


def test_a_very_common_line_is_a_bag_too(spark, monkeypatch):
    from tidelog.operators import ingest, joins

    rng = random.Random(9)
    held = [("s", rng.choice(["beat", "beat", "a", "b"]), k) for k in range(300)]
    src = [("s", k, rng.choice(["beat", "beat", "a", "c"]), k // 2) for k in range(700)]
    left = {}
    for _, line, _ in held:
        left[line] = left.get(line, 0) + 1
    want = []
    for _, k, line, eff in src:
        if eff > 299 or left.get(line, 0) == 0:
            want.append(k)
        else:
            left[line] -= 1
    for bound in (1e9, 0.1):
        monkeypatch.setattr(joins, "HOT_SHARE", bound)
        got = ingest.overlap_dedup(spark.createDataFrame(src, "store_id string, pos long, line string, eff_ms long"), spark.createDataFrame(held, "store_id string, line string, eff_ms long"))
        assert sorted(r["pos"] for r in got.collect()) == want


def test_hot_keys_join_as_others(spark):
    from tidelog.operators.joins import join_hot

    left = spark.createDataFrame([("h" if k % 3 else f"k{k}", k) for k in range(4000)], "key string, v long")
    right = left.groupBy("key").agg(F.count("*").alias("rows"), F.min("v").alias("low"))
    got = join_hot(left, right, "key", "rows").collect()
    assert sorted((r["v"], r["low"]) for r in got) == [(k, 1 if k % 3 else k) for k in range(4000)]
