import hashlib
import random
from collections import Counter

from tidelog.llm import fingerprints, queries


def likeness(a, b):
    a, b = (Counter(w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t.lower()) if w) for t in (a, b))
    every = a.keys() | b.keys()
    return sum(min(a[x], b[x]) for x in every) / sum(max(a[x], b[x]) for x in every) if every else 1.0


def edited(text, nxt):
    q = len(text) // 4
    return text[: len(text) - q] + nxt[:q]


def check(spark, d):
    docs = sorted(((r[0], r[1] or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [i for i, _ in docs]
    got = {r["doc_id"]: r for r in queries.op6_weighted_fingerprints(spark, d).collect()}
    assert len(queries.op6_weighted_fingerprints(spark, d).collect()) == len(docs)
    off = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        if ids.count(i) > 1 or ids.count(docs[(k + 1) % len(docs)][0]) > 1:
            continue
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited(t, nxt).encode()).hexdigest()
        off += [r["near_edited"] - likeness(t, edited(t, nxt)), r["near_next"] - likeness(t, nxt)]
    assert not off or sum(map(abs, off)) / len(off) < 0.06 and abs(sum(off)) / len(off) < 0.03
    by_text = {}
    for i, t in docs:
        assert by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_query(spark, sf, odd_dir, empty_dir):
    for d in (sf, odd_dir, empty_dir):
        check(spark, d)


def test_weights_count(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(150):
        a = {f"t{i}x{k}": rng.randint(1, 9) for k in range(20)}
        b = {k: max(1, n + rng.randint(-4, 4)) for k, n in a.items()}
        text = [" ".join(w for w, n in x.items() for _ in range(n)) for x in (a, b)]
        rows += [(2 * i, text[0]), (2 * i + 1, text[1])]
        want.append(likeness(*text))
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert abs(sum(got[2 * i] - w for i, w in enumerate(want)) / len(want)) < 0.02


def test_ranges_close_on_each_other(spark):
    rows = [(i * 3, f"text {i} of many") for i in range(700)]
    old, fingerprints.RANGE_ROWS = fingerprints.RANGE_ROWS, 7
    try:
        got = {r["doc_id"]: r["next"] for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string")).where("sentinel = 0").collect()}
    finally:
        fingerprints.RANGE_ROWS = old
    assert got == {i: rows[(k + 1) % 700][1] for k, (i, _) in enumerate(rows)}


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op6_weighted_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
