import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from tidelog.llm import packing, queries

NORM = re.compile(r"[\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts(spark, d):
    return [(r[0], r[1] or "") for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def check_pack(spark, d):
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, t in texts(spark, d):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            cut = ids[k : k + 2048]
            want[(i, k // 2048, k, len(cut), zlib.crc32(cut.tobytes()))] += 1
    got = pd.DataFrame(rows(queries.op4_best_fit_packing(spark, d)))
    keys = Counter((None if pd.isna(a) else int(a), b, c, e, f) for a, b, c, e, f in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) if len(got) else Counter()
    assert keys == want
    for _, g in got.sort_values("offset").groupby("sequence_id") if len(got) else ():
        assert g["length"].sum() <= 2048 and list(g["offset"]) == [0, *g["length"].cumsum()[:-1]]
    return got


def test_pack(spark, sf, odd_dir, empty_dir):
    got = check_pack(spark, sf)
    bound = packing.lower_bound(got["length"].to_numpy(), 2048)
    assert bound <= got["sequence_id"].nunique() <= bound + 2
    told = packing.certificate(queries.op4_best_fit_packing(spark, sf))
    assert told["bins"] == got["sequence_id"].nunique() and told["bound"] == int(np.ceil(bound - 1e-9)) and 0 <= told["gap"] == told["bins"] - told["bound"] <= 1
    assert (got["part_bins"] >= got["part_bound"]).all()
    check_pack(spark, odd_dir)
    assert len(check_pack(spark, empty_dir)) == 0


def test_pack_exchanges_between_partitions(spark):
    rng = np.random.default_rng(3)
    data = [(i, 0, 0, int(x)) for i, x in enumerate(rng.integers(30, 1200, 4000))]
    table = spark.createDataFrame(data, "doc_id long, row long, piece int, length long")
    got = pd.DataFrame(rows(packing.pack(table, per_part=100)))
    assert len(got) == 4000 and got.groupby("sequence_id")["length"].sum().max() <= 2048
    alone = packing.best_fit_decreasing(np.sort([x[3] for x in data])[::-1], 2048).max() + 1
    assert got["sequence_id"].nunique() <= alone * 1.01 + 1
    # Partitions that no better packing could help keep their bins: lengths of half a bin leave nothing to exchange.
    whole = spark.createDataFrame([(i, 0, 0, 1024) for i in range(4000)], "doc_id long, row long, piece int, length long")
    full = pd.DataFrame(rows(packing.pack(whole, per_part=100)))
    assert full["sequence_id"].nunique() == 2000


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.sort(rng.integers(1, 100, rng.integers(1, 40)))[::-1]
        assert packing.lower_bound(x, 100) <= packing.best_fit_decreasing(x, 100).max() + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert np.ceil(packing.lower_bound(np.array([34] * 6), 100) - 1e-9) == 3


def check_dedup(spark, d):
    groups = defaultdict(list)
    for i, t in texts(spark, d):
        groups[hashlib.sha256(NORM.sub(" ", t).encode()).hexdigest()].append(i)
    want = Counter()
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        for k, i in enumerate(ids):
            want[(i, ids[0], len(ids), k == 0, h)] += 1
    for counters in (2, 1024):
        from tidelog.llm.exact_dedup import exact_dedup

        got = Counter(tuple(r) for r in exact_dedup(spark.read.parquet(f"{d}/documents.parquet"), counters).collect())
        assert got == want


def test_dedup(spark, sf, odd_dir, empty_dir):
    for d in (sf, odd_dir, empty_dir):
        check_dedup(spark, d)


def test_keep_first(spark, odd_dir):
    from tidelog.llm.exact_dedup import keep_first

    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 5, 7, 8, 9]


def by_hand(sizes, weights, share=1.5, cap=2.0):
    want, full = share * sum(sizes), set()
    while True:
        level = (want - sum(cap * sizes[i] for i in full)) / (sum(w for i, w in enumerate(weights) if i not in full) or 1)
        more = {i for i, w in enumerate(weights) if i not in full and level * w >= cap * sizes[i]}
        if not more:
            return [cap * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= more


def check_mix(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = defaultdict(int)
    for _, s, t in docs:
        size[s] += count(t)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    aim = dict(zip(names, by_hand([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))])))
    got = rows(queries.op7_curriculum_mix(spark, d))
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, count(t)) for i, _, t in docs)
    source = {i: s for i, s, _ in docs}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - aim[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - aim[s]) < 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, rows(queries.op7_curriculum_mix(spark, d))))


def test_mix(spark, sf, odd_dir, empty_dir):
    for d in (sf, odd_dir, empty_dir):
        check_mix(spark, d)


def test_mix_stream(spark, sf):
    from tidelog.llm.curriculum import mix

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mix(docs)
    assert out.columns == docs.columns and docs.count() < out.count() <= 2 * docs.count()


def test_positions_by_hand(spark, sf):
    """Positions are those at which the integrated schedule reaches each document's place in its source."""
    from pyspark.sql import functions as F

    from tidelog.llm import curriculum

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(17))).collect()}
    got = [(r["row"]["source"], key[r["doc_id"]], r) for r in curriculum.plan(docs).collect()]
    names = sorted({s for s, _, _ in got}, key=lambda s: (s is None, s or ""))
    for k, name in enumerate(names):
        a, b = curriculum.RAMPS[k % 3]
        at = 0
        for _, _, r in sorted((x for x in got if x[0] == name), key=lambda x: x[1]):
            for n, copy in enumerate(r["copies"]):
                u, lo, hi = min(1.0, (r["source_size"] * n + at) / r["target"]), 0.0, 1.0
                for _ in range(60):
                    t = (lo + hi) / 2
                    lo, hi = (t, hi) if (a * t + (b - a) * t * t / 2) / ((a + b) / 2) < u else (lo, t)
                assert abs(copy["position"] - lo) < 1e-9
            at += r["size"]


CLASH = ["row", "src", "size", "key", "bucket", "buckets", "start", "at", "words", "epochs", "more", "w0", "w1", "target", "source_size", "taken", "copies", "copy", "position", "rows", "digest", "kept", "keep_id", "row_id", "first", "group_size", "component_id", "component", "node", "cell", "region", "n", "__text", "__size", "__id", "__d", "__digest", "score", "piece", "length", "sequence_id", "part", "free", "toxic", "count", "held_out"]


def test_clashing_names(spark, sf):
    """Every operator and stage takes columns that are called as any helper is."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    plain, odd = docs, docs.withColumns({c: F.lit("x") for c in CLASH})
    for _, stage in corpus_pipeline.STAGES:
        want, got = stage(spark, plain, sf), stage(spark, odd, sf)
        assert [r["doc_id"] for r in want.select("doc_id").orderBy("doc_id").collect()] == [r["doc_id"] for r in got.select("doc_id").orderBy("doc_id").collect()]
        if "text" in got.columns:
            assert got.columns == odd.columns
