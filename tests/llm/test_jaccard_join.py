from collections import defaultdict

import numpy as np
import pytest

from tidelog.llm import jaccard_join as jj
from tidelog.llm import queries


def sets_by_hand(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    return out


def components_by_hand(ids, sets, num, den):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and (ids[i] == ids[j] or den * len(a & b) >= num * len(a | b)):
                x, y = find(ids[i]), find(ids[j])
                up[max(x, y)] = min(x, y)
    return [find(i) for i in ids]


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.integers(len(words))] = f"w{rng.integers(10**6)}"
    return " ".join(words)


def corpus(seed, size=60):
    rng = np.random.default_rng(seed)
    base = [[f"v{x}" for x in rng.integers(0, 400, rng.integers(5, size))] for _ in range(25)]
    return [edited(rng, base[rng.integers(len(base))], rng.integers(0, 4)) for _ in range(260)] + ["", " \t", "one", "one", "One two", None]


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 8, 10)])
def test_against_all_pairs(spark, n, num, den):
    texts = corpus(n)
    ids = [int(x) for x in np.random.default_rng(0).permutation(len(texts))]
    sets = sets_by_hand(texts, n)
    want = components_by_hand(ids, sets, num, den)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    for limit, vectors in ((10**6, 1000), (1500, 3)):  # the small limits take the distributed Voronoi and block paths
        got = {r[0]: (r[1], r[2]) for r in jj.join_components(docs, n, num, den, limit, vectors).collect()}
        assert got == {i: (len(s), c) for i, s, c in zip(ids, sets, want)}


def test_cells_recurse_exactly():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 2**60, 150, dtype=np.uint64) for _ in range(12)]
    sets = []
    for _ in range(500):
        s = base[rng.integers(12)].copy()
        k = rng.integers(0, 40)
        s[rng.integers(0, 150, k)] = rng.integers(0, 2**60, k, dtype=np.uint64)
        sets.append(np.unique(s))
    links = jj.join_cell(sets, 90, 100)
    assert len(links) < len(sets)
    forest = jj._Forest(len(sets))
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both)
        forest.join(a, b)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert forest.find(i) == forest.find(j)


def test_prefixes_meet_for_every_linked_pair():
    rng = np.random.default_rng(9)
    for num, den in ((90, 100), (8, 10)):
        often = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        prefixes = jj.Prefixes(num, den, often)
        for _ in range(300):
            a = np.unique(np.concatenate((rng.integers(0, 2**63, rng.integers(5, 200), dtype=np.uint64), rng.choice(often, rng.integers(0, 200)))))
            b = a.copy()
            while True:
                c = np.unique(np.concatenate((np.delete(b, rng.integers(len(b))), rng.integers(0, 2**63, rng.integers(0, 3), dtype=np.uint64))))
                both = len(np.intersect1d(a, c))
                if den * both < num * (len(a) + len(c) - both):
                    break
                b = c
            if len(a) != len(b) or (a != b).any():
                (k, h, _), (m, g, _) = prefixes(a), prefixes(b)
                met = set(k.tolist()) & set(m.tolist())
                assert met & (set(k[h].tolist()) | set(m[g].tolist()))
                ok = jj._may_link(np.array([len(a), len(b)]), [jj.vector(a).tobytes(), jj.vector(b).tobytes()], num, den)
                assert ok.all()


def test_vectors_fold_to_lower_bounds():
    rng = np.random.default_rng(4)
    for n in (10, 3000, 90_000):
        a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for _ in range(2))
        b[: n // 2] = a[: n // 2]
        b = np.unique(b)
        va, vb = (jj.folded(jj.vector(x), 16).astype(int) for x in (a, b))
        use = (va < 255) & (vb < 255)
        assert np.abs(va - vb)[use].sum() <= len(np.setxor1d(a, b))


def test_shingles_are_those_of_the_words():
    texts = ["", None, " \t", "One", "one two", "a b c d e f", "A\x0bB\x0cc d\u00a0e É é 漢字 d\u00a0e É", "x" * 90 + " " + "yz " * 300, *corpus(1)[:40]]
    for n in (1, 3, 5):
        sets = sets_by_hand(texts, n)
        known = {}
        for group in (16, 1 << 19):
            got = list(jj.shingle_sets(texts, n, group))
            assert [len(x) for x in got] == [len(x) for x in sets]
            for x, w in zip(got, sets):
                assert (np.sort(x) == x).all() and known.setdefault(w, x.tobytes()) == x.tobytes()
    raw = " ".join(t or "" for t in texts).encode()
    assert (jj.word_hashes(raw)[0] == jj.word_hashes(raw, 50)[0]).all() and len(jj.word_hashes(raw)[0]) == len(raw.split())


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(2)
    f = jj.Frequent(64)
    for _ in range(300):
        f.add(np.unique(np.concatenate((np.arange(20, dtype=np.uint64), rng.integers(100, 2**40, 80, dtype=np.uint64)))))
    f.merge()
    assert len(f.keys) <= 64 and set(range(20)) <= set(f.keys.tolist())


def test_pivots_make_regions(spark):
    """Regions have pivots, boundary documents are in several, and memory regions split and copy too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    _, often = jj.doc_sets(docs, 3)
    met = jj.regions(docs, often, 3, 90, 100).collect()
    assert len({r["cell"] for r in met}) > 10 and len(met) > len({r["node"] for r in met})
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**60, 150, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for k in range(300):
        s = base[k % 6].copy()
        s[rng.integers(0, 150, rng.integers(0, 12))] += np.uint64(k + 1)
        sets.append(np.unique(s))
    sets += [np.unique(np.concatenate((base[0][:110], base[1][:40])))]
    cell = jj._Cell(sets, 90, 100)
    cell.run(np.arange(len(sets)))
    assert cell.counted[0] > 6 and cell.counted[1] > 6


def test_common_shingles_bring_few_documents_together(spark):
    """Documents of common phrases and few words of their own meet by the latter; what is shown is dealt out once."""
    rng = np.random.default_rng(5)
    phrases = [" ".join(f"p{x}" for x in rng.integers(0, 10**6, 4)) for _ in range(400)]
    texts = [" ".join(f"{phrases[p]} {w}" for p, w in zip(rng.integers(0, 400, 30), rng.integers(0, 10**9, 30))) for _ in range(300)]
    texts += [t.replace(t.split()[-1], "end") for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, often = jj.doc_sets(docs, 3)
    total = sets.agg({"n_shingles": "sum"}).first()[0]
    # No counters: with the frequent list empty the sample alone orders the shingles.
    plain, ordered = (jj.regions(docs, often, 3, 90, 100, 0, total=t) for t in (0, total))
    assert ordered.count() < plain.count() / 4
    assert {r[0] for r in ordered.groupBy("cell").count().where("count > 1").select("count").collect()} == {2}
    assert ordered._jdf.queryExecution().toString().count("MapInPandas") == 0
    shingles, ranks = jj.common_shingles(docs, 3, total, most=10)
    assert len(shingles) <= 10 and len(jj.common_shingles(docs, 3, total)[0]) > 400
    ids, words = zip(*[(i, t) for i, t in enumerate(texts)])
    want = components_by_hand(list(ids), sets_by_hand(words, 3), 90, 100)
    assert {r[0]: r[2] for r in jj.join_components(docs, 3, 90, 100).collect()} == dict(zip(ids, want))


def test_common_shingles_keep_the_prefixes_in_one_order():
    rng = np.random.default_rng(11)
    pool = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    prefixes = jj.Prefixes(90, 100, pool[::7], pool[1::7], rng.integers(1, 9, len(pool[1::7])).astype(np.uint8))
    for _ in range(300):
        a = np.unique(rng.choice(pool, 150))
        b = np.unique(np.concatenate((np.delete(a, rng.integers(len(a), size=2)), rng.integers(0, 2**63, 2, dtype=np.uint64))))
        (k, h, hot), (m, g, _) = prefixes(a), prefixes(b)
        met = set(k.tolist()) & set(m.tolist())
        assert met & (set(k[h].tolist()) | set(m[g].tolist()))
        ok = [jj._may_link(np.array([len(a), len(b)]), [jj.folded(jj.vector(x), size).astype(np.uint8).tobytes() for x in (a, b)], 90, 100).all() for size in (16, jj.MINI)]
        assert all(ok)


def test_query(spark, sf, odd_dir, empty_dir):
    for d in (sf, odd_dir, empty_dir):
        docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
        known = [(i, t) for i, t in docs if i is not None]
        sets = sets_by_hand([t for _, t in known], 3)
        want = components_by_hand(*map(list, ([i for i, _ in known], sets)), 90, 100) if len({i for i, _ in known}) == len(known) else None
        got = queries.op9_ngram_jaccard_join(spark, d).collect()
        assert sorted((r[0] if r[0] is not None else -1, r[1]) for r in got) == sorted((i if i is not None else -1, len(sets_by_hand([t], 3)[0])) for i, t in docs)
        if want:
            assert {r[0]: r[2] for r in got} == {i: c for (i, _), c in zip(known, want)}


def test_odd_rows(spark, odd_dir):
    got = defaultdict(set)
    for r in queries.op9_ngram_jaccard_join(spark, odd_dir).collect():
        got[r[0]].add(r[2])
    assert got[4] == {3} and got[10] == {3} and got[6] == {5} and got[1] == {1} and got[7] == {7}


def test_keep_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = jj.keep_one(docs)
    comp = jj.join_components(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted({r[2] for r in comp.collect()})
