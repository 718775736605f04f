import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tidelog.llm import packing, toxicity
from tests.llm.test_jaccard_join import components_by_hand, sets_by_hand


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == names
        out[name] = (before.collect(), docs.collect())
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    before, after = out["toxicity"]
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), toxicity.labels_of(spark, sf))
    lex = model.lexicon()
    scores = model.score(np.array([toxicity.features(r["text"], lex)[0] for r in before]))
    assert ids(after) == sorted(r["doc_id"] for r, s in zip(before, scores) if s < 0.3)

    before, after = out["exact_dedup"]
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
    assert ids(after) == sorted(first.values())

    before, after = out["ngram_jaccard_join"]
    comp = components_by_hand([r["doc_id"] for r in before], sets_by_hand([r["text"] for r in before], 5), 8, 10)
    assert ids(after) == sorted(set(comp))

    before, after = out["curriculum_mix"]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    assert {r["doc_id"]: r for r in after}.items() <= {r["doc_id"]: r for r in before}.items()

    before, after = out["best_fit_packing"]
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in before:
        x = np.array([*tok.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        want.update((r["doc_id"], k // 2048, zlib.crc32(x[k : k + 2048].tobytes())) for k in range(0, len(x), 2048))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in after) == want


def test_odd_and_empty_tables(spark, odd_dir, empty_dir):
    for d in (odd_dir, empty_dir):
        corpus_pipeline.run(spark, d).collect()


def test_workers_give_their_memory_back(spark):
    """A worker that has run a task of an operator and idles holds no memory of it; what others keep in it goes."""
    import numpy as np
    import pandas as pd

    from tidelog.llm import common

    def rss():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    @common.task_of("one")
    def run(batches):
        small = [bytes(2000) for _ in range(100_000)]  # from the heap, which keeps what is freed
        yield from (len(b) + len(small) * 0 for b in batches)

    before, gone = rss(), []
    common.kept["other"] = lambda: gone.append(1)
    assert list(run(iter([pd.DataFrame({"x": np.arange(3)})]))) == [3]
    assert gone and "other" not in common.kept and rss() - before < 60


def test_stages_begin_with_small_heaps(spark, sf, monkeypatch):
    """The heap that a stage has grown goes back before the next one's workers run, whichever stage that is."""
    from tidelog.llm import common

    total = lambda: spark._jvm.java.lang.Runtime.getRuntime().totalMemory() / 1e6
    held = spark._jvm.java.util.Vector()
    for _ in range(40):
        held.addElement(bytes(25_000_000))
    held.removeAllElements()
    grown = total()
    common.trim_heaps(spark)
    assert grown > 900 and total() < grown - 400

    trims = []
    monkeypatch.setattr(corpus_pipeline, "trim_heaps", lambda s: trims.append(s))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf)
        assert len(trims) == k + 1
