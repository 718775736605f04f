import math
import random
import re
import zlib

import numpy as np

from tidelog.llm import queries, toxicity


def best(text, model=None):
    return max((s for _, _, s in (model or toxicity.Model()).clauses(text)), default=0.0)


def test_grammar_scores_clauses_not_words():
    plain, aimed = best("What an idiot."), best("You are an idiot.")
    assert aimed > plain > best("You are not an idiot.") > 0
    assert plain > best("She said idiot.") and plain > best('It read "idiot" there.')
    assert best("I will kill you.") > best("They kill time.") > 0
    assert best("You are kind. The sky is blue.") == 0
    assert best("Not now. You idiot.") == aimed, "a negation ends with its clause"


def test_composition_is_that_of_its_parts():
    parts = [toxicity._negation, toxicity._reported, toxicity._insult, toxicity._threat]
    nxt, arcs = toxicity.grammar()
    rng = random.Random(2)
    for _ in range(300):
        states, state = [0, 0, (0, 0), 0], 0
        for _ in range(12):
            label, fired = rng.randrange(toxicity.LABELS), ()
            for k, step in enumerate(parts):
                states[k], _, more = step(states[k], label)
                fired += more
            assert arcs[state][label] == fired
            state = nxt[state][label]


def test_fitted_arcs_beat_words_alone(spark):
    """Where clean rows hold the same words, negated or reported, the clauses tell them apart and the words do not."""
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(("cats", "rain", "green", "walk", "stone", "river")) for _ in range(6))
    bad = lambda: rng.choice(("You are a %s.", "They are such %s.", "You %s!")) % rng.choice(("idiot", "moron", "loser"))
    fine = lambda: rng.choice(("You are not a %s.", "He said %s.", 'It read "%s" there.')) % rng.choice(("idiot", "moron", "loser"))
    make = lambda k: (f"{filler()}. {bad() if k % 2 else fine()} {filler()} {k}.", k % 2)
    sample = spark.createDataFrame([make(k) for k in range(400)], "text string, toxic int")
    model = toxicity.fitted(sample, toxicity.Model())
    words = toxicity.Model(link=(*model.link[:1], *[1.0] * 5, 0.0, 0.0, 0.5))
    lex, test = model.lexicon(), [make(k) for k in range(400, 700)]
    right = {}
    for name, m in (("grammar", model), ("words", words)):
        f = np.array([toxicity.features(t, lex)[0] for t, _ in test])
        best = max(np.mean((m.score(f) >= cut) == np.array([y for _, y in test])) for cut in np.arange(0.05, 1, 0.05))
        right[name] = best
    assert right["grammar"] > 0.95 and right["words"] < 0.8


def scored_by_hand(model, text):
    """The score from the definition: each clause on its own, each insult and threat by looking back."""
    look, sums, n = model.lexicon().look, [0.0] * 7, len(re.findall(r"[^\W\d_]+", text.lower()))
    for clause in re.split(r"[.!?;:\n|]+", text):
        toks = re.findall(r"[^\W\d_]+|[\"“”„«»]", clause)
        label = [toxicity.QUOTE if t in "\"“”„«»" else look(t.lower())[0] for t in toks]
        within = lambda k, x, reach: any(label[j] == x for j in range(max(0, k - reach), k))  # noqa: B023, E731
        for k, t in enumerate(toks):
            if label[k] not in (toxicity.INSULT, toxicity.THREAT):
                continue
            w = look(t.lower())[1]
            if label[k] == toxicity.INSULT:
                near = max((j for j in range(k) if label[j] == toxicity.TARGET), default=-1)
                named = any(label[j] == toxicity.PREDICATE for j in range(max(near + 1, k - 2), k))
                sums[toxicity.AIMED if near >= 0 and k - near <= 5 else toxicity.NAMED if named else toxicity.LONE] += w
            else:
                sums[toxicity.WILLED if within(k, toxicity.WILL, 4) else toxicity.BARE] += w
            if within(k, toxicity.NEGATION, 4):
                sums[toxicity.NEGATED] += w
            if within(k, toxicity.REPORT, len(toks)) or label[:k].count(toxicity.QUOTE) % 2:
                sums[toxicity.REPORTED] += w
    z = model.link[0] + sum(w * math.log1p(x) for w, x in zip(model.link[1:8], sums)) + (model.link[8] * 10 * sum(sums[:5]) / n if n else 0)
    return 1 / (1 + math.exp(-z))


def test_query_by_hand(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, toxicity.labels_of(spark, d))
    texts = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}
    got = queries.op1_toxicity(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r["score"] - scored_by_hand(model, texts[r["doc_id"]])) < 1e-9


def test_conflicting_labels_of_equal_texts(spark):
    docs = spark.createDataFrame([(1, "same words here"), (3, "same words here"), (4, "others")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    sample, _, _ = toxicity.labelled(docs, labels)
    held = {i for i in (1, 3, 4) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert not held & {1, 3} and {r["text"]: r["toxic"] for r in sample.collect()}["same words here"] == 1


def test_learns_words_and_stems(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("mel", "tor", "san", "vik") for b in ("a", "o", "ire", "um", "est", "in", "ou")]
    stem = [f"gravok{x}" for x in ("a", "en", "ust", "ir", "ol", "im")]
    docs, labels = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            t[rng.randrange(1, 29)] = rng.choice(stem)
            t[rng.randrange(1, 29)] = "blarg"
        docs.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert "blarg" in model.words and set(model.stems) == {"gravok"}
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i]["predicted"] == (i % 5 == 0) for i in got if got[i]["held_out"])
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    kept = {r[0] for r in toxicity.keep_clean(docs, labels).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if not r["predicted"]}


def test_query(spark, sf, odd_dir, empty_dir):
    for d in (sf, odd_dir, empty_dir):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        got = queries.op1_toxicity(spark, d).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
        assert sorted(map(str, got)) == sorted(map(str, queries.op1_toxicity(spark, d).collect()))
