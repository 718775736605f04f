"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps each word to a label and a weight: insult, threat verb, target, predicate (copula or
article), negation, reporting verb, will. Four sequential transducers - negation, reported speech,
insult, threat - read the labels of a clause and fire arcs: an insult is aimed (a target stands before it),
named (a predicate leads to it) or lone; a threat is willed or bare; either may be negated or reported. They
are composed once into one table, which a clause is run through. A clause's weight is the sum over
its fired arcs of arc weight times word weight, so that matched clauses are scored, not words.

Arc weights are fitted on labelled rows by logistic regression over the arcs that a document's clauses
fire; what an arc is worth, a lone insult too, is what those rows say, and an arc that they do not show
keeps its fixed weight. Insult words are fixed and, learned from the same rows, words and stems (prefix
arcs) whose contexts in toxic rows are significantly many. The sample is bounded by ``MAX_TOXIC`` and
``MAX_CLEAN`` rows, chosen by a hash of doc_id. Only text is scored.

Defined results: null and empty text match nothing and get the score of no match; several labels of
one document, and labels of rows with equal text, count as toxic if one is; without labelled rows of both
kinds the fixed words and weights stand; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alone, held_out, kept, saved, task_of, text_of

MAX_TOXIC, MAX_CLEAN = 3000, 6000
THRESHOLD = 0.3
#: Chance, under the share of toxic contexts, below which a word or stem counts as an insult.
SIGNIFICANT = 1e-9
STEMS, STEM_WORDS = range(4, 8), 5

# The grammar's words.
INSULTS = {
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "loser", "losers", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "vermin", "filth", "bastard", "retard", "freak", "coward", "pig", "whore", "slut", "bitch", "asshole", "fool",
    "idiotin", "trottel", "dummkopf", "abschaum", "arschloch", "schwachkopf", "hurensohn", "imbécile", "connard", "salaud", "ordure", "crétin", "abruti", "estúpido", "imbécil", "escoria", "cabrón", "asqueroso", "pendejo",
}
THREATS = {"kill", "hurt", "destroy", "murder", "beat", "shoot", "stab", "strangle", "rape", "burn", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"}
TARGETS = {"you", "your", "yours", "u", "he", "she", "him", "her", "they", "them", "these", "those", "people", "everyone", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "te", "vous", "ils", "tú", "usted", "ustedes", "ellos"}
NEGATIONS = {"not", "no", "never", "isn", "aren", "wasn", "don", "doesn", "without", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ni"}
REPORTS = {"said", "says", "called", "calls", "wrote", "reported", "claimed", "quoted", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió"}
WILLS = {"will", "ll", "gonna", "going", "shall", "should", "werde", "vais", "voy"}
PREDICATES = {"is", "are", "re", "was", "were", "a", "an", "the", "such", "this", "ist", "sind", "bist", "ein", "eine", "einen", "der", "die", "das", "est", "es", "sont", "un", "une", "le", "la", "les", "eres", "son", "una", "el", "los", "las"}

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, WILL, QUOTE, PREDICATE = range(9)
LABELS = 9
ARCS = ("aimed", "named", "lone", "willed", "bare", "negated", "reported")
AIMED, NAMED, LONE, WILLED, BARE, NEGATED, REPORTED = range(7)
#: Weights of the arcs before any is fitted; the last two take away.
ARC_WEIGHTS = (1.4, 1.0, 0.6, 1.2, 0.2, -0.9, -0.7)
_BASE_WEIGHT = 2.0


class Transducer:
    """Sequential: step(state, label) gives (next state, label out, arcs fired)."""

    def __init__(self, step, start=0):
        self.step, self.start = step, start

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""

        def step(state, label):
            a, out, fired = self.step(state[0], label)
            b, out, more = other.step(state[1], out)
            return (a, b), out, fired + more

        return Transducer(step, (self.start, other.start))

    def table(self) -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
        """Reachable states as rows of next states and of fired arcs, by label."""
        number, todo, nxt, arcs = {self.start: 0}, [self.start], [], []
        while todo:
            s = todo.pop(0)
            steps = [self.step(s, x) for x in range(LABELS)]
            for t, _, _ in steps:
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
            nxt.append([number[t] for t, _, _ in steps])
            arcs.append([f for _, _, f in steps])
        return nxt, arcs


def _negation(state, label):
    # A negation reaches the next four words.
    if label == NEGATION:
        return 4, label, ()
    return max(0, state - 1), label, (NEGATED,) if state and label in (INSULT, THREAT) else ()


def _reported(state, label):
    # What follows a reporting verb or stands between quotation marks is reported.
    if label == REPORT:
        return state | 1, label, ()
    if label == QUOTE:
        return state ^ 2, label, ()
    return state, label, (REPORTED,) if state and label in (INSULT, THREAT) else ()


def _insult(state, label):
    # (words left that a target reaches, words left that a predicate reaches)
    target, predicate = state
    if label == TARGET:
        return (5, 0), label, ()
    after = (max(0, target - 1), 2 if label == PREDICATE else max(0, predicate - 1))
    if label != INSULT:
        return after, label, ()
    return after, label, (AIMED,) if target else (NAMED,) if predicate else (LONE,)


def _threat(state, label):
    # A threat verb is willed up to four words after "will".
    if label == WILL:
        return 4, label, ()
    return max(0, state - 1), label, ((WILLED,) if state else (BARE,)) if label == THREAT else ()


@lru_cache(1)
def grammar() -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    return Transducer(_negation).then(Transducer(_reported)).then(Transducer(_insult, (0, 0))).then(Transducer(_threat)).table()


_WORDS = re.compile(r"[^\W\d_]+").findall
_TOKENS = re.compile(r"[^\W\d_]+|[.!?;:\n|]+|[\"“”„«»]").finditer


class Lexicon(dict):
    """word -> (label, weight); remembers a bounded number of words."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.lengths = sorted({len(s) for s in stems}, reverse=True)

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        got = self[word] = 1 if self.look(word)[0] in (INSULT, THREAT) else 0
        return got

    def look(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return INSULT, self.words[word]
        for n in self.lengths:
            if len(word) > n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        for label, known in ((INSULT, INSULTS), (THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (WILL, WILLS), (TARGET, TARGETS), (PREDICATE, PREDICATES)):
            if word in known:
                return label, _BASE_WEIGHT if label in (INSULT, THREAT) else 0.0
        return OTHER, 0.0


def matched(text: str, lexicon: Lexicon) -> list[tuple[int, int, list[float]]]:
    """(start, end, word weight by arc) of the clauses in which the grammar matches."""
    nxt, arcs = grammar()
    out, state, sums, begin = [], 0, None, 0
    for m in _TOKENS(text):
        tok = m.group()
        if tok[0] in ".!?;:\n|":
            if sums:
                out.append((begin, m.end(), sums))
            state, sums, begin = 0, None, m.end()
            continue
        label, w = (QUOTE, 0.0) if tok in "\"“”„«»" else lexicon.look(tok.lower())
        if w:
            sums = sums or [0.0] * len(ARCS)
            for arc in arcs[state][label]:
                sums[arc] += w
        state = nxt[state][label]
    if sums:
        out.append((begin, len(text), sums))
    return out


#: What a document shows: the log of its clauses' weight by arc, and their weight to its length.
SHOWN = len(ARCS) + 1


def features(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """(what a document shows, clauses matched)."""
    words = _WORDS(text.lower())
    if not words or not max(map(lexicon.__getitem__, words)):
        return [0.0] * SHOWN, 0
    found = matched(text, lexicon)
    sums = [sum(x) for x in zip(*(s for _, _, s in found))] if found else [0.0] * len(ARCS)
    return [*map(math.log1p, sums), 10 * sum(sums[:NEGATED]) / len(words)], len(found)


@task_of("toxicity")
def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, context): each word with a hash of its two neighbours, hardly ever twice in a task."""
    seen: set[tuple[str, int]] = set()
    for pdf in batches:
        for t in pdf["text"].array:
            w = _WORDS(t.lower())
            seen.update((b, xxhash.xxh64_intdigest(f"{a} {c}") >> 1) for a, b, c in zip(["", *w], w, [*w[1:], ""]))
            if len(seen) > 50_000:
                yield pd.DataFrame(list(seen), columns=["word", "context"])
                seen.clear()
    yield pd.DataFrame(list(seen), columns=["word", "context"])


def term_counts(sample: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, stem, n, words) of a sample: distinct contexts of each word, their sum over the words of each stem, and those words.

    Near copies give the same contexts. terms (term, stem) limits what is counted.
    """
    pairs = sample.select("text").repartition("text").mapInPandas(_contexts, "word string, context long").distinct()
    words = pairs.groupBy("word").agg(F.count("*").alias("n"))
    stems = F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda n: n < F.length("word")), lambda n: F.struct(F.substring(F.col("word"), F.lit(1), n).alias("term"), F.lit(True).alias("stem")))
    every = words.select("n", F.explode(F.concat(F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem"))), stems)).alias("t")).select("t.*", "n")
    if terms is not None:
        every = every.join(terms, ["term", "stem"], "left_semi")
    return every.groupBy("term", "stem").agg(F.sum("n").alias("n"), F.count("*").alias("words"))


def labelled(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[DataFrame, float, float]:
    """(sample (text, toxic), shares of the toxic and clean rows that it holds); no held-out rows."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    order = F.xxhash64("doc_id", F.lit(5))
    n = {r[0]: r[1] for r in one.groupBy(F.col("toxic") > 0).count().collect()}
    some = one.where("toxic > 0").orderBy(order).limit(max_toxic).unionByName(one.where("toxic <= 0").orderBy(order).limit(max_clean))
    # At most max_toxic + max_clean ids: a proven bound for the broadcast.
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    share = lambda k, most: min(1.0, most / n[k]) if n.get(k) else 1.0
    return saved(rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxic-sample"), share(True, max_toxic), share(False, max_clean)


def _log_tail(a: int, n: int, p: float) -> float:
    """Upper bound of log P(Binomial(n, p) >= a), by the relative entropy."""
    q = a / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + (0 if q == 1 else (1 - q) * math.log((1 - q) / (1 - p))))


class Model:
    """What is broadcast to score: insult words and stems with weights, and the link: bias, arc weights, density."""

    def __init__(self, words=None, stems=None, link=(-4.0, *ARC_WEIGHTS, 0.5)):
        self.words, self.stems, self.link = words or {}, stems or {}, tuple(link)

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.stems)

    def score(self, f: np.ndarray) -> np.ndarray:
        z = self.link[0] + f @ np.array(self.link[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def clauses(self, text: str, lexicon: Lexicon | None = None) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the clauses that match; negations and reports may take all weight away."""
        arcs = self.link[1:-1]
        return [(a, b, max(0.0, sum(w * x for w, x in zip(arcs, s)))) for a, b, s in matched(text, lexicon or self.lexicon())]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, drawn to the fixed weights; no arc changes its sign."""
    x = np.hstack([np.ones((len(x), 1)), x])
    prior = np.array(Model().link)
    b, sign = prior.copy(), np.sign(prior)
    ridge = np.diag([1e-6] + [0.3] * SHOWN)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge @ (b - prior))
        b = b + np.clip(step, -1, 1)
        b[1:] = np.where(sign[1:] > 0, np.maximum(b[1:], 0), np.minimum(b[1:], 0))
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def _featured(model: Model):
    @task_of("toxicity")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = model.lexicon()
        for pdf in batches:
            yield pd.DataFrame({"f": [features(t, lex)[0] for t in pdf["text"].array], "toxic": pdf["toxic"]})

    return run


def fitted(sample: DataFrame, model: Model, of_toxic: float = 1.0, of_clean: float = 1.0) -> Model:
    """model with its arcs fitted to sample (text, toxic): one row of numbers for each of its bounded rows."""
    rows = sample.mapInPandas(_featured(model), "f array<double>, toxic int").collect()
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    return Model(model.words, model.stems, _logistic(x, y, np.where(y > 0, 1 / of_toxic, 1 / of_clean)))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    sample, of_toxic, of_clean = labelled(docs, labels, max_toxic, max_clean)
    kinds = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(kinds) < 2:
        return Model()
    # Words and stems of the bounded sample, five contexts at least.
    rows = sorted(tuple(r) for r in term_counts(sample.where("toxic = 1")).where("n >= 5").collect())
    # A stem needs several words, none of which makes it alone; of stems with the same words the longest stands for them.
    top: dict[str, int] = {}
    for t, s, n, _ in rows:
        for k in () if s else STEMS:
            top[t[:k]] = max(n, top.get(t[:k], 0))
    stems = {t: n for t, s, n, words in rows if s and words >= STEM_WORDS and top.get(t, 0) <= 0.6 * n}
    short = {s[:-1] for s, n in stems.items() if n >= 0.95 * stems.get(s[:-1], n + 1)}
    toxic = {(t, s): n for t, s, n, _ in rows if not s or t in stems and t not in short}
    terms = sample.sparkSession.createDataFrame(sorted(toxic), "term string, stem boolean")
    clean = {(t, s): n for t, s, n, _ in term_counts(sample.where("toxic = 0"), F.broadcast(terms)).collect()}
    # The usual share of toxic contexts: by words of the two kinds of rows.
    words = {r[0]: r[1] or 1 for r in sample.groupBy("toxic").agg(F.sum(F.length("text"))).collect()}
    p = min(0.9, words[1] / (words[0] + words[1]))
    found: tuple[dict, dict] = {}, {}
    for (t, s), a in toxic.items():
        b = clean.get((t, s), 0)
        if a >= 9 * b and _log_tail(a, a + b, p) < math.log(SIGNIFICANT):
            found[s][t] = min(4.0, 1 + 0.5 * math.log((a + 0.5) / (b + 0.5) * (1 - p) / p))
    for s in [s for s in found[1] if any(s[:n] in found[1] for n in STEMS if n < len(s))]:
        del found[1][s]
    return fitted(sample, Model(*found), of_toxic, of_clean)


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """columns of docs with score and n_clauses (those the grammar matches)."""
    keep = docs.select(*columns, text_of().alias("__text"))
    schema = keep.drop("__text").schema.add("score", "double").add("n_clauses", "integer")

    @task_of("toxicity")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = model.lexicon()
        for pdf in batches:
            found = [features(t, lex) for t in pdf["__text"].array]
            yield pdf.drop(columns="__text").assign(score=model.score(np.array([f for f, _ in found]).reshape(-1, SHOWN)), n_clauses=[n for _, n in found])

    return keep.mapInPandas(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_clauses."""
    model = train(docs, labels, **bounds)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(slim, model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, in one pass over the text."""
    model = train(docs, labels, **bounds)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        lex = _lexicon_of(model)
        return pd.Series(model.score(np.array([features(t, lex)[0] for t in texts]).reshape(-1, SHOWN)) < threshold)

    return docs.where(clean(text_of()))


_kept: list = []


def _lexicon_of(model: Model) -> Lexicon:
    key = (tuple(sorted(model.words)), tuple(sorted(model.stems)))
    if not _kept or _kept[0] != key:
        alone("toxicity")
        kept["toxicity"] = _kept.clear
        _kept[:] = [key, model.lexicon()]
    return _kept[1]


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
