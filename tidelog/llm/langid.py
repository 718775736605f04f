"""Language identification with string kernels.

A chunk of text is the set of its character n-grams of 1 to 4 letters (blended spectrum, presence
only); the kernel of two chunks is the cosine of their sets. Nystrom landmarks, stratified by
language, span the kernel space; one-versus-rest kernel ridge regression is solved in it, from normal
equations that tasks sum over the training chunks. Folded into one matrix (n-gram slot by language), the
classifier scores batches of ``BATCH`` chunks, each batch by one matrix product. A text is cut in
chunks that cover all of it, whose scores are averaged by their letters. n-grams are hashed to
``SLOTS`` slots: the presence kernel is over slots, and n-grams that share one count as one.

Training takes at most ``PER_LANG`` rows of each language, by a hash of doc_id, two chunks of each;
held-out rows are never read for it. Only text is scored. The driver holds the landmarks and sums
of their size, whatever the number of training rows.

Defined results: null text, or text with no letter, is ``und`` with score 0; without training rows all
texts are; ties go to the first language by name; repeated rows are scored each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, saved

PER_LANG, LANDMARKS, CHUNK = 400, 240, 4000
#: Chunks to one matrix product.
BATCH = 64
ORDERS, SLOTS, RIDGE = 4, 1 << 15, 0.05
SHARPNESS = 6.0


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


class Grams:
    """n-gram slots of chunks, each listed once."""

    def __init__(self):
        self.flags = np.zeros(SLOTS, bool)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        flags, h = self.flags, np.zeros(len(codes), np.uint32)
        for n in range(min(ORDERS, len(codes))):
            h = h[: len(codes) - n] * np.uint32(0x01000193) + codes[n:] + np.uint32(1)
            flags[((h ^ (h >> np.uint32(15))) * np.uint32(2654435769) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - 15)] = True
        out = np.flatnonzero(flags)
        flags[out] = False
        return out


def codes_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with everything but letters made 0, and where the letters are."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = c < 0x10000
    is_letter = _letters()[np.where(low, c, 0)] & low
    for k in np.flatnonzero(~low):
        is_letter[k] = chr(c[k]).isalpha()
    return np.where(is_letter, c, np.uint32(0)), is_letter


def presence(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of unit length, a row per chunk: where its n-grams fall."""
    x = np.zeros((len(sets), SLOTS), np.float32)
    for k, g in enumerate(sets):
        x[k, g] = 1 / np.sqrt(max(1, len(g)))
    return x


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def score(self, texts, grams: Grams) -> tuple[list[str], list[float]]:
        """Language and score of each text; chunks of all texts are scored BATCH at a time."""
        sums, known = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        owner, share, sets = [], [], []
        x = np.zeros((BATCH, SLOTS), np.float32)

        def product():
            for k, g in enumerate(sets):
                x[k, g] = 1 / np.sqrt(len(g))
            np.add.at(sums, owner, np.array(share)[:, None] * (x[: len(sets)] @ self.weights))
            for k, g in enumerate(sets):
                x[k, g] = 0
            owner.clear(), share.clear(), sets.clear()

        for k, t in enumerate(texts):
            c, is_letter = codes_of(t)
            total = int(is_letter.sum())
            if not total or not self.langs:
                continue
            known[k] = True
            for at in range(0, len(c), CHUNK):
                n = int(is_letter[at : at + CHUNK].sum())
                if n:
                    owner.append(k)
                    share.append(n / total)
                    sets.append(grams(c[at : at + CHUNK]))
                    if len(sets) == BATCH:
                        product()
        if sets:
            product()
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        e = np.exp(SHARPNESS * (sums - sums.max(1, keepdims=True)))
        best, top = e.argmax(1), e.max(1) / e.sum(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, known)], np.where(known, top, 0.0).tolist()


def nystrom(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(z, root): the landmarks' rows, and the map from kernels with them to coordinates."""
    grams = Grams()
    z = presence([grams(codes_of(t)[0]) for t in landmarks])
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    ok = value > 1e-6 * value.max()
    return z, vector[:, ok] / np.sqrt(value[ok])


def normal_sums(chunks: list[tuple[str, str]], langs: list[str], weight: dict[str, float], z: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sums of phi phi' and of phi y' over chunks (language, text), y being 1 or -1."""
    grams, d = Grams(), root.shape[1]
    a, b = np.zeros((d, d)), np.zeros((d, len(langs)))
    for at in range(0, len(chunks), BATCH):
        some = chunks[at : at + BATCH]
        phi = (presence([grams(codes_of(t)[0]) for _, t in some]) @ z.T).astype(np.float64) @ root
        w = np.array([weight[y] for y, _ in some])[:, None]
        a += phi.T @ (w * phi)
        b += phi.T @ (w * np.where(np.array([y for y, _ in some])[:, None] == np.array(langs), 1.0, -1.0))
    return a, b


def solved(langs: list[str], a: np.ndarray, b: np.ndarray, z: np.ndarray, root: np.ndarray, ridge: float = RIDGE) -> Model:
    """Kernel ridge regression in the landmarks' space, folded to a weight for each slot and language."""
    beta = np.linalg.solve(a + ridge * np.eye(len(a)), b)
    return Model(langs, z.T @ (root @ beta).astype(np.float32))


def training_chunks(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(lang, key, chunk, place): at most 2 * per_lang chunks of each language, of at most CHUNK code points."""
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    key = F.xxhash64("doc_id", F.lit(23))
    some = rows.withColumn("key", key).join(F.broadcast(counts), "lang").where(F.pmod("key", F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(1.3 * per_lang) / F.col("n")) * (1 << 20))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for y, t, k in zip(pdf["lang"].array, pdf["text"].array, pdf["key"].array):
                n = -(-len(t) // CHUNK)
                for at in sorted({int(k) % n, (int(k) >> 20) % n}) if n else ():
                    out.append((y, int(k), t[at * CHUNK : (at + 1) * CHUNK]))
            yield pd.DataFrame(out, columns=["lang", "key", "chunk"])

    found = some.select("lang", "text", "key").mapInPandas(cut, "lang string, key long, chunk string")
    # The sample has about 2.6 * per_lang chunks of a language, so this window is bounded.
    return found.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "chunk"))).where(F.col("place") <= 2 * per_lang)


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model:
    """Landmarks are the first chunks of each language; the normal equations are summed where the chunks lie."""
    chunks = saved(training_chunks(docs, per_lang), "lang-sample")
    counts = {r[0]: r[1] for r in chunks.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    first = chunks.where(F.col("place") <= max(4, landmarks // len(langs))).select("lang", "place", "chunk").collect()
    z, root = nystrom([r[2] for r in sorted(map(tuple, first))])
    # Each language has the same weight in the sum of squares.
    weight = {y: sum(counts.values()) / n / len(langs) for y, n in counts.items()}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(langs)))
        for pdf in batches:
            more = normal_sums(list(zip(pdf["lang"].array, pdf["chunk"].array)), langs, weight, z, root)
            a, b = a + more[0], b + more[1]
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()]})

    # One row of fixed size for each task, and few tasks: the sample is bounded.
    got = chunks.select("lang", "chunk").coalesce(16).mapInPandas(sums, "a binary, b binary").collect()
    a, b = (sum(np.frombuffer(r[k], np.float64) for r in got) for k in (0, 1))
    d = root.shape[1]
    return solved(langs, a.reshape(d, d), b.reshape(d, len(langs)), z, root)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, per_lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for pdf in batches:
            langs, scores = model.score(pdf["text"].array, grams)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": langs, "score": scores}).astype({"doc_id": "Int64", "lang_pred": object, "score": float})

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
