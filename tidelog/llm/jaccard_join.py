"""N-gram Jaccard join in metric space.

Documents are sets of hashed word shingles; Jaccard distance 1 - J is a metric. The join is exact:

1. Pivots. All shingles have one order: frequent ones (a bounded list, by Misra-Gries counts over all
   documents) last, before them those that a sample holds more than once, by how often, then the rest; equals
   by hash. The sample decides how few documents meet, never what links. Of two linked sets the prefixes in that
   order share a shingle, so documents meet by prefix shingle and size class; at each meeting the document of
   the least hash is the pivot. A document belongs to the region of each pivot that it meets and is copied to all
   of them, so every linked pair lies in one region. Documents that meet none are done.
2. Windows over counts. Folded to counters, a set is a short vector, and the L1 distance of two vectors never
   exceeds the symmetric difference of their sets. In a region the documents that this bound and
   the window of sizes leave without a partner go before any set is sent: first by vectors of at most
   ``MINI`` counters, then, of those left, by whole ones.
3. Voronoi regions. A region of more than ``REGION_SHINGLES`` shingles gets pivots from a table, in
   tasks dealt by salt; a document goes to the cell of its nearest pivot and is copied to the cell of
   each pivot q with d(x, q) <= d(x, p) + 2 eps, so by the triangle inequality every linked pair meets
   in one cell. Cells of one component are done; the others are split again. Cells that pivots cannot
   split, whose documents all lie alike from them, meet in pairs of blocks.
4. In memory a region recurses over pivots in the same way; where windows would copy a document more
   than ``COPIES`` times on average, it compares those whose distances to all pivots differ by at most eps.

Links are confirmed with whole integers on the sets. A region returns a spanning forest of its
links, so that large groups of copies never become all their pairs; components are then joined
across regions. Shingles are 64-bit hashes of the words.

Defined results: only A-Z is lower-cased; null text, empty text and text of white space have the empty
set, are linked with nothing and are their own component; fewer words than n form one shingle;
rows that share a doc_id are one document for components; an empty table gives an empty result;
extra columns are ignored. Very long texts are whole sets; ties in distance go to the first pivot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcastable, components, join_hot, only_ids, parts, saved, task_of

#: Shingles (8 bytes each) that one in-memory region may hold.
REGION_SHINGLES = 4_000_000
#: Documents of a region whose vectors one task compares; larger regions keep all of theirs.
REGION_VECTORS = 5_000
#: Counters that a task compares at a time; of longer vectors neighbours are summed first.
VECTOR_CELLS = 4_000_000
#: Pivots of a region that is split before the in-memory step.
SPLIT_PIVOTS = 16
#: Counters of a Misra-Gries summary, and the most shingles that the frequent list holds (8 bytes each, sent to every task).
COUNTERS = 8_192
#: Shingles of the documents that the order of shingles is made from, and the most that it holds (9 bytes each, sent to every task).
SAMPLE, COMMON = 12_000_000, 524_288
#: Counters of the vectors that every document sends to its regions.
MINI = 64
#: Copies of a document, on average, beyond which an in-memory region is not split further.
COPIES = 2.0
#: Tasks among which a frequent shingle's documents are dealt.
SALTS = 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


#: White space ends words: space, tab, line feed, vertical tab, form feed, return.
_IS_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BYTES = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * _M1) * _M3) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse, n of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(raw: bytes, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word of lower-cased text, where it starts), in order: differences of running sums over its bytes.

    Text is read in pieces of so many bytes, each cut at white space, so that memory does not grow with it.
    """
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_SPACE[b], prepend=True, append=True))
    start, end = edge[0::2], edge[1::2]
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        at = int(start[k])
        j = max(k + 1, int(np.searchsorted(end, at + piece, side="right")))
        part = b[at : int(end[j - 1])]
        up, down = _powers(max(piece, len(part)))
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=run[1:])
        out[k:j] = (run[end[k:j] - at] - run[start[k:j] - at]) * down[start[k:j] - at]
        k = j
    return _mix(out * _M2 + (end - start).astype(np.uint64)), start


def _chained(h: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hashes of the runs of n words of h; size is what a run counts as."""
    m = len(h) - n + 1
    out = np.full(m, size, np.uint64)
    for k in range(n):
        out = _mix(out * _M1 + h[k : k + m])
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def shingle_sets(texts, n: int, group: int = 1 << 19) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text; texts are hashed a group of bytes at a time."""

    def sets(raws: list[bytes]) -> Iterator[np.ndarray]:
        h, start = word_hashes(b"\n".join(raws))
        ends = np.cumsum([len(r) + 1 for r in raws])
        cut = np.concatenate(([0], np.searchsorted(start, ends)))
        runs = _chained(h, n, n) if len(h) >= n else None
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= n:
                yield _distinct(runs[a : b - n + 1])
            else:
                yield _chained(h[a:b], b - a, b - a) if b > a else np.empty(0, np.uint64)

    waiting, held = [], 0
    for t in texts:
        # bytes.lower() knows ASCII only.
        raw = (t or "").encode("utf-8", "surrogatepass").lower()
        waiting.append(raw)
        held += len(raw)
        if held >= group:
            yield from sets(waiting)
            waiting, held = [], 0
    if waiting:
        yield from sets(waiting)


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def vector(s: np.ndarray) -> np.ndarray:
    """Counts of s in equal ranges of its mixed hashes: a power of two of them, about one for six shingles.

    Half as many ranges are the sums of neighbours. Counts stop at 255, which stands for any number.
    """
    bits = max(4, math.ceil(math.log2(max(1, len(s)) / 6)))
    return np.minimum(np.bincount((_mix(s ^ _M3) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(v: np.ndarray, size: int) -> np.ndarray:
    """v as at most size counters: sums of neighbours."""
    v = v.astype(np.int32)
    while len(v) > size:
        top = (v[0::2] >= 255) | (v[1::2] >= 255)
        v = np.where(top, 255, np.minimum(v[0::2] + v[1::2], 255))
    return v


# ---- the order of shingles, prefixes and size classes -----------------------------------------


class Frequent:
    """A Misra-Gries summary of shingles, kept as sorted arrays; waits until several summaries' worth is at hand."""

    def __init__(self, counters: int = COUNTERS):
        self.counters, self.waiting, self.held = counters, [], 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.waiting.append(s)
        self.held += len(s)
        if self.held > 64 * self.counters:
            self.merge()

    def merge(self) -> None:
        new, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.waiting, self.held = [], 0
        keys, at = np.unique(np.concatenate((self.keys, new)), return_inverse=True)
        counts = np.bincount(at, np.concatenate((self.counts, n)), len(keys)).astype(np.int64)
        if len(keys) > self.counters:
            counts = counts - np.partition(counts, -self.counters - 1)[-self.counters - 1]
        self.keys, self.counts = keys[counts > 0], counts[counts > 0]


class Prefixes:
    """Prefix shingles by size class for threshold num/den.

    The smaller of a linked pair shows its head (the first few) to its own class and, where a partner
    may lie there, to the next; the larger shows its prefix to its own class.
    """

    #: The rank of frequent shingles, after all others.
    HOT = 255

    def __init__(self, num: int, den: int, frequent: np.ndarray, common: np.ndarray | None = None, ranks: np.ndarray | None = None):
        """common: sorted shingles that come after all others, by ranks (1 to HOT - 1), and before frequent ones."""
        self.num, self.den = num, den
        known, at = np.unique(np.concatenate((frequent, *([] if common is None else [common]))), return_index=True)
        self.known = known
        self.ranks = np.concatenate((np.full(len(frequent), self.HOT, np.uint8), *([] if ranks is None else [ranks])))[at]
        # The smallest set that can link with a different one: |x| / (|x| + 1) >= t.
        self.least = max(1, -(-num // max(1, den - num)))
        self.starts = [self.least]
        self.tags: dict[int, np.ndarray] = {}

    def of(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * self.den**2 // self.num**2 + 1)
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def tag(self, k: int) -> np.ndarray:
        if k not in self.tags:
            self.tags[k] = _mix(np.array([k], np.uint64) * _M1 + _M3)
        return self.tags[k]

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, head, frequent) of the meetings that s goes to."""
        n, num, den = len(s), self.num, self.den
        if n < self.least:
            return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool)
        at = np.minimum(np.searchsorted(self.known, s), max(0, len(self.known) - 1))
        rank = np.where(self.known[at] == s, self.ranks[at], 0) if len(self.known) else np.zeros(n, np.uint8)
        prefix, head = n - -(-num * n // den) + 1, n - -(-2 * num * n // (den + num)) + 1
        order = np.argsort(rank, kind="stable")[:prefix]
        first, hot = s[order], rank[order] == self.HOT
        j = self.of(n)
        tag = lambda x, k: _mix(x ^ self.tag(k))
        keys, heads, hots = [tag(first, j)], [np.arange(len(first)) < head], [hot]
        if den * n >= num * self.starts[j + 1]:
            keys.append(tag(first[:head], j + 1))
            heads.append(np.ones(len(first[:head]), bool))
            hots.append(hot[:head])
        return np.concatenate(keys), np.concatenate(heads), np.concatenate(hots)


def _sets(n: int, counters: int):
    @task_of("jaccard_join")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = Frequent(counters)
        for pdf in batches:
            ids, size, dig, node, vec, mini = pdf["doc_id"].array, [], [], [], [], []
            for s in shingle_sets(pdf["text"].array, n):
                d = digest(s) if len(s) else None
                often.add(s)
                size.append(len(s))
                dig.append(d)
                node.append(_node(d) if d else None)
                v = vector(s) if d else None
                vec.append(v.tobytes() if d else None)
                mini.append(folded(v, MINI).astype(np.uint8).tobytes() if d else None)
            yield pd.DataFrame({"kind": np.int32(0), "doc_id": ids, "n_shingles": size, "digest": dig, "node": pd.array(node, "Int64"), "vec": vec, "mini": mini}).astype({"doc_id": "Int64"})
        often.merge()
        m = len(often.keys)
        yield pd.DataFrame({"kind": np.int32(1), "doc_id": pd.array([None] * m, "Int64"), "n_shingles": often.counts, "digest": None, "node": pd.array(often.keys.view(np.int64), "Int64"), "vec": None, "mini": None})

    return run


def doc_sets(docs: DataFrame, n: int, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(sets, frequent): (doc_id, n_shingles, digest, node, vec, mini) of every document, and (shingle, n) of frequent ones."""
    schema = "kind int, doc_id long, n_shingles long, digest binary, node long, vec binary, mini binary"
    both = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_sets(n, counters), schema), "sets")
    often = both.where("kind = 1").groupBy(F.col("node").alias("shingle")).agg(F.sum("n_shingles").alias("n"))
    return both.where("kind = 0").drop("kind"), often


def common_shingles(docs: DataFrame, n: int, total: int, sample: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks): those that documents with about sample of all total shingles hold more than once, sorted; the more, the higher the rank."""

    @task_of("jaccard_join")
    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in shingle_sets(pdf["text"].array, n):
                yield pd.DataFrame({"shingle": s.view(np.int64)})

    part = min(1_000_000, max(1, 1_000_000 * sample // max(1, total)))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(1_000_000)) < part).select(F.col("text").cast("string").alias("text"))
    counts = saved(some.mapInPandas(held, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "common")
    # The rows that go to the driver and to every task: those of the ranks that fit, at most `most`.
    rank = F.least(F.floor(F.log2("n")), F.lit(Prefixes.HOT - 1)).cast("int")
    fit, least = 0, Prefixes.HOT
    for r, c in sorted(counts.groupBy(rank).count().collect(), reverse=True):
        if fit + c > most:
            break
        fit, least = fit + c, r
    found = counts.select("shingle", rank.alias("rank")).where(F.col("rank") >= least).toArrow()
    keys = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("rank").to_numpy().astype(np.uint8)[order]


def _emit(n: int, num: int, den: int, frequent: np.ndarray, common: np.ndarray | None = None, ranks: np.ndarray | None = None, seen_limit: int = 200_000):
    @task_of("jaccard_join")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefixes, seen = Prefixes(num, den, frequent, common, ranks), set()
        for pdf in batches:
            out, held = [], 0
            for s in shingle_sets(pdf["text"].array, n):
                if len(s) < prefixes.least:
                    continue
                node = _node(digest(s))
                if node in seen:  # a copy: what it shows is already sent by this task
                    continue
                if len(seen) >= seen_limit:
                    seen.clear()
                seen.add(node)
                keys, head, hot = prefixes(s)
                out.append((keys, head, np.where(hot, 1 + node % SALTS, 0).astype(np.int32), np.full(len(keys), node, np.int64)))
                held += len(keys)
                if held > 200_000:
                    yield frame(out)
                    out, held = [], 0
            if out:
                yield frame(out)

    def frame(out):
        keys, head, salt, node = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"sig": keys.view(np.int64), "salt": salt, "node": node, "head": head})

    return run


def regions(docs: DataFrame, often: DataFrame, n: int, num: int, den: int, counters: int = COUNTERS, total: int = 0) -> DataFrame:
    """(cell, node): the regions, named by their pivot's node, and the documents in each, pivots too. total: how many shingles docs have; without it no sample orders them."""
    spark = docs.sparkSession
    # At most counters rows: a proven bound for what goes to the driver and to every task.
    top = often.where("n > 1").orderBy(F.desc("n"), "shingle").limit(counters).select("shingle").collect()
    frequent = np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))
    common = common_shingles(docs, n, total) if total else ()
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(_emit(n, num, den, frequent, *common), "sig long, salt int, node long, head boolean").repartition(shuffle, "sig", "salt")
    # What is shown is dealt out once: a meeting's least and greatest document are found where it lies.
    here = Window.partitionBy("sig", "salt")
    met = sent.select("sig", "salt", "node", F.min("node").over(here).alias("low"), F.max("node").over(here).alias("high"), F.max("head").over(here).alias("heads")).where("salt > 0 or (low < high and heads)")
    only_hot = [F.when(F.col("salt") > 0, F.col(c)).alias(c) for c in ("sig", "high", "heads")]
    met = saved(met.select("salt", "node", "low", *only_hot), "met")
    cold = met.where("salt = 0").select(F.col("low").alias("cell"), "node")
    # Keys of frequent shingles: at most counters times the size classes, whatever the number of documents.
    hot = met.where("salt > 0").groupBy("sig").agg(F.min("low").alias("cell"), F.max("high").alias("high"), F.max("heads").alias("heads")).where("cell < high and heads").select("sig", "cell")
    hot = met.where("salt > 0").join(F.broadcast(hot), "sig").select("cell", "node")
    return cold.unionByName(hot).distinct()


# ---- windows over vectors -----------------------------------------------------------------------


def _may_link(size: np.ndarray, vecs: list[bytes], num: int, den: int, work: int = 400_000_000) -> np.ndarray:
    """Which documents of a region may have a partner in it, by size and by the L1 distance of their vectors."""
    raw = [np.frombuffer(v, np.uint8) for v in vecs]
    width = min(map(len, raw))
    while width > 16 and width * len(raw) > VECTOR_CELLS:
        width //= 2
    v = np.stack([folded(x, width) for x in raw])
    full = v >= 255
    # A full counter stands for any number: it is left out of the distance.
    v = np.where(full, -1, v)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        far = np.where(full[rest] | full[i], 0, np.abs(v[rest] - v[i])).sum(1)
        # Linked sets differ in at most (a + b)(1 - t)/(1 + t) shingles, and in size by the factor t.
        return ((den + num) * far <= (den - num) * (size[rest] + size[i])) & (den * np.minimum(size[rest], size[i]) >= num * np.maximum(size[rest], size[i]))

    ok = np.zeros(len(size), bool)
    every = np.arange(len(size))
    hit = near(0, every)
    hit[0] = False
    ok |= hit
    ok[0] = hit.any()
    left = np.flatnonzero(~ok)
    if len(left) * len(size) * width > work:
        ok[:] = True
        return ok
    order = np.argsort(size, kind="stable")
    for i in left:
        if ok[i]:
            continue
        lo, hi = np.searchsorted(size[order], [-(-num * size[i] // den), den * size[i] // num + 1])
        rest = order[lo:hi]
        rest = rest[rest != i]
        if len(rest):
            hit = near(i, rest)
            if hit.any():
                ok[i] = True
                ok[rest[hit]] = True
    return ok


def _survivors(num: int, den: int):
    @task_of("jaccard_join")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []

        def flush():
            out = sorted(dict((r[0], r) for r in rows).values(), key=lambda r: (r[0] != key, r[0]))
            if len(out) < 2:
                return None
            ok = np.flatnonzero(_may_link(np.array([r[1] for r in out], np.int64), [r[2] for r in out], num, den))
            return pd.DataFrame({"cell": np.full(len(ok), key, np.int64), "node": np.array([out[k][0] for k in ok], np.int64)}) if len(ok) else None

        for pdf in batches:
            done = []
            for c, i, m, v in zip(pdf["cell"].array, pdf["node"].array, pdf["n"].array, pdf["vec"].array):
                if c != key:
                    if len(rows) > 1:
                        done.append(flush())
                    key, rows = c, []
                rows.append((int(i), int(m), v))
            done = [d for d in done if d is not None]
            if done:
                yield pd.concat(done, ignore_index=True)
        last = flush() if len(rows) > 1 else None
        if last is not None:
            yield last

    return run


# ---- in memory: recursion over pivots -------------------------------------------------------


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


class _Cell:
    """The sets of one region, and the exact join over them. counted: pivots, regions and copies of boundary documents."""

    PIVOTS = 8

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.eps = 1 - num / den + 1e-9
        self.size = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets)
        # Dense ids make each test one look-up.
        _, ids = np.unique(self.flat, return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.mark = np.zeros(int(self.ids.max()) + 1 if len(ids) else 1, bool)
        self.forest = _Forest(len(sets))
        self.links: list[tuple[int, int]] = []
        self.counted = [0, 0, 0]

    def shared(self, p: int, others: np.ndarray) -> np.ndarray:
        own = self.ids[self.start[p] : self.start[p + 1]]
        self.mark[own] = True
        n = self.size[others]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) + np.repeat(self.start[others] - (ends - n), n)
        out = np.add.reduceat(self.mark[self.ids[at]].astype(np.int32), ends - n)
        self.mark[own] = False
        return out

    def test(self, p: int, others: np.ndarray) -> np.ndarray:
        """Distances from p to others; links go to the forest."""
        both = self.shared(p, others)
        union = self.size[p] + self.size[others] - both
        for x in others[self.den * both >= self.num * union]:
            if x != p and self.forest.join(p, int(x)):
                self.links.append((p, int(x)))
        return 1 - both / union

    def roots(self, who: np.ndarray) -> np.ndarray:
        return np.array([self.forest.find(int(x)) for x in who])

    def run(self, who: np.ndarray) -> None:
        todo = [who]
        while todo:
            who = todo.pop()
            if len(who) > 1:
                todo += self.split(who)

    def split(self, who: np.ndarray) -> list[np.ndarray]:
        """The Voronoi regions of who over farthest-first pivots, the first of middle size; none when its links are found."""
        first = who[np.argsort(self.size[who], kind="stable")[len(who) // 2]]
        pivots, dist = [int(first)], [self.test(int(first), who)]
        near = dist[0].copy()
        while len(pivots) < min(self.PIVOTS, len(who) - 1) and near.max() > 2 * self.eps:
            p = int(who[int(near.argmax())])
            pivots.append(p)
            dist.append(self.test(p, who))
            near = np.minimum(near, dist[-1])
        d = np.stack(dist, 1)
        self.counted[0] += len(pivots)
        if len(np.unique(self.roots(who))) == 1 or len(pivots) == len(who):
            return []
        cells = [np.flatnonzero(d[:, k] <= near + 2 * self.eps) for k in range(len(pivots))]
        total = sum(map(len, cells))
        if total <= COPIES * len(who) and max(map(len, cells)) < len(who):
            self.counted[1] += len(cells)
            self.counted[2] += total - len(who)
            return [who[c] for c in cells]
        self.compare(who, d)
        return []

    def compare(self, who: np.ndarray, d: np.ndarray) -> None:
        """Each document against those after it in size order that no window excludes."""
        order = np.lexsort((who, self.size[who]))
        who, d = who[order], d[order]
        size = self.size[who]
        root = self.roots(who)
        for i in range(len(who) - 1):
            end = int(np.searchsorted(size, size[i] * self.den // self.num, side="right"))
            if end <= i + 1:
                continue
            rest = slice(i + 1, end)
            ok = (root[rest] != root[i]) & (np.abs(d[rest] - d[i]) <= self.eps).all(1)
            pick = np.flatnonzero(ok) + i + 1
            if len(pick):
                n = len(self.links)
                self.test(int(who[i]), who[pick])
                if len(self.links) > n:
                    old, of = np.unique(root, return_inverse=True)
                    root = self.roots(old)[of]


def join_cell(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets."""
    if len(sets) < 2:
        return []
    cell = _Cell(sets, num, den)
    cell.run(np.arange(len(sets)))
    return cell.links


def _join_cells(num: int, den: int):
    def links(rows: list[tuple[int, bytes]]) -> tuple[list[int], list[int]]:
        rows = sorted(dict((b, i) for i, b in rows).items(), key=lambda x: (len(x[0]), x[1]))
        found = join_cell([np.frombuffer(b, np.uint64) for b, _ in rows], num, den)
        return [rows[a][1] for a, _ in found], [rows[b][1] for _, b in found]

    @task_of("jaccard_join")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, a, b = None, [], [], []

        def flush():
            x, y = links(rows)
            a.extend(x)
            b.extend(y)

        for pdf in batches:
            for k, i, s in zip(pdf["cell"].array, pdf["doc_id"].array, pdf["shingles"].array):
                if k != key:
                    if len(rows) > 1:
                        flush()
                    key, rows = k, []
                rows.append((int(i), s))
            if len(a) > 10_000:
                yield pd.DataFrame({"a": a, "b": b})
                a.clear(), b.clear()
        if len(rows) > 1:
            flush()
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


# ---- large regions --------------------------------------------------------------------------


def _voronoi(num: int, den: int):
    """Rows of (region, salt), its pivots first: links to pivots (other is one), and the cells of each document."""
    names = ["region", "doc_id", "digest", "n", "other"]

    @task_of("jaccard_join")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, pivots, forest, eps = None, [], None, 1 - num / den + 1e-9
        for pdf in batches:
            out = []
            for region, salt, pivot, i, dig, n, s in zip(*(pdf[c].array for c in ("region", "salt", "pivot", "doc_id", "digest", "n", "shingles"))):
                if (region, salt) != key:
                    key, pivots, forest = (region, salt), [], _Forest(SPLIT_PIVOTS)
                x = np.frombuffer(s, np.uint64)
                if pivot >= 0:
                    pivots.append((int(i), x))
                    continue
                d, linked = [], None
                for k, (p, q) in enumerate(pivots):
                    both = len(np.intersect1d(x, q, assume_unique=True))
                    union = len(x) + len(q) - both
                    d.append(1 - both / union)
                    # Of the pivots that a document links with, those that this task has not joined yet.
                    if p != i and den * both >= num * union and (linked is None or forest.join(linked, k)):
                        linked = k if linked is None else linked
                        out.append((None, i, None, None, p))
                out += [(f"{region}/{k}", i, dig, n, None) for k, v in enumerate(d) if v <= min(d) + 2 * eps]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64", "n": "Int64", "other": "Int64"})

    return run


def cells_of(placed: DataFrame, body: DataFrame, num: int, den: int, limit: int, count: int) -> tuple[DataFrame, DataFrame | None]:
    """((cell, doc_id, shingles), links) for placed (region, doc_id, digest, n): every linked pair meets in a cell of bounded size, or is joined by links."""
    key, cols = ["doc_id", "digest"], ["region", "doc_id", "digest", "n"]
    near = lambda rows, n: F.broadcast(rows) if broadcastable(n) else rows
    with_sets = lambda rows: body.select(*key, "shingles").join(near(rows, count), key)
    totals = lambda rows: saved(rows.groupBy("region").agg(F.sum("n").alias("total")).where(F.col("total") > limit), "large")
    large = totals(placed)
    n_large = large.count()
    if not n_large:
        return with_sets(placed).select(F.col("region").alias("cell"), "doc_id", "shingles"), None
    small = placed.join(near(large, n_large), "region", "left_anti").select(*cols)
    rows = saved(placed.join(near(large, n_large), "region", "left_semi").select(*cols), "rows0")
    links, blocks, step = None, None, 0
    while n_large:
        step += 1
        dealt = large.withColumn("salts", F.ceil(F.col("total") / limit).cast("int"))
        picks = [F.min_by(F.struct(*key, "n"), F.xxhash64("doc_id", F.lit(step), F.lit(k))) for k in range(SPLIT_PIVOTS)]
        pivots = rows.groupBy("region").agg(F.array_distinct(F.array(*picks)).alias("p")).join(dealt, "region").select("region", "salts", F.posexplode("p").alias("pivot", "p"))
        pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "pivot", "p.*")
        salted = rows.join(near(dealt, n_large), "region").select("region", F.pmod(F.xxhash64("doc_id", F.lit(step)), F.col("salts")).cast("int").alias("salt"), F.lit(-1).alias("pivot"), *key, "n")
        both = body.select(*key, "shingles").join(pivots.unionByName(salted), key)
        width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts(count, 20_000))
        order = [F.col("region"), F.col("salt"), F.col("pivot") < 0, F.col("pivot")]
        found = both.repartition(width, "region", "salt").sortWithinPartitions(*order).mapInPandas(_voronoi(num, den), "region string, doc_id long, digest binary, n long, other long")
        found = saved(found, f"voronoi{step}")
        new = found.where("other is not null").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))
        links = new if links is None else saved(links.unionByName(new), "split-links")
        comp = components(links, "split") if links.limit(1).count() else None
        spots = found.where("other is null").drop("other")
        if comp is not None:
            spots = spots.join(comp, spots["doc_id"] == comp["node"], "left").select(*cols, F.coalesce("component", "doc_id").alias("component"))
        else:
            spots = spots.withColumn("component", F.col("doc_id"))
        # Cells of one component are done; a cell that holds nearly all of its region is not split by pivots.
        cells = spots.groupBy("region").agg(F.sum("n").alias("total"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").withColumn("parent", F.regexp_replace("region", "/[^/]*$", ""))
        cells = cells.join(large.select(F.col("region").alias("parent"), F.col("total").alias("before")), "parent").withColumn("stuck", (F.col("total") > limit) & (F.col("total") > 0.9 * F.col("before")))
        cells = saved(cells.select("region", "total", "stuck"), "cells")
        spots = saved(spots.join(near(cells, cells.count()), "region").select(*cols, "total", "stuck"), f"rows{step}")
        small = small.unionByName(spots.where(F.col("total") <= limit).select(*cols))
        stuck = spots.where("stuck").withColumn("blocks", F.ceil(F.col("total") * 2 / limit).cast("int"))
        blocks = stuck if blocks is None else blocks.unionByName(stuck)
        rows = spots.where((F.col("total") > limit) & ~F.col("stuck")).select(*cols)
        large = totals(rows)
        n_large = large.count()
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    blocks = blocks.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select(F.concat_ws("/", "region", F.least("mine", "other"), F.greatest("mine", "other")).alias("region"), "doc_id", "digest", "n")
    return with_sets(small.unionByName(blocks)).select(F.col("region").alias("cell"), "doc_id", "shingles"), links


def linked(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, limit: int = REGION_SHINGLES, vectors: int = REGION_VECTORS) -> tuple[DataFrame, DataFrame]:
    """(sets, links): doc_sets, and a forest of links (a, b) between the least doc_ids of different sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets, often = doc_sets(docs, n)
    none = spark.createDataFrame([], "a long, b long")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    met = saved(regions(docs, often, n, num, den, total=total), "regions")
    if met.limit(1).count() == 0:
        return sets, none

    def reps(*cols: str, of: DataFrame | None = None, rows: int = 0) -> DataFrame:
        """A row for each set (of those in regions of): its least doc_id, its node and size, and cols."""
        known = sets.where("digest is not null and doc_id is not null")
        if of is not None:
            nodes = of.select("node").distinct()
            known = known.join(F.broadcast(nodes) if broadcastable(rows) else nodes, "node", "left_semi")
        return known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("node").alias("node"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in cols])

    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = met.groupBy("cell").agg(F.count("*").alias("docs")).where(F.col("docs") > vectors).select("cell")
    sizes = saved(sizes, "wide")
    n_wide = sizes.count()
    wide = lambda how: met.join(F.broadcast(sizes) if broadcastable(n_wide) else sizes, "cell", how)
    def left(rows: DataFrame, own: DataFrame, name: str) -> DataFrame:
        """The rows (cell, node) that the vectors of own leave."""
        few = rows.join(own.select("node", "n", F.col(name).alias("vec")), "node").select("cell", "node", "n", "vec")
        return saved(few.repartition(shuffle, "cell").sortWithinPartitions("cell").mapInPandas(_survivors(num, den), "cell long, node long"), f"left-{name}")

    kept = left(wide("left_anti") if n_wide else met, reps("mini"), "mini")
    rows = kept.count()
    kept = left(kept, reps("vec", of=kept, rows=rows), "vec")
    if n_wide:
        kept = kept.unionByName(wide("left_semi"))
    rows = kept.count()
    wanted = saved(kept.join(reps(of=kept, rows=rows), "node").select("doc_id", F.col("cell").cast("string").alias("region"), "digest", "n"), "wanted")
    count = wanted.count()
    if not count:
        return sets, none

    @task_of("jaccard_join")
    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = list(shingle_sets(pdf["text"].array, n))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": [digest(x) for x in s], "shingles": [x.tobytes() for x in s]})

    # Sets are kept once; each region's copies are made on the way to the exchange that deals out regions.
    body = saved(only_ids(docs, wanted.select("doc_id").distinct(), True, count).mapInPandas(bodies, "doc_id long, digest binary, shingles binary"), "bodies")
    cells, links = cells_of(wanted, body, num, den, limit, count)
    width = max(shuffle, parts(count, 20_000))
    found = cells.repartition(width, "cell").sortWithinPartitions("cell").mapInPandas(_join_cells(num, den), "a long, b long")
    return sets, saved(found if links is None else found.unionByName(links), "links")


def join_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, limit: int = REGION_SHINGLES, vectors: int = REGION_VECTORS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included)."""
    sets, links = linked(docs, n, num, den, limit, vectors)
    known = sets.where("digest is not null and doc_id is not null")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    many = saved(known.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 < d1").select("doc_id"), "many")
    n_many = many.count()
    if n_many:
        # Rows that share a doc_id and have different sets tie their sets together.
        tied = known.join(many, "doc_id", "left_semi").join(reps, "digest").where("rep < doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        links = links.unionByName(tied)
    if links.limit(1).count():
        comp = components(links, "links")
        reps = reps.join(comp, reps["rep"] == comp["node"], "left").select("digest", "rows", F.coalesce("component", "rep").alias("component_id"))
    else:
        reps = reps.withColumnRenamed("rep", "component_id")
    out = join_hot(sets.select("doc_id", "n_shingles", "digest"), saved(reps, "known"), "digest", "rows")
    if n_many:
        low = out.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("low"))
        out = out.join(low, "doc_id", "left").withColumn("component_id", F.coalesce("low", "component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs with the least doc_id of their component, all columns kept; null ids and rows that repeat an id stay."""
    found = saved(join_components(docs, n, num, den), "components")
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return only_ids(docs, gone, False, gone.count())
