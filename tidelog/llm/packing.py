"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` tokens (only longer documents are cut).
Pieces are dealt into partitions of bounded size; each is packed by best-fit decreasing, and dual
feasible functions give a lower bound on its bins, a real number of which the next whole one certifies
the partition. The gap is bins less that number: a partition that is certified still wastes a part
of a bin, and the parts of several make bins. Partitions with a gap release their emptiest bins, as
many as the gap could close; the released pieces are exchanged between fewer partitions and packed
again, until one partition has packed the rest or a round releases no fewer than it took. Each
piece tells the bins and the bound of the partition that packed it, and so whether it is certified.

Only (piece, length) pairs travel. Defined results: null text is empty and yields one piece, the
end id alone; repeated rows are packed each; an empty table gives an empty result; extra columns are
ignored; ties between equal lengths are broken by (doc_id, row, piece).
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, parts, release, saved, task_of, text_of

CAPACITY = 2048
#: Pieces that one partition packs.
PIECES_PER_PART = 20_000
#: Chunks whose ids a worker remembers, in each of two generations.
CACHE_CHUNKS = 250_000


class WordTokens:
    """Ids of texts by their chunks between white space; asks the tokenizer once per chunk.

    The tokenizer splits text by white space and by the pattern below before any merge, so the ids
    of a text are those of its chunks in turn. That holds for the characters that ``ODD`` admits
    (their lower case is one character and canonical composition keeps them); a text with any
    other, or with "<|", goes to the tokenizer whole. Arrow splits and numbers the chunks of a group
    of texts, so only distinct chunks are Python objects; new ones are encoded together, and the
    end-of-word mark, which only the last token of a piece has, parts them again. Two generations of
    CACHE_CHUNKS bound the memory.
    """

    ODD = "[^\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ¡¿«»–—‘’“”…]|<\\|"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tok = Tokenizer.from_file(path)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # The same merges on pieces that are parted already and written as byte letters.
        self.merges = Tokenizer(self.tok.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept and b != 32]
        self.letters = {**{b: b for b in kept}, **{b: 256 + k + (b > 32) for k, b in enumerate(rest)}}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are not known, by their pieces."""
        parts = [self.pieces(c) for c in chunks]
        unknown = set(chain.from_iterable(parts)).difference(self.new)
        fresh = unknown.difference(self.old)
        self.new.update((c, self.old[c]) for c in unknown.difference(fresh))
        fresh = list(fresh)
        for at in range(0, len(fresh), 2000):
            some = fresh[at : at + 2000]
            text = " ".join(some)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            last = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(last) != len(some):
                self.new.update((c, self.whole(c)) for c in some)
                continue
            flat = ids.tobytes()
            self.new.update((c, flat[a:b]) for c, a, b in zip(some, [0, *last], last))
        ids = self.new.__getitem__
        self.new.update((c, b"".join(map(ids, p))) for c, p in zip(chunks, parts) if len(p) != 1)

    def of(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text."""
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(plain))
        coded = chunks.flatten().dictionary_encode()
        if len(self.new) > CACHE_CHUNKS:
            self.new, self.old = {}, self.new
        words = coded.dictionary.to_pylist()
        unknown = set(words).difference(self.new)
        unknown.discard("")
        fresh = unknown.difference(self.old)
        self.new.update((c, self.old[c]) for c in unknown.difference(fresh))
        self.learn(list(fresh))
        self.new[""] = b""
        known = list(map(self.new.__getitem__, words))
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table, start = np.frombuffer(b"".join(known), "<u4"), np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(size) else size
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = size[code]
        end = np.cumsum(n)
        flat = table[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start[code] - (end - n), n)].tobytes()
        cuts = (4 * np.concatenate(([0], end))[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]).tolist()
        return [self.whole(texts[k].as_py()) if odd[k] else flat[cuts[k] : cuts[k + 1]] for k in range(len(texts))]


def groups_of(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(start, length) of slices of texts of about so many bytes."""
    start = total = 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        total += n
        if total >= size:
            yield start, k + 1 - start
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


@lru_cache(1)
def word_tokens(path: str) -> WordTokens:
    kept["packing"] = word_tokens.cache_clear
    return WordTokens(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]) of each document's tokens and end id."""
    tokenizer = tokenizer or tokenizer_path()
    schema = "doc_id long, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    @task_of("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, step, crc = word_tokens(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity, zlib.crc32
        for batch in batches:
            texts, doc_ids, rows = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for start, n in groups_of(texts):
                out = []
                for k, ids in enumerate(known.of(texts.slice(start, n)), start):
                    ids += end
                    for j, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at : at + step]
                        out.append((doc_ids[k], rows[k], j, at // 4, len(cut) // 4, crc(cut), cut)[: 6 + with_ids])
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], schema_names)
            release()

    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    schema_names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of().alias("text")).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> float:
    """Bins that any packing needs, as a real number: the best of the volume bound and two families of dual feasible functions.

    f_eps drops items up to eps and counts those over capacity - eps as whole bins; u_k scales by
    k + 1 and rounds down unless exact. Both keep every feasible bin's sum within 1.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(n: np.ndarray, capacity: int) -> float:
    """lower_bound() of n[x] pieces of each length x."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = int(n @ x) / capacity
    for eps in range(1, capacity // 2 + 1, max(1, capacity // 256)):
        f = np.where(x > capacity - eps, capacity, np.where(x < eps, 0, x))
        best = max(best, int(n @ f) / capacity)
    for k in range(1, 9):
        up = (k + 1) * x
        f = np.where(up % capacity == 0, x * k, (up // capacity) * capacity)
        best = max(best, int(n @ f) / (capacity * k))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length, in the given order; lengths descend. Residuals are kept in one bit mask."""
    room: dict[int, list[int]] = {}
    mask, bins, n = 0, np.empty(len(lengths), np.int64), 0
    for i, x in enumerate(lengths.tolist()):
        fit = mask >> x
        if fit:
            r = x + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            b, r, n = n, capacity, n + 1
        if r > x:
            room.setdefault(r - x, []).append(b)
            mask |= 1 << (r - x)
        bins[i] = b
    return bins


def _pack_part(capacity: int, round_no: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        gap = len(fill) - bound
        # With a gap the emptiest bins go, until their room is twice what the gap wastes, and one more.
        order = np.argsort(fill, kind="stable")
        room = np.cumsum(capacity - fill[order])
        go = np.zeros(len(fill), bool)
        if gap > 0:
            go[order[: int(np.searchsorted(room, 2 * gap * capacity)) + 1]] = True
        go &= fill < capacity
        offset = pd.Series(lengths).groupby(bins).cumsum().to_numpy() - lengths
        number = (np.int64(round_no) << 56) + (np.int64(pdf["part"].iloc[0]) << 24) + bins
        return pdf[["doc_id", "row", "piece", "length"]].assign(sequence_id=number, offset=offset, free=go[bins], part_bins=len(fill), part_bound=bound)

    return run


def pack(table: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES_PER_PART) -> DataFrame:
    """(doc_id, row, piece, length, sequence_id, offset, part_bins, part_bound) for the pieces of table; reads each once a round."""
    schema = "doc_id long, row long, piece int, length long, sequence_id long, offset long, free boolean, part_bins long, part_bound double"
    rest, done, round_no = table.select("doc_id", "row", "piece", "length"), None, 0
    n, last = rest.count(), None
    while True:
        p = parts(n, per_part)
        part = F.pmod(F.xxhash64("doc_id", "row", "piece", F.lit(round_no)), F.lit(p))
        packed = saved(rest.withColumn("part", part).groupBy("part").applyInPandas(_pack_part(capacity, round_no), schema), f"packed{round_no}")
        kept = packed.where("not free").drop("free")
        freed, bins = packed.where("free").agg(F.count("*"), F.countDistinct("sequence_id")).first()
        round_no += 1
        if p == 1 or not freed or (last is not None and freed >= last):
            return (done.unionByName(packed.drop("free")) if done is not None else packed.drop("free"))
        done = kept if done is None else done.unionByName(kept)
        rest, n, last = packed.where("free"), freed, freed


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, per_part: int = PIECES_PER_PART) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_bins, part_bound."""
    table = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    places = pack(table, capacity, per_part).drop("length")
    key = ["doc_id", "row", "piece"]
    on = [table[k].eqNullSafe(places[k]) for k in key]
    return table.join(places, on, "inner").select(table["doc_id"], table["piece"], "start", "length", "ids_crc32", "sequence_id", "offset", "part_bins", "part_bound")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict:
    """{bins, bound, gap} of a packing: the bins it uses, and those that any packing of its pieces needs."""
    counts = packed.groupBy("length").count().collect()  # a row for each length, at most capacity of them
    bins = packed.agg(F.count_if(F.col("offset") == 0)).first()[0]
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts:
        n[length] = c
    bound = math.ceil(bound_of_counts(n, capacity) - 1e-9)
    return {"bins": bins, "bound": bound, "gap": bins - bound}
