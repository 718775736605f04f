"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

The terms of a text are its lower-cased words, weighted by how often they occur. For each of
``SAMPLES`` draws and each term, r and c are Gamma(2, 1) variates and b is uniform, all taken from
hashes of (term, draw); with t = floor(ln w / r + b) the term has the value
ln a = ln c - r (t - b + 1), and the term of the least value, with its t, is the sample. Two texts draw
the same sample with a probability of their generalised Jaccard similarity, sum min(w) / sum max(w).

A text and its edited form share most terms, so both are drawn in one pass. Neighbours in order of
doc_id are found without a global sort: rows are dealt into ranges of doc_id, and the first document of
each range is also sent to the range before it, as a sentinel.

Defined results: null text is empty; a text without words has the empty fingerprint, of likeness 1 to
another empty one and 0 to all others; rows with one doc_id follow each other by a hash of their text;
a null doc_id comes before all others; one row alone is its own next; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, text_of

SAMPLES = 64
#: Ranges of doc_id: about so many rows each, at most so many ranges.
RANGE_ROWS, MAX_RANGES = 2_000, 100_000
_LEAST = -(1 << 63)


def samples(term: Column, weight_log: Column, draws: int = SAMPLES) -> list[Column]:
    """The draws of a weighted term as longs: value in the high half, sample id in the low; the least wins."""
    low = lambda h, n: h.bitwiseAND(F.lit((1 << n) - 1))
    out = []
    for k in range(draws):
        h = F.xxhash64(term, F.lit(k))
        g = F.xxhash64(h)
        # Gamma(2, 1) is the sum of two exponential variates.
        r = -F.ln((low(h, 32) + F.lit(0.5)) * (F.shiftrightunsigned(h, 32) + F.lit(0.5)) * F.lit(2.0**-64))
        c = F.ln(-F.ln((low(g, 22) + F.lit(0.5)) * (F.shiftrightunsigned(g, 42) + F.lit(0.5)) * F.lit(2.0**-44)))
        b = low(F.shiftrightunsigned(g, 22), 20) * F.lit(2.0**-20)
        t = F.floor(weight_log / r + b)
        value = F.floor((c - r * (t - b + 1) + 64) * F.lit(float(1 << 24)))
        sample = low(term.bitwiseXOR(t * F.lit(0x9E3779B1)), 32)
        out.append(F.shiftleft(value, 32).bitwiseOR(sample))
    return out


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key: a coarse look first, then inside one step."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = below(every(bounds[::step]))
    inside = F.slice(every(bounds), (coarse - 1) * step + 1, F.lit(step))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + below(inside))


def with_next(docs: DataFrame) -> DataFrame:
    """(range, place, sentinel, doc_id, text, next): each text with the text that follows in order of doc_id.

    Sentinels (the first document of the next range) close each range.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(_LEAST))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    m = min(MAX_RANGES, parts(ids.count(), RANGE_ROWS))
    cuts = ids.approxQuantile("doc_id", [k / m for k in range(1, m)], 0.2 / m) if m > 1 else []
    bounds = sorted({int(x) for x in cuts})
    dealt = _range_of(key, bounds)
    firsts = sorted(ids.groupBy(dealt.alias("range")).agg(F.min(key).alias("first")).collect())
    before = [(r[1], firsts[k - 1][0]) for k, r in enumerate(firsts)]
    # One row per range, at most MAX_RANGES: a proven bound for the broadcast.
    heads = spark.createDataFrame(before, "first long, before int")
    both = rows.withColumn("range", dealt).join(F.broadcast(heads), key == heads["first"], "left")
    own, ahead = F.struct(F.col("range").cast("int").alias("range"), F.lit(0).alias("sentinel")), F.struct(F.col("before").alias("range"), F.lit(1).alias("sentinel"))
    both = both.select("doc_id", "text", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead))).alias("at")).select("doc_id", "text", "at.range", "at.sentinel")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("range").orderBy("sentinel", F.coalesce("doc_id", F.lit(_LEAST)), F.xxhash64("text"))
    return both.repartition(n, "range").withColumn("place", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))


def _likeness(a: str, b: str) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.col(a).isNull() | F.col(b).isNull(), (F.col(a).isNull() & F.col(b).isNull()).cast("double")).otherwise(same / F.lit(float(SAMPLES)))


def _text(a: str) -> Column:
    return F.coalesce(F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit(""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter replaced by as much of the start of the next.
    """
    placed = with_next(docs).withColumn("n", F.length("text"))
    quarter = F.floor(F.col("n") / 4).cast("int")
    placed = placed.withColumn("stem", F.substring("text", F.lit(1), F.col("n") - quarter)).withColumn("edited", F.concat("stem", F.substring("next", F.lit(1), quarter)))
    info = placed.where("sentinel = 0").select("range", "place", "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    # Whole words of the unchanged part count in both forms; a row of no weight keeps texts without words.
    shared = F.regexp_extract("stem", r"(?s)^(.*[\x20\x09-\x0D])", 1)
    cut = placed.withColumn("shared", shared).withColumn("from", F.length("shared") + 1)
    part = lambda text, w, e: F.struct(text.alias("text"), F.lit(w).alias("w"), F.lit(e).alias("e"))
    rest = lambda name: F.substring(name, F.col("from"), F.length(name))
    forms = cut.select("range", "place", F.explode(F.array(part(F.col("shared"), 1, 1), part(rest("text"), 1, 0), part(rest("edited"), 0, 1), part(F.lit(""), 0, 0))).alias("p"))
    words = forms.select("range", "place", F.col("p.w").alias("w"), F.col("p.e").alias("e"), F.explode(F.split(F.lower("p.text"), r"[\x20\x09-\x0D]+")).alias("word"))
    words = words.where("word != '' or (w = 0 and e = 0)")
    terms = words.groupBy("range", "place", F.xxhash64("word").alias("term")).agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    # A term of the same weight in both forms is drawn once, for both; a row of no weight has null draws.
    use = lambda weight, own, edited: F.struct(weight.alias("weight"), F.lit(own).alias("own"), F.lit(edited).alias("edited"))
    uses = F.when(F.col("w") == F.col("e"), F.array(use(F.col("w"), True, True))).when(F.col("e") == 0, F.array(use(F.col("w"), True, False))).when(F.col("w") == 0, F.array(use(F.col("e"), False, True)))
    uses = uses.otherwise(F.array(use(F.col("w"), True, False), use(F.col("e"), False, True)))
    drawn = terms.select("range", "place", "term", F.explode(uses).alias("u")).select("range", "place", "term", "u.own", "u.edited", F.ln(F.when(F.col("u.weight") > 0, F.col("u.weight"))).alias("log"))
    least = drawn.groupBy("range", "place", "own", "edited").agg(*[F.min(x).alias(f"d{k}") for k, x in enumerate(samples(F.col("term"), F.col("log")))])
    draws = F.array(*[F.col(f"d{k}") for k in range(SAMPLES)])
    forms_of = least.select("range", "place", "own", "edited", F.when(F.col("d0").isNotNull(), draws).alias("d"))
    part_of = lambda own, edited: F.max(F.when((F.col("own") == own) & (F.col("edited") == edited), F.col("d")))
    joint = forms_of.groupBy("range", "place").agg(part_of(True, True).alias("both"), part_of(True, False).alias("only"), part_of(False, True).alias("new"))
    merged = lambda x: F.coalesce(F.zip_with("both", x, lambda p, q: F.least(p, q)), F.col("both"), F.col(x))
    ids = lambda x: F.transform(x, lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = joint.select("range", "place", ids(merged("only")).alias("own"), ids(merged("new")).alias("edited"))
    near = signed.withColumn("following", F.lead("own").over(Window.partitionBy("range").orderBy("place")))
    near = near.select("range", "place", _text("own").alias("fingerprint"), _text("edited").alias("edited_fingerprint"), _likeness("own", "edited").alias("near_edited"), _likeness("own", "following").alias("near_next"))
    return info.join(near, ["range", "place"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
