"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule w(t) over training time t in [0, 1], linear between a start and
an end value. Its integral gives the source's share of the token budget; water filling stops a
source at ``cap`` times its size and reshares the excess by weight. Inside a source, documents in a
fixed hashed order hold places in cumulative tokens; inverting the cumulative demand, D(t) =
(integral of w up to t) / (integral of w), turns those places into training positions, and the
mix is range-sorted by position.

Defined results: null text has size 0 and nothing is taken of it; a null source is a source of its
own, last in order; sources whose sizes are all 0 get target 0; repeated rows count each; an empty
table gives an empty result. No row is cut except, with whole=False, the one row per source where
the target is reached, of whose last copy only the words still wanted count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcastable, join_hot, saved, text_of

#: Weights by the rank of a source's name, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Start and end of a schedule as multiples of its mean; ranks take them in turn.
RAMPS = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
#: Rows of a source to one sorted bucket.
BUCKET_ROWS = 4_000


def word_count() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """rank of each source by code point, null last; by range partitions, so that no task sees all."""
    near = saved(sources.withColumn("last", F.col("source").isNull().cast("int")).repartitionByRange("last", "source").withColumn("pid", F.spark_partition_id()), "sources")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = near.groupBy("pid").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).select("pid", "start")
    inside = Window.partitionBy("pid").orderBy("last", "source")
    return near.join(starts, "pid").withColumn("rank", F.col("start") + F.row_number().over(inside) - 1).drop("pid", "start", "last")


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, ramps: tuple = RAMPS) -> DataFrame:
    """sources (source, source_size, rows) with w0, w1 (schedule) and target, by water filling.

    Each round one aggregate finds the level of the sources that are not full yet; it ends when no
    further source reaches its cap.
    """
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    mean = pick(weights)
    src = saved(ranked(sources).withColumn("w0", mean * pick([r[0] for r in ramps])).withColumn("w1", mean * pick([r[1] for r in ramps])).withColumn("w", (F.col("w0") + F.col("w1")) / 2).drop("rank"), "weights")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    want, level, full = share * total, 0.0, F.lit(False)
    at_cap = F.col("source_size") * cap
    while True:
        used, free = src.agg(F.sum(F.when(full, at_cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        new = (want - (used or 0.0)) / free if free else math.inf
        if new <= level:
            break
        level, full = new, at_cap <= F.col("w") * F.lit(new)
        if math.isinf(level):
            break
    aim = at_cap if math.isinf(level) else F.least(at_cap, F.col("w") * F.lit(level))
    return src.withColumn("target", aim.cast("double"))


def inverse_demand(u: Column, w0: Column, w1: Column) -> Column:
    """t with D(t) = u for the schedule that runs linearly from w0 to w1."""
    bend = w1 - w0
    curved = (-w0 + F.sqrt(w0 * w0 + bend * (w0 + w1) * u)) / F.when(bend == 0, F.lit(1.0)).otherwise(bend)
    return F.least(F.greatest(F.when(F.abs(bend) < 1e-12, u).otherwise(curved), F.lit(0.0)), F.lit(1.0))


def _after(buckets: DataFrame, step: int = 1_024) -> DataFrame:
    """buckets (src, bucket, words) with start, the words of the source's earlier buckets, by runs of step buckets."""
    runs = buckets.withColumn("run", F.floor(F.col("bucket") / step))
    before = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    heads = runs.groupBy("src", "run").agg(F.sum("words").alias("all")).withColumn("head", F.coalesce(F.sum("all").over(before), F.lit(0))).select("src", "run", "head")
    inside = Window.partitionBy("src", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return runs.join(heads, ["src", "run"]).select("src", "bucket", (F.col("head") + F.coalesce(F.sum("words").over(inside), F.lit(0))).alias("start"))


def plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, ramps: tuple = RAMPS, whole: bool = True, words: Column | None = None) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken, copies) of each row of docs; row is a struct of all its columns.

    words: the size of a row, by default the words of its text. copies: a (position, words) for each copy that the mix takes. A source is dealt into hashed
    buckets of about BUCKET_ROWS rows; prefix sums over buckets, then inside each, place its rows.
    As the columns of docs are kept in the struct, their names cannot clash with any used here.
    """
    words = word_count() if words is None else words
    # A source as a key that is never null: "=" and its name, or nothing.
    src = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), src.alias("src"), words.alias("size"), F.xxhash64(F.col("doc_id"), F.lit(17)).alias("key"))
    counts = docs.select(F.col("source").cast("string").alias("source"), words.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aims = targets(counts, share, cap, weights, ramps).withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int"))
    aims = saved(aims.select(src.alias("src"), "rows", "source_size", "target", "w0", "w1", "buckets"), "aims")
    dealt = sized.join(F.broadcast(aims.drop("rows")), "src") if broadcastable(aims.count()) else join_hot(sized, aims, "src", "rows")
    dealt = dealt.withColumn("bucket", F.pmod(F.shiftright("key", 20), F.col("buckets")))
    starts = saved(_after(dealt.groupBy("src", "bucket").agg(F.sum("size").alias("words"))), "buckets")
    placed = dealt.join(starts, ["src", "bucket"])
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    size, at, total = F.col("size"), F.col("at"), F.col("source_size")
    epochs = F.when(total > 0, F.floor(F.col("target") / total)).otherwise(0).cast("int")
    left = F.col("target") - epochs * total
    if whole:
        more = F.when((size > 0) & (at + size / 2 <= left), size).otherwise(0)
    else:
        more = F.least(F.greatest(F.round(left).cast("long") - at, F.lit(0)), size)
    out = placed.withColumn("epochs", epochs).withColumn("more", more.cast("long"))
    place = lambda copy: inverse_demand((F.col("source_size") * copy + at) / F.greatest(F.col("target"), F.lit(1.0)), F.col("w0"), F.col("w1"))
    share_of = lambda i: F.when(i < F.col("epochs"), size).when(i == F.col("epochs"), F.col("more")).otherwise(F.lit(0)).cast("long")
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(cap))), lambda i: F.struct(place(i).alias("position"), share_of(i).alias("words"))), lambda c: c["words"] > 0)
    return out.select("row", "doc_id", "size", "source_size", "target", (F.col("epochs") * size + F.col("more")).cast("long").alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training stream: one row of docs' columns per copy taken, range-sorted by position.

    Whole documents only: at the target the document on it is taken if its middle lies before it.
    """
    taken = plan(docs, whole=True, **options).select("row", "doc_id", F.explode("copies").alias("copy"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartitionByRange(n, F.col("copy.position"), F.col("doc_id")).sortWithinPartitions(F.col("copy.position"), "doc_id").select("row.*")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first position (null if not taken), by position."""
    slim = saved(docs.select("doc_id", "source", word_count().alias("words")), "sizes")
    out = plan(slim, whole=False, words=F.col("words"), **options)
    first = F.get(F.col("copies"), F.lit(0))["position"]
    out = out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", first.alias("position"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "position", "doc_id").sortWithinPartitions("position", "doc_id")
