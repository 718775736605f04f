"""Forests: folders of stores, the names that lead to one, and what an input is.

A store is found at the root of a forest or one level below it. Its handle is its folder's name without
one ".rings" or ".trunk" and one ".log".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .operators import entries as E
from .operators.predicates import Predicates
from .operators.stamps import stamp_millis
from .sources import evlog
from .sources.records import is_record_stream, read_records
from .store import Store, fleet

#: Endings that name a store's parts, and the one of log files.
PARTS, LOG = (".rings", ".trunk"), ".log"


def handle(name: str) -> str:
    for end in PARTS:
        if name.endswith(end):
            name = name[: -len(end)]
            break
    return name.removesuffix(LOG)


def handle_column(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\.(rings|trunk)$", ""), r"\.log$", "")


def resolve_path(path: str) -> str:
    """The store that a path names: its folder, the folder's name with a part's ending, or a file of its manifests."""
    path = path.rstrip("/")
    at = path.find("/manifests")
    if at >= 0 and path[at + 10 : at + 11] in ("", "/"):
        path = path[:at]
    for end in PARTS:
        path = path.removesuffix(end)
    return path


def is_store(spark: SparkSession, path: str) -> bool:
    return any(n.endswith(".json") for n, folder, *_ in files.listing(spark, f"{resolve_path(path)}/manifests") if not folder)


def scan(spark: SparkSession, forest: str) -> list[tuple[str, str]]:
    """(handle, path) of the stores at the root of a forest and one level below; nothing where there is no such folder."""
    forest, out = forest.rstrip("/"), []
    for name, folder, *_ in files.listing(spark, forest):
        if not folder:
            continue
        path = f"{forest}/{name}"
        if is_store(spark, path):
            out.append((handle(name), path))
            continue
        out += [(handle(n), f"{path}/{n}") for n, f, *_ in files.listing(spark, path) if f and is_store(spark, f"{path}/{n}")]
    return sorted(out)


def unique_handles(stores: DataFrame) -> DataFrame:
    """The rows of (handle, ...) whose handle one row alone has."""
    single = stores.groupBy("handle").count().where("count = 1").select("handle")
    return stores.join(single, "handle", "left_semi")


def resolve(spark: SparkSession, token: str, forests: list[str]) -> str:
    """The store that a token names: a path as it is, a bare word by its handle in the forests."""
    if "/" in token or files.exists(spark, token):
        return resolve_path(token)
    found = [p for f in forests for h, p in scan(spark, f) if h == handle(token)]
    if len(found) != 1:
        raise LookupError(f"no store is called {token!r}" if not found else f"{token!r} names several stores: {', '.join(found)}")
    return found[0]


def kind(spark: SparkSession, path: str) -> str:
    """What an input is: a store, a record stream (it starts with the stream's mark), or text."""
    if is_store(spark, path):
        return "store"
    if not files.is_folder(spark, path) and is_record_stream(files.read_bytes(spark, path, 64)):
        return "records"
    return "text"


def search(spark: SparkSession, inputs: list[str], predicates: Predicates | None = None, start: int | None = None, end: int | None = None, max_n: int | None = None) -> DataFrame:
    """Entries of the inputs that match: (src, ts_ms, text).

    Stores are selected by window and terms, other inputs are read as they are; the two do not mix, and a
    window goes with stores only.
    """
    kinds = {p: kind(spark, p) for p in inputs}
    stores = [p for p in inputs if kinds[p] == "store"]
    if stores and len(stores) < len(inputs):
        raise ValueError("stores and other inputs do not mix; search them one after the other")
    if (start is not None or end is not None) and not stores:
        raise ValueError("a window selects on stores; these inputs are read as they are")
    if stores:
        opened = [Store(spark, resolve_path(p)) for p in inputs]
        names = F.create_map(*[F.lit(x) for k, p in enumerate(inputs) for x in (k, p)])
        found = fleet(opened, start=start, end=end, predicates=predicates, max_n=max_n)
        return found.select(F.element_at(names, F.col("src_idx")).alias("src"), "ts_ms", "text")
    parts = []
    for p in inputs:
        if kinds[p] == "records":
            rows = read_records(spark, p)
            parts.append(rows.select(F.coalesce("src", F.lit(p)).alias("src"), "ts_ms", F.decode("payload", "UTF-8").alias("text")))
        else:
            lines = evlog.text_lines(spark, p).select(F.col("source").alias("store_id"), F.col("pos").alias("line_no"), "line")
            grouped = E.group_entries(files.saved(lines.withColumn("ts_ms", stamp_millis(F.col("line"))), "lines"))
            parts.append(grouped.select(F.col("store_id").alias("src"), "ts_ms", "text"))
    out = reduce(DataFrame.unionByName, parts)
    if predicates is not None:
        out = out.where(predicates.entry(F.col("text")))
    return out.limit(max_n) if max_n is not None else out


def catalogue(spark: SparkSession, forests: list[str], followers: DataFrame | None = None) -> DataFrame:
    """A row per store of the forests, by forest and handle: what info() says of it, and how many follow it."""
    rows = []
    for f in forests:
        for h, p in scan(spark, f):
            i = Store(spark, p).info()
            rows.append((f.rstrip("/"), h, p, i["facts"]["id"], i["chunks"], i["entries"], i["bytes"], i["stored_bytes"], i["first_ms"], i["last_ms"], i["dropped_chunks"], i["dropped_bytes"]))
    # A row per store, read from its manifest and its small index.
    out = spark.createDataFrame(rows, "forest string, handle string, path string, store_id string, chunks long, entries long, bytes long, stored_bytes long, first_ms long, last_ms long, dropped_chunks long, dropped_bytes long")
    if followers is None:
        return out.orderBy("forest", "handle")
    return with_followers(out, followers).orderBy("forest", "handle")


def with_followers(stores: DataFrame, followers: DataFrame) -> DataFrame:
    """stores with followers and retaining, how many follow each and how many of them hold chunks back."""
    by = followers.groupBy("store_id").agg(F.count("*").alias("followers"), F.count_if("retaining").alias("retaining"))
    return stores.join(by, "store_id", "left")
