"""Joins that a hot key does not hold up."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of the rows of a join, the share above which a key is hot: there are at most its inverse of such keys.
HOT_SHARE = 1e-5


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], rows: str) -> DataFrame:
    """left joined (left outer) with right, which has one row per key and, in rows, how many left has of it.

    Keys that hold more than HOT_SHARE of left, 1 / HOT_SHARE of them at most, are joined by broadcast where
    their rows lie; the rest meet in a shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    total = right.agg(F.sum(rows)).first()[0] or 0
    bound = max(1_000, math.floor(total * HOT_SHARE))
    cols = [c for c in right.columns if c not in (*keys, rows)]
    hot = right.where(F.col(rows) > bound).select(*keys, F.lit(True).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in cols])
    marked = left.join(F.broadcast(hot), keys, "left")
    near = marked.where("__hot").select(*left.columns, *[F.col(f"__{c}").alias(c) for c in cols])
    far = marked.where("__hot is null").select(*left.columns).join(right.where(F.col(rows) <= bound).drop(rows), keys, "left").select(*left.columns, *cols)
    return near.unionByName(far)
