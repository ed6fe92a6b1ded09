"""Joins that keep a hot key out of a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so there are at most 1 / HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 0.001


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str = "n", share: float = HOT_SHARE) -> DataFrame:
    """Inner join of `left` with `right`, which has one row for each key and the key's number of left rows in `count`.

    Rows of hot keys meet a broadcast of at most 1/share right rows (the bound follows from the counts,
    not from a guess), all others a shuffled join in which no key has more than `share` of the rows.
    Null keys match nothing. Empty sides give an empty result.
    """
    total = right.agg(F.coalesce(F.sum(count), F.lit(0)).cast("double").alias("total"))
    marked = right.withColumn("_hot", F.col(count) > total.scalar() * F.lit(share))
    hot = F.broadcast(marked.where("_hot").drop("_hot"))
    cold = marked.where("not _hot").drop("_hot")
    return left.join(hot, keys).unionByName(left.join(F.broadcast(marked.where("_hot").select(*keys)), keys, "left_anti").join(cold, keys))
