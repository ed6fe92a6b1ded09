"""Article usage and usage-balanced assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def article_usage(assignments: DataFrame, idx: str = "idx") -> DataFrame:
    """(idx, uses), counted from the log of assignments; there is no counter to lose updates."""
    return assignments.where(F.col(idx).isNotNull()).groupBy(F.col(idx).alias("idx")).agg(F.count("*").alias("uses"))


def available(usage: DataFrame, first: int = 12, limit: int = 3) -> DataFrame:
    """(idx, uses) of articles used fewer than `limit` times; indices below `first` count as unused where they lack."""
    base = usage.sparkSession.range(first).select(F.col("id").alias("idx"))
    return usage.join(base, "idx", "full").select("idx", F.coalesce("uses", F.lit(0)).alias("uses")).where(F.col("uses") < limit)


def seeded(idx: Column, seed: int = 0) -> Column:
    """A shuffling key that is the same at each evaluation."""
    return F.md5(F.concat_ws("/", idx.cast("string"), F.lit(str(seed))))


def pick(usage: DataFrame, seed: int = 0, first: int = 12, limit: int = 3, number: int = 3) -> DataFrame:
    """Up to `number` available articles in seeded random order; none if all are used up."""
    return available(usage, first, limit).orderBy(seeded(F.col("idx"), seed), "idx").limit(number)


def assigned(picks: DataFrame, articles: DataFrame, place: str = "idx") -> DataFrame:
    """The articles at the picked places; places without an article drop out. `picks` are few and are broadcast."""
    return articles.join(F.broadcast(picks.select(place)), place)


def title_list(articles: Column) -> Column:
    """Articles as a submission lists them: their ids and titles."""
    return F.transform(articles, lambda a: F.struct(a["id"].alias("id"), a["title"].alias("title")))
