"""Urls seen once over the look-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKBACK = "7 days"


def distinct_urls(
    articles: DataFrame, time: str = "published_at", lookback: str = LOOKBACK, salts: int = 16
) -> DataFrame:
    """The first arrival per url within the look-back.

    Streaming deduplication sends all rows of a url to one task. So copies are first removed
    within ``salts`` shares of each url, and only what is left meets under the url itself: a url
    with a third of all rows is spread over ``salts`` tasks. ``time`` must be a TIMESTAMP.
    """
    # By input partition: copies that are equal in every column still fall into different shares.
    share = F.pmod(F.spark_partition_id(), F.lit(salts))
    return (
        articles.filter(F.coalesce("url", F.lit("")) != "")
        .withColumn("_share", share)
        .withWatermark(time, lookback)
        .dropDuplicatesWithinWatermark(["url", "_share"])
        .dropDuplicatesWithinWatermark(["url"])
        .drop("_share")
    )
