"""The given tables seen as the news model.

Everything irregular comes from the data itself: exact copies of a document share a url, lines
that a document lacks are missing fields, the event type decides the form of the date.
"""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.functions.labels import label_beyond
from newsignal.model import SCORE_TYPE, News
from newsignal.sources.tables import spread

AS_OF = datetime(2024, 1, 31)
COMPANIES = [f"Customer#{i:09d}" for i in range(4)]
SECTOR = "BUILDING"
# A score is kept from this confidence (in percent) on; articles below it stay unscored.
LEAST_CONFIDENCE = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"),
    )


def news_url(key: Column) -> Column:
    return F.concat(F.lit("https://news.example/"), key.cast("string"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("company_id"),
        F.col("ts").alias("published_at"),
        F.to_date("ts").alias("published_date"),
        F.col("event_type").alias("source"),
        news_url(F.col("event_id")).alias("url"),
    )


def confidence_percent() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def scored_events(events: DataFrame) -> DataFrame:
    """A score for every event, the weak ones included."""
    score = F.greatest(F.least((F.col("value") - 50) / 100, F.lit(1.0)), F.lit(-1.0)).cast(SCORE_TYPE)
    hundredths = confidence_percent().cast("decimal(3,0)") * F.lit(Decimal("0.01"))
    return events.select(
        F.col("event_id").alias("article_id"), score.alias("sentiment_score"),
        hundredths.cast(SCORE_TYPE).alias("confidence"), "ts", "user_id",
    ).select(
        "article_id", "sentiment_score", "confidence",
        label_beyond(F.col("sentiment_score"), 0.1).alias("sentiment_label"),
        F.lit("combined").alias("processing_method"),
        F.to_date("ts").alias("published_date"),
        "ts", "user_id",
    )


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_events(spread(table(spark, sf_dir, "events"))).drop("ts", "user_id")


def strong_enough() -> Column:
    return F.col("confidence") >= LEAST_CONFIDENCE / 100


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_scores(spark, sf_dir).filter(strong_enough())


def news(spark: SparkSession, sf_dir: str) -> News:
    return News(companies(spark, sf_dir), articles(spark, sf_dir), scores(spark, sf_dir))


def plain(df: DataFrame, six: tuple[str, ...] = ()) -> DataFrame:
    """Result in types that two engines print alike: decimals as doubles, integers as bigint,
    dates and times as text. The columns in ``six`` are rounded to six decimals."""
    def column(field) -> Column:
        c, kind = F.col(field.name), field.dataType.typeName()
        if field.name in six:
            c = F.round(c.cast("double"), 6)
        elif kind == "decimal":
            c = c.cast("double")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return c.alias(field.name)

    return df.select(*(column(f) for f in df.schema.fields))
