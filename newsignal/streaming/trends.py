"""Daily sector trend over a stream of scored articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsignal.plans.facts import average, partials

DELAY = "1 day"
EVERY = "15 minutes"

CLOSED = ("date date, sector string, total_articles bigint, avg_sentiment double, positive_articles bigint, "
          "negative_articles bigint, neutral_articles bigint")
LATE = "published_at timestamp, sector string, score decimal(5,4), confidence decimal(5,4), label string"
_TAGGED = f"{CLOSED}, published_at timestamp, score decimal(5,4), confidence decimal(5,4), label string, batch bigint, kind string"
#: Old state rows are judged by the watermark of the batch itself, so that late rows can be told apart by the same moment.
_ONE_WATERMARK = "spark.sql.streaming.statefulOperator.allowMultiple"


def daily_trends(scored: DataFrame, delay: str = DELAY) -> DataFrame:
    """Per day and sector: count, average, label counts, as tumbling windows.

    ``scored``: published_at (TIMESTAMP), sector, score, confidence, label. Sums are formed per
    task before the shuffle, so a sector may hold most of the rows.
    """
    windows = partials(
        scored.withWatermark("published_at", delay), F.window("published_at", "1 day").alias("day"), "sector"
    )
    return windows.select(
        F.to_date("day.start").alias("date"), "sector", F.col("n").alias("total_articles"),
        average().alias("avg_sentiment"),
        *(F.col(v).alias(f"{v}_articles") for v in ("positive", "negative", "neutral")),
    )


def _started(writer, every: str | None) -> StreamingQuery:
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def write_trends(trends: DataFrame, path: str, checkpoint: str, every: str | None = EVERY) -> StreamingQuery:
    """Keeps the whole trend table under ``path`` current (complete mode): days still open are in it.

    The table has one row per day and sector, and so has the state, for ever. A replayed batch writes the same table again.
    ``write_closed_trends`` keeps open days only.
    """
    def each(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return _started(
        trends.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint), every)


def write_closed_trends(
    scored: DataFrame, path: str, checkpoint: str, delay: str = DELAY, every: str | None = EVERY,
) -> StreamingQuery:
    """Appends each day's trend once, when it closes, and keeps rows that come later in a table of their own.

    A day closes when a row is ``delay`` past its end. The state holds the open days only, however long the stream runs.
    A row is late if its day closed before its batch; it is not in the trend of that day but among ``late_rows``. Rows without a time
    are in neither. Each batch writes one folder named by its number, so a replayed batch replaces its own rows.
    """
    spark = scored.sparkSession
    closed = daily_trends(scored, delay).withColumn("kind", F.lit("closed"))
    rows = scored.select(
        "published_at", "sector", *(F.col(c).cast("decimal(5,4)").alias(c) for c in ("score", "confidence")), "label",
        F.lit("late").alias("kind"))

    def each(batch: DataFrame, number: int) -> None:
        marks = spark.read.schema("latest timestamp, batch bigint").parquet(f"{path}/marks") if number else None
        mark = marks.filter(F.col("batch") < number).agg(F.max("latest")).first()[0] if number else None
        day = 86_400  # the windows are days of UTC
        day_end = F.timestamp_seconds((F.floor(F.unix_seconds("published_at") / day) + 1) * day)
        passed = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        seen = Observation()
        kept = (
            batch.observe(seen, F.max("published_at").alias("latest"))
            .filter((F.col("kind") == "closed") | F.coalesce(day_end <= passed, F.lit(False)))
        )
        kept.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/trends/batch={number}")
        latest = spark.createDataFrame([(seen.get["latest"],)], "latest timestamp")
        latest.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    both = closed.unionByName(rows, allowMissingColumns=True)
    before = spark.conf.get(_ONE_WATERMARK)
    spark.conf.set(_ONE_WATERMARK, "false")
    try:  # the query takes the setting along when it starts
        return _started(
            both.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint), every)
    finally:
        spark.conf.set(_ONE_WATERMARK, before)


def _written(spark: SparkSession, path: str, kind: str, columns: str) -> DataFrame:
    names = [part.split()[0] for part in columns.split(", ")]
    return spark.read.schema(_TAGGED).parquet(f"{path}/trends").filter(F.col("kind") == kind).select(*names)


def closed_trends(spark: SparkSession, path: str) -> DataFrame:
    """The trends of all days closed so far."""
    return _written(spark, path, "closed", CLOSED)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came after their day had closed."""
    return _written(spark, path, "late", LATE)
