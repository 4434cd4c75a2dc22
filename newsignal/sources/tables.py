"""The three tables from where they are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsignal.model import News

TABLES = ("companies", "articles", "sentiment_scores")


def from_parquet(spark: SparkSession, root: str) -> News:
    return News(*(spark.read.parquet(f"{root}/{t}") for t in TABLES))


def from_jdbc(spark: SparkSession, url: str, **options: str) -> News:
    """Straight from a MySQL database; filters and columns of a report are pushed down to it.

    ``options`` are Spark's JDBC options (user, password, driver, fetchsize). To read the facts
    with more than one task give partitionColumn, lowerBound, upperBound and numPartitions; they
    apply to ``articles.id`` and ``sentiment_scores.id`` (both called ``id``).
    """
    split = {"partitionColumn", "lowerBound", "upperBound", "numPartitions"}

    def read(table: str):
        chosen = {k: v for k, v in options.items() if table != "companies" or k not in split}
        return spark.read.format("jdbc").options(url=url, dbtable=table, **chosen).load()

    return News(*map(read, TABLES))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out to all of them.

    For small tables of one file whose texts are costly to process; a scan that has enough splits
    is returned as it is, so a large table is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
