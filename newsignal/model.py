"""The three-table model: schemas, the tracked companies and the handle the reports take."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_TYPE = T.DecimalType(5, 4)
LABELS = ("positive", "negative", "neutral")

# Ids are 128-bit digests of the natural key (see stable_id), hence strings.
COMPANIES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("sector", T.StringType(), False),
    T.StructField("symbol", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("market_cap", T.LongType()),
    T.StructField("employees", T.IntegerType()),
    T.StructField("founded_year", T.ShortType()),
    T.StructField("headquarters", T.StringType()),
    T.StructField("website", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

# published_date is the partition column of both fact tables. Scores repeat the date of their
# article, so a look-back prunes the two sides of the join alike.
ARTICLES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("author", T.StringType()),
    T.StructField("published_at", T.TimestampType(), False),
    T.StructField("company_id", T.StringType(), False),
    T.StructField("language", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("reading_time_minutes", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("published_date", T.DateType()),
])

SCORES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("article_id", T.StringType(), False),
    T.StructField("sentiment_score", SCORE_TYPE, False),
    T.StructField("confidence", SCORE_TYPE, False),
    T.StructField("sentiment_label", T.StringType(), False),
    T.StructField("processing_method", T.StringType(), False),
    T.StructField("processing_version", T.StringType()),
    T.StructField("subjectivity", SCORE_TYPE),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("processing_time_ms", T.IntegerType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("published_date", T.DateType()),
])

RAW_ARTICLE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("publishedAt", T.StringType()),
    T.StructField("author", T.StringType()),
])

# What one API call returned, plus what the landing job knows about the call.
ENVELOPE = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("totalResults", T.LongType()),
    T.StructField("company", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("articles", T.ArrayType(RAW_ARTICLE)),
    T.StructField("_corrupt_record", T.StringType()),
])

# The tracked companies, in the order that decides ambiguous links.
TRACKED_COMPANIES = [
    ("Apple Inc.", "Technology", "AAPL"),
    ("Microsoft Corporation", "Technology", "MSFT"),
    ("Amazon.com Inc.", "Technology", "AMZN"),
    ("Tesla Inc.", "Automotive", "TSLA"),
    ("Alphabet Inc.", "Technology", "GOOGL"),
    ("Meta Platforms Inc.", "Technology", "META"),
    ("NVIDIA Corporation", "Technology", "NVDA"),
    ("JPMorgan Chase & Co.", "Financial Services", "JPM"),
    ("Johnson & Johnson", "Healthcare", "JNJ"),
    ("Berkshire Hathaway", "Financial Services", "BRK.A"),
]

# Descriptive columns of the same companies
# (description, market cap, employees, founded, headquarters).
COMPANY_PROFILES = {
    "AAPL": ("Consumer electronics, software, and services", 3000000000000, 154000, 1976, "Cupertino, CA"),
    "MSFT": ("Software, cloud computing, and productivity services", 2800000000000, 221000, 1975, "Redmond, WA"),
    "AMZN": ("E-commerce, cloud computing, and digital services", 1500000000000, 1540000, 1994, "Seattle, WA"),
    "TSLA": ("Electric vehicles and clean energy solutions", 800000000000, 140473, 2003, "Austin, TX"),
    "GOOGL": ("Internet services, advertising, and cloud computing", 1700000000000, 190000, 1998, "Mountain View, CA"),
    "META": ("Social media and virtual reality platforms", 750000000000, 86482, 2004, "Menlo Park, CA"),
    "NVDA": ("Graphics processing and artificial intelligence", 1200000000000, 29600, 1993, "Santa Clara, CA"),
    "JPM": ("Investment banking and financial services", 500000000000, 288474, 1799, "New York, NY"),
    "JNJ": ("Pharmaceuticals, medical devices, and consumer products", 450000000000, 152700, 1886, "New Brunswick, NJ"),
    "BRK.A": ("Diversified holding company", 750000000000, 383000, 1839, "Omaha, NE"),
}


def stable_id(*parts: Column) -> Column:
    """Id of a row from its natural key: the same on every run, without a counter.

    128 bits, because 64 would already collide at some ten billion urls.
    """
    return F.md5(F.concat_ws("\u001f", *parts))


def tracked_companies(spark: SparkSession) -> DataFrame:
    """The seed list as a DataFrame: id, ordinal, name, sector, symbol and profile columns."""
    rows = [
        (i, name, sector, symbol, *COMPANY_PROFILES[symbol])
        for i, (name, sector, symbol) in enumerate(TRACKED_COMPANIES)
    ]
    schema = (
        "ordinal int, name string, sector string, symbol string, description string, "
        "market_cap bigint, employees int, founded_year smallint, headquarters string"
    )
    return spark.createDataFrame(rows, schema).withColumn("id", stable_id(F.col("name")))


@dataclass(frozen=True)
class News:
    """The three tables a report reads, and sums of the facts by hour if they are kept."""

    companies: DataFrame
    articles: DataFrame
    scores: DataFrame
    sums: DataFrame | None = None

    def moment(self, as_of: datetime | Column | None) -> Column:
        """``as_of`` in the type of ``published_at``, so that the filter reaches the scan uncast."""
        kind = self.articles.schema["published_at"].dataType
        at = F.current_timestamp() if as_of is None else F.lit(as_of)
        return at.cast(kind)

    def collated(self, collation: str = "UNICODE_CI_AI_RTRIM") -> News:
        """Names, sectors, urls and sources compared without case, accents and trailing blanks."""
        def with_collation(df: DataFrame, *cols: str) -> DataFrame:
            return df.withColumns({c: F.collate(c, collation) for c in cols if c in df.columns})

        return replace(
            self,
            companies=with_collation(self.companies, "name", "sector", "symbol"),
            articles=with_collation(self.articles, "url", "source"),
            sums=None if self.sums is None else with_collation(self.sums, "source"),
        )
