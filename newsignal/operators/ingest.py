"""From raw feed articles to normalized, deduplicated articles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal.functions.dates import lookback_start, parse_iso
from newsignal.functions.text import strip
from newsignal.operators.linking import contained_keywords

COMPANY_CONTEXT = ("stock", "market", "business")
SECTOR_CONTEXT = ("stock", "market")
REQUIRED = ("title", "publishedAt", "url")


def company_terms(companies: DataFrame) -> DataFrame:
    """First word of each company name, lower-cased: the terms of the company searches."""
    first = F.get(F.split(strip(F.lower(F.col("name"))), r"\s+"), F.lit(0))
    return companies.select(first.alias("term")).filter(F.col("term") != "").distinct()


def sector_terms(companies: DataFrame) -> DataFrame:
    return companies.select(F.lower("sector").alias("term")).filter(F.col("term") != "").distinct()


def search(
    corpus: DataFrame, terms: DataFrame, any_of: Sequence[str] = COMPANY_CONTEXT, text: str = "text"
) -> DataFrame:
    """Rows of the corpus per search term: the text holds the term and one of ``any_of``."""
    lowered = F.lower(F.col(text))
    context = F.lit(False)
    for word in any_of:
        context = context | F.contains(lowered, F.lit(word.lower()))
    return contained_keywords(corpus.filter(context), lowered, terms, "term")


def in_language(corpus: DataFrame, language: str = "en", column: str = "language") -> DataFrame:
    return corpus.filter(F.col(column) == language)


def within_lookback(articles: DataFrame, hours: int, as_of: datetime | Column | None = None) -> DataFrame:
    """Articles of the look-back, which starts at midnight: feeds are asked by date."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of)
    kind = articles.schema["published_at"].dataType
    return articles.filter(F.col("published_at") >= lookback_start(now.cast(kind), hours).cast(kind))


def newest_per_term(
    articles: DataFrame, limit: int = 10, term: str = "term", tie: str = "url"
) -> DataFrame:
    """The newest ``limit`` rows of each term.

    The limit is applied per input partition before the shuffle (WindowGroupLimit), so a
    popular term sends at most ``limit`` rows per task.
    """
    newest = Window.partitionBy(term).orderBy(F.desc("published_at"), tie)
    return articles.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= limit).drop("_rn")


def corpus_feed(
    corpus: DataFrame, terms: DataFrame, any_of: Sequence[str], hours: int = 24, as_of: datetime | Column | None = None,
    language: str = "en", limit: int = 10, tie: str = "url",
) -> DataFrame:
    """One feed request for every term: the term and a context word, one language, the look-back, the newest few.

    ``corpus``: text, language, published_at and what else is wanted. The cheap filters come before the search, so dates and
    language reach the scan.
    """
    recent = within_lookback(in_language(corpus, language), hours, as_of)
    return newest_per_term(search(recent, terms, any_of), limit, tie=tie)


def with_required_fields(raw: DataFrame) -> DataFrame:
    """Articles with title, date and url. Blanks pass, as they are trimmed only later."""
    keep = F.lit(True)
    for name in REQUIRED:
        keep = keep & (F.coalesce(F.col(name), F.lit("")) != "")
    return raw.filter(keep)


def normalize(raw: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """Flat, trimmed articles. Missing texts become '', a missing source 'Unknown', a missing
    author NULL, an unreadable date ``as_of``."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    def blank_if_null(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit(""))).alias(name)

    known = ("title", "description", "content", "url", "source", "publishedAt", "author")
    return raw.select(
        blank_if_null("title"), blank_if_null("description"), blank_if_null("content"),
        blank_if_null("url"),
        F.coalesce(F.col("source.name"), F.lit("Unknown")).alias("source"),
        parse_iso(F.col("publishedAt"), now).alias("published_at"),
        F.when(F.col("author") != "", strip(F.col("author"))).alias("author"),
        *(c for c in raw.columns if c not in known),
    )


def dedupe_by_url(
    articles: DataFrame, seen: Sequence[str] = ("fetched_at", "company_search_term", "ordinal")
) -> DataFrame:
    """The first seen article per url; articles without url are dropped.

    ``row_number = 1`` is cut down per input partition before the shuffle, so a url that holds a
    third of all rows arrives as one row per task.
    """
    first = Window.partitionBy("url").orderBy(*seen)
    return (
        articles.filter(F.coalesce(F.col("url"), F.lit("")) != "")
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )


def union_feeds(company_articles: DataFrame, sector_articles: DataFrame) -> DataFrame:
    """Company articles without repeated urls, plus the sector articles as they are."""
    return dedupe_by_url(company_articles).unionByName(sector_articles)
