"""The fact join and the partial aggregates every report starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsignal.functions.stats import population_stddev, ratio
from newsignal.model import News


def _from_date(df: DataFrame, since: Column) -> DataFrame:
    """Partition pruning: a filter on published_at alone does not prune published_date."""
    return df.filter(F.col("published_date") >= F.to_date(since)) if "published_date" in df.columns else df


def _to_date(df: DataFrame, until: Column) -> DataFrame:
    return df.filter(F.col("published_date") <= F.to_date(until)) if "published_date" in df.columns else df


def scored(
    news: News,
    since: Column | None,
    companies: DataFrame | None = None,
    method: str | None = None,
    how: str = "inner",
    until: Column | None = None,
) -> DataFrame:
    """Articles joined with their scores; one row per article and method.

    ``companies`` limits the articles before the large join, so only the wanted rows are
    shuffled; company attributes are joined after aggregation. The join key is the article id,
    which no company, source or day can skew. ``how="left"`` keeps articles without a score.
    """
    articles, scores = news.articles, news.scores
    if since is not None:
        articles = _from_date(articles.filter(F.col("published_at") >= since), since)
        scores = _from_date(scores, since)
    if until is not None:
        articles = _to_date(articles.filter(F.col("published_at") < until), until)
        scores = _to_date(scores, until)
    if method is not None:
        scores = scores.filter(F.col("processing_method") == method)
    articles = articles.select(F.col("id").alias("article_id"), "company_id", "source", "published_at")
    if companies is not None:
        wanted = companies.select(F.col("id").alias("company_id"))
        articles = articles.join(wanted, "company_id", "left_semi")
    scores = scores.select(
        "article_id",
        F.col("sentiment_score").alias("score"),
        "confidence",
        F.col("sentiment_label").alias("label"),
        F.col("processing_method").alias("method"),
    )
    return articles.join(scores, "article_id", how)


# Measures that can be summed (or min-ed, max-ed) again one level up.
_ADDITIVE = ("n", "n_scores", "total", "squares", "weighted_total", "confidence_total",
             "positive", "negative", "neutral")


def partials(facts: DataFrame, *keys: str | Column) -> DataFrame:
    """Sums and counts per key. Unused measures are pruned by the optimizer."""
    score = F.col("score")
    return facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("score").alias("n_scores"),
        F.sum("score").alias("total"),
        F.sum(score * score).alias("squares"),
        F.sum(score * F.col("confidence")).alias("weighted_total"),
        F.sum("confidence").alias("confidence_total"),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        *(F.count_if(F.col("label") == v).alias(v) for v in ("positive", "negative", "neutral")),
        F.max("published_at").alias("latest"),
    )


def rolled_up(parts: DataFrame, *keys: str | Column, also: tuple[Column, ...] = ()) -> DataFrame:
    """Partial aggregates brought to a coarser level."""
    return parts.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in _ADDITIVE),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("latest").alias("latest"),
        *also,
    )


def average(digits: int | None = None) -> Column:
    return ratio(F.col("total"), F.col("n_scores"), digits)


def weighted_average(digits: int | None = None) -> Column:
    return ratio(F.col("weighted_total"), F.col("n_scores"), digits)


def average_confidence(digits: int | None = None) -> Column:
    return ratio(F.col("confidence_total"), F.col("n_scores"), digits)


def volatility() -> Column:
    return population_stddev(F.col("n_scores"), F.col("total"), F.col("squares"))


def _hour(moment: Column, kind) -> Column:
    return F.date_trunc("hour", moment).cast(kind)


def hourly_sums(news: News) -> DataFrame:
    """Partial aggregates per company, source, method and hour; ``published_at`` is the start of the hour. Articles
    without a score have no method."""
    kind = news.articles.schema["published_at"].dataType
    hour = _hour(F.col("published_at"), kind).alias("hour")
    sums = partials(scored(news, None, how="left"), "company_id", "source", "method", hour)
    return sums.withColumnRenamed("hour", "published_at").withColumn("published_date", F.to_date("published_at"))


def _from_sums(news: News, since: Column | None, companies: DataFrame | None, method: str | None, how: str) -> DataFrame:
    """Kept sums of the whole hours from ``since`` on, and those of the hour that it cuts, from the facts."""
    sums = news.sums
    if how == "inner":
        sums = sums.filter(F.col("method").isNotNull())
    if method is not None:
        sums = sums.filter(F.col("method") == method)
    if companies is not None:
        sums = sums.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_semi")
    if since is None:
        return sums
    kind = news.articles.schema["published_at"].dataType
    begun = _hour(since, kind)
    whole = F.when(begun == since, begun).otherwise((begun + F.expr("INTERVAL 1 HOUR")).cast(kind))
    cut = partials(scored(news, since, companies, method, how, whole), "company_id", "source", _hour(F.col("published_at"), kind).alias("hour"))
    columns = ["company_id", "source", "published_at", *_ADDITIVE, "low", "high", "latest"]
    kept = _from_date(sums.filter(F.col("published_at") >= whole), since)
    return kept.select(*columns).unionByName(cut.withColumnRenamed("hour", "published_at").select(*columns))


def summed(
    news: News, since: Column | None, *keys: str | Column, companies: DataFrame | None = None,
    method: str | None = None, how: str = "inner",
) -> DataFrame:
    """Partial aggregates per key, from the kept sums if ``news`` has them, else from the facts. Keys are made of
    company, source and the hour of publication."""
    if news.sums is None or (how == "left" and method is not None):
        return partials(scored(news, since, companies, method, how), *keys)
    return rolled_up(_from_sums(news, since, companies, method, how), *keys)


def per_company(
    news: News, since: Column | None, companies: DataFrame | None = None,
    method: str | None = None, how: str = "inner",
) -> DataFrame:
    """Partial aggregates per company. Map-side sums keep a dominant company to a row per task."""
    return summed(news, since, "company_id", companies=companies, method=method, how=how)


def with_company(parts: DataFrame, companies: DataFrame, how: str = "inner") -> DataFrame:
    """Company attributes for aggregated rows; the size of ``companies`` decides the join."""
    attributes = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), "sector", "symbol"
    )
    return parts.join(attributes, "company_id", how)
