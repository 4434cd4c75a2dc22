"""The analytic reports: functions from the three tables to one DataFrame.

``as_of`` stands for "now" and defaults to the current time. ``digits`` is the number of decimals
of the columns that the report rounds; None leaves them unrounded.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal.functions.dates import days_before, weekday_name
from newsignal.functions.labels import position_in, trend
from newsignal.functions.stats import ratio, rounded
from newsignal.model import News
from newsignal.operators.ordering import tile, with_global_rank
from newsignal.plans.facts import (
    average, average_confidence, per_company, rolled_up, summed, volatility, weighted_average,
    with_company,
)

AsOf = datetime | Column | None

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _since(news: News, as_of: AsOf, days: int) -> Column:
    return days_before(news.moment(as_of), days)


def _named(news: News, *names: str) -> DataFrame:
    return news.companies.filter(F.col("name").isin(*names))


def _day() -> Column:
    return F.to_date("published_at").alias("date")


def _label_counts() -> list[Column]:
    return [F.col(v).alias(f"{v}_count") for v in ("positive", "negative", "neutral")]


def weekly_company_report(
    news: News, company: str, days: int = 7, as_of: AsOf = None,
    digits: int | None = 4, method: str | None = None,
) -> DataFrame:
    """Per day: count, average, extremes, volatility, confidence, label counts and momentum."""
    chosen = _named(news, company)
    daily = with_company(summed(
        news, _since(news, as_of, days), "company_id", _day(), companies=chosen, method=method), chosen)
    return daily.select(
        "company_name", "sector", "symbol", "date",
        F.col("n").alias("article_count"),
        average().alias("avg_sentiment"),
        F.col("low").alias("min_sentiment"),
        F.col("high").alias("max_sentiment"),
        volatility().alias("sentiment_volatility"),
        average_confidence().alias("avg_confidence"),
        *_label_counts(),
        ratio(F.col("positive") - F.col("negative"), F.col("n"), digits).alias("sentiment_momentum"),
    ).orderBy(F.desc("date"))


def company_sentiment_report(news: News, company: str, days: int = 7, as_of: AsOf = None) -> DataFrame:
    """The weekly report without volatility and momentum."""
    return weekly_company_report(news, company, days, as_of).drop("sentiment_volatility", "sentiment_momentum")


def weekly_sentiment_report(news: News, company: str, as_of: AsOf = None) -> DataFrame:
    """Seven days of the company report, without the symbol."""
    return company_sentiment_report(news, company, 7, as_of).drop("symbol")


def sector_ranking(
    news: News, sector: str, days: int = 30, min_articles: int = 5,
    as_of: AsOf = None, digits: int | None = 4,
) -> DataFrame:
    """Companies of a sector by confidence-weighted sentiment, with rank and quartile."""
    companies = news.companies.filter(F.col("sector") == sector)
    stats = (
        per_company(news, _since(news, as_of, days), companies)
        .filter(F.col("n") >= min_articles)
        .select(
            "company_id", F.col("n").alias("total_articles"),
            average(digits).alias("avg_sentiment"),
            weighted_average(digits).alias("weighted_sentiment"),
            weighted_average().alias("weight"),
        )
    )
    ranked = with_global_rank(stats, "weight", "company_id")
    quartile = tile(F.col("position"), F.col("row_total"), 4)
    return (
        with_company(ranked, companies)
        .select(
            "company_name", "symbol", "total_articles", "avg_sentiment", "weighted_sentiment",
            F.col("rank").alias("sentiment_rank"),
            F.when(quartile == 1, "Top Quartile")
            .when(quartile == 2, "Second Quartile")
            .when(quartile == 3, "Third Quartile")
            .otherwise("Bottom Quartile").alias("performance_tier"),
        )
        .orderBy("sentiment_rank", "company_name")
    )


def sentiment_moving_average(
    news: News, company: str, days: int = 30, rows: int = 7, as_of: AsOf = None
) -> DataFrame:
    """Daily average with the mean of the last ``rows`` days that have news.

    The window has no partition: its input is one row per day of the look-back.
    """
    daily = summed(news, _since(news, as_of, days), _day(), companies=_named(news, company)).select(
        "date", average().alias("daily_sentiment"), F.col("n").alias("article_count")
    )
    recent = Window.orderBy("date").rowsBetween(1 - rows, Window.currentRow)
    return (
        daily.withColumn("sentiment_7day_ma", F.avg("daily_sentiment").over(recent))
        .withColumn(
            "trend_indicator",
            F.when(F.col("daily_sentiment") > F.col("sentiment_7day_ma"), "Above Average")
            .otherwise("Below Average"),
        )
        .orderBy("date")
    )


def cross_sector_comparison(
    news: News, days: int = 7, min_articles: int = 10, as_of: AsOf = None, digits: int | None = 4
) -> DataFrame:
    """Sectors against the market, each with its best company.

    One pass over the facts: company sums roll up to sectors, sector sums to the market. The
    market window sees one row per sector; companies missing from the table still count there.
    """
    by_company = with_company(
        per_company(news, _since(news, as_of, days)), news.companies, "left"
    ).withColumn("company_avg", average())
    best = F.min_by("company_name", F.struct(-F.col("company_avg"), F.col("company_name")))
    sectors = rolled_up(
        by_company, "sector",
        also=(
            F.count("company_name").alias("total_companies"),
            best.alias("best_company"),
            F.max("company_avg").alias("best_company_sentiment"),
        ),
    )
    whole = Window.partitionBy()
    market = ratio(F.sum("total").over(whole), F.sum("n_scores").over(whole))
    versus = average() - F.col("market_avg")
    return (
        sectors.withColumn("market_avg", market)
        .filter(F.col("sector").isNotNull() & (F.col("n") >= min_articles))
        .select(
            "sector", "total_companies", F.col("n").alias("total_articles"),
            average().alias("avg_sector_sentiment"),
            volatility().alias("sentiment_volatility"),
            rounded(versus, digits).alias("vs_market_sentiment"),
            "best_company", "best_company_sentiment",
        )
        .orderBy(F.desc("avg_sector_sentiment"), "sector")
    )


def source_reliability(
    news: News, days: int = 30, min_articles: int = 20, as_of: AsOf = None, digits: int | None = 4
) -> DataFrame:
    """Consistency 1/(1+σ) and label shares per source."""
    sources = summed(news, _since(news, as_of, days), "source")
    return (
        sources.filter(F.col("n") >= min_articles)
        .select(
            "source", F.col("n").alias("total_articles"),
            average().alias("avg_sentiment"),
            volatility().alias("sentiment_std_dev"),
            average_confidence().alias("avg_confidence"),
            (1 / (1 + volatility())).alias("consistency_score"),
            *(ratio(F.col(v), F.col("n"), digits).alias(f"{v}_ratio")
              for v in ("positive", "negative", "neutral")),
        )
        .orderBy(F.desc("consistency_score"), F.desc("avg_confidence"), "source")
    )


def pairwise_difference(
    news: News, first: str, second: str, days: int = 30, as_of: AsOf = None
) -> DataFrame:
    """Daily averages of two companies side by side, on days when both have news."""
    pair = _named(news, first, second)
    daily = with_company(
        summed(news, _since(news, as_of, days), "company_id", _day(), companies=pair), pair
    )

    def side(name: str) -> Column:
        return F.max(F.when(F.col("company_name") == name, average()))

    gap = F.abs(F.col("first_sentiment") - F.col("second_sentiment"))
    return (
        daily.groupBy("date")
        .agg(side(first).alias("first_sentiment"), side(second).alias("second_sentiment"))
        .filter(F.col("first_sentiment").isNotNull() & F.col("second_sentiment").isNotNull())
        .withColumn("sentiment_difference", gap)
        .withColumn("correlation_level", difference_level(F.col("sentiment_difference")))
        .orderBy(F.desc("date"))
    )


def difference_level(gap: Column) -> Column:
    return (
        F.when(gap < 0.1, "Highly Correlated")
        .when(gap < 0.3, "Moderately Correlated")
        .otherwise("Divergent")
    )


def market_momentum(news: News, days: int = 14, as_of: AsOf = None) -> DataFrame:
    """Day-on-day change of the market average; the first day has none and is left out.

    The window has no partition: its input is one row per day of the look-back.
    """
    daily = summed(news, _since(news, as_of, days), _day()).withColumn("avg_sentiment", average())
    before = F.lag("avg_sentiment").over(Window.orderBy("date"))
    return (
        daily.withColumn("prev_day_sentiment", before)
        .filter(F.col("prev_day_sentiment").isNotNull())
        .withColumn("sentiment_change", F.col("avg_sentiment") - F.col("prev_day_sentiment"))
        .select(
            "date", "avg_sentiment",
            (F.col("positive") - F.col("negative")).alias("sentiment_momentum"),
            "sentiment_change",
            momentum_level(F.col("sentiment_change")).alias("momentum_trend"),
            F.col("n").alias("total_articles"),
        )
        .orderBy(F.desc("date"))
    )


def momentum_level(change: Column) -> Column:
    return (
        F.when(change > 0.05, "Strong Positive Shift")
        .when(change > 0.02, "Positive Shift")
        .when(change < -0.05, "Strong Negative Shift")
        .when(change < -0.02, "Negative Shift")
        .otherwise("Stable")
    )


def sector_outperformance(
    news: News, days: int = 7, min_articles: int = 3, as_of: AsOf = None, digits: int | None = 4
) -> DataFrame:
    """Companies against the average of their sector.

    Both branches ask for the same company sums (count, scores, total), so they share one shuffle
    of them and the facts are read once. The sector side is one row per sector.
    """
    parts = per_company(news, _since(news, as_of, days))
    sectors = (
        rolled_up(with_company(parts, news.companies), "sector")
        .filter(F.col("n") > 0)
        .select("sector", average().alias("sector_avg_sentiment"))
    )
    lead = F.col("company_sentiment") - F.col("sector_avg_sentiment")
    return (
        with_company(parts.filter(F.col("n") >= min_articles), news.companies)
        .select("company_name", "sector", "symbol", average().alias("company_sentiment"),
                F.col("n").alias("article_count"))
        .join(sectors, "sector")
        .select(
            "company_name", "sector", "symbol", "company_sentiment", "article_count",
            "sector_avg_sentiment",
            rounded(lead, digits).alias("outperformance"),
            F.when(F.col("company_sentiment") > F.col("sector_avg_sentiment") + 0.1, "Strong Outperformer")
            .when(F.col("company_sentiment") > F.col("sector_avg_sentiment") + 0.05, "Outperformer")
            .when(F.col("company_sentiment") < F.col("sector_avg_sentiment") - 0.05, "Underperformer")
            .otherwise("In Line").alias("performance_category"),
        )
        .orderBy(F.desc("outperformance"), "company_name")
    )


def time_patterns(news: News, days: int = 30, min_articles: int = 5, as_of: AsOf = None) -> DataFrame:
    """Sentiment by weekday and hour, with the trading session of the hour."""
    cells = summed(
        news, _since(news, as_of, days), weekday_name(F.col("published_at")).alias("day_of_week"),
        F.hour("published_at").alias("hour_of_day"),
    )
    hour = F.col("hour_of_day")
    return (
        cells.filter(F.col("n") >= min_articles)
        .select(
            "day_of_week", "hour_of_day", F.col("n").alias("article_count"),
            average().alias("avg_sentiment"),
            F.when(hour.between(9, 16), "Market Hours")
            .when(hour.between(17, 20), "After Hours")
            .otherwise("Off Hours").alias("market_session"),
        )
        .orderBy(position_in(F.col("day_of_week"), WEEKDAYS), "hour_of_day")
    )


def portfolio_report(
    news: News, names: Sequence[str], days: int = 7, weight: float | None = None,
    as_of: AsOf = None, digits: int | None = 4,
) -> DataFrame:
    """Risk-adjusted sentiment of the named companies and of the portfolio as a whole."""
    weight = 1 / len(names) if weight is None else weight
    chosen = _named(news, *names)
    metrics = with_company(per_company(news, _since(news, as_of, days), chosen), chosen).select(
        "company_name", "sector", "symbol",
        F.col("n").alias("article_count"),
        average().alias("avg"), volatility().alias("sigma"), average_confidence().alias("conf"),
    ).withColumn("adjusted", F.col("avg") / (1 + F.col("sigma")))
    total = metrics.agg(
        F.lit("PORTFOLIO TOTAL").alias("company_name"), F.lit("Mixed").alias("sector"),
        F.lit("PORTFOLIO").alias("symbol"), F.sum("article_count").alias("article_count"),
        F.avg("avg").alias("avg"), F.avg("sigma").alias("sigma"), F.avg("conf").alias("conf"),
        F.avg("adjusted").alias("adjusted"),
        F.lit(1.0).alias("portfolio_weight"), F.sum(weight * F.col("avg")).alias("contribution"),
    )
    single = metrics.withColumns(
        {"portfolio_weight": F.lit(weight), "contribution": weight * F.col("avg")}
    )
    return (
        single.unionByName(total)
        .select(
            "company_name", "sector", "symbol", "article_count",
            rounded(F.col("avg"), digits).alias("avg_sentiment"),
            rounded(F.col("sigma"), digits).alias("volatility"),
            rounded(F.col("conf"), digits).alias("confidence"),
            rounded(F.col("adjusted"), digits).alias("risk_adjusted_sentiment"),
            "portfolio_weight",
            rounded(F.col("contribution"), digits).alias("portfolio_contribution"),
        )
        .orderBy(position_in(F.col("company_name"), ("PORTFOLIO TOTAL", *names)))
    )


def recent_company_sentiment(news: News, days: int = 7, as_of: AsOf = None) -> DataFrame:
    """Companies with news in the look-back; articles without a score are counted too."""
    parts = per_company(news, _since(news, as_of, days), how="left")
    return (
        with_company(parts, news.companies)
        .select(
            "company_name", "sector", "symbol", F.col("n").alias("article_count"),
            average().alias("avg_sentiment"),
            F.col("low").alias("min_sentiment"), F.col("high").alias("max_sentiment"),
            average_confidence().alias("avg_confidence"),
            *_label_counts(),
            F.col("latest").alias("latest_article_date"),
        )
        .orderBy(F.desc("avg_sentiment"), "company_name")
    )


def daily_sector_trends(news: News, days: int = 30, as_of: AsOf = None) -> DataFrame:
    """Per day and sector: count, average, label counts."""
    parts = summed(news, _since(news, as_of, days), "company_id", _day())
    return (
        rolled_up(with_company(parts, news.companies), "date", "sector")
        .select(
            "date", "sector", F.col("n").alias("total_articles"), average().alias("avg_sentiment"),
            *(F.col(v).alias(f"{v}_articles") for v in ("positive", "negative", "neutral")),
        )
        .orderBy(F.desc("date"), "sector")
    )


def sector_analysis(news: News, sector: str, days: int = 30, as_of: AsOf = None) -> DataFrame:
    """Companies of a sector with their trend."""
    companies = news.companies.filter(F.col("sector") == sector)
    parts = per_company(news, _since(news, as_of, days), companies)
    return (
        with_company(parts, companies)
        .select(
            "company_name", F.col("n").alias("article_count"), average().alias("avg_sentiment"),
            trend(average()).alias("sentiment_trend"),
            average_confidence().alias("avg_confidence"),
        )
        .orderBy(F.desc("avg_sentiment"), "company_name")
    )


def sector_summary(news: News, sector: str, days: int = 30, as_of: AsOf = None) -> DataFrame:
    """One row for a sector: totals, trend and its best company, from one pass over the facts."""
    companies = news.companies.filter(F.col("sector") == sector)
    by_company = with_company(
        per_company(news, _since(news, as_of, days), companies), companies
    ).withColumn("company_avg", average())
    return rolled_up(
        by_company, "sector",
        also=(
            F.min_by("company_name", F.struct(-F.col("company_avg"), F.col("company_name"))).alias("top_company"),
            F.max("company_avg").alias("top_company_sentiment"),
        ),
    ).select(
        "sector", F.col("n").alias("total_articles"), average().alias("avg_sentiment"),
        trend(average()).alias("sentiment_trend"), "top_company", "top_company_sentiment",
    )


def trending_companies(news: News, limit: int = 10, as_of: AsOf = None) -> DataFrame:
    """Companies with the most articles of the last day."""
    return (
        with_company(per_company(news, _since(news, as_of, 1)), news.companies)
        .select(F.col("company_name").alias("name"), "sector", F.col("n").alias("article_count"),
                average().alias("avg_sentiment"))
        .orderBy(F.desc("article_count"), F.desc("avg_sentiment"), "name")
        .limit(limit)
    )


def top_performers(news: News, days: int = 7, as_of: AsOf = None) -> DataFrame:
    """Companies by average sentiment."""
    return (
        with_company(per_company(news, _since(news, as_of, days)), news.companies)
        .select(F.col("company_name").alias("name"), "symbol", average().alias("avg_sentiment"))
        .orderBy(F.desc("avg_sentiment"), "name")
    )


def sector_overview(news: News) -> DataFrame:
    """Sectors by average sentiment over all time."""
    by_company = with_company(per_company(news, None), news.companies)
    return (
        rolled_up(by_company, "sector", also=(F.count(F.lit(1)).alias("companies"),))
        .select("sector", "companies", average().alias("avg_sentiment"))
        .orderBy(F.desc("avg_sentiment"), "sector")
    )
