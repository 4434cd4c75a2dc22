"""SQL surface: views over the tables, table functions for the two procedures, ad-hoc queries."""

from __future__ import annotations

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from newsignal.model import News
from newsignal.plans import reports

_AVERAGE = "try_divide(cast(sum(s.sentiment_score) AS double), count(s.sentiment_score))"
_CONFIDENCE = "try_divide(cast(sum(s.confidence) AS double), count(s.confidence))"

# The day of the earliest moment; both facts are partitioned by day, so the scans of both are cut.
_FIRST_DAY = "to_date({name}.as_of - make_dt_interval({name}.days))"

_COMPANY_REPORT = f"""
CREATE OR REPLACE TEMPORARY FUNCTION company_sentiment_report(
    company STRING, days INT DEFAULT 7, as_of TIMESTAMP DEFAULT current_timestamp())
RETURNS TABLE (company_name STRING, sector STRING, symbol STRING, date DATE, article_count BIGINT,
    avg_sentiment DOUBLE, min_sentiment DECIMAL(5,4), max_sentiment DECIMAL(5,4), avg_confidence DOUBLE,
    positive_count BIGINT, negative_count BIGINT, neutral_count BIGINT)
RETURN SELECT c.name, c.sector, c.symbol, to_date(a.published_at), count(a.id), {_AVERAGE},
    min(s.sentiment_score), max(s.sentiment_score), {_CONFIDENCE},
    count_if(s.sentiment_label = 'positive'), count_if(s.sentiment_label = 'negative'),
    count_if(s.sentiment_label = 'neutral')
FROM companies c JOIN articles a ON c.id = a.company_id JOIN sentiment_scores s ON a.id = s.article_id
WHERE c.name = company_sentiment_report.company
  AND a.published_at >= cast(company_sentiment_report.as_of AS {{moment}})
      - make_dt_interval(company_sentiment_report.days)
  AND a.published_date >= {_FIRST_DAY.format(name="company_sentiment_report")}
  AND s.published_date >= {_FIRST_DAY.format(name="company_sentiment_report")}
GROUP BY c.name, c.sector, c.symbol, to_date(a.published_at)
ORDER BY to_date(a.published_at) DESC
"""

_SECTOR_ANALYSIS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION sector_sentiment_analysis(
    sector STRING, days INT DEFAULT 30, as_of TIMESTAMP DEFAULT current_timestamp())
RETURNS TABLE (company_name STRING, article_count BIGINT, avg_sentiment DOUBLE,
    sentiment_trend STRING, avg_confidence DOUBLE)
RETURN SELECT c.name, count(a.id), {_AVERAGE},
    CASE WHEN {_AVERAGE} > 0.1 THEN 'Positive' WHEN {_AVERAGE} < -0.1 THEN 'Negative' ELSE 'Neutral' END,
    {_CONFIDENCE}
FROM companies c JOIN articles a ON c.id = a.company_id JOIN sentiment_scores s ON a.id = s.article_id
WHERE c.sector = sector_sentiment_analysis.sector
  AND a.published_at >= cast(sector_sentiment_analysis.as_of AS {{moment}})
      - make_dt_interval(sector_sentiment_analysis.days)
  AND a.published_date >= {_FIRST_DAY.format(name="sector_sentiment_analysis")}
  AND s.published_date >= {_FIRST_DAY.format(name="sector_sentiment_analysis")}
GROUP BY c.id, c.name
HAVING count(a.id) >= 1
ORDER BY {_AVERAGE} DESC
"""


def register_tables(spark: SparkSession, news: News) -> SparkSession:
    """Temporary views ``companies``, ``articles``, ``sentiment_scores``."""
    news.companies.createOrReplaceTempView("companies")
    news.articles.createOrReplaceTempView("articles")
    news.scores.createOrReplaceTempView("sentiment_scores")
    return spark


def register(spark: SparkSession, news: News) -> SparkSession:
    """The tables, the two views and the two procedures (as SQL table functions)."""
    register_tables(spark, news)
    reports.recent_company_sentiment(news).createOrReplaceTempView("v_recent_company_sentiment")
    reports.daily_sector_trends(news).createOrReplaceTempView("v_daily_sentiment_trends")
    moment = news.articles.schema["published_at"].dataType.simpleString()
    for statement in (_COMPANY_REPORT, _SECTOR_ANALYSIS):
        spark.sql(statement.format(moment=moment))
    return spark


def adhoc(spark: SparkSession, news: News, query: str, params: dict | list | None = None) -> DataFrame:
    """A read-only query over the three tables with named (dict) or positional (list) parameters.

    The text must be a query as a whole: it is tried as a subquery, which no statement that changes something can
    be, and only planned at that. Then the text itself runs, so one that only fits a pair of parentheses fails.
    """
    register_tables(spark, news)
    try:
        spark.sql(f"EXPLAIN SELECT * FROM (\n{query}\n)", args=params)
    except ParseException as error:
        raise ValueError("ad-hoc queries are read-only; use the store operators to change tables") from error
    return spark.sql(query, args=params)
