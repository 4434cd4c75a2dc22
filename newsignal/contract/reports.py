"""Report queries and their SQL."""

from __future__ import annotations

from newsignal.contract.adapter import AS_OF, COMPANIES, SECTOR, news, plain
from newsignal.plans import procedures, reports

A, B = COMPANIES[0], COMPANIES[1]
NAMES = ", ".join(f"'{c}'" for c in COMPANIES)

QUERIES = {
    "weekly_company_report": lambda s, d: plain(
        reports.weekly_company_report(news(s, d), A, as_of=AS_OF, digits=None), ("sentiment_volatility",)),
    "sector_ranking": lambda s, d: plain(
        reports.sector_ranking(news(s, d), SECTOR, as_of=AS_OF, digits=None)),
    "sentiment_moving_average": lambda s, d: plain(
        reports.sentiment_moving_average(news(s, d), B, as_of=AS_OF), ("sentiment_7day_ma",)),
    "cross_sector_comparison": lambda s, d: plain(
        reports.cross_sector_comparison(news(s, d), as_of=AS_OF, digits=None), ("sentiment_volatility",)),
    "source_reliability": lambda s, d: plain(
        reports.source_reliability(news(s, d), as_of=AS_OF, digits=None),
        ("sentiment_std_dev", "consistency_score")),
    "pairwise_difference": lambda s, d: plain(
        reports.pairwise_difference(news(s, d), A, B, as_of=AS_OF)),
    "market_momentum": lambda s, d: plain(reports.market_momentum(news(s, d), as_of=AS_OF)),
    "sector_outperformance": lambda s, d: plain(
        reports.sector_outperformance(news(s, d), as_of=AS_OF, digits=None)),
    "time_patterns": lambda s, d: plain(reports.time_patterns(news(s, d), as_of=AS_OF)),
    "portfolio_report": lambda s, d: plain(
        reports.portfolio_report(news(s, d), COMPANIES, as_of=AS_OF, digits=None),
        ("avg_sentiment", "volatility", "confidence", "risk_adjusted_sentiment", "portfolio_contribution")),
    "recent_company_sentiment": lambda s, d: plain(
        reports.recent_company_sentiment(news(s, d), as_of=AS_OF)),
    "daily_sector_trends": lambda s, d: plain(reports.daily_sector_trends(news(s, d), as_of=AS_OF)),
    "company_report_fn": lambda s, d: plain(
        procedures.register(s, news(s, d)).sql(
            "SELECT * FROM company_sentiment_report(:name, as_of => :at)",
            args={"name": A, "at": AS_OF})),
    "sector_analysis_fn": lambda s, d: plain(
        procedures.register(s, news(s, d)).sql(
            "SELECT * FROM sector_sentiment_analysis(:sector, as_of => :at)",
            args={"sector": SECTOR, "at": AS_OF})),
    "weekly_report_method": lambda s, d: plain(
        reports.weekly_sentiment_report(news(s, d), A, as_of=AS_OF)),
    "sector_analysis": lambda s, d: plain(reports.sector_analysis(news(s, d), SECTOR, as_of=AS_OF)),
    "sector_summary": lambda s, d: plain(reports.sector_summary(news(s, d), SECTOR, as_of=AS_OF)),
    "trending_companies": lambda s, d: plain(reports.trending_companies(news(s, d), as_of=AS_OF)),
    "top_performers": lambda s, d: plain(reports.top_performers(news(s, d), as_of=AS_OF)),
    "sector_overview": lambda s, d: plain(reports.sector_overview(news(s, d))),
    "adhoc_sql": lambda s, d: plain(procedures.adhoc(
        s, news(s, d),
        """SELECT c.sector, count(*) AS articles, min(s.sentiment_score) AS lowest
           FROM companies c JOIN articles a ON c.id = a.company_id
           JOIN sentiment_scores s ON a.id = s.article_id
           WHERE s.sentiment_score >= :least GROUP BY c.sector""",
        {"least": 0.25})),
}

MODEL = """
companies AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS sector, 'C' || c_custkey AS symbol FROM customer),
articles AS (
  SELECT event_id AS id, user_id AS company_id, ts AS published_at, event_type AS source,
         'https://news.example/' || event_id AS url FROM events),
all_scores AS (
  SELECT event_id AS article_id, cast(k / 100 AS decimal(5,4)) AS confidence, score,
         CASE WHEN score > 0.1 THEN 'positive' WHEN score < -0.1 THEN 'negative' ELSE 'neutral' END AS label
  FROM (SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k,
               cast(greatest(least((value - 50) / 100, 1), -1) AS decimal(5,4)) AS score FROM events)),
scores AS (SELECT * FROM all_scores WHERE confidence >= 0.06),
facts AS (
  SELECT a.id, a.company_id, a.source, a.published_at, cast(a.published_at AS date) AS date,
         s.score, s.confidence, s.label
  FROM articles a JOIN scores s ON a.id = s.article_id),
named AS (
  SELECT f.*, c.name AS company_name, c.sector, c.symbol FROM facts f JOIN companies c ON c.id = f.company_id)
"""
AT = "timestamp '2024-01-31 00:00:00'"
AVG = "sum(score)::double / count(score)"
CONF = "sum(confidence)::double / count(confidence)"
LABELS = ("count(*) FILTER (label = 'positive') AS positive_{0}, "
          "count(*) FILTER (label = 'negative') AS negative_{0}, "
          "count(*) FILTER (label = 'neutral') AS neutral_{0}")
COUNTS = LABELS.format("count")


def _last(days: int) -> str:
    return f"published_at >= {AT} - INTERVAL {days} DAY"


def _daily(columns: str, extra: str = "") -> str:
    return f"""WITH {MODEL}
SELECT {columns}, strftime(date, '%Y-%m-%d') AS date, count(*) AS article_count, {AVG} AS avg_sentiment,
       min(score)::double AS min_sentiment, max(score)::double AS max_sentiment,
       {CONF} AS avg_confidence, {COUNTS}{extra}
FROM named WHERE company_name = '{A}' AND {_last(7)}
GROUP BY {columns}, date ORDER BY date DESC"""


_TREND = f"CASE WHEN {AVG} > 0.1 THEN 'Positive' WHEN {AVG} < -0.1 THEN 'Negative' ELSE 'Neutral' END"
_SECTOR_ANALYSIS = f"""WITH {MODEL}
SELECT company_name, count(*) AS article_count, {AVG} AS avg_sentiment, {_TREND} AS sentiment_trend,
       {CONF} AS avg_confidence
FROM named WHERE sector = '{SECTOR}' AND {_last(30)} GROUP BY company_id, company_name"""

ORACLES = {
    "weekly_company_report": _daily("company_name, sector, symbol", """,
       round(stddev_pop(score::double), 6) AS sentiment_volatility,
       (count(*) FILTER (label = 'positive') - count(*) FILTER (label = 'negative'))::double
         / count(*) AS sentiment_momentum"""),
    "sector_ranking": f"""WITH {MODEL}, ss AS (
  SELECT company_id, company_name, symbol, count(*) AS total_articles, {AVG} AS avg_sentiment,
         sum(score * confidence)::double / count(*) AS weighted_sentiment
  FROM named WHERE sector = '{SECTOR}' AND {_last(30)}
  GROUP BY company_id, company_name, symbol HAVING count(*) >= 5),
r AS (SELECT *, rank() OVER (ORDER BY weighted_sentiment DESC NULLS LAST) AS sentiment_rank,
             ntile(4) OVER (ORDER BY weighted_sentiment DESC NULLS LAST, md5(company_id::varchar)) AS q FROM ss)
SELECT company_name, symbol, total_articles, avg_sentiment, weighted_sentiment, sentiment_rank,
       CASE q WHEN 1 THEN 'Top Quartile' WHEN 2 THEN 'Second Quartile' WHEN 3 THEN 'Third Quartile'
              ELSE 'Bottom Quartile' END AS performance_tier FROM r""",
    "sentiment_moving_average": f"""WITH {MODEL}, d AS (
  SELECT date, {AVG} AS daily_sentiment, count(*) AS article_count
  FROM named WHERE company_name = '{B}' AND {_last(30)} GROUP BY date),
m AS (SELECT *, avg(daily_sentiment) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma FROM d)
SELECT strftime(date, '%Y-%m-%d') AS date, daily_sentiment, article_count, round(ma, 6) AS sentiment_7day_ma,
       CASE WHEN daily_sentiment > ma THEN 'Above Average' ELSE 'Below Average' END AS trend_indicator FROM m""",
    "cross_sector_comparison": f"""WITH {MODEL}, sd AS (
  SELECT sector, count(DISTINCT company_id) AS total_companies, count(*) AS total_articles,
         {AVG} AS avg_sector_sentiment, round(stddev_pop(score::double), 6) AS sentiment_volatility
  FROM named WHERE {_last(7)} GROUP BY sector HAVING count(*) >= 10),
md AS (SELECT {AVG} AS market_avg FROM facts WHERE {_last(7)}),
co AS (SELECT sector, company_name, {AVG} AS avg FROM named WHERE {_last(7)} GROUP BY sector, company_id, company_name),
tc AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY avg DESC NULLS LAST, company_name) AS rn FROM co)
SELECT sd.*, avg_sector_sentiment - market_avg AS vs_market_sentiment,
       company_name AS best_company, avg AS best_company_sentiment
FROM sd CROSS JOIN md LEFT JOIN tc ON sd.sector = tc.sector AND rn = 1
""".replace("sd.*", "sd.sector, total_companies, total_articles, avg_sector_sentiment, sentiment_volatility"),
    "source_reliability": f"""WITH {MODEL}
SELECT source, count(*) AS total_articles, {AVG} AS avg_sentiment,
       round(stddev_pop(score::double), 6) AS sentiment_std_dev, {CONF} AS avg_confidence,
       round(1 / (1 + stddev_pop(score::double)), 6) AS consistency_score,
       (count(*) FILTER (label = 'positive'))::double / count(*) AS positive_ratio,
       (count(*) FILTER (label = 'negative'))::double / count(*) AS negative_ratio,
       (count(*) FILTER (label = 'neutral'))::double / count(*) AS neutral_ratio
FROM facts WHERE {_last(30)} GROUP BY source HAVING count(*) >= 20""",
    "pairwise_difference": f"""WITH {MODEL}, d AS (
  SELECT company_name, date, {AVG} AS avg FROM named
  WHERE company_name IN ('{A}', '{B}') AND {_last(30)} GROUP BY company_name, date)
SELECT strftime(a.date, '%Y-%m-%d') AS date, a.avg AS first_sentiment, b.avg AS second_sentiment,
       abs(a.avg - b.avg) AS sentiment_difference,
       CASE WHEN abs(a.avg - b.avg) < 0.1 THEN 'Highly Correlated'
            WHEN abs(a.avg - b.avg) < 0.3 THEN 'Moderately Correlated' ELSE 'Divergent' END AS correlation_level
FROM d a JOIN d b ON a.date = b.date AND a.company_name = '{A}' AND b.company_name = '{B}'""",
    "market_momentum": f"""WITH {MODEL}, d AS (
  SELECT date, count(*) AS total_articles, {AVG} AS avg_sentiment,
         count(*) FILTER (label = 'positive') - count(*) FILTER (label = 'negative') AS sentiment_momentum
  FROM facts WHERE {_last(14)} GROUP BY date),
m AS (SELECT *, avg_sentiment - lag(avg_sentiment) OVER (ORDER BY date) AS sentiment_change FROM d)
SELECT strftime(date, '%Y-%m-%d') AS date, avg_sentiment, sentiment_momentum, sentiment_change,
       CASE WHEN sentiment_change > 0.05 THEN 'Strong Positive Shift'
            WHEN sentiment_change > 0.02 THEN 'Positive Shift'
            WHEN sentiment_change < -0.05 THEN 'Strong Negative Shift'
            WHEN sentiment_change < -0.02 THEN 'Negative Shift' ELSE 'Stable' END AS momentum_trend,
       total_articles
FROM m WHERE sentiment_change IS NOT NULL""",
    "sector_outperformance": f"""WITH {MODEL}, cs AS (
  SELECT company_id, {AVG} AS company_sentiment, count(*) AS article_count
  FROM facts WHERE {_last(7)} GROUP BY company_id),
ss AS (SELECT sector, {AVG} AS sector_avg_sentiment FROM named WHERE {_last(7)} GROUP BY sector)
SELECT c.name AS company_name, c.sector, c.symbol, company_sentiment, article_count, sector_avg_sentiment,
       company_sentiment - sector_avg_sentiment AS outperformance,
       CASE WHEN company_sentiment > sector_avg_sentiment + 0.1::double THEN 'Strong Outperformer'
            WHEN company_sentiment > sector_avg_sentiment + 0.05::double THEN 'Outperformer'
            WHEN company_sentiment < sector_avg_sentiment - 0.05::double THEN 'Underperformer'
            ELSE 'In Line' END AS performance_category
FROM companies c JOIN cs ON c.id = cs.company_id JOIN ss ON c.sector = ss.sector WHERE article_count >= 3""",
    "time_patterns": f"""WITH {MODEL}
SELECT dayname(published_at) AS day_of_week, hour(published_at) AS hour_of_day, count(*) AS article_count,
       {AVG} AS avg_sentiment,
       CASE WHEN hour(published_at) BETWEEN 9 AND 16 THEN 'Market Hours'
            WHEN hour(published_at) BETWEEN 17 AND 20 THEN 'After Hours' ELSE 'Off Hours' END AS market_session
FROM facts WHERE {_last(30)} GROUP BY dayname(published_at), hour(published_at) HAVING count(*) >= 5""",
    "portfolio_report": f"""WITH {MODEL}, m AS (
  SELECT company_name, sector, symbol, count(*) AS article_count, {AVG} AS avg,
         stddev_pop(score::double) AS sigma, {CONF} AS conf
  FROM named WHERE company_name IN ({NAMES}) AND {_last(7)} GROUP BY company_name, sector, symbol)
SELECT company_name, sector, symbol, article_count, round(avg, 6) AS avg_sentiment,
       round(sigma, 6) AS volatility, round(conf, 6) AS confidence,
       round(avg / (1 + sigma), 6) AS risk_adjusted_sentiment, 0.25::double AS portfolio_weight,
       round(0.25 * avg, 6) AS portfolio_contribution FROM m
UNION ALL
SELECT 'PORTFOLIO TOTAL', 'Mixed', 'PORTFOLIO', sum(article_count)::bigint, round(avg(avg), 6),
       round(avg(sigma), 6), round(avg(conf), 6), round(avg(avg / (1 + sigma)), 6), 1.0::double,
       round(sum(0.25 * avg), 6) FROM m""",
    "recent_company_sentiment": f"""WITH {MODEL}
SELECT c.name AS company_name, c.sector, c.symbol, count(*) AS article_count, {AVG} AS avg_sentiment,
       min(score)::double AS min_sentiment, max(score)::double AS max_sentiment, {CONF} AS avg_confidence,
       {COUNTS}, strftime(max(published_at), '%Y-%m-%d %H:%M:%S.%f') AS latest_article_date
FROM companies c JOIN articles a ON c.id = a.company_id LEFT JOIN scores s ON a.id = s.article_id
WHERE {_last(7)} GROUP BY c.id, c.name, c.sector, c.symbol""",
    "daily_sector_trends": f"""WITH {MODEL}
SELECT strftime(date, '%Y-%m-%d') AS date, sector, count(*) AS total_articles, {AVG} AS avg_sentiment,
       {LABELS.format('articles')}
FROM named WHERE {_last(30)} GROUP BY date, sector""",
    "company_report_fn": _daily("company_name, sector, symbol"),
    "sector_analysis_fn": _SECTOR_ANALYSIS,
    "weekly_report_method": _daily("company_name, sector"),
    "sector_analysis": _SECTOR_ANALYSIS,
    "sector_summary": f"""WITH {MODEL}, n AS (SELECT * FROM named WHERE sector = '{SECTOR}' AND {_last(30)}),
sd AS (SELECT sector, count(*) AS total_articles, {AVG} AS avg_sentiment, {_TREND} AS sentiment_trend
       FROM n GROUP BY sector),
co AS (SELECT sector, company_name, {AVG} AS avg FROM n GROUP BY sector, company_name),
tc AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY avg DESC NULLS LAST, company_name) AS rn FROM co)
SELECT sd.sector, total_articles, avg_sentiment, sentiment_trend, company_name AS top_company,
       avg AS top_company_sentiment FROM sd LEFT JOIN tc ON sd.sector = tc.sector AND rn = 1""",
    "trending_companies": f"""WITH {MODEL}
SELECT company_name AS name, sector, count(*) AS article_count, {AVG} AS avg_sentiment
FROM named WHERE {_last(1)} GROUP BY company_id, company_name, sector
ORDER BY article_count DESC, avg_sentiment DESC NULLS LAST, name LIMIT 10""",
    "top_performers": f"""WITH {MODEL}
SELECT company_name AS name, symbol, {AVG} AS avg_sentiment
FROM named WHERE {_last(7)} GROUP BY company_id, company_name, symbol""",
    "sector_overview": f"""WITH {MODEL}
SELECT sector, count(DISTINCT company_id) AS companies, {AVG} AS avg_sentiment FROM named GROUP BY sector""",
    "adhoc_sql": f"""WITH {MODEL}
SELECT sector, count(*) AS articles, min(score)::double AS lowest FROM named WHERE score >= 0.25 GROUP BY sector""",
}
