"""Table maintenance queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.contract import adapter
from newsignal.contract.adapter import AS_OF, plain, table
from newsignal.contract.ingest import NORMAL, normalized, raw_articles
from newsignal.contract.reports import AT, MODEL
from newsignal.model import SCORE_TYPE, News, stable_id
from newsignal.operators import store
from newsignal.operators.integrity import violations
from newsignal.operators.keyindex import KeyIndex
from newsignal.session import durable, shared_dir

KEEP_DAYS = 15
_SEEN = ["fetched_at", "company_search_term", "ordinal"]


def _known_companies(s: SparkSession, d: str) -> DataFrame:
    """Companies that are in the news: those already in the table."""
    in_news = table(s, d, "events").select(F.col("user_id").alias("id"))
    return adapter.companies(s, d).join(in_news, "id", "left_semi")


def _labelled_articles(s: SparkSession, d: str) -> DataFrame:
    """Articles of labelled documents: those already in the table."""
    known = normalized(s, d).join(table(s, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return known.select("url", stable_id(F.col("url")).alias("id")).distinct()


def _indexed_articles(s: SparkSession, d: str) -> KeyIndex:
    """A key index of the same articles: one base, and what a second batch adds."""
    known = durable(s, _labelled_articles(s, d))
    index = KeyIndex(s, shared_dir(s, "keys"), known.schema, ("url",), rows=200)
    index.rebuild(known.join(_of_good_documents(s, d), "url", "left_semi"))
    index.add(index.unseen(known))
    return index


def _of_good_documents(s: SparkSession, d: str) -> DataFrame:
    good = table(s, d, "labels").filter("quality = 1").select("doc_id")
    return normalized(s, d).join(good, "doc_id", "left_semi").select("url")


def _indexed_new_articles(s: SparkSession, d: str) -> DataFrame:
    articles = normalized(s, d).select("url", "doc_id", *_SEEN)
    firsts = durable(s, store.first_per_key(articles, ["url"], _SEEN))
    return _indexed_articles(s, d).unseen(firsts).select("url", "doc_id", "company_search_term")


def _indexed_ids(s: SparkSession, d: str) -> DataFrame:
    urls = durable(s, _urls(s, d))
    return store.ids_of(urls, _indexed_articles(s, d).lookup(urls), "url")


def _urls(s: SparkSession, d: str) -> DataFrame:
    return raw_articles(s, d).select("url").filter(F.col("url") != "").distinct()


def _negative_scores(s: SparkSession, d: str) -> DataFrame:
    return adapter.all_scores(s, d).filter(F.col("sentiment_label") == "negative")


def _kept(s: SparkSession, d: str) -> DataFrame:
    kept = store.retained(adapter.news(s, d), AS_OF, KEEP_DAYS)
    scores = kept.scores.select(F.col("article_id").alias("id"), "sentiment_score")
    return kept.articles.select("id", "company_id").join(scores, "id", "left")


def _faulty(s: SparkSession, d: str) -> News:
    """Copies share a url, some companies are missing, scores leave their range and their articles."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                                          adapter.news_url(F.md5("text")).alias("url"))
    events = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("company_id"),
                                         F.col("ts").alias("published_at"), F.col("event_type").alias("source"))
    scores = table(s, d, "events").select(
        F.col("event_id").alias("article_id"), ((F.col("value") - 50) / 100).cast(SCORE_TYPE).alias("sentiment_score"),
        (adapter.confidence_percent() / 90).cast(SCORE_TYPE).alias("confidence"),
        F.when(F.col("event_type") == "error", "unclear").when(F.col("event_type") != "view", "neutral").alias("sentiment_label"),
        F.lit("combined").alias("processing_method"),
    )
    companies = adapter.companies(s, d).filter(F.col("sector") != adapter.SECTOR)
    return News(companies, docs.join(events, "id"), scores)


QUERIES = {
    "unscored_articles": lambda s, d: adapter.articles(s, d).join(
        adapter.scores(s, d).select(F.col("article_id").alias("id")), "id", "left_anti").select("id", "company_id", "url"),
    "new_companies": lambda s, d: store.new_companies(
        adapter.companies(s, d), _known_companies(s, d)).select("name", "sector", "symbol"),
    "new_articles": lambda s, d: store.new_articles(
        normalized(s, d), _labelled_articles(s, d), _SEEN).select("url", "doc_id", "company_search_term"),
    "new_scores": lambda s, d: plain(store.new_scores(
        adapter.all_scores(s, d), _negative_scores(s, d)).select("article_id", "processing_method", "sentiment_score")),
    "existing_urls": lambda s, d: store.existing(_urls(s, d), _labelled_articles(s, d), "url"),
    "article_ids": lambda s, d: store.ids_of(_urls(s, d), _labelled_articles(s, d), "url"),
    "indexed_new_articles": _indexed_new_articles,
    "indexed_article_ids": _indexed_ids,
    "retention_keep": lambda s, d: plain(_kept(s, d)),
    "retention_counts": lambda s, d: plain(store.retention_counts(adapter.news(s, d), AS_OF, KEEP_DAYS)),
    "integrity_violations": lambda s, d: plain(violations(_faulty(s, d))),
}

_KNOWN = "known AS (SELECT DISTINCT url FROM normalized JOIN labels USING (doc_id))"
_URLS = "urls AS (SELECT DISTINCT url FROM raw WHERE url <> '')"
_CUT = f"{AT} - INTERVAL {KEEP_DAYS} DAY"


def _rule(table_name: str, rule: str, count: str) -> str:
    return f"SELECT '{table_name}' AS \"table\", '{rule}' AS rule, ({count})::bigint AS violations"


_RULES = [
    _rule("companies", f"{c} not null", f"SELECT count(*) FILTER ({c} IS NULL) FROM cs") for c in ("name", "sector")
] + [
    _rule("companies", "name unique", "SELECT count(name) - count(DISTINCT name) FROM cs"),
] + [
    _rule("articles", f"{c} not null", f"SELECT count(*) FILTER ({c} IS NULL) FROM ar")
    for c in ("title", "url", "source", "published_at", "company_id")
] + [
    _rule("articles", "url unique", "SELECT count(url) - count(DISTINCT url) FROM ar"),
    _rule("articles", "company_id references companies",
          "SELECT count(*) FROM ar WHERE company_id NOT IN (SELECT id FROM cs)"),
] + [
    _rule("sentiment_scores", f"{c} not null", f"SELECT count(*) FILTER ({c} IS NULL) FROM sc")
    for c in ("article_id", "sentiment_score", "confidence", "sentiment_label", "processing_method")
] + [
    _rule("sentiment_scores", "sentiment_label in enum",
          "SELECT count(*) FROM sc WHERE sentiment_label NOT IN ('positive', 'negative', 'neutral')"),
    _rule("sentiment_scores", "sentiment_score in -1..1",
          "SELECT count(*) FROM sc WHERE sentiment_score NOT BETWEEN -1 AND 1"),
    _rule("sentiment_scores", "confidence in 0..1", "SELECT count(*) FROM sc WHERE confidence NOT BETWEEN 0 AND 1"),
    _rule("sentiment_scores", "article_id, processing_method unique",
          "SELECT count(*) - count(DISTINCT article_id) FROM sc"),
    _rule("sentiment_scores", "article_id references articles",
          "SELECT count(*) FROM sc WHERE article_id NOT IN (SELECT id FROM ar)"),
]

ORACLES = {
    "unscored_articles": f"""WITH {MODEL}
SELECT id, company_id, url FROM articles WHERE id NOT IN (SELECT article_id FROM scores)""",
    "new_companies": f"""WITH {MODEL}
SELECT name, sector, symbol FROM companies WHERE id NOT IN (SELECT user_id FROM events)""",
    "new_articles": f"""WITH {NORMAL}, {_KNOWN}, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at, company_search_term, ordinal) AS rn FROM normalized)
SELECT url, doc_id, company_search_term FROM firsts WHERE rn = 1 AND url NOT IN (SELECT url FROM known)""",
    "new_scores": f"""WITH {MODEL}
SELECT article_id, 'combined' AS processing_method, score::double AS sentiment_score FROM all_scores WHERE label <> 'negative'""",
    "existing_urls": f"WITH {NORMAL}, {_KNOWN}, {_URLS} SELECT url FROM urls WHERE url IN (SELECT url FROM known)",
    "article_ids": f"""WITH {NORMAL}, {_KNOWN}, {_URLS}
SELECT u.url, CASE WHEN k.url IS NOT NULL THEN md5(u.url) END AS id FROM urls u LEFT JOIN known k ON u.url = k.url""",
    "retention_keep": f"""WITH {MODEL}
SELECT id, company_id, score::double AS sentiment_score FROM articles LEFT JOIN scores ON id = article_id
WHERE published_at >= {_CUT}""",
    "retention_counts": f"""WITH {MODEL}, old AS (SELECT * FROM articles WHERE published_at < {_CUT})
SELECT count(*) AS articles_deleted, count(article_id) AS scores_deleted, count(*) + count(article_id) AS rows_deleted
FROM old LEFT JOIN scores ON id = article_id""",
    "integrity_violations": f"""WITH cs AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS sector FROM customer WHERE c_mktsegment <> 'BUILDING'),
ar AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, 'https://news.example/' || md5(text) AS url,
         user_id AS company_id, ts AS published_at, event_type AS source
  FROM documents JOIN events ON doc_id = event_id),
sc AS (
  SELECT event_id AS article_id, cast((value - 50) / 100 AS decimal(5,4)) AS sentiment_score,
         cast(cast(json_extract_string(props, '$.k') AS int) / 90 AS decimal(5,4)) AS confidence,
         CASE event_type WHEN 'error' THEN 'unclear' WHEN 'view' THEN NULL ELSE 'neutral' END AS sentiment_label,
         'combined' AS processing_method FROM events)
""" + "\nUNION ALL ".join(_RULES),
}
# Looked up in the key index, the answers are the same.
ORACLES["indexed_new_articles"] = ORACLES["new_articles"]
ORACLES["indexed_article_ids"] = ORACLES["article_ids"]
