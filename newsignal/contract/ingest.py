"""Feed, ingest and linking queries over documents and events, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.contract.adapter import AS_OF, articles, news_url, plain, table
from newsignal.contract.reports import MODEL
from newsignal.functions.text import BLANKS, analysis_text
from newsignal.model import stable_id
from newsignal.operators import ingest, linking
from newsignal.session import shared_dir
from newsignal.sources import feeds

# Words of the documents in three languages that stand for "stock", "market", "business".
CONTEXT = ("that", "elle", "nicht")
LOOKBACK_AT = datetime(2024, 1, 30, 15, 30)
# The documents' events are early in the month.
FEED_HOURS = 684


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked companies named by words that occur in the documents."""
    word = F.split(F.lower("text"), r"\s+")
    named = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("ordinal"),
        F.concat_ws(" ", word[2], word[3]).alias("name"),
        word[1].alias("symbol"),
    )
    return (
        named.groupBy("name")
        .agg(F.min("ordinal").alias("ordinal"), F.min_by("symbol", "ordinal").alias("symbol"))
        .withColumns({
            "id": stable_id(F.col("name")),
            "sector": F.concat(F.lit("src"), (F.col("ordinal") % 20).cast("string")),
        })
    )


def _published_text() -> Column:
    """The event time in the ways feeds write it; 'error' has none, 'signup' is no date."""
    def iso(moment: Column, zone: str) -> Column:
        return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone))

    ts, kind = F.col("ts"), F.col("event_type")
    return (
        F.when(kind == "view", iso(ts, "Z"))
        .when(kind == "purchase", iso(ts + F.expr("INTERVAL 2 HOURS"), "+02:00"))
        .when(kind == "click", iso(ts, ""))
        .when(kind == "signup", "not a date")
        .otherwise("")
    )


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed articles: first line, second line, text, with the event's date."""
    lang, feed = F.col("lang"), F.col("feed")
    # The digest is taken before the join, so that what needs no texts does not shuffle them.
    documents = table(spark, sf_dir, "documents").withColumnRenamed("source", "feed").withColumn(
        "url", F.when(lang != "es", news_url(F.md5("text"))).otherwise(""))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts", "event_type")
    names = tracked(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.col("name").alias("_company"))
    return documents.join(events, "doc_id").join(names, "doc_id", "left").select(
        "doc_id", "lang", "feed",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.nullif(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit("")).alias("description"),
        F.col("text").alias("content"),
        "url",
        F.struct(F.when(lang != "de", feed).alias("name")).alias("source"),
        _published_text().alias("publishedAt"),
        F.when(lang == "fr", F.concat(F.lit("  "), feed, F.lit("\t"))).when(lang == "en", feed)
        .otherwise("").alias("author"),
        F.coalesce("_company", F.concat(F.lit("sector:"), feed)).alias("company_search_term"),
        F.col("ts").alias("fetched_at"),
        F.col("doc_id").alias("ordinal"),
    )


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.normalize(ingest.with_required_fields(raw_articles(spark, sf_dir)), AS_OF)


def write_payloads(spark: SparkSession, sf_dir: str, files: int | None = None) -> str:
    """The articles as landed payload files: English and French as company calls, German as
    sector calls, Spanish as failed calls (those of src7 cut off in the middle)."""
    lang = F.col("lang")
    number = F.substring("feed", 4, 9).cast("bigint")
    kind = F.when(lang.isin("en", "fr"), "company").when(lang == "de", "sector").otherwise("error")
    article = F.struct(
        "doc_id", "title", "description", "content", news_url(F.md5("content")).alias("url"), "source",
        "publishedAt", "author",
    )
    calls = (
        raw_articles(spark, sf_dir)
        .groupBy(kind.alias("kind"), "feed", number.alias("number"), F.floor(F.col("doc_id") / 1000).alias("call"))
        .agg(F.array_sort(F.collect_list(article)).alias("articles"))
    )
    names = tracked(spark, sf_dir).select(F.col("ordinal").alias("number"), F.col("name").alias("company"))
    usable = F.col("kind") != "error"
    envelope = F.struct(
        F.when(usable, "ok").otherwise("error").alias("status"),
        F.when(~usable, F.concat(F.lit("quota of "), "feed")).alias("message"),
        F.size("articles").alias("totalResults"),
        F.when(F.col("kind") != "sector", F.col("company")).alias("company"),
        F.when(F.col("kind") == "sector", F.col("feed")).alias("sector"),
        (F.lit("2024-01-30T00:00:00Z").cast("timestamp") + F.make_dt_interval(mins=F.col("call").cast("int"))).alias("fetched_at"),
        F.when(usable, F.col("articles")).alias("articles"),
    )
    line = F.to_json(envelope)
    broken = (F.col("kind") == "error") & (F.col("feed") == "src7")
    lines = calls.join(names, "number", "left").select(
        F.when(broken, F.substring(line, 1, 20)).otherwise(line).alias("value")
    )
    path = shared_dir(spark, "payloads")
    (lines.repartition(files) if files else lines).write.text(path, compression="gzip")
    return path


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.read_payloads(spark, write_payloads(spark, sf_dir))


def _feed_rows(feed: DataFrame) -> DataFrame:
    return plain(feed.select(
        "company_search_term", "ordinal", "title", "url", F.col("source.name").alias("source"), "author",
        F.md5("content").alias("content"), F.coalesce("description", F.lit("-")).alias("description"),
    ))


def _articles(df: DataFrame) -> DataFrame:
    return plain(df.select(
        "doc_id", "title", "description", F.md5("content").alias("content"), "url", "source",
        F.col("published_at").cast("timestamp_ntz"), F.coalesce("author", F.lit("-")).alias("author"),
        "company_search_term",
    ))


def _union(s: SparkSession, d: str) -> DataFrame:
    rows = normalized(s, d)
    of_sector = F.col("company_search_term").startswith("sector:")
    return ingest.union_feeds(rows.filter(~of_sector), rows.filter(of_sector))


def _search(s: SparkSession, d: str) -> DataFrame:
    corpus = table(s, d, "documents").select("doc_id", "text")
    return ingest.search(corpus, ingest.company_terms(tracked(s, d)), CONTEXT).select("doc_id", "term")


def _sectors(s: SparkSession, d: str) -> DataFrame:
    """Sectors named by words that occur in the documents."""
    word = F.split("text", r"\s+")
    return table(s, d, "benchmark").select(F.get(word, F.lit(4)).alias("sector"))


def _feed(s: SparkSession, d: str, terms: DataFrame, any_of: tuple[str, ...]) -> DataFrame:
    dated = table(s, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("published_at"))
    corpus = table(s, d, "documents").select("doc_id", "text", F.col("lang").alias("language")).join(dated, "doc_id")
    found = ingest.corpus_feed(corpus, terms, any_of, FEED_HOURS, LOOKBACK_AT, tie="doc_id")
    return plain(found.select("doc_id", "term", "published_at"))


def _analysis_text(s: SparkSession, d: str) -> DataFrame:
    text = analysis_text(F.col("title"), F.col("description"), F.col("content"), 2000)
    return raw_articles(s, d).select(
        "doc_id", F.length(text).cast("bigint").alias("length"), F.md5(text).alias("text_md5")
    )


QUERIES = {
    "search_terms": _search,
    "company_search": lambda s, d: _feed(s, d, ingest.company_terms(tracked(s, d)), CONTEXT),
    "sector_search": lambda s, d: _feed(s, d, ingest.sector_terms(_sectors(s, d)), CONTEXT[:2]),
    "language_filter": lambda s, d: ingest.in_language(table(s, d, "documents"), "en", "lang").select("doc_id", "lang"),
    "lookback_filter": lambda s, d: plain(
        ingest.within_lookback(articles(s, d), 168, LOOKBACK_AT).select("id", "published_at")),
    "latest_per_company": lambda s, d: plain(
        ingest.newest_per_term(articles(s, d), 10, "company_id", "id").select("company_id", "id", "published_at")),
    "company_feed": lambda s, d: _feed_rows(feeds.company_feed(payloads(s, d))),
    "sector_feed": lambda s, d: _feed_rows(feeds.sector_feed(payloads(s, d))),
    "feed_rejects": lambda s, d: feeds.rejects(payloads(s, d)).groupBy("error").agg(F.count(F.lit(1)).alias("calls")),
    "required_fields": lambda s, d: ingest.with_required_fields(raw_articles(s, d)).select("doc_id"),
    "parse_dates": lambda s, d: plain(
        normalized(s, d).select("doc_id", F.col("published_at").cast("timestamp_ntz"))),
    "normalize_articles": lambda s, d: _articles(normalized(s, d)),
    "dedupe_articles": lambda s, d: _articles(ingest.dedupe_by_url(normalized(s, d))),
    "union_feeds": lambda s, d: _articles(_union(s, d)),
    "link_companies": lambda s, d: linking.link_companies(normalized(s, d), tracked(s, d)).select("doc_id", "company_id"),
    "link_companies_strict": lambda s, d: linking.link_companies_strict(
        normalized(s, d), tracked(s, d)).select("doc_id", "company_id"),
    "analysis_text": _analysis_text,
}

_B = "'" + BLANKS + "'"
_ANY = " OR ".join(f"contains(lower(text), '{w}')" for w in CONTEXT)

RAW = f"""
words AS (SELECT item_id, string_split_regex(lower(text), '\\s+') AS w FROM benchmark),
tracked AS (
  SELECT md5(name) AS id, name, min(item_id) AS ordinal, arg_min(symbol, item_id) AS symbol,
         'src' || (min(item_id) % 20) AS sector
  FROM (SELECT item_id, w[3] || ' ' || w[4] AS name, w[2] AS symbol FROM words) GROUP BY name),
raw AS (
  SELECT d.doc_id, d.lang, d.source AS feed, split_part(text, chr(10), 1) AS title,
         nullif(split_part(text, chr(10), 2), '') AS description, text AS content,
         CASE WHEN lang <> 'es' THEN 'https://news.example/' || md5(text) ELSE '' END AS url,
         CASE WHEN lang <> 'de' THEN d.source END AS source, event_type,
         CASE event_type WHEN 'signup' THEN timestamp '2024-01-31' ELSE ts END AS published_at,
         CASE lang WHEN 'fr' THEN '  ' || d.source || chr(9) WHEN 'en' THEN d.source ELSE '' END AS author,
         coalesce(t.name, 'sector:' || d.source) AS company_search_term, ts AS fetched_at, doc_id AS ordinal
  FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN tracked t ON t.ordinal = d.doc_id)
"""
NORMAL = f"""{RAW},
required AS (SELECT * FROM raw WHERE title <> '' AND url <> '' AND event_type <> 'error'),
normalized AS (
  SELECT doc_id, trim(title, {_B}) AS title, trim(coalesce(description, ''), {_B}) AS description,
         trim(content, {_B}) AS content, trim(url, {_B}) AS url, coalesce(source, 'Unknown') AS source,
         published_at, CASE WHEN author <> '' THEN trim(author, {_B}) END AS author,
         company_search_term, fetched_at, ordinal FROM required)
"""
KEYWORDS = """
kwords AS (
  SELECT unnest(string_split_regex(name, '\\s+')) AS keyword, 2 AS stage, ordinal, id FROM tracked
  UNION ALL SELECT symbol, 3, ordinal, id FROM tracked)
"""
CALLS = f"""{RAW},
calls AS (
  SELECT r.* EXCLUDE (url, ordinal, company_search_term, fetched_at), 'https://news.example/' || md5(content) AS url,
         CASE WHEN lang IN ('en', 'fr') THEN 'company' WHEN lang = 'de' THEN 'sector' ELSE 'error' END AS kind,
         doc_id // 1000 AS call,
         CASE WHEN lang = 'de' THEN 'sector:' || feed ELSE t.name END AS company_search_term,
         row_number() OVER (PARTITION BY CASE WHEN lang IN ('en', 'fr') THEN 'company' ELSE lang END, feed,
                            doc_id // 1000 ORDER BY doc_id) - 1 AS ordinal
  FROM raw r LEFT JOIN tracked t ON t.ordinal = cast(substr(feed, 4) AS bigint))
"""
_ROWS = f"""doc_id, title, description, md5(content) AS content, url, source,
       strftime(published_at, '%Y-%m-%d %H:%M:%S.%f') AS published_at, coalesce(author, '-') AS author,
       company_search_term"""
_FIRST = "row_number() OVER (PARTITION BY url ORDER BY fetched_at, company_search_term, ordinal)"
_FEED = """company_search_term, ordinal, title, url, source, author, md5(content) AS content,
       coalesce(description, '-') AS description"""

_FEED_SQL = """
SELECT doc_id, term, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS published_at FROM (
  SELECT doc_id, term, ts, row_number() OVER (PARTITION BY term ORDER BY ts DESC NULLS LAST, doc_id) AS rn
  FROM documents JOIN events ON event_id = doc_id JOIN terms ON contains(lower(text), term)
  WHERE lang = 'en' AND ts >= date_trunc('day', timestamp '2024-01-30 15:30:00' - INTERVAL 684 HOUR) AND ({context}))
WHERE rn <= 10"""

ORACLES = {
    "company_search": f"WITH {RAW}, terms AS (SELECT DISTINCT string_split_regex(name, '\\s+')[1] AS term FROM tracked)"
    + _FEED_SQL.format(context=_ANY),
    "sector_search": "WITH terms AS (SELECT DISTINCT lower(string_split_regex(text, '\\s+')[5]) AS term FROM benchmark)"
    + _FEED_SQL.format(context=" OR ".join(f"contains(lower(text), '{w}')" for w in CONTEXT[:2])),
    "search_terms": f"""WITH {RAW}, terms AS (SELECT DISTINCT string_split_regex(name, '\\s+')[1] AS term FROM tracked)
SELECT doc_id, term FROM documents JOIN terms ON contains(lower(text), term) WHERE {_ANY}""",
    "language_filter": "SELECT doc_id, lang FROM documents WHERE lang = 'en'",
    "lookback_filter": """SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS published_at
FROM events WHERE ts >= date_trunc('day', timestamp '2024-01-30 15:30:00' - INTERVAL 168 HOUR)""",
    "latest_per_company": f"""WITH {MODEL}
SELECT company_id, id, strftime(published_at, '%Y-%m-%d %H:%M:%S.%f') AS published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY published_at DESC NULLS LAST, id) AS rn FROM articles)
WHERE rn <= 10""",
    "company_feed": f"WITH {CALLS} SELECT {_FEED} FROM calls WHERE kind = 'company'",
    "sector_feed": f"WITH {CALLS} SELECT {_FEED} FROM calls WHERE kind = 'sector'",
    "feed_rejects": f"""WITH {CALLS} SELECT error, count(*) AS calls FROM (
  SELECT DISTINCT feed, call, CASE WHEN feed = 'src7' THEN 'malformed payload'
                                   ELSE 'API error: quota of ' || feed END AS error
  FROM calls WHERE kind = 'error') GROUP BY error""",
    "required_fields": f"WITH {NORMAL} SELECT doc_id FROM required",
    "parse_dates": f"""WITH {NORMAL}
SELECT doc_id, strftime(published_at, '%Y-%m-%d %H:%M:%S.%f') AS published_at FROM normalized""",
    "normalize_articles": f"WITH {NORMAL} SELECT {_ROWS} FROM normalized",
    "dedupe_articles": f"WITH {NORMAL} SELECT {_ROWS} FROM (SELECT *, {_FIRST} AS rn FROM normalized) WHERE rn = 1",
    "union_feeds": f"""WITH {NORMAL} SELECT {_ROWS} FROM (
  SELECT *, {_FIRST} AS rn FROM normalized WHERE company_search_term NOT LIKE 'sector:%') WHERE rn = 1
UNION ALL SELECT {_ROWS} FROM normalized WHERE company_search_term LIKE 'sector:%'""",
    "link_companies": f"""WITH {NORMAL}, {KEYWORDS}, guess AS (
  SELECT doc_id, arg_min(k.id, k.stage * 1000000000::bigint + k.ordinal) AS id FROM normalized n
  JOIN kwords k ON contains(lower(n.title || ' ' || n.description || ' ' || n.content), k.keyword) GROUP BY doc_id)
SELECT n.doc_id, coalesce(t.id, g.id) AS company_id FROM normalized n
LEFT JOIN tracked t ON t.name = n.company_search_term LEFT JOIN guess g ON g.doc_id = n.doc_id
WHERE coalesce(t.id, g.id) IS NOT NULL""",
    "link_companies_strict": f"""WITH {NORMAL}, phrases AS (
  SELECT regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}]+') AS w, 2 AS stage, ordinal, id FROM tracked
  UNION ALL SELECT regexp_extract_all(lower(symbol), '[\\p{{L}}\\p{{N}}]+'), 3, ordinal, id FROM tracked),
needles AS (
  SELECT ' ' || array_to_string(list_slice(w, 1, CASE stage WHEN 3 THEN len(w) ELSE coalesce(list_max(kept), 1) END), ' ') || ' ' AS needle,
    stage, ordinal, id
  FROM (SELECT *, list_filter(range(1, len(w) + 1), lambda i: w[i] NOT IN ({", ".join(f"'{x}'" for x in linking.LEGAL_FORMS)})) AS kept FROM phrases)
  WHERE len(w) > 0),
texts AS (
  SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(title || ' ' || description || ' ' || content), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS text
  FROM normalized),
guess AS (
  SELECT doc_id, arg_min(k.id, k.stage * 1000000000::bigint + k.ordinal) AS id FROM texts JOIN needles k ON contains(text, needle) GROUP BY doc_id)
SELECT n.doc_id, coalesce(t.id, g.id) AS company_id FROM normalized n
LEFT JOIN tracked t ON t.name = n.company_search_term LEFT JOIN guess g ON g.doc_id = n.doc_id
WHERE coalesce(t.id, g.id) IS NOT NULL""",
    "analysis_text": f"""WITH {RAW}, t AS (
  SELECT doc_id, concat_ws(' ', nullif(title, ''), nullif(title, ''), nullif(description, ''),
    CASE WHEN length(content) > 2000 THEN substr(content, 1, 2000) || '...' ELSE nullif(content, '') END) AS text FROM raw)
SELECT doc_id, length(text) AS length, md5(text) AS text_md5 FROM t""",
}
