import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from newsignal import session
from newsignal.functions.dates import days_before
from newsignal.model import SCORES, stable_id, tracked_companies
from newsignal.operators import store
from newsignal.operators.integrity import violations
from newsignal.operators.lexicons import finance_lexicon
from newsignal.operators.store import Store
from newsignal.plans import pipeline, reports
from newsignal.sources import feeds, tables
from newsignal.streaming import dedupe, ingest, trends
from tests.conftest import AS_OF, table


def item(url, title, content="", **kw):
    return {"title": title, "description": "", "content": content, "url": url, "source": {"name": "S"},
            "publishedAt": "2025-11-18T10:00:00Z", "author": None, **kw}


def call(articles, at=0, **kw):
    return {"status": "ok", "fetched_at": f"2025-11-18T11:00:{at:02}Z", "articles": articles, **kw}


@pytest.fixture
def land(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()

    def write(name, *calls):
        (folder / name).write_text("\n".join(map(json.dumps, calls)))
        return str(folder)

    return write


@pytest.fixture
def empty(spark, tmp_path):
    return Store(spark, str(tmp_path / "store")).create()


CALLS = [
    call([item("u1", "Apple growth strong"), item("u2", "quiet day"), item("u1", "again")], company="Apple Inc."),
    call([item("u2", "other title", "loss"), item("u3", "Tesla weak risk")], 1, company="Tesla Inc."),
    call([item("u1", "from the sector"), item("u4", "metal surge"), item("u5", "weather report"), item("", "no url")],
         2, sector="technology"),
    {"status": "error", "company": "NVIDIA Corporation"},
]


def run(spark, folder, target, event_type="scheduled", as_of=AS_OF):
    return pipeline.run(spark, feeds.read_payloads(spark, folder), target, tracked_companies(spark),
                        finance_lexicon(spark), event_type, as_of=as_of).first()


def state(target):
    news = target.news()
    joined = news.articles.join(news.scores.select(F.col("article_id").alias("id"), "sentiment_score", "sentiment_label"), "id")
    return {r.url: (r.title, r.sentiment_score, r.sentiment_label) for r in joined.collect()}


def test_pipeline_run(spark, land, empty):
    folder = land("a.json", *CALLS)
    first = run(spark, folder, empty)
    assert first.success and first.errors == [] and first.old_articles_deleted is None
    assert (first.companies_processed, first.articles_fetched) == (10, 6)      # u1 u2 u3 + u1 u4 u5
    assert first.articles_processed == first.sentiment_scores_created == 4     # u5 links to nothing
    got = state(empty)
    assert set(got) == {"u1", "u2", "u3", "u4"} and got["u1"][0] == "Apple growth strong" and got["u2"][0] == "quiet day"
    # title twice: growth, strong twice each; polarity 0.5, valence 8/√79, keywords 1
    assert got["u1"][1] == Decimal(str(round(0.4 * 0.5 + 0.4 * 8 / 79 ** 0.5 + 0.2, 4)))
    assert got["u3"][2] == "negative"
    company = empty.news().articles.join(tracked_companies(spark).select(F.col("id").alias("company_id"), "name"), "company_id")
    assert {r.url: r.name for r in company.collect()}["u4"] == "Meta Platforms Inc."

    again = run(spark, folder, empty)
    assert again.success and again.articles_processed == 0 and state(empty) == got
    assert empty.news().companies.count() == 10
    assert violations(empty.news()).filter("violations > 0").count() == 0
    weekly = reports.weekly_company_report(empty.news(), "Apple Inc.", as_of=AS_OF)
    assert weekly.collect()[0].article_count == 2
    # The look-back prunes the day folders of both fact tables.
    plan = weekly._jdf.queryExecution().optimizedPlan().toString() + weekly._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("(published_date") >= 2 and "PartitionFilters: [isnotnull(published_date" in plan


def test_an_article_left_without_score_is_scored_later(spark, land, empty):
    folder = land("a.json", *CALLS)
    run(spark, folder, empty)
    half = Store(spark, empty.root + "-half").create()
    half.append("articles", empty.news().articles)
    assert run(spark, folder, half).articles_processed == 4
    assert state(half) == state(empty) and half.news().articles.count() == 4


def test_texts_are_written_once_as_fetched_and_once_per_url(spark, land, empty, monkeypatch):
    """Findings F10 and F12: each further copy of the texts is written, shuffled and spilled."""
    written, durable = [], session.durable
    monkeypatch.setattr(session, "durable", lambda s, df, *more: written.append(df.columns) or durable(s, df, *more))
    assert run(spark, land("a.json", *CALLS), empty).success
    assert sum("content" in columns or "text" in columns for columns in written) == 2
    assert state(empty)["u1"][0] == "Apple growth strong" and set(state(empty)) == {"u1", "u2", "u3", "u4"}


def test_a_later_article_is_scored_where_the_first_has_no_text(spark, land, empty):
    blank = item("u", "  ", description=" ", content="")
    folder = land("a.json", call([blank], company="Apple Inc."), call([item("u", "strong growth")], sector="technology"),
                  call([item("v", "Apple gain")], company="Tesla Inc."))
    companies = tracked_companies(spark).withColumn("symbol", F.when(F.col("name") == "Tesla Inc.", "growth").otherwise(F.col("symbol")))
    summary = pipeline.run(spark, feeds.read_payloads(spark, folder), empty, companies, finance_lexicon(spark), as_of=AS_OF).first()
    assert (summary.articles_fetched, summary.articles_added, summary.sentiment_scores_created) == (3, 2, 2)
    assert state(empty)["u"][0] == "" and state(empty)["u"][2] == "positive"


def test_run_without_articles_and_failed_run(spark, land, empty):
    nothing = run(spark, land("a.json", {"status": "error"}), empty)
    assert not nothing.success and nothing.articles_fetched == 0 and nothing.errors == []
    broken = pipeline.run(spark, spark.range(1), empty, tracked_companies(spark), finance_lexicon(spark), as_of=AS_OF).first()
    assert not broken.success and len(broken.errors) == 1


def test_maintenance_removes_old_articles(spark, land, empty):
    folder = land("a.json", call([item("old", "Apple loss", publishedAt="2025-01-01T00:00:00Z"),
                                  item("edge", "Apple gain", publishedAt="2025-08-20T12:00:00Z"),
                                  item("past", "Apple gain", publishedAt="2025-08-20T11:59:59Z"),
                                  item("new", "Apple gain")], company="Apple Inc."))
    summary = run(spark, folder, empty, "maintenance")
    assert summary.success and summary.old_articles_deleted == 4               # two articles, two scores
    assert set(state(empty)) == {"edge", "new"} and empty.news().scores.count() == 2
    assert empty.apply_retention(AS_OF) == {"articles_deleted": 0, "scores_deleted": 0, "rows_deleted": 0}
    empty.apply_retention(AS_OF + timedelta(days=90, hours=-1))
    assert set(state(empty)) == set()                                          # the edge day is dropped whole too


def test_inserts(spark):
    companies = spark.createDataFrame([("A", "T", "a")], "name string, sector string, symbol string")
    batch = spark.createDataFrame([("A", "X", "x"), ("B", "T", None), ("B", "T", None)], companies.schema)
    assert [r.name for r in store.new_companies(batch, companies).collect()] == ["B"]
    articles = spark.createDataFrame([("u", "old")], "url string, title string")
    more = spark.createDataFrame([("u", "new"), ("v", "2"), ("v", "1")], articles.schema)
    assert [tuple(r) for r in store.new_articles(more, articles, ["title"]).collect()] == [("v", "1")]
    keys = "article_id string, processing_method string"
    scores = spark.createDataFrame([("1", "combined")], keys)
    more = spark.createDataFrame([("1", "combined"), ("1", "other"), ("2", "combined")], keys)
    assert sorted(tuple(r) for r in store.new_scores(more, scores).collect()) == [("1", "other"), ("2", "combined")]
    urls = spark.createDataFrame([("u",), ("w",)], "url string")
    assert [r.url for r in store.existing(urls, articles, "url").collect()] == ["u"]
    ids = store.ids_of(urls, articles.withColumn("id", stable_id(F.col("url"))), "url")
    assert {r.url: r.id is not None for r in ids.collect()} == {"u": True, "w": False}


def test_retention_keeps_the_cutoff(spark, make_news):
    news = make_news({"A": "T"}, [("A", AS_OF - timedelta(days=90), "1"), ("A", AS_OF - timedelta(days=90, seconds=1), "1"),
                                  ("A", AS_OF - timedelta(days=91), None)])
    assert [r.id for r in store.retained(news, AS_OF).articles.collect()] == ["0"]
    assert store.retention_counts(news, AS_OF).first()[:] == (2, 1, 3)


def test_integrity(spark, make_news):
    news = make_news({"A": "T"}, [("A", AS_OF, "0.5"), ("nobody", AS_OF, "0.5")])
    bad = table(spark, SCORES, [{"article_id": "0", "processing_method": "combined", "sentiment_label": "odd",
                                 "sentiment_score": Decimal("1.5"), "confidence": None, "subjectivity": Decimal("-1")},
                                {"article_id": "9", "processing_method": "m", "sentiment_label": "neutral",
                                 "sentiment_score": Decimal("1"), "confidence": Decimal("0")}])
    found = violations(type(news)(news.companies, news.articles, news.scores.unionByName(bad)))
    assert {(r.table, r.rule): r.violations for r in found.filter("violations > 0").collect()} == {
        ("articles", "company_id references companies"): 1,
        ("sentiment_scores", "confidence not null"): 1,
        ("sentiment_scores", "sentiment_label in enum"): 1,
        ("sentiment_scores", "sentiment_score in -1..1"): 1,
        ("sentiment_scores", "subjectivity in 0..1"): 1,
        ("sentiment_scores", "article_id, processing_method unique"): 1,
        ("sentiment_scores", "article_id references articles"): 1,
    }


def test_tables_are_read_back(spark, land, empty):
    run(spark, land("a.json", *CALLS), empty)
    news = tables.from_parquet(spark, empty.root)
    assert (news.companies.count(), news.articles.count(), news.scores.count()) == (10, 4, 4)


def test_stream_ends_in_the_batch_state(spark, land, empty, tmp_path):
    folder = land("a.json", *CALLS[:1])
    land("b.json", *CALLS[1:])
    companies, lexicon = tracked_companies(spark), finance_lexicon(spark)
    def stream():
        landed = feeds.stream_payloads(spark, folder, files_per_batch=1)
        ingest.ingest(landed, empty, companies, lexicon, str(tmp_path / "cp"), as_of=AS_OF, every=None).awaitTermination()

    stream()
    batch = Store(spark, str(tmp_path / "batch"))
    run(spark, folder, batch)
    scores = {u: s for u, (_, s, _) in state(batch).items()}
    land("c.json", *CALLS)                                                     # the look-back overlaps
    stream()
    assert set(state(empty)) == set(scores) and empty.news().scores.count() == 4
    assert state(empty)["u1"][1] == scores["u1"] and state(empty)["u4"] == state(batch)["u4"]


def events(spark, folder, rows, name):
    spark.createDataFrame(rows, "url string, n int, published_at timestamp").coalesce(1).write.parquet(f"{folder}/{name}")


def test_stream_dedupe_over_batches(spark, tmp_path):
    day = datetime(2025, 1, 1)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events(spark, src, [("u", i, day) for i in range(50)] + [("v", 0, day)], "a")
    def stream():
        s = spark.readStream.schema("url string, n int, published_at timestamp").option("recursiveFileLookup", "true").parquet(src)
        (dedupe.distinct_urls(s).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start(out).awaitTermination())

    stream()
    events(spark, src, [("u", 99, day + timedelta(days=3)), ("w", 0, day + timedelta(days=3))], "b")
    stream()
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["u", "v", "w"]


def test_stream_trend_equals_batch(spark, make_news, tmp_path):
    news = make_news({"A": "T", "B": "H"}, [("A", AS_OF - timedelta(hours=7 * i), "0.25") for i in range(9)] + [("B", AS_OF, "-1")])
    facts = (news.articles.join(news.scores.withColumnRenamed("article_id", "aid"), F.col("aid") == news.articles.id)
             .join(news.companies.select(F.col("id").alias("company_id"), "sector"), "company_id")
             .select("published_at", "sector", F.col("sentiment_score").alias("score"), "confidence", F.col("sentiment_label").alias("label")))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    facts.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    trends.write_trends(trends.daily_trends(stream), out, str(tmp_path / "cp"), every=None).awaitTermination()
    assert sorted(spark.read.parquet(out).collect()) == sorted(reports.daily_sector_trends(news, as_of=AS_OF).collect())


def test_days_before_keeps_the_time(spark):
    got = spark.range(1).select(days_before(F.lit(AS_OF), 7)).first()[0]
    assert got == AS_OF - timedelta(days=7)
