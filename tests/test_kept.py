"""What a store keeps beside its tables: sums by day, rejects, counts of a run, the files already taken."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from newsignal.model import SCORES, tracked_companies
from newsignal.operators.lexicons import finance_lexicon
from newsignal.operators.store import Store
from newsignal.plans import pipeline, reports
from newsignal.plans.facts import hourly_sums
from newsignal.sources import feeds
from newsignal.streaming import ingest, trends
from tests.conftest import AS_OF, table
from tests.test_store_pipeline import CALLS, call, item

ODD = AS_OF + timedelta(minutes=17, seconds=5)  # a look-back from here cuts an hour


@pytest.fixture
def stored(spark, make_news, tmp_path):
    """A store with news in two batches, and the same news as plain tables."""
    rows = [("A" if i % 3 else "B", AS_OF - timedelta(minutes=97 * i), f"{(i % 9 - 4) / 5:.2f}", "0.5", f"s{i % 2}") for i in range(220)]
    rows += [("A", ODD - timedelta(days=7, seconds=d), "0.25", "0.75") for d in (-1, 0, 1)] + [("B", AS_OF, None), ("C", AS_OF, None)]
    news = make_news({"A": "T", "B": "T", "C": "H"}, rows)
    store = Store(spark, str(tmp_path / "store")).create()
    store.append("companies", news.companies)
    for part in (F.col("id").cast("int") < 100, F.col("id").cast("int") >= 100):
        articles = news.articles.filter(part)
        store.append("articles", articles)
        store.append("sentiment_scores", news.scores.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi"))
        store.refresh_sums()
    return store, news


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


REPORTS = [
    lambda n, at: reports.weekly_company_report(n, "A", as_of=at), lambda n, at: reports.weekly_company_report(n, "A", as_of=at, method="combined"),
    lambda n, at: reports.sentiment_moving_average(n, "B", as_of=at), lambda n, at: reports.cross_sector_comparison(n, as_of=at),
    lambda n, at: reports.source_reliability(n, as_of=at), lambda n, at: reports.time_patterns(n, as_of=at), lambda n, at: reports.market_momentum(n, as_of=at),
    lambda n, at: reports.recent_company_sentiment(n, as_of=at), lambda n, at: reports.daily_sector_trends(n, as_of=at),
    lambda n, at: reports.sector_overview(n), lambda n, at: reports.pairwise_difference(n, "A", "B", as_of=at),
    lambda n, at: reports.portfolio_report(n, ["A", "B"], as_of=at),
]


def test_reports_over_kept_sums_equal_those_over_facts(stored):
    store, news = stored
    kept = store.news()
    assert kept.sums is not None and news.sums is None
    for report in REPORTS:
        same(report(kept, ODD), report(news, ODD))
    same(reports.recent_company_sentiment(kept, as_of=AS_OF), reports.recent_company_sentiment(news, as_of=AS_OF))
    folded = reports.source_reliability(kept.collated(), as_of=AS_OF)
    same(folded, reports.source_reliability(news.collated(), as_of=AS_OF))


def test_a_report_reads_sums_and_the_cut_hour_only(stored):
    plan = reports.daily_sector_trends(stored[0].news(), as_of=ODD)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("published_at#") and "n#" in plan
    cut = [line for line in plan.splitlines() if "Filter" in line and "published_at" in line and "<" in line]
    assert cut, "the facts are read up to the first whole hour only"


def test_sums_after_retention_and_a_repeated_refresh(stored):
    store, news = stored
    store.apply_retention(ODD, 5)
    kept = store.news()
    assert kept.sums is not None
    left = news.articles.filter(F.col("published_at") >= F.lit(ODD - timedelta(days=5)))
    plain = type(news)(news.companies, left, news.scores.join(left.select(F.col("id").alias("article_id")), "article_id", "left_semi"))
    same(reports.sector_overview(kept), reports.sector_overview(plain))
    before = sorted(map(repr, kept.sums.collect()))
    store.sums.mark([str((ODD - timedelta(days=k)).date()) for k in range(9)])
    assert store.news().sums is None  # facts are used while days are marked
    same(reports.sector_overview(store.news()), reports.sector_overview(plain))
    store.refresh_sums()
    assert sorted(map(repr, store.news().sums.collect())) == before
    store.apply_retention(AS_OF + timedelta(days=30), 1)
    assert store.news().sums.count() == 0


def test_only_touched_days_are_replaced(spark, stored, tmp_path):
    store, _ = stored
    files = lambda: {f for f in store.news().sums.inputFiles()}
    before, day = files(), AS_OF.date()
    store.append("sentiment_scores", table(spark, SCORES, [
        {"article_id": "223", "processing_method": "other", "sentiment_score": Decimal("0.5"), "confidence": Decimal("1"),
         "sentiment_label": "positive", "published_date": day}]))
    assert store.sums.marked() == [str(day)]
    store.create()  # what a run that failed left is done by the next one
    changed = before ^ files()
    assert changed and all(f"published_date={day}" in f for f in changed)
    same(store.news().sums.select(*hourly_sums(store.news()).columns), hourly_sums(store.news()))


def test_tables_that_had_no_sums_get_them(spark, stored, tmp_path):
    store, news = stored
    old = Store(spark, str(tmp_path / "old"))
    for name, rows in (("companies", store.news().companies), ("articles", store.news().articles), ("sentiment_scores", store.news().scores)):
        old._write(rows, name, "append")
    old.create()
    same(old.news().sums, store.news().sums)


@pytest.fixture
def land(tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()

    def write(name, *calls):
        (folder / name).write_text("\n".join(c if isinstance(c, str) else json.dumps(c) for c in calls))
        return str(folder)

    return write


def taken(spark, store, folder, run=None):
    run = run or (lambda *a, **k: pipeline.run(spark, feeds.read_payloads(spark, folder), *a, **k))
    return run(store, tracked_companies(spark), finance_lexicon(spark), as_of=AS_OF).first()


BAD = [call([item("u9", "", "x"), item("u8", "Apple gain", publishedAt=None)], 3, company="Apple Inc."),
       {"status": "error", "message": "quota", "company": "Tesla Inc.", "fetched_at": "2025-11-18T12:00:00Z"}, '{"status": "ok", "articles": [']


def test_counts_and_rejects_of_a_run(spark, land, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), land("a.json", *CALLS, *BAD)
    first = taken(spark, store, folder)
    assert first.success and first.companies_processed == 10
    # Failed: two by status, one cut off. Incomplete: no url, no title, no date. u1 twice for Apple and u2 twice over all company calls.
    # Unlinked: the sector's copy of u1, and u5.
    assert (first.payloads_rejected, first.articles_incomplete, first.articles_repeated) == (3, 3, 2)
    assert (first.articles_fetched, first.articles_unlinked, first.articles_known, first.articles_added) == (6, 2, 0, 4)
    assert (first.sentiment_scores_created, first.scores_known) == (4, 0)
    log = {(r.kind, r.reason, r.company_search_term) for r in store.rejects.table().collect()}
    assert log == {
        ("payload", "API error: Unknown error", "NVIDIA Corporation"), ("payload", "API error: quota", "Tesla Inc."), ("payload", "malformed payload", None),
        ("article", "missing title", "Apple Inc."), ("article", "missing publishedAt", "Apple Inc."), ("article", "missing url", "sector:technology")}
    again = taken(spark, store, folder)
    assert (again.articles_added, again.articles_known, again.sentiment_scores_created, again.scores_known) == (0, 4, 0, 4)
    assert {(r.kind, r.reason, r.company_search_term) for r in store.rejects.table().collect()} == log and store.rejects.table().count() == 6


def test_what_is_repaired_leaves_the_rejects(spark, land, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    taken(spark, store, land("a.json", *CALLS, *BAD))
    better = [call([item("u9", "Apple title", "x"), item("u8", "Apple gain", publishedAt=None)], 3, company="Apple Inc."),
              call([item("u7", "Tesla gain")], company="Tesla Inc.", ) | {"fetched_at": "2025-11-18T12:00:00Z"}]
    (tmp_path / "landed" / "a.json").unlink()
    taken(spark, store, land("b.json", *better))
    assert {(r.kind, r.reason) for r in store.rejects.table().collect()} == {
        ("payload", "API error: Unknown error"), ("payload", "malformed payload"), ("article", "missing publishedAt"), ("article", "missing url")}
    assert {"u7", "u9"} <= {r.url for r in store.news().articles.collect()}


def test_rows_that_break_a_rule_are_rejected_until_repaired(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()

    def score(article, value, label="positive"):
        return {"article_id": article, "processing_method": "m", "sentiment_score": value and Decimal(value), "confidence": Decimal("0.5"),
                "sentiment_label": label, "published_date": AS_OF.date()}

    store.add_scores(table(spark, SCORES, [score("1", "0.5"), score("2", "1.5"), score("3", None), score("4", "0", "odd")]))
    assert [r.article_id for r in store.news().scores.collect()] == ["1"]
    assert sorted(r.reason for r in store.rejects.table().collect()) == ["sentiment_label in enum", "sentiment_score in -1..1", "sentiment_score not null"]
    store.add_scores(table(spark, SCORES, [score("2", "0.15"), score("3", "0.1"), score("4", "0", "neutral")]))
    assert sorted(r.article_id for r in store.news().scores.collect()) == ["1", "2", "3", "4"] and store.rejects.table().count() == 0


def test_a_run_takes_new_files_only(spark, land, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    new = lambda *a, **k: ingest.run_new(spark, folder, *a, **k)
    folder = land("a.json", *CALLS[:1])
    first = taken(spark, store, folder, new)
    assert first.success and first.articles_fetched == 2 and first.articles_added == 2
    land("b.json", *CALLS[1:])
    second = taken(spark, store, folder, new)
    assert second.articles_fetched == 5 and second.articles_known == 1  # u2; a.json is not opened again
    third = taken(spark, store, folder, new)
    assert not third.success and third.articles_fetched == 0 and third.errors == []
    whole = Store(spark, str(tmp_path / "whole"))
    taken(spark, whole, folder)
    urls = lambda s: sorted(r.url for r in s.news().articles.collect())
    assert urls(store) == urls(whole) and store.news().scores.count() == whole.news().scores.count()


FACTS = "published_at timestamp, sector string, score decimal(5,4), confidence decimal(5,4), label string"


def test_closed_days_late_rows_and_bounded_state(spark, tmp_path):
    day, half = datetime(2025, 1, 1, 12), Decimal("0.5")
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    fact = lambda d, h=0, s="T", v="0.5": (day + timedelta(days=d, hours=h), s, Decimal(v), half, "positive")
    batches = [[fact(0), fact(0, 1, "H", "-1")], [fact(1), fact(2), fact(0, 2)], [fact(0, 3), fact(3), fact(4), (None, "T", half, half, "positive")],
               [fact(1, 1), fact(2, 1), fact(4, 1)], [fact(k) for k in range(5, 9)], [fact(3, 5), fact(9)]]
    rows, late, closed, mark, states = [], [], {}, None, []
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, FACTS).coalesce(1).write.parquet(f"{src}/{number}")
        stream = spark.readStream.schema(FACTS).option("recursiveFileLookup", "true").parquet(src)
        query = trends.write_closed_trends(stream, out, checkpoint, every=None)
        query.awaitTermination()
        states += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
        end = lambda r: datetime(r[0].year, r[0].month, r[0].day) + timedelta(days=1)
        for r in (r for r in batch if r[0]):
            (late if mark and end(r) <= mark - timedelta(days=1) else rows).append(r)
        mark = max([mark or day, *(r[0] for r in batch if r[0])])
    for r in (r for r in rows if end(r) <= mark - timedelta(days=1)):
        closed.setdefault((r[0].date(), r[1]), []).append(r[2])
    found = {(r.date, r.sector): (r.total_articles, r.avg_sentiment, r.positive_articles) for r in trends.closed_trends(spark, out).collect()}
    assert found == {k: (len(v), float(sum(v)) / len(v), len(v)) for k, v in closed.items()} and len(found) > 5
    assert sorted(map(tuple, trends.late_rows(spark, out).collect())) == sorted(late) and late
    assert states and max(states) <= 6  # open days and sectors, though ten days went through
    assert spark.conf.get("spark.sql.streaming.statefulOperator.allowMultiple") == "true"
