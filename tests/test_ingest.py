import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsignal.functions.dates import parse_iso
from newsignal.model import RAW_ARTICLE, tracked_companies
from newsignal.operators import ingest, linking
from newsignal.sources import feeds

AS_OF = datetime(2025, 11, 18, 12, 0)


def article(**kw):
    base = {"title": "T", "description": "D", "content": "C", "url": "u", "source": {"name": "S"},
            "publishedAt": "2025-11-18T10:00:00Z", "author": "A"}
    return {**base, **kw}


@pytest.fixture
def payloads(spark, tmp_path):
    def write(*lines):
        (tmp_path / "p.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
        return feeds.read_payloads(spark, str(tmp_path))

    return write


def call(**kw):
    return {"status": "ok", "fetched_at": "2025-11-18T11:00:00Z", "articles": [article()], **kw}


def test_feeds_isolate_failures(payloads):
    p = payloads(call(company="TestCo"), call(sector="technology"), '{"status": "ok", "artic',
                 {"status": "error", "company": "X", "message": "no key"}, {"company": "Y"})
    (c,) = feeds.company_feed(p).collect()
    assert (c.title, c.company_search_term, c.ordinal) == ("T", "TestCo", 0)
    assert [r.company_search_term for r in feeds.sector_feed(p).collect()] == ["sector:technology"]
    errors = sorted(r.error for r in feeds.rejects(p).collect())
    assert errors == ["API error: Unknown error", "API error: no key", "malformed payload"]


def test_required_and_normalized(spark):
    raw = spark.createDataFrame([
        article(), article(title=""), article(url=None), article(publishedAt=""), article(title=" "),
        article(description=None, content=None, source=None, author="", title=" x \n", url=" v "),
    ], RAW_ARTICLE)
    kept = ingest.with_required_fields(raw)
    assert kept.count() == 3
    last = ingest.normalize(kept, AS_OF).collect()[-1]
    assert (last.title, last.description, last.content, last.url, last.source, last.author) == ("x", "", "", "v", "Unknown", None)


def test_dates(spark):
    texts = ["2025-11-18T10:00:00Z", "2025-11-18T12:00:00+02:00", "2025-11-18T10:00:00.5", "2025-11-18", "soon",
             "12:30", "T07:00", "2024", "2024-1-5", "2025-11-18 10:00"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(parse_iso(F.col("t"), F.lit(AS_OF).cast("timestamp"))).collect()]
    ten = datetime(2025, 11, 18, 10)
    assert got == [ten, ten, ten.replace(microsecond=500000), datetime(2025, 11, 18), AS_OF, *[AS_OF] * 4, ten]


def test_first_seen_wins(spark):
    rows = [("u", 2, "late"), ("u", 1, "first"), (None, 0, "x"), ("", 0, "y"), ("v", 5, "only")]
    df = spark.createDataFrame(rows, "url string, seen int, title string")
    once = ingest.dedupe_by_url(df, ["seen"])
    assert sorted(r.title for r in once.collect()) == ["first", "only"]
    assert sorted(ingest.dedupe_by_url(once, ["seen"]).collect()) == sorted(once.collect())


def test_union_keeps_repeats_between_feeds(spark):
    schema = "url string, fetched_at int, company_search_term string, ordinal int"
    company = spark.createDataFrame([("u", 1, "A", 0), ("u", 2, "B", 0)], schema)
    sector = spark.createDataFrame([("u", 1, "sector:t", 0), ("u", 2, "sector:t", 1)], schema)
    assert ingest.union_feeds(company, sector).count() == 3


def test_search_language_lookback_newest(spark):
    companies = spark.createDataFrame([("Apple Inc.", "Tech"), ("Apple Pie", "Food")], "name string, sector string")
    docs = spark.createDataFrame([(1, "APPLE stock"), (2, "apple tree"), (3, "pineapple market")], "id int, text string")
    terms = ingest.company_terms(companies)
    assert [r.term for r in terms.collect()] == ["apple"]
    assert sorted(r.id for r in ingest.search(docs, terms).collect()) == [1, 3]
    assert sorted(r.term for r in ingest.sector_terms(companies).collect()) == ["food", "tech"]
    assert ingest.in_language(docs.withColumn("language", F.lit("de"))).count() == 0
    times = spark.createDataFrame([(1, datetime(2025, 11, 17)), (2, datetime(2025, 11, 16, 23, 59))], "id int, published_at timestamp")
    assert [r.id for r in ingest.within_lookback(times, 24, AS_OF).collect()] == [1]
    many = spark.createDataFrame([("t", AS_OF - timedelta(hours=i % 12), f"u{i:02}") for i in range(24)],
                                 "term string, published_at timestamp, url string")
    got = [r.url for r in ingest.newest_per_term(many, 3).orderBy("url").collect()]
    assert got == ["u00", "u01", "u12"]


LINKS = [
    ("Apple Inc.", "x", "Apple Inc."), ("", "Apple releases new iPhone", "Apple Inc."),
    ("", "TSLA stock rises; Tesla shares up", "Tesla Inc."), ("", "a purchase of inc. shares", "Apple Inc."),
    ("", "profit & loss", "JPMorgan Chase & Co."), ("", "metal prices", "Meta Platforms Inc."),
    ("", "shares in brk.a rise", "Berkshire Hathaway"), ("", "weather report", None),
    ("sector:technology", "Johnson family", "Johnson & Johnson"), ("TESLA INC.", "quiet", None),
]


@pytest.mark.parametrize("direct", [1_000, 0])
def test_linking_traps(spark, monkeypatch, direct):
    monkeypatch.setattr(linking, "DIRECT", direct)
    companies = tracked_companies(spark)
    rows = [(i, term, title, "", "") for i, (term, title, _) in enumerate(LINKS)]
    df = spark.createDataFrame(rows, "i int, company_search_term string, title string, description string, content string")
    linked = linking.link_companies(df, companies)
    names = linked.join(companies.select(F.col("id").alias("company_id"), "name"), "company_id")
    assert {r.i: r.name for r in names.collect()} == {i: n for i, (_, _, n) in enumerate(LINKS) if n}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab& \U0001F600?", max_size=12), min_size=1, max_size=6),
       st.lists(st.text("ab&\U0001F600?", min_size=1, max_size=8), min_size=1, max_size=5, unique=True))
def test_containment_against_brute_force(spark, texts, words):
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    keywords = spark.createDataFrame([(w,) for w in words], "term string")
    expected = sorted((i, w) for i, t in enumerate(texts) for w in words if w in t)
    for direct in (1_000, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(linking, "DIRECT", direct)
            got = linking.contained_keywords(docs, F.col("text"), keywords, "term")
            assert sorted((r.id, r.term) for r in got.collect()) == expected


STRICT = [
    ("Apple Inc.", "x", "Apple Inc."), ("", "Apple releases new iPhone", "Apple Inc."), ("", "pineapple stock", None),
    ("", "a purchase of inc. shares", None), ("", "profit & loss", None), ("", "metal prices", None), ("", "shares in BRK.A rise", "Berkshire Hathaway"),
    ("", "brk was a", None), ("", "Hathaway Berkshire", None), ("", "Berkshire, Hathaway!", "Berkshire Hathaway"), ("", "JPMorgan-Chase up", "JPMorgan Chase & Co."),
    ("", "JPMorgan and Chase", None), ("", "Johnson & Johnson; Johnson", "Johnson & Johnson"), ("", "one Johnson", None), ("", "meta platforms", "Meta Platforms Inc."),
    ("", "meta", "Meta Platforms Inc."), ("", "tesla or apple", "Apple Inc."), ("", "tsla and Microsoft", "Microsoft Corporation"), (None, None, None),
]


def test_strict_linking_takes_whole_words_in_a_row(spark):
    companies = tracked_companies(spark)
    rows = [(i, term, title, "", None) for i, (term, title, _) in enumerate(STRICT)]
    df = spark.createDataFrame(rows, "i int, company_search_term string, title string, description string, content string")
    linked = linking.link_companies_strict(df, companies)
    assert linked.columns == linking.link_companies(df, companies).columns
    names = linked.join(companies.select(F.col("id").alias("company_id"), "name"), "company_id")
    assert {r.i: r.name for r in names.collect()} == {i: n for i, (_, _, n) in enumerate(STRICT) if n}
    assert "Python" not in linked._jdf.queryExecution().toString()


def test_strict_linking_against_brute_force(spark):
    rng = random.Random(5)
    words = ["ab", "cd", "ef", "inc", "co"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(12)})
    companies = spark.createDataFrame([(i, i, n, rng.choice(["gh", "ab.cd", "", None])) for i, n in enumerate(names)], "id int, ordinal int, name string, symbol string")
    texts = [" ".join(rng.choices([*words, "x", "abx", "gh"], k=rng.randint(0, 8))) for _ in range(80)]
    df = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "i int, company_search_term string, title string").withColumns(
        {"description": F.lit(None).cast("string"), "content": F.lit("")})
    needles = []
    for r in companies.collect():
        kept = r.name.split()
        while len(kept) > 1 and kept[-1] in linking.LEGAL_FORMS:
            kept.pop()
        needles += [(2, r.ordinal, " ".join(kept)), (3, r.ordinal, (r.symbol or "").replace(".", " "))]
    expected = {i: min(found)[1] for i, t in enumerate(texts) if (found := [n for n in needles if n[2] and f" {n[2]} " in f" {t} "])}
    assert {r.i: r.company_id for r in linking.link_companies_strict(df, companies).collect()} == expected
    plain = linking.link_companies_strict(df, companies, ()).select("i").distinct().count()
    assert 0 < plain <= len(expected)


def test_few_keywords_shuffle_nothing(spark):
    df = spark.createDataFrame([(1, "", "Apple up", "", "")], "i int, company_search_term string, title string, description string, content string")
    plan = linking.contained_keywords(df, F.col("title"), df.select(F.col("title").alias("term")), "term")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_linking_runs_no_python_and_takes_an_empty_list(spark):
    docs = spark.range(3).select("id", F.lit("some text").alias("text"))
    keywords = spark.range(0).select(F.lit("x").alias("term"))
    got = linking.contained_keywords(docs, F.col("text"), keywords, "term")
    assert got.count() == 0 and "Python" not in got._jdf.queryExecution().toString()


def test_strict_linking_of_few_and_of_many_phrases(spark):
    companies = spark.createDataFrame(
        [(i, i, n, s) for i, (n, s) in enumerate([("ab cd", "gh"), ("cd ef ab inc", "ab"), ("ef", "cd.gh"), ("gh gh", None)])],
        "id int, ordinal int, name string, symbol string")
    texts = ["ab-cd", "x cd. EF ab", "abcd ef", "gh gh gh", "cd gh", "cdgh", "", None, "ab ab cd", "ab ab cd"]
    expected = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (8, 0), (9, 0)]
    df = spark.createDataFrame([(i, "", t, None, "") for i, t in enumerate(texts)],
                               "i int, company_search_term string, title string, description string, content string")
    few = linking.link_companies_strict(df, companies)
    assert "explode(phrase" not in (plan := few._jdf.queryExecution().toString()) and "xxhash64" not in plan  # texts are not keyed, placed and joined
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(linking, "DIRECT", 0)
        many = linking.link_companies_strict(df, companies)
        assert "xxhash64" in many._jdf.queryExecution().toString()
    for linked in (few, many):
        assert sorted((r.i, r.company_id) for r in linked.collect()) == expected
