import random
from collections import Counter
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsignal.functions.text import analysis_text, clean, ngrams, strip, words
from newsignal.operators import scoring
from newsignal.operators.lexicons import LEXICON_SCHEMA, NEGATIVE_WORDS, POSITIVE_WORDS, STOP_WORDS, finance_lexicon
from newsignal.operators.scoring import KeywordLists


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r[0] for r in df.orderBy("id").select(expression(F.col("text"))).collect()]


def test_word_lists():
    assert (len(POSITIVE_WORDS), len(NEGATIVE_WORDS)) == (20, 18)
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) and {"up", "down"} <= set(STOP_WORDS)


def test_clean(spark):
    got = column(spark, [
        "see https://a.example/x?y=1 now", "mail me@b.example today", "a\n\t b c", "café ½ $5 (x) “q”",
        "  a & b  ", "x_y-z; ok: yes? no!",
    ], clean)
    assert got == ["see now", "mail today", "a b c", "café ½ 5 x q", "a  b", "x_y-z; ok: yes? no!"]


def test_words(spark):
    got = column(spark, ["Growth. growth.rise top-line q3 rise--fall Profit... Été, a_b .x. don't"], words)
    assert got == [["growth", "rise", "fall", "profit", "été", "x", "dont"]]


def test_strip_and_analysis_text(spark):
    assert column(spark, ["　 a "], strip) == ["a"]
    long = "A" * 3000
    df = spark.createDataFrame([("t", "d", long), ("t", "", None), ("", None, "c")], "t string, d string, c string")
    got = [r[0] for r in df.select(analysis_text(F.col("t"), F.col("d"), F.col("c"), 2000)).collect()]
    assert got == ["t t d " + "A" * 2000 + "...", "t t", "c"]
    whole = df.limit(1).select(analysis_text(F.col("t"), F.col("d"), F.col("c"))).first()[0]
    assert whole == "t t d " + long


GOLDENS = [
    ("ACME posts record profits and strong growth this quarter. Investors are optimistic.", 1.0, 0.3, "positive"),
    ("ACME missed earnings, issued a weak outlook and faces significant risk ahead.", -1.0, 0.2, "negative"),
    ("growth and loss", 0.0, 0.2, "neutral"),
    ("strong strong weak", 1 / 3, 0.3, "positive"),
    ("profits missed", 0.0, 0.0, "neutral"),
    ("shares go up", 0.0, 0.0, "neutral"),
    ("growth " * 12, 1.0, 1.0, "positive"),
    ("gain rise rally loss fall", 0.2, 0.5, "neutral"),
]


def test_keyword_goldens(spark):
    df = spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDENS)], "id int, text string")
    alone = {r.id: r.keywords for r in scoring.score_keywords(df).collect()}
    together = {r.id: r.keywords for r in scoring.score_methods(df, finance_lexicon(spark)).collect()}
    for i, (_, score, confidence, label) in enumerate(GOLDENS):
        assert alone[i].score == pytest.approx(score) and alone[i].confidence == pytest.approx(confidence)
        assert alone[i].label == label and together[i] == alone[i]


@pytest.fixture(scope="module")
def lexicon(spark):
    from decimal import Decimal as D

    rows = [("good", D("0.7"), D("0.6"), D("1.9")), ("bad", D("-0.7"), D("0.66"), D("-2.5")), ("fact", None, None, None)]
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def test_polarity_and_valence(spark, lexicon):
    df = spark.createDataFrame([(1, "good good bad day"), (2, "plain fact"), (3, "&")], "id int, text string")
    got = {r.id: r for r in scoring.score_methods(df, lexicon).collect()}
    assert got[1].polarity.score == pytest.approx(0.7 / 3) and got[1].polarity.confidence == pytest.approx(1 - 1.86 / 3)
    s = 1.9 * 2 - 2.5
    assert got[1].valence.score == pytest.approx(s / (s * s + 15) ** 0.5)
    assert got[1].valence.confidence == pytest.approx(5.8 / (5.8 + 3.5 + 1)) and got[1].valence.label == "positive"
    assert (got[2].polarity.score, got[2].polarity.confidence, got[2].valence.confidence) == (0, 1, 1)
    assert (got[3].valence.score, got[3].valence.confidence) == (0, 0)          # nothing left after cleaning


@pytest.mark.parametrize("parts,expected", [
    ([(0.5, 0.6, "positive"), (0.8, 0.7, "positive"), (1.0, 0.3, "positive")], (0.72, 0.58, "positive")),
    ([(0.3, 0.5, "positive"), (-0.9, 0.6, "negative"), (0.0, 0.0, "neutral")], (-0.24, 0.44, "positive")),
    ([(0.0, 0.5, "neutral"), (-0.2, 0.5, "negative"), (1.0, 0.1, "positive")], (0.12, 0.42, "negative")),
])
def test_ensemble_goldens(spark, parts, expected):
    structs = [F.struct(F.lit(s).alias("score"), F.lit(c).alias("confidence"), F.lit(v).alias("label")) for s, c, v in parts]
    got = spark.range(1).select(scoring.combined_result(*structs).alias("r")).first().r
    assert (got.score, got.confidence) == (pytest.approx(expected[0]), pytest.approx(expected[1]))
    assert got.label == expected[2]


def test_blank_texts(spark, lexicon):
    df = spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, "good")], "id int, text string")
    assert [r.id for r in scoring.score_texts(df, lexicon).collect()] == [4]
    batch = {r.id: r for r in scoring.analyze_batch(df, lexicon).collect()}
    assert len(batch) == 4 and batch[4].method == "combined"
    assert all(batch[i][1:] == ("unknown", 0.0, 0.0, "neutral") for i in (1, 2, 3))


def test_a_lexicon_too_large_to_broadcast_gives_the_same(spark, lexicon, monkeypatch):
    df = spark.createDataFrame([(1, "good bad"), (2, "none")], "id int, text string")
    expected = sorted(scoring.score_texts(df, lexicon).collect())
    monkeypatch.setattr(scoring, "broadcast_if_small", lambda d: d)
    assert sorted(scoring.score_texts(df, lexicon).collect()) == expected


def test_key_phrases(spark):
    df = spark.createDataFrame([(1, "Solar Power grows. the solar power grows"), (2, "one")], "id int, text string")
    got = [(r.id, r["rank"], r.phrase, r.n) for r in scoring.key_phrases(df, num_phrases=3).orderBy("id", "rank").collect()]
    assert got == [(1, 1, "power grows", 2), (1, 2, "solar power", 2), (1, 3, "solar power grows", 2)]


def test_ngrams_of_short_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(ngrams(F.col("w"), (2, 3))).collect()] == [["a b", "a b c", "b c"], [], []]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="good bad.,-!?\n&", max_size=40), min_size=1, max_size=8))
def test_scores_stay_in_range(spark, lexicon, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    result = scoring.score_texts(df, lexicon, lists=KeywordLists(("good",), ("bad",))).collect()
    assert len(result) == sum(bool(t.strip()) for t in texts)
    for r in result:
        assert -1 <= r.sentiment_score <= 1 and 0 <= r.confidence <= 1
        assert r.sentiment_label in ("positive", "negative", "neutral")


def test_key_phrases_are_counted_within_the_row(spark):
    rng = random.Random(3)
    rows = [(i % 25 if i < 30 else None, " ".join(rng.choices(["ab", "cd", "the", "ef"], k=rng.randint(0, 40))) if i % 7 else None) for i in range(33)]
    df = spark.createDataFrame(rows, "id int, text string")
    expected = []
    for key in {k for k, _ in rows}:
        n = Counter()
        for t in (t.split() for k, t in rows if k == key and t):
            for size in (2, 3, 4):
                n.update(" ".join(run) for i in range(len(t) - size + 1) if "the" not in (run := t[i : i + size]))
        first = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:3]
        expected += [(key, i, p, c) for i, (p, c) in enumerate(first, 1)]
    found = scoring.key_phrases(df, num_phrases=3, stop_words=["the"])
    got = [(r.id, r["rank"], r.phrase, r.n) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    # A text without repeats of its id passes on three phrases, not all of them.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("_counts") < plan.index("Window [count")
