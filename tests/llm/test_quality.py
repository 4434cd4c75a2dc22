import math
import random
import re
from collections import Counter

import xxhash
from newsignal.llm import quality
from pyspark.sql import functions as F

EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three four five six seven eight nine ten"), (5, "one two three four five six seven eight nine ten"),
    (6, "a b c d e f a b c d e g a b c d e"), (7, "x\nx\n\nx y\nx y\n \nz"), (8, "#tag *** |a| <b> & 100% $5"), (9, "é ü 日本 👍 " * 30),
    (None, "no id at all but words enough to be counted here"), (10, "long " * 20_000),
]


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_base_counts_match_a_plain_count(spark, docs):
    found = quality.quality_rules(docs(EDGES), labels(spark, [])).collect()
    assert sorted(map(repr, ((r.doc_id, *r[1:7]) for r in found))) == sorted(repr((i, *expected(t))) for i, t in EDGES)
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in found)  # nobody is trusted


def cell(*words, buckets):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def test_scores_match_brute_force(spark, docs, prose):
    common = prose(7, 300).split()
    good = [(i, " ".join(random.Random(i).choices(common, k=60))) for i in range(30)]
    bad = [(100 + i, prose(i, 60, "ZYXW") + " !!") for i in range(6)]
    rows, buckets = good + bad + [(200, None)], 512
    found = {r.doc_id: r for r in quality.quality_rules(docs(rows), labels(spark, [(i, 1, 0) for i in range(20)] + [(100, 0, 0)]), buckets, -0.1).collect()}
    grams = {i: [cell(w, buckets=buckets) for w in ws] + [cell(a, b, buckets=buckets) for a, b in zip(ws, ws[1:])] for i, t in rows for ws in [(t or "").split()]}
    raw, trusted = Counter(c for g in grams.values() for c in g), Counter(c for i in range(20) for c in grams[i])
    share = sum(trusted.values()) / sum(raw.values())
    for i, g in grams.items():
        total = sum(round(math.log((trusted[c] + 2) / (raw[c] * share + 2)) * 1e6) for c in g)
        assert abs(found[i].score - total / max(len(g), 1) / 1e6) < 1e-6
        assert found[i].kept == (not found[i].base_failed and found[i].score >= -0.1)
    assert min(found[i].score for i, _ in good) > max(found[i].score for i, _ in bad)


def test_no_python_in_the_plan_and_empty_tables(spark, docs):
    df = quality.quality_rules(docs([]), labels(spark, []))
    assert df.collect() == []
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_trusted_texts_are_found_at_any_number_of_bits(spark, docs):
    rows = [(i, f"text {i}") for i in range(40)] + [(3, "again"), (3, "again"), (None, "none"), (5, None)]
    trusted = spark.createDataFrame([(i,) for i in (3, 5, 7, 1_000)], "doc_id bigint")
    for bits in (64, 256, 1 << 16):
        found = quality.trusted_texts(docs(rows), trusted, bits)
        assert sorted(repr(r.text) for r in found.collect()) == sorted(map(repr, ["text 3", "again", "again", "text 5", None, "text 7"]))
    assert quality.trusted_texts(docs(rows), trusted.limit(0), 64).collect() == []


def test_whole_texts_are_not_shuffled_for_the_raw_counts(spark, docs):
    plan = quality.quality_rules(docs([(1, "a b")]), labels(spark, [(1, 1, 0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and "Join LeftOuter, (doc_id" not in plan


def test_every_trusted_document_counts(spark):
    docs = spark.range(40_500).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 97).alias("text"))
    good = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality.trusted_ids(good.union(good)).count() == 40_500
    scores = quality.quality_rules(docs, good).agg(F.min("score"), F.max("score"), F.count("score")).collect()[0]
    assert tuple(scores) == (0, 0, 40_500)  # all are trusted, so both corpora are the same
