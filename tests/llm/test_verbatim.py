"""Suffix arrays, and the operators built on them: decontamination and periodic runs."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from newsignal.llm import decontamination, runs
from newsignal.llm.suffixes import common_prefixes, suffix_array
from pyspark.sql import functions as F

SYMBOLS = st.one_of(
    st.lists(st.integers(0, 2), max_size=60),
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 12), st.lists(st.integers(0, 3), max_size=5)).map(
        lambda x: x[0] * x[1] + x[2] + x[0] * x[1]))


@given(SYMBOLS, st.sampled_from([None, 1, 2, 5]))
@settings(max_examples=200, deadline=None)
def test_suffixes_are_in_order(symbols, depth):
    order = suffix_array(np.array(symbols, np.int64), depth).tolist()
    key = lambda i: symbols[i : i + depth] if depth else symbols[i:]
    assert sorted(order) == list(range(len(symbols)))
    assert all(key(i) <= key(j) for i, j in zip(order, order[1:]))
    if depth is None:
        def shared(i, j):
            return next((k for k in range(len(symbols)) if max(i, j) + k >= len(symbols) or symbols[i + k] != symbols[j + k]), 0)

        assert common_prefixes(symbols, order) == ([0] * bool(order)) + [shared(i, j) for i, j in zip(order, order[1:])]


def plain_runs(words, least):
    """All maximal stretches with a period, by trying every period."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 3 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


@given(SYMBOLS, st.sampled_from([3, 4, 6, 9, 24]))
@settings(max_examples=300, deadline=None)
def test_runs_match_a_search_over_all_periods(symbols, least):
    assert runs.text_runs(np.array(symbols, np.int64), least) == plain_runs(symbols, least)


def looped(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_report(doc_id, text):
    words = looped(doc_id, text)
    found = plain_runs(words, 24)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_report_matches_brute_force(spark, docs, prose):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.choice([5, 30, 200]))) for i in range(60)]
    rows += [(100 + i, " ".join([*prose(i, 9).split(), *(prose(i, rng.randint(1, 9)).split() * rng.randint(2, 30)), *prose(i + 1, 9).split()])) for i in range(40)]
    rows += [(200, "a " * 3_000), (201, "x y " * 40 + "z " + "x y " * 40), (202, None), (203, ""), (204, " \n\t"), (205, "é é " * 30),
             (None, "a b c " * 12), (None, None), (206, "one\ntwo\fthree\x0bfour\r" * 7), (201, "x y " * 40), (201, "x y " * 40), (207, prose(5, 9) + " w" * 23)]
    ids = {i for i, _ in rows}
    assert any(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)
    table = docs(rows).withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(1))
    found = [tuple(r) for r in runs.run_report(table).collect()]
    assert sorted(map(repr, found)) == sorted(repr(plain_report(*r)) for r in rows)
    assert runs.run_report(docs([])).collect() == []


def test_runs_and_collapsed_text(spark, docs):
    found = runs.periodic_runs(docs([(1, "so " + "no no yes " * 9 + "end")]), ("doc_id", "source")).collect()[0]
    assert (found.source, found.n_words, found.collapsed) == ("src", 29, "so no no yes end")
    assert [tuple(r) for r in found.runs] == [(1, 27, 3)]
    with pytest.raises(ValueError):
        runs.periodic_runs(docs([]), ("doc_id",), least=2)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(doc, items, window):
    words, hit, named = cut(doc), set(), set()
    for item, text in items:
        own = cut(text)
        size = min(window, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        places = [k for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in grams]
        hit |= {k + x for k in places for x in range(size)}
        named |= {str(item)} if places and item is not None else set()
    return words, hit, sorted(named)


def bench_rows(prose):
    items = [(i, prose(1_000 + i, 14 + i)) for i in range(12)] + [(20, "Short item, only!"), (21, None), (22, " - "), (None, prose(1_500, 12))]
    return items + [(3, prose(1_600, 11)), (30, items[4][1]), (31, "a " * 15), (32, prose(1_004, 18) + " tail of another one")]


def contaminated_rows(prose):
    items = [t for _, t in bench_rows(prose) if t]
    rows = [(i, prose(i, 60)) for i in range(20)]
    rows += [(100 + i, prose(i, 20) + " " + " ".join(t.upper().split()[i % 3 : 13]) + "! " + prose(i + 1, 7)) for i, t in enumerate(items)]
    rows += [(200, "A, a; a-a a\na a a a a a a"), (201, "my short ITEM -- only this"), (202, None), (203, ""), (204, "?!"), (None, items[1]), (100, items[2]),
             (205, prose(9, 30_000) + " " + items[5]), (206, items[4] + " " + items[5]), (206, items[4] + " " + items[5]), (207, "é " + items[6].replace(" ", "  "))]
    return rows


@pytest.mark.parametrize("block", [decontamination.BLOCK, 150])
def test_hits_match_brute_force(spark, docs, prose, block):
    items, rows = bench_rows(prose), contaminated_rows(prose)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    found = decontamination.verbatim_matches(docs(rows), benchmark, ("doc_id", "source"), block=block).collect()
    shown = []
    for r in found:
        places = {k for s in r.spans for k in range(s.start, s.start + s.length)}
        shown.append(repr((r.doc_id, r.n_words, sorted(places), r["items"])))
    expected = []
    for i, text in rows:
        words, hit, named = plain_hits(text, items, 10)
        expected.append(repr((i, len(words), sorted(hit), named)))
    assert sorted(shown) == sorted(expected)


def test_matches_are_the_longest(spark, docs, prose):
    items, rows = bench_rows(prose), contaminated_rows(prose)
    found = decontamination.verbatim_matches(docs(rows), spark.createDataFrame(items, "item_id bigint, text string"), ("doc_id", "text")).collect()
    for r in found:
        words = cut(r.text)
        reach = {}
        for m in r.matches:
            own = [cut(t) for i, t in items if (None if i is None else str(i)) == m.item]
            part = words[m.start : m.start + m.length]
            assert any(part == w[k : k + len(part)] for w in own for k in range(len(w)))
            longer = words[m.start : m.start + m.length + 1]
            assert len(longer) == len(part) or not any(longer == w[k : k + len(longer)] for w in map(cut, (t for _, t in items)) for k in range(len(w)))
            reach |= {k: True for k in range(m.start, m.start + m.length)}
        assert all(k in reach for s in r.spans for k in range(s.start, s.start + s.length))


def test_report_equals_its_sql_and_removal_keeps_clean_documents(spark, docs, prose):
    items, rows = bench_rows(prose), contaminated_rows(prose)
    benchmark, table = spark.createDataFrame(items, "item_id bigint, text string"), docs(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    report = decontamination.contamination_report(table, benchmark)
    want = con.execute(decontamination.REPORT_SQL)
    assert [c[0] for c in want.description] == report.columns
    assert sorted(repr(tuple(r)) for r in report.collect()) == sorted(map(repr, want.fetchall()))
    clean = decontamination.decontaminated(table.withColumn("spans", F.lit(7)), benchmark)
    assert clean.columns == [*table.columns, "spans"]
    left = sorted(repr((r.doc_id, r.text)) for r in clean.collect())
    assert left == sorted(repr(r) for r in rows if not plain_hits(r[1], items, 10)[1])


def test_decontamination_of_empty_tables(spark, docs, prose):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination_report(docs([]), none).collect() == []
    one = decontamination.contamination_report(docs([(1, prose(1))]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated, r.items_sha256) for r in one] == [(40, 0, False, hashlib.sha256(b"").hexdigest())]
    with pytest.raises(ValueError):
        decontamination.verbatim_matches(docs([]), none, ("doc_id", "n_words"))
