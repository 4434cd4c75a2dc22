import copy
import os
import re
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from newsignal import session
from newsignal.llm import jaccard, langid, toxicity
from newsignal.llm.batches import lean
from newsignal.llm.hashing import TextWords, in_chunks
from pyspark.sql import functions as F

LETTERS = {"aa": "abcde", "bb": "éèçàa", "cc": "üößtz"}


def multilingual(prose, n=120, words=40):
    langs = list(LETTERS)
    return [(i, prose(i, words, LETTERS[langs[i % 3]]), langs[i % 3]) for i in range(n)]


def test_equal_words_hash_equal_and_others_do_not():
    texts = [b"one two one", b"", b"  two\n", "é two".encode()]
    words = TextWords(texts)
    assert words.bounds.tolist() == [0, 3, 3, 4, 6]
    h = words.hashes
    assert h[0] == h[2] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 3
    assert [len(c) for c in in_chunks([b"a" * 10] * 5, 20)] == [2, 2, 1]


def test_languages_are_learned_and_held_out(spark, docs, prose):
    rows = multilingual(prose) + [(900, None, "aa"), (901, "123 !", "bb"), (902, "", "cc"), (903, prose(5, 30, LETTERS["bb"]), None), (None, prose(6, 30, LETTERS["cc"]), "aa")]
    rows += [rows[0], (904, prose(7, 30_000, LETTERS["aa"]), "aa")]
    found = langid.identify(docs(rows)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:120])
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "bb", "cc", "aa"]
    folds = dict(docs(rows).select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4).collect())
    assert all(r.held_out == (folds[r.doc_id] == 2) for r in found)


def test_language_without_rows_or_with_one_language(spark, docs):
    assert langid.identify(docs([])).collect() == []
    only = langid.identify(docs([(i, "some text here", "en") for i in range(8)])).collect()
    assert all(r.lang_pred == "en" and r.score == 1 for r in only)
    none = langid.identify(docs([(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_l1_penalty_leaves_weights_at_zero(docs, prose):
    model = langid.train(docs(multilingual(prose)))
    assert (model.weights == 0).mean() > 0.5 and 0.05 <= model.temperature <= 20


def toxic_rows(prose, n=400):
    marks = {"aa": ["blorg", "zonk"], "bb": ["vequta", "vequ"], "cc": ["lostra"]}
    rows, labels = [], []
    for i, text, lang in multilingual(prose, n):
        bad = i % 4 == 0
        words = text.split()
        for k in (3, 17, 30) if bad else ():
            words[k] = marks[lang][(i + k) % len(marks[lang])] + ("" if lang == "aa" else "xyz"[i % 3])
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxic_words_are_learned(spark, docs, prose):
    rows, labels = toxic_rows(prose)
    rows += [(5_000, None, "aa"), (5_001, "", "bb"), (None, "blorg", "aa"), (5_002, "word " * 9_000, None), rows[0]]
    table = spark.createDataFrame(labels + [(0, 1, 0), (1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(docs(rows), table).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    truth = {i: t for i, _, t in labels}
    held = [(truth[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.93


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs([(1, "a"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs([]), none).collect() == []


LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 90 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def near_copies(prose, seed, n, words, edits):
    rng = np.random.default_rng(seed)
    base = prose(seed, words).split()
    out = []
    for k in range(n):
        copy = list(base)
        for at in rng.choice(words, rng.integers(0, edits + 1), replace=False):
            copy[at] = f"new{k}x{at}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("common, block, leaf", [(32, 1_024, 128), (2, 8, 4)])
def test_components_match_brute_force(spark, docs, prose, monkeypatch, common, block, leaf):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    texts = [t for s in range(3) for t in near_copies(prose, s, 30, 80 + 40 * s, 5)]
    chain = prose(50, 300).split()
    for k in range(12):
        chain = [*chain[:10 * k], *(f"c{k}{i}" for i in range(5)), *chain[10 * k + 5 :]]
        texts.append(" ".join(chain))
    passage = prose(60, 60)
    texts += [passage + " " + prose(70 + k, 70) for k in range(40)]
    texts += ["Same Text here", "same text HERE", "same text here ", "two words", "Two words", "one", "", " \n", None, "word " * 5_000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, texts[0]), (7, texts[0]), (None, texts[1]), (None, "never seen before by anyone")]
    found = [tuple(r) for r in jaccard.jaccard_components(spark, docs(rows)).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_components(rows)))


def test_steps_of_components_read_links_a_few_times_only(spark, monkeypatch):
    """Paths, stars and rings become stars of their smallest member; no step has a plan of many scans, which would fill the driver."""
    random, plans, keep = np.random.default_rng(3), [], jaccard.Tables.keep

    def kept(tables, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(tables, df)

    monkeypatch.setattr(jaccard.Tables, "keep", kept)
    name = (random.permutation(200) - 100).tolist()
    path, star, ring = [(i, i + 1) for i in range(60)], [(70, i) for i in range(71, 100)], [(100 + i, 100 + (i + 1) % 40) for i in range(40)]
    ends = [(name[a], name[b]) for a, b in path + star + ring + [(150, 150), (160, 161), (161, 160)]]
    found = jaccard.components(spark.createDataFrame(ends, "a bigint, b bigint"), jaccard.Tables(spark)).collect()
    expected = []
    for group in (range(61), range(70, 100), range(100, 140), (160, 161)):
        least, *others = sorted(name[i] for i in group)
        expected += [(x, least) for x in others]
    assert sorted((r.own, r.root) for r in found) == sorted(expected)
    assert len(plans) > 2 and max(plan.count("FileScan") for plan in plans[1:]) <= 4


def test_garbage_of_the_driver_is_collected_between_steps(spark, monkeypatch):
    """Without, its heap grows to the limit, however little of it is in use."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: next(b.getCollectionCount() for b in beans if b.getName() == "G1 Old Generation")
    links = [(a, a + 1) for a in range(12)]
    counts = []
    for share in (1.0, 0.0):
        monkeypatch.setattr(session, "HEAP_SHARE", share)
        before, tables = collected(), jaccard.Tables(spark)
        found = jaccard.components(spark.createDataFrame(links, "a bigint, b bigint"), tables).collect()
        assert sorted(map(tuple, found)) == [(a, 0) for a in range(1, 13)]
        assert len({path for _, path in tables.paths.values()}) == 1  # plans of tables that are gone are not held
        counts.append(collected() - before)
    assert counts[1] >= counts[0] + 4  # once at least for each step


def test_workers_give_back_what_a_task_has_freed():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def hoarding(batches):
        taken = [np.ones(4_000) for _ in range(4_000)]  # 128 MB in pieces that the C library keeps at hand
        held.append(taken.pop())
        yield from batches

    held, first = [], resident()
    assert list(lean(hoarding)([1, 2])) == [1, 2]
    assert resident() < first + 40


def test_components_of_an_empty_table(spark, docs):
    assert jaccard.jaccard_components(spark, docs([])).collect() == []


def test_recursive_regions_lose_no_pair(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = np.random.default_rng(0)
    centres = rng.poisson(20, (5, jaccard.CELLS))
    cells = np.concatenate([c + rng.integers(0, 2, (40, jaccard.CELLS)) * (rng.random((40, 1)) < 0.5) for c in centres]).astype(np.int32)
    sizes, groups = cells.sum(axis=1), np.arange(len(cells)) % 7
    want = {(i, j) for i in range(len(cells)) for j in range(i + 1, len(cells)) if groups[i] != groups[j] and 190 * np.abs(cells[i] - cells[j]).sum() <= 10 * (sizes[i] + sizes[j])}
    assert {tuple(sorted(p)) for p in jaccard.region_pairs(sizes, cells, groups).tolist()} == want and want


def test_pipeline_keeps_clean_documents(spark, tmp_path, prose):
    rows, labels = toxic_rows(prose)
    table = [(i, t, lang, "s", len(t)) for i, t, lang in rows] + [(2_000, rows[1][1], "bb", "s", 1), (2_001, "!!", "aa", "s", 2), (2_002, None, None, None, None)]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/sf/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "jaccard_join", "packing"]
    found = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()}
    clean, bad = {i for i, _, t in labels if not t}, {i for i, _, t in labels if t}
    assert not {2_000, 2_001, 2_002} & found
    assert len(clean & found) > 0.95 * len(clean) and len(bad & found) < 0.05 * len(bad)


def test_the_near_copy_stage_follows_its_own_rule(spark, docs, prose):
    rows = [(100 * s + k, t) for s in range(6) for k, t in enumerate(near_copies(prose, 200 + s, 12, 100 + 30 * s, 5))]
    grams = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    threes = {i: set(zip(*(t.split()[k:] for k in range(3)))) for i, t in rows}
    alike = lambda sets, a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    least = {i: i for i, _ in rows}
    for _ in rows:  # until the smallest id has gone through every chain
        least = {i: min(least[j] for j in grams if alike(grams, i, j) >= 0.8) for i in grams}
    assert any(0.8 <= alike(grams, a, b) < 0.9 and alike(threes, a, b) < 0.9 for a in grams for b in grams)
    found = [r.doc_id for r in corpus_pipeline.near_copies(spark, docs(rows), "").collect()]
    assert sorted(found) == sorted(set(least.values()))


@pytest.mark.parametrize("words, share", [(1, 50), (5, 80), (2, 100)])
def test_components_by_other_rules(spark, docs, prose, words, share):
    texts = [t for s in range(2) for t in near_copies(prose, 300 + s, 15, 60, 8)] + ["a b c d", "A b c d", "a b c", "", None]
    sets = [set(zip(*(w[k:] for k in range(words)))) or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min([least[i], *(least[j] for j, b in enumerate(sets) if a and 100 * len(a & b) >= share * len(a | b))]) for i, a in enumerate(sets)]
    found = jaccard.jaccard_components(spark, docs(list(enumerate(texts))), words, share).collect()
    assert sorted(tuple(r) for r in found) == [(i, len(a), least[i]) for i, a in enumerate(sets)]


def test_near_copies_go_by_row(spark, docs, prose):
    a, b, c, d, e, f = (prose(400 + k, 80) for k in range(6))
    stay = [(1, a), (1, b), (3, c), (None, d), (4, ""), (4, ""), (None, None), (None, None), (5, f)]
    go = [(2, a), (3, b), (None, d), (None, a + " more"), (5, f), (5, f)]
    found = corpus_pipeline.near_copies(spark, docs([*stay, *go, (None, e), (None, e + " more")]), "").collect()
    either = [(r.doc_id, r.text) for r in found if r.text in (e, e + " more")]
    assert len(either) == 1
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found))) == sorted(map(repr, stay + either))


def test_a_repeated_id_is_sampled_once(spark, docs, prose):
    table = docs(multilingual(prose))
    rows = langid.training_rows(table)
    first = rows.orderBy(F.xxhash64("doc_id")).limit(1).collect()[0]
    many = [(first.doc_id, prose(500 + k, 20, LETTERS[first.lang]), first.lang) for k in range(60)]
    more = table.select("doc_id", "text", "lang").union(docs(many).select("doc_id", "text", "lang"))
    plain, repeated = (langid.sample_features(langid.training_rows(t), 12) for t in (table, more))
    assert [lang for lang, _, _ in repeated] == [lang for lang, _, _ in plain] and len(repeated) == 12
    assert sum((a[2].tobytes() != b[2].tobytes()) for a, b in zip(plain, repeated)) <= 1
    labels = table.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    chosen = [[r.doc_id for r in toxicity._sampled(t, labels, {0: 50, 1: 50}).collect()] for t in (table, more)]
    assert sorted(chosen[0]) == sorted(chosen[1]) and len(set(chosen[1])) == len(chosen[1])


def test_a_sample_is_cut_down_by_slices_and_stays_the_same(spark):
    ids = spark.range(5_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "rare").otherwise("usual").alias("lang"), F.xxhash64("id").alias("key"))
    few = langid.lowest(ids, "lang", 60).collect()
    for lang, most in (("rare", 100), ("usual", 80)):
        every = sorted(r.key for r in ids.collect() if r.lang == lang)[:60]
        held = sorted(r.key for r in few if r.lang == lang)
        assert held[: len(every)] == every and len(held) <= most


def test_toxicity_is_learned_from_all_rows(spark, docs, prose):
    """The network starts from 12 rows; the words of the others, languages and thresholds come from the rest, in several shards."""
    rows, labels = toxic_rows(prose)
    table = spark.createDataFrame([(i, 1, t) for i, _, t in labels], "doc_id bigint, quality int, toxic int")
    few = {1: 6, 0: 6}
    start, whole = (toxicity.train(docs(rows), table, few, shard=70, rounds=n) for n in (0, 10))
    assert (start.table != whole.table).any(axis=1).mean() > 0.9 and (start.weights != whole.weights).any()
    assert whole.languages == ["aa", "bb", "cc"]
    truth = {i: t for i, _, t in labels}

    def errors(model):
        found = toxicity.score(docs(rows).filter(toxicity.fold(F.col("doc_id")) == 2), model).collect()
        return sum((r.score >= toxicity.THRESHOLD) != truth[r.doc_id] for r in found) / len(found)

    assert errors(whole) < 0.1 and errors(whole) < errors(start)


def test_a_threshold_counts_all_rows():
    logits, toxic, rows = np.array([2.0, 1.0, 0.0]), np.array([3, 5, 1]), np.array([3, 6, 90])
    assert toxicity._best_threshold(logits, toxic, rows) == 0.5
    assert toxicity._best_threshold(logits, 0 * toxic, rows) is None


def test_what_the_network_learns_from_is_small_where_it_is_shuffled(spark, docs, prose):
    """Word numbers are pressed, and of the texts without a label few go on to the join."""
    table = docs([(i, prose(i, 400)) for i in range(200)])
    marks = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert 40 <= toxicity._maybe_marked(table, marks).count() < 60
    rows = toxicity._numbered(toxicity._texts(toxicity._maybe_marked(table, marks), marks)).collect()
    texts = {r.key: r.text for r in table.select(F.xxhash64("doc_id").alias("key"), "text").collect()}
    assert len(rows) == 40
    for r in rows:
        words, (full, stem) = toxicity.Words([texts[r.key]]), toxicity._unpressed(r.words)
        assert full.tolist() == words.full.tolist() and stem.tolist() == words.stem.tolist()
    assert sum(len(r.words) for r in rows) < 0.8 * sum(8 * len(toxicity._unpressed(r.words)[0]) for r in rows)


def test_each_labelled_text_is_shuffled_once_to_its_shard(spark, docs, prose):
    """Rounds read shards as they are: no row is shuffled again, and the networks are those of rows dealt out by key."""
    table = docs([(i, None if i % 11 == 0 else prose(i % 90, 20), "xx") for i in range(100)] + [(7, "a", None), (None, "b", "xx")])
    marks = spark.createDataFrame([(i, i % 2) for i in range(0, 120, 2)] + [(7, 1), (9, 0)], "doc_id bigint, toxic int")
    single = toxicity._numbered(toxicity._texts(table, marks))
    shards = toxicity._sharded(table, marks, 3)
    plan = shards._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(key#") == plan.count("REPARTITION_BY_NUM") == 1
    found = shards.collect()
    assert sorted(r.aside for r in found) == [False] * 3 + [True] * 3
    assert all((key % 5 == 4) == r.aside for r in found for key in r.key)
    rows = [(*x[:3], bytes(x[3])) for r in found for x in zip(r.key, r.toxic, r.lang, r.words)]
    assert sorted(map(repr, rows)) == sorted(repr((r.key, r.toxic, r.lang, bytes(r.words))) for r in single.collect())
    nets = []
    for given in ((single.filter("pmod(key, 5) <> 4"), 3), (shards.filter("not aside"),)):
        sample = sorted((key, toxic, *toxicity._unpressed(words)) for key, toxic, _, words in rows)
        model, past = toxicity._learn([x[1:] for x in sample[:8]], 1, np.full(1 << toxicity.ROW_BITS, toxicity.LEAST_ROWS))
        toxicity._averaged(model, past, *given)
        nets.append(model)
    assert np.allclose(nets[0].table, nets[1].table, atol=1e-6) and np.allclose(nets[0].weights, nets[1].weights, atol=1e-6)


def test_networks_of_shards_are_averaged_over_the_shards_with_a_word(spark):
    """Two shards go on from one network; a row of the table that one of them holds is that one's, others are the mean."""
    texts = [(k, k % 2, f"word{k % 3} {'left' if k < 40 else 'right'} both") for k in range(80)]
    rows = toxicity._numbered(spark.createDataFrame([(k, t, "xx", x) for k, t, x in texts], "doc_id bigint, toxic int, lang string, text string"))
    found = sorted((r.key, r.toxic, *toxicity._unpressed(r.words)) for r in rows.repartition(1).collect())
    held = np.full(1 << toxicity.ROW_BITS, toxicity.LEAST_ROWS)
    model, past = toxicity._learn([x[1:] for x in found[:8]], 1, held)
    parts = [sorted((r[0], r[1], *toxicity._unpressed(r[2])) for r in part) for part in rows.repartition(2, "key").select("key", "toxic", "words").rdd.map(tuple).glom().collect()]
    nets = []
    for part in parts:
        net, squares = copy.deepcopy((model, past))
        toxicity._go_on(net, squares, [x[1:] for x in part], 1, np.random.default_rng(abs(part[0][0])))
        nets.append((net, squares, {int(s) for x in part for y in x[2:] for s in net.slots[y]} - {0}))
    before = model.table.copy()
    toxicity._averaged(model, past, rows, 2)
    for slot in set().union(*(own for _, _, own in nets)):
        mean = np.mean([net.table[slot] for net, _, own in nets if slot in own], axis=0)
        assert np.allclose(model.table[slot], mean, atol=1e-5)
    share = len(parts[0]) / len(texts)
    assert np.allclose(model.weights, share * nets[0][0].weights + (1 - share) * nets[1][0].weights, atol=1e-5)
    others = sorted(set(range(0, len(before), 997)) - set().union(*(own for _, _, own in nets)))
    assert (model.table[others] == before[others]).all()


def test_bits_reach_the_driver_without_an_object_for_each_word(spark, monkeypatch):
    keys = spark.range(3_000).select(F.xxhash64("id").alias("own"))
    members = np.array([r.own for r in keys.collect()], np.int64).view(np.uint64)
    monkeypatch.setattr(type(keys), "collect", lambda _: pytest.fail("collected as objects"))
    bitmap = jaccard.Bitmap(keys, "own")
    assert bitmap.has(members).all() and not bitmap.has(members ^ np.uint64(1 << 20)).all()
