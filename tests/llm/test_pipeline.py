"""The pipeline and its near-copy stage on odd tables."""

import corpus_pipeline
import pytest
from newsignal.llm import jaccard

PLAIN = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def written(spark, tmp_path, rows, schema=PLAIN, labels=()):
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_an_empty_table(spark, tmp_path):
    found = corpus_pipeline.run(spark, written(spark, tmp_path, []))
    assert found.collect() == [] and found.columns[:2] == ["doc_id", "start"]


CLASHES = ("language string, certainty double, toxicity double, row string, _id int, _key int, _row string, own int, root int, gone boolean, id int, key int, "
           "smallest string, n int, marked int, rest int")


def test_further_columns_of_any_name_are_kept(spark, tmp_path, prose):
    texts = [prose(i, 60) for i in range(12)]
    rows = [(i, t, "aa", "s", 1) for i, t in enumerate([*texts, texts[3], texts[4] + " tail"])] + [(5, texts[5], "aa", "s", 1), (None, None, None, None, None)]
    more = ("x", 0.5, 0.25, "kept", 1, 2, "own", 3, 4, True, 5, 6, "y", 7, 8, 9)
    schema = f"{PLAIN}, {CLASHES}"
    sf = written(spark, tmp_path, [(*r, *more) for r in rows], schema)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns
        assert all(tuple(r)[5:] == more for r in found.collect())
    left = sorted(str(r.doc_id) for r in corpus_pipeline.near_copies(spark, docs, sf).collect())
    assert left == sorted([*map(str, range(12)), "None"])  # 12 and 13 are copies, the second 5 repeats
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(range(12))


def test_repeated_rows_null_ids_and_long_texts_through_all_stages(spark, tmp_path, prose):
    long = prose(70, 30_000)
    kept = [(1, prose(1, 50), "aa"), (2, long, "aa"), (None, prose(3, 50), "aa"), (4, prose(4, 50), None)]
    go = [(1, kept[0][1], "aa"), (9, long + " end", "aa"), (None, kept[2][1], "aa"), (7, "", "aa"), (8, None, "aa"), (6, " 12 ! ", None)]
    sf = written(spark, tmp_path, [(i, t, lang, "s", 1) for i, t, lang in kept + go])
    found = corpus_pipeline.run(spark, sf).collect()
    whole = {i: sum(r.length for r in found if r.doc_id == i) for i in {r.doc_id for r in found}}
    assert set(whole) == {1, 2, None, 4}
    assert all(sum(r.length for r in found if r.doc_id == i) == next(r.doc_tokens for r in found if r.doc_id == i) for i in whole)


@pytest.mark.parametrize("block, items", [(1_024, 1 << 20), (4, 1 << 20), (1_024, 600)])
def test_groups_of_near_copies_in_blocks(spark, docs, prose, monkeypatch, block, items):
    """Copies that are near a common text but hardly near each other: many pairs to verify, few links."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SETS", block)
    monkeypatch.setattr(jaccard, "ITEMS", items)
    base = prose(1, 200).split()
    texts = [" ".join(base)]
    for k in range(40):
        copy = list(base)
        for at in range(k % 7):
            copy[(k * 31 + at * 29) % 200] = f"w{k}x{at}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    sets = [set(zip(*(t.split()[k:] for k in range(3)))) for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        least = [min(least[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 90 * len(a | b)) for a in sets]
    found = jaccard.jaccard_components(spark, docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == list(enumerate(least))


def test_clusters_and_intersections():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, pairs in ((1, 0), (6, 3), (50, 30), (200, 400)):
        i, j = rng.integers(0, n, (2, pairs))
        first = jaccard.representatives(i, j, n)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j):
                want[a] = want[b] = min(want[a], want[b])
        assert first.tolist() == want
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(25)]
    common = jaccard.common_elements(sets)
    assert all(common[a, b] == len(set(x.tolist()) & set(y.tolist())) for a, x in enumerate(sets) for b, y in enumerate(sets) if a != b)
