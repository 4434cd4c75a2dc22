import base64
import hashlib
import io
import zipfile

import duckdb
import numpy as np
import pytest
from newsignal.llm import chat, neighbours, warc
from pyspark.sql import functions as F

PAGES = [
    (5, "http://a.example/x?y=1", "<p>one</p>"), (3, "http://a.example/z", "<p>one</p>"), (4, None, "<p>two é</p>"), (6, "no url", None), (7, "http://b.example", ""),
    (8, "http://c.example/\nnew\r\nline", "\r\n\r\n<x>"), (9, "u", "long " * 50_000), (None, "u", "<p>two é</p>"), (None, "v", "alone"), (3, "http://a.example/z", "<p>one</p>"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload_bytes string")


def test_archive_round_trip(spark):
    found = [tuple(r) for r in warc.archive(spark, pages(spark, PAGES)).collect()]
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        data, least = (html or "").encode(), first.get(html or "")
        own = least is None or least == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else least))
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert warc.archive(spark, pages(spark, [])).collect() == []


def test_small_payloads_are_not_deduplicated(spark):
    found = warc.archive(spark, pages(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "xxxx"), (4, "d", "xxxx")]), least=3).collect()
    assert {r.page_id: r.refers_to for r in found} == {1: None, 2: None, 3: None, 4: 3}


@pytest.mark.parametrize("zip64", [True, False])
def test_reader_parses_what_the_standard_library_writes(zip64):
    stream = io.BytesIO()
    writer = warc.PackageWriter(stream, "2024-01-01T00:00:00Z", zip64)
    for i, url, html in PAGES:
        writer.add(i, url, (html or "").encode(), None)
    writer.close()
    data = stream.getvalue()
    reader = warc.PackageReader(lambda at, n: data[at : at + n], len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as same:
        assert same.testzip() is None and set(same.namelist()) == set(reader.members)
        assert all(same.read(name) == reader.member(name) for name in reader.members)
    got = [warc.parse_record(data[e["offset"] : e["offset"] + e["length"]]) for e in sorted(reader.index(), key=lambda e: e["offset"])]
    assert [(r["page_id"], r["payload"]) for r in got] == [(i, (h or "").encode()) for i, _, h in PAGES]


def test_zip64_directory_of_many_members():
    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"x%d" % i)
        z.comment = b"PK\5\6 in a note"
    data = stream.getvalue()
    reader = warc.PackageReader(lambda at, n: data[at : at + n], len(data))
    assert len(reader.members) == 66_000 and reader.member("m65999") == b"x65999"
    with pytest.raises(ValueError):
        warc.PackageReader(lambda at, n: data[at : at + n], len(data) - 40)


def test_damaged_records_are_noticed():
    raw, _ = warc.record(1, "u", b"payload", None, "2024-01-01T00:00:00Z")
    import gzip

    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(gzip.decompress(raw).replace(b"\r\n\r\npayload", b"\r\n\r\npayloaX")))


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"), (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, 0, None, None), (6, None, "user", "late"), (6, 0, "user", "<|im_end|> early"), (7, 0, "user", ""), (None, 0, "user", "lost"),
    (8, 0, "user", "hi"), (8, 0, "user", "hi"), (9, 0, "assistant", "hi"), (10, 0, "user", "x" * 50_000),
]


def test_snapshots_collapse_like_the_sql(spark):
    turns = spark.createDataFrame([(*t, "e") for t in TURNS], "conv_id bigint, turn bigint, role string, text string, place string")
    found = {tuple(r) for r in chat.render(turns).collect()}
    with duckdb.connect() as con:
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", TURNS)
        assert found == set(con.execute(chat.RENDER_SQL).fetchall())
    assert {i for i, _, _ in found} == {2, 4, 5, 6, 7, 8, 9, 10}
    assert chat.render(turns.limit(0)).collect() == []
    assert "Python" not in chat.render(turns)._jdf.queryExecution().toString()


def brute_nearest(vectors, k):
    out = []
    for q, v in vectors:
        if q % 20 == 0:
            near = sorted((-float(np.dot(np.float64(v), np.float64(w))), j) for j, w in vectors if j != q)[:k]
            out += [(q, n + 1, j) for n, (_, j) in enumerate(near)]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(60)]
    good = [(i, v if any(v) else [1] * 6) for i, v in good]
    odd = [(100, None), (101, [0.0] * 6), (102, [float("nan")] * 6), (103, [float("inf"), 0, 0, 0, 0, 0]), (104, [1.0, 2.0]), (None, [1.0] * 6), (105, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (106, [])]
    table = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "e") for i, v in good + odd + good[:3]], "vec_id bigint, embedding array<float>, score string")
    found = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(spark, table, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(found) == sorted(brute_nearest(good, 20))
    assert neighbours.nearest(spark, table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_on_hard_vectors_with_copies(spark, monkeypatch):
    for name, value in (("LEAST_CANDIDATES", 500), ("SLICE", 256), ("QUERY_BLOCK", 32)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((10, 32))
    vectors = [(i, (centres[i % 10] * 0.5 + rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(3_000)]
    vectors += [(3_000 + i, vectors[7][1]) for i in range(900)]
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    found = neighbours.nearest(spark, table, F.col("vec_id") % 20 == 0).collect()
    got, want = {(r.query_id, r.vec_id) for r in found}, {(q, j) for q, _, j in brute_nearest(vectors, 20)}
    assert len(got & want) / len(want) >= 0.9
    assert {r.query_id for r in found} == {i for i, _ in vectors if i % 20 == 0}
