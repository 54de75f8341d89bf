import hashlib
from collections import Counter

import pyarrow.fs as pafs
import pytest

from bazaarflow.llm import warc


def expected(rows):
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= warc.REVISIT_FROM:
            best[h] = max(i, best.get(h, i))
    return Counter(
        (i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("response", None) if best.get(h, i) == i else ("revisit", best[h])))
        for i, _, h in rows
    )


def read_back(pages, **more):
    return [tuple(r) for r in warc.captured(pages, **more).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]


def test_round_trip_with_hot_payloads_and_odd_rows(spark, monkeypatch):
    hot = "<p>é</p>" * 200
    rows = [(i, f"http://h{i % 3}.example.com/p{i}", hot) for i in range(150)]
    rows += [(200 + i, "http://same.example.com/", f"<b>{i % 40}</b>" * (1 + 20 * (i % 9))) for i in range(120)]
    rows += [(400, None, None), (401, "", ""), (402, "not a url", "x" * 100_000), (403, "http://[bad", "y"), (404, "http://h:99999/é ?q=\r\nX: y", "z")]
    pages = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, digest string, file int")
    assert Counter(read_back(pages)) == expected(rows)
    assert warc.captured(pages.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "http://a.b/", "x" * 2000)] * 3 + [(None, "http://a.b/", "n"), (2, "http://a.b/", "x" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    digest = hashlib.sha1(b"x" * 2000).hexdigest()
    found = Counter(read_back(pages))
    assert found == Counter([(1, 2000, digest, "revisit", 2)] * 3 + [(2, 2000, digest, "response", None), (None, 1, hashlib.sha1(b"n").hexdigest(), "response", None)])


def test_small_blocks_and_payloads(spark):
    rows = [(i, f"https://www.x{i % 5}.org:8443/a/{i // 7}", f"page {i}") for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.captured(pages, payload=True).select("page_id", "payload").collect()
    assert Counter(map(tuple, found)) == Counter((i, h) for i, _, h in rows)


def test_index_file_finds_keys_that_span_blocks(spark, tmp_path):
    captures = spark.createDataFrame([("k", 5, "f", n, 1) for n in range(1500)] + [("a", n, "f", n, 1) for n in range(600)] + [("z", 1, "g", 0, 1)], warc.CAPTURE).coalesce(1)
    names = [f"{tmp_path}/{r.file}" for r in warc.build_index(captures, str(tmp_path)).collect()]
    files = [warc.IndexFile(pafs.LocalFileSystem(), n) for n in names]
    assert sum(len(f.find(("k", True, 5))) for f in files) == 1500
    assert sum(len(f.find(("a", True, 599))) for f in files) == 1
    assert sum(len(f.find(("m", True, 1))) for f in files) == 0
    assert all(len(f.directory) >= 1 for f in files)


@pytest.mark.parametrize("url, key", [
    ("http://www.Example.com", "com,example)/"), ("https://a.b.c:8080/x?y=1#z", "c,b,a:8080)/x?y=1"), ("https://a.b:443/", "b,a)/"), (None, ""), ("mailto:x", "mailto:x"),
])
def test_keys(url, key):
    assert warc.surt(url) == key


def test_damaged_records_are_noticed():
    data = warc.record(1, "http://a/", b"body", None)
    fields, block = warc.parsed(data)
    assert warc.payload_of(fields, block) == b"body"
    with pytest.raises(ValueError):
        warc.payload_of(*warc.parsed(data.replace(b"body", b"bodi")))
    with pytest.raises(ValueError):
        warc.parsed(data[:-1])
