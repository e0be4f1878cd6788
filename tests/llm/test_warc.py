from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from depvital.llm import warc
from depvital.llm.common import new_folder

BIG = "<html>" + "ä payload\r\n\r\n" * 200
PAGES = [
    (1, "http://a/ü b\r\nX: y", BIG, "x"),
    (2, None, BIG, "x"),
    (5, "http://c", BIG, "x"),
    (5, "http://c", BIG, "x"),
    (3, "http://d", None, "x"),
    (4, "http://e", "", "x"),
    (6, "http://f", "small", "x"),
    (7, "http://g", "small", "x"),
    (None, "http://h", BIG, "x"),
    (None, "http://i", "n" * 1000, "x"),
    (None, "http://j", "n" * 1000, "x"),
    (8, "http://k", "z" * 3_000_000, "x"),
    (9, "http://l", "n" * 999, "x"),
    (10, "http://l", "n" * 999, "x"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)


def test_digests(spark):
    want = []
    for page, _, html, _ in PAGES:
        raw = (html or "").encode()
        best = max((p for p, _, h, _ in PAGES if (h or "") == (html or "") and p is not None), default=None) if len(raw) >= 1000 else None
        refers = best if best != page else None
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    got = warc.archive_digests(frame(spark, PAGES), new_folder(spark, "warc-test"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_selected_records(spark, monkeypatch):
    folder = new_folder(spark, "warc-test")
    index = warc.write_archives(frame(spark, PAGES), folder)
    found = warc.read_records(index.where(F.col("page_id").isin(1, 6, 8)), folder).collect()
    assert {(r.page_id, r.record_type, len(r.payload)) for r in found} == {(1, "revisit", 0), (6, "response", 5), (8, "response", 3_000_000)}
    assert {r.url for r in found if r.page_id == 1} == {"http://a/ü%20b%0D%0AX:%20y"}
    monkeypatch.setattr(warc, "GAP_BYTES", -1)  # no joined reads
    assert warc.read_ranges(index).count() == len(PAGES)
    monkeypatch.setattr(warc, "GAP_BYTES", 1 << 30)
    assert warc.read_ranges(index).count() == index.select("file").distinct().count()


def test_empty(spark):
    assert warc.archive_digests(frame(spark, []), new_folder(spark, "warc-test")).collect() == []
