from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

import check

from depvital.llm.queries import ORACLE_SQL, SHARD_BYTES
from depvital.llm.sharding import HASH_BITS, shard, write_shards

from .conftest import AWKWARD


def expected(rows, limit):
    items = []
    for doc, text, *_ in rows:
        key = str(doc) if doc is not None else f"text:{text or ''}"
        bits = f"{int(hashlib.md5(key.encode()).hexdigest()[:15], 16):060b}"
        items.append((bits, len((text or "").encode()), doc))
    out = []

    def place(part, depth):
        total = sum(b for _, b, _ in part)
        if total <= limit or depth == HASH_BITS or len({h for h, _, _ in part}) == 1:
            out.extend((d, h[:depth], b, len(part), total) for h, b, d in part)
            return
        halves = defaultdict(list)
        for x in part:
            halves[x[0][depth]].append(x)
        for half in halves.values():
            place(half, depth + 1)

    if items:
        place(items, 0)
    return out


@pytest.mark.parametrize("limit", [10_000_000, 600, 40])
def test_buckets_split_until_they_fit(documents, limit):
    rows = [(i, "x" * (i % 37)) for i in range(500)]
    got = shard(documents(rows), limit).collect()
    assert sorted((r.doc_id, r.shard, r.bytes, r.shard_docs, r.shard_bytes) for r in got) == sorted(expected(rows, limit))
    assert not any(r.over_limit for r in got) and all(r.shard_bytes <= limit and r.depth == len(r.shard) for r in got)


def test_awkward_rows(documents):
    got = shard(documents(AWKWARD), 20).collect()
    assert sorted((r.doc_id or -1, r.bytes) for r in got) == sorted((r[0] or -1, len((r[1] or "").encode())) for r in AWKWARD)
    over = {r.doc_id for r in got if r.over_limit}
    assert over == {6, 7, 8}
    for r in got:
        if r.over_limit:
            assert r.shard_docs == 1  # nothing else is left in the shard of a text beyond the limit
    assert shard(documents([]), 20).collect() == []


def test_written_shards(spark, documents, tmp_path):
    docs = documents([(i, "text " * 20) for i in range(64)]).select("doc_id", "text")
    placed = shard(docs, 1000)
    write_shards(docs, placed, f"file://{tmp_path}/shards")
    again = spark.read.parquet(f"file://{tmp_path}/shards")
    assert again.count() == 64 and again.select("shard").distinct().count() == placed.select("shard").distinct().count()


def test_texts_over_the_limit_match_sql(documents):
    rows = [(i, "x" * (300_000 if i % 3 else 10)) for i in range(30)] + [(30, "y" * (SHARD_BYTES + 1)), (31, "z" * (3 * SHARD_BYTES))]
    docs = documents(rows).select("doc_id", "text")
    got = shard(docs, SHARD_BYTES)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    result = con.execute(ORACLE_SQL["op10_sharding"])
    columns = [d[0] for d in result.description]
    want = check.rows_of(columns, result.fetchall())
    assert check.rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
    assert {r.depth for r in got.collect() if r.over_limit} == {40}
