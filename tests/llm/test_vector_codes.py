from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

import check
from depvital.llm.queries import ORACLE_SQL
from depvital.llm.vector_codes import assign, code_errors, compress, reassign

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("codes", "nears", "error", "whole", "code", "vector", "a.b")],
    ]
)


@pytest.fixture(scope="module")
def vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 7) for r in rows], VECTORS).repartition(3)


def expected(rows, parts=8, size=16, rounds=6):
    """Every round compares every part with every entry."""
    kept = []
    for vec_id, x, label in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(4096 * float(np.float32(c))) for c in x], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:size]] for p in range(parts)]
    gap = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    nearest = lambda v, p: min((gap(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                members[p, nearest(v, p)[1]].append(cut(v, p))
        for (p, k), held in members.items():
            books[p][k] = [sum(c) // len(held) for c in zip(*held)]
    out, by_label = [], defaultdict(int)
    for vec_id, v, label in kept:
        best = [nearest(v, p) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[label] += error
        out.append((vec_id, "".join(f"{k:02x}" for _, k in best), error, label))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label]) for i, c, e, label in out), key=repr), digest


def found(vectors, **options):
    coded, books = compress(vectors, **options)
    return sorted((tuple(r) for r in code_errors(coded).collect()), key=repr), books.sha256()


def test_only_moved_entries_are_compared():
    draw = np.random.default_rng(5)
    for _ in range(40):
        parts = draw.integers(-3, 4, (200, 2))  # many ties
        before = draw.integers(-3, 4, (7, 2))
        moved = draw.random(7) < 0.4
        after = np.where(moved[:, None], draw.integers(-3, 4, (7, 2)), before)
        code, near, compared = reassign(parts, after, moved, *assign(parts, before))
        want = assign(parts, after)
        assert (code == want[0]).all() and (near == want[1]).all()
        rescanned = int(moved[assign(parts, before)[0]].sum())
        assert compared == rescanned * 7 + (200 - rescanned) * int(moved.sum())


@pytest.mark.parametrize("seed,count", [(0, 300), (1, 40), (2, 9)])
def test_equals_whole_scans(vectors, seed, count):
    draw = np.random.default_rng(seed)
    rows = [(int(i), [float(c) for c in draw.normal(0, 0.001 if i % 3 else 0.2, 16)], int(i % 4)) for i in draw.permutation(count)]
    assert found(vectors(rows)) == expected(rows)


def test_other_sizes(vectors):
    draw = np.random.default_rng(7)
    rows = [(i, [float(c) for c in draw.normal(0, 1, 6)], 0) for i in range(400)]
    assert found(vectors(rows), parts=2, size=300, rounds=2)[1] == expected(rows, 2, 300, 2)[1]
    assert found(vectors(rows), parts=3, size=5, rounds=0) == expected(rows, 3, 5, 0)


AWKWARD = [
    (1, [0.5] * 16, 1),
    (1, [0.5] * 16, 1),
    (2, None, 1),
    (3, [0.5] * 15 + [None], 1),
    (4, [float("nan")] + [0.1] * 15, None),
    (5, [float("-inf")] + [0.1] * 15, None),
    (6, [0.0] * 16, None),
    (7, [-0.0001] * 16, None),
    (8, [-0.25, 0.125] * 8, 2),
]


def test_awkward_rows_and_sql(vectors):
    rows = AWKWARD + [(100 + i, [i / 7, -i / 3] * 8, i % 3) for i in range(50)]
    assert found(vectors(rows)) == expected(rows)
    coded, books = compress(vectors(rows))
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    result = con.execute(ORACLE_SQL["op12_vector_codes"])
    columns = [d[0] for d in result.description]
    got = [(*r, books.sha256()) for r in code_errors(coded).collect()]
    assert check.rows_of(["vec_id", "code", "error", "label_error", "codebooks_sha256"], got) == check.rows_of(columns, result.fetchall())


def test_null_identifiers_other_lengths_and_empty_tables(vectors):
    rows = [(None, [0.5] * 8, 1), (None, [0.25] * 8, 1), (3, [0.1] * 8, 1)]
    assert found(vectors(rows)) == expected(rows)
    odd = [r for r in code_errors(compress(vectors([*rows, (9, [0.1] * 4, 1), (10, [], 2)]))[0]).collect() if r.code is None]
    assert sorted((r.vec_id, r.error) for r in odd) == [(9, None), (10, None)]
    assert found(vectors([])) == ([], hashlib.sha256(b"").hexdigest())
    assert found(vectors([(1, None, 1)]))[0] == []


def test_components_that_would_overflow_are_an_error(vectors):
    with pytest.raises(Exception, match="overflow"):
        compress(vectors([(1, [1e30] * 8, 1)]))
