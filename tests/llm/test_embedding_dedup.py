from __future__ import annotations

import numpy as np
import pytest

from depvital.llm.embedding_dedup import linked, local_roots, near_vectors


def expected(rows, threshold):
    size = max((len(v) for _, v in rows if v), default=0)
    unit = []
    for _, v in rows:
        good = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array([*v, *[0.0] * (size - len(v))]) if good else None
        unit.append(x / np.linalg.norm(x) if good else None)
    near = [[i != j and a is not None and b is not None and a @ b >= threshold for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    u, v = np.nonzero(np.array(near))
    roots = local_roots(len(rows), u, v)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, sum(n), least.get(r)) for (i, _), n, r in zip(rows, near, roots)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, unit string").repartition(3)


@pytest.mark.parametrize("tile_bytes", [1 << 22, 1])
def test_against_all_pairs(spark, tile_bytes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(25, 12))
    rows = [(int(i), (centres[i % 25] + rng.normal(size=12) * rng.choice([0.05, 0.3])).tolist()) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, [2 * x for x in rows[1][1]])]
    got = near_vectors(frame(spark, rows), 0.95, tile_bytes=tile_bytes).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == expected(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [1e200, 2e200]), (8, [1.0, 2.0])]
    rows += [(9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (11, [-0.0, 3.0]), (12, [0.0, 1.0]), (None, [1.0, 2.0]), (None, [5.0, -7.0]), (13, [1e-200, 2e-200])]
    got = near_vectors(frame(spark, rows)).collect()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got if r.vec_id not in (None, 8)}
    assert {i: found[i] for i in range(1, 7)} == {i: (0, i, True) for i in range(1, 7)}
    assert found[7] == (5, 7, True) and found[9] == found[13] == (5, 7, False)
    assert found[10] == (0, 10, True) and found[11] == (1, 11, True) and found[12] == (1, 11, False)
    assert sorted(((r.n_links, r.component_id) for r in got if r.vec_id is None), key=repr) == [(0, None), (5, 7)]
    assert near_vectors(frame(spark, [])).collect() == []
    assert near_vectors(frame(spark, rows[:3])).count() == 3


def test_bounded_products_find_all_pairs():
    rng = np.random.default_rng(4)
    for spread in (0.02, 0.2, 2.0):
        x = rng.normal(size=(1, 40)) + rng.normal(size=(200, 40)) * spread
        x /= np.linalg.norm(x, axis=1)[:, None]
        i, j = linked(x, x, 0.95)
        want = np.nonzero(x @ x.T >= 0.95)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(want[0].tolist(), want[1].tolist()))
