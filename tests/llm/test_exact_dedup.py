from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from depvital.llm.exact_dedup import exact_dedup

from .conftest import AWKWARD


def expected(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[text or ""].append(doc)
    out, seen = [], set()
    for doc, text, *_ in rows:
        ids = groups[text or ""]
        best = max((i for i in ids if i is not None), default=None)
        keep = doc == best and (doc, text or "") not in seen
        seen.add((doc, text or ""))
        out.append((doc, best, len(ids), keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [8 << 20, 50, 1])
def test_awkward_rows(documents, range_bytes):
    got = [tuple(r) for r in exact_dedup(documents(AWKWARD), range_bytes=range_bytes).collect()]
    assert sorted(got, key=repr) == expected(AWKWARD)


def test_a_group_that_crosses_ranges(documents):
    rows = [(i, "the same text" if i % 3 else f"text {i % 40}") for i in range(600)]
    got = [tuple(r) for r in exact_dedup(documents(rows), range_bytes=200).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_normalised_and_empty(documents):
    from pyspark.sql import functions as F

    got = exact_dedup(documents([(1, "A"), (2, "a ")]), normalise=lambda t: F.lower(F.trim(t))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(1, 2, 2), (2, 2, 2)}
    assert exact_dedup(documents([])).collect() == []
