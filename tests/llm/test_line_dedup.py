from __future__ import annotations

import numpy as np
import pytest

from depvital.llm.line_dedup import BLANKS, PerfectHash, line_dedup, line_key

from .conftest import AWKWARD

LINES = [
    (1, "a line of its own\n  Shared LINE here \nshort\nshared line here"),
    (2, "shared line here\t\nshort\n\nanother line, shared"),
    (3, "ANOTHER LINE, SHARED\nanother line, shared\r\nunique line number three"),
    (3, "another line, shared"),
    (None, "shared line here\nonly with null identifiers"),
    (None, "only with null identifiers"),
    (4, "Ünïcödé line 中文\nÜnïcödé line 中文"),
    (5, "ÜnïcÖdé line 中文\nünïcödé line 中文\nÜnïcödé LINE 中文"),
    (6, "123456789\n1234567890"),
    (7, "123456789\n1234567890"),
]


def expected(rows, least=10):
    holders = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(line.strip(BLANKS)) >= least:
                holders.setdefault(line_key(line), set()).add(float("inf") if doc is None else doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        own = float("inf") if doc is None else doc
        kept = [x for x in lines if len(h := holders.get(line_key(x), ())) < 2 or min(h) == own or len(x.strip(BLANKS)) < least]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_lines", "probes"), [(20_000, 200_000), (1, 2)])
@pytest.mark.parametrize("rows", [AWKWARD, LINES])
def test_rows(documents, rows, shard_lines, probes):
    got = line_dedup(documents(rows), shard_lines=shard_lines, probes_per_copy=probes)
    assert "a.b" in got.columns and "row" in got.columns and got.columns.count("n_lines") == 1
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr) == expected(rows)


def test_empty(documents):
    assert line_dedup(documents([])).collect() == []
    assert line_dedup(documents([(1, None), (2, "no line twice")])).count() == 2


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        high, low = rng.integers(0, 2**64, (2, n), np.uint64)
        high[: n // 2] = 5  # equal halves must not keep keys together
        perfect = PerfectHash.load(PerfectHash.build(high, low).store())
        assert perfect.size == n
        assert sorted(perfect.place(high, low).tolist()) == list(range(n))
