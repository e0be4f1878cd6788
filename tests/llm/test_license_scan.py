from __future__ import annotations

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

import check
from depvital.llm.license_scan import BASE, NOTICES, RARE_WORDS, Template, agreeing, exact, license_labels, scan_licenses
from depvital.llm.queries import ORACLE_SQL

from .conftest import AWKWARD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, templates=BASE + NOTICES):
    """(label, base, start, share) of every place, trying every start of every template in every text."""
    split = [(r[0], words_of(r[1])) for r in rows]
    counts = Counter(w for _, words in split for w in set(words))
    out = []
    for doc, words in split:
        places = []
        for t in templates:
            held = [p for p, w in enumerate(t.words) if counts[w]]
            rare = sorted(held, key=lambda p: (counts[t.words[p]], t.words[p], p))[:RARE_WORDS]
            for start in range(-len(t.words), len(words)):
                stands = [0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(t.words)]
                if all(stands[p] for p in t.key_places) and sum(stands[p] for p in rare) >= agreeing(t, len(rare)):
                    places.append((t.label, t.base, start, sum(stands) / len(t.words)))
        out.append((doc, len(words), sorted(places)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, sorted(map(tuple, r.places))) for r in df.collect()), key=repr)


TEXTS = [
    "Licensed under CC BY-NC 4.0. All rights reserved! cc\nby",
    "cc by cc by cc by",
    "GENERAL public--license; the gnu General Public License, version 3.",
    "All Rights. Reserved all rights not reserved",
    "mit license at once",
    "Released by us under the MIT license.",
    "Permission is hereby granted, free of charge, to any person having a copy of this software and associated documentation files",
    "charge to any person obtaining a copy of this software and associated documentation files",
    "worK under the apache license version 2.0, K",
    "Écc by à cc by",
    "this this work is licensed under the gnu general public license version 3",
    "",
    None,
]


def test_places_equal_all_starts_tried(documents):
    rows = [*enumerate(TEXTS), *[(100 + i, f"x{i} general words all of the public under license") for i in range(20)], (None, "cc by"), (1, "cc by"), (1, "cc by")]
    got = found(scan_licenses(documents(rows)))
    assert got == expected(rows)
    by_doc = {d: p for d, _, p in got}
    assert [p[:3] for p in by_doc[9]] == [("cc-by", True, 3)]  # a letter before the phrase is part of its word
    assert any(p[0] == "mit" and p[3] < 1 for p in by_doc[6]), "a passage with other words in it is still found"
    assert by_doc[7] == [], "without its key phrase a passage does not count"
    assert by_doc[4] == [], "too few of the passage"
    assert [p[3] for p in by_doc[5] if p[0] == "mit"] == [0.8]


@pytest.mark.parametrize("seed", range(3))
def test_random_words(documents, seed):
    import random

    draw = random.Random(seed)
    templates = (exact("ab", "a b"), exact("aab", "a a b"), Template("long", "a b c a d e f g", ("b c a",)), Template("none", "y z", ("z",)))
    rows = [(i, " ".join(draw.choices("abcdefg", k=draw.randrange(60)))) for i in range(80)]
    assert found(scan_licenses(documents(rows), templates)) == expected(rows, templates)


def test_labels(documents):
    rows = list(enumerate(TEXTS))
    got = {r.doc_id: r for r in license_labels(scan_licenses(documents(rows))).collect()}
    first = got[0]
    assert (first.n_words, first.n_base, first.first_word, first.last_word) == (12, 3, 2, 10)
    assert (first.base_labels, first.labels, first.score) == ("cc-by,reserved", "cc-by,cc-by-nc,reserved", 1.0)
    for empty in (11, 12):
        r = got[empty]
        assert tuple(r) == (empty, 0, 0, None, None, "", "", 0.0)


def test_awkward_rows_and_sql(documents):
    rows = AWKWARD + [(20, "word all rights reserved " * 50_000), (21, "cc"), (21, "cc by")]
    docs = documents(rows)
    got = license_labels(scan_licenses(docs))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    result = con.execute(ORACLE_SQL["op11_license_scan"])
    columns = [d[0] for d in result.description]
    assert check.rows_of(got.columns, [tuple(r) for r in got.collect()]) == check.rows_of(columns, result.fetchall())
    assert license_labels(scan_licenses(documents([]))).collect() == []


def test_no_python_in_the_plan(documents):
    plan = license_labels(scan_licenses(documents([(1, "all rights reserved")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
