from __future__ import annotations

import base64
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as driver
import check
import corpus_pipeline
from depvital.llm import language_id, queries
from depvital.llm.common import keep_table, read_table
from depvital.llm.queries import RANKS

from .conftest import AWKWARD

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    ok, note = check.compare(name, spark, check.connect(SF), SF)
    assert ok, note


def test_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))
    assert set(queries.QUERIES) <= set(driver.queries()) and "pipeline" in driver.queries()


def test_stages(spark):
    """Each stage against a plain version over the rows that the one before kept."""
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    inputs = []
    for _, stage in corpus_pipeline.STAGES:
        inputs.append({r.doc_id: r for r in docs.collect()})
        docs = keep_table(stage(spark, docs, SF), "test-stage")
        if stage is not corpus_pipeline.encode:
            assert docs.columns == columns
    final = {r.doc_id: r for r in docs.collect()}
    start, known, lean, single, mixed = inputs

    assert set(known) == {i for i, r in start.items() if any(map(str.isalpha, r.text))}

    holders = {}
    for i, r in known.items():
        for line in r.text.split("\n"):
            holders.setdefault(line.strip(" \t\n\x0b\x0c\r").encode().lower(), set()).add(i)
    for i, r in known.items():
        kept = [x for x in r.text.split("\n") if len(k := x.strip(" \t\n\x0b\x0c\r")) < 10 or min(holders[k.encode().lower()]) == i]
        assert lean[i].text == "\n".join(kept) and lean[i].n_chars == len(lean[i].text)

    words = {i: r.text.encode().lower().split() for i, r in lean.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    gone = set()
    ids = sorted(sets)
    lead = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((lead[i], lead[j]))
                lead = {k: a if v == b else v for k, v in lead.items()}
    gone = {i for i in ids if lead[i] != i}
    assert set(single) == set(ids) - gone and set(mixed) == set(single)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(final) == set(mixed)
    for i, r in final.items():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == library.encode_ordinary(mixed[i].text)
        assert r.decoded_sha256 == hashlib.sha256(mixed[i].text.encode()).hexdigest()


def test_mix_is_the_order_of_the_rows(spark):
    docs = read_table(spark, SF, "documents")
    rows = corpus_pipeline.mix(spark, docs, SF).select("source").collect()
    first = [r.source for r in rows[:: 8]][:40]
    assert len(set(first)) >= 5  # blocks of many sources from the start


def test_empty_tables(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def awkward(spark):
    """Rows with null and repeated identifiers, in the columns of the documents."""
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source in ((*r, *[None] * (4 - len(r))) for r in AWKWARD)]
    rows += [(None, f"Null document number {n} " + " ".join(f"w{n}x{k}" for k in range(40)), "en", "a", 0) for n in range(6)]
    rows += [(70, f"Shared identifier {n} " + " ".join(f"s{n}x{k}" for k in range(40)), "en", "a", 0) for n in range(3)]
    rows += [(None, rows[-1][1], "en", "b", 0), (60, rows[-2][1], "en", "b", 0), (61, "  " + rows[-1][1], "en", "b", 0)]
    columns = read_table(spark, SF, "documents").columns
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_near_copies_of_null_and_repeated_identifiers(spark):
    docs, rows = awkward(spark)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()), key=repr)
    groups = {}
    for i, text, *_ in rows:
        words = (text or "").lower().encode().split()
        groups.setdefault(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else None, set()).add((i, text))
    groups = list(groups.values())
    long = [g for g in groups if any(t and len(t) > 10_000 for _, t in g)]  # LONG and LONG + "end"
    groups = [g for g in groups if g not in long] + [set().union(*long)]
    best = lambda g: min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = [best(g) for g in groups]
    spelt = lambda found: sorted(((i, t or "") for i, t in found), key=repr)
    assert spelt(got) == spelt(want)


def test_every_stage_on_awkward_rows(spark):
    docs, rows = awkward(spark)
    ids = lambda found: sorted((r[0] for r in found), key=repr)
    for _, stage in corpus_pipeline.STAGES:
        found = keep_table(stage(spark, docs, SF), "test-awkward").select("doc_id").collect()
        if stage is corpus_pipeline.identify_language:
            model = language_id.fit(docs)
            assert ids(found) == ids(r for r, (_, _, gone) in zip(rows, model.predict([r[1] for r in rows])) if not gone)
        elif stage is not corpus_pipeline.drop_near_copies:
            assert ids(found) == ids(rows)


def test_result_holds_the_mix(spark):
    """The order and the shares of the sources, from run()'s rows written to several files and read again."""
    rows = [tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "source", "mix_slot", "mix_place").collect()]
    assert [r[2:] for r in rows] == sorted(r[2:] for r in rows) and len(set(r[2:] for r in rows)) == len(rows)
    again = keep_table(spark.createDataFrame(rows, "doc_id long, source string, mix_slot long, mix_place long").repartition(3), "test-mix").collect()
    assert [r.doc_id for r in sorted(again, key=lambda r: (r.mix_slot, r.mix_place))] == [r[0] for r in rows]
    sources = {}
    for doc, source, slot, _ in rows:
        sources.setdefault(source, []).append((slot, doc))
    weight = {s: 1 + int(hashlib.md5(s.encode()).hexdigest()[:4], 16) % 9 for s in sources}
    assert len(set(weight.values())) > 3
    for source, found in sources.items():
        digests = [hashlib.md5(str(doc).encode()).hexdigest() for _, doc in found]
        assert digests == sorted(digests)
        slots = sorted({slot for slot, _ in found})
        for n, slot in enumerate(slots):  # the n-th block runs within a block of its target
            assert abs(slot * weight[source] / sum(weight.values()) - n) < 1
