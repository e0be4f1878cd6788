from __future__ import annotations

import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from depvital.llm.mixing import mix_sources, period_slots, source_shares

from .conftest import AWKWARD


def shares_of(spark, weights):
    counts = spark.createDataFrame([(f"={i:04d}", f"{i:04d}", 1) for i in range(len(weights))], "key string, source string, docs long")
    return source_shares(counts, {f"{i:04d}": w for i, w in enumerate(weights)})


@pytest.mark.parametrize("weights", [[1], [3, 3, 3], [1, 2, 4, 13], [500, 300, 199, 1], [70] * 11, [1] * 30 + [70], [997, 2, 2003], [6, 4, 10]])
def test_every_slot_keeps_to_the_targets(spark, weights):
    rows = sorted((r.slot, r["at"]) for r in period_slots(shares_of(spark, weights)).collect())
    whole = sum(weights)
    assert [s for s, _ in rows] == list(range(whole // math.gcd(*weights)))
    done = Counter()
    for slot, source in rows:
        done[source] += 1
        for i, w in enumerate(weights):
            assert abs(done[i] - Fraction(w * (slot + 1), whole)) < 1


def test_a_weight_of_one_in_a_million_is_kept(spark):
    rows = period_slots(shares_of(spark, [1, 1_000_000]))
    rare = rows.where("at = 0").collect()
    assert rows.count() == 1_000_001 and len(rare) == 1
    # before its slot t it has had 0 of t / 1000001 blocks, from there on 1: less than one block off at every slot
    assert rows.where("at = 1").selectExpr("max(turn)").first()[0] == 999_999
    worst = rows.where("at = 1").selectExpr("max(abs((turn + 1) - (slot + 1) * 1000000 / 1000001))").first()[0]
    assert worst < 1 and 0 <= rare[0].slot < 1_000_001


def test_many_sources(spark):
    rows = period_slots(shares_of(spark, [1] * 1500)).collect()
    assert sorted(r.slot for r in rows) == list(range(1500)) and len({r["at"] for r in rows}) == 1500


def test_mix(documents):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    got = mix_sources(documents(rows), {"hot": 5, **{f"s{i}": i + 1 for i in range(6)}}, block_docs=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    by_slot = {}
    for r in got:
        if r.source == "s6":
            assert r.slot is None
            continue
        by_slot.setdefault(r.slot, []).append((r.source, r.block, r.place))
    for found in by_slot.values():
        assert len({x[:2] for x in found}) == 1 and sorted(x[2] for x in found) == list(range(len(found)))
    blocks = [(r.source, r.block) for r in got if r.place == 0 and r.slot is not None]
    assert len(blocks) == len(set(blocks)) == len(by_slot)


def test_awkward_rows(documents):
    got = mix_sources(documents(AWKWARD), block_docs=2).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in AWKWARD)
    assert len({(r.slot, r.place) for r in got}) == len(AWKWARD)
    assert mix_sources(documents([])).collect() == []
    assert {r.slot for r in mix_sources(documents(AWKWARD), {}).collect()} == {None}


def test_null_identifiers_are_split_by_text(documents):
    rows = [(None, f"text {i}", "en", "hot") for i in range(2000)] + [(i, "t", "en", "b") for i in range(50)]
    got = mix_sources(documents(rows), {"hot": 2, "b": 1}, carry=["text", "a.b"]).collect()
    assert Counter(r.text for r in got) == Counter(r[1] for r in rows) and {r["a.b"] for r in got} == {"x"}
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    again = mix_sources(documents(rows).repartition(7), {"hot": 2, "b": 1}, carry=["text", "a.b"]).collect()
    assert {(r.text, r.slot, r.place) for r in got if r.text != "t"} == {(r.text, r.slot, r.place) for r in again if r.text != "t"}


def test_targets_are_met_in_the_mix(documents):
    rows = [(i, "t", "en", "abc"[i % 3]) for i in range(3000)]
    got = mix_sources(documents(rows), lambda source, docs: F.when(source == "a", 7).when(source == "b", 2).otherwise(1), block_docs=5).collect()
    blocks = sorted({(r.slot, r.source) for r in got})
    done = Counter()
    for n, (slot, source) in enumerate(blocks[:280], 1):  # until the first source runs out
        assert slot == n - 1
        done[source] += 1
        for s, w in (("a", 7), ("b", 2), ("c", 1)):
            assert abs(done[s] - Fraction(w * n, 10)) < 1
