"""Rows that lie by their key are neither shuffled nor read again; the results stay the same."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from depvital.operators import advisories, graph
from depvital.plans import entrypoints
from depvital.plans.fixtures import Fixtures
from depvital.session import cut_by
from depvital.sources import sbom

SF = "/root/testdata/sf0.001"
ADVISORIES = "package_id BIGINT, version STRING, advisory_id STRING, cvss3 DOUBLE, relation STRING, dependency_name STRING"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark):
    values = [(p % 5, f"1.{p % 3}", f"A-{p % 11}", float(p % 7), "TRANSITIVE" if p % 2 else None, f"d{p % 4}" if p % 2 else None) for p in range(200)]
    values += [(None, "1.0", "A-1", 2.0, None, None), (1, None, "A-2", None, None, None), (7, "1.0", "A-3", None, None, None)]
    return spark.createDataFrame(values, ADVISORIES)


@pytest.mark.parametrize("name, exchanges", [("fx_versions", 1), ("fx_advisories", 1), ("fx_package_graphs", 2)])
def test_snapshots_are_dealt_once(spark, no_broadcast, name, exchanges):
    found = plan(Fixtures(spark, SF)._view(name))
    assert len(re.findall(r"\bExchange hashpartitioning", found)) <= exchanges + found.count("ReusedExchange") + (name == "fx_package_graphs")
    assert "SortAggregate" not in found


def test_bucketed_tables_join_as_they_lie(spark, no_broadcast):
    left = cut_by(rows(spark).select("package_id", "version", "cvss3"), "package_id")
    right = cut_by(rows(spark).select("package_id", "version", "advisory_id").distinct(), "package_id")
    joined = left.join(right, ["package_id", "version"])
    assert "Exchange" not in plan(joined)
    expected = rows(spark).select("package_id", "version", "cvss3").join(rows(spark).select("package_id", "version", "advisory_id").distinct(), ["package_id", "version"])
    assert sorted(map(str, joined.collect())) == sorted(map(str, expected.collect()))


def test_added_metrics_are_those_of_the_union(spark):
    both = rows(spark)
    keys = ["package_id", "version"]
    direct, found = both.where("relation IS NULL"), both.where("relation IS NOT NULL")
    wanted = both.select(*keys).distinct().where("package_id IS NOT NULL AND version IS NOT NULL")
    whole = wanted.join(advisories.advisory_metrics(both), keys, "left")
    apart = advisories.add_metrics(wanted.join(advisories.advisory_metrics(direct), keys, "left"), advisories.advisory_metrics(found), keys)
    assert sorted(map(str, apart.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_top_advisories_read_their_input_once(spark, no_broadcast):
    table = cut_by(rows(spark), "package_id")
    top = advisories.top_advisories(table)
    assert plan(top).count("FileScan") == 1 and "Join" not in plan(top)
    found = {(r.package_id, r.version): r for r in top.collect()}
    assert set(found) == {(a.package_id, a.version) for a in rows(spark).collect() if a.package_id is not None and a.version is not None}
    for key, r in found.items():
        mine = [a for a in rows(spark).collect() if (a.package_id, a.version) == key]
        worst = sorted(mine, key=lambda a: (a.cvss3 is None, -(a.cvss3 or 0.0), a.advisory_id))[:3]
        assert r.top_ids == ";".join(a.advisory_id for a in worst) and r.top_cvss3 == worst[0].cvss3
        assert (r.advisory_count, r.more_count) == (len(mine), max(0, len(mine) - 3))
        assert r.dependencies is not None


def test_documents_are_dealt_by_project_once(spark, no_broadcast):
    text = (
        '{"metadata":{"component":{"bom-ref":"root"}},"components":[{"bom-ref":"a","purl":"pkg:npm/a@1?x=y","components":'
        '[{"bom-ref":"b","purl":"pkg:npm/b@1"},{"bom-ref":"","purl":"pkg:npm/c@1"}]},{"bom-ref":"a","purl":"pkg:npm/z@1"}],'
        '"dependencies":[{"ref":"root","dependsOn":["a"]},{"ref":"a","dependsOn":["b","pkg:npm/c@1"]}]}'
    )
    files = spark.createDataFrame([(p, text) for p in (1, 2, None)], "project_id BIGINT, text STRING")
    components, dependencies, _ = sbom.read_sboms(files)
    refs = cut_by(sbom.reference_map(components), "project_id", dealt=True)
    assert "Exchange" not in plan(sbom.reference_map(components))
    edges = graph.sbom_edges(refs, dependencies)
    assert "Exchange" not in plan(edges)
    assert {(r.project_id, r.ref, r.purl) for r in refs.where("project_id = 1").collect()} == {
        (1, "a", "pkg:npm/z@1"), (1, "pkg:npm/a@1?x=y", "pkg:npm/a@1"), (1, "pkg:npm/z@1", "pkg:npm/z@1"), (1, "b", "pkg:npm/b@1"),
        (1, "pkg:npm/b@1", "pkg:npm/b@1"), (1, "pkg:npm/c@1", "pkg:npm/c@1"),
    }
    assert {(r.project_id, r.src, r.dst) for r in edges.collect()} == {(p, "pkg:npm/z@1", d) for p in (1, 2) for d in ("pkg:npm/b@1", "pkg:npm/c@1")}
    assert refs.where(F.col("project_id").isNull()).count() == 6


def test_more_frames_follow_in_the_same_buckets(spark, no_broadcast):
    """Levels of components went through a union, which was dealt anew."""
    first = cut_by(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "project_id BIGINT, ref STRING"), "project_id")
    second = spark.createDataFrame([("d", 1), ("e", 3)], "ref STRING, project_id BIGINT")
    table = cut_by(first, "project_id", dealt=True, more=[second, second.where("ref = 'e'")])
    assert sorted(r.ref for r in table.collect()) == ["a", "b", "c", "d", "e", "e"]
    counted = table.groupBy("project_id").count()
    assert {(r.project_id, r["count"]) for r in counted.collect()} == {(1, 2), (2, 1), (3, 2), (None, 1)}
    assert "hashpartitioning" not in plan(counted)


def test_references_of_a_project_are_described_where_they_lie(spark, no_broadcast, monkeypatch):
    """A full join lies by no key: what references stand for was dealt again after it."""
    plans = []
    monkeypatch.setattr(graph, "cut_by", lambda df, key, dealt=False: plans.append(plan(df)) or cut_by(df, key, dealt))
    table = lambda rows, schema: cut_by(spark.createDataFrame(rows, schema), "project_id")
    refs = table([(1, "r", "pkg:npm/root"), (1, "a", "pkg:npm/a"), (1, "b", "pkg:npm/b"), (2, "a", "pkg:npm/a")], "project_id BIGINT, ref STRING, purl STRING")
    entries = [(1, "top", "r"), (1, "r", "a"), (1, "r", "mid"), (1, "mid", "b"), (2, "top", "a")]
    dependencies = table(entries, "project_id BIGINT, ref STRING, child_ref STRING")
    # a project may have several documents, and so several roots
    roots = table([(1, "top", "pkg:npm/root"), (1, "top", "pkg:npm/other"), (2, "top", None)], "project_id BIGINT, root_ref STRING, root_purl STRING")
    direct = graph.direct_deps(refs, dependencies, roots, dealt=True)
    # the first root's own package leads to its children, and it is a package to the second
    assert {tuple(r) for r in direct.collect()} == {(1, "pkg:npm/root"), (1, "pkg:npm/a"), (1, "pkg:npm/b"), (2, "pkg:npm/a")}
    assert len(plans) == 2 and not any("hashpartitioning" in p for p in plans)


def test_results_are_found_once_for_each_package_url(spark):
    """Rows that share a package URL had their keys worked out one by one, and were shuffled with them."""
    rows = spark.createDataFrame([(1, "pkg:npm/a@1"), (2, "pkg:npm/a@1"), (2, "pkg:npm/a@2"), (3, "no url"), (4, None), (5, "pkg:npm/z@1")], "project_id BIGINT, purl STRING")
    assessed = spark.createDataFrame([("pkg:npm/a", "ok", None, 2, None)], "canonical_key STRING, verdict STRING, error STRING, advisory_count BIGINT, transitive_count BIGINT")
    each = entrypoints._with_results(rows, assessed)
    once = entrypoints._with_results(rows, assessed, rows.unionByName(rows))
    assert once.columns == each.columns
    assert sorted(map(repr, once.collect())) == sorted(map(repr, each.collect()))
    assert {(r.project_id, r.verdict) for r in once.collect()} == {(1, "ok"), (2, "ok"), (3, "review"), (4, "review"), (5, "review")}
