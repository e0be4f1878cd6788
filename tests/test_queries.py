from __future__ import annotations

import pytest

import __spark_entry__ as driver
import check
from depvital.plans.fixtures import SNAPSHOTS, Fixtures
from depvital.sources import facts

SF = "/root/testdata/sf0.001"
# a cross-section; check.py compares all of them
NAMES = [
    "release_slots", "advisory_metrics", "build_integrity", "registry_rule_hits", "label_distribution", "scan_summary",
    "graph_metrics", "diet_plan", "transitive_advisories", "top_advisories", "eol_text_readme", "license_report",
    "license_mentions", "coupling_metrics", "package_keys", "sbom_direct", "go_requirements", "workflow_refs", "vanity_repos",
    "scan_from_inputs", "scan_from_sbom", "scan_from_gomod", "scan_from_repos", "diet_from_sbom", "diet_export", "graph_choice", "scorecard_wide",
    "ordered_distribution", "ordered_entries", "reachability", "lifecycle_signals", "scan_advisories", "input_sample", "dedup_inputs", "scan_rows",
]


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    ok, note = check.compare(name, spark, duck, SF)
    assert ok, note


def test_contract(spark):
    queries, statements = driver.queries(), driver.oracle_sql()
    assert set(statements) <= set(queries)
    assert {n for n in set(queries) - set(statements) if not n.startswith("op") and n != "pipeline"} == set()
    assert driver.entry(spark).columns == ["label", "reason", "packages", "percent", "bucket"]
    assert {name.removeprefix("fx_") for name in SNAPSHOTS} <= set(facts.SCHEMAS)


def test_plan_from_documents_equals_plan_from_tables(spark):
    """Projects whose documents name their direct dependencies (0 and 2 of 4) get the plan that the edge tables give."""
    queries = driver.queries()
    from_tables = {
        (r.project_id, r.package_id): r.priority for r in queries["graph_only_plan"](spark, SF).collect()
    }
    fixtures = Fixtures(spark, SF)
    ids = {r.purl: r.package_id for r in fixtures["fx_packages"].select("purl", "package_id").collect()}
    rows = [r for r in queries["diet_from_sbom"](spark, SF).collect() if r.project_id % 4 in (0, 2)]
    assert rows and any(r.scope == "tool" for r in rows)
    for r in rows:
        assert r.scope is not None or from_tables[r.project_id, ids[r.purl]] == r.priority


def test_scans_find_facts(spark):
    """Module files and repositories lead to packages and repositories that facts are known of, and to some without."""
    rows = driver.queries()["scan_from_gomod"](spark, SF).collect()
    required = driver.queries()["go_requirements"](spark, SF).collect()
    assert sorted((r.project_id, r.purl) for r in rows) == sorted((r.project_id, r.purl) for r in required)
    assert len({r.verdict for r in rows}) >= 3 and all(r.verdict == "review" for r in rows if r.error)
    rows = driver.queries()["scan_from_repos"](spark, SF).collect()
    assert {r.source for r in rows} >= {"purl", "repository", "actions", "actions-local"}
    assert len({r.verdict for r in rows if r.source in ("repository", "actions")}) >= 3
    assert all(r.via for r in rows if r.source in ("actions-local", "actions-transitive"))
