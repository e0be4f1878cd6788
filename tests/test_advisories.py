from __future__ import annotations

from pyspark.sql import functions as F

from depvital.operators import advisories, reports
from depvital.plans import entrypoints, scan

VERSION = "struct<version:string,published_at:timestamp,is_deprecated:boolean>"


def packages(spark, rows):
    """(package_id, ecosystem, name, requested, stable, highest) as packages with slots."""
    raw = spark.createDataFrame(rows, "package_id BIGINT, ecosystem STRING, name STRING, version STRING, s STRING, m STRING")
    slot = lambda c: F.expr(f"CASE WHEN {c} IS NOT NULL THEN named_struct('version', {c}, 'published_at', CAST(NULL AS TIMESTAMP), 'is_deprecated', false) END")
    return raw.withColumns({"stable": slot("s"), "max_semver": slot("m")}).drop("s", "m")


def versions(spark, rows):
    return spark.createDataFrame(rows, "package_id BIGINT, version STRING").selectExpr(
        "*", "CAST(NULL AS TIMESTAMP) AS published_at", "false AS is_default", "false AS is_deprecated"
    )


GRAPHS = "package_id BIGINT, graph_version STRING, dependency_id BIGINT, dependency_version STRING"
ADVISORIES = "package_id BIGINT, version STRING, advisory_id STRING, cvss3 DOUBLE, relation STRING"


def test_graph_of_the_version_then_two_fallbacks(spark):
    slots = packages(
        spark,
        [
            (1, "npm", "a", "1.0.0", "2.0.0", "2.0.0"),  # the requested version has a graph
            (2, "npm", "b", None, "2.0.0", "3.0.0"),  # no request: the stable one
            (3, "npm", "c", "1.0.0", "2.0.0", "2.0.0"),  # only a fallback version has one
            (4, "npm", "d", "1.0.0", "9.0.0", "9.0.0"),  # the third best fallback is not tried
            (5, "nuget", "e", "1.0.0", "1.0.0", "1.0.0"),  # no graphs in this ecosystem
            (6, "npm", "f", None, None, None),  # no version at all
        ],
    )
    known = versions(spark, [(3, v) for v in ("1.0.0", "2.0.0", "1.9.0")] + [(4, v) for v in ("9.0.0", "8.0.0", "7.0.0", "1.0.0")])
    graphs = spark.createDataFrame([(1, "1.0.0", 9, "1"), (1, "2.0.0", 9, "1"), (2, "2.0.0", 9, "1"), (3, "1.9.0", 9, "1"), (4, "7.0.0", 9, "1"), (5, "1.0.0", 9, "1")], GRAPHS)
    got = {tuple(r) for r in advisories.choose_graphs(slots, known, graphs).collect()}
    assert got == {(1, "1.0.0", 0), (2, "2.0.0", 0), (3, "1.9.0", 2)}


def test_only_the_own_graph_and_its_node_versions_count(spark):
    slots = packages(spark, [(1, "npm", "a", "1.0.0", "1.0.0", "2.0.0"), (7, "npm", "other", "1.0.0", "1.0.0", "1.0.0"), (9, "npm", "dep", "1", "1", "1"), (8, "npm", "deep", "1", "1", "1")])
    graphs = spark.createDataFrame([(1, "1.0.0", 9, "1.5"), (1, "1.0.0", 8, "1"), (1, "2.0.0", 9, "2.0"), (7, "1.0.0", 9, "3.0")], GRAPHS)
    found = spark.createDataFrame(
        [
            (9, "1.5", "A-1", 5.0, None),  # the node's version
            (9, "2.0", "A-2", 5.0, None),  # a version of the graph of 2.0.0, which is not the one that was asked for
            (9, "3.0", "A-3", 5.0, None),  # a version in another package's graph
            (9, "1", "A-4", 5.0, None),  # the dependency's own stable version, not in any graph
            (8, "1", "A-1", 7.0, None),  # the same advisory by another dependency
            (8, "1", "A-5", 1.0, None),
            (1, "1.0.0", "A-5", 1.0, None),  # known for the version itself
        ],
        ADVISORIES,
    )
    rows = advisories.with_transitive(slots, found, versions(spark, []), graphs).where("relation = 'TRANSITIVE'").collect()
    got = {(r.package_id, r.version, r.advisory_id, r.cvss3, r.dependency_name) for r in rows}
    assert got == {(1, "1.0.0", "A-1", 7.0, "deep"), (7, "1.0.0", "A-3", 5.0, "dep")}


def test_actions_of_a_repository(spark):
    files = spark.createDataFrame(
        [
            ("r", ".github/workflows/ci.yml", "jobs:\n  a:\n    steps:\n      - uses: acme/direct@v1\n      - uses: ./.github/actions/one\n"),
            ("r", ".github/actions/one/action.yml", "runs:\n  using: composite\n  steps:\n    - uses: acme/local/sub@v1\n    - uses: acme/direct@v2\n"),
            ("r", "acme/direct/action.yml", "runs:\n  using: composite\n  steps:\n    - uses: lib/x@v1\n"),
            ("r", "acme/local/sub/action.yml", "runs:\n  using: composite\n  steps:\n    - uses: lib/y@v1\n"),
            ("r", "lib/y/action.yml", "runs:\n  using: composite\n  steps:\n    - uses: lib/z@v1\n    - uses: acme/direct@v1\n"),
        ],
        "scope STRING, path STRING, text STRING",
    )
    got = {(r.repo, r.source, r.via) for r in entrypoints.repository_actions(files).collect()}
    assert got == {
        ("acme/direct", "actions", None),
        ("acme/local", "actions-local", ".github/actions/one"),
        ("lib/x", "actions-transitive", "acme/direct"),
        ("lib/y", "actions-transitive", "acme/local/sub"),
        ("lib/z", "actions-transitive", "acme/local/sub"),
    }


def test_lists_are_cut_and_counted(spark):
    rows = spark.createDataFrame([(1, f"s{i % 25:02d}") for i in range(100)] + [(2, "only")], "k BIGINT, v STRING")
    got = {r.k: (r.names, r.names_count) for r in reports.first_values(rows, ["k"], "v", "names", 3).collect()}
    assert got == {1: ("s00;s01;s02", 25), 2: ("only", 1)}


def test_archived_by_the_check_where_the_state_is_unknown(spark):
    scores = spark.createDataFrame(
        [(1, "Maintained", 0, "Project is archived."), (2, "Maintained", 0, "no commits"), (3, "Fuzzing", 0, "project is archived")],
        "repo_id BIGINT, check_name STRING, score BIGINT, reason STRING",
    )
    assert {r.repo_id: r.archived_by_check for r in scan.repo_scores(scores).collect()} == {1: True, 2: False, 3: False}
