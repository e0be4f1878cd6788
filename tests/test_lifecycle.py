from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from depvital.operators import assess

AS_OF = "2024-02-01 00:00:00"
NOW = dt.datetime(2024, 2, 1)
SCHEMA = (
    "name STRING, ecosystem STRING, stable STRUCT<version: STRING, published_at: TIMESTAMP>, "
    "prerelease STRUCT<version: STRING, published_at: TIMESTAMP>, max_semver STRUCT<version: STRING, published_at: TIMESTAMP>, "
    "requested STRUCT<version: STRING, published_at: TIMESTAMP>, maintained_score INT, vulnerability_score INT, "
    "has_commit_data BOOLEAN, latest_human_commit TIMESTAMP, days_since_commit INT, archived BOOLEAN, disabled BOOLEAN, "
    "advisory_count BIGINT, high_count BIGINT, unknown_count BIGINT, eol_state STRING, eol_reason STRING, eol_successor STRING"
)


def case(name, *, eco="npm", stable=None, pre=None, top=None, maint=None, vuln=None, commit=None, has_commit=None,
         archived=False, disabled=False, adv=0, high=0, unknown=0, eol=None, reason=None, successor=None):
    ago = lambda d: None if d is None else ("1.0.0", NOW - dt.timedelta(days=d))
    human = None if commit is None else NOW - dt.timedelta(days=commit)
    return (
        name, eco, ago(stable), ago(pre), ago(top), None, maint, vuln,
        has_commit if has_commit is not None else commit is not None, human, commit, archived, disabled, adv, high, unknown,
        eol, reason, successor,
    )


CASES = [
    # (row, label, rule)
    (case("planned", eol="Scheduled", successor="next", archived=True), "EOL-Scheduled", "planned_eol"),
    (case("archived", archived=True, stable=1), "EOL-Confirmed", "archived_or_disabled"),
    (case("disabled", disabled=True), "EOL-Confirmed", "archived_or_disabled"),
    (case("eol", eol="EOL", reason="Gone", stable=1), "EOL-Confirmed", "primary_eol"),
    (case("residual", commit=800, adv=2, unknown=1, stable=900), "EOL-Effective", "residual_vulnerabilities"),
    (case("residual low severity", commit=800, adv=2, stable=900, maint=1), "Stalled", "low_maintenance_dormant"),
    (case("stable 365", stable=365), "Active", "recent_stable"),
    (case("stable 366", stable=366), "Stalled", "no_commit_mid_publish"),
    (case("prerelease 180", stable=900, pre=180), "Active", "recent_prerelease"),
    (case("prerelease 181", stable=900, pre=181, commit=400, maint=5), "Stalled", "maintained_inactive"),
    (case("vcs", eco="golang", commit=10, stable=900), "Active", "commits_vcs_direct"),
    (case("maintained", commit=180, maint=3, stable=900), "Active", "commits_maintained"),
    (case("no scorecard", commit=180, stable=900), "Active", "commits_no_scorecard"),
    (case("low", commit=180, maint=2, stable=900), "Stalled", "commits_low_maintenance"),
    (case("commit 181", commit=181, maint=2, stable=900), "Stalled", "low_maintenance"),
    (case("safe score", commit=1095, vuln=8, maint=0, stable=900), "Legacy-Safe", "safe_by_vulnerability_score"),
    (case("inactive good score", commit=1094, vuln=8, maint=0, stable=900), "Stalled", "stalled_good_vulnerability_score"),
    (case("bots only", has_commit=True, vuln=9, maint=1, stable=900), "Legacy-Safe", "safe_by_vulnerability_score"),
    (case("no advisories 731", commit=731, maint=1, vuln=5, stable=900), "Legacy-Safe", "safe_no_advisories"),
    (case("no advisories 730", commit=730, maint=1, vuln=5, stable=900), "Stalled", "low_maintenance"),
    (case("poor", commit=800, maint=1, vuln=2, adv=1, high=1, stable=900), "EOL-Effective", "low_maintenance_vulnerable"),
    (case("middling", commit=800, maint=1, vuln=3, adv=1, high=1, stable=900), "Stalled", "low_maintenance_dormant"),
    (case("recent publish", commit=400, stable=700), "Stalled", "inactive_recent_publish"),
    (case("old publish", commit=800, stable=800, adv=1), "Stalled", "inactive_old_publish"),
    (case("no registry", commit=400), "Stalled", "inactive_no_registry"),
    (case("inconclusive", commit=400, stable=800), "Review Needed", "commit_inconclusive"),
    (case("no commit ok", maint=3, stable=900), "Stalled", "no_commit_maintained"),
    (case("no commit low high", maint=1, adv=1, high=1, stable=731), "EOL-Effective", "no_commit_low_vulnerable"),
    (case("no commit low unknown", maint=1, adv=1, unknown=1, stable=731), "EOL-Effective", "no_commit_low_vulnerable"),
    (case("no commit low minor", maint=1, adv=1, stable=731), "Stalled", "no_commit_low_vulnerable"),
    (case("no commit low", maint=1, stable=731), "Stalled", "no_commit_low"),
    (case("vulnerable old", adv=1, high=1, stable=731), "EOL-Effective", "no_commit_vulnerable_old"),
    (case("vulnerable old minor", adv=1, stable=731), "Stalled", "no_commit_vulnerable_old"),
    (case("vulnerable recent", adv=1, high=1, stable=730), "Stalled", "no_commit_vulnerable_recent"),
    (case("recent by another slot", top=300), "Active", "no_commit_recent_publish"),
    (case("mid publish", top=500), "Stalled", "no_commit_mid_publish"),
    (case("legacy", top=800), "Legacy-Safe", "no_commit_old_publish"),
    (case("nothing"), "Review Needed", "no_data"),
    (case("future publish", stable=-3), "Active", "recent_stable"),
]


def test_every_rule(spark):
    rows = assess.lifecycle(spark.createDataFrame([c[0] for c in CASES], SCHEMA), AS_OF).collect()
    got = {r.name: (r.lifecycle.label, r.lifecycle.rule) for r in rows}
    assert got == {c[0][0]: (c[1], c[2]) for c in CASES}
    reasons = {r.name: r.lifecycle.reason for r in rows}
    assert reasons["planned"] == "Scheduled EOL; successor: next"
    assert reasons["eol"] == "Gone"


def test_all_rules_are_covered():
    reachable = {rule[3] for rule in assess._RULES} - {"commit_data_missing"}
    assert reachable == {c[2] for c in CASES}


def test_verdict_precedence(spark):
    rows = [
        ("error", True, "EOL", "Active", "review"),
        (None, True, "Scheduled", "Active", "replace"),
        (None, False, "EOL", "Active", "replace"),
        (None, False, "Scheduled", "Active", "caution"),
        (None, False, None, "Active", "ok"),
        (None, False, None, "Legacy-Safe", "ok"),
        (None, False, None, "Stalled", "caution"),
        (None, False, None, "EOL-Effective", "replace"),
        (None, False, None, "EOL-Scheduled", "caution"),
        (None, False, None, "Review Needed", "review"),
        (None, False, None, None, "review"),
    ]
    df = spark.createDataFrame(rows, "error STRING, archived BOOLEAN, eol STRING, label STRING, want STRING")
    got = df.select("want", assess.verdict(F.col("error"), F.col("archived"), F.col("eol"), F.col("label")).alias("v"))
    assert all(r.want == r.v for r in got.collect())


def test_final_status(spark):
    rows = [("EOL", "2025", "Active", "EOL-Effective"), ("EOL", None, "Active", "EOL-Confirmed"),
            ("Scheduled", None, "Active", "EOL-Scheduled"), (None, None, "Stalled", "Stalled"), (None, None, None, "Review Needed")]
    df = spark.createDataFrame(rows, "state STRING, scheduled STRING, label STRING, want STRING")
    got = df.select("want", assess.final_status(F.col("state"), F.col("scheduled"), F.col("label")).alias("s")).collect()
    assert all(r.want == r.s for r in got)


def test_build_integrity(spark):
    rows = [(1, "Dangerous-Workflow", 10), (1, "Branch-Protection", 0), (2, "Dangerous-Workflow", 10),
            (2, "Branch-Protection", 5), (2, "Code-Review", 5), (3, "Dangerous-Workflow", 0), (3, "Branch-Protection", -1),
            (3, "Code-Review", 3), (3, "Token-Permissions", 4), (4, "SAST", 10)]
    got = {r.repo_id: r for r in assess.build_integrity(
        spark.createDataFrame(rows, "repo_id BIGINT, check_name STRING, score BIGINT")).collect()}
    assert got[1].build_label == "Ungraded" and got[1].build_score is None
    assert got[2].build_label == "Moderate" and got[2].build_score == 7.0
    assert got[3].build_label == "Weak" and got[3].build_signals == 3
    assert 4 not in got


def test_filters_and_policy(spark):
    rows = [(1, "ok", "Active", "Active"), (1, "replace", "EOL-Confirmed", "EOL-Confirmed"), (2, "review", None, None),
            (2, "review", "Review Needed", "Review Needed")]
    df = spark.createDataFrame(rows, "project_id BIGINT, verdict STRING, status STRING, lifecycle_label STRING")
    assert assess.filter_verdicts(df, ["OK", "replace"]).count() == 2
    assert assess.filter_labels(df, only_review=True).count() == 2
    assert assess.filter_labels(df, only_eol=True).count() == 1
    assert assess.filter_labels(df, True, True).count() == 3
    got = {r.project_id: r.failed for r in assess.fail_policy(df, ["eol-confirmed"]).collect()}
    assert got == {1: True, 2: False}
    with pytest.raises(ValueError):
        assess.filter_verdicts(df, ["bad"])
    with pytest.raises(ValueError):
        assess.fail_policy(df, ["active"])
    relations = spark.createDataFrame([("direct",), ("transitive",), (None,)], "relation STRING")
    assert assess.filter_relation(relations).count() == 2
    assert assess.filter_relation(relations, True).count() == 3
