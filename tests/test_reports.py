from __future__ import annotations

from depvital.operators import reports


def test_scorecard_wide_has_every_check_of_the_table(spark):
    analysis = spark.createDataFrame(
        [(1, "pkg:npm/a", "https://github.com/o/a", 5.0, 1, 2, False, "Active", "r")],
        "repo_id long, purl string, repo_url string, overall_score double, days_since_stable int, days_since_prerelease int, "
        "archived boolean, lifecycle_label string, lifecycle_reason string",
    )
    scores = spark.createDataFrame([(1, "Maintained", 7), (1, "Own `odd`.check", 3), (2, "Webhooks", 4)], "repo_id long, check_name string, score int")
    wide = reports.scorecard_wide(analysis, scores)
    row = wide.collect()[0].asDict()
    assert row["Maintained"] == "7.00" and row["Own `odd`.check"] == "3.00" and row["Webhooks"] is None and row["Fuzzing"] is None
    assert "Own `odd`.check" not in reports.scorecard_wide(analysis, scores, ["Maintained"]).columns
