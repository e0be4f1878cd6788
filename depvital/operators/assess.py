"""Lifecycle, build-integrity and verdict labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.config import (
    BUILD_CHECKS,
    BUILD_HARDENED_MIN,
    BUILD_MIN_SIGNALS,
    BUILD_MODERATE_MIN,
    DEFAULTS,
    LABELS,
    NO_DATE_DAYS,
    NO_DATE_YEARS,
    VCS_DIRECT_ECOSYSTEMS,
    VERDICTS,
    Thresholds,
)
from depvital.functions.scalars import age_days, round_half_up, severity

# Columns a lifecycle input row has; every fact may be NULL.
LIFECYCLE_INPUTS = (
    "ecosystem",
    "stable",  # struct version, published_at
    "prerelease",
    "max_semver",
    "requested",
    "maintained_score",
    "vulnerability_score",
    "has_commit_data",
    "latest_human_commit",
    "days_since_commit",
    "archived",
    "disabled",
    "advisory_count",
    "high_count",
    "unknown_count",
    "eol_state",  # EOL, Scheduled or NULL
    "eol_reason",
    "eol_successor",
)


# Ordered rules: condition, label, reason, rule name. Conditions read the columns prepared in lifecycle();
# a label or reason in parentheses is an expression.
_RULES = (
    ("eol_state = 'Scheduled'", "EOL-Scheduled", "('Scheduled EOL' || _successor)", "planned_eol"),
    ("archived OR disabled", "EOL-Confirmed", "Repository archived or disabled", "archived_or_disabled"),
    ("eol_state = 'EOL'", "EOL-Confirmed", "(coalesce(eol_reason, 'End of life') || _successor)", "primary_eol"),
    ("(_maint < 0 OR _vuln < 0) AND latest_human_commit IS NOT NULL AND _human > {dormant} AND _has_advisories"
     " AND _severe", "EOL-Effective", "Unmaintained, unpatched vulnerabilities", "residual_vulnerabilities"),
    ("_stable_age <= {recent}", "Active", "Actively maintained with recent releases", "recent_stable"),
    ("_pre_age <= {recent_pre}", "Active", "Actively maintained with recent pre-release", "recent_prerelease"),
    ("_human <= {commit_gap} AND ecosystem IN ({vcs_direct})", "Active", "Active commits (VCS-direct delivery)",
     "commits_vcs_direct"),
    ("_human <= {commit_gap} AND _maint >= {maint_ok}", "Active", "Active commits, no recent publish",
     "commits_maintained"),
    ("_human <= {commit_gap} AND _maint < 0", "Active", "Active commits, scorecard unavailable",
     "commits_no_scorecard"),
    ("_human <= {commit_gap}", "Stalled", "Active commits but low maintenance", "commits_low_maintenance"),
    ("days_since_commit >= {commit_missing}", "Review Needed", "Commit data missing", "commit_data_missing"),
    # commit data, no recent activity
    ("_commit AND _vuln >= {vuln_good} AND _years >= {frozen_years}", "Legacy-Safe",
     "Dormant but no known vulnerabilities", "safe_by_vulnerability_score"),
    ("_commit AND _vuln >= {vuln_good}", "Stalled", "Low vulnerability risk but inactive",
     "stalled_good_vulnerability_score"),
    ("_commit AND _adv = 0 AND _human > {dormant}", "Legacy-Safe", "Dormant but no known vulnerabilities",
     "safe_no_advisories"),
    ("_commit AND _low AND _human > {dormant} AND _vuln >= 0 AND _vuln < {vuln_poor}", "EOL-Effective",
     "Unmaintained, unpatched vulnerabilities", "low_maintenance_vulnerable"),
    ("_commit AND _low AND _human > {dormant}", "Stalled", "Low maintenance, long-term inactive",
     "low_maintenance_dormant"),
    ("_commit AND _low", "Stalled", "Low maintenance", "low_maintenance"),
    ("_commit AND _maint >= 0", "Stalled", "Maintained but no recent activity", "maintained_inactive"),
    ("_commit AND _publish <= {dormant}", "Stalled", "No recent activity, recent publish",
     "inactive_recent_publish"),
    ("_commit AND _publish > {dormant} AND _human > {dormant}", "Stalled", "Long-term inactive, no recent releases",
     "inactive_old_publish"),
    ("_commit AND _publish IS NULL", "Stalled", "No recent activity, no registry data", "inactive_no_registry"),
    ("_commit", "Review Needed", "Insufficient data for assessment", "commit_inconclusive"),
    # no commit data
    ("_maint >= {maint_ok}", "Stalled", "Maintained but no commit data", "no_commit_maintained"),
    ("_maint >= 0 AND _has_advisories AND _publish > {dormant}", "(_by_severity)",
     "Unmaintained, unpatched vulnerabilities", "no_commit_low_vulnerable"),
    ("_maint >= 0", "Stalled", "Low maintenance, no commit data", "no_commit_low"),
    ("_has_advisories AND _publish > {dormant}", "(_by_severity)", "Unpatched vulnerabilities, no recent releases",
     "no_commit_vulnerable_old"),
    ("_has_advisories", "Stalled", "Unpatched vulnerabilities, recent publish", "no_commit_vulnerable_recent"),
    ("_publish <= {recent}", "Active", "Recently published, no known vulnerabilities", "no_commit_recent_publish"),
    ("_publish <= {dormant}", "Stalled", "No vulnerabilities but no recent releases", "no_commit_mid_publish"),
    ("_publish IS NOT NULL", "Legacy-Safe", "Dormant but no known vulnerabilities", "no_commit_old_publish"),
    ("TRUE", "Review Needed", "Insufficient data for assessment", "no_data"),
)


def _sql(text: str) -> str:
    return text if text.startswith("(") else "'" + text.replace("'", "\\'") + "'"


def _rule_case(cfg: Thresholds) -> str:
    """The ordered rules as one CASE expression; the first condition that holds wins."""
    limits = {
        "recent": cfg.recent_stable_days,
        "recent_pre": cfg.recent_prerelease_days,
        "commit_gap": cfg.human_commit_gap_days,
        "commit_missing": cfg.recent_stable_days * cfg.legacy_frozen_years * 10,
        "frozen_years": cfg.legacy_frozen_years,
        "dormant": cfg.eol_inactivity_days,
        "vuln_good": cfg.vuln_good_min,
        "vuln_poor": cfg.vuln_poor_max,
        "maint_ok": cfg.maintenance_ok_min,
        "vcs_direct": ", ".join(f"'{e}'" for e in VCS_DIRECT_ECOSYSTEMS),
    }
    branches = [
        f"WHEN {condition.format(**limits)} THEN "
        f"named_struct('label', {_sql(label)}, 'reason', {_sql(reason)}, 'rule', '{rule}')"
        for condition, label, reason, rule in _RULES
    ]
    return "CASE " + " ".join(branches) + " END"


def lifecycle(analysis: DataFrame, as_of: str, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Add lifecycle (struct label, reason, rule): an ordered rule list in one CASE."""
    slots = ("stable", "prerelease", "max_semver", "requested")
    ages = {slot: age_days(F.col(f"{slot}.published_at"), as_of) for slot in slots}
    prepared = {
        "_stable_age": ages["stable"],
        "_pre_age": ages["prerelease"],
        "_publish": F.least(*ages.values()),
        "_human": F.coalesce(age_days(F.col("latest_human_commit"), as_of), F.lit(NO_DATE_DAYS)),
        "_maint": F.expr("coalesce(cast(maintained_score AS DOUBLE), -1.0D)"),
        "_vuln": F.expr("coalesce(cast(vulnerability_score AS DOUBLE), -1.0D)"),
        "_adv": F.expr("coalesce(advisory_count, 0)"),
        "_commit": F.expr("coalesce(has_commit_data, false)"),
        "_successor": F.expr("coalesce('; successor: ' || nullif(eol_successor, ''), '')"),
    }
    derived = {
        "_years": F.expr(f"CASE WHEN _human = {NO_DATE_DAYS} THEN {NO_DATE_YEARS}D ELSE _human / 365.0D END"),
        "_low": F.expr(f"_maint >= 0 AND _maint < {cfg.maintenance_ok_min}"),
        "_has_advisories": F.expr(f"_adv >= {cfg.residual_advisories} AND _adv > 0"),
        "_severe": F.expr("_adv > 0 AND (coalesce(unknown_count, 0) > 0 OR coalesce(high_count, 0) > 0)"),
    }
    by_severity = {"_by_severity": F.expr("CASE WHEN _severe THEN 'EOL-Effective' ELSE 'Stalled' END")}
    return (
        analysis.withColumns(prepared)
        .withColumns(derived)
        .withColumns(by_severity)
        .withColumn("lifecycle", F.expr(_rule_case(cfg)))
        .drop(*prepared, *derived, *by_severity)
    )


# What each rule looked at, in order; "advisories" stands for the count and the worst severity.
_RULE_SIGNALS = {
    "planned_eol": "eol_source eol_scheduled_date",
    "archived_or_disabled": "repo_archived repo_disabled",
    "primary_eol": "eol_source",
    "residual_vulnerabilities": "last_human_commit maintained_score advisories",
    "recent_stable": "recent_stable_release last_human_commit maintained_score",
    "recent_prerelease": "recent_pre_release last_human_commit maintained_score",
    "commits_vcs_direct": "last_human_commit ecosystem_delivery maintained_score",
    "commit_data_missing": "last_human_commit",
    "safe_by_vulnerability_score": "last_human_commit advisories",
    "stalled_good_vulnerability_score": "last_human_commit advisories",
    "safe_no_advisories": "last_human_commit advisory_count",
    "low_maintenance_vulnerable": "last_human_commit maintained_score advisories",
    "inactive_recent_publish": "last_human_commit days_since_release maintained_score",
    "inactive_old_publish": "last_human_commit days_since_release maintained_score",
    "no_commit_low_vulnerable": "last_human_commit maintained_score days_since_release advisories",
    "no_commit_vulnerable_old": "last_human_commit maintained_score days_since_release advisories",
    "no_commit_vulnerable_recent": "last_human_commit maintained_score days_since_release advisories",
    "no_commit_recent_publish": "days_since_release advisory_count",
    "no_commit_mid_publish": "days_since_release advisory_count",
    "no_commit_old_publish": "days_since_release advisory_count",
}
_DEFAULT_SIGNALS = "last_human_commit maintained_score"
# signals that are left out, not reported as absent, when they have no value
_OPTIONAL_SIGNALS = ("eol_scheduled_date", "repo_archived", "repo_disabled", "max_advisory_severity")


def lifecycle_signals(labelled: DataFrame, as_of: str, key: str = "package_id") -> DataFrame:
    """Facts behind each lifecycle label: key, rule, position, name, value and role (used or absent)."""
    split = lambda names: names.replace("advisories", "advisory_count max_advisory_severity").split()
    literal = lambda names: F.array(*[F.lit(n) for n in split(names)])
    by_rule = F.create_map(*[x for rule, names in _RULE_SIGNALS.items() for x in (F.lit(rule), literal(names))])
    names = F.coalesce(F.try_element_at(by_rule, F.col("lifecycle_rule")), literal(_DEFAULT_SIGNALS))
    score = F.col("max_cvss3")
    values = {
        "eol_source": F.when(F.col("eol_state") == "Scheduled", "scheduled").otherwise(
            F.coalesce(F.lower("eol_source"), F.lit("primary-source"))
        ),
        "eol_scheduled_date": F.col("eol_scheduled"),
        "repo_archived": F.when(F.col("archived"), "true"),
        "repo_disabled": F.when(F.col("disabled"), "true"),
        "last_human_commit": F.when(F.col("has_commit_data"), F.date_format("latest_human_commit", "yyyy-MM-dd")),
        "maintained_score": F.when(
            F.col("maintained_score") >= 0, F.concat(F.col("maintained_score").cast("string"), F.lit("/10"))
        ),
        "recent_stable_release": F.lit("true"),
        "recent_pre_release": F.lit("true"),
        "ecosystem_delivery": F.lit("vcs-direct"),
        "advisory_count": F.coalesce("advisory_count", F.lit(0)).cast("string"),
        "max_advisory_severity": F.when(score > 0, F.concat(severity(score), F.lit(" "), F.format_string("%.1f", score))),
        "days_since_release": F.least(
            *[age_days(F.col(f"{s}.published_at"), as_of) for s in ("stable", "prerelease", "max_semver", "requested")]
        ).cast("string"),
    }
    table = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])
    named = labelled.select(key, "lifecycle_rule", table.alias("_values"), names.alias("_names"))
    # outer: the list is never empty, and no test for that is to be pushed through the rules above
    rows = named.select(key, "lifecycle_rule", "_values", F.posexplode_outer("_names").alias("position", "name")).select(
        key, "lifecycle_rule", "position", "name", F.try_element_at("_values", F.col("name")).alias("value")
    )
    return rows.where(F.col("value").isNotNull() | ~F.col("name").isin(*_OPTIONAL_SIGNALS)).withColumn(
        "role", F.when(F.col("value").isNull(), "absent").otherwise("used")
    )


def final_status(eol_state: Column, eol_scheduled: Column, label: Column) -> Column:
    """One status for consumers: registry end of life first, then planned end, then the label."""
    return (
        F.when((eol_state == "EOL") & eol_scheduled.isNotNull(), "EOL-Effective")
        .when(eol_state == "EOL", "EOL-Confirmed")
        .when(eol_state == "Scheduled", "EOL-Scheduled")
        .otherwise(F.coalesce(label, F.lit("Review Needed")))
    )


def verdict(error: Column, archived: Column, eol_state: Column, label: Column) -> Column:
    """ok, caution, replace or review."""
    return (
        F.when(error.isNotNull(), "review")
        .when(archived, "replace")
        .when(eol_state == "EOL", "replace")
        .when(eol_state == "Scheduled", "caution")
        .when(label.isin("Active", "Legacy-Safe"), "ok")
        .when(label.isin("Stalled", "EOL-Scheduled"), "caution")
        .when(label.isin("EOL-Confirmed", "EOL-Effective"), "replace")
        .otherwise("review")
    )


def build_integrity(scores: DataFrame, key: str = "repo_id") -> DataFrame:
    """Weighted mean of six checks per repository; fewer than three known checks stay ungraded.

    ``scores`` has the key, check_name, score. The label uses the unrounded mean.
    """
    weight = F.create_map(*[F.lit(x) for pair in BUILD_CHECKS for x in pair])[F.col("check_name")]
    known = scores.where(F.col("check_name").isin(*[c for c, _ in BUILD_CHECKS]) & (F.col("score") >= 0))
    sums = known.groupBy(key).agg(
        F.sum(weight * F.col("score")).alias("weighted"),
        F.sum(weight).alias("weights"),
        F.count(F.lit(1)).alias("signals"),
    )
    graded = F.col("signals") >= BUILD_MIN_SIGNALS
    raw = F.col("weighted") / F.col("weights")
    return sums.select(
        key,
        F.col("signals").alias("build_signals"),
        F.when(graded, round_half_up(raw, 1)).alias("build_score"),
        build_label(F.when(graded, raw)).alias("build_label"),
    )


def build_label(raw_score: Column) -> Column:
    return (
        F.when(raw_score.isNull() | (raw_score < 0), "Ungraded")
        .when(raw_score >= BUILD_HARDENED_MIN, "Hardened")
        .when(raw_score >= BUILD_MODERATE_MIN, "Moderate")
        .otherwise("Weak")
    )


Axis = Callable[[DataFrame], DataFrame]


def assess_axes(analysis: DataFrame, axes: Iterable[Axis]) -> DataFrame:
    """Run assessment axes in order; each adds its own columns."""
    for axis in axes:
        analysis = analysis.transform(axis)
    return analysis


def filter_verdicts(entries: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Rows with one of the given verdicts; an unknown name is an error."""
    names = [w.strip().lower() for w in wanted]
    unknown = sorted(set(names) - set(VERDICTS))
    if unknown:
        raise ValueError(f"unknown verdict: {', '.join(unknown)}")
    return entries.where(F.col("verdict").isin(*names)) if names else entries


def filter_labels(entries: DataFrame, only_review: bool = False, only_eol: bool = False) -> DataFrame:
    """Only rows needing review (an empty label counts), only end-of-life rows, or both together."""
    status = F.col("status")
    review = status.isNull() | (status == "") | (status == "Review Needed")
    eol = F.coalesce(status.startswith("EOL-"), F.lit(False))
    if only_review and only_eol:
        return entries.where(review | eol)
    if only_review:
        return entries.where(review)
    return entries.where(eol) if only_eol else entries


# --- fixed values: labels a policy may name ------------------------------------
POLICY_LABELS = {
    "eol-confirmed": "EOL-Confirmed",
    "eol-effective": "EOL-Effective",
    "eol-scheduled": "EOL-Scheduled",
    "stalled": "Stalled",
    "legacy-safe": "Legacy-Safe",
}


def fail_policy(entries: DataFrame, labels: Iterable[str], key: str = "project_id") -> DataFrame:
    """Whether any row of a project carries one of the named labels."""
    names = [name.strip().lower() for name in labels if name.strip()]
    unknown = [name for name in names if name not in POLICY_LABELS]
    if unknown:
        raise ValueError(f"label not selectable: {', '.join(unknown)}")
    hit = F.col("lifecycle_label").isin(*[POLICY_LABELS[n] for n in names]) if names else F.lit(False)
    return entries.groupBy(key).agg(
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("failed"), F.count_if(hit).alias("hits")
    )


def filter_relation(dependencies: DataFrame, show_transitive: bool = False) -> DataFrame:
    """Drop transitive rows unless asked for; an unknown relation is kept."""
    if show_transitive:
        return dependencies
    return dependencies.where(F.col("relation").isNull() | (F.col("relation") != "transitive"))


def is_success(error: Column, score_count: Column, label: Column) -> Column:
    return error.isNull() & ((F.coalesce(score_count, F.lit(0)) > 0) | (F.coalesce(label, F.lit("")) != ""))


def known_labels() -> tuple[str, ...]:
    return LABELS
