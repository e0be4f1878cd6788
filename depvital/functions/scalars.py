"""Small column helpers used by several jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, as_of: str) -> Column:
    """Whole 24-hour blocks between the timestamp and the evaluation time, cut toward zero."""
    gap = micros(F.lit(as_of)) - micros(ts)
    return (F.signum(gap) * F.floor(F.abs(gap) / MICROS_PER_DAY)).cast("int")


def round_half_up(value: Column, digits: int) -> Column:
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def severity(cvss: Column) -> Column:
    """CVSS 3 base score to its severity band; NULL for zero and for no score."""
    return (
        F.when(cvss.isNull() | (cvss <= 0), F.lit(None).cast("string"))
        .when(cvss <= 3.9, "LOW")
        .when(cvss <= 6.9, "MEDIUM")
        .when(cvss <= 8.9, "HIGH")
        .otherwise("CRITICAL")
    )


def advisory_source(advisory_id: Column) -> Column:
    upper = F.upper(advisory_id)
    return (
        F.when(upper.startswith("GHSA-"), "GHSA")
        .when(upper.startswith("CVE-"), "CVE")
        .when(upper.startswith("GO-"), "OSV")
        .otherwise("OTHER")
    )


def advisory_url(advisory_id: Column) -> Column:
    upper = F.upper(advisory_id)
    return (
        F.when(upper.startswith("GHSA-"), F.concat(F.lit("https://github.com/advisories/"), advisory_id))
        .when(upper.startswith("CVE-"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), upper))
        .otherwise(F.concat(F.lit("https://osv.dev/"), upper))
    )
