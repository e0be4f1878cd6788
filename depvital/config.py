"""Thresholds and the evaluation time shared by all jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Ages are measured against this instant unless a job is given another one.
DEFAULT_AS_OF = "2024-02-01 00:00:00"

# Stand-in for "no date" where a rule compares ages.
NO_DATE_DAYS = 9999
NO_DATE_YEARS = 999.0


@dataclass(frozen=True)
class Thresholds:
    """Lifecycle rule thresholds (days unless named otherwise)."""

    recent_stable_days: int = 365
    recent_prerelease_days: int = 180
    human_commit_gap_days: int = 180
    legacy_frozen_years: int = 3
    eol_inactivity_days: int = 730
    vuln_good_min: float = 8.0
    vuln_poor_max: float = 3.0
    maintenance_ok_min: float = 3.0
    residual_advisories: int = 1
    high_cvss: float = 7.0


DEFAULTS = Thresholds()

# --- fixed values -----------------------------------------------------------
SUPPORTED_ECOSYSTEMS = ("npm", "pypi", "maven", "nuget", "cargo", "golang", "gem", "composer", "github")
GRAPH_ECOSYSTEMS = ("npm", "cargo", "maven", "pypi")
VCS_DIRECT_ECOSYSTEMS = ("golang", "composer")
LABELS = (
    "Active",
    "Stalled",
    "Legacy-Safe",
    "EOL-Confirmed",
    "EOL-Effective",
    "EOL-Scheduled",
    "Review Needed",
)
VERDICTS = ("ok", "caution", "replace", "review")
# (scorecard check, weight) of the build-integrity score
BUILD_CHECKS = (
    ("Dangerous-Workflow", 10.0),
    ("Branch-Protection", 7.5),
    ("Code-Review", 7.5),
    ("Token-Permissions", 7.5),
    ("Binary-Artifacts", 7.5),
    ("Pinned-Dependencies", 5.0),
)
BUILD_MIN_SIGNALS = 3
BUILD_HARDENED_MIN = 7.5
BUILD_MODERATE_MIN = 2.5
