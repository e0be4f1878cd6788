"""Version columns: stability test and a sortable semantic-version key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words that mark an unstable version ------------------------
UNSTABLE_WORDS = ("alpha", "beta", "rc", "dev", "snapshot", "pre", "preview")

_CORE = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z.-]+)?$"


def is_stable_looking(version: Column) -> Column:
    """No unstable word anywhere in the version text."""
    found = F.lower(version).rlike("|".join(UNSTABLE_WORDS))
    return (version != "") & ~found


def is_semver(version: Column) -> Column:
    """Lenient test: leading v and missing minor or patch are accepted."""
    return version.rlike(_CORE)


def prerelease_part(version: Column) -> Column:
    return F.regexp_extract(version, _CORE, 4)


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def semver_key(version: Column) -> Column:
    """Struct that orders like semantic-version precedence; NULL when the text is no version.

    A release sorts above its pre-releases; numeric identifiers sort below words, and a shorter
    identifier list below a longer one with the same start (array comparison does both).
    """
    # one pass of the pattern instead of one for each of its groups
    parts = F.split(F.regexp_replace(version, _CORE, "$1|$2|$3|$4"), r"\|")
    pre = parts[3]
    number = r"^\d+$"
    idents = F.transform(
        F.split(pre, r"\."),
        lambda part: F.struct(
            (~part.rlike(number)).cast("int").alias("is_word"),
            F.when(part.rlike(number), part.try_cast("decimal(38,0)")).otherwise(F.lit(0).cast("decimal(38,0)")).alias("num"),
            F.when(part.rlike(number), F.lit("")).otherwise(part).alias("word"),
        ),
    )
    release = F.array(F.struct(F.lit(1).alias("is_word"), F.lit(0).cast("decimal(38,0)").alias("num"), F.lit("").alias("word")))
    return F.when(
        is_semver(version),
        F.struct(
            _number(parts[0]).alias("major"),
            _number(parts[1]).alias("minor"),
            _number(parts[2]).alias("patch"),
            (pre == "").cast("int").alias("is_release"),
            F.when(pre == "", release).otherwise(idents).alias("pre"),
        ),
    )
