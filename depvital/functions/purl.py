"""Package URLs: parts, canonical keys, registry addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from depvital.functions.binding import let

# qualifiers and subpath start at the first ? or #
_PURL = r"^pkg:/*([A-Za-z][A-Za-z0-9.+-]*)/(.+)$"
# the version follows the last @ that is not the first character of a name part
_VERSION = r"[^/]@([^@]*)$"
_BEFORE_VERSION = r"(?<=[^/])@[^@]*$"


def _decoded(text: Column) -> Column:
    plain = lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    return let(text, lambda t: F.when(t.contains("%"), plain(t)).otherwise(t))


def purl_struct(raw: Column) -> Column:
    """Struct (type, namespace, name, version) of a package URL; NULL where it cannot be read."""

    def parts(bare: Column) -> Column:
        body = F.rtrim(F.regexp_extract(bare, _PURL, 2))
        path = F.regexp_replace(F.regexp_replace(body, _BEFORE_VERSION, ""), r"^/+|/+$", "")

        def named(p: Column) -> Column:
            return F.struct(
                F.lower(F.regexp_extract(bare, _PURL, 1)).alias("type"),
                F.nullif(_decoded(F.regexp_extract(p, r"^(.+)/[^/]+$", 1)), F.lit("")).alias("namespace"),
                _decoded(F.regexp_extract(p, r"([^/]+)$", 1)).alias("name"),
                F.nullif(_decoded(F.regexp_extract(body, _VERSION, 1)), F.lit("")).alias("version"),
            )

        return F.when(bare.rlike(_PURL), let(path, lambda p: F.when(p != "", named(p))))

    return let(F.regexp_replace(F.btrim(raw), r"[?#].*$", ""), parts)


def is_purl(raw: Column) -> Column:
    """A readable package URL: a type and a name."""
    return raw.rlike(r"^\s*pkg:/*[A-Za-z][A-Za-z0-9.+-]*/+[^/?#\s]")


def purl_type(raw: Column) -> Column:
    return purl_struct(raw)["type"]


def canonical_key(kind: Column, namespace: Column, name: Column) -> Column:
    """Lower-case key without version, qualifiers or subpath."""
    return F.lower(F.concat(F.lit("pkg:"), kind, F.lit("/"), F.concat_ws("/", namespace, name)))


def versionless(raw: Column) -> Column:
    """The input without its version, case and qualifiers kept."""
    head = F.regexp_extract(raw, r"^([^?#]*)", 1)
    tail = F.regexp_extract(raw, r"^[^?#]*(.*)$", 1)
    return F.concat(F.regexp_replace(head, _BEFORE_VERSION, ""), tail)


def repair_maven(purl: Column) -> Column:
    """group:artifact as group/artifact, if there is exactly one colon (also %3A) and a dotted group."""
    core = F.regexp_extract(purl, r"^pkg:maven/([^@?#]*)", 1)
    suffix = F.regexp_extract(purl, r"^pkg:maven/[^@?#]*(.*)$", 1)
    encoded = ~core.contains(":") & F.lower(core).rlike("^[^%]*(?:%(?!3a)[^%]*)*%3a(?!.*%3a)")
    plain = F.when(encoded, F.replace(F.lower(core), F.lit("%3a"), F.lit(":"))).otherwise(core)
    fits = purl.startswith("pkg:maven/") & plain.rlike(r"^[^:/]*\.[^:/]*:[^:/]+$")
    return F.when(fits, F.concat(F.lit("pkg:maven/"), F.replace(plain, F.lit(":"), F.lit("/")), suffix)).otherwise(purl)


def registry_name(ecosystem: Column, namespace: Column, name: Column) -> Column:
    """Name of a package as its registry spells it."""
    eco = F.lower(ecosystem)
    scope = F.concat(F.lit("@"), F.regexp_replace(namespace, "^@+", ""))
    return (
        F.when(namespace.isNull() | (namespace == ""), name)
        .when(eco == "maven", F.concat_ws(":", namespace, name))
        .when(eco == "npm", F.concat_ws("/", scope, name))
        .when(eco.isin("composer", "packagist", "golang"), F.concat_ws("/", namespace, name))
        .otherwise(name)
    )


# --- fixed values: registry pages ({n} name, {g} and {a} Maven parts, {v} version) -----
REGISTRY_PAGES = {
    "npm": ("https://www.npmjs.com/package/{n}", "https://www.npmjs.com/package/{n}/v/{v}"),
    "pypi": ("https://pypi.org/project/{n}/", "https://pypi.org/project/{n}/{v}/"),
    "gem": ("https://rubygems.org/gems/{n}", "https://rubygems.org/gems/{n}/versions/{v}"),
    "composer": ("https://packagist.org/packages/{n}", None),
    "golang": ("https://pkg.go.dev/{n}", "https://pkg.go.dev/{n}@{v}"),
    "maven": (
        "https://central.sonatype.com/artifact/{g}/{a}",
        "https://central.sonatype.com/artifact/{g}/{a}/{v}",
    ),
    "cargo": ("https://crates.io/crates/{n}", "https://crates.io/crates/{n}/{v}"),
    "nuget": ("https://www.nuget.org/packages/{n}", "https://www.nuget.org/packages/{n}/{v}"),
}


def _fill(template: str, values: dict[str, Column]) -> Column:
    pieces = [F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(re.split(r"\{(\w)\}", template))]
    return F.concat(*pieces)


def registry_urls(ecosystem: Column, name: Column, version: Column) -> dict[str, Column]:
    """Package and version page of a registry name; NULL where the registry has none."""
    values = {"n": name, "g": F.split_part(name, F.lit(":"), F.lit(1)), "a": F.split_part(name, F.lit(":"), F.lit(2)), "v": version}
    page, version_page = F.lit(None).cast("string"), F.lit(None).cast("string")
    for eco, (package_template, version_template) in REGISTRY_PAGES.items():
        match = F.lower(ecosystem) == eco
        if eco == "maven":
            match = match & name.rlike("^[^:]+:[^:]+$")
        page = F.when(match, _fill(package_template, values)).otherwise(page)
        if version_template:
            has_version = F.coalesce(version != "", F.lit(False))
            version_page = F.when(match & has_version, _fill(version_template, values)).otherwise(version_page)
    return {"registry_url": page, "version_url": version_page}
