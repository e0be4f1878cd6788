"""Licences: spelling normalisation, resolution per package, reports and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.functions.spdx import alias_key, dictionary, license_of_url

# --- fixed values: where a licence came from ---------------------------------------
PROJECT_SPDX = "depsdev-project-spdx"
PROJECT_OTHER = "depsdev-project-nonstandard"
VERSION_SPDX = "depsdev-version-spdx"
VERSION_RAW = "depsdev-version-raw"
GITHUB_SPDX = "github-project-spdx"
GITHUB_OTHER = "github-project-nonstandard"
POM_SPDX = "maven-pom-spdx"
POM_OTHER = "maven-pom-nonstandard"
FALLBACK = "project-fallback"
DERIVED = "derived-from-version"
NONSTANDARD_SOURCES = (PROJECT_OTHER, GITHUB_OTHER, VERSION_RAW, POM_OTHER)

_LICENSE = "struct<identifier:string,raw:string,source:string,is_spdx:boolean>"


def normalize_licenses(raws: DataFrame, spdx: DataFrame, raw: str = "raw") -> DataFrame:
    """Add license_id, is_spdx and match_type (exact, case-fold, alias, no-assertion, heuristic, none).

    Spellings are looked up in the dictionary by their upper-case form, then by alias key; both lookups are
    hash joins against the same small table. What no entry matches keeps its words joined by dashes.
    """
    entries = dictionary(spdx)
    text = F.btrim(F.coalesce(F.col(raw), F.lit("")))
    exact = entries.where("rank = 0").select(F.col("key").alias("_upper"), F.col("license_id").alias("_exact"))
    alias = entries.select(F.col("key").alias("_alias_key"), F.col("license_id").alias("_alias"))
    keyed = raws.withColumns({"_text": text, "_upper": F.upper(text), "_alias_key": alias_key(text)})
    found = F.coalesce("_exact", "_alias")
    silent = F.col("_upper").isin("NOASSERTION", "NONE")
    return (
        keyed.join(exact, "_upper", "left")
        .join(alias, "_alias_key", "left")
        .withColumns(
            {
                "match_type": F.when(F.col("_text") == "", "none")
                .when(silent, "no-assertion")
                .when(F.col("_exact") == F.col("_text"), "exact")
                .when(F.col("_exact").isNotNull() | (F.lower(found) == F.lower("_text")), "case-fold")
                .when(found.isNotNull(), "alias")
                .otherwise("heuristic"),
                "is_spdx": (F.col("_text") != "") & ~silent & found.isNotNull(),
                "license_id": F.when(F.col("_text") == "", F.lit(None))
                .when(silent, F.col("_upper"))
                .otherwise(F.coalesce(found, F.regexp_replace("_text", r"\s+", "-"))),
            }
        )
        .drop("_text", "_upper", "_alias_key", "_exact", "_alias")
    )


def license_url_lookup(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add url_license for addresses of well-known licence texts."""
    return urls.withColumn("url_license", license_of_url(F.col(url)))


# --- resolution -------------------------------------------------------------------------


def _license(identifier: Column, raw: Column, source: Column | str, is_spdx: Column | bool) -> Column:
    return F.struct(
        identifier.alias("identifier"),
        raw.alias("raw"),
        (source if isinstance(source, Column) else F.lit(source)).alias("source"),
        (is_spdx if isinstance(is_spdx, Column) else F.lit(is_spdx)).alias("is_spdx"),
    )


def _nonstandard(name: str) -> Column:
    column = F.col(name)
    return F.coalesce(~column["is_spdx"] & column["source"].isin(*NONSTANDARD_SOURCES), F.lit(False))


def _identified(name: str) -> Column:
    return F.coalesce(F.col(name)["identifier"] != "", F.lit(False))


def _none_spdx(name: str) -> Column:
    """The list has entries and none of them is a recognised licence."""
    return (F.size(name) > 0) & ~F.exists(name, lambda v: v["is_spdx"])


def spellings(facts: DataFrame) -> DataFrame:
    """All raw spellings of a package in one long table: package_id, slot, position, raw, url.

    ``facts`` has package_id, project_raw, github_spdx, github_name, version_spdx and version_raw (arrays),
    manifest (array of struct name, url).
    """
    none = F.lit(None).cast("string")

    def one(slot: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(slot).alias("slot"), F.lit(0).alias("position"), value.alias("raw"), none.alias("url")))

    def many(slot: str, name: str) -> Column:
        return F.transform(
            F.coalesce(F.col(name), F.array().cast("array<string>")),
            lambda v, i: F.struct(F.lit(slot).alias("slot"), i.alias("position"), v.alias("raw"), none.alias("url")),
        )

    manifest = F.transform(
        F.coalesce(F.col("manifest"), F.array().cast("array<struct<name:string,url:string>>")),
        lambda m, i: F.struct(F.lit("manifest").alias("slot"), i.alias("position"), m["name"].alias("raw"), m["url"].alias("url")),
    )
    rows = F.concat(
        one("project", F.col("project_raw")),
        one("github_spdx", F.col("github_spdx")),
        one("github_name", F.col("github_name")),
        many("version_spdx", "version_spdx"),
        many("version_raw", "version_raw"),
        manifest,
    )
    return facts.select("package_id", F.explode(rows).alias("s")).select("package_id", "s.*").where(
        "trim(coalesce(raw, '')) <> '' OR trim(coalesce(url, '')) <> ''"
    )


def resolve_licenses(facts: DataFrame, spdx: DataFrame) -> DataFrame:
    """project_license (struct) and version_licenses (array) of every package.

    ``facts`` as for ``spellings``, plus requested_known (the requested version exists). Order: project,
    version, project for a silent version, a single version for a silent project, repository host,
    manifest. A recognised licence is never replaced. All spellings are normalised in one join and come
    back in one grouped aggregation; the lists hold one package's own entries.
    """
    known = normalize_licenses(spellings(facts), spdx)
    from_url = license_of_url(F.col("url"))
    usable = F.col("license_id").isNotNull() & (F.upper("license_id") != "NOASSERTION")
    spdx_entry = F.struct("license_id", F.btrim("raw").alias("raw"), "is_spdx")

    def single(slot: str) -> Column:
        return F.max(F.when((F.col("slot") == slot) & usable, spdx_entry)).alias(slot)

    def versions(slot: str, source: str) -> Column:
        entry = F.struct(
            F.col("license_id").alias("identifier"), F.col("position"), F.btrim("raw").alias("raw"),
            F.lit(source).alias("source"), F.col("is_spdx"),
        )
        return F.array_sort(F.collect_list(F.when((F.col("slot") == slot) & usable, entry))).alias(slot)

    pom_entry = F.struct(
        "position",
        F.when(F.col("is_spdx"), F.col("license_id")).otherwise(F.coalesce(from_url, F.lit(""))).alias("identifier"),
        F.when(F.col("is_spdx"), F.btrim("raw"))
        .when(from_url.isNotNull(), F.btrim("url"))
        .otherwise(F.coalesce(F.expr("nullif(btrim(raw), '')"), F.btrim("url")))
        .alias("raw"),
        F.when(F.col("is_spdx") | from_url.isNotNull(), POM_SPDX).otherwise(POM_OTHER).alias("source"),
        (F.col("is_spdx") | from_url.isNotNull()).alias("is_spdx"),
    )
    grouped = known.groupBy("package_id").agg(
        single("project"),
        single("github_spdx"),
        single("github_name"),
        versions("version_spdx", VERSION_SPDX),
        versions("version_raw", VERSION_RAW),
        F.array_sort(F.collect_list(F.when(F.col("slot") == "manifest", pom_entry))).alias("pom"),
    )

    def first_of_each(name: str) -> Column:
        """One entry per identifier, the first; the list is sorted by identifier and position."""
        plain = F.transform(name, lambda v: F.struct(*[v[f].alias(f) for f in ("identifier", "raw", "source", "is_spdx")]))
        return F.filter(plain, lambda v, i: (i == 0) | (F.get(plain, i - 1)["identifier"] != v["identifier"]))

    def distinct_in_order(name: str) -> Column:
        key = lambda v: F.when(v["identifier"] != "", v["identifier"]).otherwise(F.concat(F.lit("raw:"), v["raw"]))
        keys = F.transform(name, key)
        kept = F.filter(name, lambda v, i: F.array_position(keys, key(v)) == i + 1)
        return F.transform(kept, lambda v: F.struct(*[v[f].alias(f) for f in ("identifier", "raw", "source", "is_spdx")]))

    empty = F.array().cast(f"array<{_LICENSE}>")
    base = facts.select("package_id", "requested_known", "github_spdx", "github_name").withColumnsRenamed(
        {"github_spdx": "github_spdx_raw", "github_name": "github_name_raw"}
    )
    project = F.when(
        F.col("project").isNotNull(),
        F.when(F.col("project.is_spdx"), _license(F.col("project.license_id"), F.col("project.raw"), PROJECT_SPDX, True))
        .otherwise(_license(F.lit(""), F.col("project.raw"), PROJECT_OTHER, False)),
    )
    own = F.when(F.size("version_spdx") > 0, first_of_each("version_spdx")).otherwise(first_of_each("version_raw"))
    step = base.join(grouped, "package_id", "left").withColumns(
        {"pl": project, "vl": F.when(F.col("requested_known"), F.coalesce(own, empty)).otherwise(empty)}
    )
    # a silent or unrecognised version takes the project's licence
    from_project = F.array(_license(F.col("pl.identifier"), F.col("pl.identifier"), FALLBACK, True))
    step = step.withColumn(
        "vl",
        F.when(
            F.col("requested_known") & _identified("pl") & ((F.size("vl") == 0) | _none_spdx("vl")), from_project
        ).otherwise(F.col("vl")),
    )
    # a silent or unrecognised project takes the only licence of the version
    only = F.get("vl", F.lit(0))
    promote = (
        F.col("requested_known") & ~_identified("pl") & (F.size("vl") == 1)
        & (F.col("pl").isNull() | _nonstandard("pl")) & only["is_spdx"]
    )
    step = step.withColumn(
        "pl", F.when(promote, _license(only["identifier"], only["identifier"], DERIVED, True)).otherwise(F.col("pl"))
    )
    # repository host
    open_project = F.col("pl").isNull() | _nonstandard("pl")

    def text_of(name: str) -> Column:
        value = F.btrim(F.coalesce(F.col(name), F.lit("")))
        return F.when((value != "") & (F.upper(value) != "NOASSERTION"), value)

    raw_host = F.coalesce(text_of("github_name_raw"), text_of("github_spdx_raw"))
    host = (
        F.when(F.col("github_spdx.is_spdx"),
               _license(F.col("github_spdx.license_id"), F.col("github_spdx_raw"), GITHUB_SPDX, True))
        .when(F.col("github_name.is_spdx"),
              _license(F.col("github_name.license_id"), F.col("github_name_raw"), GITHUB_SPDX, True))
        .when(raw_host.isNotNull() & ~(_nonstandard("pl") & F.coalesce(F.col("pl.raw") == raw_host, F.lit(False))),
              _license(F.lit(""), raw_host, GITHUB_OTHER, False))
    )
    step = step.withColumn("pl", F.when(open_project, F.coalesce(host, F.col("pl"))).otherwise(F.col("pl")))
    # manifest
    step = step.withColumn("pom", F.coalesce(distinct_in_order("pom"), empty))
    best = F.get(F.filter("pom", lambda v: v["is_spdx"]), F.lit(0))
    step = step.withColumn(
        "pom_project",
        F.when((F.col("pl").isNull() | _nonstandard("pl")) & best.isNotNull(), best)
        .when(F.col("pl").isNull() & (F.size("pom") > 0), F.get("pom", F.lit(0)))
        .otherwise(F.col("pl")),
    )
    takes_pom = (F.size("pom") > 0) & ((F.size("vl") == 0) | (_none_spdx("vl") & best.isNotNull()))
    return step.select(
        "package_id",
        F.col("pom_project").alias("project_license"),
        F.when(takes_pom, F.col("pom")).otherwise(F.col("vl")).alias("version_licenses"),
        best["identifier"].alias("manifest_spdx"),
        F.when(F.col("pl.is_spdx"), F.col("pl.identifier")).alias("settled_spdx"),
    )


def version_licenses(facts: DataFrame, spdx: DataFrame) -> DataFrame:
    """Distinct licences of a version, sorted: recognised details first, the raw list only without any."""
    long = normalize_licenses(spellings(facts).where("slot IN ('version_spdx', 'version_raw')"), spdx)
    usable = long.where("license_id IS NOT NULL AND upper(license_id) <> 'NOASSERTION'")
    ids = usable.groupBy("package_id", "license_id").agg(F.min(F.when(F.col("slot") == "version_spdx", 0).otherwise(1)).alias("rank"))
    best = usable.groupBy("package_id").agg(F.min(F.when(F.col("slot") == "version_spdx", 0).otherwise(1)).alias("best"))
    return ids.join(best, "package_id").where("rank = best").select("package_id", "license_id")


def license_disagreements(resolved: DataFrame) -> DataFrame:
    """Packages whose manifest names another licence than the settled one."""
    return resolved.where(
        "settled_spdx IS NOT NULL AND manifest_spdx IS NOT NULL AND lower(settled_spdx) <> lower(manifest_spdx)"
    ).select("package_id", "settled_spdx", "manifest_spdx")


def _is_composite(text: Column) -> Column:
    return F.coalesce(F.upper(text).rlike(r" AND | OR |[()]"), F.lit(False))


def license_report(analysis: DataFrame) -> DataFrame:
    """The licence export: 23 columns, lists joined by semicolons.

    ``analysis`` has purl, effective_purl, version_resolved, project_license, version_licenses, error,
    registry_url, repository_url.
    """
    p, versions = F.col("project_license"), F.col("version_licenses")
    count = F.size(versions)
    zero = p.isNull()
    spdx = F.coalesce(p["is_spdx"], F.lit(False))
    odd = ~zero & _nonstandard("project_license")
    all_non = _none_spdx("version_licenses")
    has_project = spdx & F.exists(versions, lambda v: v["identifier"] == p["identifier"])
    mismatch = spdx & (count > 0) & ~has_project
    fallback = (count == 1) & (F.get(versions, F.lit(0))["source"] == FALLBACK)
    source = F.coalesce(p["source"], F.lit(""))
    derived = source == DERIVED
    github = source.isin(GITHUB_SPDX, GITHUB_OTHER)
    flags = {
        "_zero": zero, "_spdx": spdx, "_odd": odd, "_count": count, "_all_non": all_non, "_has": has_project,
        "_mismatch": mismatch, "_fallback": F.coalesce(fallback, F.lit(False)), "_derived": derived, "_github": github,
    }

    def joined(field: str) -> Column:
        return F.array_join(F.transform(versions, lambda v: v[field]), ";")

    composite = F.exists(versions, lambda v: _is_composite(v["identifier"]) | _is_composite(v["raw"]))
    return analysis.withColumns(flags).select(
        F.col("purl").alias("original_purl"),
        "effective_purl",
        "version_resolved",
        F.coalesce(p["identifier"], F.lit("")).alias("project_license_identifier"),
        F.coalesce(p["raw"], F.lit("")).alias("project_license_raw"),
        source.alias("project_license_source"),
        F.col("_spdx").alias("project_license_is_spdx"),
        F.col("_zero").alias("project_license_is_zero"),
        joined("identifier").alias("version_license_identifiers"),
        joined("raw").alias("version_license_raws"),
        joined("source").alias("version_license_sources"),
        F.col("_count").alias("version_license_count"),
        F.col("_all_non").alias("version_licenses_all_non_spdx"),
        composite.alias("version_licenses_any_composite_expr"),
        F.col("_mismatch").alias("project_vs_version_mismatch"),
        ((F.col("_zero") | F.col("_odd")) & ((F.col("_count") == 0) | F.col("_all_non"))).alias(
            "licenses_all_missing_or_nonstandard"
        ),
        F.col("_fallback").alias("fallback_applied"),
        F.col("_derived").alias("derived_from_version"),
        F.col("_github").alias("github_override_applied"),
        license_scenario().alias("license_resolution_scenario"),
        "error",
        "registry_url",
        "repository_url",
    )


# Ordered scenario labels over the flag columns of license_report; the first condition that holds wins.
_SCENARIOS = (
    ("_fallback", "fallback_applied"),
    ("_derived", "derived_from_version"),
    ("_github AND _spdx", "github_override_spdx"),
    ("_github AND _odd", "github_override_nonstandard"),
    ("_zero AND _count = 0", "no_project_no_version"),
    ("_spdx AND _count = 0", "project_spdx_no_version"),
    ("_odd AND _count = 0", "project_nonstandard_no_version"),
    ("NOT _spdx AND NOT _odd AND NOT _zero AND _count = 0", "project_other_no_version"),
    ("NOT _spdx AND NOT _odd AND NOT _zero", "project_other_with_versions"),
    ("_zero", "versions_only"),
    ("_spdx AND NOT _mismatch AND NOT _all_non AND _has", "project_spdx_version_all_spdx_consistent"),
    ("_spdx AND _mismatch AND NOT _all_non", "project_spdx_version_all_spdx_mismatch"),
    ("_spdx AND NOT _mismatch AND _all_non", "project_spdx_versions_all_nonspdx"),
    ("_spdx AND _mismatch AND _all_non", "project_spdx_versions_all_nonspdx_mismatch"),
    ("_odd AND NOT _all_non", "project_nonstandard_versions_mixed"),
    ("_odd AND _all_non", "project_nonstandard_versions_all_nonspdx"),
)


def license_scenario() -> Column:
    branches = " ".join(f"WHEN {condition} THEN '{label}'" for condition, label in _SCENARIOS)
    return F.expr(f"CASE {branches} ELSE 'catch_all' END")


# --- manifests ------------------------------------------------------------------------------

def _property_maps(properties: DataFrame, packages: DataFrame | None) -> DataFrame:
    """(package_id, _properties, _cyclic): one value per key, and the keys whose values lead back to themselves.

    Of a repeated key the row with the largest ``position`` counts (without that column the largest value). ``packages``
    (package_id, namespace, name, version) adds the names that every manifest knows, below all others.
    """
    place = F.col("position") if "position" in properties.columns else F.lit(0)
    rows = properties.select("package_id", "key", "value", place.cast("long").alias("place"))
    if packages is not None:
        fields = {"groupId": "namespace", "artifactId": "name", "version": "version"}
        known = [F.struct(F.lit(f"{p}.{k}").alias("key"), F.col(c).cast("string").alias("value")) for p in ("project", "pom") for k, c in fields.items()]
        own = packages.select("package_id", F.explode(F.array(*known)).alias("k")).select("package_id", "k.key", "k.value")
        rows = rows.unionByName(own.where("value IS NOT NULL").withColumn("place", F.lit(-1).cast("long")))
    single = rows.groupBy("package_id", "key").agg(F.max(F.struct("place", "value"))["value"].alias("value"))
    maps = single.groupBy("package_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_properties"))
    refs = F.transform_values("_properties", lambda _, v: F.array_distinct(F.regexp_extract_all(v, F.lit(r"\$\{([^}]+)\}"), F.lit(1))))

    def reached(key: Column) -> Column:
        """Keys that a key's value needs, however far."""
        further = lambda names: F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at("_refs", n), F.array().cast("array<string>"))))
        return F.aggregate(F.map_keys("_refs"), F.element_at("_refs", key), lambda names, _: F.array_union(names, further(names)))

    linked = maps.withColumn("_refs", refs)
    chained = F.exists(F.map_values("_refs"), lambda names: F.size(names) > 0)
    cyclic = F.when(chained, F.filter(F.map_keys("_refs"), lambda k: F.array_contains(reached(k), k)))
    return linked.withColumn("_cyclic", F.coalesce(cyclic, F.array().cast("array<string>"))).drop("_refs")


def expand_properties(
    entries: DataFrame, properties: DataFrame, columns: tuple[str, ...] = ("name", "url"), packages: DataFrame | None = None
) -> DataFrame:
    """Replace ${key} by the package's property until nothing changes; unknown keys and keys that need themselves stay.

    ``properties`` has package_id, key, value. A package's properties form one small map, built once and
    joined by package; every round replaces all keys that occur in the text, and a chain has at most as many links as
    there are keys.
    """
    result = entries.join(_property_maps(properties, packages), "package_id", "left").withColumn(
        "_properties", F.coalesce("_properties", F.create_map().cast("map<string,string>"))
    )

    def expand(text: Column) -> Column:
        keys = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$\{([^}]+)\}"), F.lit(1)))

        def one(acc: Column, key: Column) -> Column:
            mark = F.concat(F.lit("${"), key, F.lit("}"))
            value = F.when(~F.array_contains("_cyclic", key), F.try_element_at("_properties", key))
            return F.replace(acc, mark, F.coalesce(value, mark))

        return F.aggregate(keys, text, one)

    rounds = F.map_keys("_properties")  # one round for each key at most
    expanded = {
        c: F.when(F.contains(c, F.lit("${")), F.aggregate(rounds, F.col(c), lambda acc, _: expand(acc))).otherwise(F.col(c))
        for c in columns
    }
    return result.withColumns(expanded).drop("_properties", "_cyclic")


def manifest_licenses(entries: DataFrame, properties: DataFrame, spdx: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Licence entries of manifests in document order, each licence once.

    ``entries`` has package_id, position, name, url. The name decides if it is recognised, else the
    address, else the text stays as it is.
    """
    expanded = expand_properties(entries, properties, packages=packages)
    known = normalize_licenses(expanded, spdx, raw="name")
    url_id = license_of_url(F.col("url"))
    name = F.expr("nullif(btrim(name), '')")
    address = F.expr("nullif(btrim(url), '')")
    identifier = F.when(F.col("is_spdx"), F.col("license_id")).otherwise(url_id)
    raw = F.when(F.col("is_spdx"), name).when(url_id.isNotNull(), address).otherwise(F.coalesce(name, address))
    resolved = known.where(name.isNotNull() | address.isNotNull()).select(
        "package_id",
        "position",
        F.coalesce(identifier, F.lit("")).alias("identifier"),
        raw.alias("raw"),
        F.when(identifier.isNotNull(), POM_SPDX).otherwise(POM_OTHER).alias("source"),
    )
    key = F.when(F.col("identifier") != "", F.col("identifier")).otherwise(F.concat(F.lit("raw:"), F.col("raw")))
    first = resolved.withColumn("_key", key).groupBy("package_id", "_key").agg(
        F.min(F.struct("position", "identifier", "raw", "source")).alias("first")
    )
    return first.select("package_id", "first.*")


# --- documents and expressions -----------------------------------------------------------------

MENTION = r"(?i)(?:licensed|released) under (?:the )?([^\n.]*(?:\.\d[^\n.]*)*)"
SPDX_TAG = r"SPDX-License-Identifier:\s*([^\s*/]+)"


def license_mentions(docs: DataFrame, spdx: DataFrame, key: str = "doc_id") -> DataFrame:
    """Licences named in documents, each mention with its identifier and match type."""
    mentions = F.concat(
        F.regexp_extract_all("text", F.lit(MENTION), F.lit(1)), F.regexp_extract_all("text", F.lit(SPDX_TAG), F.lit(1))
    )
    found = docs.where(F.col("text").rlike(MENTION) | F.col("text").rlike(SPDX_TAG)).select(
        key, F.explode(mentions).alias("raw")
    )
    cleaned = found.withColumn("raw", F.regexp_replace(F.btrim("raw"), r"[\s.,;]+$", "")).where("raw <> ''")
    return normalize_licenses(cleaned, spdx).select(key, "raw", "license_id", "match_type")


_OR_AND = r"(?i)(?<![^\s()])(or|and)(?![^\s()])"
_WITH = r"(?i)(?<![^\s()])with(?![^\s()])"


def license_leaves(expressions: DataFrame, spdx: DataFrame, key: str = "package_id") -> DataFrame:
    """Licences named in expressions such as "MIT OR (GPL-2.0+ WITH X)": one row per leaf.

    ``expressions`` has the key and expression. Words between operators form one name; WITH binds to the
    name before it, or to every name of the bracketed group before it that has none of its own.
    """
    marked = F.regexp_replace(F.regexp_replace("expression", _WITH, "\x02"), _OR_AND, "\x01")
    tokens = F.regexp_extract_all(marked, F.lit("[\x01()]|[^\x01()]+"), F.lit(0))
    trimmed = F.filter(F.transform(tokens, lambda t: F.btrim(t, F.lit(" \t\r\n"))), lambda t: t != "")
    rows = expressions.select(key, "expression", trimmed.alias("tokens"))
    bracket = lambda t: F.when(t == "(", 1).when(t == ")", -1).otherwise(0)
    depths = F.transform(
        "tokens", lambda t, i: F.aggregate(F.slice("tokens", F.lit(1), i + 1), F.lit(0), lambda a, x: a + bracket(x))
    )
    rows = rows.withColumn("depths", depths)
    is_name = lambda t: ~t.isin("(", ")", "\x01") & ~t.startswith("\x02")
    last = F.size("tokens") - 1

    def group_exception(i: Column) -> Column:
        """Exception right after the closing bracket of a group that holds position i."""
        spots = F.filter(
            F.sequence(F.lit(0), last),
            lambda j: (j > i)
            & F.get("tokens", j).startswith("\x02")
            & (F.get("tokens", j - 1) == ")")
            & F.forall(
                F.slice("depths", i + 1, F.greatest(j - i - 1, F.lit(1))), lambda d: d > F.get("depths", j)
            ),
        )
        return F.get("tokens", F.get(spots, F.lit(0)))

    def words(text: Column, part: int) -> Column:
        piece = F.get(F.split(text, "\x02"), F.lit(part))
        return F.nullif(F.btrim(F.regexp_replace(piece, r"\s+", " ")), F.lit(""))

    leaves = F.filter(
        F.transform(
            "tokens",
            lambda t, i: F.when(
                is_name(t),
                F.struct(
                    i.alias("position"),
                    words(t, 0).alias("raw"),
                    F.coalesce(words(t, 1), words(group_exception(i), 1)).alias("exception"),
                ),
            ),
        ),
        lambda leaf: leaf.isNotNull(),
    )
    ands = F.exists(F.regexp_extract_all("expression", F.lit(_OR_AND), F.lit(1)), lambda o: F.lower(o) == "and")
    ors = F.exists(F.regexp_extract_all("expression", F.lit(_OR_AND), F.lit(1)), lambda o: F.lower(o) == "or")
    mix = F.when(ands & ors, "mixed").when(ands, "and").when(ors, "or").otherwise("single")
    exploded = rows.select(key, "expression", mix.alias("operators"), F.explode(leaves).alias("leaf")).select(
        key, "expression", "operators", "leaf.*"
    )
    later = F.col("raw").rlike(r"[^+]\+$")
    based = exploded.withColumns(
        {"or_later": later, "base": F.when(later, F.regexp_replace("raw", r"\+$", "")).otherwise(F.col("raw"))}
    )
    known = normalize_licenses(based, spdx, raw="base")
    return known.select(
        key, "position", "raw", F.when(F.col("is_spdx"), F.col("license_id")).alias("license_id"), "or_later",
        "exception", "operators", "match_type",
    )
