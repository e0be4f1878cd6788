"""Package and repository keys: resolution, repair, grouping, inference and round-trip checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.config import GRAPH_ECOSYSTEMS, SUPPORTED_ECOSYSTEMS
from depvital.functions.purl import (
    canonical_key,
    purl_struct,
    purl_type,
    registry_name,
    registry_urls,
    repair_maven,
    versionless,
)
from depvital.functions.repo_urls import canonical_url, github_owner_repo, is_github_input, repo_key


def resolve_package_keys(inputs: DataFrame, column: str = "purl") -> DataFrame:
    """Parts, canonical key and versionless form of every package URL; unreadable ones have a NULL key."""
    parsed = inputs.withColumn("_parts", purl_struct(F.col(column)))
    return (
        parsed.withColumns({f"purl_{name}": F.col(f"_parts.{name}") for name in ("type", "namespace", "name", "version")})
        .withColumns(
            {
                "canonical_key": canonical_key(F.col("purl_type"), F.col("purl_namespace"), F.col("purl_name")),
                "versionless": versionless(F.btrim(F.col(column))),
            }
        )
        .drop("_parts")
    )


def key_variants(resolved: DataFrame, column: str = "purl") -> DataFrame:
    """Per canonical key: inputs, distinct spellings and distinct versions.

    Spellings are made distinct first, so the second grouping is small and no list is collected.
    """
    per_spelling = resolved.where("canonical_key IS NOT NULL").groupBy(
        "canonical_key", column, "purl_version"
    ).agg(F.count(F.lit(1)).alias("inputs"))
    per_text = per_spelling.groupBy("canonical_key", column).agg(F.sum("inputs").alias("inputs"))
    versions = per_spelling.where("purl_version IS NOT NULL").select("canonical_key", "purl_version").distinct()
    version_counts = versions.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("versions"))
    spellings = per_text.groupBy("canonical_key").agg(
        F.sum("inputs").alias("inputs"), F.count(F.lit(1)).alias("spellings"), F.min(column).alias("first_spelling")
    )
    return spellings.join(version_counts, "canonical_key", "left").withColumn(
        "versions", F.coalesce("versions", F.lit(0).cast("long"))
    )


def repair_maven_inputs(inputs: DataFrame, column: str = "purl") -> DataFrame:
    """Add the repaired package URL and whether it changed."""
    fixed = repair_maven(F.col(column))
    return inputs.withColumns({"repaired": fixed, "was_fixed": fixed != F.col(column)})


def repair_stats(repaired: DataFrame, column: str = "purl") -> DataFrame:
    maven = F.col(column).startswith("pkg:maven/")
    return repaired.agg(
        F.count_if(maven).alias("maven_inputs"),
        F.count_if(F.col("was_fixed")).alias("fixed"),
        F.count_if(maven & ~F.col("was_fixed")).alias("already_canonical"),
    )


def split_supported(inputs: DataFrame, column: str = "purl") -> tuple[DataFrame, DataFrame]:
    """Inputs of supported ecosystems, and the others."""
    kind = purl_type(F.col(column))
    supported = F.coalesce(kind.isin(*SUPPORTED_ECOSYSTEMS), F.lit(False))
    return inputs.where(supported), inputs.where(~supported)


def filter_ecosystem(inputs: DataFrame, ecosystem: str, column: str = "purl") -> DataFrame:
    """Inputs of one ecosystem, in any case; unreadable ones are dropped."""
    return inputs.where(purl_type(F.col(column)) == ecosystem.strip().lower())


def graph_eligible(packages: DataFrame) -> DataFrame:
    """Packages that a dependency graph exists for: four ecosystems, with a version."""
    return packages.where(F.lower("ecosystem").isin(*GRAPH_ECOSYSTEMS) & (F.coalesce("version", F.lit("")) != ""))


def dedup_inputs(inputs: DataFrame, key: str, order: str) -> DataFrame:
    """First occurrence of every key, all columns kept; a grouped minimum, not a sorted window."""
    others = [c for c in inputs.columns if c not in (key, order)]
    first = inputs.groupBy(key).agg(F.min(F.struct(order, *others)).alias("first"))
    return first.select(key, "first.*")


def sample_inputs(
    inputs: DataFrame, n: int, seed: int, place: Sequence[str] = ("file_id", "line_no"), kind: str = "kind",
    kinds: Sequence[str] = ("package", "repository"),
) -> DataFrame:
    """n pseudo-random rows of each of the kinds, all rows where there are fewer.

    The order is a hash of the seed and the row's place, so it does not depend on how rows are partitioned; each kind
    takes its own top-n.
    """
    number = F.md5(F.concat_ws("/", F.lit(seed), *place).cast("binary"))
    tagged = inputs.withColumn("_number", number)
    parts = [tagged.where(F.col(kind) == k).orderBy("_number", *place).limit(n) for k in kinds]
    return reduce(DataFrame.unionByName, parts).drop("_number")


def input_kind(line: Column) -> Column:
    text = F.btrim(line)
    return F.when(text.startswith("pkg:"), "package").when(is_github_input(text), "repository").otherwise("unrecognised")


# --- repositories --------------------------------------------------------------------


def canonical_repos(packages: DataFrame, column: str = "repo_url") -> DataFrame:
    """Add the normalised address and the repository key."""
    raw = F.col(column)
    return packages.withColumns(
        {
            "normalized_url": canonical_url(raw),
            "repo_key": repo_key(raw),
        }
    )


def group_by_repo(packages: DataFrame, column: str = "repo_url") -> DataFrame:
    """Packages and address spellings per repository key."""
    keyed = canonical_repos(packages, column).where("repo_key IS NOT NULL")
    per_spelling = keyed.groupBy("repo_key", column).agg(
        F.count(F.lit(1)).alias("packages"), F.min("package_id").alias("first_package")
    )
    return per_spelling.groupBy("repo_key").agg(
        F.sum("packages").alias("packages"),
        F.count(F.lit(1)).alias("spellings"),
        F.min("first_package").alias("first_package"),
    )


# --- fixed values: order of a PyPI project's addresses ---------------------------------
PYPI_URL_KEYS = ("repository", "source", "source code", "github", "code", "homepage", "home", "project")


def candidate_priority(kind: Column, label: Column) -> Column:
    """Where a repository address comes from, best first: declared source, other link, related project,
    registry entry (PyPI labels in their own order)."""
    pypi = F.lit(100 + len(PYPI_URL_KEYS))
    for i, key in reversed(list(enumerate(PYPI_URL_KEYS))):
        pypi = F.when(F.lower(label) == key, 100 + i).otherwise(pypi)
    return (
        F.when((kind == "link") & (label == "SOURCE_REPO"), 0)
        .when(kind == "link", 1)
        .when(kind == "related", 2)
        .when(kind == "pypi", pypi)
        .when(kind == "registry", 50)
        .otherwise(1000)
    )


def choose_repo(candidates: DataFrame) -> DataFrame:
    """Best repository address per package.

    ``candidates`` has package_id, kind (link, related, registry, pypi), label, position, url. A declared
    source may be on any host, other candidates must be on GitHub.
    """
    url = canonical_url(F.btrim("url"))
    usable = candidates.withColumns({"_url": url, "_priority": candidate_priority(F.col("kind"), F.col("label"))}).where(
        (F.col("_url") != "") & ((F.col("_priority") == 0) | F.lower("_url").contains("github.com/"))
    )
    return usable.groupBy("package_id").agg(
        F.min_by(F.struct(F.col("_url").alias("url"), "kind"), F.struct("_priority", "position", "_url")).alias("best")
    ).select("package_id", F.col("best.url").alias("repo_url"), F.col("best.kind").alias("repo_source"))


def enrich_package(packages: DataFrame) -> DataFrame:
    """Registry name and registry pages of a package."""
    named = packages.withColumn("registry_name", registry_name(F.col("ecosystem"), F.col("namespace"), F.col("name")))
    return named.withColumns(registry_urls(F.col("ecosystem"), F.col("registry_name"), F.col("version")))


# --- fixed values: dependency-manifest managers and languages by ecosystem -----------------
MANAGER_ECOSYSTEMS = {
    "NPM": "npm",
    "PIP": "pypi",
    "PYPI": "pypi",
    "MAVEN": "maven",
    "NUGET": "nuget",
    "CARGO": "cargo",
    "RUST": "cargo",
    "GO": "golang",
    "GOLANG": "golang",
    "RUBYGEMS": "gem",
    "GEM": "gem",
    "GITHUB": "github",
}
LANGUAGE_ECOSYSTEMS = {
    "javascript": "npm",
    "typescript": "npm",
    "python": "pypi",
    "java": "maven",
    "kotlin": "maven",
    "go": "golang",
    "rust": "cargo",
    "ruby": "gem",
    "c#": "nuget",
    "f#": "nuget",
    "visual basic .net": "nuget",
    "php": "composer",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def infer_package(repos: DataFrame, manifests: DataFrame, languages: DataFrame) -> DataFrame:
    """Package URL guessed for a repository: from its dependency manifests, else from its main language.

    ``repos`` has repo_key, owner, repo; ``manifests`` repo_key, manager; ``languages`` repo_key, language,
    bytes. Of several ecosystems the alphabetically first is taken; an unknown language means npm.
    """
    eco = F.coalesce(_lookup(MANAGER_ECOSYSTEMS, F.upper("manager")),
                     F.when(F.lower("manager").isin(*SUPPORTED_ECOSYSTEMS), F.lower("manager")))
    declared = manifests.select("repo_key", eco.alias("eco")).groupBy("repo_key").agg(F.min("eco").alias("declared"))
    main = languages.where("bytes > 0").groupBy("repo_key").agg(
        F.min_by("language", F.struct(-F.col("bytes"), F.col("language"))).alias("language")
    )
    ecosystem = F.coalesce("declared", _lookup(LANGUAGE_ECOSYSTEMS, F.lower("language")), F.lit("npm"))
    owner, repo = F.col("owner"), F.col("repo")
    name = (
        F.when(F.col("ecosystem") == "golang", F.concat_ws("/", F.lit("github.com"), owner, repo))
        .when(F.col("ecosystem").isin("maven", "composer", "github"), F.concat_ws("/", owner, repo))
        .when(F.col("ecosystem").isin("pypi", "cargo", "gem"), F.lower(repo))
        .otherwise(repo)
    )
    purl = F.concat(F.lit("pkg:"), F.col("ecosystem"), F.lit("/"), name)
    return (
        repos.join(declared, "repo_key", "left")
        .join(main, "repo_key", "left")
        .withColumn("ecosystem", ecosystem)
        .select(
            "repo_key",
            "ecosystem",
            F.col("declared").isNotNull().alias("from_manifest"),
            F.when(F.col("declared").isNotNull(), F.lower(purl)).otherwise(purl).alias("purl"),
        )
    )


def validate_roundtrip(analysis: DataFrame) -> DataFrame:
    """Whether the repository found for a package is the one that was asked for.

    ``analysis`` has input_url and resolved_url. No resolved address, or an unreadable input, passes; an
    address outside GitHub does not. Rows that fail are to be reported by repository facts alone.
    """
    asked, found = F.col("_asked"), F.col("_found")
    same = (F.lower(asked["owner"]) == F.lower(found["owner"])) & (F.lower(asked["repo"]) == F.lower(found["repo"]))
    empty = F.coalesce("resolved_url", F.lit("")) == ""
    return (
        analysis.withColumns(
            {"_asked": github_owner_repo(F.col("input_url")), "_found": github_owner_repo(F.col("resolved_url"))}
        )
        .withColumn("repo_matches", F.when(empty | asked.isNull(), True).when(found.isNull(), False).otherwise(same))
        .withColumn("repository_only", ~F.col("repo_matches"))
        .drop("_asked", "_found")
    )


# --- vanity import paths ------------------------------------------------------------------------


def page_metadata(pages: DataFrame) -> DataFrame:
    """go-import and go-source entries of HTML pages: page_id, kind, position, prefix, repo_url.

    Only git entries that lead to GitHub count. A source entry without a home takes the repository from
    its directory template.
    """
    tags = F.regexp_extract_all("html", F.lit(r"<meta\b([^>]*)>"), F.lit(1))
    named = pages.select("page_id", F.posexplode(tags).alias("position", "tag"))
    kind = F.lower(F.regexp_extract("tag", r'(?i)(?:^|\s)name\s*=\s*"([^"]*)"', 1))
    content = F.regexp_extract("tag", r'(?i)(?:^|\s)content\s*=\s*"([^"]*)"', 1)
    entries = (
        named.select("page_id", "position", kind.alias("kind"), F.split(F.btrim(F.regexp_replace(content, r"\s+", " ")), " ").alias("f"))
        .where(F.col("kind").isin("go-import", "go-source") & (F.size("f") >= 3))
    )

    def github(url: Column) -> Column:
        found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?i:github\.com)(?::\d+)?/+([^/?#]+/[^/?#]+)", 1)
        return F.when(found != "", F.concat(F.lit("https://github.com/"), F.regexp_replace(found, r"\.git$", "")))

    template = F.regexp_replace(F.col("f")[2], r"/(?:tree|blob)/.*$", "")
    target = F.when(
        F.col("kind") == "go-import", F.when(F.lower(F.col("f")[1]) == "git", github(F.col("f")[2]))
    ).otherwise(F.coalesce(github(F.col("f")[1]), github(template)))
    return entries.select("page_id", "kind", "position", F.col("f")[0].alias("prefix"), target.alias("repo_url")).where(
        "repo_url IS NOT NULL"
    )


def resolve_vanity(packages: DataFrame, pages: DataFrame) -> DataFrame:
    """Repository of import paths whose host only redirects, read from the page served there.

    ``packages`` has package_id, import_path, page_id; ``pages`` page_id, html. Import entries go before
    source entries; the longest prefix of the import path wins, else the first entry.
    """
    entries = page_metadata(pages)
    path, prefix = F.lower("import_path"), F.lower("prefix")
    matches = (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))
    order = F.struct(
        (F.col("kind") != "go-import").cast("int"),
        (~matches).cast("int"),
        F.when(matches, -F.length("prefix")).otherwise(0),
        "position",
    )
    return (
        packages.select("package_id", "import_path", "page_id")
        .join(entries, "page_id")
        .groupBy("package_id", "import_path")
        .agg(F.min_by(F.struct("repo_url", "kind", "prefix"), order).alias("best"))
        .select("package_id", "import_path", "best.repo_url", F.col("best.kind").alias("entry"))
    )
