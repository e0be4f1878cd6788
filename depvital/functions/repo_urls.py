"""Repository addresses: one spelling per repository."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from depvital.functions.binding import let


def normalize_repo_url(raw: Column) -> Column:
    """https address without user, query, fragment, trailing slashes and .git."""
    url = F.when(
        raw.startswith("github:"),
        F.concat(
            F.lit("https://github.com/"),
            F.regexp_replace(F.regexp_replace(raw, r"^github:/*", ""), r"^(?i)github\.com/", ""),
        ),
    ).otherwise(raw)
    url = F.regexp_replace(url, r"^git\+https://", "https://")
    url = F.regexp_replace(url, r"^(?:git\+)?ssh://(?:git@)?([^/:]*):", "https://$1/")
    url = F.regexp_replace(url, r"^(?:git\+)?ssh://(?:git@)?", "https://")
    url = F.regexp_replace(url, r"^git@([^/:]*):", "https://$1/")
    url = F.regexp_replace(url, r"^git://", "https://")
    url = F.regexp_replace(url, r"[#?].*$", "")
    return F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"\.git$", "")


def apache_mirror(raw: Column) -> Column:
    """GitHub mirror of repositories hosted at Apache; NULL for others."""
    text = F.btrim(raw)
    hosted = F.lower(text).rlike(r"gitbox\.apache\.org|git-wip-us\.apache\.org")
    query = F.regexp_extract(text, r"[?&;]p=([^&;\s]+)", 1)
    path = F.regexp_replace(F.regexp_replace(text, r"[?#].*$", ""), r"/+$", "")
    last = F.regexp_extract(path, r"/([^/]+)$", 1)
    name = F.regexp_replace(F.when(query != "", query).otherwise(last), r"\.git$", "")
    return F.when(
        hosted & (name != "") & ~name.isin("repos", "asf") & ~name.contains("apache.org"),
        F.concat(F.lit("https://github.com/apache/"), F.btrim(name, F.lit("/"))),
    )


def github_owner_repo(raw: Column) -> Column:
    """Struct (owner, repo) of a GitHub repository reference in any of its spellings; NULL for others."""

    def split(url: Column) -> Column:
        full = r"^https?://(?:[^/@]*@)?([^/]*)/*([^/]+)/+([^/]+)"
        is_full = url.rlike(r"^https?://")
        short = F.regexp_replace(F.regexp_replace(url, r"^github\.com/", ""), r"^/+", "")
        bare = r"^([^/]+)/+([^/]+)"
        on_github = ~is_full | F.lower(F.regexp_extract(url, full, 1)).contains("github.com")
        parts = F.struct(
            F.when(is_full, F.regexp_extract(url, full, 2)).otherwise(F.regexp_extract(short, bare, 1)).alias("owner"),
            F.regexp_replace(
                F.when(is_full, F.regexp_extract(url, full, 3)).otherwise(F.regexp_extract(short, bare, 2)), r"\.git$", ""
            ).alias("repo"),
        )
        named = lambda p: p["owner"].rlike("^[^@:]+$") & p["repo"].rlike("^[^@:]+$")
        return F.when(
            on_github & ~F.lower(url).startswith("pkg:"), let(parts, lambda p: F.when(named(p), p))
        )

    return let(normalize_repo_url(F.btrim(raw)), split)


def is_github_input(line: Column) -> Column:
    """Whether an input line is a GitHub repository: address, github.com/owner/repo, or owner/repo."""
    text = F.btrim(line)
    address = text.rlike(r"^https?://[^/]*(?i:github\.com)[^/]*/+[^/?#]+/[^/?#]+")
    short = text.rlike(r"^github\.com/[^/]+/[^/]+")
    pair = text.rlike(r"^[^/@:]+/[^/@:]+$")
    return F.when(text.rlike("^https?://"), address).otherwise(short | pair)


def repo_key(raw: Column) -> Column:
    """Lower-case github.com/owner/repo, or the normalised address of another host."""

    def key(url: Column) -> Column:
        lowered = F.regexp_replace(F.lower(F.btrim(url)), r"[#?].*$", "")
        found = F.regexp_replace(F.regexp_extract(lowered, r"github\.com[:/]+([^/]+/[^/]+)", 1), r"\.git$", "")
        return let(
            found, lambda f: F.when(f != "", F.concat(F.lit("github.com/"), f)).otherwise(F.nullif(url, F.lit("")))
        )

    return let(canonical_url(raw), key)


def canonical_url(raw: Column) -> Column:
    """Normalised address, with Apache-hosted repositories at their GitHub mirror."""
    return F.coalesce(apache_mirror(raw), normalize_repo_url(raw))
