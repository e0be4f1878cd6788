"""Go module files and CI workflow files as dependency tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.functions.binding import let
from depvital.operators.prefixes import longest_prefix_join

# --- Go modules -----------------------------------------------------------------------


def _directive_lines(word: str) -> Column:
    """Lines of a directive in file order, from its blocks and from single-line uses."""
    uses = F.regexp_extract_all("text", F.lit(rf"(?m)^{word}\s*\([^)]*\)|^{word}[ \t]+[^(\s][^\n]*$"), F.lit(0))
    return F.flatten(F.transform(uses, lambda u: F.split(F.regexp_replace(u, rf"^{word}\s*\(?|\)$", ""), "\n")))


def _lines(files: DataFrame, word: str) -> DataFrame:
    return files.select("project_id", F.posexplode(_directive_lines(word)).alias("position", "_line")).select(
        "project_id", "position", F.btrim("_line", F.lit(" \t\r")).alias("line")
    )


def _word(text: Column, n: int) -> Column:
    return F.btrim(F.split_part(F.regexp_replace(text, r"\s+", " "), F.lit(" "), F.lit(n)), F.lit('"`'))


def read_go_manifests(files: DataFrame) -> DataFrame:
    """Direct requirements of module files: project_id, name, version, purl, scope.

    ``files`` has project_id, text. Lines marked indirect are left out; a module's last replacement is applied
    unless it is a local path; modules that a tool directive points into have scope "tool".
    """
    code = lambda line: F.btrim(F.regexp_replace(line, r"//.*$", ""))
    requires = (
        _lines(files, "require")
        .select("project_id", code(F.col("line")).alias("line"), F.col("line").rlike(r"//\s*indirect\b").alias("indirect"))
        .where("line <> ''")
        .select(
            "project_id", _word(F.col("line"), 1).alias("name"), _word(F.col("line"), 2).alias("version"), "indirect"
        )
        .where("version <> ''")
    )
    sides = (
        _lines(files, "replace")
        .select("project_id", "position", F.split(code(F.col("line")), r"\s*=>\s*").alias("s"))
        .where(F.size("s") == 2)
    )
    replaces = (
        sides.select(
            "project_id",
            "position",
            _word(F.col("s")[0], 1).alias("name"),
            _word(F.col("s")[1], 1).alias("new_name"),
            _word(F.col("s")[1], 2).alias("new_version"),
        )
        .groupBy("project_id", "name")
        .agg(F.max_by(F.struct("new_name", "new_version"), "position").alias("new"))
        .where("new.new_version <> '' AND NOT new.new_name LIKE '.%' AND NOT new.new_name LIKE '/%'")
    )
    tools = (
        _lines(files, "tool").select("project_id", _word(code(F.col("line")), 1).alias("path")).where("path <> ''").distinct()
    )
    tool_modules = longest_prefix_join(
        tools, requires.select("project_id", F.col("name").alias("prefix"), "name"), "path", "/", ignore_case=False
    ).select("project_id", "name", F.lit("tool").alias("scope")).distinct()
    name = F.coalesce("new.new_name", "name")
    version = F.coalesce("new.new_version", "version")
    return (
        requires.where("NOT indirect")
        .join(replaces, ["project_id", "name"], "left")
        .join(tool_modules, ["project_id", "name"], "left")
        .select(
            "project_id",
            F.col("name").alias("module"),
            name.alias("name"),
            version.alias("version"),
            F.concat(F.lit("pkg:golang/"), name, F.lit("@"), version).alias("purl"),
            "scope",
        )
    )


def tool_modules(dependencies: DataFrame) -> DataFrame:
    """(project_id, name) of modules used as tools, for the removal plan."""
    return dependencies.where("scope = 'tool'").select("project_id", "name").distinct()


# --- CI workflows -----------------------------------------------------------------------

# text under a key with | or > is no YAML, and inputs of a step are not its keys; both lie deeper than their key
_BLOCK = r"[^\n]*?:[ \t]*[|>][-+0-9]*[ \t]*(?:#[^\n]*)?"
_INPUT_KEYS = ("with", "env", "inputs", "outputs", "secrets", "matrix")
_INPUTS = rf"[\"']?(?:{'|'.join(_INPUT_KEYS)})[\"']?[ \t]*:[ \t]*(?:#[^\n]*)?"
_NESTED = (
    rf"(?m)^([ \t]*)-([ \t]+)(?:{_BLOCK}|{_INPUTS})$(?:\n(?:\1[ \t]\2[ \t]+[^\n]*|[ \t]*$))*+"
    rf"|^([ \t]*)(?!-)(?:{_BLOCK}|{_INPUTS})$(?:\n(?:\3[ \t]+[^\n]*|[ \t]*$))*+"
)
_VALUE = r"(\"[^\"\n]*\"|'[^'\n]*'|[^\s#,}\]'\"][^\s#,}\]]*)"
_USES = rf"(?m)(?:^[ \t]*(?:-[ \t]+)*|[{{,][ \t]*)[\"']?uses[\"']?[ \t]*:[ \t]*{_VALUE}"


def clean_local_path(uses: Column) -> Column:
    """Path of a local action below the repository root; NULL when it leaves the root or is no local path.

    Single dots and doubled slashes are removed and "name/.." pairs are folded.
    """
    path = F.regexp_replace(uses, r"^\./", "")
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(F.lit(""))), F.greatest(F.size(acc), F.lit(1))) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    inside = uses.startswith("./") & ~uses.contains("\\") & ~path.startswith("/")
    cleaned = F.array_join(folded, "/")
    return F.when(inside & (cleaned != "") & ~cleaned.startswith(".."), cleaned)


def _own_keys(text: Column) -> Column:
    """The text without what lies deeper than its key; looked for only where the text holds a sign or word that every match holds."""
    may_nest = reduce(Column.__or__, [text.contains(word) for word in ("|", ">", *_INPUT_KEYS)])
    return F.when(may_nest, F.regexp_replace(text, _NESTED, "")).otherwise(text)


def _reference(value: Column) -> Column:
    """A reference as (kind, action, local_path, uses), worked out once; NULL for container images and paths outside."""
    nothing = F.lit(None).cast("string")

    def entry(kind: str, action: Column, local: Column, uses: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), action.alias("action"), local.alias("local_path"), uses.alias("uses"))

    def read(uses: Column) -> Column:
        def by_target(target: Column) -> Column:
            named = (F.split_part(target, F.lit("/"), F.lit(1)) != "") & (F.split_part(target, F.lit("/"), F.lit(2)) != "")
            return F.when(named, entry("remote", F.regexp_replace(target, "/+$", ""), nothing, uses))

        def by_path(path: Column) -> Column:
            return F.when(path.isNotNull(), entry("local", nothing, path, uses))

        elsewhere = uses.startswith("../") | uses.startswith("docker://")
        return F.when(uses.startswith("./"), let(clean_local_path(uses), by_path)).when(
            ~elsewhere, let(F.substring_index(uses, "@", 1), by_target)
        )

    return let(F.btrim(F.btrim(value, F.lit("\"'"))), read)


def read_workflow_refs(files: DataFrame) -> DataFrame:
    """Action references of workflow and composite-action files, each once per file with its smallest ref.

    ``files`` has scope (repository), path, text. Columns: scope, path, kind (remote or local), action
    (owner/repo[/path]), ref, local_path. Container images are left out, and so are action files that are
    not composite. References are dealt by repository, so a table bucketed by it is written as they lie.
    """
    is_action = F.col("path").rlike(r"(?:^|/)action\.ya?ml$")
    composite = F.col("text").rlike(r"(?im)^[ \t]*using:[ \t]*['\"]?composite['\"]?[ \t]*$")
    uses = F.regexp_extract_all(_own_keys(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))), F.lit(_USES), F.lit(1))
    found = files.where(~is_action | composite).select(
        "scope", "path", F.explode(F.filter(F.transform(uses, _reference), lambda r: r.isNotNull())).alias("_r")
    )
    return (
        found.select(
            "scope",
            "path",
            "_r.kind",
            "_r.action",
            F.when(F.col("_r.kind") == "remote", F.nullif(F.regexp_extract("_r.uses", r"^[^@]+@(.*)$", 1), F.lit(""))).alias("ref"),
            "_r.local_path",
        )
        .repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope")
        .groupBy("scope", "path", "kind", "action", "local_path")
        .agg(F.min("ref").alias("ref"))
        .select("scope", "path", "kind", "action", "ref", "local_path")
    )


def action_urls(refs: DataFrame) -> DataFrame:
    """Repository addresses of remote references."""
    repo = F.regexp_extract("action", r"^([^/]+/[^/]+)", 1)
    return refs.where("kind = 'remote'").select("scope", F.concat(F.lit("https://github.com/"), repo).alias("url")).distinct()
