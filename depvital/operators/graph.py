"""Dependency graphs: resolution of direct dependencies, reachability and removal metrics.

Tables are keyed by project. A project of up to ``LARGE_EDGES`` edges is walked in one task (see ``walks``): one shuffle,
no rounds. Larger ones are walked by joins on (project, node), never on the project alone, so they spread over all tasks;
their rounds cut lineage in the shared checkpoint folder. Both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depvital.operators.walks import LARGE_EDGES, first_labels, pairs, providers, split_by_size, start_metrics, walk_graphs
from depvital.session import cut_by, cut_lineage, drop_table


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _pin(df: DataFrame, n: int, *key: str) -> DataFrame:
    return df.repartition(n, *key).persist()


class _Found:
    """Rows found so far, as tables in the checkpoint folder that are merged when the last is no smaller than the one
    before: a row is written again a logarithmic number of times, and a round joins a few tables."""

    def __init__(self) -> None:
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, rows: DataFrame) -> tuple[int, DataFrame]:
        new = cut_lineage(rows)
        count = new.count()  # from the files' footers
        if count:
            self.tables.append((count, new))
        while len(self.tables) > 1 and self.tables[-1][0] >= self.tables[-2][0]:
            (a, x), (b, y) = self.tables[-2:]
            self.tables[-2:] = [(a + b, cut_lineage(x.unionByName(y)))]
            for merged in (x, y):
                if merged is not new:  # the newest rows are the next frontier
                    drop_table(merged)
        return count, new

    def all(self, like: DataFrame) -> DataFrame:
        return _union([table for _, table in self.tables] or [like])


def _walk(edges: DataFrame, start: DataFrame, key: list[str], step) -> DataFrame:
    """Rows of the start and of every further round; a round's rows are those of ``step`` whose key is new.

    Each round joins only the rows found in the round before, so every pair is expanded once and cycles end by
    themselves. Edges are cached by their start: shuffled once, not in every round.
    """
    n = _partitions(edges.sparkSession)
    links = _pin(cut_lineage(edges.select("scope", "src", "dst").distinct()), n, "scope", "src")
    found = _Found()
    count, frontier = found.add(start.withColumn("level", F.lit(0)))
    level = 0
    while count:
        level += 1
        rows = step(frontier, links).join(found.all(frontier).select(*key), key, "left_anti")
        count, frontier = found.add(rows.withColumn("level", F.lit(level)))
    links.unpersist()
    return found.all(frontier)


def _apart(edges: DataFrame, starts: DataFrame, large_edges: int):
    """(edges, starts) of the scopes that one task can hold, and of the others (None without any)."""
    near, large = split_by_size(edges, large_edges)
    if large is None:
        return (near, starts), None
    return (near, starts.join(large, "scope", "left_anti")), (edges.join(large, "scope", "left_semi"), starts.join(large, "scope", "left_semi"))


def closure(edges: DataFrame, seeds: DataFrame, origin: str, large_edges: int = LARGE_EDGES) -> DataFrame:
    """All (scope, origin, node, level) reachable from the seeds; the first (lowest) level is kept.

    ``edges`` has scope, src, dst; ``seeds`` has scope, the origin column and node, which are the same.
    """
    near, far = _apart(edges, seeds.select("scope", "node"), large_edges)
    found = walk_graphs(*near, pairs, [("scope", "scope"), (origin, "node"), ("node", "node"), ("level", "int")])
    if far is None:
        return found
    by_joins = _closure_by_joins(far[0], far[1].withColumn(origin, F.col("node")), origin)
    return found.unionByName(by_joins.select(*found.columns))


def _closure_by_joins(edges: DataFrame, seeds: DataFrame, origin: str) -> DataFrame:
    key = ["scope", origin, "node"]

    def step(frontier: DataFrame, links: DataFrame) -> DataFrame:
        ends = frontier.select("scope", origin, F.col("node").alias("src")).join(links, ["scope", "src"])
        return ends.select("scope", origin, F.col("dst").alias("node")).distinct()

    return _walk(edges, seeds.select(*key).distinct(), key, step)


def first_reach(edges: DataFrame, seeds: DataFrame, payload: str, large_edges: int = LARGE_EDGES) -> DataFrame:
    """(scope, node, payload, level): each reachable node once, at its lowest level, with the smallest payload.

    ``edges`` has scope, src, dst; ``seeds`` has scope, node and the payload column (text). All seeds advance
    together, so an edge is followed once however many seeds lead to it.
    """
    near, far = _apart(edges, seeds.select("scope", "node", payload), large_edges)
    output = [("scope", "scope"), ("node", "node"), (payload, "string"), ("level", "int")]
    found = walk_graphs(*near, first_labels, output, label=payload)
    if far is None:
        return found
    least = F.min(payload).alias(payload)

    def step(frontier: DataFrame, links: DataFrame) -> DataFrame:
        ends = frontier.select("scope", F.col("node").alias("src"), payload).join(links, ["scope", "src"])
        return ends.groupBy("scope", F.col("dst").alias("node")).agg(least)

    by_joins = _walk(far[0], far[1].groupBy("scope", "node").agg(least), ["scope", "node"], step)
    return found.unionByName(by_joins.select(*found.columns))


def _by_scope(edges: DataFrame, direct: DataFrame) -> tuple[DataFrame, DataFrame]:
    scoped = edges.select(F.col("project_id").alias("scope"), "src", "dst")
    return scoped, direct.select(F.col("project_id").alias("scope"), F.col("package_id").alias("node"))


def reachability(edges: DataFrame, direct: DataFrame, large_edges: int = LARGE_EDGES) -> DataFrame:
    """(project_id, direct_id, node, level) for every node reachable from a direct dependency.

    The start itself is left out, also when a cycle leads back to it.
    """
    scoped, starts = _by_scope(edges, direct)
    reach = closure(scoped, starts, "direct_id", large_edges)
    return reach.where("node <> direct_id").withColumnRenamed("scope", "project_id")


def _mark_direct(reach: DataFrame, direct: DataFrame) -> DataFrame:
    flags = direct.select("project_id", F.col("package_id").alias("node"), F.lit(True).alias("is_direct")).distinct()
    return reach.join(flags, ["project_id", "node"], "left").withColumn(
        "is_direct", F.coalesce("is_direct", F.lit(False))
    )


def graph_metrics(edges: DataFrame, direct: DataFrame, large_edges: int = LARGE_EDGES) -> DataFrame:
    """Transitive nodes per direct dependency: total, exclusive to it, shared, and direct ones above it.

    A node is exclusive where its smallest and its largest provider are the same, so no table of (direct, node) pairs is
    built, but for projects that one task cannot hold.
    """
    near, far = _apart(*_by_scope(edges, direct), large_edges)
    output = [("scope", "scope"), ("direct_id", "node"), ("total_transitive", "long"), ("exclusive_transitive", "long"), ("via_count", "long")]
    found = walk_graphs(*near, start_metrics, output)
    found = found.select(
        F.col("scope").alias("project_id"),
        "direct_id",
        "total_transitive",
        "exclusive_transitive",
        (F.col("total_transitive") - F.col("exclusive_transitive")).alias("shared_transitive"),
        "via_count",
    )
    if far is None:
        return found
    wide = far[0].withColumnRenamed("scope", "project_id"), far[1].select(F.col("scope").alias("project_id"), F.col("node").alias("package_id"))
    return found.unionByName(pair_metrics(reachability(*wide, large_edges), wide[1].distinct()))


def direct_providers(edges: DataFrame, direct: DataFrame, large_edges: int = LARGE_EDGES) -> DataFrame:
    """(project_id, node, via, via_count): the smallest direct dependency that leads to a node, and how many do."""
    near, far = _apart(*_by_scope(edges, direct), large_edges)
    found = walk_graphs(*near, providers, [("scope", "scope"), ("node", "node"), ("via", "node"), ("via_count", "long")])
    found = found.withColumnRenamed("scope", "project_id")
    if far is None:
        return found
    wide = far[0].withColumnRenamed("scope", "project_id"), far[1].select(F.col("scope").alias("project_id"), F.col("node").alias("package_id"))
    reach = reachability(*wide, large_edges)
    return found.unionByName(reach.groupBy("project_id", "node").agg(F.min("direct_id").alias("via"), F.count(F.lit(1)).alias("via_count")))


def pair_metrics(reach: DataFrame, direct: DataFrame) -> DataFrame:
    """``graph_metrics`` from a table of reachable pairs.

    A node with a single provider belongs to that provider, so exclusive nodes come from one count and
    minimum per node instead of a window over all providers of the node.
    """
    marked = _mark_direct(reach, direct)
    transitive = marked.where(~F.col("is_direct"))
    totals = transitive.groupBy("project_id", "direct_id").agg(F.count(F.lit(1)).alias("total"))
    exclusive = (
        transitive.groupBy("project_id", "node")
        .agg(F.count(F.lit(1)).alias("providers"), F.min("direct_id").alias("direct_id"))
        .where("providers = 1")
        .groupBy("project_id", "direct_id")
        .agg(F.count(F.lit(1)).alias("exclusive"))
    )
    above = (
        marked.where("is_direct")
        .groupBy("project_id", F.col("node").alias("direct_id"))
        .agg(F.count(F.lit(1)).alias("via_count"))
    )
    key = ["project_id", "direct_id"]
    zero = F.lit(0).cast("long")
    return (
        direct.select("project_id", F.col("package_id").alias("direct_id"))
        .join(totals, key, "left")
        .join(exclusive, key, "left")
        .join(above, key, "left")
        .select(
            *key,
            F.coalesce("total", zero).alias("total_transitive"),
            F.coalesce("exclusive", zero).alias("exclusive_transitive"),
            (F.coalesce("total", zero) - F.coalesce("exclusive", zero)).alias("shared_transitive"),
            F.coalesce("via_count", zero).alias("via_count"),
        )
    )


def indirect_via(reach: DataFrame, direct: DataFrame) -> DataFrame:
    """(project, direct, via) rows: direct dependencies that would stay, and the direct one that keeps them."""
    wanted = direct.select("project_id", F.col("package_id").alias("node"))
    return reach.join(wanted, ["project_id", "node"], "left_semi").select(
        "project_id", F.col("node").alias("direct_id"), F.col("direct_id").alias("via_id")
    )


def via_parents(reach: DataFrame, direct: DataFrame, names: DataFrame) -> DataFrame:
    """(project, node, parent name) rows: direct dependencies through which a transitive one comes in."""
    wanted = direct.select("project_id", F.col("package_id").alias("node"))
    transitive = reach.join(wanted, ["project_id", "node"], "left_anti")
    short = names.select(F.col("package_id").alias("direct_id"), F.col("name").alias("via_name"))
    return transitive.join(short, "direct_id").select("project_id", "node", "via_name")


def classify_relation(nodes: DataFrame, direct: DataFrame, graph_projects: DataFrame) -> DataFrame:
    """direct, transitive, or unknown where the project has no dependency graph at all."""
    flags = direct.select("project_id", F.col("package_id").alias("node"), F.lit(True).alias("is_direct")).distinct()
    known = graph_projects.select("project_id", F.lit(True).alias("has_graph")).distinct()
    return (
        nodes.join(known, "project_id", "left")
        .join(flags, ["project_id", "node"], "left")
        .select(
            "project_id",
            "node",
            F.when(F.col("has_graph").isNull(), "unknown")
            .when(F.col("is_direct"), "direct")
            .otherwise("transitive")
            .alias("relation"),
        )
    )


def total_transitive(nodes: DataFrame, direct: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of a project that are neither direct nor the project itself."""
    wanted = direct.select("project_id", F.col("package_id").alias("node"))
    left = nodes.select("project_id", "node").distinct().join(wanted, ["project_id", "node"], "left_anti")
    left = left.join(roots.select("project_id", F.col("root").alias("node")), ["project_id", "node"], "left_anti")
    return left.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_transitive"))


# --- SBOM graphs --------------------------------------------------------------


def sbom_edges(refs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Package edges of SBOM dependency entries; references without a package are dropped.

    ``refs`` has project_id, ref, purl (bom-ref or raw PURL to normalised PURL); ``dependencies`` has
    project_id, ref, child_ref.
    """
    src = refs.select("project_id", "ref", F.col("purl").alias("src"))
    dst = refs.select("project_id", F.col("ref").alias("child_ref"), F.col("purl").alias("dst"))
    return (
        dependencies.where("child_ref IS NOT NULL")
        .join(src, ["project_id", "ref"])
        .join(dst, ["project_id", "child_ref"])
        .select("project_id", "src", "dst")
        .distinct()
    )


def direct_deps(refs: DataFrame, dependencies: DataFrame, roots: DataFrame, dealt: bool = False) -> DataFrame:
    """Direct dependencies of every project root.

    ``roots`` has project_id, root_ref, root_purl (either may be NULL). References without a package, and
    the project's own package, are passed through to their children. So is a sole child of a reference
    without a package, if it has children itself. A root without an entry: direct are the references
    nothing depends on. A project without a root or without dependencies yields no row. Inputs that lie in tables bucketed
    by project are ``dealt`` already.
    """
    key = ["project_id", "ref"]
    children = cut_by(dependencies.where("child_ref IS NOT NULL").select(*key, "child_ref").distinct(), "project_id", dealt)
    entries = dependencies.select(*key).distinct()
    rooted = roots.select("project_id", F.coalesce("root_ref", "root_purl").alias("ref"), "root_purl").where(
        "ref IS NOT NULL"
    )
    # what a reference stands for and how many children it has; references without a package appear by children only
    counts = children.groupBy(*key).agg(F.count(F.lit(1)).alias("child_count"))
    # the roots are joined before the counts: what a full join gives is known to lie by no key, and would be dealt again
    own = refs.select(*key, "purl").join(rooted.select("project_id", "root_purl"), "project_id", "left")
    described = cut_by(
        own.select(*key, "purl", (F.col("purl") == F.col("root_purl")).alias("is_self"))
        .join(counts, key, "full")
        .select(
            *key,
            "purl",
            F.coalesce("child_count", F.lit(0)).alias("child_count"),
            F.coalesce("is_self", F.lit(False)).alias("is_self"),
        ),
        "project_id",
        dealt,
    )
    # a state is a reference, marked when it is the sole child of one without a package; states that pass lead on
    state = lambda sole, ref: F.concat(F.when(sole, "*").otherwise("-"), ref)
    always = F.col("purl").isNull() | F.col("is_self")
    passing = described.select(
        *key,
        F.explode(F.expr("CASE WHEN purl IS NULL OR is_self THEN array(true, false) WHEN child_count > 0 THEN array(true) END")).alias("sole"),
        (F.col("purl").isNull() & (F.col("child_count") == 1)).alias("only"),
    )
    links = passing.join(children, key).select(
        F.col("project_id").alias("scope"), state(F.col("sole"), F.col("ref")).alias("src"), state(F.col("only"), F.col("child_ref")).alias("dst")
    )
    starts = rooted.join(entries, key, "left_semi").join(children, key).select(
        F.col("project_id").alias("scope"), state(F.lit(False), F.col("child_ref")).alias("node"), F.lit("").alias("start")
    )
    reached = first_reach(links, starts, "start").select(
        F.col("scope").alias("project_id"), F.expr("substr(node, 2)").alias("ref"), F.col("node").startswith("*").alias("sole")
    )
    ends = reached.join(described, key).where(~always & ~(F.col("sole") & (F.col("child_count") > 0)))
    inferred = (
        rooted.join(entries, key, "left_anti")
        .select("project_id")
        .join(entries, "project_id")
        .join(children.select("project_id", F.col("child_ref").alias("ref")), key, "left_anti")
        .join(described.where("purl IS NOT NULL"), key)
    )
    return ends.select("project_id", "purl").unionByName(inferred.select("project_id", "purl")).distinct()


def _maven_group(purl: str) -> Column:
    return F.lower(F.regexp_extract(purl, r"^pkg:maven/(.+)/[^/@]+(?:@|$)", 1))


def flatten_aggregators(direct: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Replace the modules of a Maven aggregator project by what they depend on.

    It applies when the root is a Maven package and every direct dependency shares its group and has
    dependencies of its own. One level only; modules and the project itself are left out; a project for
    which nothing remains keeps its direct dependencies.
    """
    group = _maven_group("root_purl")
    maven = roots.select("project_id", "root_purl", group.alias("root_group")).where("root_group <> ''")
    parents = edges.select("project_id", F.col("src").alias("purl"), F.lit(True).alias("has_children")).distinct()
    judged = (
        direct.join(maven, "project_id")
        .join(parents, ["project_id", "purl"], "left")
        .groupBy("project_id")
        .agg(
            F.bool_and(
                (_maven_group("purl") == F.col("root_group")) & F.coalesce("has_children", F.lit(False))
            ).alias("aggregator")
        )
        .where("aggregator")
        .select("project_id")
    )
    modules = direct.join(judged, "project_id", "left_semi")
    below = (
        modules.join(edges.withColumnRenamed("src", "purl"), ["project_id", "purl"])
        .select("project_id", F.col("dst").alias("purl"))
        .distinct()
        .join(modules, ["project_id", "purl"], "left_anti")
        .join(roots.select("project_id", F.col("root_purl").alias("purl")), ["project_id", "purl"], "left_anti")
    )
    replaced = below.select("project_id").distinct()
    return direct.join(replaced, "project_id", "left_anti").unionByName(below)


# --- CI actions ---------------------------------------------------------------


def action_closure(direct_actions: DataFrame, composite_refs: DataFrame) -> DataFrame:
    """Actions reached through composite actions, with the direct action that leads to each.

    ``direct_actions`` has scope, action (owner/repo[/path]); ``composite_refs`` has scope, action, uses.
    Actions at the lowest level win, then the lexically first origin. Output rows are repositories
    (owner/repo) that no direct action names already.
    """
    edges = composite_refs.select("scope", F.col("action").alias("src"), F.col("uses").alias("dst"))
    seeds = direct_actions.select("scope", F.col("action").alias("via"), F.col("action").alias("node"))
    reach = first_reach(edges, seeds, "via").where("level > 0")
    found = (
        reach.withColumn("repo", action_repo("node"))
        .groupBy("scope", "repo")
        .agg(F.min(F.struct("level", "via")).alias("first"))
        .select("scope", "repo", "first.level", "first.via")
    )
    named = direct_actions.select("scope", action_repo("action").alias("repo")).distinct()
    return found.join(named, ["scope", "repo"], "left_anti")


def action_repo(action: str) -> Column:
    """owner/repo of owner/repo/path."""
    return F.regexp_extract(action, r"^([^/]+/[^/]+)", 1)


def local_action_refs(workflow_paths: DataFrame, local_refs: DataFrame, remote_refs: DataFrame) -> DataFrame:
    """(scope, action, level, path): remote actions named by a repository's own composite actions, and where.

    ``workflow_paths`` has scope, path; ``local_refs`` has scope, path, uses_path; ``remote_refs`` has scope, path, action.
    The closure stays inside the repository.
    """
    edges = local_refs.select("scope", F.col("path").alias("src"), F.col("uses_path").alias("dst"))
    seeds = workflow_paths.select("scope", F.col("path").alias("start"), F.col("path").alias("node"))
    paths = first_reach(edges, seeds, "start").select("scope", F.col("node").alias("path"), "level")
    return paths.join(remote_refs, ["scope", "path"]).select("scope", "action", "level", "path")


def local_action_uses(workflow_paths: DataFrame, local_refs: DataFrame, remote_refs: DataFrame) -> DataFrame:
    """Repositories named by ``local_action_refs``, with the path at the lowest level, then the first path."""
    return (
        local_action_refs(workflow_paths, local_refs, remote_refs)
        .groupBy("scope", action_repo("action").alias("repo"))
        .agg(F.min(F.struct("level", "path")).alias("first"))
        .select("scope", "repo", F.col("first.path").alias("via_path"))
    )
