"""Connected components of a large edge table, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.llm.common import keep_table, lookup


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge; edges: long columns a, b. root is the smallest node of the component.

    Each round points every node at its smallest neighbour, shortens the pointers to their roots and renames the edges'
    ends; an edge inside one tree goes. The edge table shrinks at least by half each round. Nulls are ignored.
    """
    rest = keep_table(_between(edges.where("a is not null and b is not null")), "edges")
    renamed: DataFrame | None = None
    while not rest.isEmpty():
        pointers = _roots(rest)
        if renamed is None:
            renamed = pointers
        else:
            moved = lookup(renamed.withColumnRenamed("root", "mid"), pointers.withColumnRenamed("node", "mid"), ["mid"])
            renamed = keep_table(moved.select("node", F.coalesce("root", "mid").alias("root")), "renamed")
        rest = keep_table(_between(_rename(rest, pointers)), "edges")
    return renamed if renamed is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _between(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rename(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = lookup(edges, pointers.select(F.col("node").alias(end), "root"), [end]).drop(end).withColumnRenamed("root", end)
    return edges


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root): every node's pointer to its smallest neighbour, followed to the end."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("b")))  # b's own row; a smaller neighbour of b has a row with b first
    pointers = keep_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "pointers")
    while True:
        step = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        pointers = keep_table(lookup(pointers, step, ["root"]).select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "pointers")
        if pointers.where("moved").isEmpty():
            return pointers.select("node", "root")
        pointers = pointers.select("node", "root")
