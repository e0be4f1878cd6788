"""Walks over many small graphs at once.

A scope (a project, a repository) with a bounded number of edges is walked inside one task: rows are shuffled once by
scope, and each task walks all graphs of a slice of its rows together, level by level, with bitmaps of 64 starts per
node. What a walk holds is as large as its edges, however many (start, node) pairs there are. Scopes with more edges are
told apart here and walked by joins (see ``graph``), so no task ever holds a graph without a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from depvital.session import cut_lineage, find_package

#: Edges of a scope that one task may hold, and rows that are walked together where scopes are smaller.
LARGE_EDGES = 1_000_000
SLICE_ROWS = 200_000
#: Pairs that are handed on together.
PAIR_ROWS = 100_000
_WORD = 64


def split_by_size(edges: DataFrame, large_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of scopes that one task can hold, and the large scopes (one row each; None without any)."""
    sizes = edges.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large_edges).select("scope")
    large = cut_lineage(sizes)
    if large.isEmpty():
        return edges, None
    return edges.join(large, "scope", "left_anti"), large


class Graphs:
    """The graphs of some whole scopes: nodes are numbered through all scopes, edges are sorted by their start."""

    def __init__(self, rows: pa.Table) -> None:
        scope, self.scopes = _codes(rows.column("scope"))
        ends, self.values = _codes(pa.chunked_array(rows.column("src").chunks + rows.column("dst").chunks))
        src, dst = np.split(ends, 2)
        is_edge = dst >= 0
        width = max(1, len(self.values))
        start_keys, end_keys = scope * width + src, (scope * width + dst)[is_edge]
        self.keys = np.unique(np.concatenate([start_keys, end_keys]))
        self.scope, self.value = self.keys // width, self.keys % width
        from_, self.dst = np.searchsorted(self.keys, start_keys[is_edge]), np.searchsorted(self.keys, end_keys)
        order = np.argsort(from_, kind="stable")
        self.dst = self.dst[order]
        self.first_edge = np.concatenate([[0], np.cumsum(np.bincount(from_, minlength=len(self.keys)))])
        # starts: rows without an end, in the order of scope and value
        self.start_rows = np.flatnonzero(~is_edge)
        self.starts = np.unique(np.searchsorted(self.keys, start_keys[~is_edge]))
        self.start_of_row = np.searchsorted(self.keys, start_keys[~is_edge])
        per_scope = np.bincount(self.scope[self.starts], minlength=len(self.scopes))
        self.first_start = np.concatenate([[0], np.cumsum(per_scope)])[:-1]
        self.place = np.arange(len(self.starts)) - self.first_start[self.scope[self.starts]]

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``nodes`` and ends of all edges that leave them."""
        counts = self.first_edge[nodes + 1] - self.first_edge[nodes]
        at = np.repeat(np.arange(len(nodes)), counts)
        before = np.cumsum(counts) - counts
        return at, self.dst[np.arange(len(at)) - np.repeat(before, counts) + np.repeat(self.first_edge[nodes], counts)]

    def words(self) -> range:
        return range(-(-int(self.place.max() + 1) // _WORD) if len(self.place) else 0)

    def spread(self, word: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, nodes, new bits): which of the word's starts first reach each node at each level; level 0 are the starts."""
        bits, arriving = np.zeros(len(self.keys), np.uint64), np.zeros(len(self.keys), np.uint64)
        mine = self.place // _WORD == word
        active = self.starts[mine]
        new = np.uint64(1) << (self.place[mine] % _WORD).astype(np.uint64)
        level = 0
        while len(active):
            bits[active] |= new
            yield level, active, new
            at, ends = self.out(active)
            np.bitwise_or.at(arriving, ends, new[at])
            touched = np.unique(ends)
            new = arriving[touched] & ~bits[touched]
            arriving[touched] = 0
            active, new = touched[new != 0], new[new != 0]
            level += 1

    def start_at(self, nodes: np.ndarray, word: int, bit: int) -> np.ndarray:
        """Index of the start that a bit of a word stands for in the nodes' scopes."""
        return self.first_start[self.scope[nodes]] + word * _WORD + bit

    def columns(self, nodes: np.ndarray) -> list[pa.Array]:
        """Scope and value of nodes."""
        return [self.scopes.take(pa.array(self.scope[nodes])), self.values.take(pa.array(self.value[nodes]))]

    def named(self, nodes: np.ndarray) -> pa.Array:
        return self.values.take(pa.array(self.value[nodes]))


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes in the order of the values, -1 for nulls, and the values."""
    encoded = column.combine_chunks().dictionary_encode() if column.num_chunks else pa.array([], column.type).dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    order = pc.sort_indices(encoded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    codes = pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(codes >= 0, rank[codes] if len(rank) else -1, -1), encoded.dictionary.take(order)


def _walk_scopes(kernel: Callable[[Graphs, pa.Table], Iterator[list[pa.Array]]], names: list[str], slice_rows: int):
    """Batches sorted by scope to the kernel's rows; whole scopes are taken together up to ``slice_rows`` rows."""

    def run(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        for columns in kernel(Graphs(table), table):
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            scope = batch.column(0)
            ends = np.flatnonzero(pc.not_equal(scope[1:], scope[:-1]).to_numpy(zero_copy_only=False)) + 1
            if held and held[-1].column(0)[-1].as_py() != scope[0].as_py():
                ends = np.concatenate([[0], ends])
            lo = 0
            for end in ends.tolist():  # between two scopes
                if count + end - lo >= slice_rows:
                    yield from run([*held, batch.slice(lo, end - lo)])
                    held, count, lo = [], 0, end
            held.append(batch.slice(lo))
            count += batch.num_rows - lo
        if held:
            yield from run(held)

    return walk


def walk_graphs(
    edges: DataFrame,
    starts: DataFrame,
    kernel: Callable[[Graphs, pa.Table], Iterator[list[pa.Array]]],
    output: list[tuple[str, str]],
    label: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Rows that a kernel gives for the graphs of all scopes.

    ``edges`` has scope, src, dst; ``starts`` has scope, node and the label column, if one is named. ``output`` lists names
    and types: int, long, string, or "scope" and "node" for those of the inputs.
    """
    find_package(edges.sparkSession)
    nothing = F.lit(None).cast("string")
    node_type = edges.schema["src"].dataType
    rows = edges.select("scope", "src", "dst", nothing.alias("label")).unionByName(
        starts.select("scope", F.col("node").alias("src"), F.lit(None).cast(node_type).alias("dst"), (F.col(label) if label else nothing).alias("label"))
    )
    rows = rows.where("scope IS NOT NULL AND src IS NOT NULL")
    types = {"scope": rows.schema["scope"].dataType, "node": node_type, "int": IntegerType(), "long": LongType(), "string": StringType()}
    schema = StructType([StructField(name, types[kind]) for name, kind in output])
    dealt = rows.repartition("scope").sortWithinPartitions("scope")
    return dealt.mapInArrow(_walk_scopes(kernel, [name for name, _ in output], slice_rows), schema)


# --- kernels ---------------------------------------------------------------------


def pairs(graphs: Graphs, rows: pa.Table) -> Iterator[list[pa.Array]]:
    """scope, start, node, level of every pair, starts themselves at level 0."""

    def found(held: list[tuple[np.ndarray, np.ndarray, int]]) -> list[pa.Array]:
        start, node = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        level = np.repeat([h[2] for h in held], [len(h[0]) for h in held]).astype(np.int32)
        return [*graphs.columns(start), graphs.named(node), pa.array(level)]

    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    for word in graphs.words():
        for level, nodes, new in graphs.spread(word):
            for bit in range(_WORD):
                hit = nodes[(new >> np.uint64(bit)) & np.uint64(1) != 0]
                if len(hit):
                    held.append((graphs.starts[graphs.start_at(hit, word, bit)], hit, level))
            if sum(len(h[0]) for h in held) >= PAIR_ROWS:
                yield found(held)
                held = []
    if held:
        yield found(held)


def _reached(graphs: Graphs, word: int) -> np.ndarray:
    bits = np.zeros(len(graphs.keys), np.uint64)
    for _, nodes, new in graphs.spread(word):
        bits[nodes] |= new
    return bits


def start_metrics(graphs: Graphs, rows: pa.Table) -> Iterator[list[pa.Array]]:
    """scope, start, transitive nodes below it, those below no other start, and other starts above it.

    A node belongs to one start where its smallest and its largest one are the same.
    """
    n, k = len(graphs.keys), len(graphs.starts)
    if not k:
        return
    smallest, largest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    is_start = np.zeros(n, bool)
    is_start[graphs.starts] = True
    total, above = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for word in graphs.words():
        bits = _reached(graphs, word)
        nodes = np.flatnonzero((bits != 0) & ~is_start)
        for bit in range(_WORD):
            hit = nodes[(bits[nodes] >> np.uint64(bit)) & np.uint64(1) != 0]
            if not len(hit):
                continue
            start = graphs.start_at(hit, word, bit)
            smallest[hit] = np.where(smallest[hit] < 0, start, smallest[hit])
            largest[hit] = start
            total += np.bincount(start, minlength=k)
        above += np.bitwise_count(bits[graphs.starts]).astype(np.int64)
    own = (smallest >= 0) & (smallest == largest)
    exclusive = np.bincount(smallest[own], minlength=k)
    yield [*graphs.columns(graphs.starts), *(pa.array(x) for x in (total, exclusive, above - 1))]


def providers(graphs: Graphs, rows: pa.Table) -> Iterator[list[pa.Array]]:
    """scope, node, its smallest start and how many starts lead to it; a start does not lead to itself."""
    n = len(graphs.keys)
    smallest, count = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for word in graphs.words():
        bits = _reached(graphs, word)
        mine = graphs.place // _WORD == word
        bits[graphs.starts[mine]] &= ~(np.uint64(1) << (graphs.place[mine] % _WORD).astype(np.uint64))
        hit = np.flatnonzero(bits)
        count[hit] += np.bitwise_count(bits[hit]).astype(np.int64)
        lowest = np.bitwise_count((bits[hit] & (~bits[hit] + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        start = graphs.start_at(hit, word, 0) + lowest
        smallest[hit] = np.where(smallest[hit] < 0, start, smallest[hit])
    hit = np.flatnonzero(count)
    if len(hit):
        yield [*graphs.columns(hit), graphs.named(graphs.starts[smallest[hit]]), pa.array(count[hit])]


def first_labels(graphs: Graphs, rows: pa.Table) -> Iterator[list[pa.Array]]:
    """scope, node, smallest label that arrives at the lowest level, and that level; all starts advance together."""
    codes, labels = _codes(rows.column("label"))
    none = len(labels)
    label = np.full(len(graphs.keys), none, np.int64)
    own = codes[graphs.start_rows]
    np.minimum.at(label, graphs.start_of_row, np.where(own < 0, none, own))
    seen = np.zeros(len(graphs.keys), bool)
    active, level = graphs.starts, 0
    while len(active):
        seen[active] = True
        found = label[active]
        yield [*graphs.columns(active), labels.take(pa.array(found, mask=found == none)), pa.array(np.full(len(active), level, np.int32))]
        at, ends = graphs.out(active)
        fresh = ~seen[ends]
        np.minimum.at(label, ends[fresh], found[at[fresh]])
        active = np.unique(ends[fresh])
        level += 1
