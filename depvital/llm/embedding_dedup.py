"""Near-duplicate embeddings by a tiled comparison in principal-component order.

Equal vectors are folded into one with a multiplicity. The others are turned into the frame of the principal components
of all vectors, so leading coordinates hold most of a product. Tiles are ranges of the first coordinate; pairs of tiles
whose bounding boxes lie too far apart are left out (unit vectors with cosine c are sqrt(2 - 2 c) apart). Inside a pair
of tiles, products of leading coordinates come first; what the rest can add is at most the product of the suffix norms,
and a pair of vectors is dropped as soon as it cannot reach the threshold. A task gives counts of links and edges that
span the linked vectors, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.llm.common import keep_table, lookup, named, range_of
from depvital.llm.components import components

THRESHOLD = 0.95
#: Bytes of vectors in a tile, and entries of the product matrix that are in memory at once.
TILE_BYTES = 4 << 20
BLOCK_ENTRIES = 4 << 20
#: Leading coordinates in a tile's bounding box.
BOX = 4
#: What rounding may add to a bound.
SLACK = 1e-9


def unit_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vkey, unit): unit vector as doubles and a 128-bit hash of it; both null for vectors that link with nothing."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = pc.fill_null(pc.cast(lists.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            blobs: list[bytes | None] = [None] * len(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                found = values[starts[rows][:, None] + np.arange(size)]
                with np.errstate(invalid="ignore", over="ignore"):
                    top = np.abs(found).max(axis=1)
                    good = np.isfinite(top) & (top > 0)
                    found = found[good] / top[good][:, None]
                found = found / np.sqrt((found * found).sum(axis=1))[:, None] + 0.0  # no negative zeros
                for row, x in zip(rows[good].tolist(), found):
                    blobs[row] = np.trim_zeros(x, "b").tobytes()
            keys = [None if b is None else xxhash.xxh3_128_digest(b) for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "vkey", "unit"])

    rows = table.select(named(id_col).cast("long").alias("vec_id"), named(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(units, "vec_id long, vkey binary, unit binary")


def _matrix(blobs: list[bytes], size: int) -> np.ndarray:
    """Unit vectors as rows; shorter vectors are filled up with zeros."""
    out = np.zeros((len(blobs), size))
    for row, blob in zip(out, blobs):
        x = np.frombuffer(blob)
        row[: len(x)] = x
    return out


def principal_frame(vectors: DataFrame, size: int) -> np.ndarray:
    """Columns are the principal directions of all vectors, the strongest first. The sums have size * size entries,
    whatever the number of vectors; they are added up on the executors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), size)
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["at", "v"])

    sums = vectors.select("unit").mapInArrow(moments, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    found = np.zeros(size * size)
    for row in sums.toLocalIterator():
        found[row["at"]] = row["v"]
    strength, directions = np.linalg.eigh(found.reshape(size, size))
    return directions[:, np.argsort(strength)[::-1]]


def _tiles(vectors: DataFrame, frame: np.ndarray, tile_rows: int) -> DataFrame:
    """(tile, low, high, nodes, weights, turned): one row for each tile, vectors sorted by the first coordinate."""
    size = len(frame)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = _matrix(batch.column(2).to_pylist(), size) @ frame
            blobs = pa.array([x.tobytes() for x in turned], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(turned[:, 0]), blobs], names=["node", "weight", "first", "turned"])

    turned = vectors.select("node", "weight", "unit").mapInArrow(turn, "node long, weight long, first double, turned binary")
    turned = keep_table(turned, "turned-vectors")
    count = turned.count()
    ranges = max(1, -(-count // tile_rows))
    cuts = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(turned.agg(F.percentile_approx("first", cuts, 100 * ranges)).first()[0])) if cuts else []
    in_range = F.lit(0) if not cuts else range_of(F.col("first"), F.array(*[F.lit(c) for c in cuts]), len(cuts))
    dealt = turned.withColumn("range", in_range)
    # a range of many equal first coordinates is cut further by the vectors' numbers
    parts = dealt.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / (2 * tile_rows)).alias("parts"))
    dealt = lookup(dealt, parts, ["range"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tile() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            x = np.frombuffer(b"".join(table.column("turned").to_pylist())).reshape(-1, size)
            low, high = x[:, :BOX].min(axis=0).tolist(), x[:, :BOX].max(axis=0).tolist()
            blobs = [table.column(c).to_numpy().tobytes() for c in ("node", "weight")]
            name = f"{table.column('range')[0].as_py()}-{table.column('part')[0].as_py()}"
            kinds = (pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array([v], t) for v, t in zip((name, low, high, *blobs, x.tobytes()), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=["tile", "low", "high", "nodes", "weights", "turned"])

        for batch in batches:
            both = [batch.column(i).to_numpy() for i in (0, 1)]
            cuts = [0, *(np.flatnonzero((np.diff(both[0]) != 0) | (np.diff(both[1]) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (both[0][lo], both[1][lo]):
                    yield tile()
                    held = []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield tile()

    ordered = dealt.select("range", "part", "first", "node", "weight", "turned").repartition("range", "part").sortWithinPartitions("range", "part", "first")
    schema = "tile string, low array<double>, high array<double>, nodes binary, weights binary, turned binary"
    return keep_table(ordered.mapInArrow(pack, schema), "vector-tiles")


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(a, b), a <= b: pairs of tiles whose boxes come within the reach. Tiles meet in cells of the first coordinate."""
    boxes = tiles.select("tile", "low", "high")
    lowest, highest = F.floor(F.col("low")[0] / reach), F.floor(F.col("high")[0] / reach)
    left = boxes.select(F.col("tile").alias("a"), F.col("low").alias("al"), F.col("high").alias("ah"), F.explode(F.sequence(lowest, highest + 1)).alias("cell"))
    right = boxes.select(F.col("tile").alias("b"), F.col("low").alias("bl"), F.col("high").alias("bh"), F.explode(F.sequence(lowest, highest + 1)).alias("cell"))
    gap = F.expr("aggregate(zip_with(zip_with(al, bh, (x, y) -> x - y), zip_with(bl, ah, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D)), 0D, (s, g) -> s + g * g)")
    near = left.join(right, "cell").where(F.col("a") <= F.col("b")).where(gap <= reach * reach + SLACK)
    return near.select("a", "b").distinct()


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the edges."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        for at in (u, v, label[u], label[v]):
            np.minimum.at(new, at, least)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the rows of a and b whose product reaches the threshold; leading coordinates first."""
    size = a.shape[1]
    stops = sorted({max(1, size // 4), max(1, size // 2), size})
    rest_a, rest_b = ([np.sqrt((x[:, s:] ** 2).sum(axis=1)) for s in stops] for x in (a, b))
    products = a[:, : stops[0]] @ b[:, : stops[0]].T
    i, j = np.nonzero(products >= threshold - SLACK - np.outer(rest_a[0], rest_b[0]))
    sums = products[i, j]
    if len(i) > products.size // 16:  # many pairs are still open: products of whole blocks are cheaper
        products += a[:, stops[0] :] @ b[:, stops[0] :].T
        return np.nonzero(products >= threshold)
    del products
    for number in range(1, len(stops)):
        part = slice(stops[number - 1], stops[number])
        for lo in range(0, len(i), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            sums[at] += np.einsum("ij,ij->i", a[i[at], part], b[j[at], part])
        open_ = sums >= threshold - (SLACK + rest_a[number][i] * rest_b[number][j] if number < len(stops) - 1 else 0)
        i, j, sums = i[open_], j[open_], sums[open_]
    return i, j


def _compare(threshold: float, size: int):
    """Pairs of tiles to rows (node, links, root): links found for a node, or an edge from the node to another."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name_a, nodes_a, weights_a, a, name_b, nodes_b, weights_b, b = (batch.column(i)[row].as_py() for i in range(8))
                same = name_a == name_b
                nodes_a, weights_a, nodes_b, weights_b = (np.frombuffer(x, np.int64) for x in (nodes_a, weights_a, nodes_b, weights_b))
                a, b = (np.frombuffer(x).reshape(-1, size) for x in (a, b))
                shift = 0 if same else len(a)
                counts = np.zeros(shift + len(b), np.int64)
                roots = np.arange(shift + len(b))
                step = max(1, BLOCK_ENTRIES // len(b))
                for lo in range(0, len(a), step):
                    block = a[lo : lo + step]
                    first = int(np.searchsorted(b[:, 0], block[0, 0] - reach))
                    last = int(np.searchsorted(b[:, 0], block[-1, 0] + reach, side="right"))
                    if same:
                        first = max(first, lo)
                    if first >= last:
                        continue
                    i, j = linked(block, b[first:last], threshold)
                    i, j = i + lo, j + first
                    if same:
                        once = i < j
                        i, j = i[once], j[once]
                    if not len(i):
                        continue
                    counts += np.bincount(i, weights_b[j], len(counts)).astype(np.int64)
                    counts += np.bincount(j + shift, weights_a[i], len(counts)).astype(np.int64)
                    old = np.flatnonzero(roots != np.arange(len(roots)))
                    roots = local_roots(len(roots), np.concatenate([i, old]), np.concatenate([j + shift, roots[old]]))
                nodes = nodes_a if same else np.concatenate([nodes_a, nodes_b])
                hit = np.flatnonzero(counts)
                columns = [pa.array(nodes[hit]), pa.array(counts[hit]), pa.array(nodes[roots[hit]])]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "root"])

    return compare


def near_vectors(
    table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", tile_bytes: int = TILE_BYTES
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: other rows with cosine >= threshold, and the smallest vec_id
    that is reachable by links; kept marks it.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
    component. Shorter vectors count as filled up with zeros. Rows with equal directions link with each other, repeated
    rows too. Null identifiers take part, but name a component only if nothing else is in it. Other columns are not read.
    """
    rows = keep_table(unit_vectors(table, id_col, vec_col), "unit-vectors")
    vectors = rows.where("vkey is not null").groupBy("vkey").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first_id"), F.any_value("unit").alias("unit"))
    vectors = keep_table(vectors.withColumn("node", F.monotonically_increasing_id()), "distinct-vectors")
    size = (vectors.agg(F.max(F.octet_length("unit"))).first()[0] or 8) // 8
    tiles = _tiles(vectors, principal_frame(vectors, size), max(64, tile_bytes // (8 * size)))
    pairs = _tile_pairs(tiles, float(np.sqrt(max(1e-12, 2 - 2 * threshold))))
    sides = [tiles.select(F.col("tile").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "weights", "turned")]) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").repartition(F.xxhash64("a", "b"))
    both = both.select("a", "nodes_a", "weights_a", "turned_a", "b", "nodes_b", "weights_b", "turned_b")
    found = keep_table(both.mapInArrow(_compare(threshold, size), "node long, links long, root long"), "vector-links")

    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_node = vectors.select("vkey", "node", "weight", "first_id").join(counts, "node", "left").join(roots, "node", "left")
    of_node = keep_table(of_node.withColumn("root", F.coalesce("root", "node")), "vector-roots")
    named_by = of_node.groupBy("root").agg(F.min("first_id").alias("component"))
    of_key = lookup(of_node, named_by, ["root"]).select("vkey", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component")
    component = F.when(F.col("vkey").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return (
        lookup(rows.select("vec_id", "vkey"), of_key, ["vkey"])
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
