"""Vector code compression: product codebooks by Lloyd's rounds that compare active entries only.

Vectors become whole numbers and are cut into parts; every part position has a codebook. Each row carries, for each part,
its entry and the exact squared distance to it. In a round, a part whose entry stayed fixed compares only the entries that
moved against that stored distance, and the others rescan the whole codebook; whole numbers keep both exact. Rows stay
where they were read: a round is one pass over them that gives new row states and, for each task, sums by entry; only
those sums (as many as the codebooks have numbers) reach the driver. The states of a round follow from the rows and the
codebooks before, so a lost executor's part is worked out again from the table without any shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.llm.common import find_package, lookup, named

SCALE = 4096
#: Whole components beyond this could overflow a squared distance of a part.
LARGEST = 1 << 26
#: Bytes of differences that are held at once.
CHUNK = 16 << 20


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(n, k) squared distances of n parts to k entries."""
    out = np.empty((len(parts), len(entries)), np.int64)
    step = max(1, CHUNK // (8 * max(1, entries.size)))
    for lo in range(0, len(parts), step):
        gap = parts[lo : lo + step, None, :] - entries[None, :, :]
        out[lo : lo + step] = np.einsum("nkd,nkd->nk", gap, gap)
    return out


def assign(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part, ties to the lower index, and its squared distance, by a whole scan."""
    found = distances(parts, entries)
    best = found.argmin(axis=1)
    return best, found[np.arange(len(parts)), best]


def reassign(
    parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, near: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """`assign` after some entries moved, from the entries and distances before; also the number of comparisons made.

    A part of a fixed entry is no farther from it than from any other fixed entry, and has the lower index where equal.
    """
    code, near = code.copy(), near.copy()
    active = np.flatnonzero(moved)
    rescan = moved[code]
    code[rescan], near[rescan] = assign(parts[rescan], entries)
    compared = int(rescan.sum()) * len(entries)
    if len(active):
        stay = np.flatnonzero(~rescan)
        found = distances(parts[stay], entries[active])
        best = found.argmin(axis=1)
        other, far = active[best], found[np.arange(len(stay)), best]
        closer = (far < near[stay]) | ((far == near[stay]) & (other < code[stay]))
        code[stay[closer]], near[stay[closer]] = other[closer], far[closer]
        compared += found.size
    return code, near, compared


@dataclass
class Codebooks:
    """entries: (parts, entries, width) whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        """Digest of all components in order, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _whole(vectors: pa.Array) -> list[np.ndarray | None]:
    """floor(SCALE * x) of each vector; None for null vectors and those with null or non-finite components."""
    out: list[np.ndarray | None] = []
    for x in vectors:
        if not x.is_valid or x.values.null_count:
            out.append(None)
            continue
        scaled = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) * SCALE
        if not np.isfinite(scaled).all():
            out.append(None)
            continue
        scaled = np.floor(scaled)
        if scaled.size and np.abs(scaled).max() > LARGEST:
            raise ValueError(f"components beyond {LARGEST // SCALE} overflow the distances")
        out.append(scaled.astype("<i8"))
    return out


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, whole): rows whose vector has only finite components; `whole` holds 64-bit numbers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _whole(batch.column(2))
            kept = pa.array([w is not None for w in whole], pa.bool_())
            data = pa.array([None if w is None else w.tobytes() for w in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["vec_id", "label", "whole"]).filter(kept)

    label = F.to_json(F.struct(named(label_col).alias("label"))).alias("label")  # null labels are '{}', equal ones equal text
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), label, named(vector_col).alias("vector"))
    return rows.mapInArrow(convert, "vec_id long, label string, whole binary")


def _matrix(whole: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has `width` components as one matrix, and which rows they are."""
    blobs = whole.to_pylist()
    fits = np.array([len(b) == 8 * width for b in blobs], bool)
    return np.frombuffer(b"".join(b for b, f in zip(blobs, fits) if f), "<i8").reshape(-1, width), fits


STATE = "vec_id long, label string, whole binary, codes binary, nears binary, error long"


def _round(books: np.ndarray, moved: np.ndarray | None):
    """Rows of STATE to the same with the entries and distances in the given codebooks; `moved` is None in the first round.
    Vectors of another width keep null codes."""
    parts, _, width = books.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, fits = _matrix(batch.column(2), parts * width)
            n = len(matrix)
            codes, nears = np.empty((n, parts), np.uint8 if books.shape[1] <= 256 else "<u4"), np.empty((n, parts), "<i8")
            if moved is not None:
                codes = np.frombuffer(b"".join(filter(None, batch.column(3).to_pylist())), codes.dtype).reshape(n, parts).copy()
                nears = np.frombuffer(b"".join(filter(None, batch.column(4).to_pylist())), "<i8").reshape(n, parts).copy()
            for p in range(parts):
                own = matrix[:, p * width : (p + 1) * width]
                if moved is None:
                    codes[:, p], nears[:, p] = assign(own, books[p])
                else:
                    codes[:, p], nears[:, p], _ = reassign(own, books[p], moved[p], codes[:, p].astype(np.int64), nears[:, p])
            at = np.where(fits, np.cumsum(fits) - 1, -1).tolist()
            columns = [pa.array([None if i < 0 else found[i].tobytes() for i in at], pa.binary()) for found in (codes, nears)]
            total = nears.sum(axis=1).tolist()
            errors = pa.array([None if i < 0 else total[i] for i in at], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, errors], names=["vec_id", "label", "whole", "codes", "nears", "error"])

    return step


def _sums(shape: tuple[int, int, int]):
    """Rows with codes to one row (part, entry, count, sums) for each used entry of a task."""
    parts, size, width = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            matrix, _ = _matrix(batch.column(0), parts * width)
            codes = np.frombuffer(b"".join(filter(None, batch.column(1).to_pylist())), np.uint8 if size <= 256 else "<u4").reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], matrix[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=size)
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "count", "sums"])

    return add


def _first_entries(rows: DataFrame, parts: int, size: int) -> np.ndarray:
    """Codebooks from the `size` vectors with the smallest identifiers (null identifiers last, ties by components)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(size).collect()
    vectors = [np.frombuffer(r["whole"], "<i8") for r in first]
    vectors = [v for v in vectors if len(v) == len(vectors[0])]
    width = len(vectors[0]) // parts if vectors else 0
    if vectors and len(vectors[0]) % parts:
        raise ValueError(f"vectors of {len(vectors[0])} components have no {parts} equal parts")
    return np.array([[v[p * width : (p + 1) * width] for v in vectors] for p in range(parts)], np.int64).reshape(parts, len(vectors), width)


def compress(
    vectors: DataFrame,
    parts: int = 8,
    size: int = 16,
    rounds: int = 6,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, error) for each vector, and the codebooks.

    codes has one byte for each part (four for codebooks of over 256 entries), error is the sum of the parts' squared
    distances to their entries; label is the label as JSON. Components become floor(4096 * x). Vectors that are null or
    hold null or non-finite components are left out. Codebooks start from the vectors with the smallest identifiers; null
    identifiers come last, equal ones are ordered by their vectors, and repeated rows count each. With fewer vectors than
    entries the codebooks are smaller. Vectors whose length is not that of the first one keep a null code and error; a
    length that cannot be cut into equal parts, or a component that could overflow a distance, is an error. Other columns
    are not read. An empty table gives an empty result.
    """
    find_package(vectors.sparkSession)
    rows = whole_vectors(vectors, id_col, vector_col, label_col).persist(StorageLevel.DISK_ONLY)
    books = _first_entries(rows, parts, size)
    state = rows.selectExpr("*", "cast(null as binary) as codes", "cast(null as binary) as nears", "cast(null as long) as error")
    if not books.size:
        return state.select("vec_id", "label", "codes", "error"), Codebooks(books)
    held, moved = rows, None
    for _ in range(rounds):
        state = state.mapInArrow(_round(books, moved), STATE).persist(StorageLevel.DISK_ONLY)
        sums = state.select("whole", "codes").mapInArrow(_sums(books.shape), "part int, entry int, count long, sums array<long>")
        every = F.sum("count").alias("count"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])]
        after = books.copy()
        for r in sums.groupBy("part", "entry").agg(*every).collect():  # at most parts x size rows
            after[r["part"], r["entry"]] = [r[f"s{i}"] // r["count"] for i in range(books.shape[2])]
        held.unpersist()  # the new states are complete; a lost one is worked out again from the table
        held, moved, books = state, (after != books).any(axis=2), after
    state = state.mapInArrow(_round(books, moved), STATE)
    return state.select("vec_id", "label", "codes", "error"), Codebooks(books)


def code_errors(coded: DataFrame) -> DataFrame:
    """Rows of `compress` as vec_id, code (hexadecimal), error, label_error (the errors of all rows of the label)."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    code = F.lower(F.hex("codes")).alias("code")
    return lookup(coded.select("vec_id", "label", code, "error"), sums, ["label"]).select("vec_id", "code", "error", "label_error")
