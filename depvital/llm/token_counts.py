"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens: a leaf holds the characters and tokens of some consecutive
pre-tokens, an inner node the sums below it. A pre-token's start is a place where splitting can begin anew, because the
pattern looks ahead by one character at most and never back. After an edit only the leaves it touches, with two
characters of context before it, are split and encoded again, on to the first old leaf start that is a pre-token start
in the new text too; the sums on the paths to the root change, all other counts stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depvital.llm.byte_bpe import Codec, codec, read_ranks, small_batches
from depvital.llm.common import named

#: Pre-tokens in a leaf of a new tree.
LEAF_PIECES = 64
#: An edit can change the pre-token that ends up to one character before it; a leaf that ends earlier stays.
CONTEXT = 2
STATE = "doc_id long, text string, tree binary, n_tokens long"


class CountTree:
    """Sums of characters (row 0) and tokens (row 1); node i has the children 2 i and 2 i + 1, leaf k is node width + k."""

    def __init__(self, sums: np.ndarray) -> None:
        self.sums = sums
        self.width = sums.shape[1] // 2

    @classmethod
    def build(cls, coder: Codec, text: str) -> CountTree:
        chars, tokens = piece_sizes(coder, text)
        cuts = np.arange(0, len(chars), LEAF_PIECES)
        width = 1 << max(0, len(cuts) - 1).bit_length()
        sums = np.zeros((2, 2 * width), np.int32)
        if len(cuts):
            sums[0, width : width + len(cuts)] = np.add.reduceat(chars, cuts)
            sums[1, width : width + len(cuts)] = np.add.reduceat(tokens, cuts)
        level = width
        while level > 1:
            sums[:, level // 2 : level] = sums[:, level : 2 * level : 2] + sums[:, level + 1 : 2 * level : 2]
            level //= 2
        return cls(sums)

    @classmethod
    def load(cls, stored: bytes) -> CountTree:
        return cls(np.frombuffer(stored, "<i4").reshape(2, -1).copy())

    def store(self) -> bytes:
        return self.sums.astype("<i4").tobytes()

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character (the last leaf with characters beyond the end), and the leaf's start."""
        place = max(0, min(place, int(self.sums[0, 1]) - 1))
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.sums[0, node]:
                start += int(self.sums[0, node])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = self.width + leaf
        self.sums[:, node] = chars, tokens
        while node > 1:
            node //= 2
            self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]

    def edit(self, coder: Codec, text: str, edits: Sequence[tuple[int, int, str]]) -> tuple[str, int]:
        """Apply the edits; returns the new text and the number of characters that were split again."""
        total, again = len(text), 0
        todo = _ordered(edits, total)
        if not total:
            new = "".join(e[2] for e in todo)
            self.__init__(CountTree.build(coder, new).sums)
            return new, len(new)
        out: list[str] = []
        changes: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        done = k = 0
        while k < len(todo):
            first, start = self.leaf_at(todo[k][0] - CONTEXT)
            last, stop, from_edit, synced = first, start + self._chars(first), k, False
            while not synced:
                # an edit belongs to this stretch if its context begins in it; the stretch ends with a leaf behind the edit
                while k < len(todo) and (stop == total or todo[k][0] - CONTEXT < stop):
                    while todo[k][1] > stop:
                        last += 1
                        stop += self._chars(last)
                    k += 1
                new = _spliced(text, start, stop, todo[from_edit:k])
                behind = last + 1
                while stop < total and not self._chars(behind):
                    behind += 1
                ahead = text[stop : stop + self._chars(behind)] if stop < total else ""
                chars, tokens = piece_sizes(coder, new + ahead)
                again += len(new) + len(ahead)
                ends = np.cumsum(chars)
                synced = stop == total or not new or bool(np.any(ends == len(new)))
                if not synced:  # the old leaf start is no pre-token start any more: go on through the next leaf
                    last, stop = behind, stop + len(ahead)
            kept = int(np.searchsorted(ends, len(new), side="right"))
            changes.append((first, last, chars[:kept], tokens[:kept]))
            out += [text[done:start], new]
            done = stop
        out.append(text[done:])
        for first, last, chars, tokens in changes:
            cuts = np.linspace(0, len(chars), last - first + 2).astype(int)
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                self.put(first + i, int(chars[lo:hi].sum()), int(tokens[lo:hi].sum()))
        return "".join(out), again

    def _chars(self, leaf: int) -> int:
        return int(self.sums[0, self.width + leaf])


def piece_sizes(coder: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each pre-token."""
    pieces = coder.split(text)
    return np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(coder.counts(pieces), np.int64)


def _ordered(edits: Sequence[tuple[int, int, str]], total: int) -> list[tuple[int, int, str]]:
    """By place, inside the text; what an earlier edit has replaced is not replaced again."""
    found, free = [], 0
    for start, stop, text in sorted(edits, key=lambda e: (e[0], e[1])):
        start = min(max(start, free, 0), total)
        free = max(free, min(max(stop, start), total))
        found.append((start, free, text))
    return found


def _spliced(text: str, start: int, stop: int, edits: Sequence[tuple[int, int, str]]) -> str:
    parts, at = [], start
    for first, last, new in edits:
        parts += [text[at:first], new]
        at = last
    return "".join([*parts, text[at:stop]])


def build_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """State table (doc_id, text, tree, n_tokens) of whole texts, one row per input row; keep it to apply edits later.

    A null text counts as empty and has no tokens. Repeated rows and null identifiers come back as they went in; other
    columns are not read; an empty table gives an empty state.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for whole in batches:
            for batch in small_batches(whole, 1):
                trees = [CountTree.build(coder, t or "") for t in batch.column(1).to_pylist()]
                columns = [pa.array([t.store() for t in trees], pa.binary()), pa.array([t.n_tokens for t in trees], pa.int64())]
                texts = pc.fill_null(batch.column(1), "")
                yield pa.RecordBatch.from_arrays([batch.column(0), texts, *columns], names=["doc_id", "text", "tree", "n_tokens"])

    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))
    return texts.mapInArrow(build, STATE)


def unbuilt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A state without trees; they are built by the task that applies the first edits."""
    text = F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text")
    none = F.lit(None).cast("binary").alias("tree"), F.lit(None).cast("long").alias("n_tokens")
    return docs.select(named(id_col).cast("long").alias("doc_id"), text, *none)


Edit = tuple[int, int, str]


def _edited(state: DataFrame, edits: Sequence[str], edits_of: Callable[[str, list], list[Edit]], ranks_path: str, pattern: str) -> DataFrame:
    """The state after the edits that `edits_of` gives for a text and its value of the columns `edits`."""
    ranks = state.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names = ["doc_id", "text", "tree", "n_tokens", "n_tokens_before", "n_edits", "split_again"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks.value, pattern)
        for whole in batches:
            for batch in small_batches(whole, 1):
                given = batch.column(4).to_pylist() if edits else [None] * batch.num_rows
                rows = []
                for text, stored, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), given):
                    changes = edits_of(text, own)
                    tree = CountTree.build(coder, text) if stored is None else CountTree.load(stored)
                    before, again = tree.n_tokens, 0
                    if changes:
                        text, again = tree.edit(coder, text, changes)
                    rows.append((text, tree.store(), tree.n_tokens, before, len(changes), again))
                texts, trees, *counts = (list(x) for x in zip(*rows))
                counts = [pa.array(c, pa.int64()) for c in counts]
                columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(trees, pa.binary()), *counts]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = state.select("doc_id", "text", "tree", "n_tokens", *edits)
    return rows.mapInArrow(apply, f"{STATE}, n_tokens_before long, n_edits long, split_again long")


def apply_edits(state: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The state after its column edits (array of start, stop, text in characters of the old text).

    Adds n_tokens_before, n_edits and split_again (characters that were split anew). Places beyond the text's end count
    as its end; where edits overlap, the later one replaces what is left; null or no edits leave a row as it is.
    """

    def given(text: str, edits: list | None) -> list[Edit]:
        return [(e["start"], e["stop"], e["text"] or "") for e in edits or [] if e]

    return _edited(state, ["edits"], given, ranks_path, pattern)


def replace_matches(state: DataFrame, search: str, replacement: str, ranks_path: str, pattern: str) -> DataFrame:
    """The state after each match of the search pattern was replaced (groups as \\1); columns as in `apply_edits`."""
    matches = regex.compile(search).finditer
    return _edited(state, [], lambda text, _: [(m.start(), m.end(), m.expand(replacement)) for m in matches(text)], ranks_path, pattern)
