"""Language identification by the nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams. Each language has several centroids, clusters of its
training vectors; a text gets the language of the centroid with the largest cosine. It is rejected by its distance from
that centroid: for each language and text length, the limit lies between the cosines of the language's own training texts
and those of the texts of all other languages, which are what an unseen language would look like.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depvital.llm.byte_bpe import small_batches
from depvital.llm.common import find_package, keep_table, named, nullable

#: Hashed features; lengths of n-grams in bytes.
DIMS = 8192
GRAMS = (1, 2, 3, 4)
#: Centroids per language, and the bound of labelled texts per language that they are clustered from. Document
#: frequencies come from all training texts.
CENTROIDS = 4
SAMPLE_PER_LANGUAGE = 1500
#: Limits are kept for lengths of half octaves of features. A language's own texts lie above the first quantile, other
#: languages' texts below the second one; where few own texts tell the length, the limit stays farther below them.
LENGTHS = 2 * 14
OWN_QUANTILE, FOREIGN_QUANTILE = 0.002, 0.99
SLACK, FEW, LEAST_TEXTS = 0.97, 100, 5
_SPAN = 1 << 20
_ROWS = 256
#: ASCII letters in lower case, other ASCII characters blank, bytes of other characters as they are.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def term_weights(text: str) -> np.ndarray:
    """Logarithmic counts of the text's hashed n-grams; words are set off by single blanks."""
    folded = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    counts = np.zeros(DIMS)
    for lo in range(0, len(folded), _SPAN):  # long texts in spans that overlap by an n-gram
        codes = np.frombuffer(folded[lo : lo + _SPAN + max(GRAMS) - 1], np.uint8).astype(np.uint32)
        for n in GRAMS:
            used = min(_SPAN, len(codes) - n + 1)
            if used <= 0:
                continue
            mixed = codes[:used].copy()
            for k in range(1, n):
                mixed = mixed * np.uint32(257) + codes[k : k + used]
            mixed = (mixed + np.uint32(n)) * np.uint32(2654435761)
            counts += np.bincount(mixed >> np.uint32(32 - int(math.log2(DIMS))), minlength=DIMS)
    return np.log1p(counts).astype(np.float32)


def length_of(weights: np.ndarray) -> np.ndarray:
    """Length class of each row: half octaves of its number of features."""
    terms = np.maximum(1, (weights > 0).sum(axis=-1))
    return np.minimum(LENGTHS - 1, np.floor(2 * np.log2(terms))).astype(np.int64)


def least_cosines(own: dict[int, tuple[float, int]], foreign: dict[int, float]) -> np.ndarray:
    """Limit for each length, from (low quantile, number) of own texts and the high quantile of others by length.

    Longer texts lie nearer, so limits never fall with the length; lengths with hardly any own texts take over from the
    next longer ones, at a lower rate the shorter they are.
    """
    limits = np.full(LENGTHS, np.inf)
    own = {at: found for at, found in own.items() if found[1] >= LEAST_TEXTS} or own
    for at, (low, n) in own.items():
        floor = low * min(SLACK, 1 - 0.5 * n**-0.5)
        limits[at] = (floor + foreign[at]) / 2 if n >= FEW and foreign.get(at, floor) < floor else floor
    if not own:
        return np.zeros(LENGTHS)
    longest = max(own)
    limits[longest + 1 :] = limits[longest]
    limits = np.minimum.accumulate(limits[::-1])[::-1]
    shortest = min(own)
    limits[:shortest] = limits[shortest] * 0.9 ** (shortest - np.arange(shortest))
    return limits


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the language of each centroid, centroids as unit rows, the least cosine that each language accepts by
    length, IDF weights."""

    languages: list[str]
    of_centroid: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text; `und`, 0 and rejected without letters or without a model."""
        out = [("und", 0.0, True)] * len(texts)
        rows = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        for lo in range(0, len(rows), _ROWS):
            part = rows[lo : lo + _ROWS]
            weights = np.stack([term_weights(texts[i]) for i in part])
            cosines = _unit(weights * self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            limits = self.least[self.of_centroid[best], length_of(weights)]
            for i, b, c, limit in zip(part, best.tolist(), cosines[np.arange(len(part)), best].tolist(), limits.tolist()):
                out[i] = (self.languages[self.of_centroid[b]], min(1.0, max(0.0, c)), c < limit)
        return out


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means over unit rows from far-apart starts: (unit centroids, cluster of each row)."""
    starts = [int((vectors @ vectors.mean(axis=0)).argmax())]
    nearest = vectors @ vectors[starts[0]]
    while len(starts) < min(k, len(vectors)):
        starts.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[starts[-1]])
    centroids = vectors[starts]
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = _unit(sums)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is never learned from: the remainder by 4 of the CRC-32 of its identifier's digits is 2."""
    return F.coalesce(F.crc32(named(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows that are not held out and have an identifier, a label and a text with a letter.

    Document frequencies are counted over all of these; centroids are clustered, and limits measured, on at most
    `sample_per_language` texts of each language, chosen by a hash of the identifier. Without such rows the model knows no
    language.
    """
    find_package(docs.sparkSession)
    text, lang, doc = named(text_col).cast("string"), named(lang_col).cast("string"), named(id_col).cast("long")
    rows = docs.where(~held_out(id_col) & doc.isNotNull() & lang.isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.select(doc.alias("doc_id"), lang.alias("lang"), text.alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMS + 1, np.int64)  # the last entry counts texts
        for batch in batches:
            for value in batch.column(0):
                seen[:DIMS] += term_weights(value.as_py()) > 0
                seen[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(seen)], names=["at", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    n = np.zeros(DIMS + 1)
    for row in counted.collect():  # one row for each feature
        n[row["at"]] = row["n"]
    idf = (np.log((1 + n[DIMS]) / (1 + n[:DIMS])) + 1).astype(np.float32)

    order = F.xxhash64("doc_id", F.lit("language"))
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    share = F.least(F.lit(1.0), 1.5 * sample_per_language / F.col("total"))
    some = rows.join(F.broadcast(totals), "lang").where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    sample = some.withColumn("place", place).where(F.col("place") <= sample_per_language).select("lang", "text")

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        vectors = _unit(np.stack([term_weights(t) for t in group["text"]]) * idf)
        found, _ = cluster(vectors, CENTROIDS)
        blobs = [c.astype("<f4").tobytes() for c in found]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "number": range(len(found)), "centroid": blobs})

    sample = keep_table(sample, "language-sample")
    model = sample.groupBy("lang").applyInPandas(centroids, "lang string, number int, centroid binary")
    rows_of = sorted(model.collect(), key=lambda r: (r["lang"], r["number"]))  # a few rows for each language
    languages = sorted({r["lang"] for r in rows_of})
    of_centroid = np.array([languages.index(r["lang"]) for r in rows_of], np.int64)
    table = np.stack([np.frombuffer(r["centroid"], "<f4") for r in rows_of]) if rows_of else np.zeros((0, DIMS), np.float32)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                weights = term_weights(text)
                near = _unit((weights * idf)[None, :]) @ table.T
                best = np.full(len(languages), -1.0)
                np.maximum.at(best, of_centroid, near[0])
                columns = [np.arange(len(languages)), np.array(languages) == lang, np.full(len(languages), length_of(weights)), best]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["to", "own", "length", "cosine"])

    least = np.zeros((len(languages), LENGTHS))
    if languages:
        quantile = lambda q: F.percentile_approx("cosine", q, 10_000)
        spread = sample.mapInArrow(cosines, "to long, own boolean, length long, cosine double").groupBy("to", "own", "length")
        low, high = quantile(OWN_QUANTILE).alias("low"), quantile(FOREIGN_QUANTILE).alias("high")
        found = spread.agg(low, high, F.count(F.lit(1)).alias("n")).collect()  # a few dozen rows for each language
        for k in range(len(languages)):
            mine = [r for r in found if r["to"] == k]
            own = {r["length"]: (r["low"], r["n"]) for r in mine if r["own"]}
            least[k] = least_cosines(own, {r["length"]: r["high"] for r in mine if not r["own"]})
    return LanguageModel(languages, of_centroid, table, least, idf)


def classify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The input's columns with lang_pred, score (cosine, 0 to 1) and rejected, in place of columns of the same names.

    Only the text is an input of a prediction. lang_pred is a learned language even for rejected texts, and `und` (score
    0, rejected) for null and empty texts and texts without a letter. One row per input row; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1):
                found = shared.value.predict(batch.column(1).to_pylist())
                columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["row", "text", "lang_pred", "score", "rejected"])

    names = [f.name for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    rest = [named(n) for n in names if n != text_col] or [F.lit(None).cast("string").alias("none")]
    rows = docs.select(F.struct(*rest).alias("row"), named(text_col).cast("string").alias("text"))
    schema = rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    kept = [F.col("text").alias(n) if n == text_col else F.col("row").getField(n).alias(n) for n in names]
    return rows.mapInArrow(predict, nullable(schema)).select(*kept, "lang_pred", "score", "rejected")
