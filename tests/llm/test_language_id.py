from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from depvital.llm import language_id
from depvital.llm.common import read_table

from .conftest import AWKWARD


def test_held_out_accuracy_and_rejection(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en", "es", "fr"] and len(model.centroids) == 16
    rows = language_id.classify(docs.withColumn("held", language_id.held_out()), model).where("held").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)  # few texts tell the limits here
    strange = model.predict(["漢字 仮名 交じり文 です " * 20, "Съешь же ещё этих мягких булок " * 20, "1234 !!", "", None])
    assert [r for _, _, r in strange] == [True] * 5
    assert strange[2:] == [("und", 0.0, True)] * 3


@pytest.mark.parametrize("unseen", ["en", "es", "de", "fr"])
def test_an_unseen_language_is_rejected(spark, unseen):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    model = language_id.fit(docs.where(F.col("lang") != unseen))
    texts = docs.where("lang is not null and text is not null").withColumn("held", language_id.held_out())
    strange = [r.text for r in texts.where(F.col("lang") == unseen).limit(400).collect()]
    known = [r.text for r in texts.where((F.col("lang") != unseen) & F.col("held")).limit(800).collect()]
    rejected = [sum(r for _, _, r in model.predict(part)) / len(part) for part in (strange, known)]
    print(unseen, rejected)
    assert rejected[0] >= 0.9 and rejected[1] <= 0.005


def test_nearest_centroid_and_cosine_by_brute_force(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs)
    for r in language_id.classify(docs, model).collect():
        if r.lang_pred == "und":
            continue
        vector = language_id.term_weights(r.text).astype(float) * model.idf
        cosines = [float(vector @ c) / float(np.linalg.norm(vector) * np.linalg.norm(c)) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(r.score - cosines[best]) < 1e-5
        assert r.lang_pred == model.languages[model.of_centroid[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-5


def test_limits():
    own = {24: (0.1, 1), 20: (0.8, 500), 16: (0.5, 500), 12: (0.4, 9)}
    limits = language_id.least_cosines(own, {20: 0.6, 16: 0.55})
    assert np.isclose(limits[[20, 27]], (0.8 * 0.97 + 0.6) / 2).all() and np.isclose(limits[16], 0.5 * 0.97)
    assert np.isclose(limits[12], 0.4 * (1 - 0.5 / 3)) and (np.diff(limits) >= 0).all() and 0 < limits[0] < limits[11]
    assert not language_id.least_cosines({}, {}).any()


def test_awkward_rows(documents):
    docs = documents([*AWKWARD, *[(100 + i, "the cat and the dog " * 3, "en") for i in range(20)], *[(200 + i, "der hund und die katze " * 3, "de") for i in range(20)]])
    model = language_id.fit(docs, sample_per_language=5)
    rows = language_id.classify(docs, model)
    assert [c for c in rows.columns if c not in docs.columns] == ["lang_pred", "rejected"] and rows.columns.count("score") == 1
    found = rows.collect()
    assert len(found) == len(AWKWARD) + 40
    for r in found:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
        if r.doc_id and 200 <= r.doc_id:
            assert r.lang_pred == "de"


def test_without_labels(documents):
    docs = documents([(1, "some text"), (2, None)])
    model = language_id.fit(docs)
    assert [(r.lang_pred, r.score) for r in language_id.classify(docs, model).collect()] == [("und", 0.0)] * 2
    assert language_id.classify(documents([]), language_id.fit(documents([]))).collect() == []


def test_long_texts_are_counted_whole():
    span = language_id._SPAN
    whole = np.expm1(language_id.term_weights("ab " * span))
    assert abs(whole.sum() - sum(3 * span + 1 - n + 1 for n in language_id.GRAMS)) < 1e-3 * whole.sum()
