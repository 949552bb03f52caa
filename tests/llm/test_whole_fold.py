"""Toxicity learns from every row of the learning fold, on the posteriors alone; insults must be near each other."""

import numpy as np
from pyspark.sql import functions as F

from textlab.llm import toxicity


def test_label_model_and_classifier_see_all_rows(spark, monkeypatch):
    toxic, clean = "you are a worthless idiot", "the river runs past the mill"
    docs = [(i, f"{toxic if i % 10 == 0 else clean} {i}") for i in range(4000)] + [(None, clean), (4001, None)]
    labels = [(i, 1, int(i % 10 == 0)) for i in range(200)]
    seen = {}
    model, linear = toxicity.label_model, toxicity.logistic
    monkeypatch.setattr(toxicity, "label_model", lambda votes, *a, **k: seen.update(n=k["times"].sum(), q=model(votes, *a, **k)) or seen["q"])
    monkeypatch.setattr(toxicity, "logistic", lambda x, y, w, **k: seen.update(target=y, weight=w) or linear(x, y, w, **k))
    fold = F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True))
    toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fold)
    assert seen["n"] == seen["weight"].sum() == sum(d is None or d % 4 != 1 for d, _ in docs)
    assert np.array_equal(seen["target"], seen["q"][0])


def test_near_needs_closeness():
    near = len(toxicity.LEXICON) + 1
    votes = lambda t: toxicity.fixed_votes(t, toxicity.tokens_of(t))
    assert votes("an idiot and a moron")[near] == 1 and votes("idiot, idiot!")[near] == 1
    assert votes("an idiot " + "word " * 50 + "a moron")[near] == 0 and votes("an idiot")[near] == 0
