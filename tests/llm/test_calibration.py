"""Cuts are taken over all labelled rows, however many there are."""

import numpy as np

from textlab.llm import importance, quality_rules


def test_importance_cut_covers_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    good, bad = rng.normal(5, 2, 6000), rng.normal(-3, 2, 6000)
    rows = [(i, float(w)) for i, w in enumerate(np.r_[good, bad])]
    scored = spark.createDataFrame(rows, "doc_id long, log_weight double")
    labels = spark.createDataFrame([(i, int(i < 6000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    most = np.quantile(good, 1 - importance.KEEP_GOOD)
    assert np.isclose(importance.calibrate(scored, labels), (most + bad[bad < most].max()) / 2, rtol=0, atol=1e-12)
    assert importance.calibrate(scored, labels.where("quality = 1")) == float("-inf")


def test_quality_rules_cut_covers_all_good_rows(spark):
    good = np.random.default_rng(4).random(7000)
    scored = spark.createDataFrame([(i, float(s)) for i, s in enumerate(good)] + [(7000, 2.0), (None, 3.0)], "doc_id long, anomaly double")
    labels = spark.createDataFrame([(i, int(i < 7000), 0) for i in range(7001)], "doc_id long, quality int, toxic int")
    assert np.isclose(quality_rules.calibrate(scored, labels), np.quantile(good, quality_rules.KEEP_GOOD) + 1e-9, rtol=0, atol=1e-12)
