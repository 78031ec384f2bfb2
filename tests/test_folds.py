"""Leave-one-group-out fits of all groups at once, and saved models."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lanewise.operators import folds as L
from lanewise.plans import triage
from lanewise.sources import models as M
from lanewise.sources.sinks import work_dir

FEATURES = triage.FEATURES


def table(spark, groups=6, rows=60, seed=1, label=None):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        for i in range(rows + 7 * g):
            x = r.normal(size=len(FEATURES)) * [1, 2, 0.1, 1, 3] + [0, 5, 1, g, 0]
            y = int(x[0] + 0.3 * x[4] + r.normal() > 0.2) if label is None else label(g)
            out.append((g, 1000 * g + i, y, *map(float, x)))
    return spark.createDataFrame(out, "group_id long, doc_id long, good int, " + ", ".join(f"{f} double" for f in FEATURES))


def test_each_model_is_the_fit_without_its_group(spark):
    df = table(spark).repartition(4).cache()
    got = L.leave_one_out(df, FEATURES, "good", triage.fold_stats(df))
    held = {(r.group_id, r.doc_id): r.p for r in L.held_out(df, FEATURES, got).collect()}
    trained = {(r.fold, r.doc_id): r.p for r in L.training(df, FEATURES, got, "doc_id").collect()}
    assert len(held) == df.count() and len(trained) == 5 * df.count()
    for st in triage.fold_stats(df).collect():
        g, s = st.group_id, st.asDict()
        tr = triage.scale(df.filter(F.col("group_id") != g), s)
        m = triage.fit(tr, s["n_train"])
        i = got.groups.tolist().index(g)
        assert np.allclose(got.weights[i], [m.intercept, *m.coefficients], atol=1e-5) and got.n_train[i] == s["n_train"] == tr.count()
        p = vector_to_array("probability")[1].alias("p")
        for r in m.transform(triage.scale(df.filter(F.col("group_id") == g), s)).select("doc_id", p).collect():
            assert abs(held[g, r.doc_id] - r.p) < 1e-5
        for r in m.transform(tr).select("doc_id", p).limit(50).collect():
            assert abs(trained[g, r.doc_id] - r.p) < 1e-5


def test_folds_of_one_class_and_few_rows(spark):
    df = table(spark, 3, 20, label=lambda g: int(g == 0))          # without group 0 all labels are 0
    m = L.leave_one_out(df, FEATURES, "good", triage.fold_stats(df))
    p = {r.group_id: r.p for r in L.held_out(df, FEATURES, m).groupBy("group_id").agg(F.max("p").alias("p")).collect()}
    assert p[0] < 1e-6 and np.isfinite(m.weights).all()
    one = df.where("group_id = 1")
    m = L.leave_one_out(one, FEATURES, "good", triage.fold_stats(one))
    assert m.n_train.tolist() == [0] and L.held_out(one, FEATURES, m).where("p <> 0.5").isEmpty()
    none = df.where("false")
    assert len(L.leave_one_out(none, FEATURES, "good", triage.fold_stats(none)).groups) == 0


def test_too_many_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_GROUPS", 2)
    df = table(spark, 3, 5)
    with pytest.raises(ValueError):
        L.leave_one_out(df, FEATURES, "good", triage.fold_stats(df))


def test_sources_are_the_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, models = triage.lomo(spark, sf)
    labelled = docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert out.select("group_id").distinct().count() == labelled.select("source").distinct().count() == models.count()
    assert out.count() == labelled.count()
    sizes = {r.group_id: r.n_train for r in models.collect()}
    own = {r.group_id: r["count"] for r in out.groupBy("group_id").count().collect()}
    assert all(sizes[g] == labelled.count() - own[g] for g in own)


def test_models_are_saved_in_versions(spark, sf):
    folder = work_dir(spark, "models")
    assert M.versions(spark, folder) == []
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, folder)
    assert M.save_model(spark, folder, triage.MODEL) == 1
    assert M.save_model(spark, folder, triage.MODEL | {"t_high": float("inf"), "intercept": 0.1}) == 2
    assert M.load_model(spark, folder, 1) == triage.MODEL and M.load_model(spark, folder)["t_high"] == float("inf")
    with pytest.raises(ValueError):
        M.save_model(spark, folder, {"features": []})
    with pytest.raises(FileNotFoundError):
        M.load_model(spark, folder, 7)
    a, b = triage.scored(spark, sf), triage.scored(spark, sf, M.load_model(spark, folder, 1))
    assert sorted(map(tuple, a.select("doc_id", "p", "high").collect())) == sorted(map(tuple, b.select("doc_id", "p", "high").collect()))
    assert triage.scored(spark, sf, M.load_model(spark, folder)).where("high").isEmpty()
