"""Neighbourhoods in Arrow batches: slices and stretches of rows, however short, give what one slice gives; rows are sorted once."""

import pytest
from pyspark.sql import functions as F

from lanewise.operators import signal as G
from lanewise.operators import stencil
from lanewise.plans import QUERIES
from lanewise.sources import tables
from lanewise.sources.tables import sliced_track


@pytest.fixture(scope="module")
def hot(spark, sf, tmp_path_factory):
    """A third of all rows are one entity's; some values are null."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    ev = ev.withColumn("user_id", F.expr("CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id % 9 END")).withColumn("value", F.expr("CASE WHEN event_id % 41 = 5 THEN NULL ELSE value END"))
    out = str(tmp_path_factory.mktemp("stencil"))
    ev.coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same_in_short_stretches(spark, hot, name, monkeypatch):
    want = rows(QUERIES[name](spark, hot))
    monkeypatch.setattr(tables, "SLICE_ROWS", 17)
    monkeypatch.setattr(stencil, "STRETCH", 23)
    assert want and rows(QUERIES[name](spark, hot)) == want


def test_launch_assign(spark, hot, monkeypatch):
    """slices of entities that fit one take no join of all rows, crossings no lists of neighbours."""
    reads = plan(G.classified_cusps(sliced_track(spark, hot).select(*G.ID, "y", "cy"), 6.0, 1.2, 50.0)).count("Relation [")
    assert reads <= 3, reads
    same_in_short_stretches(spark, hot, "launch_assign", monkeypatch)


def test_last_per_segment(spark, hot, monkeypatch):
    """F5"""
    assert plan(G.collapses(sliced_track(spark, hot).select(*G.ID, "cy"))).count("Relation [") <= 3
    same_in_short_stretches(spark, hot, "last_per_segment", monkeypatch)


def test_peak_pick_mad(spark, hot, monkeypatch):
    """scores, neighbours and ranks come from one pass."""
    same_in_short_stretches(spark, hot, "peak_pick_mad", monkeypatch)
    assert plan(G.peaks(sliced_track(spark, hot), "y", 9, 3.0)).count("Relation [") == 0                # ranks are fixed from the written peaks


def test_segment_split_merge(spark, hot, monkeypatch):
    """runs that a stretch of rows cuts are one run."""
    same_in_short_stretches(spark, hot, "segment_split_merge", monkeypatch)


def test_serve_call(spark, hot, monkeypatch):
    """first starts, settled windows and tosses of entities of one and of many slices."""
    from lanewise.plans import sequences
    t = sequences.launches(spark, hot)
    assert "collect_list" not in plan(t) and t.count()
    same_in_short_stretches(spark, hot, "serve_call", monkeypatch)
