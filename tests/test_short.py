"""Entities of few rows are one slice: nothing is carried between slices, and tracks are looked through once."""

import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import signal as G
from lanewise.operators import slices as S
from lanewise.operators import stencil
from lanewise.plans import QUERIES, sequences, signals
from lanewise.presets import TRACK
from lanewise.sources.tables import sliced_track
from test_stencil import hot, plan, rows, same_in_short_stretches  # noqa: F401


@pytest.fixture
def passes(monkeypatch):
    calls, real = [], stencil._answers
    monkeypatch.setattr(stencil, "_answers", lambda *a: calls.append(1) or real(*a))
    return calls


def test_detect_events(spark, hot, passes, monkeypatch):  # noqa: F811
    """crossings, cusps and collapses come from one pass; entities of many slices give the same events."""
    assert QUERIES["detect_events"](spark, hot).count() and len(passes) == 1
    same_in_short_stretches(spark, hot, "detect_events", monkeypatch)


def test_suppressed_whole(spark):
    """short entities are suppressed without rounds; equal strengths, equal times and NaN as in rounds."""
    rnd = random.Random(7)
    data = [(e, rnd.randrange(4000), i, rnd.choice((1.0, 2.0, 2.5, float("nan"), -0.0, 0.0, rnd.random()))) for e in range(9) for i in range(1 + e * 40)]
    df = spark.createDataFrame(data, "entity_id long, seq long, event_id long, strength double")
    some = lambda d: rows(d.select("entity_id", "seq", "event_id", "strength"))
    in_rounds, whole = [], []
    want = some(G.suppress(df, 50, TRACK, in_rounds))
    assert some(G.suppress(df.withMetadata("entity_id", S.ONE), 50, TRACK, whole)) == want and in_rounds and not whole
    none = df.where("false").withMetadata("entity_id", S.ONE)
    assert G.suppress(none, 50, TRACK).isEmpty()


def test_last_per_segment(spark, sf, passes):
    """candidates and bounds come from one pass; carried without a join of slices."""
    df = QUERIES["last_per_segment"](spark, sf)
    assert len(passes) == 1 and "Join" not in plan(df) and df.count()


def test_segment_split_merge(spark, sf, monkeypatch):
    """plateaus name the times of their rows themselves; no row is joined with the track, no slice with a neighbour."""
    plans, real = [], signals.in_segments
    monkeypatch.setattr(signals, "in_segments", lambda a, b: plans.append(plan(a) + plan(real(a, b))) or real(a, b))
    assert QUERIES["segment_split_merge"](spark, sf).count() and "Join" not in plans[0]


def test_peak_clusters(spark, sf):
    """peaks carry their clusters; a peak without another is in no fold."""
    df = sliced_track(spark, sf)
    peaks = G.peaks(df, "y", 9, 1.0, 3)
    named = S.islands(S.adjacent(peaks, ["rank"]), F.coalesce(F.col("rank") - F.col("prev.rank") >= 3, F.lit(False)), "n").select("entity_id", "cluster", "n", "lone").collect()
    assert len({(r.entity_id, r.cluster) for r in named}) == len({(r.entity_id, r.n) for r in named}) == len({(r.entity_id, r.cluster, r.n) for r in named})
    size = {}
    for r in named:
        size[r.entity_id, r.n] = size.get((r.entity_id, r.n), 0) + 1
    assert {r.lone for r in named} == {True, False} and all(r.lone == (size[r.entity_id, r.n] == 1) for r in named)


def test_point_signals(spark, sf, monkeypatch):
    """the ladder of hits is built once."""
    calls, real = [], sequences.ladder
    monkeypatch.setattr(sequences, "ladder", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert QUERIES["point_signals"](spark, sf).count() and len(calls) == 1


def test_carry_backwards_is_linear(spark):
    """the next value is carried in reverse order; no frame runs on to the end of an entity for every row."""
    df = spark.range(60000).select(F.lit(1).cast("long").alias("entity_id"), F.lit(0).cast("long").alias("slice"), F.col("id").alias("seq"), F.col("id").alias("event_id"))
    for inclusive in (True, False):
        out = S.carry(df, {"next": F.when(F.col("seq") % 7 == 3, F.col("seq"))}, False, inclusive)
        assert "currentrow$(), unboundedfollowing" not in plan(out) and "(RowFrame, 1, unboundedfollowing" not in plan(out)
        at = F.col("seq") + (0 if inclusive else 1)
        want = at + F.pmod(3 - at, F.lit(7))
        wrong = out.where(~F.col("next").eqNullSafe(F.when(want < 60000, want)))
        assert wrong.isEmpty()
