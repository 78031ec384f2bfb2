"""Folds composed over slices equal one fold over the key."""

import random

import pytest

from lanewise.operators import compose
from lanewise.operators import slices as S
from lanewise.operators.compose import composed_fold
from lanewise.operators.fold import fold
from lanewise.operators.machines import Gate, Plateau
from lanewise.plans.stateful import plateaus


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def one_fold(df, machine):
    return rows_of(fold(df.drop("slice"), ["entity_id"], ["seq", "event_id"], machine.new, machine.step, machine.schema, machine.finish))


@pytest.fixture(scope="module")
def levels(spark):
    """A hot entity that never pauses, one that is often absent, short ones, one row."""
    r, rows, i = random.Random(3), [], 0
    for e, n in ((1, 900), (2, 200), (3, 7), (4, 1)):
        at, level = 0, 0.0
        for _ in range(n):
            at += r.choice([1, 1, 2]) if e != 2 else r.choice([1, 3, 40])
            level = level if r.random() < 0.8 else float(r.choice([0, 10, 25, 60, 90]))
            rows.append((e, 0, at, i, level + r.choice([0, 0, 0, 50]) * (r.random() < 0.2), r.random() < 0.85))
            i += 1
    return spark.createDataFrame(rows, "entity_id long, part long, seq long, event_id long, level double, present boolean")


@pytest.mark.parametrize("rows", [11, 10_000])
@pytest.mark.parametrize("machine", [Plateau(20.0, 2, 3, 15), Plateau(5.0, 4, 8, 1000), Plateau(1000.0, 2, 3, 10_000)], ids=["quick", "slow", "never"])
def test_plateaus_over_slices(levels, rows, machine):
    seen = []
    df = S.row_slices(levels, rows, 4)
    got = rows_of(composed_fold(df, ["entity_id"], ["seq", "event_id"], machine, seen))
    assert got == one_fold(levels, machine) and len(got) == levels.count()
    if rows == 11:
        assert df.where("entity_id = 1").select("slice").distinct().count() >= 16
        if machine.close == 15:                                    # a machine that forgets runs most slices two or three times
            assert sum(seen) <= 3 * seen[0], seen
        assert len(seen) <= compose.ROUNDS + 1
    assert bool(seen) == (rows < 10_000)


@pytest.mark.parametrize("rows", [9, 60, 10_000])
def test_gate_over_slices(spark, rows):
    r = random.Random(5)
    data, at = [], 0
    for i in range(700):
        at += r.choice([0, 0, 1, 1, 1, 3])
        data.append((1 + (i >= 600), at, i, at // 2, r.uniform(0, 12), r.uniform(0, 12), float(r.randint(0, 4))))
    df = spark.createDataFrame(data, "entity_id long, seq long, event_id long, frame long, cx double, cy double, score double")
    sliced = S.row_slices(df, rows, 1)
    assert rows_of(composed_fold(sliced, ["entity_id"], ["seq", "event_id"], Gate(6.0))) == one_fold(df, Gate(6.0))


def test_large_ids_stay_whole(spark):
    """Heads of slices do not turn 64-bit ids into floats."""
    big = (1 << 62) + 1
    df = spark.createDataFrame([(1, 0, t, big + t, 1.0, True) for t in range(30)], "entity_id long, part long, seq long, event_id long, level double, present boolean")
    got = composed_fold(S.row_slices(df, 4, 1), ["entity_id"], ["seq", "event_id"], Plateau(1.0, 2, 3, 10)).collect()
    assert {r.event_id for r in got} == {big + t for t in range(30)} and {r.plateau for r in got} == {0}


def test_plateaus_do_not_depend_on_slices(spark, sf):
    assert rows_of(plateaus(spark, sf, 8)) == rows_of(plateaus(spark, sf))


def test_empty(spark, levels):
    assert composed_fold(S.row_slices(levels.where("false"), 5, 4), ["entity_id"], ["seq", "event_id"], Plateau(20.0, 2, 3, 15)).isEmpty()
