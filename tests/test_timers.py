"""Streams in event time: rows out of order, rows too late, keys closed by their timers."""

import random

import pytest

from lanewise.operators.machines import Plateau
from lanewise.operators.slices import row_slices
from lanewise.plans.stateful import active, timed_active, total_active
from lanewise.presets import HOUR
from lanewise.streaming.timers import drain, ending, timed_fold

SCHEMA = "entity_id long, seq long, event_id long, kind string, row_ long"


def stream(spark, tmp_path, batches, schema=SCHEMA):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_active_time_out_of_order(spark, tmp_path):
    """Five micro-batches whose rows overlap by less than the delay give what the batch query gives."""
    r, rows = random.Random(1), []
    for e in range(4):
        at = HOUR
        for i in range(80):
            at += r.choice([HOUR, 5 * HOUR, 30 * HOUR, 200 * HOUR])
            rows.append((e, at, 1000 * e + i, r.choice(["signup", "signup", "purchase", "view", "click", "error"]), r.randrange(3)))
    rows.sort(key=lambda x: x[1] + r.randrange(20 * HOUR))
    cut = [rows[i:i + 64] for i in range(0, len(rows), 64)]
    df, end = ending(spark, stream(spark, tmp_path, cut), ["entity_id"], "seq")
    got = total_active(drain(timed_active(df), "active-test", end))
    want = active(row_slices(spark.createDataFrame(rows, SCHEMA), 25, HOUR))
    cols = ["entity_id", "row_", "active_ms", "holes", "hole_ms"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    """A row that arrives behind the watermark counts for nothing; one within the delay does."""
    t = lambda h: (1000 + h) * HOUR
    first = [(1, t(0), 1, "signup", 7), (2, t(100), 2, "view", 0)]
    second = [(2, t(101), 5, "view", 0)]
    third = [(1, t(90), 3, "purchase", 7), (1, t(2), 4, "purchase", 7), (2, t(102), 6, "view", 0)]
    df, end = ending(spark, stream(spark, tmp_path, [first, second, third]), ["entity_id"], "seq")
    got = total_active(drain(timed_active(df), "late-test", end))
    # without the late purchase at 2 h the row stays open until 90 h, a hole
    assert [tuple(r) for r in got.select("entity_id", "row_", "active_ms", "holes", "hole_ms").collect()] == [(1, 7, 0, 1, 90 * HOUR)]


@pytest.mark.parametrize("later", [True, False])
def test_a_silent_key_is_closed(spark, tmp_path, later):
    """Rows in doubt come out once the watermark has passed the timer, though only another key goes on and no tick ends the stream."""
    schema = "entity_id long, seq long, event_id long, level double, present boolean, part long"
    rows = [(1, 1000 + i, i, 50.0 if i == 9 else 10.0, True, 0) for i in range(10)]
    batches = [rows, [(2, 1500 if later else 1040, 100, 1.0, True, 0)], [(2, 2000 if later else 1041, 101, 1.0, True, 0)]]
    df = stream(spark, tmp_path, batches, schema).select("entity_id", "part", "seq", "event_id", "level", "present")
    out = timed_fold(df, ["entity_id", "part"], ["seq", "event_id"], Plateau(20.0, 2, 3, 100), "seq", "10 milliseconds", 100)
    got = {r.event_id: r.plateau for r in drain(out, "close-test").where("entity_id = 1").collect()}
    assert got == {i: 0 for i in range(9)} | ({9: -1} if later else {})
