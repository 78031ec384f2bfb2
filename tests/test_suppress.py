"""Suppression by rounds equals the greedy rule: strongest first, nothing kept within the gap of something kept."""

import random

import pytest

from lanewise.operators import signal as G
from lanewise.presets import TRACK


def greedy(rows, gap):
    kept = []
    for e, t, i, s in sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2])):
        if all(k[0] != e or abs(k[1] - t) >= gap for k in kept):
            kept.append((e, t, i, s))
    return sorted(kept)


def dense(seed, n, ties):
    r, at, rows = random.Random(seed), -50, []
    for i in range(n):
        at += r.choice([0, 1, 1, 2])
        rows.append((1 if i < 0.8 * n else i % 5, at, i, float(r.randint(0, 6)) if ties else r.random()))
    return rows


CASES = {"dense": dense(1, 1200, False), "ties": dense(2, 1200, True),
         "ramp": [(1, 3 * i, i, float(i)) for i in range(600)] + [(2, 3 * i, 1000 + i, float(-i)) for i in range(40)],
         "one place": [(1, 5, i, float(i % 7)) for i in range(50)], "one row": [(1, 0, 0, 1.0)], "none": []}


@pytest.mark.parametrize("case,gap", [*[(c, 10) for c in CASES], ("dense", 1)])
def test_rounds_equal_greedy(spark, case, gap):
    seen, rows = [], CASES[case]
    df = spark.createDataFrame(rows, "entity_id long, seq long, event_id long, strength double")
    got = sorted(map(tuple, G.suppress(df, gap, TRACK, seen).collect()))
    assert got == greedy(rows, gap)
    assert seen == sorted(seen, reverse=True) and len(seen) <= G.SUPPRESS_ROUNDS
    if case in ("dense", "ties"):
        assert len(seen) < G.SUPPRESS_ROUNDS, seen                 # a dense track is done without the fold
    if case == "ramp" and gap == 10:
        assert len(seen) == G.SUPPRESS_ROUNDS                      # and a long ramp goes on with it
