"""Hand-checked cases of the notation, score, flight and session rules."""

import json

import pytest
from pyspark.sql import functions as F

from lanewise.functions import notation as N
from lanewise.operators.machines import Gate, Plateau, Replay
from lanewise.operators.score import Count, Rules
from lanewise.presets import check_grammar


def one(spark, col, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(col.alias("v")).first()["v"]


def test_grammar():
    check_grammar()


@pytest.mark.parametrize("s,want", [("4b28f1f3n#", "s4 b2 f1 f3 n"), ("6*", "s6 *"), ("4h1n#", "s4 ?1 n"), ("c6s19f;3b3d#", "s? b1 f3 b3 d"), ("", "s? ?")])
def test_point_tokens(spark, s, want):
    assert " ".join(one(spark, N.point_tokens(F.col("p")), p=s)) == want


@pytest.mark.parametrize("s,want", [("s?f2?3?", "s? f2 ?3 ?"), ("s6*", "s6 *"), ("4h1n#", "s4 ?1 n"), ("s4b3f1w@", "s4 b3 f1 w")])
def test_draft_tokens(spark, s, want):
    assert " ".join(one(spark, N.draft_tokens(F.col("p")), p=s)) == want


@pytest.mark.parametrize("first,second,want", [
    ("6*", "", 1), ("4b2n#", "", 1), ("5b2f1*", "", 1), ("4f1*", "", 2), ("4b3f1w@", "", 2), ("6b2f3b2n@", "", 1),
    ("4d", "5b2f1*", 1), ("6w", "4d", 2), ("6w", "4g", 2), ("4b2f1?", "", None), ("4b2+f1*", "", 1)])
def test_winner(spark, first, second, want):
    assert one(spark, N.winner(F.col("f"), F.col("s")), f=first, s=second) == want


@pytest.mark.parametrize("first,second,want", [
    ("6b29f1f3*", "", []), ("4w", "5b2n@", []), ("6b2Z*", "", [("1st", 3, "unknown mark")]), ("62b1*", "", [("1st", 1, "digit follows no shot")]),
    ("b2f1*", "", [("1st", 0, "no serve digit at start")]), ("6b2f1", "", [("1st", 4, "no ending mark")]),
    ("6b2f1@", "", [("1st", 5, "error ending without an error letter")]), ("6b2f1*", "5b2n@", [("1st", -1, "first should be a fault")]), ("", "", [("1st", -1, "empty")])])
def test_violations(spark, first, second, want):
    df = spark.createDataFrame([(first, second)], "f string, s string")
    got = [tuple(r) for r in df.select(F.inline(N.violations(F.col("f"), "1st", F.col("s") != ""))).collect()]
    if second:
        got += [tuple(r) for r in df.select(F.inline(N.violations(F.col("s"), "2nd", F.lit(False)))).collect()]
    assert got == want


def brute(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
    return d[-1][-1]


def test_edit_distance_and_ops(spark):
    import random
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["é", "日本"]
    rows = [([rnd.choice(words[: rnd.choice((3, 402))]) for _ in range(rnd.randrange(25))], [rnd.choice(words[:5]) for _ in range(rnd.randrange(25))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    ops = N.edit_ops()
    for r in df.select("a", "b", N.edit_distance(F.col("a"), F.col("b")).alias("d"), ops("a", "b").alias("o")).collect():
        want = brute(r.a, r.b)
        assert r.d == want == sum(o[0] != "match" for o in r.o)
        assert [o[1] for o in r.o if o[0] != "ins"] == r.a and [o[2] for o in r.o if o[0] != "del"] == r.b


def play(rules, winners, c=None):
    """Contexts before the points, and the counters after them."""
    c, out = c or Count(), []
    for w in winners:
        out.append(rules.context(c))
        c = rules.after(c, w)
    return out, c


def test_score_opening_and_deuce():
    ctx, _ = play(Rules(), [1, 1, 2, 2, 1, 2, 2, 1, 1, 1, 1])
    assert [c[4] for c in ctx[:8]] == ["0-0", "15-0", "30-0", "30-15", "30-30", "40-30", "40-40", "40-AD"]
    assert ctx[10][:4] == (0, 0, 1, 0) and ctx[10][7] == 2


def to_six_all(rules):
    c = None
    for g in range(12):
        _, c = play(rules, [1 + g % 2] * 4, c)
    return c


def test_tiebreak_and_numbering():
    r, c = Rules(), to_six_all(Rules())
    assert r.context(c)[2:] == (6, 6, "0-0", 13, True, 1)
    ctx, c = play(r, [1, 2, 1, 2, 1, 2], c)
    assert [x[7] for x in ctx] == [1, 2, 2, 1, 1, 2]
    _, c = play(r, [1] * 4, c)
    assert c == Count(s1=1, game_no=14, opener=2) and r.server(c) == 2


def test_deciding_set_variants():
    adv = Rules(best_of=1, final_set="adv")
    c = to_six_all(adv)
    assert adv.context(c)[6] is False and adv.kind(c) == "game"
    tb10 = Rules(best_of=1, final_set="tb10")
    _, c = play(tb10, [1] * 9, to_six_all(tb10))
    assert not tb10.over(c)
    assert tb10.over(tb10.after(c, 1))


def test_replay_state_is_plain():
    m = Replay()
    st = m.new()
    for w in [1, 2, 2, 1, 1]:
        m.step(st, Row(entity_id=1, match=0, event_id=0, winner=w))
    assert Count(*json.loads(json.dumps(st))) == Count(p1=3, p2=2)


class Row:
    def __init__(self, **kw):
        self.__dict__.update(kw)


def labels(levels, present=None, seqs=None, **kw):
    m = Plateau(**{"change": 0.5, "confirm": 5, "settle": 8, "close": 15, **kw})
    st, out = m.new(), {}
    for i, v in enumerate(levels):
        for _, _, e, p in m.step(st, Row(entity_id=1, part=0, event_id=i, level=v, present=present[i] if present else True, seq=seqs[i] if seqs else i)):
            out[e] = p
    for _, _, e, p in m.finish(st):
        out[e] = p
    return [out[i] for i in range(len(levels))]


def test_plateau_rules():
    assert labels([1] * 10 + [2] * 3 + [1] * 3) == [0] * 16                       # flicker is absorbed
    assert labels([1] * 10 + [2] * 6) == [0] * 10 + [1] * 6                       # a confirmed change
    assert labels([1] * 10 + [2] * 3) == [0] * 10 + [-1] * 3                      # undecided at the end
    assert labels([1] * 10 + [9] + [1] * 9, present=[True] * 10 + [False] + [True] * 9, seqs=list(range(11)) + list(range(40, 49))) == [0] * 10 + [-1] + [1] * 9


def test_gate_rules():
    g, out = Gate(2.0), []
    st = g.new()
    rows = [(0, 0.0, 1.0), (1, 1.0, 1.0), (1, 0.5, 5.0), (2, 50.0, 9.0), (3, 50.0, 9.0), (5, 0.0, 1.0)]
    for i, (f, x, s) in enumerate(rows):
        out += g.step(st, Row(entity_id=1, event_id=i, frame=f, cx=x, cy=0.0, score=s))
    out += g.finish(st)
    assert [o[1] for o in out] == [0, 2, 4, 5]      # the far one resets the gate, then is taken
