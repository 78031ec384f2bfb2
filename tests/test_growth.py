"""Work that must grow with the rows, not with their keys, their lengths or the number of readers."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.functions import notation as N
from lanewise.functions.pairing import edit_distances, edit_script, edit_scripts
from lanewise.operators.quantiles import quantiles
from lanewise.plans import QUERIES, grading


def test_far_points_are_resolved(spark, tmp_path):
    """Points of a match may lie any distance apart: no run is cut into stretches of its span."""
    far = 40_000_000_000_004                       # 2.4e9 stretches of 2**14 from the first one
    rows = [(4, 1, "F", 3.0, "1-URGENT"), (far, 1, "F", 3.0, "1-URGENT")]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.clip: (r.pt, r.status) for r in QUERIES["order_resolve"](spark, str(tmp_path)).collect()}
    assert far % 7 and got == {4: (4, "order-resolved"), far: (far, "order-resolved")}


def test_batches_align_as_single_pairs():
    """Short lists side by side, long ones alone, null tokens and null lists: distances and scripts of each pair alone."""
    rnd = random.Random(5)
    some = lambda: [f"w{rnd.randrange(rnd.choice((2, 40)))}" for _ in range(rnd.randrange(rnd.choice((1, 5, 34, 80))))]
    rows = [(some(), some()) for _ in range(400)]
    a, b = (pa.array(c, pa.list_(pa.string())) for c in zip(*rows))
    want = [edit_script(x, y) for x, y in rows]
    assert edit_scripts(a, b).to_pylist() == want
    assert edit_distances(a, b).tolist() == [sum(o[0] != "match" for o in w) for w in want]
    assert edit_distances(a[7:90], b[7:90]).tolist() == edit_distances(a, b).tolist()[7:90]
    odd = pa.array([None, ["a", None, "b"], []], a.type), pa.array([["a"], ["a", "b"], [None]], a.type)
    assert edit_distances(*odd).tolist() == [None, 0, 0]


def test_long_turns_are_quick():
    """A pair of long word lists takes bits, not a walk of cells with a dictionary lookup each."""
    a, b = [f"w{i % 97}" for i in range(6000)], [f"w{i % 89}" for i in range(6000)]
    t = time.time()
    d = edit_distances(*(pa.array([x], pa.list_(pa.string())) for x in (a, b)))
    assert 0 < d[0] < 6000 and time.time() - t < 5


def test_draft_is_computed_once(spark):
    """However often the tokens of a draft name it, its expression stands in the plan a few times at most."""
    df = spark.createDataFrame([("4f1*",)], "p string").select(N.draft_tokens(F.translate("p", "f", "b")).alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(p#") == 1 and df.first().t == ["s4", "b1", "*"]


@pytest.mark.parametrize("name", ["edit_decomposition", "ratio_quartiles", "accuracy_vs_truth"])
def test_points_are_graded_once(spark, sf, monkeypatch, name):
    calls, real = [], grading.graded
    monkeypatch.setattr(grading, "graded", lambda *a: calls.append(1) or real(*a))
    assert QUERIES[name](spark, sf).count() and len(calls) == 1


def test_quantiles_with_weights(spark):
    rows = [(g, float(v % 7), 1 + (v * g) % 5) for g in (1, 2) for v in range(40)]
    df = spark.createDataFrame(rows, "g int, v double, k int")
    plain = df.selectExpr("g", "v", "explode(sequence(1, k)) AS i")
    probs = {"a": .25, "b": .5}
    assert quantiles(df, ["g"], "v", probs, weight="k").orderBy("g").collect() == quantiles(plain, ["g"], "v", probs).orderBy("g").collect()


def test_conflicts_are_looked_up():
    """one row a match, with what the rules say point by point, however batches cut a match."""
    from lanewise.operators.score import Count, Rules
    from lanewise.plans.stateful import count_conflicts
    rnd, rules, rows, want = random.Random(4), Rules(), [], []
    for match in range(5):
        c, told = Count(), [0, 0, 0]
        for _ in range(rnd.choice((1, 40, 400))):
            w, rel, unseen = rnd.randrange(3), rnd.randrange(3), rnd.random() < .1
            rows.append((match, w, unseen, rel))
            derived = 0 if rel == 0 else rules.server(c) if rel == 1 else 3 - rules.server(c)
            told = [told[0] + 1, told[1] + bool(w and derived and derived != w and not unseen), told[2] + (not (w or derived))]
            c = rules.after(c, w or derived) if w or derived else c
        want.append((match, *told))
    parts = [rows[i:i + 7] for i in range(0, len(rows), 7)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*p)], ["match_id", "attested", "unseen", "rel"]) for p in parts]
    assert [tuple(r.values()) for b in count_conflicts(batches) for r in b.to_pylist()] == want
