"""Helpers against plain windows and brute force; narrow slices and hot entities included."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lanewise.operators import signal as G
from lanewise.operators import slices as S
from lanewise.operators.machines import Replay
from lanewise.operators.quantiles import quantiles
from lanewise.operators.score import Count, Rules
from lanewise.functions.pairing import common_pairs
from lanewise.plans.signals import separate_peaks
from lanewise.plans.stateful import LEVELS, plateaus, replay
from lanewise.presets import TRACK
from lanewise.sources import readers, sinks
from lanewise.streaming.state import events_stream, run_available, stream_fold

WIDTH = 50


@pytest.fixture(scope="module")
def hot(spark):
    """Three entities; the first owns most rows and has long silences."""
    rnd, rows, eid = random.Random(5), [], 0
    for ent, n in ((1, 400), (2, 60), (3, 1)):
        t = 0
        for _ in range(n):
            t += rnd.choice([1, 2, 3, 7, 20, 180])
            rows.append((ent, ent % 2, t, eid, float(rnd.randrange(100)), rnd.choice("abc")))
            eid += 1
    df = spark.createDataFrame(rows, "entity_id long, group_id long, seq long, event_id long, y double, kind string")
    return df.cache()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def plain():
    return Window.partitionBy("entity_id").orderBy("seq", "event_id")


def test_adjacent(hot):
    a = S.adjacent(S.add_slice(hot, WIDTH), ["y"]).select("event_id", "prev.y", "next.y")
    same(a, hot.select("event_id", F.lag("y").over(plain()), F.lead("y").over(plain())))


@pytest.mark.parametrize("k", [1, 4, 9])
def test_context(hot, k):
    a = S.context(S.add_slice(hot, WIDTH), ["y"], k).select("event_id", "before.y", "after.y")
    y = F.collect_list("y")
    same(a, hot.select("event_id", y.over(plain().rowsBetween(-k, -1)), y.over(plain().rowsBetween(1, k))))


def test_running_sum_and_carry(hot):
    d = S.running_sum(S.add_slice(hot, WIDTH), {"c": F.col("y")})
    v = F.when(F.col("kind") == "a", F.col("y"))
    for forward in (True, False):
        for inclusive in (True, False):
            d2 = S.carry(d.select("entity_id", "seq", "event_id", "slice", "y", "kind", "c"), {"v": v}, forward, inclusive)
            rows = plain().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1) if forward else plain().rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
            want = (F.last if forward else F.first)(v, True).over(rows)
            same(d2.select("event_id", "c", "v"), hot.select("event_id", F.sum("y").over(plain().rowsBetween(Window.unboundedPreceding, 0)), want))


def test_spread(hot):
    w = Window.partitionBy("entity_id").orderBy("seq").rangeBetween(-30, 30)
    d = S.spread(hot, 30, WIDTH)
    got = d.withColumn("n", F.count("*").over(Window.partitionBy("entity_id", "slice").orderBy("seq").rangeBetween(-30, 30))).filter("own")
    same(got.select("event_id", "n"), hot.select("event_id", F.count("*").over(w)))


def test_bucket_join(hot):
    a, b = hot.filter("kind = 'a'"), hot.filter("kind = 'b'")
    near = F.abs(F.col("l.seq") - F.col("r.seq")) <= 12
    j = S.bucket_join(a, b, ["entity_id"], "seq", F.col("seq") - 12, F.col("seq") + 12, 12, near)
    want = a.alias("l").join(b.alias("r"), (F.col("l.entity_id") == F.col("r.entity_id")) & near)
    pick = lambda d: d.select(F.col("l.event_id"), F.col("r.event_id").alias("o"))
    same(pick(j), pick(want))
    anti = S.bucket_join(a, b, ["entity_id"], "seq", F.col("seq") - 12, F.col("seq") + 12, 12, near, "left_anti")
    same(anti.select("event_id"), a.select("event_id").join(pick(want).select("event_id"), "event_id", "left_anti"))


def test_quantiles(hot):
    got = {r.entity_id: r for r in quantiles(hot, ["entity_id"], "y", {"a": .25, "b": .5, "c": .75}, 7.0).collect()}
    for e in (1, 2, 3):
        ys = [r.y for r in hot.filter(F.col("entity_id") == e).collect()]
        assert np.allclose([got[e].a, got[e].b, got[e].c], np.percentile(ys, [25, 50, 75])) and got[e].n == len(ys)


def test_suppress(spark, hot):
    cand = hot.select("entity_id", "seq", "event_id", F.col("y").alias("strength"))
    got = {r.event_id for r in G.suppress(cand, 9, TRACK).collect()}
    want = set()
    rows = cand.collect()
    for e in (1, 2, 3):
        kept = []
        for r in sorted((r for r in rows if r.entity_id == e), key=lambda r: (-r.strength, r.seq, r.event_id)):
            if all(abs(r.seq - k.seq) >= 9 for k in kept):
                kept.append(r)
        want |= {k.event_id for k in kept}
    assert got == want


def test_separate_peaks(hot):
    rows = S.running_sum(S.add_slice(hot, WIDTH), {"rank": F.lit(1)}).filter("y > 60").withColumn("z", F.col("y"))
    got = {r.event_id for r in separate_peaks(rows, 3).collect()}
    want, data = set(), rows.orderBy("entity_id", "rank").collect()
    for e in (1, 2, 3):
        kept = []
        for r in (r for r in data if r.entity_id == e):
            if kept and r["rank"] - kept[-1]["rank"] < 3:
                if r.z > kept[-1].z:
                    kept[-1] = r
            else:
                kept.append(r)
        want |= {k.event_id for k in kept}
    assert got == want


def test_gradient_matches_numpy(hot):
    d = G.gradient(S.add_slice(hot, WIDTH), "y", "v", 1)
    got = [r.v for r in d.filter("entity_id = 1").orderBy("seq").collect()]
    rows = hot.filter("entity_id = 1").orderBy("seq").collect()
    assert np.allclose(got, np.gradient([r.y for r in rows], [float(r.seq) for r in rows]))


def test_lcs():
    rnd = random.Random(2)
    for _ in range(50):
        a, b = ([rnd.randrange(3) for _ in range(rnd.randrange(9))] for _ in range(2))
        pairs = common_pairs(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert pairs == sorted(pairs) and len({p[0] for p in pairs}) == len({p[1] for p in pairs}) == len(pairs)


def test_replay_fold(spark):
    rnd = random.Random(1)
    rows = [(e, 0, i, e * 1000 + i, rnd.randrange(1, 3)) for e in (1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "entity_id long, match long, seq long, event_id long, winner int")
    got = {r.event_id: tuple(r)[3:] for r in replay(df).collect()}
    for e in (1, 2):
        c = Count()
        for r in (r for r in rows if r[0] == e):
            assert got[r[3]] == Rules().context(c)
            c = Rules().after(c, r[4])


def test_order_resolve_brute(spark, sf):
    from lanewise.plans.alignment import key_join, order_resolve, truth_keys
    points = {}
    for r in truth_keys(spark, sf).collect():
        points.setdefault(r.key, []).append(r.pt)
    by_match = {}
    for r in key_join(spark, sf).collect():
        by_match.setdefault(r.match_id, []).append(r)
    want = {}
    for rows in by_match.values():
        rows.sort(key=lambda r: r.clip)
        done = [r.first_pt if r.status == "matched" else None for r in rows]
        for i, r in enumerate(rows):
            if r.status != "ambiguous":
                continue
            lo = next((d for d in reversed(done[:i]) if d is not None), -1)
            hi = next((rows[j].first_pt for j in range(i + 1, len(rows)) if rows[j].status == "matched"), 10 ** 12)
            fit = [p for p in sorted(points[r.key]) if lo < p < hi]
            if fit:
                done[i] = fit[0]
            want[r.clip] = fit[0] if fit else -1
    assert {r.clip: r.pt for r in order_resolve(spark, sf).collect()} == want


def test_plateau_stream_equals_batch(spark, sf):
    from lanewise.plans.stateful import plateau_online
    batch = {r.event_id: r.plateau for r in plateaus(spark, sf).collect()}
    stream = {r.event_id: r.plateau for r in plateau_online(spark, sf).collect()}
    assert stream == batch and len(stream) == 1000


def test_replay_stream_over_batches(spark, tmp_path):
    """Two micro-batches: the state carries over and equals the batch fold."""
    rows = [(e, 0, i, e * 1000 + i, 1 + (i * i + e) % 2) for e in (1, 2) for i in range(60)]
    schema = "entity_id long, match long, seq long, event_id long, winner int"
    df = spark.createDataFrame(rows, schema)
    for i, cond in enumerate(("seq < 25", "seq >= 25")):
        df.filter(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{i}"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run_available(stream_fold(src, ["entity_id", "match"], ["seq"], Replay()), "replay-test")
    same(got, replay(df))


def test_unknown_tokens_count(spark):
    from lanewise.functions import notation as N
    row = spark.createDataFrame([(["AF", "ZZ", "AO", "YY"], ["AF", "AO", "XX"])], "a array<string>, b array<string>")
    assert row.select(N.small_edit_distance(F.col("a"), F.col("b"), ["AF", "AO"]).alias("d")).first().d == 2


def test_fingerprint_sees_where_nulls_are(spark):
    one, two = (spark.createDataFrame([r], "a int, b int") for r in ((None, 1), (1, None)))
    assert sinks.fingerprint(one).first() != sinks.fingerprint(two).first()


def test_fingerprint_keeps_cells_apart(spark):
    for x, y in ((("a|=b", "c"), ("a", "b|=c")), (("a|1=b", "c"), ("a", "b|1=c")), (("~", None), (None, "~")), (("", "1="), ("1=", ""))):
        one, two = (spark.createDataFrame([r], "a string, b string") for r in (x, y))
        assert sinks.fingerprint(one).first() != sinks.fingerprint(two).first()


def test_write_errors_are_not_refusals(spark, tmp_path):
    from pyspark.errors import AnalysisException
    with pytest.raises(AnalysisException):
        sinks.write_new(spark.range(1).selectExpr("id AS a", "id AS a"), str(tmp_path / "x"))


def test_deviation_of_large_means(spark):
    from lanewise.plans import triage
    rows = [(i % 3, *[1e9 + (i * (k + 1)) % 7 for k in range(len(triage.FEATURES))]) for i in range(60)]
    got = {r.group_id: r for r in triage.fold_stats(spark.createDataFrame(rows, ["group_id", *triage.FEATURES])).collect()}
    for g, r in got.items():
        for k, f in enumerate(triage.FEATURES):
            others = np.array([row[k + 1] for row in rows if row[0] != g])
            assert np.isclose(r[f"mu_{f}"] - 1e9, others.mean() - 1e9) and np.isclose(r[f"sd_{f}"], others.std())


def test_windowed_stream_equals_batch(spark, sf):
    ev = events_stream(spark, sf, "events*.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    agg = ev.groupBy("user_id", F.window("ts", "8 hours").alias("w")).agg(F.count("*").alias("n"))
    done = run_available(agg, "windows-test")
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "8 hours").alias("w")).agg(F.count("*").alias("n"))
    assert 0 < done.count() <= batch.count() and done.exceptAll(batch).count() == 0      # closed windows only, all equal


def test_levels_are_serialisable():
    import json
    assert json.loads(json.dumps(LEVELS.new())) == LEVELS.new()


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    p = str(tmp_path / "t")
    assert [sinks.write_new(df, p, dry_run=True), sinks.write_new(df, p), sinks.write_new(df, p), sinks.write_new(df, p, force=True)] == ["would write", "written", "refused", "written"]
    frozen = tuple(sinks.fingerprint(df).first())
    sinks.assert_unchanged(df.orderBy(F.desc("id")), frozen)
    with pytest.raises(ValueError):
        sinks.assert_unchanged(df.withColumn("v", F.when(F.col("id") == 3, 0).otherwise(F.col("v"))), frozen)


def test_tolerant_json(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"k": 1}\n\n{"k": 2}\n{"k": \n')
    rows = readers.read_json_lines(spark, str(p), "k LONG").collect()
    assert sorted(r.j.k for r in rows if not r.bad) == [1, 2] and sum(r.bad for r in rows) == 1


def test_two_shapes(spark):
    with pytest.raises(ValueError):
        readers.read_points(spark.range(1))
    s = spark.createDataFrame([("a", 3.5, 9.1), ("b", None, None), ("c", 0.0, 0.0), ("d", 9.0, 3.0)], "first string, start_s double, end_s double")
    assert [r.first for r in readers.read_points(s).filter("start_s IS NOT NULL").collect()] == ["a"]


def test_launch_assignment_brute(spark):
    """Every launch, and every crossing without one, is what the rule says given the launches before it."""
    from lanewise.plans.sequences import BACK, FWD, assign_launches
    from lanewise.presets import HOUR
    rnd, cross, cand, eid = random.Random(7), [], [], 0
    for ent in (1, 2):
        t = 0
        for _ in range(40):
            t += rnd.choice([1, 3, 9, 40]) * HOUR
            cross.append((ent, t, t + HOUR))
            for _ in range(rnd.randrange(3)):
                cand.append((ent, t + rnd.randrange(-14, 10) * HOUR + eid, eid, rnd.choice(["hit", "bounce"])))
                eid += 1
    got = sorted((r.entity_id, r.start_seq, r.seq, r.signal) for r in assign_launches(
        spark.createDataFrame(cross, "entity_id long, start_seq long, end_seq long"), spark.createDataFrame(cand, "entity_id long, seq long, event_id long, cls string")).collect())
    given = {(e, a): (at, kind) for e, a, at, kind in got}
    assert len(given) == len(got) and set(given) <= {(e, a) for e, a, _ in cross}
    for ent, a, _ in cross:
        free = max((at for (e, b), (at, _) in given.items() if e == ent and b < a), default=-10**18) + TRACK.min_gap
        choice = [(cls != "hit", abs(t - a), t) for e, t, _, cls in cand if e == ent and t >= free and -BACK <= t - a <= FWD]
        nothing = (a, "crossing") if a >= free else None
        assert given.get((ent, a)) == ((min(choice)[2], "cusp") if choice else nothing)
