"""Longer per-entity sequence queries: flights, endings, launches, composites."""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import count_if, r6
from ..operators import signal as G
from ..operators import slices as S
from ..operators.fold import fold
from ..operators.stencil import pair, whole
from ..presets import (CENTER_X, COURT_L, DAY, FLIP_COST, FLIP_SLOTS, HOUR, LADDER_QUALITY, NET_Y, SIDE_L, SIDE_R, TRACK, VOTE_LANDING,
                       VOTE_SERVE, VOTE_TOUCH)
from ..session import cut_lineage
from ..sources.tables import TRACK_SQL, sliced_track, table, track, written_track
from .aggregates import ladder, quality
from .registry import query
from .registry import r6 as q6
from .signals import (CUSP_SQL, FAR_SWING, FAR_Y, NEAR_SWING, W_SQL, chains, cusp_rows, first_seen, is_hit, last_in_segment, settled, toss)

P = TRACK
FLIGHT_CAP, FLIGHT_HOLE, TELEPORT = 80 * HOUR, DAY, 1.0      # ms, ms, metres per frame
TAIL_K, EXTRAP, BOTH_WIN, OUT = 8, 21.0, 2.0, 0.25           # samples, frames, frames, metres

TAIL_SQL = f"""lc AS (SELECT entity_id, max((seq, event_id)) AS c FROM t WHERE kind = 'purchase' GROUP BY 1),
  ta AS (SELECT t.*, seq - lag(seq) OVER w AS g, sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)) AS st FROM t JOIN lc USING (entity_id) WHERE seq > c[1] AND seq <= c[1] + {FLIGHT_CAP} {W_SQL.replace('entity_id', 't.entity_id')}),
  tl AS (SELECT * FROM (SELECT *, max(CASE WHEN g > {FLIGHT_HOLE} OR st / (g / {P.frame}::DOUBLE) > {TELEPORT} THEN 1 ELSE 0 END) OVER w AS bad FROM ta {W_SQL}) WHERE bad = 0)"""


def flight_tail(spark, sf, t=None):
    """Contiguous samples after the last hit of each entity, cut at the first hole or jump.

    Only the hours after one hit are kept before the window, which bounds its size."""
    t = track(spark, sf) if t is None else t
    last = t.filter(is_hit()).groupBy("entity_id").agg(F.max("seq").alias("c"))
    t = t.join(last, "entity_id").filter((F.col("seq") > F.col("c")) & (F.col("seq") <= F.col("c") + FLIGHT_CAP))
    w = Window.partitionBy("entity_id").orderBy("seq", "event_id")
    gap = F.col("seq") - F.lag("seq").over(w)
    step = F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w), 2) + F.pow(F.col("cy") - F.lag("cy").over(w), 2))
    t = t.withColumn("_g", gap).withColumn("_s", step)
    bad = F.coalesce((F.col("_g") > FLIGHT_HOLE) | (F.try_divide(F.col("_s"), F.col("_g") / P.frame) > TELEPORT), F.lit(False))
    return t.withColumn("_b", F.max(bad.cast("int")).over(w)).filter("_b = 0").drop("_b", "_g", "_s")


@query("contiguous_tail", f"WITH {TRACK_SQL}, {TAIL_SQL} SELECT entity_id, event_id FROM tl")
def contiguous_tail(spark, sf):
    return flight_tail(spark, sf).select("entity_id", "event_id")


_RACE = f"""CASE WHEN n < 4 THEN '?' WHEN ts <= {EXTRAP} AND tb <= {EXTRAP} AND abs(ts - tb) <= {BOTH_WIN} THEN 'x' WHEN ts <= {EXTRAP} AND ts <= tb THEN 'w' WHEN tb <= {EXTRAP} THEN 'd' WHEN ts <= {EXTRAP} THEN 'w' ELSE '?' END"""
_FAR = f"CASE WHEN y0 < 0 THEN true WHEN y0 > {COURT_L} THEN false WHEN abs(by_) > 1e-3 THEN by_ < 0 ELSE y0 < {NET_Y} END"
_TB = (f"CASE WHEN {_FAR} THEN CASE WHEN y0 < {-OUT} THEN 0 WHEN by_ < 0 THEN ({-OUT} - y0) / by_ ELSE 1e18 END "
       f"ELSE CASE WHEN y0 > {COURT_L + OUT} THEN 0 WHEN by_ > 0 THEN ({COURT_L + OUT} - y0) / by_ ELSE 1e18 END END")
_SX = f"(CASE WHEN bx_ > 0 THEN {SIDE_R + OUT} ELSE {SIDE_L - OUT} END - x0)"
_TS = f"CASE WHEN NOT x0 BETWEEN {SIDE_L - OUT} AND {SIDE_R + OUT} THEN 0 WHEN abs(bx_) < 1e-9 THEN 1e18 WHEN {_SX} / bx_ < 0 THEN 1e18 ELSE {_SX} / bx_ END"


@query("boundary_race", f"""WITH {TRACK_SQL}, {TAIL_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY entity_id) AS n FROM tl),
  f AS (SELECT entity_id, max(n) AS n, regr_slope(cx, seq / {P.frame}::DOUBLE) AS bx_, regr_slope(cy, seq / {P.frame}::DOUBLE) AS by_, arg_max(cx, (seq, event_id)) AS x0, arg_max(cy, (seq, event_id)) AS y0 FROM k WHERE r <= {TAIL_K} GROUP BY 1),
  g AS (SELECT *, {_TS} AS ts, {_TB} AS tb FROM f) SELECT entity_id, n, {_RACE} AS call FROM g""")
def boundary_race(spark, sf):
    return race(flight_tail(spark, sf)).select("entity_id", "n", "call")


def race(tail):
    """Line fit of the last samples, raced to the sideline and to the baseline."""
    w = Window.partitionBy("entity_id")
    t = tail.withColumn("_r", F.row_number().over(w.orderBy(F.desc("seq"), F.desc("event_id")))).withColumn("_n", F.count("*").over(w))
    f = t.filter(F.col("_r") <= TAIL_K).withColumn("f", F.col("seq") / P.frame).groupBy("entity_id").agg(
        F.max("_n").alias("n"), F.regr_slope("cx", "f").alias("bx_"), F.regr_slope("cy", "f").alias("by_"),
        F.max_by("cx", F.struct("seq", "event_id")).alias("x0"), F.max_by("cy", F.struct("seq", "event_id")).alias("y0"))
    return f.withColumn("ts", F.expr(_TS)).withColumn("tb", F.expr(_TB)).withColumn("call", F.expr(_RACE))


def kinks(spark, sf, t=None):
    """First near-half V-cusp within flight time of each entity's last hit."""
    last = (track(spark, sf) if t is None else t).filter(is_hit()).groupBy("entity_id").agg(F.max("seq").alias("c"))
    k = cusp_rows(spark, sf, t).join(last, "entity_id")
    k = k.filter((F.col("seq") > F.col("c") + 2 * P.frame) & (F.col("seq") <= F.col("c") + 4 * P.recv) & (F.col("straddle") <= 4 * DAY)
                 & (F.col("swing") >= NEAR_SWING) & (F.col("cy") > NET_Y + 1) & (F.col("cy") < COURT_L + 8.0))
    m = F.min(F.struct("seq", "event_id", "cx", "cy")).alias("m")
    return k.groupBy("entity_id").agg(m).select("entity_id", "m.seq", "m.event_id", "m.cx", "m.cy")


@query("near_kink", f"""WITH {TRACK_SQL}, {CUSP_SQL}, l AS (SELECT entity_id, max(seq) AS c FROM t WHERE kind = 'purchase' GROUP BY 1)
  SELECT entity_id, arg_min(event_id, (seq, event_id)) AS event_id, {q6('arg_min(cx, (seq, event_id))')} AS cx, {q6('arg_min(cy, (seq, event_id))')} AS cy FROM cu JOIN l USING (entity_id)
  WHERE seq > c + {2 * P.frame} AND seq <= c + {4 * P.recv} AND straddle <= {4 * DAY} AND swing >= {NEAR_SWING} AND cy > {NET_Y + 1} AND cy < {COURT_L + 8.0} GROUP BY 1""")
def near_kink(spark, sf):
    k = kinks(spark, sf)
    return k.select("entity_id", "event_id", r6(F.col("cx")).alias("cx"), r6(F.col("cy")).alias("cy"))


def verdict(deep, wide):
    return F.when(deep & wide, "x@").when(deep, "d@").when(wide, "w@").otherwise("*")


def endings(spark, sf, lad=None, shared=None):
    """Evidence cascade for the last hit: own landing, net death, near kink, race, '?'."""
    t = track(spark, sf) if shared is None else shared
    lad = ladder(spark, sf) if lad is None else lad
    hits = t.filter(is_hit()).groupBy("entity_id").agg(F.max(F.struct("seq", "event_id")).alias("h"))
    last = hits.join(lad.select("event_id", "lx", "ly"), F.col("h.event_id") == F.col("event_id")).select("entity_id", F.col("h.seq").alias("c"), "lx", "ly")
    tail = t.join(hits.select("entity_id", F.col("h.seq").alias("c")), "entity_id").filter(F.col("seq") >= F.col("c")).groupBy("entity_id").agg(
        F.count("*").alias("n"), F.max(F.struct("seq", "event_id", "cy")).alias("z"))
    k = kinks(spark, sf, shared).select("entity_id", F.col("cx").alias("kx"), F.col("cy").alias("ky"))
    r = race(flight_tail(spark, sf, shared)).select("entity_id", "call")
    j = last.join(tail, "entity_id", "left").join(k, "entity_id", "left").join(r, "entity_id", "left")
    wide = lambda c: ~F.col(c).between(SIDE_L - OUT, SIDE_R + OUT)
    net = (F.col("n") >= 3) & (F.abs(F.col("z.cy") - NET_Y) < 1.5) & (F.col("z.seq") - F.col("c") <= 4 * P.recv)
    own = F.when(F.col("ly").isNotNull(), verdict(F.col("ly") < -OUT, wide("lx")))
    kink = F.when(F.col("kx").isNotNull(), verdict(F.col("ky") > COURT_L + 0.5, wide("kx")))
    flown = F.when(F.col("call").isin("w", "d", "x"), F.concat("call", F.lit("@")))
    src = F.when(own.isNotNull(), "landing").when(net, "net").when(kink.isNotNull(), "kink").when(flown.isNotNull(), "race").otherwise("none")
    return j.select("entity_id", F.coalesce(own, F.when(net, "n@"), kink, flown, F.lit("?")).alias("ending"), src.alias("src"))


@query("ending_infer")
def ending_infer(spark, sf):
    return endings(spark, sf)


# ---- alternation ----
CANDIDATES = [(first, mask) for first in (0, 1) for mask in range(1 << FLIP_SLOTS)]
_VOTE = (f"CASE WHEN role = 'user' THEN {VOTE_TOUCH} WHEN role = 'assistant' THEN -{VOTE_TOUCH} ELSE 0.0 END + CASE WHEN turn = 0 THEN {VOTE_SERVE} ELSE 0.0 END"
         f" + CASE WHEN length(text) % 3 = 0 THEN {VOTE_LANDING} ELSE 0.0 END")
_SLOT = "length(text) % 2 = 0"


@query("alternation_map", f"""WITH c AS (SELECT conv_id, turn, ({_VOTE}) AS v, least({FLIP_SLOTS}, coalesce(sum(CASE WHEN {_SLOT} THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sb,
     least({FLIP_SLOTS}, sum(CASE WHEN {_SLOT} AND nx IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) AS ns FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)),
  k AS (SELECT conv_id, c // {1 << FLIP_SLOTS} AS first, c % {1 << FLIP_SLOTS} AS mask, max(ns) AS ns,
     sum(v * CASE WHEN (c // {1 << FLIP_SLOTS} + turn + bit_count(CAST((c % {1 << FLIP_SLOTS}) & ((1 << CAST(sb AS INT)) - 1) AS INT))) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM c, range({len(CANDIDATES)}) r(c) GROUP BY 1, 2, 3)
  SELECT conv_id, CAST(first AS INT) AS first_, CAST(mask AS INT) AS mask, {q6(f's - {FLIP_COST} * bit_count(CAST(mask AS INT))')} AS score FROM k WHERE mask < (1 << CAST(ns AS INT))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY s - {FLIP_COST} * bit_count(CAST(mask AS INT)) DESC, first, mask) = 1""")
def alternation_map(spark, sf):
    """Best alternating assignment with up to four optional flips.

    All 32 candidates are summed side by side in one aggregate: a turn's side under a
    candidate is the parity of its position plus the flips taken before it.
    """
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(_VOTE).alias("v"), F.expr(_SLOT).alias("slot"))
    c = S.add_slice(c, 64, "turn")
    by = (("conv_id",), ("turn",))
    c = S.running_sum(c, {"upto": F.col("slot").cast("int")}, *by)
    # slots strictly before this turn; the last turn cannot hold one
    c = c.withColumn("sb", F.least(F.lit(FLIP_SLOTS), F.col("upto") - F.col("slot").cast("int")).cast("int"))
    even = lambda first, mask: F.expr(f"({first} + turn + bit_count({mask} & (shiftleft(1, sb) - 1))) % 2 = 0")
    sums = [F.sum(F.when(even(f, m), F.col("v")).otherwise(-F.col("v"))).alias(f"c{i}") for i, (f, m) in enumerate(CANDIDATES)]
    g = c.groupBy("conv_id").agg(F.max_by("sb", "turn").alias("ns"), *sums)
    score = lambda i, m: F.when(F.lit(m) < F.pow(2, F.col("ns")), F.col(f"c{i}") - FLIP_COST * bin(m).count("1"))
    best = F.array_max(F.array(*[F.struct(score(i, m).alias("score"), F.lit(-f).alias("f"), F.lit(-m).alias("m")) for i, (f, m) in enumerate(CANDIDATES)]))
    return g.select("conv_id", best.alias("b")).select("conv_id", (-F.col("b.f")).alias("first_"), (-F.col("b.m")).alias("mask"), r6(F.col("b.score")).alias("score"))


# ---- launches and the serve call ----
LAUNCH_WIN, LAUNCH_GAP, LAUNCH_SPAN, LAUNCH_MONO = 2 * DAY, P.hole, 4.0, 0.75


def launches(spark, sf, t=None):
    """First start whose contiguous look-ahead passes the level mostly one way."""
    df = S.spread((track(spark, sf) if t is None else t).select("entity_id", "seq", "event_id", "cy"), LAUNCH_WIN, P.slice_ms)
    found = whole(df, ["entity_id", "slice"], ["seq", "event_id"], first_starts, "entity_id long, seq long, event_id long, end_ string, cy double")
    return found.groupBy("entity_id").agg(F.min(F.struct("seq", "event_id", "end_", "cy")).alias("m")).select("entity_id", "m.seq", "m.event_id", "m.end_", "m.cy")


def first_starts(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """The first own row of each group that starts a launch. Look-aheads are found by bisection, steps up and down counted by prefix sums."""
    i, seq, (cy, ok) = np.arange(t.num_rows), t.column("seq").to_numpy(), pair(t.column("cy"))
    new = np.zeros(t.num_rows, bool)
    new[starts] = True
    new[1:] |= np.diff(seq) > LAUNCH_GAP
    key = (np.cumsum(new) << 36) + seq - seq[np.maximum.accumulate(np.where(new, i, 0))]      # ascends over the runs
    a, z = np.searchsorted(key, key), np.searchsorted(key, key + LAUNCH_WIN, side="right") - 1
    with np.errstate(all="ignore"):
        step = np.where(ok[1:] & ok[:-1], np.sign(np.diff(cy)), 0)
        up, down = (np.concatenate([[0], np.cumsum(step == d)]) for d in (1, -1))
        y0, y1 = cy[a], cy[z]
        same = np.where(y1 > y0, up[z] - up[a], down[z] - down[a])
        good = ok[a] & ok[z] & ((y0 - NET_Y) * (y1 - NET_Y) < 0) & (np.abs(y1 - y0) > LAUNCH_SPAN) & (same / np.maximum(z - a, 1) >= LAUNCH_MONO)
    at = np.flatnonzero(good & t.column("own").to_numpy())
    at = at[np.unique(np.searchsorted(starts, at, side="right"), return_index=True)[1]]
    out = t.select(["entity_id", "seq", "event_id", "cy"]).take(pa.array(at))
    return out.add_column(3, "end_", pa.array(np.where(y1[at] < y0[at], "near", "far"), pa.string()))


@query("first_launch", f"""WITH {TRACK_SQL}, r AS (SELECT *, sum(b) OVER w AS run FROM (SELECT *, CASE WHEN lag(seq) OVER w IS NULL OR seq - lag(seq) OVER w > {LAUNCH_GAP} THEN 1 ELSE 0 END AS b FROM t {W_SQL}) {W_SQL}),
  j AS (SELECT a.entity_id, a.seq, a.event_id, a.cy, list(z.cy ORDER BY z.seq, z.event_id) AS ys FROM r a JOIN r z ON z.entity_id = a.entity_id AND z.run = a.run AND z.seq BETWEEN a.seq AND a.seq + {LAUNCH_WIN} GROUP BY ALL),
  o AS (SELECT *, CASE WHEN ys[-1] < ys[1] THEN 'near' ELSE 'far' END AS end_ FROM j WHERE len(ys) > 1 AND (ys[1] - {NET_Y}) * (ys[-1] - {NET_Y}) < 0 AND abs(ys[-1] - ys[1]) > {LAUNCH_SPAN}
    AND list_avg(list_transform(range(1, len(ys)), lambda i: CASE WHEN sign(ys[i + 1] - ys[i]) = sign(ys[-1] - ys[1]) THEN 1.0 ELSE 0.0 END)) >= {LAUNCH_MONO})
  SELECT entity_id, min(seq) AS seq, arg_min(event_id, (seq, event_id)) AS event_id, arg_min(end_, (seq, event_id)) AS end_, {q6('arg_min(cy, (seq, event_id))')} AS cy FROM o GROUP BY 1""")
def first_launch(spark, sf):
    return launches(spark, sf).select("entity_id", "seq", "event_id", "end_", r6(F.col("cy")).alias("cy"))


def serve_calls(spark, sf, shared=None):
    """Ball launch first; else a settled entity with a peak; else a refusal with its reason."""
    t = track(spark, sf) if shared is None else shared
    la = launches(spark, sf, shared).select("entity_id", F.col("seq").alias("f0"), F.col("end_").alias("ball_end"), F.col("cy").alias("launch_cy"))
    pre = t.join(la, "entity_id").filter((F.col("seq") >= F.col("f0") - 2 * P.second) & (F.col("seq") <= F.col("f0")))
    stance = pre.groupBy("entity_id").agg(F.count("*").alias("ns"), F.median("cx").alias("sx")).filter((F.col("ns") >= 2) & (F.abs(F.col("sx") - CENTER_X) <= 2.5))
    st = settled(spark, sf, shared).groupBy("entity_id").agg(F.min(F.struct("start_seq", "mx", "my")).alias("s"))
    tp = toss(sliced_track(spark, sf) if shared is None else shared).select("entity_id", F.col("seq").alias("toss_seq"), "peak_ratio")
    ids = t.groupBy("entity_id").agg(F.min("seq").alias("first_seq"))
    j = ids.join(la, "entity_id", "left").join(stance, "entity_id", "left").join(st, "entity_id", "left").join(tp, "entity_id", "left")
    players = F.col("s").isNotNull() & (F.col("peak_ratio") >= 1.12)
    src = F.when(F.col("f0").isNotNull(), "ball").when(players, "players").otherwise("none")
    server = F.when(src == "ball", F.col("ball_end")).when(src == "players", F.when(F.col("s.my") > NET_Y, "near").otherwise("far")).otherwise("?")
    x = F.when(src == "ball", F.col("sx")).when(src == "players", F.col("s.mx"))
    deuce = F.when(server == "near", x > CENTER_X).otherwise(x < CENTER_X)
    side = F.when(x.isNull(), "").when(deuce, "deuce").otherwise("ad")
    reason = F.when((src == "ball") & (side == ""), "stance_unreadable_no_side").when((src == "none") & F.col("s").isNull(), "no_confident_serve: never-settles").when(
        src == "none", "no_confident_serve: no-toss").otherwise("")
    at = F.when(src == "ball", F.col("f0")).when(src == "players", F.col("toss_seq"))
    return j.select("entity_id", server.alias("server"), F.abs(x - CENTER_X).alias("margin"), side.alias("side"), at.alias("serve_seq"),
                    ((at - F.col("first_seq")) / P.second).alias("serve_s"), "launch_cy", src.alias("src"), reason.alias("reason"))


@query("serve_call")
def serve_call(spark, sf):
    return serve_calls(spark, sf).select("entity_id", "server", r6(F.col("margin")).alias("margin"), "side", "serve_seq", r6(F.col("serve_s")).alias("serve_s"), "src", "reason")


# ---- engineered features ----
_RANKED = f"rk0 AS (SELECT *, row_number() OVER w AS rk, count(*) OVER (PARTITION BY entity_id) AS n FROM t {W_SQL})"


@query("ending_features", f"""WITH {TRACK_SQL}, {_RANKED}, k AS (SELECT *, least(5, n - 1) AS k FROM rk0)
  SELECT entity_id, {', '.join(f'{q6(e)} AS {a}' for a, e in {
      'n_shots': "count(CASE WHEN kind = 'purchase' THEN 1 END)", 'final_cx': 'max(CASE WHEN rk = n THEN cx END)', 'final_cy': 'max(CASE WHEN rk = n THEN cy END)',
      'vx': '(max(CASE WHEN rk = n THEN cx END) - max(CASE WHEN rk = n - k THEN cx END)) / greatest(max(k), 1)', 'vy': '(max(CASE WHEN rk = n THEN cy END) - max(CASE WHEN rk = n - k THEN cy END)) / greatest(max(k), 1)',
      'fall': '(max(CASE WHEN rk = n THEN y END) - max(CASE WHEN rk = n - k THEN y END)) / greatest(max(k), 1)', 'max_abs_cx': 'max(abs(cx))', 'max_abs_cy': 'max(abs(cy))',
      'tail_min': 'min(CASE WHEN rk > floor(n * 0.6::DOUBLE) THEN abs(cy) END)', 'n_track': 'max(n)'}.items())} FROM k GROUP BY 1""")
def ending_features(spark, sf):
    """Final position, velocity over the last samples, extremes and tail of each track."""
    df = S.running_sum(sliced_track(spark, sf), {"rk": F.lit(1)})
    df = df.join(track(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id").withColumn("k", F.least(F.lit(5), F.col("n") - 1))
    at = lambda c, cond: F.max(F.when(cond, F.col(c)))
    end, back, k = F.col("rk") == F.col("n"), F.col("rk") == F.col("n") - F.col("k"), F.greatest(F.max("k"), F.lit(1))
    cols = {"n_shots": F.count(F.when(is_hit(), 1)), "final_cx": at("cx", end), "final_cy": at("cy", end), "vx": (at("cx", end) - at("cx", back)) / k,
            "vy": (at("cy", end) - at("cy", back)) / k, "fall": (at("y", end) - at("y", back)) / k, "max_abs_cx": F.max(F.abs("cx")), "max_abs_cy": F.max(F.abs("cy")),
            "tail_min": F.min(F.when(F.col("rk") > F.floor(F.col("n") * 0.6), F.abs("cy"))), "n_track": F.max("n")}
    g = df.groupBy("entity_id").agg(*[c.alias(n) for n, c in cols.items()])
    return g.select("entity_id", *[r6(F.col(n)).alias(n) for n in cols])


@query("serve_features", f"""WITH {TRACK_SQL}, s AS (SELECT entity_id, arg_min(event_id, (seq, event_id)) AS sid, min(seq) AS sq, arg_min(cx, (seq, event_id)) AS sx FROM t WHERE kind = 'signup' GROUP BY 1),
   l AS (SELECT s.entity_id, arg_min(cx, (t.seq, t.event_id)) AS lx, arg_min(cy, (t.seq, t.event_id)) AS ly FROM s JOIN t ON t.entity_id = s.entity_id AND t.kind = 'view' AND (t.seq, t.event_id) > (s.sq, s.sid) GROUP BY 1),
   e AS (SELECT *, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM t {W_SQL}), c AS (SELECT entity_id, arg_min(cx + ({NET_Y} - cy) / (ny - cy) * (nx - cx), (seq, event_id)) AS ncx FROM e WHERE (cy < {NET_Y}) <> (ny < {NET_Y}) GROUP BY 1),
   a AS (SELECT entity_id, min(seq) AS f, arg_min(cy, (seq, event_id)) AS launch FROM t GROUP BY 1)
   SELECT entity_id, {q6('coalesce(lx, 0)')} AS land_x, {q6('coalesce(ly, 0)')} AS land_y, lx IS NOT NULL AS has_land, {q6('coalesce(sx, 0)')} AS server_x, {q6(f'coalesce(abs(sx - {CENTER_X}), 0)')} AS margin, {q6(f'coalesce((sq - f) / {P.second}::DOUBLE, 0)', 4)} AS serve_s,
     {q6('launch')} AS launch_cy, coalesce(sx > {CENTER_X}, false) AS side_deuce, {q6('coalesce(ncx, 0)')} AS netcross_x, ncx IS NOT NULL AS has_netcross FROM a LEFT JOIN s USING (entity_id) LEFT JOIN l USING (entity_id) LEFT JOIN c USING (entity_id)""")
def serve_features(spark, sf):
    t = track(spark, sf)
    first = lambda *cols: F.min(F.struct("seq", "event_id", *cols)).alias("m")
    s = t.filter("kind = 'signup'").groupBy("entity_id").agg(first("cx")).select("entity_id", F.col("m.seq").alias("sq"), F.col("m.event_id").alias("sid"), F.col("m.cx").alias("sx"))
    views = t.filter("kind = 'view'").join(s, "entity_id").filter(F.struct("seq", "event_id") > F.struct("sq", "sid"))
    land = views.groupBy("entity_id").agg(first("cx", "cy")).select("entity_id", F.col("m.cx").alias("lx"), F.col("m.cy").alias("ly"))
    e = S.adjacent(sliced_track(spark, sf), ["cx", "cy"])
    ny, nx = F.col("next.cy"), F.col("next.cx")
    x = F.col("cx") + (NET_Y - F.col("cy")) / (ny - F.col("cy")) * (nx - F.col("cx"))
    net = e.filter((F.col("cy") < NET_Y) != (ny < NET_Y)).withColumn("ncx", x).groupBy("entity_id").agg(first("ncx")).select("entity_id", F.col("m.ncx").alias("ncx"))
    a = t.groupBy("entity_id").agg(first("cy")).select("entity_id", F.col("m.seq").alias("f"), F.col("m.cy").alias("launch"))
    j = a.join(s, "entity_id", "left").join(land, "entity_id", "left").join(net, "entity_id", "left")
    z = lambda c: r6(F.coalesce(c, F.lit(0.0)))
    return j.select("entity_id", z(F.col("lx")).alias("land_x"), z(F.col("ly")).alias("land_y"), F.col("lx").isNotNull().alias("has_land"), z(F.col("sx")).alias("server_x"),
                    z(F.abs(F.col("sx") - CENTER_X)).alias("margin"), r6(F.coalesce((F.col("sq") - F.col("f")) / P.second, F.lit(0.0)), 4).alias("serve_s"), r6(F.col("launch")).alias("launch_cy"),
                    F.coalesce(F.col("sx") > CENTER_X, F.lit(False)).alias("side_deuce"), z(F.col("ncx")).alias("netcross_x"), F.col("ncx").isNotNull().alias("has_netcross"))


# ---- launch assignment and the full event list ----
BACK, FWD = P.launch_back, P.launch_fwd


def assign_launches(chain, cands):
    """Each crossing claims the nearest unused candidate in its launch window, hits first;
    a crossing without one gets a synthetic launch unless the last launch already owns it.

    Crossings further apart than the windows reach cannot compete, so they fold apart."""
    j = S.bucket_join(cands, chain, ["entity_id"], "seq", F.col("start_seq") - BACK, F.col("start_seq") + FWD, BACK + FWD,
                      F.col("l.seq").between(F.col("r.start_seq") - BACK, F.col("r.start_seq") + FWD))
    # each crossing's candidates in the order in which it would take them
    rank = F.struct((F.col("l.cls") != "hit").alias("other"), F.abs(F.col("l.seq") - F.col("r.start_seq")).alias("off"), F.col("l.seq").alias("seq"), F.col("l.event_id").alias("event_id"))
    pool = j.groupBy("r.entity_id", "r.start_seq", "r.end_seq").agg(F.array_sort(F.collect_list(rank)).alias("pool"))
    c = S.adjacent(S.derived_slice(chain.select("entity_id", "start_seq", "end_seq"), P.slice_ms, "start_seq"), ["start_seq"], **G.BY_START)
    c = S.islands(c, F.col("start_seq") - F.col("prev.start_seq") > BACK + FWD + P.min_gap, "cluster", **G.BY_START).drop("prev", "next", "slice")
    rows = c.join(pool, ["entity_id", "start_seq", "end_seq"], "left").select(
        "entity_id", "cluster", "start_seq", "end_seq", F.coalesce(F.to_json("pool"), F.lit("[]")).alias("pool"))

    def step(state, r):
        # launches are min_gap apart, so `free` also rules out every candidate taken before
        taken = next((p for p in json.loads(r.pool) if p["seq"] >= state["free"]), None)
        if taken is None and r.start_seq < state["free"]:
            return []
        seq, event, signal = (taken["seq"], taken["event_id"], "cusp") if taken else (r.start_seq, -1, "crossing")
        state["free"] = seq + P.min_gap
        return [(r.entity_id, r.start_seq, seq, event, signal)]

    return fold(rows, ["entity_id", "cluster"], ["start_seq", "end_seq"], lambda: {"free": -(1 << 62)}, step,
                "entity_id long, start_seq long, seq long, event_id long, signal string")


def classified_cusps(spark, sf):
    """Suppressed cusps inside the valid zone, with their hit/bounce class."""
    return suppressed_cusps(G.classified_cusps(sliced_track(spark, sf).select(*G.ID, "y", "cy"), NEAR_SWING, FAR_SWING, FAR_Y))


def suppressed_cusps(c):
    c = c.filter(F.col("cy").between(-12, COURT_L + 2.2))
    c = cut_lineage(c.select("entity_id", "seq", "event_id", "cls", "cy", F.col("swing").alias("strength")))
    kept = G.suppress(c.select("entity_id", "seq", "event_id", "strength"), P.min_gap, P).select("event_id")
    return cut_lineage(c.join(kept, "event_id", "left_semi"))


@query("launch_assign")
def launch_assign(spark, sf):
    _, ch = chains(spark, sf)
    return assign_launches(G.longest_chain(ch), classified_cusps(spark, sf))


@query("detect_events")
def detect_events(spark, sf):
    return events(spark, sf)


def events(spark, sf):
    """Hits from the crossing spine, bounces from the cusp and collapse detectors.

    Entities without a spine keep every detector event."""
    x, cusps, falls = G.detectors(sliced_track(spark, sf).select(*G.ID, "y", "cy"), P, NEAR_SWING, FAR_SWING, FAR_Y)
    x = cut_lineage(x)
    spine = G.longest_chain(cut_lineage(G.split_chains(x.filter("strict"), P)))
    cand = suppressed_cusps(cusps)
    falls = last_in_segment(falls.select("entity_id", "seq", "event_id"), cand, P.min_gap)
    base = cand.select("entity_id", "seq", "event_id", F.col("cls").alias("kind"), F.lit("cusp").alias("signal")).unionByName(
        falls.select("entity_id", "seq", "event_id", F.lit("bounce").alias("kind"), F.lit("collapse").alias("signal")))
    base = cut_lineage(base)
    parts = G.long_partitions(spine, first_seen(spark, sf), P)
    weak = G.inside_partition(x, "start_seq", "end_seq", parts, P)
    cols = ["group_id", "entity_id", "start_seq", "end_seq"]
    chain = cut_lineage(spine.select(*cols).unionByName(weak.select(*cols)).distinct())
    hits = cut_lineage(assign_launches(chain, cand))
    # hit-class cusps buried in a partition, away from every start and from every hit
    left = G.long_partitions(chain.withColumn("chain", F.lit(0)), first_seen(spark, sf), P)
    hidden = G.inside_partition(base.filter("kind = 'hit' AND signal = 'cusp'"), "seq", "seq", left, P)
    sep = P.second * 4 // 5
    far = lambda d, other, at, gap: S.bucket_join(d, other, ["entity_id"], "seq", F.col(at) - gap, F.col(at) + gap, gap, F.abs(F.col("l.seq") - F.col(f"r.{at}")) <= gap, "left_anti").drop("_b")
    hidden = far(far(hidden, chain, "start_seq", sep), hits.select("entity_id", "seq"), "seq", P.min_gap - 1)
    first = G.suppress(hidden.select("entity_id", "seq", "event_id", (-F.col("seq")).cast("double").alias("strength")), P.min_gap, P)
    # the receiver's shot after the last crossing
    end = chain.groupBy("entity_id").agg(F.max("end_seq").alias("e"))
    taken = hits.select("event_id").union(first.select("event_id"))
    tail = base.filter("kind = 'hit' AND signal = 'cusp'").join(end, "entity_id").filter((F.col("seq") > F.col("e")) & (F.col("seq") <= F.col("e") + P.recv))
    tail = far(tail.join(taken, "event_id", "left_anti"), hits.select("entity_id", "seq"), "seq", P.min_gap - 1)
    tail = tail.groupBy("entity_id").agg(F.min(F.struct("seq", "event_id")).alias("m")).select("entity_id", "m.seq", "m.event_id")
    hit = lambda d, sig: d.select("entity_id", "seq", "event_id", F.lit("hit").alias("kind"), sig.alias("signal"))
    found = hit(hits, F.col("signal")).unionByName(hit(first, F.lit("hidden"))).unionByName(hit(tail, F.lit("trailing")))
    found = cut_lineage(found)
    spined = end.select("entity_id")
    bounces = base.filter("kind = 'bounce'").join(spined, "entity_id", "left_semi").join(found.select("entity_id", "seq"), ["entity_id", "seq"], "left_anti")
    return found.unionByName(bounces).unionByName(base.join(spined, "entity_id", "left_anti"))


@query("point_signals")
def point_signals(spark, sf):
    """The feature vector of every entity, defaults and clamps included."""
    t = written_track(spark, sf)
    calls = serve_calls(spark, sf, t).select("entity_id", "server", "margin", "serve_s", "launch_cy", "src", "side", "serve_seq")
    calls = cut_lineage(calls)          # read twice
    q = quality(spark, sf, t).select("entity_id", "n", "coverage", "max_hole", "n_holes")
    x, _ = chains(spark, sf, t)
    n_x = x.filter("strict").groupBy("entity_id").agg(F.count("*").alias("n_x"))
    early = x.join(calls.select("entity_id", "serve_seq"), "entity_id").groupBy("entity_id").agg(
        count_if(F.col("end_seq") < F.col("serve_seq")).alias("pre"), count_if(F.col("end_seq") >= F.col("serve_seq")).alias("spine"))
    lad = cut_lineage(ladder(spark, sf, t).select("entity_id", "event_id", "src", "digit", "hx", "hy", "nx", "ny", "lx", "ly")
                      .sortWithinPartitions("entity_id", "event_id"))           # averages add up in one order
    worth = F.create_map(*[F.lit(v) for kv in LADDER_QUALITY.items() for v in kv])
    d = lad.groupBy("entity_id").agg(F.count("*").alias("n_shots"), F.avg(F.try_element_at(worth, F.col("src"))).alias("dir_quality"), F.avg((F.col("digit") == "?").cast("double")).alias("dirs_refused"),
                                     F.avg(F.hypot(F.col("nx") - F.col("hx"), F.col("ny") - F.col("hy"))).alias("dist"))
    hits = track(spark, sf).filter(is_hit()).groupBy("entity_id").agg(((F.max("seq") - F.min("seq")) / P.second / F.greatest(F.count("*") - 1, F.lit(1))).alias("shot_gap"))
    e = endings(spark, sf, lad, t).select("entity_id", "ending")
    j = calls.join(q, "entity_id")
    for part in (n_x, early, d, hits, e):
        j = j.join(part, "entity_id", "left")
    num = lambda c, v=0.0: F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    plausible = F.when((F.col("src") == "ball") & F.col("launch_cy").isNotNull(), yes((F.col("launch_cy") <= 2) | (F.col("launch_cy") >= 8) | F.col("margin").isNotNull())).otherwise(yes(F.col("server") != "?"))
    cols = {"serve_committed": yes(F.col("server") != "?"), "serve_margin": F.least(num("margin"), F.lit(3.0)), "serve_s": F.least(num("serve_s", 5), F.lit(5.0)), "launch_plausible": plausible,
            "side_committed": yes(F.col("side") != ""), "n_holes": num("n_holes"), "coverage": num("coverage"), "max_hole_s": num("max_hole") / P.second, "contact_dist": F.least(num("dist", 300), F.lit(300.0)),
            "dir_quality": num("dir_quality"), "dirs_refused": num("dirs_refused"), "ending_committed": yes(F.coalesce("ending", F.lit("?")) != "?"), "n_shots": num("n_shots"),
            "crossings_gap": F.abs(num("n_shots") - num("n_x") - 1), "xr_pre_serve": num("pre"), "spineless": yes((num("n_shots") >= 3) & (num("spine") == 0)), "shot_gap_s": num("shot_gap"),
            "shots_per_s": F.try_divide(num("n_shots"), F.col("n") / F.col("coverage"))}
    return j.select("entity_id", *[r6(c, 4).alias(n) for n, c in cols.items()])



