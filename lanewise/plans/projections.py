"""Projections, filters and predicates: narrow column work, no shuffle of the data."""

from pyspark.sql import functions as F

from ..functions.numeric import r6

from ..operators.quantiles import quantiles
from ..presets import HOUR, INTERIOR_MIN, LINE_MIN, REACH_SHARE, REACH_SLACK, TRACK
from ..sources.tables import TRACK_SQL, table, track
from .notation import STATE_SQL, states
from .registry import query
from .registry import r6 as q6
from .signals import HALF_SQL, plausible

P = TRACK
# A mild perspective map from track units to metres.
H = ((0.1097, 0.002, 0.1), (0.001, 0.2377, -0.2), (0.0002, 0.0001, 1.0))


def project(x, y, h=H):
    """(X, Y) of a 3x3 projective map."""
    row = lambda r: r[0] * x + r[1] * y + r[2]
    return row(h[0]) / row(h[2]), row(h[1]) / row(h[2])


def project_sql(x: str, y: str) -> tuple[str, str]:
    row = lambda r: f"({r[0]}::DOUBLE * ({x}) + {r[1]}::DOUBLE * ({y}) + {r[2]}::DOUBLE)"
    return f"{row(H[0])} / {row(H[2])}", f"{row(H[1])} / {row(H[2])}"


OFFSET_SQL = """st AS (SELECT entity_id, event_id, seq, x - coalesce(s_acctbal / 1000, 0) - coalesce(n_regionkey, 0) AS xs, y - coalesce(s_nationkey, 0) AS ys
  FROM t LEFT JOIN supplier ON s_suppkey = entity_id LEFT JOIN nation ON n_nationkey = (seq // 3600000) % 24)"""


def stabilized(spark, sf):
    """Track minus a per-entity offset (supplier) and a per-hour shift (nation, fixed size)."""
    off = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), (F.col("s_acctbal") / 1000).alias("dx"), F.col("s_nationkey").alias("dy"))
    shift = table(spark, sf, "nation").select(F.col("n_nationkey").alias("_h"), F.col("n_regionkey").alias("sx"))
    df = track(spark, sf).withColumn("_h", F.floor(F.col("seq") / HOUR) % 24)
    df = df.join(off, "entity_id", "left").join(F.broadcast(shift), "_h", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return df.withColumn("xs", F.col("x") - zero("dx") - zero("sx")).withColumn("ys", F.col("y") - zero("dy"))


@query("stabilize_offset", f"WITH {TRACK_SQL}, {OFFSET_SQL} SELECT entity_id, event_id, {q6('xs')} AS xs, {q6('ys')} AS ys FROM st")
def stabilize_offset(spark, sf):
    return stabilized(spark, sf).select("entity_id", "event_id", r6(F.col("xs")).alias("xs"), r6(F.col("ys")).alias("ys"))


_PX, _PY = project_sql("x", "y")
_UX, _UY = project_sql("x", "y - 1")


@query("project_homography", f"WITH {TRACK_SQL} SELECT entity_id, event_id, {q6(_PX)} AS px, {q6(_PY)} AS py FROM t")
def project_homography(spark, sf):
    px, py = project(F.col("x"), F.col("y"))
    return track(spark, sf).select("entity_id", "event_id", r6(px).alias("px"), r6(py).alias("py"))


@query("local_scale", f"WITH {TRACK_SQL} SELECT entity_id, event_id, {q6(f'sqrt(power(({_UX}) - ({_PX}), 2) + power(({_UY}) - ({_PY}), 2))')} AS scale FROM t")
def local_scale(spark, sf):
    a, b = project(F.col("x"), F.col("y")), project(F.col("x"), F.col("y") - 1)
    return track(spark, sf).select("entity_id", "event_id", r6(F.hypot(b[0] - a[0], b[1] - a[1])).alias("scale"))


@query("plausible_half", f"WITH {TRACK_SQL}, {HALF_SQL} SELECT entity_id, event_id FROM ph")
def plausible_half(spark, sf):
    return plausible(track(spark, sf)).select("entity_id", "event_id")


@query("mask_columns", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE o_orderstatus END AS first_draft, CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE o_totalprice END AS conf_p, "
       "CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS confidence, o_custkey FROM orders")
def mask_columns(spark, sf):
    cold = F.col("o_custkey") % 2 == 0
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(cold, "").otherwise(F.col("o_orderstatus")).alias("first_draft"), F.when(cold, -1.0).otherwise(F.col("o_totalprice")).alias("conf_p"),
        F.when(~cold, F.col("o_orderpriority")).alias("confidence"), "o_custkey")


@query("view_gate", f"WITH {TRACK_SQL} SELECT entity_id, event_id FROM t WHERE x / 60 > {INTERIOR_MIN} AND y / 50 > {LINE_MIN}")
def view_gate(spark, sf):
    return track(spark, sf).filter((F.col("x") / 60 > INTERIOR_MIN) & (F.col("y") / 50 > LINE_MIN)).select("entity_id", "event_id")


_WIN_SQL = f"""w AS (SELECT entity_id, event_id, CASE WHEN kind = 'error' THEN NULL ELSE seq END AS start_ms,
   CASE WHEN kind = 'view' THEN NULL ELSE seq + CAST(x - 30 AS BIGINT) * {P.second // 10} END AS end_ms FROM t)"""


def windows(spark, sf):
    end = F.col("seq") + (F.col("x") - 30).cast("long") * (P.second // 10)
    return track(spark, sf).select("entity_id", "event_id", F.when(F.col("kind") != "error", F.col("seq")).alias("start_ms"),
                                   F.when(F.col("kind") != "view", end).alias("end_ms"))


@query("valid_windows", f"WITH {TRACK_SQL}, {_WIN_SQL} SELECT printf('m%d_point_%03d', entity_id, event_id % 1000) AS clip, start_ms, end_ms FROM w WHERE start_ms < end_ms")
def valid_windows(spark, sf):
    clip = F.format_string("m%d_point_%03d", "entity_id", F.col("event_id") % 1000)
    return windows(spark, sf).filter("start_ms < end_ms").select(clip.alias("clip"), "start_ms", "end_ms")


@query("window_pad", f"""WITH {TRACK_SQL}, b AS (SELECT min(seq) AS z FROM t), {_WIN_SQL}, r AS (SELECT entity_id, event_id, greatest(0, start_ms - z - {P.second // 2}) AS cut_ms, end_ms - z AS e FROM w, b WHERE start_ms < end_ms)
   SELECT entity_id, event_id, cut_ms, e - cut_ms + {P.second // 2} AS dur_ms FROM r""")
def window_pad(spark, sf):
    """Windows on the clock of the first sample, padded half a second, clamped at 0."""
    z = track(spark, sf).agg(F.min("seq").alias("z"))
    r = windows(spark, sf).filter("start_ms < end_ms").join(F.broadcast(z))     # one row
    r = r.withColumn("cut_ms", F.greatest(F.lit(0).cast("long"), F.col("start_ms") - F.col("z") - P.second // 2))
    return r.select("entity_id", "event_id", "cut_ms", (F.col("end_ms") - F.col("z") - F.col("cut_ms") + P.second // 2).alias("dur_ms"))


@query("override_degrade", f"WITH {TRACK_SQL}, o AS (SELECT entity_id, event_id, CASE WHEN kind = 'error' THEN '?' WHEN entity_id % 2 = 0 THEN 'near' ELSE 'far' END AS call, CASE WHEN cy >= 11.885 THEN 'near' ELSE 'far' END AS used, CAST(4 + event_id % 3 AS VARCHAR) AS zone FROM t) "
       "SELECT entity_id, event_id, used, CASE WHEN call <> '?' AND call <> used THEN '?' ELSE zone END AS zone FROM o")
def override_degrade(spark, sf):
    call = F.when(F.col("kind") == "error", "?").when(F.col("entity_id") % 2 == 0, "near").otherwise("far")
    used = F.when(F.col("cy") >= 11.885, "near").otherwise("far")
    zone = (4 + F.col("event_id") % 3).cast("string")
    return track(spark, sf).select("entity_id", "event_id", used.alias("used"), F.when((call != "?") & (call != used), "?").otherwise(zone).alias("zone"))


def rect_gap(px, py, cx, cy, w, h):
    """Distance of a point from a rectangle given by centre and size (0 inside)."""
    dx = F.greatest(cx - w / 2 - px, F.lit(0.0), px - (cx + w / 2))
    dy = F.greatest(cy - h / 2 - py, F.lit(0.0), py - (cy + h / 2))
    return F.sqrt(dx * dx + dy * dy)


# Boxes over the track: centred at a fixed post of the group, sized by the sample's own y.
_BOX = "(10.0::DOUBLE * (group_id + 1))"
RECT_SQL = (f"bx AS (SELECT *, 20.0::DOUBLE + y / 10 AS bw, 40.0::DOUBLE + y / 5 AS bh, {_BOX} AS bcx, 60.0::DOUBLE AS bcy FROM t), rc AS (SELECT *, "
            "sqrt(power(greatest(bcx - bw / 2 - x, 0, x - (bcx + bw / 2)), 2) + power(greatest(bcy - bh / 2 - y, 0, y - (bcy + bh / 2)), 2)) AS gap_ FROM bx)")


def boxes(spark, sf):
    df = track(spark, sf).withColumns({"bw": 20.0 + F.col("y") / 10, "bh": 40.0 + F.col("y") / 5, "bcx": 10.0 * (F.col("group_id") + 1), "bcy": F.lit(60.0)})
    return df.withColumn("gap_", rect_gap(F.col("x"), F.col("y"), F.col("bcx"), F.col("bcy"), F.col("bw"), F.col("bh")))


@query("rect_distance", f"WITH {TRACK_SQL}, {RECT_SQL} SELECT entity_id, event_id, {q6('gap_')} AS gap_ FROM rc")
def rect_distance(spark, sf):
    return boxes(spark, sf).select("entity_id", "event_id", r6(F.col("gap_")).alias("gap_"))


TYP_SQL = "ty AS (SELECT entity_id, kind, quantile_cont(bh, 0.75) AS p75 FROM bx GROUP BY 1, 2)"


def typical(spark, sf):
    """75th percentile box height per entity and side (kind)."""
    return quantiles(boxes(spark, sf), ["entity_id", "kind"], "bh", {"p75": 0.75}, 5.0).drop("n")


@query("percentile_by_side", f"WITH {TRACK_SQL}, {RECT_SQL}, {TYP_SQL} SELECT entity_id, kind, {q6('p75')} AS p75 FROM ty")
def percentile_by_side(spark, sf):
    return typical(spark, sf).withColumn("p75", r6(F.col("p75")))


def gated(spark, sf):
    df = boxes(spark, sf).join(typical(spark, sf), ["entity_id", "kind"])
    return df.withColumn("ok", F.col("gap_") <= REACH_SHARE * F.greatest("bh", "p75") / 10 + REACH_SLACK / 10)


@query("reach_gate", f"WITH {TRACK_SQL}, {RECT_SQL}, {TYP_SQL} SELECT entity_id, event_id, gap_ <= {REACH_SHARE}::DOUBLE * greatest(bh, p75) / 10 + {REACH_SLACK / 10} AS ok FROM rc JOIN ty USING (entity_id, kind)")
def reach_gate(spark, sf):
    return gated(spark, sf).select("entity_id", "event_id", "ok")


def letter(dx, near, lefty):
    """f or b from the side of the box the sample is on, mirrored by end and hand."""
    right = F.when(near, dx > 0).otherwise(dx < 0)
    return F.when(right != lefty, "f").otherwise("b")


@query("side_letter", f"""WITH {TRACK_SQL}, {RECT_SQL}, {TYP_SQL}, g AS (SELECT *, gap_ <= {REACH_SHARE}::DOUBLE * greatest(bh, p75) / 10 + {REACH_SLACK / 10} AS ok FROM rc JOIN ty USING (entity_id, kind))
   SELECT entity_id, event_id, CASE WHEN NOT ok OR kind = 'error' THEN '?' WHEN (CASE WHEN group_id % 2 = 0 THEN x > bcx ELSE x < bcx END) <> (entity_id % 5 = 0) THEN 'f' ELSE 'b' END AS letter FROM g""")
def side_letter(spark, sf):
    df = gated(spark, sf)
    let = letter(F.col("x") - F.col("bcx"), F.col("group_id") % 2 == 0, F.col("entity_id") % 5 == 0)
    return df.select("entity_id", "event_id", F.when(~F.col("ok") | (F.col("kind") == "error"), "?").otherwise(let).alias("letter"))


@query("mechanistic_gate", f"""WITH {TRACK_SQL}, e AS (SELECT entity_id, min(CASE WHEN kind = 'signup' THEN seq END) AS s0, count(CASE WHEN kind = 'purchase' THEN 1 END) AS shots,
     count(CASE WHEN kind = 'click' AND cy > 11.885 THEN 1 END) AS passes, arg_min(cy, (seq, event_id)) AS launch FROM t GROUP BY 1),
   p AS (SELECT t.entity_id, count(*) AS pre FROM t JOIN e USING (entity_id) WHERE t.kind = 'click' AND t.seq < e.s0 GROUP BY 1)
   SELECT entity_id, (launch <= 2 OR launch >= 8) AND coalesce(pre, 0) < 2 AND NOT (shots >= 3 AND passes = 0) AS gate FROM e LEFT JOIN p USING (entity_id)""")
def mechanistic_gate(spark, sf):
    """Three whole-entity rules: plausible launch, few early passes, a spine."""
    t = track(spark, sf)
    k = lambda n: F.col("kind") == n
    e = t.groupBy("entity_id").agg(F.min(F.when(k("signup"), F.col("seq"))).alias("s0"), F.count(F.when(k("purchase"), 1)).alias("shots"),
                                   F.count(F.when(k("click") & (F.col("cy") > 11.885), 1)).alias("passes"),
                                   F.min(F.struct("seq", "event_id", "cy")).alias("m"))
    pre = t.filter(k("click")).join(e.select("entity_id", "s0"), "entity_id").filter(F.col("seq") < F.col("s0")).groupBy("entity_id").agg(F.count("*").alias("pre"))
    launch = F.col("m.cy")
    gate = ((launch <= 2) | (launch >= 8)) & (F.coalesce("pre", F.lit(0)) < 2) & ~((F.col("shots") >= 3) & (F.col("passes") == 0))
    return e.join(pre, "entity_id", "left").select("entity_id", gate.alias("gate"))


@query("point_filter_matched", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def point_filter_matched(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


_SCORE = ("CASE WHEN p_name LIKE '%red%' OR p_type LIKE '%PROMO%' THEN 100 ELSE 0 END + CASE WHEN p_name LIKE '%ring%' THEN 40 ELSE 0 END + CASE WHEN p_name LIKE '%small%' THEN 10 ELSE 0 END"
          " + CASE WHEN p_size BETWEEN 20 AND 45 THEN 60 WHEN p_size BETWEEN 10 AND 19 THEN 30 WHEN p_size > 45 THEN 45 WHEN p_size < 3 THEN -20 ELSE 0 END")


def candidates(spark, sf):
    return table(spark, sf, "part").withColumn("score", F.expr(_SCORE))


@query("candidate_score_rules", f"SELECT p_brand, max(({_SCORE})) AS score, arg_min(p_partkey, (-({_SCORE}), -p_size, p_partkey)) AS best FROM part GROUP BY 1")
def candidate_score_rules(spark, sf):
    """Best candidate of each brand by rule score, then duration band, then key."""
    best = F.min(F.struct((-F.col("score")).alias("s"), (-F.col("p_size")).alias("z"), "p_partkey"))
    return candidates(spark, sf).groupBy("p_brand").agg(best.alias("m")).select("p_brand", (-F.col("m.s")).alias("score"), F.col("m.p_partkey").alias("best"))


@query("topk_global", f"SELECT p_partkey, {_SCORE} AS score FROM part ORDER BY score DESC, p_partkey LIMIT 5")
def topk_global(spark, sf):
    return candidates(spark, sf).select("p_partkey", "score").orderBy(F.desc("score"), "p_partkey").limit(5)


@query("end_parity", f"""WITH {STATE_SQL}, g AS (SELECT *, gm1 + gm2 + CASE WHEN set1 = 1 AND set2 = 0 THEN 9 WHEN set2 = 1 THEN 12 WHEN set1 = 1 THEN 10 ELSE 0 END AS g FROM sc),
   s AS (SELECT *, CAST(floor((g + 1) / 2) AS BIGINT) + CASE WHEN gm1 = 6 AND gm2 = 6 THEN CAST(floor((pt % 13 + pt % 7) / 6) AS BIGINT) ELSE 0 END AS swaps FROM g)
   SELECT pt, CASE WHEN swaps % 2 = 1 THEN 'near' ELSE 'far' END AS p1_end FROM s""")
def end_parity(spark, sf):
    return with_end(states(spark, sf)).select("pt", "p1_end")


def with_end(df):
    """The end player 1 occupies: games plus prior, changeovers, tiebreak swaps."""
    s1, s2 = F.col("set1"), F.col("set2")
    prior = F.when((s1 == 1) & (s2 == 0), 9).when(s2 == 1, 12).when(s1 == 1, 10).otherwise(0)
    g = F.col("gm1") + F.col("gm2") + prior
    tb = F.when((F.col("gm1") == 6) & (F.col("gm2") == 6), F.floor((F.col("pt") % 13 + F.col("pt") % 7) / 6)).otherwise(0)
    return df.withColumn("p1_end", F.when((F.floor((g + 1) / 2) + tb) % 2 == 1, "near").otherwise("far"))


@query("shift_grid_argmax", f"""WITH {TRACK_SQL}, g AS (SELECT a.v AS dx, b.v AS dy, a.i * 3 + b.i AS i FROM (SELECT unnest([-2, 0, 2]) AS v, unnest([0, 1, 2]) AS i) a, (SELECT unnest([-2, 0, 2]) AS v, unnest([0, 1, 2]) AS i) b),
   s AS (SELECT entity_id, event_id, dx, dy, i, round_even(1.0 / (1 + abs(cx + dx - 5) + abs(cy + dy - 12)), 9) AS sc FROM t, g)
   SELECT entity_id, event_id, dx, dy, {q6('sc')} AS hit FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY sc DESC, i) = 1""")
def shift_grid_argmax(spark, sf):
    """Best of a 3x3 shift grid per sample: an array maximum, nothing is exploded."""
    grid = [(dx, dy) for dx in (-2, 0, 2) for dy in (-2, 0, 2)]
    score = lambda dx, dy: F.bround(1.0 / (1 + F.abs(F.col("cx") + dx - 5) + F.abs(F.col("cy") + dy - 12)), 9)
    best = F.array_max(F.array(*[F.struct(score(dx, dy).alias("hit"), F.lit(-i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(grid)]))
    return track(spark, sf).select("entity_id", "event_id", best.alias("b")).select("entity_id", "event_id", "b.dx", "b.dy", r6(F.col("b.hit")).alias("hit"))



