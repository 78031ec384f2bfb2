"""Window, sequence and signal queries over the track."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.numeric import count_if, ratio, r6
from ..operators import signal as G
from ..operators import slices as S
from ..operators.quantiles import quantiles
from ..operators.stencil import pair, sorted_median, whole
from ..presets import (CENTER_X, COURT_L, COURT_W, DAY, HOUR, JUMP_M, NET_Y, SIDE_L, SIDE_R, TRACK)
from ..session import cut_lineage
from ..sources.tables import TRACK_SQL, sliced_track, track
from .registry import query
from .registry import r6 as q6

P = TRACK
NEAR_SWING, FAR_SWING, FAR_Y = 6.0, 1.2, 50.0

W_SQL = "WINDOW w AS (PARTITION BY entity_id ORDER BY seq, event_id)"
MA_SQL = f"""ma AS (SELECT *, (coalesce(lag(y) OVER w, y) + y + coalesce(lead(y) OVER w, y)) / 3 AS ys FROM t {W_SQL})"""


def grad_sql(src: str, col: str, out: str, unit: int, name: str) -> str:
    return f"""{name}0 AS (SELECT *, lag({col}) OVER w AS fp, lead({col}) OVER w AS fn,
      CAST(seq - lag(seq) OVER w AS DOUBLE) / {unit} AS hs, CAST(lead(seq) OVER w - seq AS DOUBLE) / {unit} AS hd FROM {src} {W_SQL}),
    {name} AS (SELECT * EXCLUDE (fp, fn, hs, hd), fp IS NOT NULL AND fn IS NOT NULL AS inn,
      CASE WHEN fp IS NULL THEN (fn - {col}) / nullif(hd, 0) WHEN fn IS NULL THEN ({col} - fp) / nullif(hs, 0)
      ELSE (hs*hs*fn + (hd*hd - hs*hs)*{col} - hd*hd*fp) / nullif(hs*hd*(hs+hd), 0) END AS {out} FROM {name}0)"""


@query("moving_average_edge", f"WITH {TRACK_SQL}, {MA_SQL} SELECT entity_id, event_id, {q6('ys')} AS ys FROM ma")
def moving_average_edge(spark, sf):
    return G.smooth3(sliced_track(spark, sf), "y", "ys").select("entity_id", "event_id", r6(F.col("ys")).alias("ys"))


@query("gradient_nonuniform", f"""WITH {TRACK_SQL}, {grad_sql('t', 'y', 'v', HOUR, 'g')}
  SELECT entity_id, event_id, {q6('v')} AS v FROM g""")
def gradient_nonuniform(spark, sf):
    return G.gradient(sliced_track(spark, sf), "y", "v", HOUR).select("entity_id", "event_id", r6(F.col("v")).alias("v"))


HOLES_SQL = f"""h AS (SELECT entity_id, seq AS start_seq, lead(seq) OVER w AS end_seq FROM t {W_SQL}
  QUALIFY lead(seq) OVER w - seq > {P.hole})"""


@query("gap_holes", f"WITH {TRACK_SQL}, {HOLES_SQL} SELECT entity_id, start_seq, end_seq FROM h")
def gap_holes(spark, sf):
    return G.gaps(sliced_track(spark, sf), P.hole).select("entity_id", "start_seq", "end_seq")


CUSP_SQL = f"""{MA_SQL}, {grad_sql('ma', 'ys', 'v', HOUR, 'cg')},
  cu AS (SELECT *, lag(v) OVER w - lead(v) OVER w AS swing, lead(seq) OVER w - lag(seq) OVER w AS straddle FROM cg {W_SQL}
    QUALIFY lag(inn) OVER w AND lead(inn) OVER w AND lag(v) OVER w > 0 AND lead(v) OVER w < 0
      AND lag(v) OVER w - lead(v) OVER w >= CASE WHEN ys >= {FAR_Y} THEN {NEAR_SWING} ELSE {FAR_SWING} END)"""


def cusp_rows(spark, sf, t=None):
    return G.cusps(sliced_track(spark, sf) if t is None else t, P, NEAR_SWING, FAR_SWING, FAR_Y)


@query("cusp_candidates", f"WITH {TRACK_SQL}, {CUSP_SQL} SELECT entity_id, event_id, {q6('swing')} AS swing FROM cu")
def cusp_candidates(spark, sf):
    return cusp_rows(spark, sf).select("entity_id", "event_id", r6(F.col("swing")).alias("swing"))


def nms_sql(rows: str, gap: int) -> str:
    """CTEs ending in `kept` (entity_id, event_id): rows `rows` (entity_id, seq, event_id, strength) taken strongest first."""
    return f"""nms_in AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, seq, event_id) AS i FROM {rows}),
  nms_r AS (
    SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held, CAST(NULL AS BIGINT) AS took FROM nms_in
    UNION ALL
    SELECT entity_id, i, CASE WHEN free THEN list_append(held, seq) ELSE held END, CASE WHEN free THEN event_id END FROM (
      SELECT e.entity_id, e.i, e.seq, e.event_id, r.held, len(list_filter(r.held, lambda k: abs(k - e.seq) < {gap})) = 0 AS free
      FROM nms_r r JOIN nms_in e ON e.entity_id = r.entity_id AND e.i = r.i + 1)),
  kept AS (SELECT entity_id, took AS event_id FROM nms_r WHERE took IS NOT NULL)"""


@query("greedy_nms", f"""WITH RECURSIVE {TRACK_SQL}, {CUSP_SQL}, c AS (SELECT entity_id, seq, event_id, swing AS strength FROM cu), {nms_sql('c', P.second * 2)}
  SELECT c.entity_id, c.seq, c.event_id, {q6('strength')} AS strength FROM c JOIN kept USING (entity_id, event_id)""")
def greedy_nms(spark, sf):
    cand = cusp_rows(spark, sf).select("entity_id", "seq", "event_id", F.col("swing").alias("strength"))
    return G.suppress(cand, P.second * 2, P).withColumn("strength", r6(F.col("strength")))


COLL_SQL = f"""{grad_sql('t', 'cy', 'vcy', P.second, 'vg')},
  co0 AS (SELECT *, median(vcy) OVER b AS mb, median(vcy) OVER a AS med_after, count(*) OVER b AS nb, count(*) OVER a AS na FROM vg
    WINDOW b AS (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
           a AS (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
  co AS (SELECT * FROM co0 WHERE nb = 6 AND na = 6 AND cy <= {NET_Y} AND sign(mb) = sign(med_after)
    AND abs(med_after) > 0.3 AND abs(mb) / abs(med_after) >= 3)"""


@query("collapse_candidates", f"WITH {TRACK_SQL}, {COLL_SQL} SELECT entity_id, event_id, {q6('mb')} AS mb, {q6('med_after')} AS ma FROM co")
def collapse_candidates(spark, sf):
    return G.collapses(sliced_track(spark, sf)).select("entity_id", "event_id", r6(F.col("mb")).alias("mb"), r6(F.col("ma")).alias("ma"))


def last_in_segment(cands, bounds, inset: int):
    """Last candidate strictly inside each segment between bounds, `inset` from both ends."""
    none = F.lit(None).cast("long")
    a = cands.select("entity_id", "seq", "event_id", F.lit(0).alias("_k"), none.alias("_b"))
    b = bounds.select("entity_id", "seq", "event_id", F.lit(1).alias("_k"), F.col("seq").alias("_b"))
    both = S.derived_slice(a.unionByName(b), P.slice_ms)
    order = ("seq", "event_id", "_k")
    both = S.carry(both, {"lo": F.col("_b")}, True, True, order=order)
    both = S.carry(both, {"hi": F.col("_b")}, False, True, order=order)
    ok = ((F.col("_k") == 0) & (F.coalesce(F.col("lo") + inset <= F.col("seq"), F.lit(True)))
          & (F.coalesce(F.col("seq") <= F.col("hi") - inset, F.lit(True))))
    both = both.filter(ok).withColumn("segment", F.coalesce("lo", F.lit(-1)))
    return both.groupBy("entity_id", "segment").agg(F.max(F.struct("seq", "event_id")).alias("m")).select(
        "entity_id", "segment", F.col("m.seq").alias("seq"), F.col("m.event_id").alias("event_id"))


@query("last_per_segment", f"""WITH {TRACK_SQL}, {CUSP_SQL}, {COLL_SQL},
  c AS (SELECT co.entity_id, co.seq, co.event_id,
      (SELECT max(b.seq) FROM cu b WHERE b.entity_id = co.entity_id AND (b.seq, b.event_id) <= (co.seq, co.event_id) AND b.event_id <> co.event_id) AS lo,
      (SELECT min(b.seq) FROM cu b WHERE b.entity_id = co.entity_id AND (b.seq, b.event_id) >= (co.seq, co.event_id)) AS hi FROM co)
  SELECT entity_id, coalesce(lo, -1) AS segment, max(seq) AS seq, max_by(event_id, seq) AS event_id FROM c
  WHERE (lo IS NULL OR lo + {P.min_gap} <= seq) AND (hi IS NULL OR seq <= hi - {P.min_gap}) GROUP BY 1, 2""")
def last_per_segment(spark, sf):
    bounds, cands = G.cusps_and_collapses(sliced_track(spark, sf).select(*G.ID, "y", "cy"), NEAR_SWING, FAR_SWING, FAR_Y)
    return last_in_segment(cands, bounds, P.min_gap)


@query("classify_event", f"""WITH {TRACK_SQL}, {grad_sql('t', 'cy', 'vcy', P.second, 'vg')},
  m AS (SELECT *, median(vcy) OVER (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS med FROM vg),
  s AS (SELECT entity_id, min(seq) AS s0 FROM t WHERE kind = 'signup' GROUP BY 1)
  SELECT m.entity_id, m.event_id, CASE WHEN abs(med) > 4.5 THEN 'hit' ELSE 'bounce' END AS cls, {q6('med')} AS ma
  FROM m LEFT JOIN s USING (entity_id) WHERE m.kind = 'click'
    AND (cy BETWEEN -12 AND {COURT_L + 2.2} OR abs(seq - s0) <= {P.reach})""")
def classify_event(spark, sf):
    df = G.classify(sliced_track(spark, sf)).filter("kind = 'click'")
    first = track(spark, sf).filter("kind = 'signup'").groupBy("entity_id").agg(F.min("seq").alias("s0"))
    valid = F.col("cy").between(-12, COURT_L + 2.2) | F.coalesce(F.abs(F.col("seq") - F.col("s0")) <= P.reach, F.lit(False))
    return df.join(first, "entity_id", "left").filter(valid).select("entity_id", "event_id", "cls", r6(F.col("ma")).alias("ma"))


def cross_sql(weak: bool, name: str) -> str:
    cap = "" if weak else f"AND abs(c1 - c0) <= {P.cross_span_max} AND abs(c1 - c0) / nullif((end_seq - start_seq) / {P.second}, 0) <= {P.cross_speed_max}"
    n = P.cross_samples_weak if weak else P.cross_samples
    return f"""{name} AS (SELECT * FROM runs WHERE edges + 1 >= {n} AND abs(c1 - c0) >= {P.cross_span_min}
      AND least(c0, c1) < {NET_Y - 1} AND greatest(c0, c1) > {NET_Y + 1} AND end_seq > start_seq
      AND abs(c1 - c0) / nullif((end_seq - start_seq) / {P.second}, 0) >= {P.cross_speed_min} AND max_step <= {P.cross_max_step} {cap})"""


EDGE_SQL = f"""cs AS (SELECT *, (coalesce(lag(cy) OVER w, cy) + cy + coalesce(lead(cy) OVER w, cy)) / 3 AS cs, row_number() OVER w AS rk FROM t {W_SQL}),
  ed0 AS (SELECT *, lead(seq) OVER w AS nseq, lead(cs) OVER w AS ncs,
    CASE WHEN lead(seq) OVER w - seq <= {P.cross_gap} THEN sign(lead(cs) OVER w - cs) ELSE 0 END AS d FROM cs {W_SQL}),
  ed AS (SELECT *, sum(CASE WHEN d <> pd THEN 1 ELSE 0 END) OVER w AS run FROM
    (SELECT *, coalesce(lag(d) OVER w, 0) AS pd FROM ed0 {W_SQL}) {W_SQL}),
  runs AS (SELECT entity_id, group_id, run, min(seq) AS start_seq, max(nseq) AS end_seq, CAST(max(d) AS INT) AS dir, arg_min(cs, rk) AS c0,
    arg_max(ncs, rk) AS c1, min(rk) AS rank0, max(rk) + 1 AS rank1, count(*) AS edges,
    max(abs(ncs - cs) / greatest((nseq - seq) / {P.frame}, 1.0)) AS max_step FROM ed WHERE d <> 0 GROUP BY 1, 2, 3)"""


@query("net_crossings", f"WITH {TRACK_SQL}, {EDGE_SQL}, {cross_sql(False, 'x')} SELECT entity_id, start_seq, end_seq, dir FROM x")
def net_crossings(spark, sf):
    x = G.crossings(sliced_track(spark, sf), P)
    return x.filter("strict").select("entity_id", "start_seq", "end_seq", "dir")


CHAIN_SQL = f"""{EDGE_SQL}, {cross_sql(False, 'x')}, {cross_sql(True, 'xw')},
  fl AS (SELECT entity_id, rk, sum(f) OVER (PARTITION BY entity_id ORDER BY rk) AS flips, f FROM (SELECT entity_id, rk,
    CASE WHEN sign(cs - {NET_Y}) * sign(lag(cs) OVER w - {NET_Y}) < 0 THEN 1 ELSE 0 END AS f FROM cs {W_SQL})),
  xl AS (SELECT x.*, lag(end_seq) OVER v AS pe, lag(rank1) OVER v AS pr FROM x WINDOW v AS (PARTITION BY x.entity_id ORDER BY start_seq, end_seq)),
  ch AS (SELECT xl.*, CAST(sum(CASE WHEN start_seq - pe > {P.dead_gap} AND (rank0 - pr) / ((start_seq - pe) / {P.second}) >= 0.5
      AND (a.flips - a.f) - b.flips <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY xl.entity_id ORDER BY start_seq, end_seq) AS BIGINT) AS chain
    FROM xl JOIN fl a ON a.entity_id = xl.entity_id AND a.rk = xl.rank0 LEFT JOIN fl b ON b.entity_id = xl.entity_id AND b.rk = xl.pr),
  pick AS (SELECT entity_id, chain FROM (SELECT entity_id, chain, count(*) AS n FROM ch GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, chain) = 1),
  best AS (SELECT ch.* FROM ch JOIN pick USING (entity_id, chain))"""


def chains(spark, sf, t=None):
    """All crossings and the chained strict ones; the crossing table is small and used
    many times, so its lineage is cut."""
    x = cut_lineage(G.crossings(sliced_track(spark, sf) if t is None else t, P))
    return x, cut_lineage(G.split_chains(x.filter("strict"), P))


@query("chain_split", f"""WITH {TRACK_SQL}, {CHAIN_SQL}
  SELECT entity_id, ch.chain, min(start_seq) AS start_seq, max(end_seq) AS end_seq, count(*) AS n, max(ch.chain = pick.chain) AS picked
  FROM ch JOIN pick USING (entity_id) GROUP BY 1, 2""")
def chain_split(spark, sf):
    _, ch = chains(spark, sf)
    n = ch.groupBy("entity_id", "chain").agg(F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"), F.count("*").alias("n"))
    best = n.groupBy("entity_id").agg(F.max_by("chain", F.struct("n", -F.col("chain"))).alias("_c"))
    return n.join(best, "entity_id").withColumn("picked", F.col("chain") == F.col("_c")).drop("_c")


PARTS_SQL = f"""pt AS (SELECT entity_id, end_seq AS p0, nx AS p1 FROM (SELECT *, lead(start_seq) OVER (PARTITION BY entity_id ORDER BY start_seq, end_seq) AS nx FROM best)
    WHERE nx - end_seq > {P.long_gap}
  UNION ALL SELECT entity_id, f - 1, s FROM (SELECT entity_id, min(start_seq) AS s FROM best GROUP BY 1) JOIN
    (SELECT entity_id, min(seq) AS f FROM t GROUP BY 1) USING (entity_id) WHERE s - (f - 1) > {P.long_gap})"""


def first_seen(spark, sf):
    return track(spark, sf).groupBy("entity_id").agg(F.min("seq").alias("first_seq"))


@query("long_partitions", f"WITH {TRACK_SQL}, {CHAIN_SQL}, {PARTS_SQL} SELECT entity_id, p0, p1 FROM pt")
def long_partitions(spark, sf):
    _, ch = chains(spark, sf)
    return G.long_partitions(G.longest_chain(ch), first_seen(spark, sf), P).select("entity_id", "p0", "p1")


@query("interval_contains", f"""WITH {TRACK_SQL}, {CHAIN_SQL}, {PARTS_SQL}
  SELECT xw.entity_id, start_seq, end_seq, dir FROM xw WHERE EXISTS (SELECT 1 FROM pt WHERE pt.entity_id = xw.entity_id AND p0 < start_seq AND end_seq < p1)""")
def interval_contains(spark, sf):
    x, ch = chains(spark, sf)
    parts = G.long_partitions(G.longest_chain(ch), first_seen(spark, sf), P)
    return (G.inside_partition(x, "start_seq", "end_seq", parts, P)
            .select("entity_id", "start_seq", "end_seq", "dir"))


@query("trailing_event", f"""WITH {TRACK_SQL}, {CHAIN_SQL}, e AS (SELECT entity_id, max(end_seq) AS e FROM best GROUP BY 1)
  SELECT t.entity_id, arg_min(event_id, (seq, event_id)) AS event_id, min(seq) AS seq FROM t JOIN e USING (entity_id)
  WHERE kind = 'purchase' AND seq > e AND seq <= e + {P.recv * 4} GROUP BY 1""")
def trailing_event(spark, sf):
    _, ch = chains(spark, sf)
    end = G.longest_chain(ch).groupBy("entity_id").agg(F.max("end_seq").alias("e"))
    hits = track(spark, sf).filter("kind = 'purchase'")
    after = hits.join(end, "entity_id").filter((F.col("seq") > F.col("e")) & (F.col("seq") <= F.col("e") + P.recv * 4))
    return after.groupBy("entity_id").agg(F.min(F.struct("seq", "event_id")).alias("m")).select(
        "entity_id", F.col("m.event_id").alias("event_id"), F.col("m.seq").alias("seq"))


SETTLE_SQL = f"""st AS (SELECT entity_id, s AS start_seq, count(*) AS n, median(cx) AS mx, median(cy) AS my FROM
    (SELECT entity_id, cx, cy, (seq // {P.settle_step}) * {P.settle_step} - k * {P.settle_step} AS s FROM t, range({P.settle // P.settle_step}) r(k))
    GROUP BY 1, 2 HAVING n >= 2 AND abs(mx - {CENTER_X}) <= 2.5 AND my BETWEEN 5 AND 18)"""


def settled(spark, sf, t=None):
    """Sliding windows in which the entity is tracked and stands inside the band."""
    df = S.spread((track(spark, sf) if t is None else t).select("entity_id", "seq", "event_id", "cx", "cy"), P.settle, P.slice_ms)
    g = whole(df.drop("own"), ["entity_id", "slice"], ["seq", "event_id"], settle_windows, "entity_id long, start_seq long, n long, mx double, my double")
    return g.filter((F.abs(F.col("mx") - CENTER_X) <= 2.5) & F.col("my").between(5, 18))


def settle_windows(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """Windows of two rows or more that start in a group's slice, with the medians of their places."""
    group = np.repeat(np.arange(len(starts)), ends - starts)
    lead = t.column("slice").to_numpy()[starts] * P.slice_ms // P.settle_step            # first window of the slice
    seq, steps = t.column("seq").to_numpy(), P.settle // P.settle_step
    since = seq - lead[group] * P.settle_step
    w = (since // P.settle_step)[:, None] - np.arange(steps)
    inside = (w >= 0) & (w < P.slice_ms // P.settle_step)
    win = np.unique(((group[:, None] << 24) + w)[inside])
    g, w = win >> 24, win & ((1 << 24) - 1)
    key, at = (group << 36) + since + P.settle, (g << 36) + w * P.settle_step + P.settle
    lo, hi = np.searchsorted(key, at), np.searchsorted(key, at + P.settle)
    n = hi - lo
    med = {c: (np.zeros(len(n)), np.zeros(len(n), bool)) for c in ("cx", "cy")}
    for size in np.unique(n[n >= 2]):
        of = np.flatnonzero(n == size)
        for part in np.array_split(of, -(-len(of) * int(size) // (1 << 20))):
            j = lo[part][:, None] + np.arange(size)
            for c, (v, valid) in med.items():
                x, ok = pair(t.column(c))
                v[part], valid[part] = sorted_median(x[j], ok[j], ok[j].sum(1))
    two = n >= 2
    cols = [t.column("entity_id").combine_chunks().take(pa.array(starts[g[two]])), pa.array((lead[g] + w)[two] * P.settle_step), pa.array(n[two].astype(np.int64))]
    return pa.table([*cols, *[pa.array(v[two], mask=~valid[two]) for v, valid in med.values()]], ["entity_id", "start_seq", "n", "mx", "my"])


@query("sliding_settle", f"WITH {TRACK_SQL}, {SETTLE_SQL} SELECT entity_id, min(start_seq) AS start_seq, {q6('arg_min(mx, start_seq)')} AS mx FROM st GROUP BY 1")
def sliding_settle(spark, sf):
    return settled(spark, sf).groupBy("entity_id").agg(F.min("start_seq").alias("start_seq"), r6(F.min_by("mx", "start_seq")).alias("mx"))


TOSS_SQL = """tm AS (SELECT entity_id, median(y) AS m0 FROM t GROUP BY 1),
  tf AS (SELECT t.entity_id, seq, event_id, y FROM t JOIN tm USING (entity_id) WHERE y <= 2 * m0),
  ts AS (SELECT *, first_value(y) OVER full_w AS y0, last_value(y) OVER full_w AS y1,
      list(y) OVER (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l,
      count(*) OVER (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS nb,
      count(*) OVER (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS na FROM tf
      WINDOW full_w AS (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  tk AS (SELECT entity_id, seq, event_id, list_aggregate(l || list_transform(range(2 - nb), lambda i: y0) || list_transform(range(2 - na), lambda i: y1), 'median') AS hh FROM ts),
  tp AS (SELECT entity_id, max(hh) AS peak, median(hh) AS med, arg_min(event_id, (-hh, seq, event_id)) AS event_id, arg_min(seq, (-hh, seq, event_id)) AS seq FROM tk GROUP BY 1)"""


def toss(df):
    """Peak of the median-5 filtered series after dropping samples over twice the median.

    An entity of one slice is looked at whole; the medians of longer ones come from counts of their values."""
    df = df.select("entity_id", "slice", "seq", "event_id", "y").filter(F.col("y").isNotNull())
    if S.one_slice(df):
        return whole(df, ["entity_id"], ["seq", "event_id"], toss_whole, TOSSED)
    many = cut_lineage(df.groupBy("entity_id").agg(F.min("slice").alias("_a"), F.max("slice").alias("_b")).where("_a < _b").select("entity_id"))
    short = whole(df.join(many, "entity_id", "left_anti") if not many.isEmpty() else df, ["entity_id"], ["seq", "event_id"], toss_whole, TOSSED)
    return short if many.isEmpty() else short.unionByName(long_toss(df.join(many, "entity_id", "left_semi")))


TOSSED = "entity_id long, seq long, event_id long, peak_ratio double"


def toss_whole(t: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    def middle(v, starts, ends):
        """The median of each stretch, as `quantiles` interpolates it."""
        group = np.repeat(np.arange(len(starts)), ends - starts)
        v, at = v[np.lexsort((v, group))], (ends - starts - 1) / 2
        lo, hi = v[starts + np.floor(at).astype(np.int64)], v[starts + np.ceil(at).astype(np.int64)]
        return lo + (hi - lo) * (at - np.floor(at))

    y, group = t.column("y").to_numpy(), np.repeat(np.arange(len(starts)), ends - starts)
    kept = np.flatnonzero(y <= 2 * middle(y, starts, ends)[group])
    y, group = y[kept], group[kept]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    if not len(starts):
        return t.slice(0, 0).select(["entity_id", "seq", "event_id"]).append_column("peak_ratio", pa.array([], pa.float64()))
    ends = np.append(starts[1:], len(y))
    first, last = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts) - 1
    near = np.minimum(np.maximum(np.arange(len(y))[:, None] + np.arange(-2, 3), first[:, None]), last[:, None])
    hh = np.sort(y[near], axis=1)[:, 2]
    top, med = np.maximum.reduceat(hh, starts), middle(hh, starts, ends)
    at = np.flatnonzero(hh == np.repeat(top, ends - starts))
    at = at[np.unique(group[at], return_index=True)[1]]                  # the first of equal peaks
    with np.errstate(all="ignore"):
        ratio = top / med
    return t.select(["entity_id", "seq", "event_id"]).take(pa.array(kept[at])).append_column("peak_ratio", pa.array(ratio, mask=med == 0))


def long_toss(df):
    med = quantiles(df, ["entity_id"], "y", {"m0": 0.5}, 10.0).drop("n")
    df = df.join(med, "entity_id").filter(F.col("y") <= 2 * F.col("m0")).drop("m0")
    df = cut_lineage(G.median_filter(df.select("entity_id", "slice", "seq", "event_id", "y"), "y", 5, "hh"))
    peak = df.groupBy("entity_id").agg(F.min(F.struct(-F.col("hh"), "seq", "event_id")).alias("m"), F.max("hh").alias("peak"))
    mid = quantiles(df, ["entity_id"], "hh", {"med": 0.5}, 10.0).drop("n")
    return peak.join(mid, "entity_id").select("entity_id", F.col("m.seq").alias("seq"), F.col("m.event_id").alias("event_id"),
                                              F.try_divide("peak", "med").alias("peak_ratio"))


@query("toss_peak", f"WITH {TRACK_SQL}, {TOSS_SQL} SELECT entity_id, seq, event_id, {q6('peak / med')} AS peak_ratio FROM tp")
def toss_peak(spark, sf):
    return toss(sliced_track(spark, sf)).withColumn("peak_ratio", r6(F.col("peak_ratio")))


FLAG_SQL = f"""f0 AS (SELECT *, CASE WHEN kind IN ('view', 'click') THEN 1 ELSE 0 END AS flag FROM t),
  f1 AS (SELECT *, first_value(flag) OVER a AS ff, last_value(flag) OVER a AS fl, sum(flag) OVER m AS s, count(*) OVER b AS nb, count(*) OVER n AS na FROM f0
    WINDOW a AS (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
      m AS (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING),
      b AS (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
      n AS (PARTITION BY entity_id ORDER BY seq, event_id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
  f2 AS (SELECT *, CASE WHEN (s + (4 - nb) * ff + (4 - na) * fl) * 2 > 9 THEN 1 ELSE 0 END AS on_ FROM f1),
  f3 AS (SELECT *, sum(c) OVER w AS run FROM (SELECT *, CASE WHEN on_ <> coalesce(lag(on_) OVER w, 0) THEN 1 ELSE 0 END AS c FROM f2 {W_SQL}) {W_SQL}),
  f4 AS (SELECT entity_id, run, min(seq) AS a, max(seq) AS b FROM f3 WHERE on_ = 1 GROUP BY 1, 2),
  f5 AS (SELECT *, sum(CASE WHEN pb IS NULL OR a - pb > {P.merge_gap} THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY a) AS seg FROM
    (SELECT *, lag(b) OVER (PARTITION BY entity_id ORDER BY a) AS pb FROM f4)),
  sg AS (SELECT entity_id, CAST(seg AS BIGINT) AS seg, min(a) AS start_seq, max(b) AS end_seq FROM f5 GROUP BY 1, 2 HAVING max(b) - min(a) + {P.frame} >= {P.min_run})"""


def flag_segments(spark, sf):
    return G.smooth_flag_runs(sliced_track(spark, sf), F.col("kind").isin("view", "click"), P)


@query("bool_smooth_runs", f"WITH {TRACK_SQL}, {FLAG_SQL} SELECT entity_id, seg, start_seq, end_seq FROM sg")
def bool_smooth_runs(spark, sf):
    return flag_segments(spark, sf).select("entity_id", "seg", "start_seq", "end_seq")


def in_segments(samples, segs):
    """Samples joined with the (disjoint) segment containing them, by carrying segments."""
    a = samples.select("*", F.lit(1).alias("_k"), F.lit(None).cast("struct<seg:bigint,start_seq:bigint,end_seq:bigint>").alias("_s")).drop("slice")
    b = segs.select("entity_id", F.col("start_seq").alias("seq"), F.lit(-1).cast("long").alias("event_id"), F.lit(0).alias("_k"),
                    F.struct("seg", "start_seq", "end_seq").alias("_s"))
    both = S.derived_slice(a.unionByName(b, allowMissingColumns=True), P.slice_ms)
    both = S.carry(both, {"segm": F.col("_s")}, order=("seq", "_k", "event_id"))
    return both.filter((F.col("_k") == 1) & (F.col("seq") <= F.col("segm.end_seq"))).drop("_k", "_s")


@query("dead_air_drop", f"""WITH {TRACK_SQL}, {FLAG_SQL}
  SELECT s.entity_id, s.start_seq, {q6('coalesce(median(y), 0.0)')} AS motion, {q6('coalesce(avg(CASE WHEN y < 20 THEN 1.0 ELSE 0.0 END), 0.0)')} AS dup_frac,
    coalesce(median(y), 0.0) < 35 AS dropped
  FROM sg s LEFT JOIN t ON t.entity_id = s.entity_id AND t.seq > s.start_seq AND t.seq <= s.end_seq GROUP BY 1, 2""")
def dead_air_drop(spark, sf):
    segs = cut_lineage(flag_segments(spark, sf))
    inside = in_segments(track(spark, sf), segs).filter(F.col("seq") > F.col("segm.start_seq")).select(
        "entity_id", F.col("segm.start_seq").alias("start_seq"), "y")
    med = quantiles(inside, ["entity_id", "start_seq"], "y", {"motion": 0.5}, 10.0).drop("n")
    dup = inside.groupBy("entity_id", "start_seq").agg(ratio(count_if(F.col("y") < 20), F.count("*")).alias("dup_frac"))
    out = segs.select("entity_id", "start_seq").join(med, ["entity_id", "start_seq"], "left").join(dup, ["entity_id", "start_seq"], "left")
    out = out.fillna(0.0, ["motion", "dup_frac"])
    return out.select("entity_id", "start_seq", r6(F.col("motion")).alias("motion"), r6(F.col("dup_frac")).alias("dup_frac"),
                      (F.col("motion") < 35).alias("dropped"))


@query("plateau_collapse", f"""WITH {TRACK_SQL}, c AS (SELECT *, sum(ch) OVER w AS run FROM (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS ch FROM t {W_SQL}) {W_SQL})
  SELECT entity_id, min(seq) AS start_seq, max(seq) AS end_seq, any_value(kind) AS kind, count(*) AS n FROM c GROUP BY entity_id, run HAVING count(*) >= 2""")
def plateau_collapse(spark, sf):
    df = S.adjacent(sliced_track(spark, sf), ["kind"])
    df = S.islands(df, F.col("prev.kind").isNull() | (F.col("prev.kind") != F.col("kind")), "run")
    g = df.groupBy("entity_id", "run", "kind").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n"))
    return g.filter("n >= 2").drop("run")


HORIZON = 40 * HOUR


@query("identity_continuity", f"""WITH {TRACK_SQL}, m AS (SELECT *, median(cx) OVER r AS mx, count(*) OVER r AS n FROM t
    WINDOW r AS (PARTITION BY entity_id ORDER BY seq RANGE BETWEEN {HORIZON} PRECEDING AND {HORIZON} FOLLOWING EXCLUDE CURRENT ROW))
  SELECT entity_id, event_id FROM m WHERE n < 3 OR abs(cx - mx) <= {JUMP_M}""")
def identity_continuity(spark, sf):
    return G.neighbour_filter(track(spark, sf), "cx", JUMP_M, HORIZON, P).select("entity_id", "event_id")


INTERP_SQL = f"""ip AS (SELECT entity_id, f + i AS f, y + (i / greatest(g, 1)) * CASE WHEN i = 0 THEN 0 ELSE ny - y END AS y, i > 0 AS fill FROM
    (SELECT *, unnest(CASE WHEN g > 1 AND g <= 12 THEN range(g) ELSE [0] END) AS i FROM
      (SELECT entity_id, seq // {HOUR} AS f, y, lead(y) OVER w AS ny, coalesce(lead(seq // {HOUR}) OVER w - seq // {HOUR}, 1) AS g FROM src {W_SQL})))"""


@query("gap_interpolate", f"""WITH {TRACK_SQL}, src AS (SELECT * FROM t), {INTERP_SQL} SELECT entity_id, f, {q6('y')} AS y, fill FROM ip""")
def gap_interpolate(spark, sf):
    return G.interpolate(sliced_track(spark, sf), ["y"], HOUR, 12).select("entity_id", "f", r6(F.col("y")).alias("y"), "fill")


def plausible(df, slack: float = 2.0):
    """Samples whose position lies in the half of their side (even group: near)."""
    near = F.col("group_id") % 2 == 0
    ok = F.when(near, F.col("cy").between(NET_Y - slack, COURT_L + 8.0)).otherwise(F.col("cy").between(-8.0, NET_Y + slack))
    return df.filter(F.col("cx").between(-7.0, COURT_W + 7.0) & ok)


HALF_SQL = f"""ph AS (SELECT * FROM t WHERE cx BETWEEN -7.0 AND {COURT_W + 7.0} AND CASE WHEN group_id % 2 = 0
   THEN cy BETWEEN {NET_Y - 2.0} AND {COURT_L + 8.0} ELSE cy BETWEEN -8.0 AND {NET_Y + 2.0} END)"""


@query("clean_track", f"""WITH {TRACK_SQL}, {HALF_SQL}, m AS (SELECT *, median(cx) OVER r AS mx, count(*) OVER r AS n FROM ph
    WINDOW r AS (PARTITION BY entity_id ORDER BY seq RANGE BETWEEN {HORIZON} PRECEDING AND {HORIZON} FOLLOWING EXCLUDE CURRENT ROW)),
  src AS (SELECT * FROM m WHERE n < 3 OR abs(cx - mx) <= {JUMP_M}), {INTERP_SQL}
  SELECT entity_id, f, {q6('y')} AS y, fill FROM ip""")
def clean_track(spark, sf):
    kept = G.neighbour_filter(plausible(track(spark, sf)), "cx", JUMP_M, HORIZON, P)
    return G.interpolate(kept, ["y"], HOUR, 12).select("entity_id", "f", r6(F.col("y")).alias("y"), "fill")


@query("peak_pick_mad")
def peak_pick_mad(spark, sf):
    peaks = G.peaks(sliced_track(spark, sf).select("entity_id", "slice", "seq", "event_id", "y"), "y", 9, 3.0, 3)
    kept = peaks.filter("lone").select("entity_id", "event_id", "seq", "z").unionByName(separate_clusters(peaks.filter("NOT lone"), 3))
    return kept.withColumn("z", r6(F.col("z")))


def separate_peaks(peaks, sep: int):
    """Left to right: a peak closer than `sep` ranks to the last kept one replaces it if higher."""
    df = S.adjacent(peaks, ["rank"])
    return separate_clusters(S.islands(df, F.coalesce(F.col("rank") - F.col("prev.rank") >= sep, F.lit(False)), "cluster"), sep)


def separate_clusters(df, sep: int):
    """The same where peaks closer than `sep` to the one before are known to be of its cluster."""
    from ..operators.fold import fold
    df = df.select("entity_id", "cluster", "seq", "event_id", "rank", "z")

    def emit(state):
        return [(r.entity_id, r.event_id, r.seq, r.z) for r in state]

    def step(state, row):
        if state and row.rank - state[0].rank < sep:
            if row.z > state[0].z:
                state[0] = row
            return []
        out = emit(state)
        state[:] = [row]
        return out

    return fold(df, ["entity_id", "cluster"], ["seq", "event_id"], list, step,
                "entity_id long, event_id long, seq long, z double", emit)


@query("events_in_holes", f"""WITH {TRACK_SQL}, o AS (SELECT *, max(CASE WHEN kind <> 'click' THEN seq END) OVER (w ROWS UNBOUNDED PRECEDING) AS a,
     min(CASE WHEN kind <> 'click' THEN seq END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM t {W_SQL})
  SELECT entity_id, count(*) AS n_inside, count(DISTINCT a) AS n_holes
  FROM o WHERE kind = 'click' AND b - a > {P.hole} GROUP BY 1""")
def events_in_holes(spark, sf):
    df = sliced_track(spark, sf)
    seen = F.when(F.col("kind") != "click", F.col("seq"))
    df = S.carry(S.carry(df, {"a": seen}), {"b": seen}, forward=False)
    inside = df.filter((F.col("kind") == "click") & (F.col("b") - F.col("a") > P.hole))
    per_hole = inside.groupBy("entity_id", "a").agg(F.count("*").alias("n"))
    return per_hole.groupBy("entity_id").agg(F.sum("n").alias("n_inside"), F.count("*").alias("n_holes"))


# ---- intervals between hits ('purchase'), landings ('view') ----

def is_hit():
    return F.col("kind") == "purchase"


def hit_frames(spark, sf, t=None):
    """Track rows with the hit at or before them, the next hit after, and the next landing."""
    df = sliced_track(spark, sf) if t is None else t
    df = S.carry(df, {"hit": F.when(is_hit(), F.struct("seq", "event_id", "cx", "cy"))})
    df = S.carry(df, {"nxt": F.when(is_hit(), F.struct("seq", "event_id", "cx", "cy")),
                      "land": F.when(F.col("kind") == "view", F.struct("seq", "event_id", "cx", "cy"))}, forward=False, inclusive=False)
    return df


HITS_SQL = f"""hf AS (SELECT *, max(CASE WHEN kind = 'purchase' THEN rk END) OVER (w ROWS UNBOUNDED PRECEDING) AS hit_rk,
    min(CASE WHEN kind = 'purchase' THEN rk END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt_rk,
    min(CASE WHEN kind = 'view' THEN rk END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS land_rk
  FROM (SELECT *, row_number() OVER w AS rk FROM t {W_SQL}) {W_SQL})"""


@query("interval_first_after", f"""WITH {TRACK_SQL}, {HITS_SQL} SELECT h.entity_id, h.event_id, l.event_id AS landing_id, {q6('l.cx')} AS landing_x
  FROM hf h JOIN hf l ON l.entity_id = h.entity_id AND l.rk = h.land_rk WHERE h.kind = 'purchase' AND (h.nxt_rk IS NULL OR h.land_rk < h.nxt_rk)""")
def interval_first_after(spark, sf):
    df = hit_frames(spark, sf).filter(is_hit() & F.col("land").isNotNull())
    first = F.col("nxt").isNull() | (F.struct("land.seq", "land.event_id") < F.struct("nxt.seq", "nxt.event_id"))
    return df.filter(first).select("entity_id", "event_id", F.col("land.event_id").alias("landing_id"), r6(F.col("land.cx")).alias("landing_x"))


@query("interval_overlap", f"""WITH {TRACK_SQL}, {HOLES_SQL}, ht AS (SELECT entity_id, event_id, seq, lead(seq) OVER w AS nx FROM t WHERE kind = 'purchase' {W_SQL})
  SELECT entity_id, event_id, EXISTS (SELECT 1 FROM h WHERE h.entity_id = ht.entity_id AND start_seq < nx AND end_seq > seq) AS flip_slot FROM ht WHERE nx IS NOT NULL""")
def interval_overlap(spark, sf):
    df = S.adjacent(sliced_track(spark, sf), ["seq"])
    closed = F.coalesce(F.col("seq") - F.col("prev.seq") > P.hole, F.lit(False))
    df = S.running_sum(df.drop("next"), {"holes": closed.cast("int")}).drop("prev").filter(is_hit())
    df = S.adjacent(df, ["holes"])
    return df.filter(F.col("next").isNotNull()).select("entity_id", "event_id", (F.col("next.holes") > F.col("holes")).alias("flip_slot"))


def digit(x, near):
    """Thirds of the width, mirrored for a near receiver: '1', '2' or '3'."""
    z = F.when(x < COURT_W / 3, 0).when(x < 2 * COURT_W / 3, 1).otherwise(2)
    return (F.when(near, 2 - z).otherwise(z) + 1).cast("string")


def digit_sql(x: str, near: str) -> str:
    z = f"CASE WHEN {x} < {COURT_W / 3} THEN 0 WHEN {x} < {2 * COURT_W / 3} THEN 1 ELSE 2 END"
    return f"CAST(CASE WHEN {near} THEN 2 - ({z}) ELSE {z} END + 1 AS VARCHAR)"


def first_passes(df):
    """First level pass after each hit and before the next: the pivot edge of its segment."""
    df = df.filter(F.col("hit").isNotNull())
    df = S.adjacent(df, ["cy", "cx", "seq", "event_id", "hit"])
    inside = (F.col("event_id") != F.col("hit.event_id")) & (F.col("next.hit.event_id") == F.col("hit.event_id"))
    flip = F.signum(F.col("cy") - NET_Y) * F.signum(F.col("next.cy") - NET_Y) < 0
    return df.withColumn("pass_", inside & flip)


@query("crossing_extrapolate", f"""WITH {TRACK_SQL}, {HITS_SQL},
  s AS (SELECT *, lead(cy) OVER w AS ny, lead(cx) OVER w AS nx, lead(hit_rk) OVER w AS nh,
      sum(CASE WHEN abs(cy - {NET_Y}) <= 5 THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS out_ FROM hf WHERE hit_rk IS NOT NULL {W_SQL}),
  pv AS (SELECT entity_id, hit_rk, arg_min(rk, rk) AS i, arg_min(cy, rk) AS ya, arg_min(ny, rk) AS yb, arg_min(cx, rk) AS xa, arg_min(nx, rk) AS xb FROM s
    WHERE rk <> hit_rk AND nh = hit_rk AND sign(cy - {NET_Y}) * sign(ny - {NET_Y}) < 0 GROUP BY 1, 2),
  o AS (SELECT pv.*, a.out_ AS oi1, b.out_ AS oi2, a.out_ - CASE WHEN abs(a.cy - {NET_Y}) <= 5 THEN 0 ELSE 1 END AS oib FROM pv
    JOIN s a ON a.entity_id = pv.entity_id AND a.rk = pv.i JOIN s b ON b.entity_id = pv.entity_id AND b.rk = pv.i + 1),
  r AS (SELECT o.entity_id, o.hit_rk, count(*) AS n, regr_slope(s.cx, s.cy) AS slope, abs(arg_max(s.cy, s.rk) - arg_min(s.cy, s.rk)) AS dy, any_value(ya) AS ya, any_value(yb) AS yb, any_value(xa) AS xa, any_value(xb) AS xb
    FROM o JOIN s ON s.entity_id = o.entity_id AND s.hit_rk = o.hit_rk AND s.rk <> s.hit_rk AND
      (s.rk IN (i, i + 1) OR (s.rk < i AND oib - (s.out_ - CASE WHEN abs(s.cy - {NET_Y}) <= 5 THEN 0 ELSE 1 END) = 0) OR (s.rk > i + 1 AND s.out_ - oi2 = 0)) GROUP BY 1, 2)
  SELECT r.entity_id, h.event_id, {q6(f"xa + ({NET_Y} - ya) / (yb - ya) * (xb - xa) + slope * CASE WHEN yb > ya THEN {NET_Y} ELSE -{NET_Y} END", 4)} AS x,
    CASE WHEN yb > ya THEN 'near' ELSE 'far' END AS receiver FROM r JOIN hf h ON h.entity_id = r.entity_id AND h.rk = r.hit_rk WHERE n >= 3 AND dy >= 1e-6""")
def crossing_extrapolate(spark, sf):
    return pass_signal(hit_frames(spark, sf)).select("entity_id", "event_id", r6(F.col("x"), 4).alias("x"), "receiver")


def pass_signal(df):
    """x at the level plus local slope times depth, from the first pass after each hit.

    The slope is fitted on the samples around the pass that stay within 5 m of the
    level without a break: prefix counts of out-of-band samples tell a break apart.
    """
    df = first_passes(df.drop("nxt", "land"))
    out = F.when(F.abs(F.col("cy") - NET_Y) <= 5, 0).otherwise(1)
    df = S.running_sum(df.withColumn("o", out), {"outs": F.col("o"), "rank": F.lit(1)})
    df = df.withColumn("hit_id", F.col("hit.event_id"))
    edge = F.struct("rank", "outs", F.col("o"), F.col("next.cy").alias("yb"), F.col("next.cx").alias("xb"), F.col("cy").alias("ya"), F.col("cx").alias("xa"))
    pivot = (df.filter("pass_").groupBy("entity_id", "hit_id").agg(F.min(edge).alias("p")))
    body = df.filter(F.col("event_id") != F.col("hit_id")).select("entity_id", "hit_id", "rank", "outs", "o", "cx", "cy")
    j = body.join(pivot, ["entity_id", "hit_id"])
    i, at_next = F.col("p.rank"), F.col("p.outs") + F.when(F.abs(F.col("p.yb") - NET_Y) <= 5, 0).otherwise(1)
    before = (F.col("rank") < i) & (F.col("p.outs") - F.col("p.o") - (F.col("outs") - F.col("o")) == 0)
    after = (F.col("rank") > i + 1) & (F.col("outs") - at_next == 0)
    fit = j.filter((F.col("rank") == i) | (F.col("rank") == i + 1) | before | after).groupBy("entity_id", "hit_id").agg(
        F.count("*").alias("n"), F.regr_slope("cx", "cy").alias("slope"), F.max("p").alias("p"),
        F.max_by("cy", "rank").alias("y1"), F.min_by("cy", "rank").alias("y0"))
    up = F.col("p.yb") > F.col("p.ya")
    t = (NET_Y - F.col("p.ya")) / (F.col("p.yb") - F.col("p.ya"))
    x = F.col("p.xa") + t * (F.col("p.xb") - F.col("p.xa")) + F.col("slope") * F.when(up, NET_Y).otherwise(-NET_Y)
    return fit.filter((F.col("n") >= 3) & (F.abs(F.col("y1") - F.col("y0")) >= 1e-6)).select(
        "entity_id", F.col("hit_id").alias("event_id"), x.alias("x"), F.when(up, "near").otherwise("far").alias("receiver"))
