"""Trajectory operators over irregular samples of an entity, sliced by time."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import array_median
from ..presets import NET_Y, TRACK, Track
from ..session import cut_lineage
from . import slices as S
from .stencil import Find, Rows, ge, gt, pair, several, sorted_median, stencil, whole

ID = ("group_id", "entity_id", "seq", "event_id", "slice")


def smooth3(df: DataFrame, col: str, out: str) -> DataFrame:
    """Three-sample mean, the end samples replicated."""
    df = S.adjacent(df, [col])
    return (df.withColumn(out, (F.coalesce(F.col(f"prev.{col}"), F.col(col)) + F.col(col)
                                + F.coalesce(F.col(f"next.{col}"), F.col(col))) / 3)
            .drop("prev", "next"))


def gradient(df: DataFrame, col: str, out: str, unit: int) -> DataFrame:
    """Derivative on irregular spacing: second order inside, one-sided at the ends."""
    df = S.adjacent(df, [col, "seq"])
    f, fp, fn = F.col(col), F.col(f"prev.{col}"), F.col(f"next.{col}")
    hs = (F.col("seq") - F.col("prev.seq")) / unit
    hd = (F.col("next.seq") - F.col("seq")) / unit
    inner = F.try_divide(hs * hs * fn + (hd * hd - hs * hs) * f - hd * hd * fp, hs * hd * (hs + hd))
    return (df.withColumn(out, F.when(F.col("prev").isNull(), F.try_divide(fn - f, hd))
                          .when(F.col("next").isNull(), F.try_divide(f - fp, hs)).otherwise(inner))
            .withColumn("inner", F.col("prev").isNotNull() & F.col("next").isNotNull())
            .drop("prev", "next"))


def gaps(df: DataFrame, longer_than: int) -> DataFrame:
    """Holes: consecutive samples more than `longer_than` apart."""
    df = S.adjacent(df.select(*ID), ["seq"])
    return (df.filter(F.col("next.seq") - F.col("seq") > longer_than)
            .select("group_id", "entity_id", F.col("seq").alias("start_seq"), F.col("next.seq").alias("end_seq")))


def _cusp_rows(r: Rows, near: float, far: float, far_y: float):
    """Indices of the cusps among the rows to answer for, their swing and straddle."""
    y = r.col("y")
    ys = r.mean3(y)
    seq = (r.seq, np.ones(r.n, bool))
    slope = r.slope(ys, 3_600_000)
    (v0, ok0), _ = r.at(slope, -1)
    (v1, ok1), _ = r.at(slope, 1)
    inside = r.mine & (r.i - r.first >= 2) & (r.end - r.i > 2)
    need = np.where(ys[1] & ge(ys[0], far_y), near, far)
    with np.errstate(all="ignore"):
        swing = v0 - v1
    at = np.flatnonzero(inside & ok0 & ok1 & gt(v0, 0.0) & (v1 < 0) & ge(swing, need))
    return at, swing[at], r.at(seq, 1)[0][0][at] - r.at(seq, -1)[0][0][at]


def _sure(v):
    return v, np.ones(len(v), bool)


def cusps(df: DataFrame, p: Track, near: float, far: float, far_y: float) -> DataFrame:
    """Samples where the derivative of the smoothed signal flips from + to -."""
    return stencil(df, *_find_cusps(near, far, far_y))


def _find_cusps(near: float, far: float, far_y: float) -> Find:
    def find(r: Rows):
        at, swing, straddle = _cusp_rows(r, near, far, far_y)
        return at, {"straddle": _sure(straddle), "swing": _sure(swing)}

    return Find(4, find, {"straddle": "long", "swing": "double"})


def _speeds(r: Rows, at: np.ndarray, k: int) -> dict:
    """Medians `mb` and `ma` of the depth speeds of up to k samples before and after, and `nb`, `na`, how many there were."""
    v = r.slope(r.col("cy"), TRACK.second)
    mb, okb, nb = r.median(v, at, -k, -1)
    ma, oka, na = r.median(v, at, 1, k)
    return {"nb": _sure(nb.astype(np.int32)), "na": _sure(na.astype(np.int32)), "mb": (mb, okb), "ma": (ma, oka)}


SPEEDS = {"nb": "integer", "na": "integer", "mb": "double", "ma": "double"}


def collapses(df: DataFrame, ratio: float = 3.0, floor: float = 0.3, k: int = 6) -> DataFrame:
    """Far-half samples whose speed collapses: medians of k before and k after."""
    return stencil(df, *_find_collapses(k)).filter(_collapsed(ratio, floor))


def _find_collapses(k: int) -> Find:
    def find(r: Rows):
        cy, ok = r.col("cy")
        at = np.flatnonzero(r.mine & ok & (cy <= NET_Y) & (r.i - r.first >= k) & (r.end - r.i > k))
        return at, _speeds(r, at, k)

    return Find(k + 2, find, SPEEDS)


def _collapsed(ratio: float, floor: float) -> Column:
    same = F.signum("mb") == F.signum("ma")
    return same & (F.abs("ma") > floor) & (F.try_divide(F.abs("mb"), F.abs("ma")) >= ratio)


def _with_class(df: DataFrame, fast: float) -> DataFrame:
    return df.withColumn("cls", F.when(F.abs("ma") > fast, "hit").otherwise("bounce"))


def classify(df: DataFrame, fast: float = 4.5) -> DataFrame:
    """Adds `ma`, the median speed after the sample, and `cls`: hit when fast, else bounce."""
    def find(r: Rows):
        at = np.flatnonzero(r.mine)
        return at, _speeds(r, at, 6)

    return _with_class(stencil(df, 8, find, SPEEDS), fast)


def classified_cusps(df: DataFrame, near: float, far: float, far_y: float, fast: float = 4.5) -> DataFrame:
    """Cusps with their class; speeds are taken around cusps only."""
    return _with_class(stencil(df, *_find_classified(near, far, far_y)), fast)


def _find_classified(near: float, far: float, far_y: float) -> Find:
    def find(r: Rows):
        at, swing, straddle = _cusp_rows(r, near, far, far_y)
        return at, {"straddle": _sure(straddle), "swing": _sure(swing), **_speeds(r, at, 6)}

    return Find(8, find, {"straddle": "long", "swing": "double", **SPEEDS})


def cusps_and_collapses(df: DataFrame, near: float, far: float, far_y: float) -> tuple[DataFrame, DataFrame]:
    """`cusps` and `collapses` of one pass."""
    cu, co = several(df, [_find_cusps(near, far, far_y), _find_collapses(6)])
    return cu, co.filter(_collapsed(3.0, 0.3))


def detectors(df: DataFrame, p: Track, near: float, far: float, far_y: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`crossings`, `classified_cusps` and `collapses` of one pass."""
    runs, cu, co = several(df, [_find_crossings(p), _find_classified(near, far, far_y), _find_collapses(6)])
    return _crossings(runs, p), _with_class(cu, 4.5), co.filter(_collapsed(3.0, 0.3))


def crossings(df: DataFrame, p: Track) -> DataFrame:
    """Maximal monotone runs of the smoothed depth through the level, gated by span, speed and steps.

    Runs are islands over edges to the next sample, so neighbouring runs may share an end sample. `strict`
    tells the runs that also pass the span cap, sample floor and speed cap. `rank*` and
    `flips*` are prefix counts of samples and of level passes at the two ends (gap evidence).
    A row of the first step is a run, or the part of one that a stretch of rows holds.
    """
    return _crossings(stencil(df.select(*ID, "cy"), *_find_crossings(p)), p)


def _find_crossings(p: Track) -> Find:
    def find(r: Rows):
        cs, ok = r.mean3(r.col("cy"))
        (ncs, okn), there = r.at((cs, ok), 1)
        gap = r.seq[np.where(there, r.i + 1, r.i)] - r.seq
        with np.errstate(all="ignore"):
            rise, side = ncs - cs, np.sign(cs - NET_Y)
            # runs that touch a NaN fail the step gate
            d = np.where(there & (gap <= p.cross_gap) & ok & okn, np.where(np.isnan(rise), 2, np.sign(rise)), 0).astype(np.int8)
            (before, okb), _ = r.at((side, ok), -1)
            flip = np.where(ok & okb & (side * before < 0), 1, 0)
            step = np.abs(rise) / np.maximum(gap / p.frame, 1.0)
        (dp, okd), _ = r.at((d, np.ones(r.n, bool)), -1)
        turn = d != np.where(okd, dp, 0)
        c = r.sums(run=turn, rank=np.ones(r.n), flips=flip)
        on = np.flatnonzero(r.mine & (np.abs(d) == 1))
        new = np.ones(len(on), bool)
        new[1:] = (c["run"][on[1:]] != c["run"][on[:-1]]) | (r.first[on[1:]] != r.first[on[:-1]])
        heads = np.flatnonzero(new)
        a, z = on[heads], on[np.append(heads[1:], len(on)) - 1] if len(on) else on
        edges = np.diff(np.append(heads, len(on)))
        steep = np.maximum.reduceat(step[on], heads) if len(on) else step[:0]
        (ends, oke), _ = r.at((turn, np.ones(r.n, bool)), 1)
        short = turn[a] & (ends[z] | ~oke[z]) & (edges + 1 < p.cross_samples_weak)        # a whole run
        keep = ~short
        a, z, edges, steep = a[keep], z[keep], edges[keep], steep[keep]
        nxt = r.seq[np.minimum(z + 1, r.n - 1)] if r.n else r.seq
        (next_flip, okf), _ = r.at((flip, np.ones(r.n, bool)), 1)
        return a, {"run": _sure(c["run"][a]), "start_seq": _sure(r.seq[a]), "end_seq": _sure(nxt), "dir": _sure(d[a].astype(np.int32)), "c0": _sure(cs[a]), "c1": _sure(ncs[z]),
                   "rank0": _sure(c["rank"][a]), "rank1": _sure(c["rank"][z] + 1), "flips0": _sure(c["flips"][a] - flip[a]),
                   "flips1": _sure(c["flips"][z] + np.where(okf, next_flip, 0)[z]), "max_step": _sure(steep), "edges": _sure(edges.astype(np.int64))}

    return Find(4, find, {
        "run": "long", "start_seq": "long", "end_seq": "long", "dir": "integer", "c0": "double", "c1": "double", "rank0": "long", "rank1": "long", "flips0": "long", "flips1": "long",
        "max_step": "double", "edges": "long"}, {"run": "run", "rank0": "rank", "rank1": "rank", "flips0": "flips", "flips1": "flips"})


def _crossings(parts: DataFrame, p: Track) -> DataFrame:
    runs = parts.groupBy("group_id", "entity_id", "run").agg(
        F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"), F.max("dir").alias("dir"), F.min_by("c0", "rank0").alias("c0"), F.max_by("c1", "rank1").alias("c1"),
        F.min("rank0").alias("rank0"), F.max("rank1").alias("rank1"), F.min("flips0").alias("flips0"), F.max("flips1").alias("flips1"),
        F.max("max_step").alias("max_step"), F.sum("edges").alias("edges"))
    span = F.abs(F.col("c1") - F.col("c0"))
    dur = (F.col("end_seq") - F.col("start_seq")) / p.second
    lo, hi = F.least("c0", "c1"), F.greatest("c0", "c1")
    speed = F.try_divide(span, dur)
    weak = ((F.col("edges") + 1 >= p.cross_samples_weak) & (span >= p.cross_span_min)
            & (lo < NET_Y - 1) & (hi > NET_Y + 1) & (dur > 0)
            & (speed >= p.cross_speed_min) & (F.col("max_step") <= p.cross_max_step))
    strict = ((F.col("edges") + 1 >= p.cross_samples) & (span <= p.cross_span_max) & (speed <= p.cross_speed_max))
    return runs.filter(weak).select(
        "group_id", "entity_id", "start_seq", "end_seq", "dir",
        "rank0", "rank1", "flips0", "flips1", strict.alias("strict"))


ROW = ("group_id", "entity_id", "start_seq", "end_seq")
BY_START = dict(order=("start_seq", "end_seq"))


def split_chains(cross: DataFrame, p: Track, coverage: float = 0.5) -> DataFrame:
    """Chain id per crossing: a new chain starts after a dead gap that was sampled well
    enough to be evidence and in which the level was never passed."""
    df = S.derived_slice(cross, p.slice_ms, "start_seq")
    df = S.adjacent(df, ["end_seq", "rank1", "flips1"], **BY_START)
    gap = F.col("start_seq") - F.col("prev.end_seq")
    seen = (F.col("rank0") - F.col("prev.rank1")) / (gap / p.second)
    dead = (gap > p.dead_gap) & (seen >= coverage) & (F.col("flips0") - F.col("prev.flips1") <= 0)
    return S.islands(df.drop("next"), F.coalesce(dead, F.lit(False)), "chain", **BY_START).drop("prev")


def longest_chain(chained: DataFrame) -> DataFrame:
    """The chain with most crossings of each entity, the first one on a tie."""
    n = chained.groupBy("entity_id", "chain").agg(F.count("*").alias("n"))
    best = n.groupBy("entity_id").agg(F.max_by("chain", F.struct("n", -F.col("chain"))).alias("chain"))
    return chained.join(best, ["entity_id", "chain"])


def long_partitions(chain: DataFrame, first_seen: DataFrame, p: Track) -> DataFrame:
    """Over-long gaps inside a chain, and the stretch before its first crossing."""
    df = S.adjacent(S.derived_slice(chain, p.slice_ms, "start_seq"), ["start_seq"], **BY_START)
    inner = (df.filter(F.col("next.start_seq") - F.col("end_seq") > p.long_gap)
             .select("group_id", "entity_id", F.col("end_seq").alias("p0"), F.col("next.start_seq").alias("p1")))
    head = chain.groupBy("group_id", "entity_id").agg(F.min("start_seq").alias("p1"))
    front = (head.join(first_seen, "entity_id").withColumn("p0", F.col("first_seq") - 1)
             .filter(F.col("p1") - F.col("p0") > p.long_gap))
    return inner.unionByName(front.select("group_id", "entity_id", "p0", "p1"))


def inside_partition(rows: DataFrame, at: str, until: str, parts: DataFrame, p: Track) -> DataFrame:
    """Rows [at, until] strictly inside one of the (disjoint) partitions.

    The partitions are spliced into the row stream and carried forward, so no range
    join is needed however long they are.
    """
    a = rows.drop("slice").select("*", F.col(at).alias("_at"), F.lit(0).alias("_side"),
                    F.lit(None).cast("struct<p0:bigint,p1:bigint>").alias("_part"))
    b = parts.select("entity_id", F.col("p0").alias("_at"), F.lit(1).alias("_side"),
                     F.struct("p0", "p1").alias("_part"))
    both = S.derived_slice(a.unionByName(b, allowMissingColumns=True), p.slice_ms, "_at")
    both = S.carry(both, {"_in": F.col("_part")}, order=("_at", "_side"))
    return (both.filter((F.col("_side") == 0) & (F.col("_in.p0") < F.col(at)) & (F.col(until) < F.col("_in.p1")))
            .drop("_at", "_side", "_part", "_in", "slice"))


def smooth_flag_runs(df: DataFrame, flag: Column, p: Track, k: int = 9) -> DataFrame:
    """Rolling median of a flag, runs of true, small gaps merged, short runs dropped."""
    h = k // 2

    def find(r: Rows):
        f = r.col("flag")[0].astype(np.int64)
        # end flags are replicated
        votes = sum(f[np.minimum(np.maximum(r.i + d, r.first), r.end - 1)] for d in range(-h, h + 1))
        on = votes * 2 > k
        (was, okw), _ = r.at((on, on), -1)
        was = was & okw
        held = np.flatnonzero(r.mine & on)
        new = np.ones(len(held), bool)
        new[1:] = (np.diff(held) != 1) | (r.first[held[1:]] != r.first[held[:-1]])
        heads = np.flatnonzero(new)
        a, z = held[heads], held[np.append(heads[1:], len(held)) - 1] if len(held) else held
        return a, {"start_seq": _sure(r.seq[a]), "end_seq": _sure(r.seq[z]), "more": _sure(was[a])}

    flags = df.select(*ID, F.coalesce(flag, F.lit(False)).cast("int").alias("flag"))
    runs = stencil(flags, h + 2, find, {"start_seq": "long", "end_seq": "long", "more": "boolean"})
    return merge_runs(cut_lineage(runs.select("group_id", "entity_id", "start_seq", "end_seq", F.col("event_id").alias("start_id"), "more")), p)


def merge_runs(runs: DataFrame, p: Track) -> DataFrame:
    """Joins runs at most `merge_gap` apart, and those that go on (`more`) where a stretch of rows ended, then keeps those of at least `min_run`."""
    order = dict(order=("start_seq", "start_id"))
    runs = S.adjacent(S.derived_slice(runs, p.slice_ms, "start_seq"), ["end_seq"], **order)
    far = F.coalesce(F.col("start_seq") - F.col("prev.end_seq") > p.merge_gap, F.lit(True)) & ~F.col("more")
    runs = S.islands(runs, far, "seg", **order)
    segs = (runs.groupBy("group_id", "entity_id", "seg")
            .agg(F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq")))
    return segs.filter(F.col("end_seq") - F.col("start_seq") + p.frame >= p.min_run)


def neighbour_filter(df: DataFrame, col: str, radius: float, horizon: int, p: Track,
                     at_least: int = 3) -> DataFrame:
    """Drops samples far from the median of the other samples within the horizon."""
    near = S.spread(df.drop("slice"), horizon, p.slice_ms)
    w = Window.partitionBy("entity_id", "slice").orderBy("seq").rangeBetween(-horizon, horizon)
    near = near.withColumn("_nb", F.collect_list(F.struct("event_id", F.col(col).alias("v"))).over(w)).filter("own")
    others = F.transform(F.filter("_nb", lambda s: s["event_id"] != F.col("event_id")), lambda s: s["v"])
    near = near.withColumn("_nb", others)
    far = (F.size("_nb") >= at_least) & (F.abs(F.col(col) - array_median(F.col("_nb"))) > radius)
    return near.filter(~far).drop("_nb", "own")


def interpolate(df: DataFrame, cols: list[str], unit: int, max_gap: int) -> DataFrame:
    """Linear fill of gaps of 2..max_gap grid steps; original samples keep fill = false."""
    df = df.withColumn("f", F.floor(F.col("seq") / unit).cast("long"))
    df = S.adjacent(df, ["f", *cols])
    gap = F.col("next.f") - F.col("f")
    steps = F.when((gap > 1) & (gap <= max_gap), F.sequence(F.lit(0).cast("long"), gap - 1)).otherwise(
        F.array(F.lit(0).cast("long")))
    df = df.withColumn("_gap", gap).withColumn("_i", F.explode(steps))
    t = F.col("_i") / F.col("_gap")
    for c in cols:
        df = df.withColumn(c, F.when(F.col("_i") == 0, F.col(c)).otherwise(F.col(c) + t * (F.col(f"next.{c}") - F.col(c))))
    return df.select("group_id", "entity_id", (F.col("f") + F.col("_i")).alias("f"), *cols,
                     (F.col("_i") > 0).alias("fill"))


def median_filter(df: DataFrame, col: str, k: int, out: str) -> DataFrame:
    """Median over k edge-replicated rows."""
    h = k // 2

    def find(r: Rows):
        v, ok = r.col(col)
        at = np.flatnonzero(r.mine)
        j = at[:, None] + np.arange(-h, h + 1)
        j = np.minimum(np.maximum(j, r.first[at][:, None]), r.end[at][:, None] - 1)
        return at, {out: sorted_median(v[j], ok[j], np.full(len(at), k))}

    return stencil(df, h + 1, find, {out: "double"})


def peaks(df: DataFrame, col: str, k: int, least: float, sep: int = 3) -> DataFrame:
    """Rows whose z = (value - window median) / (window MAD + 1e-6) over k edge-replicated rows is `least` or more and not
    below either neighbour's, with `z` and the row's `rank` in the entity. Peaks less than `sep` ranks after the one before are of its
    `cluster`; those that are `lone` have no other in theirs."""
    h = k // 2

    def find(r: Rows):
        v, ok = r.col(col)
        all_ = np.full(r.n, k)
        j = r.i[:, None] + np.arange(-h, h + 1)
        j = np.minimum(np.maximum(j, r.first[:, None]), r.end[:, None] - 1)
        m, okm = sorted_median(v[j], ok[j], all_)
        with np.errstate(all="ignore"):
            mad, okd = sorted_median(np.abs(v[j] - m[:, None]), ok[j] & okm[:, None], all_)
            z = (v - m) / (mad + 1e-6), ok & okm & okd
        (before, okb), _ = r.at(z, -1)
        (after, oka), _ = r.at(z, 1)
        peak = z[1] & okb & oka & ge(z[0], least) & ge(z[0], before) & ge(z[0], after)
        back, on = (np.any([r.at((peak, peak), d)[0][1] for d in side], axis=0) for side in (range(1 - sep, 0), range(1, sep)))
        c = r.sums(rank=np.ones(r.n), cluster=peak & ~back)
        at = np.flatnonzero(r.mine & peak)
        return at, {"z": _sure(z[0][at]), "rank": _sure(c["rank"][at]), "cluster": _sure(c["cluster"][at]), "lone": _sure(~(back | on)[at])}

    return stencil(df, h + sep + 1, find, {"z": "double", "rank": "long", "cluster": "long", "lone": "boolean"}, {"rank": "rank", "cluster": "cluster"})


SUPPRESS_ROUNDS = 12


def suppress(cand: DataFrame, min_gap: int, p: Track, report: list | None = None) -> DataFrame:
    """Strongest-first suppression: keep a candidate when no kept one is within min_gap. Ties go by seq, then event_id.

    A candidate that is stronger than all undecided ones within the gap is kept whatever happens elsewhere, and takes out those
    within the gap. Two candidates of one bucket of min_gap are always within it, so each round looks at the strongest of every
    bucket: where it beats the strongest of both neighbours it is kept. All buckets of all entities go at once, and the strongest undecided
    one of an entity always wins, so rounds are few (about the logarithm of the candidates) unless strengths rise steadily over
    many buckets; what such ramps leave open after SUPPRESS_ROUNDS is folded by cluster. report takes the undecided rows before each round.
    Where no entity is long, each is looked at whole (`suppress_whole`).
    """
    if S.short_keys(cand):
        few = cand.select("entity_id", "seq", "event_id", F.col("strength").cast("double").alias("strength"))
        return whole(few, ["entity_id"], ["seq", "event_id"], lambda t, starts, ends: suppress_whole(t, starts, min_gap), few.schema)
    rows = cand.select("entity_id", "seq", "event_id", F.col("strength").cast("double").alias("strength"), F.floor(F.col("seq") / F.lit(min_gap)).cast("long").alias("b"))
    open_, kept = cut_lineage(rows), None
    around = F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))
    for _ in range(SUPPRESS_ROUNDS):
        n = open_.count()
        if not n:
            break
        if report is not None:
            report.append(n)
        top = open_.groupBy("entity_id", "b").agg(F.max(F.struct("strength", (-F.col("seq")).alias("s"), (-F.col("event_id")).alias("e"))).alias("top"))
        seen = top.select("entity_id", "b", "top", around.alias("at")).groupBy("entity_id", "at").agg(
            F.max(F.when(F.col("at") == F.col("b"), F.col("top"))).alias("own"), F.max(F.when(F.col("at") != F.col("b"), F.col("top"))).alias("other"))
        wins = seen.where(F.col("own").isNotNull() & (F.col("other").isNull() | (F.col("own") > F.col("other"))))
        wins = cut_lineage(wins.select("entity_id", (-F.col("own.s")).alias("seq"), (-F.col("own.e")).alias("event_id"), "own.strength", F.col("at").alias("b")))
        near = wins.select("entity_id", F.col("seq").alias("w"), around.alias("b")).groupBy("entity_id", "b").agg(F.collect_list("w").alias("wins"))   # three at most
        left = open_.join(near, ["entity_id", "b"], "left").where(F.col("wins").isNull() | ~F.exists("wins", lambda w: F.abs(w - F.col("seq")) < min_gap))
        open_ = cut_lineage(left.drop("wins"))
        kept = wins.drop("b") if kept is None else kept.union(wins.drop("b"))
    if kept is None:
        return rows.drop("b")
    return kept if open_.isEmpty() else kept.union(_suppress_clusters(open_.drop("b"), min_gap, p))


def suppress_whole(t: pa.Table, starts: np.ndarray, min_gap: int) -> pa.Table:
    """The same of sorted rows of whole entities: strongest first, each takes out the rows within the gap."""
    step = np.minimum(np.diff(t.column("seq").to_numpy(), prepend=0), min_gap)
    step[starts] = min_gap                                  # wider steps and other entities are out of reach alike
    at = np.cumsum(step)
    lo, hi = np.searchsorted(at, at - min_gap, side="right").tolist(), np.searchsorted(at, at + min_gap).tolist()
    v, ok = pair(t.column("strength"))
    kept, gone = [], bytearray(len(at))
    for i in np.lexsort((np.arange(len(at)), -v, ~np.isnan(v), ~ok)).tolist():     # NaN is the largest number; ties go by seq, then event_id
        if not gone[i]:
            kept.append(i)
            gone[lo[i]:hi[i]] = b"\1" * (hi[i] - lo[i])
    return t.take(pa.array(kept, pa.int64()))


def _suppress_clusters(cand: DataFrame, min_gap: int, p: Track) -> DataFrame:
    """The same by a fold: an entity is cut where candidates lie min_gap apart, and a cluster's buffer is released
    as soon as the strongest pending candidate is out of reach."""
    from .fold import fold
    df = S.adjacent(S.add_slice(cand, p.slice_ms), ["seq"])
    df = S.islands(df, F.coalesce(F.col("seq") - F.col("prev.seq") >= min_gap, F.lit(False)), "cluster")
    df = df.select("entity_id", "cluster", "seq", "event_id", "strength")

    def flush(pending):
        kept = []
        for row in sorted(pending, key=lambda r: (-r.strength, r.seq, r.event_id)):
            if all(abs(row.seq - k.seq) >= min_gap for k in kept):
                kept.append(row)
        pending.clear()
        return [(r.entity_id, r.seq, r.event_id, r.strength) for r in kept]

    def step(pending, row):
        out = []
        if pending:
            top = max(pending, key=lambda r: (r.strength, -r.seq, -r.event_id))
            if row.seq - top.seq >= min_gap:
                out = flush(pending)
        pending.append(row)
        return out

    return fold(df, ["entity_id", "cluster"], ["seq", "event_id"], list, step,
                "entity_id long, seq long, event_id long, strength double", flush)
