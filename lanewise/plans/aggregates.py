"""Aggregations: crosstabs, calibrations, timing and quality summaries."""

from pyspark.sql import functions as F

from ..functions.numeric import count_if, r6
from ..operators import slices as S
from ..operators.quantiles import quantiles
from ..presets import HOUR, NET_Y, TRACK, TRUST_MIN, VERIFY_MIN
from ..sources.tables import TRACK_SQL, sliced_track, table, track
from .notation import STATE_SQL, states
from .projections import RECT_SQL, boxes, letter
from .registry import query
from .registry import r6 as q6
from .signals import HITS_SQL, W_SQL, digit, digit_sql, hit_frames, is_hit

P = TRACK


def sums(**conds: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}" for n, c in conds.items())


@query("parity_crosstab", f"""WITH {STATE_SQL}, c AS (SELECT match_id % 40 AS group_id, set1, set2, (gm1 + gm2) % 2 AS par, count(*) AS n,
    {sums(k="(o_totalprice > 150000) = ((gm1 + gm2 + set1) % 2 = 0)")} FROM sc GROUP BY 1, 2, 3, 4)
  SELECT c.*, {q6('1.0::DOUBLE * c.k / c.n')} AS rate, c.n >= 5 AND 1.0::DOUBLE * c.k / c.n <= 0.35 AND coalesce(s.n >= 5 AND 1.0::DOUBLE * s.k / s.n >= 0.65, false) AS inversion
  FROM c LEFT JOIN c s ON s.group_id = c.group_id AND s.set1 = c.set1 AND s.set2 = c.set2 AND s.par = 1 - c.par""")
def parity_crosstab(spark, sf):
    """Agreement by state and parity; a cell is suspect when its sibling is right."""
    s = states(spark, sf).select((F.col("match_id") % 40).alias("group_id"), "set1", "set2", ((F.col("gm1") + F.col("gm2")) % 2).alias("par"),
                                 ((F.col("o_totalprice") > 150000) == ((F.col("gm1") + F.col("gm2") + F.col("set1")) % 2 == 0)).alias("ok"))
    c = s.groupBy("group_id", "set1", "set2", "par").agg(F.count("*").alias("n"), count_if(F.col("ok")).alias("k"))
    sib = c.select("group_id", "set1", "set2", (1 - F.col("par")).alias("par"), F.col("n").alias("sn"), F.col("k").alias("sk"))
    j = c.join(sib, ["group_id", "set1", "set2", "par"], "left")
    bad = (F.col("n") >= 5) & (F.col("k") / F.col("n") <= 0.35) & F.coalesce((F.col("sn") >= 5) & (F.col("sk") / F.col("sn") >= 0.65), F.lit(False))
    return j.select("group_id", "set1", "set2", "par", "n", "k", r6(F.col("k") / F.col("n")).alias("rate"), bad.alias("inversion"))


# ---- box condition × outcome ----
_CONDS = ["bad_height", "bad_width", "off_court_x", "wrong_half", "sane"]
_LET_SQL = "CASE WHEN (CASE WHEN group_id % 2 = 0 THEN x > bcx ELSE x < bcx END) THEN 'f' ELSE 'b' END"


@query("condition_crosstab", f"""WITH {TRACK_SQL}, {RECT_SQL}, m AS (SELECT group_id, kind, median(bh) AS mh, median(bw) AS mw FROM bx GROUP BY 1, 2),
  c AS (SELECT group_id, CASE WHEN bh < 0.85 * mh OR bh > 1.2 * mh THEN 'bad_height' WHEN bw > 1.3 * mw THEN 'bad_width' WHEN cx > 9 THEN 'off_court_x' WHEN (group_id % 2 = 0) = (cy < {NET_Y - 2}) THEN 'wrong_half' ELSE 'sane' END AS cond,
    CASE WHEN kind = 'error' THEN 'refused' WHEN ({_LET_SQL}) = CASE WHEN event_id % 3 = 0 THEN 'f' ELSE 'b' END THEN 'right_' ELSE 'wrong' END AS outcome FROM rc JOIN m USING (group_id, kind))
  SELECT coalesce(group_id, -1) AS group_id, outcome, {sums(**{c: f"cond = '{c}'" for c in _CONDS})}, count(*) AS total FROM c GROUP BY GROUPING SETS ((group_id, outcome), (outcome))""")
def condition_crosstab(spark, sf):
    """Outcome by box condition with the failing check, per group and pooled."""
    b = boxes(spark, sf)
    key = ["group_id", "kind"]
    m = quantiles(b, key, "bh", {"mh": .5}, 5.0).drop("n").join(quantiles(b, key, "bw", {"mw": .5}, 5.0).drop("n"), key)
    b = b.join(m, key)
    cond = (F.when((F.col("bh") < 0.85 * F.col("mh")) | (F.col("bh") > 1.2 * F.col("mh")), "bad_height").when(F.col("bw") > 1.3 * F.col("mw"), "bad_width")
            .when(F.col("cx") > 9, "off_court_x").when((F.col("group_id") % 2 == 0) == (F.col("cy") < NET_Y - 2), "wrong_half").otherwise("sane"))
    let = letter(F.col("x") - F.col("bcx"), F.col("group_id") % 2 == 0, F.lit(False))
    truth = F.when(F.col("event_id") % 3 == 0, "f").otherwise("b")
    out = F.when(F.col("kind") == "error", "refused").when(let == truth, "right_").otherwise("wrong")
    g = b.select("group_id", cond.alias("cond"), out.alias("outcome")).groupBy("group_id", "outcome").agg(
        *[count_if(F.col("cond") == c).alias(c) for c in _CONDS], F.count("*").alias("total"))
    return pooled(g, ["outcome"], [*_CONDS, "total"])


def pooled(g, keys, cols):
    """Per-group rows plus the same summed over all groups (group_id = -1)."""
    every = g.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols]).withColumn("group_id", F.lit(-1).cast("long"))
    return g.select("group_id", *keys, *cols).unionByName(every)


# ---- direction signals: four reads of each hit against a truth digit ----
SIGNALS = ["land_near", "land_far", "contact", "cross"]
LADDER_SQL = f"""{HITS_SQL}, lad AS (SELECT h.group_id, h.entity_id, h.event_id, CAST(1 + h.event_id % 3 AS VARCHAR) AS truth, h.cx AS hx, h.cy AS hy, l.cx AS lx, l.cy AS ly, n.cx AS nx, n.cy AS ny,
    CASE WHEN l.cy >= {NET_Y} THEN {digit_sql('l.cx', 'true')} END AS land_near, CASE WHEN l.cy < {NET_Y} THEN {digit_sql('l.cx', 'false')} END AS land_far,
    CASE WHEN n.seq - h.seq <= {12 * HOUR} THEN {digit_sql('n.cx', f'n.cy >= {NET_Y}')} END AS contact,
    CASE WHEN sign(h.cy - {NET_Y}) * sign(n.cy - {NET_Y}) < 0 THEN {digit_sql('(h.cx + n.cx) / 2', 'n.cy > h.cy')} END AS "cross"
  FROM hf h LEFT JOIN hf l ON l.entity_id = h.entity_id AND l.rk = h.land_rk AND (h.nxt_rk IS NULL OR h.land_rk < h.nxt_rk) LEFT JOIN hf n ON n.entity_id = h.entity_id AND n.rk = h.nxt_rk WHERE h.kind = 'purchase'),
  lq AS (SELECT *, CASE WHEN land_near IS NOT NULL THEN 'land_near' WHEN contact IS NOT NULL THEN 'contact' WHEN "cross" IS NOT NULL THEN 'cross' WHEN land_far IS NOT NULL THEN 'land_far' ELSE 'none' END AS src,
    coalesce(land_near, contact, "cross", land_far, '?') AS digit FROM lad)"""


def ladder(spark, sf, t=None):
    """Each hit with its landing, the reads of every rung, and the committed digit."""
    df = hit_frames(spark, sf, t).filter(is_hit())
    before = F.col("nxt").isNull() | (F.struct("land.seq", "land.event_id") < F.struct("nxt.seq", "nxt.event_id"))
    df = df.withColumn("land", F.when(before, F.col("land")))
    hx, hy, lx, ly, nx, ny = (F.col(c) for c in ("cx", "cy", "land.cx", "land.cy", "nxt.cx", "nxt.cy"))
    df = df.select("group_id", "entity_id", "event_id", (1 + F.col("event_id") % 3).cast("string").alias("truth"), hx.alias("hx"), hy.alias("hy"),
                   lx.alias("lx"), ly.alias("ly"), nx.alias("nx"), ny.alias("ny"),
                   F.when(ly >= NET_Y, digit(lx, F.lit(True))).alias("land_near"), F.when(ly < NET_Y, digit(lx, F.lit(False))).alias("land_far"),
                   F.when(F.col("nxt.seq") - F.col("seq") <= 12 * HOUR, digit(nx, ny >= NET_Y)).alias("contact"),
                   F.when(F.signum(hy - NET_Y) * F.signum(ny - NET_Y) < 0, digit((hx + nx) / 2, ny > hy)).alias("cross"))
    src = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("land_near", "contact", "cross", "land_far")], F.lit("none"))
    return df.withColumn("src", src).withColumn("digit", F.coalesce("land_near", "contact", "cross", "land_far", F.lit("?")))


@query("signal_ladder", f"WITH {TRACK_SQL}, {LADDER_SQL} SELECT entity_id, event_id, digit, src FROM lq")
def signal_ladder(spark, sf):
    return ladder(spark, sf).select("entity_id", "event_id", "digit", "src")


def _reads_sql() -> str:
    return " UNION ALL ".join(f"SELECT event_id, truth, '{s}' AS s, \"{s}\" AS d FROM lad WHERE \"{s}\" IS NOT NULL" for s in SIGNALS)


@query("signal_quality", f"""WITH {TRACK_SQL}, {LADDER_SQL}, r AS ({_reads_sql()}), n AS (SELECT count(*) AS n FROM lad)
  SELECT s AS s1, '' AS s2, count(*) AS n, {sums(agree='d = truth')}, CAST(0 AS BIGINT) AS right_when_agree, {q6('1.0::DOUBLE * count(*) / (SELECT n FROM n)')} AS coverage FROM r GROUP BY 1
  UNION ALL SELECT a.s, b.s, count(*), {sums(agree='a.d = b.d', right_when_agree='a.d = b.d AND a.d = a.truth')}, 0.0 FROM r a JOIN r b ON a.event_id = b.event_id AND a.s < b.s GROUP BY 1, 2""")
def signal_quality(spark, sf):
    """Coverage and accuracy per read, and pairwise agreement: all from one pass, the
    pairs come from the reads of the row itself instead of a self-join."""
    df = ladder(spark, sf)
    names = sorted(SIGNALS)
    none = F.lit(None).cast("string")
    item = lambda a, b: F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"), F.col(a).alias("d1"), (F.col(b) if b else none).alias("d2"))
    pairs = [item(a, "") for a in names] + [item(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    rows = df.select("truth", F.inline(F.array(*pairs))).filter("d1 IS NOT NULL AND (s2 = '' OR d2 IS NOT NULL)")
    same = F.when(F.col("s2") == "", F.col("d1") == F.col("truth")).otherwise(F.col("d1") == F.col("d2"))
    g = rows.groupBy("s1", "s2").agg(F.count("*").alias("n"), count_if(same).alias("agree"),
                                     count_if((F.col("s2") != "") & same & (F.col("d1") == F.col("truth"))).alias("right_when_agree"))
    total = track(spark, sf).filter(is_hit()).agg(F.count("*").alias("t"))
    g = g.join(F.broadcast(total))      # one row
    return g.select("s1", "s2", "n", "agree", "right_when_agree", r6(F.when(F.col("s2") == "", F.col("n") / F.col("t")).otherwise(0.0)).alias("coverage"))


MODES = ["abs", "abs_rev", "recv", "recv_rev", "hand", "recv_hand", "recv_hand_rev"]


def _flip_sql(mode: str, near: str) -> str:
    lefty = "(entity_id % 5 = 0)"
    return {"abs": "false", "abs_rev": "true", "recv": near, "recv_rev": f"NOT ({near})", "hand": lefty, "recv_hand": f"({near}) <> {lefty}", "recv_hand_rev": f"(NOT ({near})) <> {lefty}"}[mode]


_GEO, _CHAIN = f"ly >= {NET_Y}", f"hy < {NET_Y}"


@query("mapping_calibration", f"""WITH {TRACK_SQL}, {LADDER_SQL}, z AS ({' UNION ALL '.join(f"SELECT group_id, '{d}' AS receiver, '{m}' AS mode, {digit_sql('lx', _flip_sql(m, n))} = truth AS ok FROM lad WHERE lx IS NOT NULL" for d, n in (('geo', _GEO), ('chain', _CHAIN)) for m in MODES)})
  SELECT coalesce(group_id, -1) AS group_id, receiver, mode, {sums(k='ok')}, count(*) AS n FROM z GROUP BY GROUPING SETS ((group_id, receiver, mode), (receiver, mode))""")
def mapping_calibration(spark, sf):
    """Seven candidate mappings under two receiver definitions, per group and pooled."""
    df = ladder(spark, sf).filter("lx IS NOT NULL")
    one = lambda d, n, m: F.struct(F.lit(d).alias("receiver"), F.lit(m).alias("mode"), (digit(F.col("lx"), F.expr(_flip_sql(m, n))) == F.col("truth")).alias("ok"))
    rows = F.array(*[one(d, n, m) for d, n in (("geo", _GEO), ("chain", _CHAIN)) for m in MODES])
    g = df.select("group_id", F.inline(rows)).groupBy("group_id", "receiver", "mode").agg(count_if(F.col("ok")).alias("k"), F.count("*").alias("n"))
    return pooled(g, ["receiver", "mode"], ["k", "n"])


@query("reference_counterfactual", f"""WITH {TRACK_SQL}, {RECT_SQL}, m AS (SELECT *, median(bcx + bw / 8) OVER (PARTITION BY entity_id ORDER BY seq RANGE BETWEEN {24 * HOUR} PRECEDING AND {24 * HOUR} FOLLOWING) AS nb FROM rc),
   r AS (SELECT group_id, CASE WHEN event_id % 3 = 0 THEN 'f' ELSE 'b' END AS truth, group_id % 2 = 0 AS near, x - bcx AS d0, x - (bcx + bw / 8) AS d1, x - nb AS d2, bw > 30 OR abs(x - bcx) < 5 AS abstain FROM m),
   v AS (SELECT group_id, 'ref0' AS ref, truth, near, d0 AS d, false AS a FROM r UNION ALL SELECT group_id, 'ref1', truth, near, d1, false FROM r UNION ALL SELECT group_id, 'ref2', truth, near, d2, false FROM r UNION ALL SELECT group_id, 'ref3', truth, near, d0, abstain FROM r)
  SELECT group_id, ref, {sums(right_="NOT a AND (CASE WHEN (CASE WHEN near THEN d > 0 ELSE d < 0 END) THEN 'f' ELSE 'b' END) = truth", total='NOT a', abstained='a')} FROM v GROUP BY 1, 2""")
def reference_counterfactual(spark, sf):
    """The same side read under four references, the last one allowed to abstain."""
    from pyspark.sql import Window

    from ..functions.numeric import array_median
    h = 24 * HOUR
    b = S.spread(boxes(spark, sf), h, P.slice_ms)
    w = Window.partitionBy("entity_id", "slice").orderBy("seq").rangeBetween(-h, h)
    b = b.withColumn("nb", array_median(F.collect_list(F.col("bcx") + F.col("bw") / 8).over(w))).filter("own")
    near, truth = F.col("group_id") % 2 == 0, F.when(F.col("event_id") % 3 == 0, "f").otherwise("b")
    x, c = F.col("x"), F.col("bcx")
    abstain = (F.col("bw") > 30) | (F.abs(x - c) < 5)
    ref = lambda n, d, a: F.struct(F.lit(n).alias("ref"), (letter(d, near, F.lit(False)) == truth).alias("ok"), a.alias("a"))
    no = F.lit(False)
    rows = F.array(ref("ref0", x - c, no), ref("ref1", x - (c + F.col("bw") / 8), no), ref("ref2", x - F.col("nb"), no), ref("ref3", x - c, abstain))
    return b.select("group_id", F.inline(rows)).groupBy("group_id", "ref").agg(
        count_if(F.col("ok") & ~F.col("a")).alias("right_"), count_if(~F.col("a")).alias("total"), count_if(F.col("a")).alias("abstained"))


_RULE_SQL = f"""p0 AS (SELECT *, lead(cy) OVER w AS ny, lead(seq) OVER w AS ns FROM t {W_SQL}),
  fc AS (SELECT entity_id, arg_min(CASE WHEN ny < cy THEN 'near' ELSE 'far' END, (seq, event_id)) AS end_, arg_min(ns, (seq, event_id)) AS f1, arg_min(abs(ny - cy) / ((ns - seq) / {P.second}::DOUBLE), (seq, event_id)) AS speed
     FROM p0 WHERE ns - seq BETWEEN 1 AND {P.hole} AND (cy - {NET_Y}) * (ny - {NET_Y}) < 0 AND cy BETWEEN -4 AND 27.77 AND ny BETWEEN -4 AND 27.77 GROUP BY 1),
  sv AS (SELECT group_id, entity_id, min(CASE WHEN kind = 'signup' THEN seq END) AS sf, CASE entity_id % 4 WHEN 0 THEN '?' WHEN 1 THEN 'near' ELSE 'far' END AS used, CASE WHEN entity_id % 3 = 0 THEN 'near' ELSE 'far' END AS truth FROM t GROUP BY 1, 2),
  ru AS (SELECT sv.*, fc.*, coalesce(sf IS NOT NULL AND f1 <= sf - {2 * P.second // 5}, false) AS early, coalesce(speed >= 8, false) AS fast FROM sv LEFT JOIN fc USING (entity_id))"""


def _hyb(g: str) -> str:
    return f"CASE WHEN end_ IS NULL THEN used WHEN used = '?' THEN end_ WHEN end_ <> used AND ({g}) THEN end_ ELSE used END"


RULES = {"R0": "false", "Hearly": "early", "Hfast": "fast", "Hboth": "early AND fast"}


@query("rule_ab", f"""WITH {TRACK_SQL}, {_RULE_SQL}, x AS ({' UNION ALL '.join(f"SELECT group_id, '{n}' AS rule, used, truth, {('used' if n == 'R0' else _hyb(g))} AS call FROM ru" for n, g in RULES.items())})
  SELECT group_id, rule, count(*) AS n, {sums(right_='call = truth', flips='call <> used', good_flips='call <> used AND call = truth')} FROM x GROUP BY 1, 2""")
def rule_ab(spark, sf):
    """Override rules on the first level pass of each entity, scored against the current call."""
    df = S.adjacent(sliced_track(spark, sf), ["cy", "seq"])
    gap, cy, ny = F.col("next.seq") - F.col("seq"), F.col("cy"), F.col("next.cy")
    ok = gap.between(1, P.hole) & ((cy - NET_Y) * (ny - NET_Y) < 0) & cy.between(-4, 27.77) & ny.between(-4, 27.77)
    first = F.min(F.struct("seq", "event_id", F.when(ny < cy, "near").otherwise("far").alias("end_"), F.col("next.seq").alias("f1"), (F.abs(ny - cy) / (gap / P.second)).alias("speed")))
    fc = df.filter(ok).groupBy("entity_id").agg(first.alias("m")).select("entity_id", "m.end_", "m.f1", "m.speed")
    sv = track(spark, sf).groupBy("group_id", "entity_id").agg(F.min(F.when(F.col("kind") == "signup", F.col("seq"))).alias("sf"))
    used = F.expr("CASE entity_id % 4 WHEN 0 THEN '?' WHEN 1 THEN 'near' ELSE 'far' END")
    ru = sv.withColumn("used", used).withColumn("truth", F.when(F.col("entity_id") % 3 == 0, "near").otherwise("far")).join(fc, "entity_id", "left")
    ru = ru.withColumn("early", F.coalesce(F.col("f1") <= F.col("sf") - 2 * P.second // 5, F.lit(False))).withColumn("fast", F.coalesce(F.col("speed") >= 8, F.lit(False)))
    calls = F.array(*[F.struct(F.lit(n).alias("rule"), F.expr("used" if n == "R0" else _hyb(g)).alias("call")) for n, g in RULES.items()])
    x = ru.select("group_id", "used", "truth", F.inline(calls))
    flip = F.col("call") != F.col("used")
    return x.groupBy("group_id", "rule").agg(F.count("*").alias("n"), count_if(F.col("call") == F.col("truth")).alias("right_"), count_if(flip).alias("flips"),
                                             count_if(flip & (F.col("call") == F.col("truth"))).alias("good_flips"))


_SRC = "CASE WHEN kind <> 'click' THEN 'other' WHEN y > -10 AND y < 30 THEN 'inside' ELSE 'plausible' END"


@query("source_mix", f"WITH {TRACK_SQL} SELECT group_id, {_SRC} AS src, count(*) AS n, {sums(good='event_id % 7 < 5', early='x < 30', stance='event_id % 2 = 0')}, {q6('median(x)')} AS med FROM t GROUP BY 1, 2")
def source_mix(spark, sf):
    t = track(spark, sf).withColumn("src", F.expr(_SRC))
    key = ["group_id", "src"]
    g = t.groupBy(*key).agg(count_if(F.col("event_id") % 7 < 5).alias("good"), count_if(F.col("x") < 30).alias("early"), count_if(F.col("event_id") % 2 == 0).alias("stance"))
    return quantiles(t, key, "x", {"med": .5}, 10.0).withColumn("med", r6(F.col("med"))).join(g, key)


@query("majority_vote", f"""WITH {TRACK_SQL}, c AS (SELECT entity_id, seq // {24 * HOUR} AS plateau, kind, count(*) AS n, min((seq, event_id)) AS f FROM t WHERE kind <> 'error' GROUP BY 1, 2, 3)
  SELECT entity_id, plateau, kind AS vote, n AS votes FROM c QUALIFY row_number() OVER (PARTITION BY entity_id, plateau ORDER BY n DESC, f) = 1""")
def majority_vote(spark, sf):
    """Most common read per plateau; the first seen wins a tie."""
    t = track(spark, sf).filter("kind <> 'error'").withColumn("plateau", F.floor(F.col("seq") / (24 * HOUR)))
    c = t.groupBy("entity_id", "plateau", "kind").agg(F.count("*").alias("n"), F.min(F.struct("seq", "event_id")).alias("f"))
    best = c.groupBy("entity_id", "plateau").agg(F.min(F.struct((-F.col("n")).alias("n"), "f", "kind")).alias("m"))
    return best.select("entity_id", "plateau", F.col("m.kind").alias("vote"), (-F.col("m.n")).alias("votes"))


@query("track_quality", f"""WITH {TRACK_SQL}, d AS (SELECT *, seq - lag(seq) OVER w AS gap FROM t {W_SQL})
  SELECT entity_id, count(*) AS n, {q6(f'count(*) / ((max(seq) - min(seq)) / {P.second}::DOUBLE + 1)')} AS coverage, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_hole, {sums(n_holes=f'gap > {P.hole}')},
    {q6(f'coalesce(avg(gap / {P.second}::DOUBLE), 0)')} AS mean_gap FROM d GROUP BY 1""")
def track_quality(spark, sf):
    """Coverage, longest hole and hole count. The mean gap telescopes to the span, so only
    the hole columns need neighbours; those are taken across slices."""
    return quality(spark, sf).select("entity_id", "n", r6(F.col("coverage")).alias("coverage"), "max_hole", "n_holes", r6(F.col("mean_gap")).alias("mean_gap"))


def quality(spark, sf, t=None):
    df = S.adjacent(sliced_track(spark, sf) if t is None else t, ["seq"])
    gap = F.col("seq") - F.col("prev.seq")
    span = (F.max("seq") - F.min("seq")) / P.second
    return df.groupBy("group_id", "entity_id").agg(F.count("*").alias("n"), (F.count("*") / (span + 1)).alias("coverage"), F.coalesce(F.max(gap), F.lit(0)).alias("max_hole"),
                                                   count_if(gap > P.hole).alias("n_holes"), F.coalesce(F.avg(gap / P.second), F.lit(0.0)).alias("mean_gap"))


_TH = "CASE WHEN v >= {t} THEN 'trust' WHEN v >= {w} THEN 'verify' ELSE 'rekey' END".format(t=TRUST_MIN, w=VERIFY_MIN)
_COMPS = {"early": "l_shipdate < TIMESTAMP '2000-01-01'", "open_": "l_linestatus = 'O'", "returned": "l_returnflag = 'R'", "cheap": "l_discount < 0.095"}


@query("graded_report", f"""WITH g AS (SELECT l_suppkey % 12 AS grp, count(*) AS n, {sums(**_COMPS)} FROM lineitem GROUP BY 1),
  r AS ({' UNION ALL '.join(f"SELECT '{c}' AS component, grp, n, {c} AS k, round_even(1.0::DOUBLE * {c} / n, 9) AS rate FROM g" for c in _COMPS)}),
  p AS (SELECT component, 1.0::DOUBLE * sum(k) / sum(n) AS v, min(rate) AS lo, max(rate) AS hi FROM r GROUP BY 1),
  w AS (SELECT component, string_agg(CAST(grp AS VARCHAR), ',' ORDER BY rate, grp) AS worst FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY component ORDER BY rate, grp) <= 2) GROUP BY 1)
  SELECT component, {q6('v')} AS value, {_TH} AS grade, {q6('lo')} AS lo, {q6('hi')} AS hi, worst FROM p JOIN w USING (component)""")
def graded_report(spark, sf):
    """Pooled value and grade per component, its range over groups, and the two worst groups."""
    g = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("grp")).agg(F.count("*").alias("n"), *[count_if(F.expr(e)).alias(c) for c, e in _COMPS.items()])
    r = g.select("grp", "n", F.inline(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("k")) for c in _COMPS])))
    r = r.withColumn("rate", F.bround(F.col("k") / F.col("n"), 9))
    # twelve rows per component at most
    p = r.groupBy("component").agg((F.sum("k") / F.sum("n")).alias("v"), F.min("rate").alias("lo"), F.max("rate").alias("hi"),
                                   F.slice(F.array_sort(F.collect_list(F.struct("rate", "grp"))), 1, 2).alias("w"))
    worst = F.array_join(F.transform("w", lambda s: s["grp"].cast("string")), ",")
    return p.select("component", r6(F.col("v")).alias("value"), F.expr(_TH).alias("grade"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), worst.alias("worst"))


@query("arm_timing", f"""WITH {TRACK_SQL}, d AS (SELECT CASE entity_id % 3 WHEN 0 THEN 'cold_a' WHEN 1 THEN 'review' ELSE 'cold_b' END AS arm, CASE WHEN x > 50 THEN 'high' ELSE 'low' END AS tier, y FROM t WHERE kind <> 'error')
  SELECT arm, tier, count(*) AS n, {q6('median(y)', 1)} AS med, {q6('avg(y)', 4)} AS mean FROM d GROUP BY 1, 2""")
def arm_timing(spark, sf):
    t = track(spark, sf).filter("kind <> 'error'").select(F.expr("CASE entity_id % 3 WHEN 0 THEN 'cold_a' WHEN 1 THEN 'review' ELSE 'cold_b' END").alias("arm"), F.when(F.col("x") > 50, "high").otherwise("low").alias("tier"), "y")
    key = ["arm", "tier"]
    m = t.groupBy(*key).agg(F.avg("y").alias("mean"))
    return quantiles(t, key, "y", {"med": .5}, 10.0).join(m, key).select(*key, "n", r6(F.col("med"), 1).alias("med"), r6(F.col("mean"), 4).alias("mean"))


@query("topk_per_group", "SELECT l_suppkey, l_returnflag, max(l_extendedprice) AS price, arg_min((l_orderkey, l_partkey), (-l_extendedprice, l_orderkey, l_partkey))[1] AS l_orderkey FROM lineitem GROUP BY 1, 2".replace("arg_min((l_orderkey, l_partkey), (-l_extendedprice, l_orderkey, l_partkey))[1]", "arg_min(l_orderkey, (-l_extendedprice, l_orderkey, l_partkey))"))
def topk_per_group(spark, sf):
    m = F.min(F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_partkey")).alias("m")
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(m).select("l_suppkey", "l_returnflag", (-F.col("m.p")).alias("price"), F.col("m.l_orderkey").alias("l_orderkey"))


@query("bottomk", f"WITH {TRACK_SQL}, g AS (SELECT entity_id, round_even(avg(y), 6) AS m FROM t GROUP BY 1) SELECT entity_id, {q6('m')} AS m FROM g ORDER BY m, entity_id LIMIT 4")
def bottomk(spark, sf):
    return track(spark, sf).groupBy("entity_id").agg(r6(F.avg("y")).alias("m")).orderBy("m", "entity_id").limit(4)


@query("tumbling_rollup", f"WITH {TRACK_SQL} SELECT entity_id, (seq // {P.second}) * {P.second} AS start_seq, count(*) AS n, {q6('sum(y)')} AS total FROM t GROUP BY 1, 2")
def tumbling_rollup(spark, sf):
    return rollup_windows(spark, sf, "8 hours")


@query("sliding_rollup", f"""WITH {TRACK_SQL}, e AS (SELECT entity_id, y, (seq // {2 * HOUR} - k) * {2 * HOUR} AS start_seq FROM t, range(4) r(k)) SELECT entity_id, start_seq, count(*) AS n, {q6('sum(y)')} AS total FROM e GROUP BY 1, 2""")
def sliding_rollup(spark, sf):
    return rollup_windows(spark, sf, "8 hours", "2 hours")


def rollup_windows(spark, sf, *span):
    t = track(spark, sf).withColumn("ts", F.timestamp_millis("seq"))
    g = t.groupBy("entity_id", F.window("ts", *span).alias("w")).agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    return g.select("entity_id", F.unix_millis("w.start").alias("start_seq"), "n", r6(F.col("total")).alias("total"))


@query("session_gap", f"""WITH {TRACK_SQL}, s AS (SELECT *, sum(CASE WHEN seq - p >= {P.hole} OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY seq, event_id) AS sid FROM (SELECT *, lag(seq) OVER w AS p FROM t {W_SQL}))
  SELECT entity_id, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n FROM s GROUP BY entity_id, sid""")
def session_gap(spark, sf):
    """Sessions closed by half a day of absence. Islands over slices rather than a session
    window: a hot entity is then spread over its slices."""
    df = S.adjacent(sliced_track(spark, sf), ["seq"])
    df = S.islands(df, F.coalesce(F.col("seq") - F.col("prev.seq") >= P.hole, F.lit(True)), "sid")
    return df.groupBy("entity_id", "sid").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n")).drop("sid")



