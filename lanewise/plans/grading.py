"""Grading of drafts against truth: scorecards, decomposition, counterfactuals."""

from pyspark.sql import functions as F

from ..functions import notation as N
from ..functions.numeric import count_if, once, r6, ratio
from ..operators.quantiles import quantiles
from ..presets import GOOD_EDITS
from ..session import cut_lineage
from ..sources.tables import SEQUENCE_SQL, sequences, table
from .notation import DRAFT_EXPR, KEY, KEY_SQL, POINTS_SQL, draft_sql, points, tokens_sql
from .registry import query
from .registry import r6 as q6

Q_TOKENS = ["AF", "AO", "NF", "NO", "RF", "RO"]
THRESHOLDS = [1, 2, 3, 5]
FIXES = {"baseline": "", "serve": "serve", "letters": "letters", "dirs_attempted": "dirs_attempted", "dirs_all": "dirs_all",
         "endings": "endings", "letters+dirs": "letters+dirs_all", "letters+dirs+endings": "letters+dirs_all+endings",
         "all": "serve+letters+dirs_all+endings"}


def code_sql(lst: str, vocab: list[str]) -> str:
    words = "[" + ", ".join(f"'{t}'" for t in vocab) + "]"
    return f"array_to_string(list_transform({lst}, lambda t: chr(CAST(96 + list_position({words}, t) AS INT))), '')"


def dist_sql(a: str, b: str, vocab: list[str]) -> str:
    return f"levenshtein({code_sql(a, vocab)}, {code_sql(b, vocab)})"


# ---- acceptance at k edits over the order sequences ----
@query("edit_effort_curve", f"""WITH {SEQUENCE_SQL},
  d AS (SELECT group_id, {dist_sql('truth', 'draft', Q_TOKENS)} AS d,
     {dist_sql("list_transform(truth, lambda x: left(x, 1) || 'F')", "list_transform(draft, lambda x: left(x, 1) || 'F')", Q_TOKENS)} AS ds FROM q)
  SELECT group_id, k, count(*) AS n, CAST(sum(CASE WHEN d <= k THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(sum(CASE WHEN ds <= k THEN 1 ELSE 0 END) AS BIGINT) AS accepted_structural,
    {q6('avg(d)')} AS mean_distance FROM d, (SELECT unnest([1, 2, 3, 5]) AS k) GROUP BY GROUPING SETS ((group_id, k), (k))""")
def edit_effort_curve(spark, sf):
    head = lambda c: F.transform(c, lambda t: F.substring(t, 1, 1))
    df = sequences(spark, sf).select("group_id", N.small_edit_distance(F.col("truth"), F.col("draft"), Q_TOKENS).alias("d"),
                                     N.small_edit_distance(head("truth"), head("draft"), ["A", "N", "R"]).alias("ds"))
    # one partial aggregate per group, then the thresholds and the pooled row on top
    aggs = [F.count("*").alias("n"), F.sum("d").alias("sum_d")]
    for k in THRESHOLDS:
        aggs += [count_if(F.col("d") <= k).alias(f"a{k}"), count_if(F.col("ds") <= k).alias(f"s{k}")]
    g = df.groupBy("group_id").agg(*aggs)
    pooled = g.rollup("group_id").agg(*[F.sum(c).alias(c) for c in g.columns[1:]])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("accepted"), F.col(f"s{k}").alias("accepted_structural")) for k in THRESHOLDS])
    return pooled.select("group_id", "n", r6(F.col("sum_d") / F.col("n")).alias("mean_distance"), F.inline(rows))


# ---- component grading over the points ----
_CALL = "CAST(1 + (supp + CASE WHEN part % 4 = 0 THEN 1 ELSE 0 END) % 2 AS INT)"
GRADED_SQL = f"""{POINTS_SQL}, pd AS (SELECT *, {DRAFT_EXPR} AS draft FROM pts),
  gr0 AS (SELECT {KEY_SQL}, match_id % 8 AS group_id, svr, {_CALL} AS call, flags, draft, {tokens_sql('played')} AS a, {draft_sql('draft')} AS b FROM pd),
  gr AS (SELECT *, {dist_sql('a', 'b', N.NOTATION_TOKENS)} AS d FROM gr0)"""


def graded(spark, sf):
    """Points with truth tokens `a`, draft tokens `b` and their distance `d`."""
    df = points(spark, sf).withColumn("draft", F.expr(DRAFT_EXPR))
    df = df.select(*KEY, (F.col("match_id") % 8).alias("group_id"), "svr", F.expr(_CALL).alias("call"), "flags", "draft", "attested", "played")
    df = once(df, a=N.point_tokens(F.col("played")), b=N.draft_tokens(F.col("draft"))).drop("played")
    return df.withColumn("d", N.edit_distance(F.col("a"), F.col("b")))      # dropped by the optimiser where nobody reads it


def _sum_sql(c: str) -> str:
    return f"CAST(coalesce(sum({c}), 0) AS BIGINT)"


_CARD_SQL = f"""cd AS (SELECT group_id, a, b, d, svr, call, len(a) = len(b) AS aligned, substr(a[1], 2, 1) AS za, substr(b[1], 2, 1) AS zb,
     list_filter(list_zip(a[2:len(a) - 1], b[2:len(b) - 1]), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND left(z[1], 1) IN ('f', 'b') AND left(z[2], 1) IN ('f', 'b')) AS lt FROM gr),
  ce AS (SELECT *, len(lt) AS n_let, len(list_filter(lt, lambda z: left(z[1], 1) = left(z[2], 1))) AS ok_let FROM cd)"""


@query("scorecard", f"""WITH {GRADED_SQL}, {_CARD_SQL}
  SELECT group_id, count(*) AS n, {_sum_sql('CASE WHEN svr = call THEN 1 ELSE 0 END')} AS server_ok, {_sum_sql('CASE WHEN abs(len(a) - len(b)) <= 1 THEN 1 ELSE 0 END')} AS rally_pm1,
    {_sum_sql("CASE WHEN za <> '?' AND zb <> '?' THEN 1 ELSE 0 END")} AS zone_n, {_sum_sql("CASE WHEN za <> '?' AND zb <> '?' AND za = zb THEN 1 ELSE 0 END")} AS zone_ok,
    {_sum_sql('n_let')} AS letters_n, {_sum_sql('ok_let')} AS letters_ok, {_sum_sql('CASE WHEN aligned THEN n_let ELSE 0 END')} AS aligned_n, {_sum_sql('CASE WHEN aligned THEN ok_let ELSE 0 END')} AS aligned_ok,
    {_sum_sql("CASE WHEN b[-1] <> '?' AND a[-1] <> '?' THEN 1 ELSE 0 END")} AS ending_n, {_sum_sql("CASE WHEN b[-1] <> '?' AND a[-1] = b[-1] THEN 1 ELSE 0 END")} AS ending_ok,
    {_sum_sql('CASE WHEN d <= 1 THEN 1 ELSE 0 END')} AS accepted FROM ce GROUP BY 1""")
def scorecard(spark, sf):
    """All component scores of every group in one pass."""
    df = graded(spark, sf)
    za, zb = F.substring(F.get("a", 0), 2, 1), F.substring(F.get("b", 0), 2, 1)
    mid = lambda c: F.slice(c, 2, F.size(c) - 2)
    first = lambda c: F.substring(c, 1, 1)
    lets = F.filter(F.arrays_zip(mid(F.col("a")).alias("x"), mid(F.col("b")).alias("y")),
                    lambda z: first(z["x"]).isin("f", "b") & first(z["y"]).isin("f", "b"))
    df = once(df, lt=lets)
    df = once(df, n_let=F.size("lt"), ok_let=F.size(F.filter("lt", lambda z: first(z["x"]) == first(z["y"]))))
    ea, eb = F.element_at("a", -1), F.element_at("b", -1)
    aligned = F.size("a") == F.size("b")
    both_z = (za != "?") & (zb != "?")
    return df.groupBy("group_id").agg(
        F.count("*").alias("n"), count_if(F.col("svr") == F.col("call")).alias("server_ok"),
        count_if(F.abs(F.size("a") - F.size("b")) <= 1).alias("rally_pm1"), count_if(both_z).alias("zone_n"),
        count_if(both_z & (za == zb)).alias("zone_ok"), F.sum("n_let").alias("letters_n"), F.sum("ok_let").alias("letters_ok"),
        F.sum(F.when(aligned, F.col("n_let")).otherwise(0)).alias("aligned_n"), F.sum(F.when(aligned, F.col("ok_let")).otherwise(0)).alias("aligned_ok"),
        count_if((eb != "?") & (ea != "?")).alias("ending_n"), count_if((eb != "?") & (ea == eb)).alias("ending_ok"),
        count_if(F.col("d") <= 1).alias("accepted"))


@query("ending_confusion", f"""WITH {GRADED_SQL} SELECT a[-1] AS truth_ending, {', '.join(f"{_sum_sql(f'CASE WHEN b[-1] = {e!r} THEN 1 ELSE 0 END')} AS c{i}" for i, e in enumerate('*nwdx?'))} FROM gr WHERE a[-1] <> '?' GROUP BY 1""")
def ending_confusion(spark, sf):
    df = graded(spark, sf).select(F.element_at("a", -1).alias("truth_ending"), F.element_at("b", -1).alias("e")).filter("truth_ending <> '?'")
    return df.groupBy("truth_ending").agg(*[count_if(F.col("e") == e).alias(f"c{i}") for i, e in enumerate("*nwdx?")])


@query("strict_components", f"""WITH {GRADED_SQL}, s AS (SELECT group_id, a, b, list_zip(a[2:len(a) - 1], b[2:len(b) - 1]) AS z FROM gr WHERE len(a) = len(b)),
  m AS (SELECT group_id, unnest(z) AS z FROM s),
  x AS (SELECT group_id, {_sum_sql("CASE WHEN left(z[1], 1) IN ('f', 'b') THEN 1 ELSE 0 END")} AS letters_n, {_sum_sql("CASE WHEN left(z[1], 1) IN ('f', 'b') AND left(z[1], 1) = left(z[2], 1) THEN 1 ELSE 0 END")} AS letters_ok,
     {_sum_sql("CASE WHEN right(z[1], 1) IN ('1', '2', '3') THEN 1 ELSE 0 END")} AS dirs_denom, {_sum_sql("CASE WHEN right(z[1], 1) IN ('1', '2', '3') AND right(z[2], 1) IN ('1', '2', '3') THEN 1 ELSE 0 END")} AS dirs_n,
     {_sum_sql("CASE WHEN right(z[1], 1) IN ('1', '2', '3') AND right(z[1], 1) = right(z[2], 1) THEN 1 ELSE 0 END")} AS dirs_ok FROM m GROUP BY 1),
  y AS (SELECT group_id, {_sum_sql("CASE WHEN substr(a[1], 2, 1) IN ('4', '5', '6') THEN 1 ELSE 0 END")} AS zone_n, {_sum_sql("CASE WHEN substr(a[1], 2, 1) IN ('4', '5', '6') AND a[1] = b[1] THEN 1 ELSE 0 END")} AS zone_ok,
     {_sum_sql("CASE WHEN a[-1] <> '?' THEN 1 ELSE 0 END")} AS ending_n, {_sum_sql("CASE WHEN a[-1] <> '?' AND a[-1] = b[-1] THEN 1 ELSE 0 END")} AS ending_ok FROM s GROUP BY 1)
  SELECT * FROM x JOIN y USING (group_id)""")
def strict_components(spark, sf):
    """Component accuracy on equal-length pairs; refusals leave only the direction denominator."""
    df = graded(spark, sf).filter(F.size("a") == F.size("b"))
    z = F.arrays_zip(F.slice("a", 2, F.size("a") - 2).alias("x"), F.slice("b", 2, F.size("b") - 2).alias("y"))
    ch = lambda c, i: F.substring(c, i, 1)
    legal = lambda c: ch(c, 2).isin("1", "2", "3")
    n = lambda f: F.size(F.filter("z", f))
    df = once(df, z=z).select(
        "group_id", n(lambda s: ch(s["x"], 1).isin("f", "b")).alias("letters_n"),
        n(lambda s: ch(s["x"], 1).isin("f", "b") & (ch(s["x"], 1) == ch(s["y"], 1))).alias("letters_ok"),
        n(lambda s: legal(s["x"])).alias("dirs_denom"), n(lambda s: legal(s["x"]) & legal(s["y"])).alias("dirs_n"),
        n(lambda s: legal(s["x"]) & (ch(s["x"], 2) == ch(s["y"], 2))).alias("dirs_ok"),
        ch(F.get("a", 0), 2).isin("4", "5", "6").cast("int").alias("zone_n"),
        (ch(F.get("a", 0), 2).isin("4", "5", "6") & (F.get("a", 0) == F.get("b", 0))).cast("int").alias("zone_ok"),
        (F.element_at("a", -1) != "?").cast("int").alias("ending_n"),
        ((F.element_at("a", -1) != "?") & (F.element_at("a", -1) == F.element_at("b", -1))).cast("int").alias("ending_ok"))
    return df.groupBy("group_id").agg(*[F.sum(c).alias(c) for c in df.columns[1:]])


def pair_ops(spark, sf, extra=()):
    """Distinct (group, truth, draft) with their count `n` and edit operations `ops`."""
    pairs = graded(spark, sf).groupBy("group_id", "a", "b", *extra).agg(F.count("*").alias("n"))
    ops = N.edit_ops()
    return once(pairs, ops=ops("a", "b"))


def op_rows(df):
    return df.select("*", F.explode("ops").alias("o")).select("*", F.col("o")[0].alias("op"), F.col("o")[1].alias("x"), F.col("o")[2].alias("y")).drop("o", "ops")


@query("edit_decomposition")
def edit_decomposition(spark, sf):
    """Mean edits per point by category, per group and pooled."""
    # each pair adds one row of its own, so points are counted in the same pass
    ops = F.concat(F.array(F.array(F.lit("point"), F.lit(""), F.lit(""))), "ops")
    df = op_rows(pair_ops(spark, sf).withColumn("ops", ops)).filter("op <> 'match'")
    cat = F.when(F.col("op") == "sub", N.classify_sub(F.col("x"), F.col("y"))).otherwise(F.col("op"))
    g = df.groupBy("group_id", "op", "x", "y").agg(F.sum("n").alias("n")).groupBy("group_id", cat.alias("category")).agg(F.sum("n").alias("edits"))
    g = cut_lineage(g)                  # a few rows per group
    tot = g.filter("category = 'point'").select("group_id", F.col("edits").alias("points"))
    g = g.filter("category <> 'point'").join(tot, "group_id")
    pooled = g.groupBy("category").agg(F.sum("edits").alias("edits")).crossJoin(tot.agg(F.sum("points").alias("points")))
    g = g.unionByName(pooled.withColumn("group_id", F.lit(-1).cast("long")))
    return g.select("group_id", "category", "edits", r6(F.col("edits") / F.col("points")).alias("per_point"))


@query("refusal_split")
def refusal_split(spark, sf):
    """Wrong components: committed and wrong, or refused with '?'."""
    df = op_rows(pair_ops(spark, sf)).filter("op = 'sub'").groupBy("group_id", "x", "y").agg(F.sum("n").alias("n"))
    ka, kb = N.token_kind(F.col("x")), N.token_kind(F.col("y"))
    ch = lambda c, i: F.substring(F.col(c), i, 1)
    none = F.lit(None).cast("struct<component:string,refused:boolean>")
    part = lambda name, wrong, refused: F.when(wrong, F.struct(F.lit(name).alias("component"), refused.alias("refused"))).otherwise(none)
    parts = F.array_compact(F.array(
        part("serve_zone", ka == "serve", ch("y", 2) == "?"), part("ending", ka == "ending", F.col("y") == "?"),
        part("letter", (ka == "rally") & (ch("x", 1) != ch("y", 1)), ch("y", 1) == "?"),
        part("direction", (ka == "rally") & (ch("x", 2) != ch("y", 2)), ch("y", 2) == "?")))
    df = df.filter(ka == kb).select("group_id", "n", F.inline(parts))
    return df.groupBy("group_id", "component").agg(F.sum(F.when(~F.col("refused"), F.col("n")).otherwise(0)).alias("wrong"),
                                                   F.sum(F.when(F.col("refused"), F.col("n")).otherwise(0)).alias("refused"))


def rebuilt(fix: str):
    """Draft tokens with the fixed components set to truth at aligned positions."""
    fixes = set(fix.split("+")) if fix else set()
    kept = F.filter("ops", lambda o: o[0] != "del")

    def token(o):
        x, y = o[1], o[2]
        ka, kb = N.token_kind(x), N.token_kind(y)
        letter = F.substring(x, 1, 1) if "letters" in fixes else F.substring(y, 1, 1)
        d = F.substring(y, 2, 1)
        if "dirs_all" in fixes:
            d = F.substring(x, 2, 1)
        elif "dirs_attempted" in fixes:
            d = F.when(d != "?", F.substring(x, 2, 1)).otherwise(d)
        aligned = o[0] != "ins"
        out = F.when(aligned & (ka == "rally") & (kb == "rally"), F.concat(letter, d))
        if "serve" in fixes:
            out = out.when(aligned & (ka == "serve") & (kb == "serve"), x)
        if "endings" in fixes:
            out = out.when(aligned & (ka == "ending") & (kb == "ending"), x)
        return out.otherwise(y)

    return F.transform(kept, token)


@query("counterfactual_headroom")
def counterfactual_headroom(spark, sf):
    """Acceptance and mean distance when one component is taken from truth."""
    df = pair_ops(spark, sf)
    dist = [N.small_edit_distance(F.col("a"), rebuilt(f), N.NOTATION_TOKENS).alias(f"d{i}") for i, f in enumerate(FIXES.values())]
    df = df.select("group_id", "n", F.inline(F.array(F.struct(*dist))))
    aggs = [F.sum("n").alias("points")]
    for i in range(len(FIXES)):
        aggs += [F.sum(F.when(F.col(f"d{i}") <= 1, F.col("n")).otherwise(0)).alias(f"a{i}"), F.sum(F.col(f"d{i}") * F.col("n")).alias(f"s{i}")]
    g = df.groupBy("group_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("variant"), F.col(f"a{i}").alias("accepted"), r6(F.col(f"s{i}") / F.col("points")).alias("mean_distance"))
                     for i, name in enumerate(FIXES)])
    return g.select("group_id", "points", F.inline(rows))


# ---- review arms ----
_ARM = "CASE part % 3 WHEN 0 THEN 'cold_a' WHEN 1 THEN 'review' ELSE 'cold_b' END"


@query("accuracy_vs_truth", f"""WITH {GRADED_SQL} SELECT {_ARM} AS arm, count(*) AS n, {q6('median(d)')} AS median_d, {_sum_sql('CASE WHEN d = 0 THEN 1 ELSE 0 END')} AS exact,
   {_sum_sql('CASE WHEN d <= 1 THEN 1 ELSE 0 END')} AS within_1 FROM gr WHERE flags <> 'unseen' GROUP BY 1""")
def accuracy_vs_truth(spark, sf):
    df = graded(spark, sf).filter("flags <> 'unseen'").select(F.expr(_ARM).alias("arm"), "d")
    df = cut_lineage(df.groupBy("arm", "d").agg(F.count("*").alias("k")))          # rows are graded once, for all figures
    c = df.groupBy("arm").agg(*[F.coalesce(F.sum(F.when(e, F.col("k"))), F.lit(0)).alias(n) for n, e in {"exact": F.col("d") == 0, "within_1": F.col("d") <= 1}.items()])
    return quantiles(df, ["arm"], "d", {"median_d": 0.5}, weight="k").withColumn("median_d", r6(F.col("median_d"))).join(c, "arm")


_FIXED = "translate(draft, '?', 'f')"


@query("anchoring_list", f"""WITH {GRADED_SQL}, c AS (SELECT *, {_FIXED} AS fixed FROM gr WHERE supp % 2 = 0 AND d > {GOOD_EDITS} AND flags <> 'unseen'),
   e AS (SELECT {KEY_SQL}, a, b, d, {draft_sql('fixed')} AS k FROM c)
   SELECT {KEY_SQL}, d AS draft_truth, {dist_sql('k', 'a', N.NOTATION_TOKENS)} AS corrected_truth, {dist_sql('k', 'b', N.NOTATION_TOKENS)} AS corrected_draft FROM e""")
def anchoring_list(spark, sf):
    """Confident rows whose draft was far off, with the three pairwise distances."""
    df = graded(spark, sf).filter("supp % 2 = 0 AND flags <> 'unseen'").filter(F.col("d") > GOOD_EDITS)
    df = once(df, k=N.draft_tokens(F.expr(_FIXED)))
    dist = lambda x, y: N.small_edit_distance(F.col(x), F.col(y), N.NOTATION_TOKENS)
    return df.select(*KEY, F.col("d").alias("draft_truth"), dist("k", "a").alias("corrected_truth"), dist("k", "b").alias("corrected_draft"))


@query("correction_histogram")
def correction_histogram(spark, sf):
    """Draft → corrected operations by class, most common first."""
    df = graded(spark, sf).filter("flags <> 'unseen'").select(F.col("b").alias("x"), N.draft_tokens(F.expr(_FIXED)).alias("y"))
    df = df.groupBy("x", "y").agg(F.count("*").alias("n"))
    ops = N.edit_ops()
    df = df.select("n", F.explode(ops("x", "y")).alias("o")).filter(F.col("o")[0] != "match")
    o = F.col("o")
    bin_ = (F.when(o[0] == "sub", N.classify_sub(o[1], o[2])).when(o[0] == "del", F.concat(F.lit("del_"), N.token_kind(o[1])))
            .otherwise(F.concat(F.lit("ins_"), N.token_kind(o[2]))))
    return df.groupBy(bin_.alias("bin")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bin")


@query("binary_agreement", f"""SELECT CASE o_custkey % 3 WHEN 0 THEN 'cold_a' WHEN 1 THEN 'review' ELSE 'cold_b' END AS arm,
    {', '.join(f"{_sum_sql(f'CASE WHEN {c} THEN 1 ELSE 0 END')} AS {n}" for n, c in {'both': "o_orderstatus = 'F' AND o_totalprice > 250000", 'ours_only': "o_orderstatus <> 'F' AND o_totalprice > 250000", 'truth_only': "o_orderstatus = 'F' AND NOT o_totalprice > 250000", 'neither': "o_orderstatus <> 'F' AND NOT o_totalprice > 250000"}.items())} FROM orders GROUP BY 1""")
def binary_agreement(spark, sf):
    t, o = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250000
    arm = F.expr("CASE o_custkey % 3 WHEN 0 THEN 'cold_a' WHEN 1 THEN 'review' ELSE 'cold_b' END")
    return table(spark, sf, "orders").groupBy(arm.alias("arm")).agg(
        count_if(t & o).alias("both"), count_if(~t & o).alias("ours_only"), count_if(t & ~o).alias("truth_only"), count_if(~t & ~o).alias("neither"))


@query("ratio_quartiles", f"""WITH {GRADED_SQL}, r AS (SELECT group_id, 1.0::DOUBLE * len(b) / len(a) AS r, abs(len(b) - len(a)) <= 1 AS c FROM gr)
  SELECT group_id, count(*) AS n, {q6('quantile_cont(r, 0.25)')} AS q1, {q6('quantile_cont(r, 0.5)')} AS q2, {q6('quantile_cont(r, 0.75)')} AS q3, {q6('avg(CASE WHEN c THEN 1.0 ELSE 0.0 END)')} AS within_1 FROM r GROUP BY 1""")
def ratio_quartiles(spark, sf):
    df = graded(spark, sf).select("group_id", (F.size("b") / F.size("a")).alias("r"), (F.abs(F.size("b") - F.size("a")) <= 1).alias("c"))
    df = cut_lineage(df.groupBy("group_id", "r", "c").agg(F.count("*").alias("k")))      # rows are graded once, for all figures
    q = quantiles(df, ["group_id"], "r", {"q1": .25, "q2": .5, "q3": .75}, 0.25, weight="k")
    c = df.groupBy("group_id").agg(ratio(F.coalesce(F.sum(F.when(F.col("c"), F.col("k"))), F.lit(0)), F.sum("k")).alias("within_1"))
    return q.join(c, "group_id").select("group_id", "n", *[r6(F.col(x)).alias(x) for x in ("q1", "q2", "q3", "within_1")])


# ---- sequence features ----
@query("prev_next_features", f"""WITH {SEQUENCE_SQL}, u AS (SELECT entity_id, unnest(truth) AS token, generate_subscripts(truth, 1) - 1 AS i, truth FROM q)
  SELECT entity_id, CAST(i AS INT) AS i, token, CAST(least(i, 12) AS INT) AS pos, CASE WHEN i % 2 = 0 THEN 'server' ELSE 'returner' END AS role, CASE WHEN i >= 1 THEN truth[i] ELSE 'none' END AS prev1,
    CASE WHEN i >= 2 THEN truth[i - 1] ELSE 'none' END AS prev2 FROM u""")
def prev_next_features(spark, sf):
    """One row per token with the two before it; each row of the array carries its own neighbours."""
    back = lambda i, k: F.when(i >= k, F.get("truth", i - k)).otherwise("none")
    rows = F.transform("truth", lambda t, i: F.struct(i.alias("i"), t.alias("token"), back(i, 1).alias("prev1"), back(i, 2).alias("prev2")))
    return sequences(spark, sf).select("entity_id", F.inline(rows)).select(
        "entity_id", "i", "token", F.least("i", F.lit(12)).alias("pos"), F.when(F.col("i") % 2 == 0, "server").otherwise("returner").alias("role"), "prev1", "prev2")


@query("prior_rerank", f"""WITH {SEQUENCE_SQL}, u AS (SELECT unnest(truth) AS token, generate_subscripts(truth, 1) AS i, truth, draft FROM q),
  c AS (SELECT coalesce(truth[i - 1], 'none') AS prev1, token, draft[i] AS seen FROM (SELECT *, CASE WHEN i = 1 THEN NULL ELSE i END AS j FROM u) WHERE j IS NOT NULL),
  p AS (SELECT prev1, token, count(*) AS n FROM c GROUP BY 1, 2), t AS (SELECT prev1, sum(n) AS tot FROM p GROUP BY 1),
  s AS (SELECT prev1, seen, token, (n / tot) * CASE WHEN seen = token THEN 0.6::DOUBLE WHEN left(seen, 1) = left(token, 1) THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END AS score FROM p JOIN t USING (prev1) JOIN (SELECT DISTINCT prev1, seen FROM c) USING (prev1))
  SELECT prev1, seen, token AS best, {q6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY prev1, seen ORDER BY score DESC, token) = 1""")
def prior_rerank(spark, sf):
    """Context prior times observation likelihood; the best token per (context, observation)."""
    rows = F.transform("truth", lambda t, i: F.struct(i.alias("i"), F.get("truth", i - 1).alias("prev1"), t.alias("token"), F.get("draft", i).alias("seen")))
    df = sequences(spark, sf).select(F.inline(rows)).filter("i >= 1").drop("i")
    p = df.groupBy("prev1", "token", "seen").agg(F.count("*").alias("n"))
    prior = p.groupBy("prev1", "token").agg(F.sum("n").alias("n"))
    prior = prior.join(prior.groupBy("prev1").agg(F.sum("n").alias("tot")), "prev1")
    like = F.when(F.col("seen") == F.col("token"), 0.6).when(F.substring("seen", 1, 1) == F.substring("token", 1, 1), 0.2).otherwise(0.05)
    s = prior.join(p.select("prev1", "seen").distinct(), "prev1").withColumn("score", F.col("n") / F.col("tot") * like)
    best = s.groupBy("prev1", "seen").agg(F.min(F.struct(-F.col("score"), "token")).alias("m"))
    return best.select("prev1", "seen", F.col("m.token").alias("best"), r6(-F.col("m.col1")).alias("score"))


def _split_sql(text: str) -> str:
    """The split of a text in SQL: its md5 as a number, modulo 100 and 35, digit by digit."""
    fold = lambda m: (f"list_reduce(list_prepend(0, list_transform(range(1, 33), lambda i: strpos('0123456789abcdef', substr(md5({text}), i, 1)) - 1)), "  # noqa: E731
                      f"lambda a, d: (a * 16 + d) % {m})")
    return f"CASE WHEN {fold(100)} >= 10 THEN 'skip' WHEN {fold(35)} // 7 = 0 THEN 'test' ELSE 'train' END"


@query("hash_split", f"SELECT c_custkey, {_split_sql('c_name')} AS split FROM customer")
def hash_split(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", split_of(F.col("c_name")).alias("split"))


def split_of(name, include: int = 10):
    """skip / train / test by the 128-bit md5 of a name, folded modulo 100 and 35."""
    hexes = F.split(F.md5(name.cast("binary")), "")
    digits = F.transform(F.filter(hexes, lambda c: c != ""), lambda c: F.conv(c, 16, 10).cast("int"))
    fold = lambda m: F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % m)
    return F.when(fold(100) >= include, "skip").when(F.floor(fold(35) / 7) == 0, "test").otherwise("train")


@query("intersect_leakcheck", f"""WITH o AS (SELECT o_custkey, {_split_sql('CAST(o_orderkey AS VARCHAR)')} AS by_row, {_split_sql('CAST(o_custkey AS VARCHAR)')} AS by_entity FROM orders),
  s AS (SELECT 'row' AS split_by, o_custkey, by_row AS side FROM o UNION ALL SELECT 'entity', o_custkey, by_entity FROM o),
  c AS (SELECT split_by, o_custkey, bool_or(side = 'train') AND bool_or(side = 'test') AS both_sides FROM s GROUP BY 1, 2)
  SELECT split_by, count(*) AS entities, count(*) FILTER (WHERE both_sides) AS leaked FROM c GROUP BY 1""")
def intersect_leakcheck(spark, sf):
    """Customers with orders on the train and on the test side, when orders or when customers are split by their hash."""
    o = table(spark, sf, "orders").select("o_custkey", split_of(F.col("o_orderkey").cast("string")).alias("row"), split_of(F.col("o_custkey").cast("string")).alias("entity"))
    sides = o.select("o_custkey", F.inline(F.array(*[F.struct(F.lit(k).alias("split_by"), F.col(k).alias("side")) for k in ("row", "entity")])))
    each = sides.filter("side <> 'skip'").distinct()
    leaked = each.filter("side = 'train'").drop("side").intersect(each.filter("side = 'test'").drop("side"))
    n = sides.select("split_by", "o_custkey").distinct().groupBy("split_by").agg(F.count("*").alias("entities"))
    return n.join(leaked.groupBy("split_by").agg(F.count("*").alias("leaked")), "split_by", "left").select("split_by", "entities", F.coalesce("leaked", F.lit(0)).alias("leaked"))
