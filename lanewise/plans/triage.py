"""Calibrated triage: features, standardisation, models, thresholds and tiers."""

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import count_if, r6, ratio
from ..operators import folds as L
from ..operators import slices as S
from ..presets import MIN_FLAGS, PRECISION_TARGET
from ..session import cut_lineage
from ..sources.models import apply_model, load_model, save_model
from ..sources.sinks import work_dir
from ..sources.tables import sequences, spread_scan, table
from .aggregates import pooled, sums
from .grading import GRADED_SQL, graded, split_of
from .registry import query
from .registry import r6 as q6

FEATURES = ["log_chars", "line_repeat", "digit_share", "upper_share", "word_len"]
# A published model over the features above: means, deviations, weights, threshold.
MODEL = {"features": FEATURES, "mu": [6.5, 0.05, 0.02, 0.03, 5.5], "sd": [1.6, 0.15, 0.04, 0.02, 1.5], "weights": [0.9, -0.8, -0.7, -0.2, 0.3], "intercept": 1.6,
         "t_high": 0.9, "n_train": 0}

_LEN = lambda keep: f"length(regexp_replace(text, '[^{keep}]', '', 'g'))"
_ONE = "CAST(greatest(length(text), 1) AS DOUBLE)"
TRIAGE_SQL = f"""d0 AS (SELECT d.doc_id, source, text, quality AS good, toxic, string_split(text, chr(10)) AS ls FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  gs AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS group_id FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
  d AS (SELECT doc_id, source, group_id, good, toxic,
    ln(1 + length(text)) AS log_chars, (len(ls) - len(list_distinct(ls)))::DOUBLE / len(ls) AS line_repeat, {_LEN('0-9')} / {_ONE} AS digit_share, {_LEN('A-Z')} / {_ONE} AS upper_share,
    length(text) / CAST(len(string_split(text, ' ')) AS DOUBLE) AS word_len FROM d0 JOIN gs USING (source))"""


def groups(spark, sf):
    """The sources, numbered by name: the groups that are held out. One row a source; the window orders names only."""
    names = table(spark, sf, "documents").where("source is not null").select("source").distinct()
    return names.select("source", (F.row_number().over(Window.orderBy("source")) - 1).cast("long").alias("group_id"))


def docs(spark, sf):
    """One row per labelled document: its source's number, label and whole-text features. A document without source is in no group."""
    d = spread_scan(table(spark, sf, "documents").select("doc_id", "source", "text")).join(table(spark, sf, "labels"), "doc_id").join(groups(spark, sf), "source")
    n = F.greatest(F.length("text"), F.lit(1)).cast("double")
    kept = lambda c: F.length(F.regexp_replace("text", f"[^{c}]", "")) / n
    lines = F.split("text", "\n")
    return d.select("doc_id", "source", "group_id", F.col("quality").alias("good"), "toxic", F.log(1.0 + F.length("text")).alias("log_chars"),
                    ((F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines)).alias("line_repeat"), kept("0-9").alias("digit_share"),
                    kept("A-Z").alias("upper_share"), (F.length("text") / F.size(F.split("text", " "))).alias("word_len"))


_LOGIT = " + ".join(f"({w}::DOUBLE * (({f} - {m}::DOUBLE) / {s}::DOUBLE))" for f, m, s, w in zip(FEATURES, MODEL["mu"], MODEL["sd"], MODEL["weights"]))
SCORED_SQL = f"""{TRIAGE_SQL}, sc AS (SELECT *, round_even(1 / (1 + exp(-({MODEL['intercept']}::DOUBLE + {_LOGIT}))), 9) AS p, line_repeat < 0.3 AND toxic = 0 AS gate FROM d),
  fl AS (SELECT *, p >= {MODEL['t_high']} AND gate AS high FROM sc)"""


def scored(spark, sf, model: dict = MODEL):
    """A model applied to the features; high when p reaches the threshold and the gate holds."""
    df = apply_model(docs(spark, sf), model).withColumn("gate", (F.col("line_repeat") < 0.3) & (F.col("toxic") == 0))
    return df.withColumn("high", F.col("above") & F.col("gate")).drop("above")


@query("score_model", f"WITH {SCORED_SQL} SELECT doc_id, {q6('p')} AS p, high FROM fl")
def score_model(spark, sf):
    """The published model, saved as a version and loaded again."""
    folder = work_dir(spark, "model")
    return scored(spark, sf, load_model(spark, folder, save_model(spark, folder, MODEL))).select("doc_id", r6(F.col("p")).alias("p"), "high")


def fold_stats(df):
    """Per held-out group: mean and population deviation over all the other groups.

    Counts, means and squared deviations are taken once per group and moved to the common mean, so large means
    do not cancel; a fold has the totals minus its own, so rows are never multiplied by the folds.
    """
    g = df.groupBy("group_id").agg(F.count("*").alias("n"), *[a for f in FEATURES for a in (F.avg(f).alias(f"m_{f}"), (F.var_pop(f) * F.count("*")).alias(f"d_{f}"))])
    g = g.join(F.broadcast(g.agg(*[(F.sum(F.col("n") * F.col(f"m_{f}")) / F.sum("n")).alias(f"c_{f}") for f in FEATURES])))        # one row
    off = {f: F.col(f"m_{f}") - F.col(f"c_{f}") for f in FEATURES}
    g = g.withColumns({f"s_{f}": F.col("n") * off[f] for f in FEATURES} | {f"q_{f}": F.col(f"d_{f}") + F.col("n") * off[f] * off[f] for f in FEATURES})
    tot = g.agg(*[F.sum(c).alias(f"t_{c}") for c in ["n", *[f"{k}_{f}" for f in FEATURES for k in "sq"]]])
    j = g.join(F.broadcast(tot))        # one row
    left = F.col("t_n") - F.col("n")
    n = F.nullif(left, F.lit(0))                                   # a group that is all there is has no training rows
    cols = [F.col("group_id"), left.alias("n_train")]
    for f in FEATURES:
        shift = (F.col(f"t_s_{f}") - F.col(f"s_{f}")) / n
        var = F.greatest((F.col(f"t_q_{f}") - F.col(f"q_{f}")) / n - shift * shift, F.lit(0.0))
        cols += [(F.col(f"c_{f}") + shift).alias(f"mu_{f}"), F.when(var < 1e-18, 1.0).otherwise(F.sqrt(var)).alias(f"sd_{f}")]
    return j.select(*cols)


@query("standardize", f"WITH {TRIAGE_SQL}, g AS (SELECT DISTINCT group_id FROM d), m AS (SELECT g.group_id, {', '.join(f'avg({f}) AS mu_{f}, stddev_pop({f}) AS sd_{f}' for f in FEATURES)} FROM g JOIN d ON d.group_id <> g.group_id GROUP BY 1) "
       f"SELECT doc_id, {', '.join(q6(f'({f} - mu_{f}) / sd_{f}', 4) + f' AS {f}' for f in FEATURES)} FROM d JOIN m USING (group_id)")
def standardize(spark, sf):
    """Held-out rows on the scale of their training groups."""
    df = cut_lineage(docs(spark, sf))
    z = df.join(F.broadcast(fold_stats(df)), "group_id")       # one row per fold
    return z.select("doc_id", *[r6((F.col(f) - F.col(f"mu_{f}")) / F.col(f"sd_{f}"), 4).alias(f) for f in FEATURES])


def scale(df, stats: dict):
    """Vector column of the features on the scale of one fold's training rows."""
    return df.withColumn("features", array_to_vector(F.array(*[(F.col(f) - stats[f"mu_{f}"]) / stats[f"sd_{f}"] for f in FEATURES])))


def fit(train, n: int, l2: float = 1.0):
    """Mean log-loss plus (l2 / 2n)|w|², free intercept."""
    lr = LogisticRegression(labelCol="good", featuresCol="features", regParam=l2 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10)
    return lr.fit(train)


def lomo(spark, sf):
    """Leave-one-source-out: p, the fold's threshold and its flag for every held-out row, and the models (group_id, mu, sd, weights, t_high).

    All models are fit together (see operators.folds), and their thresholds come from one ranking of all training rows.
    """
    df = cut_lineage(scored(spark, sf).drop("p", "high"))
    models = L.leave_one_out(df, FEATURES, "good", fold_stats(df))
    t = cut_lineage(precision_threshold(L.training(df, FEATURES, models, "doc_id", "good")).withColumnRenamed("fold", "group_id"))
    known = cut_lineage(models.table(df).join(t, "group_id", "left").withColumn("t_high", F.coalesce("t_high", F.lit(float("inf")))))
    out = L.held_out(df, FEATURES, models).join(F.broadcast(known.select("group_id", "t_high")), "group_id")       # one row a source
    return out.withColumn("high", (F.col("p") >= F.col("t_high")) & F.col("gate")), known


def precision_threshold(df, target: float = PRECISION_TARGET, min_flags: int = MIN_FLAGS):
    """Smallest p per fold whose running precision meets the target; infinity if none.

    The ranking is a prefix sum over slices of p, so no fold is ordered in one task.
    """
    df = S.add_slice(df.withColumn("_r", -F.col("p")), 0.001, "_r")
    df = S.running_sum(df, {"_n": F.lit(1), "_g": F.col("good")}, ("fold",), ("_r", "doc_id"))
    ok = (F.col("_n") >= min_flags) & (F.col("_g") / F.col("_n") >= target)
    return df.groupBy("fold").agg(F.coalesce(F.min(F.when(ok, F.col("p"))), F.lit(float("inf"))).alias("t_high"))


@query("running_precision_threshold", f"""WITH {SCORED_SQL}, f AS (SELECT DISTINCT group_id AS fold FROM fl), r AS (SELECT fold, p, count(*) OVER w AS n, sum(good) OVER w AS g FROM f JOIN fl ON fl.group_id <> f.fold
     WINDOW w AS (PARTITION BY fold ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT fold, {q6('t')} AS t_high, t IS NOT NULL AS has_threshold FROM (SELECT fold, min(CASE WHEN n >= {MIN_FLAGS} AND g::DOUBLE / n >= {PRECISION_TARGET} THEN p END) AS t FROM r GROUP BY 1)""")
def running_precision_threshold(spark, sf):
    s = cut_lineage(scored(spark, sf).select("group_id", "doc_id", "good", "p"))
    folds = F.array(*[F.lit(r[0]).cast("long") for r in s.select("group_id").distinct().collect()]).cast("array<long>")       # one row a source
    rows = s.select("doc_id", "good", "p", F.explode(F.array_remove(folds, F.col("group_id"))).alias("fold"))
    t = precision_threshold(rows)
    return t.select("fold", r6(finite("t_high")).alias("t_high"), finite("t_high").isNotNull().alias("has_threshold"))


def finite(name: str):
    """A threshold, or null where no p meets the target."""
    return F.when(F.col(name) < float("inf"), F.col(name))


@query("logistic_fit")
def logistic_fit(spark, sf):
    """Coefficients of the penalised fit on all rows, on the standardised scale."""
    df = cut_lineage(docs(spark, sf).withColumn("group_id", F.lit(0)))
    st = df.agg(F.count("*").alias("n_train"), *[a for f in FEATURES for a in (F.avg(f).alias(f"mu_{f}"), F.stddev_pop(f).alias(f"sd_{f}"))]).first().asDict()
    st.update({k: v or 1.0 for k, v in st.items() if k.startswith("sd_")})
    m = fit(scale(df, st), st["n_train"])
    rows = [("intercept", float(m.intercept))] + list(zip(FEATURES, [float(w) for w in m.coefficients]))
    return spark.createDataFrame(rows, "name string, weight double").withColumn("weight", r6(F.col("weight"), 4))


@query("lomo_flags")
def lomo_flags(spark, sf):
    return lomo(spark, sf)[0].select("group_id", "doc_id", "good", r6(F.col("p"), 4).alias("p"), r6(finite("t_high"), 4).alias("t_high"), "high")


def tiers(df):
    g = df.groupBy("group_id").agg(F.count("*").alias("n"), count_if(F.col("high")).alias("n_high"), count_if(F.col("high") & (F.col("good") == 1)).alias("good_high"),
                                   count_if(~F.col("high") & (F.col("good") == 1)).alias("good_low"))
    g = pooled(g, [], ["n", "n_high", "good_high", "good_low"])
    return g.select("group_id", "n", "n_high", "good_high", r6(F.col("n_high") / F.col("n")).alias("coverage"), r6(ratio(F.col("good_low"), F.col("n") - F.col("n_high"))).alias("low_rate"))


@query("tier_table", f"""WITH {SCORED_SQL}, g AS (SELECT coalesce(group_id, -1) AS group_id, count(*) AS n, {sums(n_high='high', good_high='high AND good = 1', good_low='NOT high AND good = 1')} FROM fl GROUP BY GROUPING SETS ((group_id), ()))
   SELECT group_id, n, n_high, good_high, {q6('n_high::DOUBLE / n')} AS coverage, {q6('coalesce(good_low::DOUBLE / nullif(n - n_high, 0), 0)')} AS low_rate FROM g""")
def tier_table(spark, sf):
    return tiers(scored(spark, sf))


_BINS = {"d0_1": "d <= 1", "d2": "d = 2", "d3_5": "d BETWEEN 3 AND 5", "d6": "d >= 6"}


@query("tier_confusion", f"WITH {GRADED_SQL} SELECT CASE WHEN supp % 2 = 0 THEN 'high' ELSE 'low' END AS flag, {sums(**_BINS)}, count(*) AS total FROM gr GROUP BY 1")
def tier_confusion(spark, sf):
    return graded(spark, sf).groupBy(F.when(F.col("supp") % 2 == 0, "high").otherwise("low").alias("flag")).agg(
        *[count_if(F.expr(e)).alias(n) for n, e in _BINS.items()], F.count("*").alias("total"))


GATES = {"V0": "line_repeat < 0.3 AND toxic = 0", "V1": "line_repeat < 0.1", "V2": "toxic = 0", "V3": "line_repeat < 0.3 OR toxic = 0"}


@query("gate_ab")
def gate_ab(spark, sf):
    """Four gate variants over one leave-one-group-out fit: the gate is outside the model."""
    df = cut_lineage(lomo(spark, sf)[0])
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), (F.expr(g) & (F.col("p") >= F.col("t_high"))).alias("hi")) for v, g in GATES.items()])
    x = df.select("group_id", "good", F.inline(rows))
    g = x.groupBy("group_id", "variant").agg(F.count("*").alias("n"), count_if(F.col("hi")).alias("n_high"), count_if(F.col("hi") & (F.col("good") == 1)).alias("good_high"),
                                             count_if(F.col("hi") & (F.col("good") == 0)).alias("bad_high"))
    return pooled(g, ["variant"], ["n", "n_high", "good_high", "bad_high"])


@query("gate_autopsy")
def gate_autopsy(spark, sf):
    """Good rows that stayed low, by blocker, and the features that pull each fold down."""
    df, models = lomo(spark, sf)
    df = cut_lineage(df.join(F.broadcast(models.select("group_id", "mu", "sd")), "group_id"))          # one row a source
    w = models.select("group_id", "weights", F.col("t_high").alias("t"))
    above, good = F.col("p") >= F.col("t_high"), F.col("good") == 1
    z = [(F.col(f) - F.col("mu")[i]) / F.col("sd")[i] for i, f in enumerate(FEATURES)]
    g = df.groupBy("group_id").agg(count_if(good).alias("good"), count_if(good & F.col("high")).alias("flagged"), count_if(good & above & ~F.col("gate")).alias("gate_blocked"),
                                   count_if(good & ~above).alias("below"), *[F.avg(z[i]).alias(f"z{i}") for i in range(len(FEATURES))])
    j = g.join(F.broadcast(w), "group_id")          # one row per fold
    drags = F.array_sort(F.array(*[F.struct((F.col(f"z{i}") * F.col("weights")[i + 1]).alias("drag"), F.lit(f).alias("feature")) for i, f in enumerate(FEATURES)]))
    return j.select("group_id", "good", "flagged", "gate_blocked", "below", r6(finite("t"), 4).alias("t_high"),
                    F.array_join(F.transform(F.slice(drags, 1, 4), lambda s: s["feature"]), ",").alias("drags"))


@query("coverage_curve", f"""WITH {SCORED_SQL}, r AS (SELECT *, greatest(p, 1 - p) AS conf, (p >= 0.5) = (good = 1) AS ok FROM fl), o AS (SELECT *, row_number() OVER (ORDER BY conf DESC, doc_id) AS rk, count(*) OVER () AS n FROM r),
   k AS (SELECT unnest([100, 75, 50, 25]) AS k) SELECT k, count(*) AS n, {q6('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')} AS accuracy, {q6('min(conf)')} AS min_conf FROM o JOIN k ON rk <= greatest(1, CAST(round_even(o.n * k / 100.0, 0) AS BIGINT)) GROUP BY 1""")
def coverage_curve(spark, sf):
    """Accuracy of the most confident shares; ranks are prefix sums over confidence slices."""
    df = scored(spark, sf).select("doc_id", F.greatest(F.col("p"), 1 - F.col("p")).alias("conf"), ((F.col("p") >= 0.5) == (F.col("good") == 1)).alias("ok"))
    df = cut_lineage(df)        # four narrow columns; the text features are computed once
    df = S.add_slice(df.withColumn("one", F.lit(0)).withColumn("_r", -F.col("conf")), 0.001, "_r")
    df = S.running_sum(df, {"rk": F.lit(1)}, ("one",), ("_r", "doc_id"))
    n = df.agg(F.count("*").alias("n_all"))
    df = df.join(F.broadcast(n))        # one row
    rows = df.select("conf", "ok", "rk", "n_all", F.explode(F.array(*[F.lit(k) for k in (100, 75, 50, 25)])).alias("k"))
    top = rows.filter(F.col("rk") <= F.greatest(F.lit(1), F.bround(F.col("n_all") * F.col("k") / 100.0, 0).cast("long")))
    return top.groupBy("k").agg(F.count("*").alias("n"), r6(ratio(count_if(F.col("ok")), F.count("*"))).alias("accuracy"), r6(F.min("conf")).alias("min_conf"))


_BASE = "CASE WHEN log_chars < 5 THEN -1 WHEN line_repeat > 0.1 THEN 0 ELSE 1 END"


@query("learned_vs_baseline", f"""WITH {SCORED_SQL}, b AS (SELECT *, {_BASE} AS base FROM fl) SELECT coalesce(group_id, -1) AS group_id, count(*) AS n, {sums(learned='(p >= 0.5) = (good = 1)', baseline='base = good', committed='base >= 0', majority='good = 1')} FROM b GROUP BY GROUPING SETS ((group_id), ())""")
def learned_vs_baseline(spark, sf):
    df = scored(spark, sf).withColumn("base", F.expr(_BASE))
    g = df.groupBy("group_id").agg(F.count("*").alias("n"), count_if((F.col("p") >= 0.5) == (F.col("good") == 1)).alias("learned"), count_if(F.col("base") == F.col("good")).alias("baseline"),
                                   count_if(F.col("base") >= 0).alias("committed"), count_if(F.col("good") == 1).alias("majority"))
    return pooled(g, [], ["n", "learned", "baseline", "committed", "majority"])


@query("class_recall", f"""WITH {SCORED_SQL}, c AS (SELECT good AS cls, count(*) AS n, {sums(hit='(p >= 0.8) = (good = 1)')} FROM fl GROUP BY 1), a AS (SELECT sum(hit)::DOUBLE / sum(n) AS acc, max(n)::DOUBLE / sum(n) AS base FROM c)
   SELECT cls, n, {q6('hit::DOUBLE / n')} AS recall, {q6('acc')} AS accuracy, {q6('base')} AS base_rate, {q6('acc - base')} AS lift FROM c, a""")
def class_recall(spark, sf):
    c = scored(spark, sf).groupBy(F.col("good").alias("cls")).agg(F.count("*").alias("n"), count_if((F.col("p") >= 0.8) == (F.col("good") == 1)).alias("hit"))
    a = c.agg((F.sum("hit") / F.sum("n")).alias("acc"), (F.max("n") / F.sum("n")).alias("base"))
    return c.join(F.broadcast(a)).select("cls", "n", r6(F.col("hit") / F.col("n")).alias("recall"), r6(F.col("acc")).alias("accuracy"), r6(F.col("base")).alias("base_rate"), r6(F.col("acc") - F.col("base")).alias("lift"))


@query("forest_lomo")
def forest_lomo(spark, sf):
    """Bagged trees trained without each group, against the group's majority label."""
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 3).alias("group_id"), F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    e = cut_lineage(e.repartition("vec_id"))
    rf = RandomForestClassifier(numTrees=200, maxDepth=6, minInstancesPerNode=4, featureSubsetStrategy="sqrt", seed=0)
    out = None
    for held in range(3):
        m = rf.fit(e.filter(F.col("group_id") != held))
        p = m.transform(e.filter(F.col("group_id") == held)).select("group_id", "vec_id", "label", "prediction", F.array_max(vector_to_array("probability")).alias("conf"))
        out = p if out is None else out.unionByName(p)
    return out.select("group_id", "vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), r6(F.col("conf"), 4).alias("conf"))


@query("onehot_logistic")
def onehot_logistic(spark, sf):
    """Next-token model on one-hot context, trained and tested on a hash split of the orders."""
    back = lambda i, k: F.when(i >= k, F.get("truth", i - k)).otherwise("none")
    rows = F.transform("truth", lambda t, i: F.struct(F.substring(t, 1, 1).alias("y"), back(i, 1).alias("p1"), back(i, 2).alias("p2"), F.least(i, F.lit(12)).cast("string").alias("pos")))
    df = sequences(spark, sf).groupBy(split_of(F.col("entity_id").cast("string"), 100).alias("split"), "truth").agg(F.count("*").alias("k"))
    # equal sequences are opened once, equal rows are one weighted row: the fit sees hundreds of rows, not the corpus
    df = df.select("split", "k", F.inline(rows))
    df = cut_lineage(df.groupBy("split", "y", "p1", "p2", "pos").agg(F.sum("k").cast("double").alias("n")))
    tr, te = df.filter("split = 'train'"), df.filter("split = 'test'")
    cols = ["p1", "p2", "pos"]
    ix = StringIndexer(inputCols=["y", *cols], outputCols=["label", *[f"{c}_i" for c in cols]], handleInvalid="keep", stringOrderType="alphabetAsc").fit(tr)
    oh = OneHotEncoder(inputCols=[f"{c}_i" for c in cols], outputCols=[f"{c}_v" for c in cols], handleInvalid="keep").fit(ix.transform(tr))
    va = VectorAssembler(inputCols=[f"{c}_v" for c in cols], outputCol="features")
    prep = lambda d: va.transform(oh.transform(ix.transform(d)))
    n = tr.agg(F.sum("n")).first()[0]
    m = LogisticRegression(weightCol="n", regParam=1.0 / n, maxIter=100).fit(prep(tr))
    p = m.transform(prep(te))
    base = tr.groupBy("y").agg(F.sum("n").alias("k")).agg(F.max_by("y", F.struct("k", "y")).alias("maj"))
    g = p.join(F.broadcast(base)).groupBy("y").agg(F.sum("n").cast("long").alias("n_test"), F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n")).otherwise(0)).cast("long").alias("hits"),
                                                  F.sum(F.when(F.col("y") == F.col("maj"), F.col("n")).otherwise(0)).cast("long").alias("base_hits"))
    return g.select("y", "n_test", "hits", "base_hits", r6(F.col("hits") / F.col("n_test")).alias("recall"))


@query("sink_json_report", f"""WITH {SCORED_SQL} SELECT group_id, '{{"n":' || count(*) || ',"n_high":' || CAST(coalesce(sum(CASE WHEN high THEN 1 ELSE 0 END), 0) AS BIGINT) || '}}' AS report FROM fl GROUP BY 1""")
def sink_json_report(spark, sf):
    """The sidecar a downstream report reads: one JSON object per group, written as a file and read back."""
    g = scored(spark, sf).groupBy("group_id").agg(F.count("*").alias("n"), count_if(F.col("high")).alias("n_high"))
    path = work_dir(spark, "report")
    g.write.mode("errorifexists").json(path)
    back = spark.read.schema(g.schema).json(path)
    return back.select("group_id", F.to_json(F.struct("n", "n_high")).alias("report"))



