"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from ..functions.numeric import count_if, r6
from ..sources import readers, sinks
from ..sources.tables import sequences, table
from .aggregates import sums
from .registry import query
from .registry import r6 as q6


@query("scan_typed", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def scan_typed(spark, sf):
    """A CSV table read back through its schema."""
    path = sinks.work_dir(spark, "typed")
    table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "l_orderkey LONG, l_linenumber INT, l_quantity DOUBLE, l_returnflag STRING")


@query("scan_partitioned_entity", f"SELECT user_id % 8 AS entity, count(*) AS n, {q6('sum(value)')} AS total FROM events GROUP BY 1")
def scan_partitioned_entity(spark, sf):
    path = sinks.work_dir(spark, "entities")
    sinks.write_entities(table(spark, sf, "events").select("event_id", "value", (F.col("user_id") % 8).alias("group_id")), path, "group_id")
    df = readers.read_entities(spark, path, "event_id LONG, value DOUBLE")
    return df.groupBy("entity").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("scan_pruned_lookup", """WITH p AS (SELECT o_custkey, year(o_orderdate) AS era FROM orders WHERE o_custkey % 2 = 1)
  SELECT CAST(era AS BIGINT) AS era, count(*) AS n FROM p WHERE era >= 1997 GROUP BY 1 UNION ALL SELECT -1, count(*) FROM customer WHERE c_custkey % 2 = 1 AND c_custkey NOT IN (SELECT o_custkey FROM p WHERE era >= 1997)""")
def scan_pruned_lookup(spark, sf):
    """Lookup in a table laid out by tour and era: only the asked partitions are read.
    Indexed ids without points come back under era -1."""
    path = sinks.work_dir(spark, "lookup")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_custkey") % 2).alias("tour"), F.year("o_orderdate").cast("long").alias("era"))
    o.repartition("tour", "era", F.pmod(F.col("o_orderkey"), F.lit(4))).write.partitionBy("tour", "era").parquet(path)
    hit = spark.read.parquet(path).filter("tour = 1 AND era >= 1997")
    index = table(spark, sf, "customer").filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("o_custkey"))
    missing = index.join(hit, "o_custkey", "left_anti").agg(F.lit(-1).cast("long").alias("era"), F.count("*").alias("n"))
    return hit.groupBy(F.col("era").cast("long").alias("era")).agg(F.count("*").alias("n")).unionByName(missing)


@query("scan_json_tolerant", """WITH e AS (SELECT event_type, CASE WHEN event_id % 97 = 0 THEN '{"k": ' WHEN event_id % 101 = 0 THEN '  ' ELSE props END AS line FROM events)
  SELECT event_type, CAST(sum(CASE WHEN line <> '{"k": ' THEN 1 ELSE 0 END) AS BIGINT) AS n_good, CAST(sum(CASE WHEN line = '{"k": ' THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
   CAST(sum(CASE WHEN line <> '{"k": ' THEN CAST(regexp_extract(line, '(\\d+)', 1) AS BIGINT) ELSE 0 END) AS BIGINT) AS total FROM e WHERE trim(line) <> '' GROUP BY 1""")
def scan_json_tolerant(spark, sf):
    line = F.when(F.col("event_id") % 97 == 0, '{"k": ').when(F.col("event_id") % 101 == 0, "  ").otherwise(F.col("props"))
    df = readers.parse_json_lines(table(spark, sf, "events").select("event_type", line.alias("line")), "line", "k LONG")
    return df.groupBy("event_type").agg(count_if(~F.col("bad")).alias("n_good"), count_if(F.col("bad")).alias("n_bad"),
                                        F.sum(F.when(~F.col("bad"), F.col("j.k")).otherwise(0)).alias("total"))


@query("scan_two_shapes", f"""SELECT 'export' AS shape, count(*) AS n, CAST(0 AS BIGINT) AS timed, CAST(sum(o_orderkey) AS BIGINT) AS pts FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT 'session', count(*), {sums(timed='o_totalprice % 100 < 60')}, CAST(0 AS BIGINT) FROM orders WHERE o_orderkey % 3 <> 0""")
def scan_two_shapes(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("pt"), F.col("o_orderstatus").alias("played"))
    b = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderstatus").alias("first"), (F.col("o_totalprice") % 100).alias("start_s"), F.lit(60.0).alias("end_s"))
    rows = readers.read_points(a).unionByName(readers.read_points(b), allowMissingColumns=True)
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.count("start_s").alias("timed"), F.coalesce(F.sum("pt"), F.lit(0)).alias("pts"))


# Per-segment settings; anything not named takes the default. Fixed, at most one row per segment.
SETTINGS = {"BUILDING": {"best_of": "5"}, "MACHINERY": {"final_set": "adv", "best_of": "5"}, "HOUSEHOLD": {"final_set": "tb10"}}
DEFAULTS = {"best_of": "3", "final_set": "tb7", "start_end": "far"}


def _setting_sql(k: str) -> str:
    arms = " ".join(f"WHEN '{s}' THEN '{v[k]}'" for s, v in SETTINGS.items() if k in v)
    return f"CASE c_mktsegment {arms} ELSE '{DEFAULTS[k]}' END" if arms else f"'{DEFAULTS[k]}'"


@query("scan_config", "SELECT c_custkey, " + ", ".join(f"{_setting_sql(k)} AS {k}" for k in DEFAULTS) + " FROM customer")
def scan_config(spark, sf):
    """Every customer with the settings of its segment, defaults filled in."""
    cfg = spark.createDataFrame([(s, {**DEFAULTS, **v}) for s, v in SETTINGS.items()], "c_mktsegment string, cfg map<string,string>")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(F.broadcast(cfg), "c_mktsegment", "left")
    return c.select("c_custkey", *[F.coalesce(F.try_element_at("cfg", F.lit(k)), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


@query("sink_partitioned", "SELECT o_orderpriority AS group_id, count(*) AS shots, count(DISTINCT l_orderkey) AS entities FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def sink_partitioned(spark, sf):
    """Shot rows in one folder per group, read back and summarised."""
    path = sinks.work_dir(spark, "shots")
    rows = sequences(spark, sf).select("group_id", "entity_id", F.posexplode("truth").alias("shot", "token"))
    sinks.write_entities(rows, path, "group_id")
    back = spark.read.schema("entity_id LONG, shot INT, token STRING, group_id STRING").option("header", True).csv(path)
    per = back.groupBy("group_id", "entity_id").agg(F.count("*").alias("n"))
    return per.groupBy("group_id").agg(F.sum("n").alias("shots"), F.count("*").alias("entities"))


@query("sink_no_overwrite", "SELECT a AS attempt, r AS result, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n FROM (VALUES (1, 'would write'), (2, 'written'), (3, 'refused'), (4, 'written')) v(a, r)")
def sink_no_overwrite(spark, sf):
    path = sinks.work_dir(spark, "once")
    df = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    done = [(1, sinks.write_new(df, path, dry_run=True)), (2, sinks.write_new(df, path)), (3, sinks.write_new(df, path)), (4, sinks.write_new(df, path, force=True))]
    report = spark.createDataFrame(done, "attempt int, result string")
    return report.join(F.broadcast(spark.read.parquet(path).agg(F.count("*").alias("n"))))      # one row


@query("sink_append_log", "SELECT CASE event_type WHEN 'view' THEN 'a' ELSE 'b' END AS session, 'cold' AS mode, count(*) AS n, count(*) AS stamped FROM events GROUP BY 1")
def sink_append_log(spark, sf):
    path = sinks.work_dir(spark, "log")
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    for session, mine in (("a", F.col("event_type") == "view"), ("b", F.col("event_type") != "view")):
        sinks.append_log(e.filter(mine), path, session, "cold")
    log = spark.read.schema("event_id LONG, session STRING, mode STRING, server_ts_ms LONG").json(path)
    return log.groupBy("session", "mode").agg(F.count("*").alias("n"), F.count("server_ts_ms").alias("stamped"))


def _digest_sql(where: str, price: str) -> str:
    """Rows as length=cell|length=cell|..., columns by name, ~ for null; the sum of the first 60 bits of their md5."""
    text = [f"CAST({price if c == 'o_totalprice' else c} AS VARCHAR)" for c in ORDER_COLUMNS]
    cells = " || '|' || ".join(f"coalesce(length({t}) || '=' || {t}, '~')" for t in text)
    return f"SELECT '{where}' AS snapshot, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5({cells}), 1, 15)) AS BIGINT)) AS VARCHAR) AS digest FROM orders"


ORDER_COLUMNS = ["o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]


@query("snapshot_fingerprint", " UNION ALL ".join(_digest_sql(w, p) for w, p in (
    ("frozen", "o_totalprice"), ("reordered", "o_totalprice"), ("edited", "CASE WHEN o_orderkey = 1 THEN o_totalprice + 1 ELSE o_totalprice END"))))
def snapshot_fingerprint(spark, sf):
    """Fingerprint of the orders, of the same rows in another order, and with one cell changed."""
    o = table(spark, sf, "orders").select(ORDER_COLUMNS)
    bump = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    out = None
    for name, df in (("frozen", o), ("reordered", o.repartition("o_custkey")), ("edited", bump)):
        f = sinks.fingerprint(df).withColumn("snapshot", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


@query("seeded_sample", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 30")
def seeded_sample(spark, sf, n: int = 30, seed: int = 42):
    """n gradeable rows, the same for every run of a seed, in file order."""
    pool = table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("c_custkey").cast("string")).cast("binary"))
    return pool.orderBy(key, "c_custkey").limit(n).orderBy("c_custkey")


@query("latest_wins", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_wins(spark, sf):
    m = F.max(F.struct("ts", "event_id", "value")).alias("m")
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(m).select("user_id", "event_type", "m.event_id", "m.value")


_VAL = "round_even(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 3)"


@query("metric_history_upsert", f"""WITH h AS (SELECT o_orderpriority AS metric, date_trunc('month', o_orderdate) AS day, {_VAL} AS v FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2),
   l AS (SELECT metric, arg_max(v, day) AS last_v FROM h GROUP BY 1), n AS (SELECT o_orderpriority AS metric, {_VAL} AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
   SELECT n.metric, {q6('n.v')} AS value, CASE WHEN last_v IS NULL OR abs(round_even(last_v - n.v, 6)) >= 0.005 THEN 'append' ELSE 'keep' END AS action FROM n LEFT JOIN l USING (metric)""")
def metric_history_upsert(spark, sf):
    """Append a trend point only when the metric moved by half a percent point."""
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "metric")
    v = F.bround(F.avg(F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0)), 3)
    day = F.date_trunc("month", "o_orderdate")
    h = o.filter("o_orderdate < TIMESTAMP_NTZ '2000-01-01'").groupBy("metric", day.alias("day")).agg(v.alias("v"))
    last = h.groupBy("metric").agg(F.max_by("v", "day").alias("last_v"))
    new = o.filter("o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").groupBy("metric").agg(v.alias("v"))
    j = new.join(last, "metric", "left")
    moved = F.col("last_v").isNull() | (F.abs(F.bround(F.col("last_v") - F.col("v"), 6)) >= 0.005)
    return j.select("metric", r6(F.col("v")).alias("value"), F.when(moved, "append").otherwise("keep").alias("action"))
