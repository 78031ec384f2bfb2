"""Notation queries: strings built from the order lines, tokens, validity, winners."""

from pyspark.sql import functions as F

from ..functions import notation as N
from ..functions.numeric import once, r6
from ..presets import (COURT_W, DEPTHS, DIRECTIONS, ERROR_LETTERS, FAULT_LETTERS, FOREHAND, BACKHAND, OTHER_MARKS,
                       POINT_SCORES, SCORE_REPAIR, SHOT_LETTERS, SHOTS, SINGLES_MARGIN, CENTER_X)
from ..sources.tables import (SEQUENCE_SQL, TRACK_SQL, order_lines, sequences, spread_scan, table, track)
from .registry import query
from .registry import r6 as q6

# ---- points: one notation string per order line, in expressions both engines read ----
_A, _B = "l_partkey", "l_suppkey"


def _stroke(k: int) -> str:
    return (f"substr('fbrsvzopuylmhijktq', CAST(({_A} * {k} + {_B}) % 18 + 1 AS INT), 1)"
            f" || CASE WHEN ({_A} + {k}) % 4 = 0 THEN '' ELSE CAST(({_A} + {k}) % 4 AS STRING) END"
            f" || CASE WHEN ({_B} + {k}) % 3 = 0 THEN CAST(7 + {_A} % 3 AS STRING) ELSE '' END"
            f" || CASE WHEN ({_A} + {_B} + {k}) % 11 = 0 THEN '+' ELSE '' END")


_SERVE = (f"CASE {_A} % 9 WHEN 0 THEN '0' WHEN 1 THEN 'c6' WHEN 2 THEN '' WHEN 3 THEN '4' WHEN 4 THEN '4' WHEN 5 THEN '5' "
          "ELSE '6' END")
_END = (f"CASE WHEN ({_A} + {_B}) % 13 = 0 THEN '?' WHEN ({_A} + {_B}) % 17 = 0 THEN '' WHEN l_returnflag = 'A' THEN '*'"
        f" WHEN l_returnflag = 'N' THEN substr('nwdx!e', CAST({_B} % 6 + 1 AS INT), 1) || '@'"
        f" ELSE substr('nwdx', CAST({_B} % 4 + 1 AS INT), 1) || '#' END")
_BODY = (f"({_SERVE}) || " + " || ".join(f"CASE WHEN l_linenumber > {k} THEN {_stroke(k)} ELSE '' END" for k in range(1, 6))
         + f" || CASE WHEN {_A} % 29 = 0 THEN 'Z' ELSE '' END || ({_END})")
_FAULT = f"substr('456', CAST({_A} % 3 + 1 AS INT), 1) || CASE WHEN {_B} % 8 = 0 THEN '' ELSE substr('nwdxg', CAST({_B} % 5 + 1 AS INT), 1) END"
_SECOND = f"CASE WHEN {_B} % 7 = 0 THEN '5d' ELSE {_BODY} END"
POINT_COLUMNS = {
    "match_id": "l_orderkey", "pt": "l_linenumber", "part": "l_partkey", "supp": "l_suppkey",
    "first_": f"CASE WHEN l_discount >= 0.07 THEN {_FAULT} ELSE {_BODY} END",
    "second_": f"CASE WHEN l_discount >= 0.07 THEN {_SECOND} ELSE ' ' END",
    "svr": "CAST(1 + l_suppkey % 2 AS INT)",
    "attested": "CASE WHEN l_quantity < 20 THEN 0 ELSE CAST(1 + l_partkey % 2 AS INT) END",
    "flags": "CASE WHEN l_quantity > 48 THEN 'unseen' ELSE '' END",
}
_LINES = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in POINT_COLUMNS.items()) + " FROM lineitem"
POINTS_SQL = f"pts0 AS ({_LINES}), pts AS (SELECT *, CASE WHEN trim(second_) <> '' THEN second_ ELSE first_ END AS played FROM pts0)"


def points(spark, sf):
    """match_id, pt, part, supp, first_, second_, svr, attested, flags, played."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag"]
    df = once(spread_scan(table(spark, sf, "lineitem").select(*cols)), body=F.expr(_BODY))
    df = df.select(*[F.expr(e.replace(_BODY, "body")).alias(n) for n, e in POINT_COLUMNS.items()])
    return df.withColumn("played", N.played(F.col("first_"), F.col("second_")))


def cls(chars: str) -> str:
    return N.char_class(chars)


def in_sql(expr: str, chars: str) -> str:
    return f"{expr} IN ({', '.join(repr(c) for c in chars)})"


def ending_sql(p: str) -> str:
    bare = f"regexp_replace({p}, '[@#!]+$', '')"
    return f"CASE WHEN {p} LIKE '%*' THEN '*' WHEN {in_sql(f'right({bare}, 1)', 'nwdx')} THEN right({bare}, 1) ELSE '?' END"


def serve_sql(p: str) -> str:
    return f"'s' || CASE WHEN {in_sql(f'left({p}, 1)', '456')} THEN left({p}, 1) ELSE '?' END"


def strokes_sql(body: str, shots: str) -> str:
    c = cls(shots)
    return (f"list_transform(regexp_extract_all({body}, '{c}[^{c[1:]}*'), lambda m: CASE WHEN {in_sql('left(m, 1)', FOREHAND)} THEN 'f'"
            f" WHEN {in_sql('left(m, 1)', BACKHAND)} THEN 'b' ELSE '?' END || coalesce(nullif(regexp_extract(m, '[123]'), ''), '?'))")


def tokens_sql(p: str) -> str:
    return f"list_concat(list_concat([{serve_sql(p)}], {strokes_sql(f'substr({p}, 2)', SHOTS)}), [{ending_sql(p)}])"


def draft_sql(d: str) -> str:
    """Needs d as a plain column name."""
    core = f"regexp_replace(regexp_replace({d}, '^s', ''), '[@#!]+$', '')"
    known = in_sql(f"right({core}, 1)", "*nwdx?")
    body = f"(CASE WHEN {known} THEN regexp_replace({core}, '.$', '') ELSE {core} END)"
    return (f"list_concat(list_concat([{serve_sql(body)}], {strokes_sql(f'substr({body}, 2)', SHOTS + '?')}),"
            f" [CASE WHEN {known} THEN right({core}, 1) ELSE '?' END])")


# The draft of a played string: lost, doubled, misread and unknown strokes.
DRAFT_EXPR = ("'s' || translate(CASE WHEN part % 5 = 0 THEN replace(played, 'r', '') WHEN part % 6 = 0 THEN replace(played, 'b', 'bf2b')"
              " ELSE played END, 'fhijkt1d', 'b?????2w')")


KEY = ["match_id", "pt", "part", "supp"]
KEY_SQL = "match_id, pt, part, supp"


@query("tokenize_points", f"WITH {POINTS_SQL} SELECT {KEY_SQL}, played, array_to_string({tokens_sql('played')}, ' ') AS tokens FROM pts")
def tokenize_points(spark, sf):
    return points(spark, sf).select(*KEY, "played", F.array_join(N.point_tokens(F.col("played")), " ").alias("tokens"))


@query("tokenize_draft", f"WITH {POINTS_SQL}, d AS (SELECT *, {DRAFT_EXPR} AS draft FROM pts) SELECT {KEY_SQL}, draft, array_to_string({draft_sql('draft')}, ' ') AS tokens FROM d")
def tokenize_draft(spark, sf):
    df = points(spark, sf).withColumn("draft", F.expr(DRAFT_EXPR))
    return df.select(*KEY, "draft", F.array_join(N.draft_tokens(F.col("draft")), " ").alias("tokens"))


@query("played_string", f"WITH {POINTS_SQL} SELECT {KEY_SQL}, played, CASE WHEN trim(second_) <> '' THEN '2nd' ELSE '1st' END AS served FROM pts")
def played_string(spark, sf):
    return points(spark, sf).select(*KEY, "played", F.when(F.trim("second_") != "", "2nd").otherwise("1st").alias("served"))


def exploded(spark, sf):
    """One row per stroke of every point. Strokes are rows first and columns then, which is compiled; structs built by a lambda are not."""
    df = once(points(spark, sf), p=F.trim("played")).filter(F.length("p") > 0)
    df = df.select(*KEY, "svr", "p", F.posexplode(F.concat(F.array(F.lit("")), N.stroke_runs(F.col("p")))).alias("shot_idx", "m"), N.n_strokes(F.col("p")).alias("last"))
    return df.select(*KEY, "svr", "shot_idx", F.when(F.col("shot_idx") % 2 == 0, F.col("svr")).otherwise(3 - F.col("svr")).alias("striker"),
                     *N.stroke(F.col("p"), F.col("m"), F.col("shot_idx"), F.col("last")))


_S, _NS = cls(SHOTS), cls(SHOTS)[1:]
STROKES_SQL = f"""sx AS (SELECT {KEY_SQL}, svr, trim(played) AS p, regexp_extract_all(substr(trim(played), 2), '{_S}[^{_NS}*') AS r FROM pts WHERE length(trim(played)) > 0),
  sy AS (SELECT *, unnest(list_concat([NULL], r)) AS m, generate_subscripts(list_concat([NULL], r), 1) - 1 AS shot_idx, len(r) AS last_idx,
     CASE WHEN {in_sql('right(p, 1)', '*@#')} THEN right(p, 1) ELSE '' END AS mark FROM sx),
  st AS (SELECT {KEY_SQL}, svr, CAST(shot_idx AS INT) AS shot_idx, CAST(CASE WHEN shot_idx % 2 = 0 THEN svr ELSE 3 - svr END AS INT) AS striker, m IS NULL AS is_serve,
    CASE WHEN m IS NULL THEN substr({serve_sql('p')}, 2, 1) ELSE '' END AS serve_zone, coalesce(left(m, 1), '') AS letter,
    CASE WHEN m IS NULL THEN 'serve' WHEN {in_sql('left(m, 1)', FOREHAND)} THEN 'fh' WHEN {in_sql('left(m, 1)', BACKHAND)} THEN 'bh' ELSE '?' END AS side,
    CASE WHEN m IS NULL THEN '' ELSE coalesce(nullif(regexp_extract(m, '[123]'), ''), '?') END AS dir,
    CASE WHEN m IS NULL THEN '' ELSE coalesce(nullif(regexp_extract(m, '[789]'), ''), '?') END AS depth,
    CASE WHEN shot_idx = last_idx THEN mark ELSE '' END AS ending,
    CASE WHEN shot_idx = last_idx AND mark IN ('@', '#') AND {in_sql("substr(p, length(p) - 1, 1)", ERROR_LETTERS)} THEN substr(p, length(p) - 1, 1) ELSE '' END AS err FROM sy)"""


@query("explode_shots", f"WITH {POINTS_SQL}, {STROKES_SQL} SELECT * FROM st")
def explode_shots(spark, sf):
    return exploded(spark, sf)


@query("structural_tokens", f"""WITH {POINTS_SQL}, k AS (SELECT {KEY_SQL}, {tokens_sql('played')} AS tk FROM pts)
  SELECT {KEY_SQL}, array_to_string(list_transform(tk[1:len(tk) - 1], lambda t: CASE WHEN length(t) = 2 AND t[1] = 's' THEN 's' ELSE t[1] END), ' ') AS tokens FROM k""")
def structural_tokens(spark, sf):
    return points(spark, sf).select(*KEY, F.array_join(N.structural(N.point_tokens(F.col("played"))), " ").alias("tokens"))


def _kind_sql(t: str) -> str:
    return f"CASE WHEN length({t}) = 2 AND left({t}, 1) = 's' THEN 'serve' WHEN length({t}) = 1 AND {in_sql(t, '*nwdx?')} THEN 'ending' ELSE 'rally' END"


_PAIRS_SQL = f"""tk AS (SELECT {tokens_sql('played')} AS a, {DRAFT_EXPR} AS draft FROM pts), td AS (SELECT a, {draft_sql('draft')} AS b FROM tk),
  pr AS (SELECT unnest(a) AS x, unnest(b) AS y FROM td WHERE len(a) = len(b)), dif AS (SELECT x, y, {_kind_sql('x')} AS kx, {_kind_sql('y')} AS ky FROM pr WHERE x <> y)"""


@query("classify_sub", f"""WITH {POINTS_SQL}, {_PAIRS_SQL} SELECT CASE WHEN kx <> ky THEN 'sub_crosstype' WHEN kx = 'serve' THEN 'sub_serve_zone' WHEN kx = 'ending' THEN 'sub_ending'
   WHEN x[1] = y[1] AND x[2] <> y[2] THEN 'sub_direction' WHEN x[2] = y[2] AND x[1] <> y[1] THEN 'sub_letter' ELSE 'sub_letter+dir' END AS cls, x AS truth_tok, y AS our_tok, count(*) AS n FROM dif GROUP BY ALL""")
def classify_sub(spark, sf):
    df = points(spark, sf).select("played", F.expr(DRAFT_EXPR).alias("draft"))
    df = once(df, a=N.point_tokens(F.col("played")), b=N.draft_tokens(F.col("draft")))
    df = df.filter(F.size("a") == F.size("b")).select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.a").alias("truth_tok"), F.col("z.b").alias("our_tok"))
    df = df.filter("truth_tok <> our_tok").groupBy("truth_tok", "our_tok").agg(F.count("*").alias("n"))
    return df.withColumn("cls", N.classify_sub(F.col("truth_tok"), F.col("our_tok")))


@query("token_kind", f"WITH {POINTS_SQL}, k AS (SELECT unnest({tokens_sql('played')}) AS t FROM pts) SELECT {_kind_sql('t')} AS kind, t AS token, count(*) AS n FROM k GROUP BY ALL")
def token_kind(spark, sf):
    df = points(spark, sf).select(F.explode(N.point_tokens(F.col("played"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return df.withColumn("kind", N.token_kind(F.col("token")))


@query("token_edit_distance", """WITH c AS (SELECT a.conv_id, a.turn, string_split(a.text, ' ') AS x, string_split(b.text, ' ') AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)
  SELECT conv_id, turn, CAST(len(x) AS INT) AS n_a, CAST(len(y) AS INT) AS n_b, CAST(list_reduce(list_transform(x, lambda w: list_transform(y, lambda v: CASE WHEN v = w THEN 0 ELSE 1 END)),
    lambda r, k: list_reduce(list_transform(range(1, len(k) + 1), lambda j: [least(r[j + 1] + 1, r[j] + k[j])]), lambda acc, e: list_append(acc, least(acc[-1] + 1, e[1])), [r[1] + 1]),
    CAST(range(0, len(y) + 1) AS INT[]))[-1] AS INT) AS distance FROM c""")
def token_edit_distance(spark, sf):
    """Edit distance of neighbouring turns over their whole word lists."""
    d = N.edit_distance(F.col("x"), F.col("y"))
    return adjacent_turns(spark, sf).select("conv_id", "turn", F.size("x").alias("n_a"), F.size("y").alias("n_b"), d.alias("distance"))


def adjacent_turns(spark, sf):
    c = spread_scan(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", F.split("text", " ").alias("x"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    return c.join(n, ["conv_id", "turn"])


@query("edit_backtrace")
def edit_backtrace(spark, sf):
    """Each distinct pair of orderings is aligned once, then joined back by its count."""
    pairs = sequences(spark, sf).groupBy("truth", "draft").agg(F.count("*").alias("n"))
    ops = N.edit_ops()
    df = pairs.select(F.col("truth").alias("a"), F.col("draft").alias("b"), "n", ops("truth", "draft").alias("o"))
    return df.select(F.array_join("a", " ").alias("truth"), F.array_join("b", " ").alias("draft"), "n",
                     F.size(F.filter("o", lambda o: o[0] != "match")).alias("distance"),
                     N.edit_distance(F.col("a"), F.col("b")).alias("native_distance"),
                     F.array_join(F.transform("o", lambda o: F.concat_ws(":", o)), " ").alias("ops"))


def _lint_sql(f: str, name: str, fault: str) -> str:
    known = cls(N.KNOWN)
    return f"""SELECT {KEY_SQL}, '{name}' AS field, CAST(pos AS INT) AS pos, msg FROM (
     SELECT {KEY_SQL}, -1 AS pos, 'empty' AS msg FROM lt WHERE {f} = ''
     UNION ALL SELECT {KEY_SQL}, 0, 'no serve digit at start' FROM lt WHERE {f} <> '' AND NOT {in_sql(f'left({f}, 1)', '0456')}
     UNION ALL SELECT {KEY_SQL}, i, CASE WHEN NOT regexp_matches(substr({f}, i + 1, 1), '{known}') THEN 'unknown mark' ELSE 'digit follows no shot' END
       FROM (SELECT *, unnest(range(length({f}))) AS i FROM lt) WHERE NOT regexp_matches(substr({f}, i + 1, 1), '{known}')
         OR (i > 0 AND regexp_matches(substr({f}, i + 1, 1), '{cls(DIRECTIONS + DEPTHS)}') AND NOT regexp_matches(substr({f}, 1, i), '{cls(SHOT_LETTERS)}'))
     UNION ALL SELECT {KEY_SQL}, -1, 'first should be a fault' FROM lt WHERE {fault} AND {f} <> '' AND NOT regexp_matches(substr({f}, 2), '{cls(FAULT_LETTERS)}')
     UNION ALL SELECT {KEY_SQL}, length({f}) - 1, 'no ending mark' FROM lt WHERE NOT ({fault}) AND {f} <> '' AND NOT {in_sql(f'right({f}, 1)', '*@#')}
     UNION ALL SELECT {KEY_SQL}, length({f}) - 1, 'error ending without an error letter' FROM lt WHERE NOT ({fault}) AND {in_sql(f'right({f}, 1)', '@#')}
        AND NOT {in_sql(f'substr({f}, greatest(length({f}) - 1, 0), CASE WHEN length({f}) > 1 THEN 1 ELSE 0 END)', ERROR_LETTERS)})"""


@query("notation_violations", f"""WITH {POINTS_SQL}, lt AS (SELECT {KEY_SQL}, trim(first_) AS f, trim(second_) AS s FROM pts)
  {_lint_sql('f', '1st', "s <> ''")} UNION ALL SELECT * FROM ({_lint_sql('s', '2nd', 'false')}) WHERE msg <> 'empty'""")
def notation_violations(spark, sf):
    f, s = F.trim("first_"), F.trim("second_")
    both = F.concat(N.violations(f, "1st", s != ""), F.when(s != "", N.violations(s, "2nd", F.lit(False))).otherwise(
        F.slice(N.violations(s, "2nd", F.lit(False)), 1, 0)))
    return points(spark, sf).select(*KEY, F.inline(both))


def winner_sql(f: str, s: str) -> str:
    tail = cls(OTHER_MARKS) + "+$"
    core = lambda c: f"regexp_replace({c}, '{tail}', '')"
    p = f"(CASE WHEN trim({s}) <> '' THEN trim({s}) ELSE trim({f}) END)"
    n = f"length(regexp_replace(substr({p}, 2), '[^{cls(SHOT_LETTERS)[1:]}', '', 'g'))"
    hitter = f"(CASE WHEN {n} % 2 = 0 THEN 1 ELSE 2 END)"
    end = f"right({core(p)}, 1)"
    return (f"CASE WHEN trim({s}) <> '' AND {in_sql(f'right({core(f'trim({s})')}, 1)', FAULT_LETTERS)} AND NOT regexp_matches({s}, '[*@#]') THEN 2"
            f" WHEN {end} = '*' THEN {hitter} WHEN {end} IN ('@', '#') THEN 3 - {hitter} END")


@query("derive_winner", f"WITH {POINTS_SQL} SELECT {KEY_SQL}, coalesce({winner_sql('first_', 'second_')}, 0) AS winner FROM pts")
def derive_winner(spark, sf):
    return points(spark, sf).select(*KEY, F.coalesce(N.winner(F.col("first_"), F.col("second_")), F.lit(0)).alias("winner"))


@query("append_validated", f"""WITH {POINTS_SQL}, v AS (SELECT {KEY_SQL}, flags = 'unseen' OR attested > 0 OR {winner_sql('first_', 'second_')} IS NOT NULL AS accepted FROM pts)
  SELECT {KEY_SQL}, accepted, CASE WHEN accepted THEN '' ELSE 'winner required' END AS reason FROM v""")
def append_validated(spark, sf):
    """Accepted points and the quarantine, told apart by `accepted`."""
    ok = (F.col("flags") == "unseen") | (F.col("attested") > 0) | N.winner(F.col("first_"), F.col("second_")).isNotNull()
    return points(spark, sf).select(*KEY, ok.alias("accepted")).withColumn("reason", F.when(F.col("accepted"), "").otherwise("winner required"))


@query("tokenize_chart_rows", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus AS token,
    CASE WHEN l_linenumber = 1 THEN 's' || CASE WHEN l_suppkey % 7 IN (4, 5, 6) THEN CAST(l_suppkey % 7 AS VARCHAR) ELSE '?' END
     ELSE CASE l_returnflag WHEN 'A' THEN 'f' WHEN 'N' THEN 'b' ELSE '?' END || CASE WHEN l_suppkey % 5 IN (1, 2, 3) THEN CAST(l_suppkey % 5 AS VARCHAR) ELSE '?' END END AS tok FROM lineitem),
  g AS (SELECT l_orderkey, list(tok ORDER BY l_linenumber, l_partkey, l_suppkey, token, tok) AS ts, list(token ORDER BY l_linenumber, l_partkey, l_suppkey, token, tok) AS raw FROM r GROUP BY 1)
  SELECT l_orderkey AS entity_id, array_to_string(list_concat(list_concat(CASE WHEN left(ts[1], 1) = 's' THEN [] ELSE ['s?'] END, ts), [CASE WHEN raw[-1] LIKE '%F' THEN '*' ELSE '?' END]), ' ') AS tokens FROM g""")
def tokenize_chart_rows(spark, sf):
    li = order_lines(spark, sf)
    zone = lambda m, legal: F.when((F.col("l_suppkey") % m).isin(*legal), (F.col("l_suppkey") % m).cast("string")).otherwise("?")
    side = F.when(F.col("token").startswith("A"), "f").when(F.col("token").startswith("N"), "b").otherwise("?")
    tok = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("s"), zone(7, (4, 5, 6)))).otherwise(F.concat(side, zone(5, (1, 2, 3))))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "token", tok.alias("tok"))))
    g = li.groupBy("l_orderkey").agg(rows.alias("r"))
    ts = F.transform("r", lambda s: s["tok"])
    lead = F.when(F.get("r", 0)["tok"].startswith("s"), F.slice(ts, 1, 0)).otherwise(F.array(F.lit("s?")))
    end = F.array(F.when(F.element_at("r", -1)["token"].endswith("F"), "*").otherwise("?"))
    return g.select(F.col("l_orderkey").alias("entity_id"), F.array_join(F.concat(lead, ts, end), " ").alias("tokens"))


@query("label_from_evidence", f"WITH {SEQUENCE_SQL} SELECT entity_id, array_to_string(list_transform(truth, lambda t, i: CASE WHEN i = 1 THEN 's' || t ELSE t END), '') || '*' AS label FROM q")
def label_from_evidence(spark, sf):
    label = F.transform("truth", lambda t, i: F.when(i == 0, F.concat(F.lit("s"), t)).otherwise(t))
    return sequences(spark, sf).select("entity_id", F.concat(F.array_join(label, ""), F.lit("*")).alias("label"))


# ---- scores of the orders table: match = customer, state from the key's digits ----
STATE = {
    "match_id": "o_custkey", "pt": "o_orderkey",
    "set1": "CAST(o_orderkey % 2 AS INT)", "set2": "CAST(floor(o_orderkey / 2) % 2 AS INT)",
    "gm1": "CAST(floor(o_orderkey / 4) % 7 AS INT)", "gm2": "CAST(floor(o_totalprice) % 7 AS INT)",
    "pa": "CASE CAST(floor(o_totalprice / 7) % 5 AS INT) WHEN 0 THEN '0' WHEN 1 THEN '15' WHEN 2 THEN '30' WHEN 3 THEN '40' ELSE 'AD' END",
    "pb": "CASE CAST(floor(o_totalprice / 31) % 4 AS INT) WHEN 0 THEN '0' WHEN 1 THEN '15' WHEN 2 THEN '30' ELSE '40' END",
    "svr": "CAST(1 + floor(o_totalprice / 3) % 2 AS INT)",
}
STATE_SQL = "sc AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in STATE.items()) + ", o_orderstatus, o_orderpriority, o_totalprice FROM orders)"


def states(spark, sf):
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in STATE.items()], "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("pts_flip", f"WITH {STATE_SQL} SELECT match_id, pt, CASE WHEN svr = 2 THEN pb || '-' || pa ELSE pa || '-' || pb END AS pts FROM sc")
def pts_flip(spark, sf):
    return states(spark, sf).select("match_id", "pt", flip(F.concat_ws("-", "pa", "pb"), F.col("svr")).alias("pts"))


def flip(pts, svr):
    """Server-first to player-1-first and back: reversed when player 2 serves."""
    a, b = F.split_part(pts, F.lit("-"), F.lit(1)), F.split_part(pts, F.lit("-"), F.lit(2))
    return F.when((svr == 2) & pts.contains("-"), F.concat_ws("-", b, a)).otherwise(pts)


_READ = "CAST(CAST(floor(o_totalprice / {d}) AS BIGINT) % 50 AS STRING)"
_REPAIR_SQL = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SCORE_REPAIR.items()) + f" ELSE {c} END"


def _norm_sql(a: str, b: str) -> str:
    legal = "(" + ", ".join(f"'{v}'" for v in POINT_SCORES) + ")"
    return (f"CASE WHEN {a} = 'AD' THEN 'AD-40' WHEN {b} = 'AD' THEN '40-AD' ELSE (CASE WHEN {a} IN {legal} THEN {a} ELSE '0' END)"
            f" || '-' || (CASE WHEN {b} IN {legal} THEN {b} ELSE '0' END) END")


def normalize(a, b):
    """Legal player-1-first score from two raw reads: repair map, then '0' for junk."""
    repair = F.create_map(*[F.lit(x) for kv in SCORE_REPAIR.items() for x in kv])
    fix = lambda c: F.coalesce(F.try_element_at(repair, F.upper(F.trim(c))), F.upper(F.trim(c)))
    legal = lambda c: F.when(c.isin(*POINT_SCORES), c).otherwise("0")
    a, b = fix(a), fix(b)
    return F.when(a == "AD", "AD-40").when(b == "AD", "40-AD").otherwise(F.concat_ws("-", legal(a), legal(b)))


@query("pts_normalize", f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'AD' ELSE {_READ.format(d=10)} END AS a0, {_READ.format(d=100)} AS b0 FROM orders),
  f AS (SELECT o_orderkey, {_REPAIR_SQL('a0')} AS a, {_REPAIR_SQL('b0')} AS b FROM r) SELECT o_orderkey AS pt, {_norm_sql('a', 'b')} AS pts FROM f""")
def pts_normalize(spark, sf):
    a = F.expr(f"CASE WHEN o_orderkey % 9 = 0 THEN 'ad ' ELSE {_READ.format(d=10)} END")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("pt"), normalize(a, F.expr(_READ.format(d=100))).alias("pts"))


@query("pressure_bucket", f"""WITH {STATE_SQL}, p AS (SELECT pa || '-' || pb AS s FROM sc)
  SELECT CASE WHEN s IN ('40-AD', 'AD-40', '30-40', '40-30') THEN 'pressure' WHEN s = '0-0' THEN 'start' WHEN s LIKE '%AD%' THEN 'pressure' ELSE 'mid' END AS bucket, count(*) AS n FROM p GROUP BY 1""")
def pressure_bucket(spark, sf):
    return states(spark, sf).select(pressure(F.concat_ws("-", "pa", "pb")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def pressure(s):
    return (F.when(s.isin("40-AD", "AD-40", "30-40", "40-30"), "pressure").when(s == "0-0", "start")
            .when(s.contains("AD"), "pressure").otherwise("mid"))


# ---- thirds ----
def serve_zone(x, left):
    """Thirds of the service box towards the centre line: 6 nearest, 4 widest."""
    x0 = F.when(left, F.lit(SINGLES_MARGIN)).otherwise(F.lit(CENTER_X))
    x1 = F.when(left, F.lit(CENTER_X)).otherwise(F.lit(COURT_W - SINGLES_MARGIN))
    t = F.least(F.greatest((x - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))
    c = F.when(left, 1 - t).otherwise(t)
    return F.when(c < 1 / 3, 6).when(c < 2 / 3, 5).otherwise(4)


@query("zone_bin", f"""WITH {TRACK_SQL}, z AS (SELECT entity_id, event_id, entity_id % 2 = 0 AS lf, cx, CASE WHEN entity_id % 2 = 0 THEN {SINGLES_MARGIN} ELSE {CENTER_X} END::DOUBLE AS x0,
    CASE WHEN entity_id % 2 = 0 THEN {CENTER_X} ELSE {COURT_W - SINGLES_MARGIN} END::DOUBLE AS x1 FROM t),
  c AS (SELECT *, CASE WHEN lf THEN 1 - least(greatest((cx - x0) / (x1 - x0), 0.0), 1.0) ELSE least(greatest((cx - x0) / (x1 - x0), 0.0), 1.0) END AS c FROM z)
  SELECT entity_id, event_id, CASE WHEN c < 1.0::DOUBLE / 3 THEN 6 WHEN c < 2.0::DOUBLE / 3 THEN 5 ELSE 4 END AS zone FROM c""")
def zone_bin(spark, sf):
    return track(spark, sf).select("entity_id", "event_id", serve_zone(F.col("cx"), F.col("entity_id") % 2 == 0).alias("zone"))


@query("thirds_digit", f"""WITH {TRACK_SQL}, z AS (SELECT entity_id, event_id, cy >= {COURT_W} AS near, CASE WHEN cx < {COURT_W / 3} THEN 0 WHEN cx < {2 * COURT_W / 3} THEN 1 ELSE 2 END AS z FROM t)
  SELECT entity_id, event_id, CAST(CASE WHEN near THEN 2 - z ELSE z END + 1 AS VARCHAR) AS digit FROM z""")
def thirds_digit(spark, sf):
    from .signals import digit
    return track(spark, sf).select("entity_id", "event_id", digit(F.col("cx"), F.col("cy") >= COURT_W).alias("digit"))


# ---- vectors ----
def next_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


_VEC_SQL = "v AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"


def total(a):
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


@query("similarity_ncc", f"""WITH {_VEC_SQL}, c AS (SELECT vec_id, list_transform(a, lambda v: v - list_sum(a) / len(a)) AS a, list_transform(b, lambda v: v - list_sum(b) / len(b)) AS b FROM v)
  SELECT vec_id, {q6('list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))')} AS ncc FROM c""")
def similarity_ncc(spark, sf):
    centre = lambda c: F.transform(c, lambda v: v - total(F.col(c)) / F.size(c))
    df = next_vectors(spark, sf).select("vec_id", centre("a").alias("a"), centre("b").alias("b"))
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    d = F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b"))
    return df.select("vec_id", r6(F.when(d > 1e-6, dot("a", "b") / d).otherwise(0.0)).alias("ncc"))


@query("changed_fraction", f"""WITH {_VEC_SQL}, c AS (SELECT vec_id, list_transform(a, lambda v: v - list_sum(a) / len(a)) AS a, list_transform(b, lambda v: v - list_sum(b) / len(b)) AS b FROM v)
  SELECT vec_id, {q6("list_min(list_transform([-2, 0, 2], lambda s: len(list_filter(range(3, len(b) - 1), lambda i: abs(a[i + s] - b[i]) > 0.15)) / (len(b) - 4)))")} AS changed FROM c""")
def changed_fraction(spark, sf):
    """Smallest share of changed cells over small shifts of the centred vectors."""
    centre = lambda c: F.transform(c, lambda v: v - total(F.col(c)) / F.size(c))
    df = next_vectors(spark, sf).select("vec_id", centre("a").alias("a"), centre("b").alias("b"))
    n = F.size("b") - 4
    diff = lambda s: F.size(F.filter(F.sequence(F.lit(2), F.size("b") - 3), lambda i: F.abs(F.get("a", i + s) - F.get("b", i)) > 0.15)) / n
    return df.select("vec_id", r6(F.least(diff(-2), diff(0), diff(2))).alias("changed"))
