"""Stateful folds over ordered logs, in batch and as streams."""

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import notation as N
from ..functions.numeric import count_if, once, r6
from ..operators import slices as S
from ..operators.compose import composed_fold
from ..operators.fold import fold
from ..operators.machines import Active, Gate, Plateau, Replay
from ..operators.score import Count, Rules
from ..operators.signal import BY_START
from ..presets import HOUR, TRACK
from ..session import cut_lineage
from ..sources.tables import TRACK_SQL, millis, sliced_track, track
from ..streaming.state import events_stream
from ..streaming.timers import drain, ending, timed_fold
from .notation import POINTS_SQL, points, winner_sql
from .registry import ORACLES, query
from .signals import W_SQL, flag_segments, q6

P = TRACK
IDLE = 24 * HOUR
LEVELS = Plateau(change=20.0, confirm=2, settle=3, close=P.absent_close)


# ---- active time ----
@query("active_time", f"""WITH {TRACK_SQL}, a AS (SELECT *, lag(seq) OVER w AS p, last_value(CASE WHEN kind = 'signup' THEN CAST(x % 5 AS BIGINT) WHEN kind = 'purchase' THEN -1 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_,
     coalesce(last_value(CASE WHEN kind = 'view' THEN 1 WHEN kind = 'click' THEN 0 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paused FROM t {W_SQL}),
   g AS (SELECT entity_id, open_ AS row_, seq - p AS gap FROM a WHERE open_ >= 0 AND paused = 0 AND p IS NOT NULL UNION ALL SELECT entity_id, CAST(x % 5 AS BIGINT), 0 FROM t WHERE kind = 'signup')
   SELECT entity_id, row_, CAST(sum(CASE WHEN gap <= {IDLE} THEN gap ELSE 0 END) AS BIGINT) AS active_ms, count(CASE WHEN gap > {IDLE} THEN 1 END) AS holes, CAST(sum(CASE WHEN gap > {IDLE} THEN gap ELSE 0 END) AS BIGINT) AS hole_ms FROM g GROUP BY 1, 2""")
def active_time(spark, sf):
    return active(sliced_track(spark, sf).withColumn("row_", (F.col("x") % 5).cast("long")))


def active(df):
    """Active time per row: gaps while a row is open and not paused; longer gaps are holes.

    kinds: signup opens a row, purchase closes it, view pauses, click resumes."""
    k = lambda n: F.col("kind") == n
    df = S.carry(df, {"open_": F.when(k("signup"), F.col("row_")).when(k("purchase"), F.lit(-1)),
                      "paused": F.when(k("view"), 1).when(k("click"), 0), "p": F.col("seq")}, True, False)
    live = (F.col("open_") >= 0) & (F.coalesce("paused", F.lit(0)) == 0) & F.col("p").isNotNull()
    own = F.struct(F.col("row_").alias("r"), F.lit(0).cast("long").alias("gap"))
    past = F.struct(F.col("open_").alias("r"), (F.col("seq") - F.col("p")).alias("gap"))
    parts = F.array_compact(F.array(F.when(live, past), F.when(k("signup"), own)))
    g = df.select("entity_id", F.inline(parts))
    idle = F.col("gap") > IDLE
    return g.groupBy("entity_id", F.col("r").alias("row_")).agg(
        F.sum(F.when(~idle, F.col("gap")).otherwise(0)).alias("active_ms"), count_if(idle).alias("holes"), F.sum(F.when(idle, F.col("gap")).otherwise(0)).alias("hole_ms"))


@query("active_time_online", ORACLES["active_time"])
def active_time_online(spark, sf):
    """The same from a stream: rows may come late by a day, and a silent entity is closed by its timer."""
    rows, end = ending(spark, stream_rows(spark, sf), ["entity_id"], "seq")
    return total_active(drain(timed_active(rows), "active", end))


def stream_rows(spark, sf, files: int | None = None):
    ev = events_stream(spark, sf, "events*.parquet", files)
    x = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("double")
    return ev.select(F.col("user_id").alias("entity_id"), millis("ts").alias("seq"), "event_id", F.col("event_type").alias("kind"), (x % 5).cast("long").alias("row_"))


def timed_active(df, delay: str = "1 day"):
    return timed_fold(df, ["entity_id"], ["seq", "event_id"], Active(IDLE), "seq", delay, P.absent_close)


def total_active(parts):
    return parts.groupBy("entity_id", "row_").agg(*[F.sum(c).alias(c) for c in ("active_ms", "holes", "hole_ms")])


# ---- score replay ----
def replay_sql(name: str, rows: str) -> str:
    """CTEs ending in `name`: rows(k, i, w, rel, ...) with the counters before each point, the server and the winner that counts.

    rows lists the points of each match k as i = 1, 2, ...; w is the known winner or 0, rel the winner as seen from the server.
    """
    return f"""{name}_in AS ({rows}),
  {name}_r AS (
    SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, 0 AS s1, 0 AS s2, 0 AS g1, 0 AS g2, 0 AS p1, 0 AS p2, 1 AS game_no, 1 AS opener FROM {name}_in
    UNION ALL
    SELECT k, i, s1, s2, CASE WHEN takes_set AND greatest(s1, s2) < 2 THEN 0 ELSE g1 END, CASE WHEN takes_set AND greatest(s1, s2) < 2 THEN 0 ELSE g2 END, p1, p2, game_no, opener FROM (
      SELECT k, i, takes_set, s1 + CAST(takes_set AND v = 1 AS INT) AS s1, s2 + CAST(takes_set AND v = 2 AS INT) AS s2, g1, g2, p1, p2, game_no, opener FROM (
        SELECT *, takes_game AND (tb OR (greatest(g1, g2) >= 6 AND abs(g1 - g2) >= 2)) AS takes_set FROM (
          SELECT k, i, v, tb, takes_game, s1, s2, g1 + CAST(takes_game AND v = 1 AS INT) AS g1, g2 + CAST(takes_game AND v = 2 AS INT) AS g2,
                 CASE WHEN takes_game THEN 0 ELSE p1 END AS p1, CASE WHEN takes_game THEN 0 ELSE p2 END AS p2,
                 game_no + CAST(takes_game AS INT) AS game_no, CASE WHEN takes_game THEN 3 - opener ELSE opener END AS opener FROM (
            SELECT *, greatest(p1, p2) >= CASE WHEN tb THEN 7 ELSE 4 END AND abs(p1 - p2) >= 2 AND v > 0 AS takes_game FROM (
              SELECT k, i, v, tb, s1, s2, g1, g2, p1 + CAST(v = 1 AS INT) AS p1, p2 + CAST(v = 2 AS INT) AS p2, game_no, opener FROM (
                SELECT *, CASE WHEN w > 0 THEN w WHEN rel = 0 THEN 0 WHEN rel = 1 THEN svr ELSE 3 - svr END AS v FROM (
                  SELECT r.*EXCLUDE (i), e.i, e.w, e.rel, r.g1 = 6 AND r.g2 = 6 AS tb,
                         CASE WHEN r.g1 = 6 AND r.g2 = 6 AND ((r.p1 + r.p2 + 1) // 2) % 2 = 1 THEN 3 - r.opener ELSE r.opener END AS svr
                  FROM {name}_r r JOIN {name}_in e ON e.k = r.k AND e.i = r.i + 1)))))))),
  {name} AS (
    SELECT *, CASE WHEN g1 = 6 AND g2 = 6 THEN a || '-' || b WHEN least(a, b) < 3 THEN {_call('a')} || '-' || {_call('b')} WHEN a = b THEN '40-40' WHEN a > b THEN 'AD-40' ELSE '40-AD' END AS pts,
           CASE rel WHEN 0 THEN 0 WHEN 1 THEN svr ELSE 3 - svr END AS derived FROM (
      SELECT *, CASE WHEN svr = 1 THEN p1 ELSE p2 END AS a, CASE WHEN svr = 1 THEN p2 ELSE p1 END AS b FROM (
        SELECT e.*, r.s1, r.s2, r.g1, r.g2, r.p1, r.p2, r.game_no,
               CASE WHEN r.g1 = 6 AND r.g2 = 6 AND ((r.p1 + r.p2 + 1) // 2) % 2 = 1 THEN 3 - r.opener ELSE r.opener END AS svr
        FROM {name}_in e JOIN {name}_r r ON r.k = e.k AND r.i = e.i - 1)))"""


def _call(n: str) -> str:
    return f"CASE {n} WHEN 0 THEN '0' WHEN 1 THEN '15' WHEN 2 THEN '30' ELSE '40' END"


def _points_sql(winner: str) -> str:
    return f"SELECT entity_id AS k, row_number() OVER (PARTITION BY entity_id ORDER BY seq, event_id) AS i, {winner} AS w, 0 AS rel, event_id FROM t"


_WON = "CAST(1 + event_id % 2 AS INT)"
_MOVED = f"CASE WHEN event_id % 50 = 0 THEN 3 - {_WON} ELSE {_WON} END"


def matches(spark, sf):
    t = track(spark, sf)
    return t.select("entity_id", F.lit(0).cast("long").alias("match"), "seq", "event_id", (1 + F.col("event_id") % 2).cast("int").alias("winner"))


def replay(df, machine=Replay()):
    return fold(df, ["entity_id", "match"], ["seq", "event_id"], machine.new, machine.step, machine.schema)


@query("score_replay", f"""WITH RECURSIVE {TRACK_SQL}, {replay_sql('m', _points_sql(_WON))}
  SELECT k AS entity_id, 0::BIGINT AS match, event_id, s1 AS set1, s2 AS set2, g1 AS gm1, g2 AS gm2, pts, game_no, true AS tb_set, svr FROM m""")
def score_replay(spark, sf):
    """Score context before every point of every match."""
    return replay(matches(spark, sf))


@query("replay_after_edit", f"""WITH RECURSIVE {TRACK_SQL}, {replay_sql('m', _points_sql(_WON))}, {replay_sql('n', _points_sql(_MOVED))}
  SELECT n.k AS entity_id, 0::BIGINT AS match, event_id, m.pts AS old_pts, n.pts AS new_pts, n.s1 AS set1, n.s2 AS set2, n.g1 AS gm1, n.g2 AS gm2, n.svr FROM n JOIN m USING (event_id)
  WHERE (n.s1, n.s2, n.g1, n.g2, n.pts, n.svr) <> (m.s1, m.s2, m.g1, m.g2, m.pts, m.svr)""")
def replay_after_edit(spark, sf):
    """Flips the winner of some points and rescores only the matches they belong to;
    every later point whose context moved is reported."""
    m = matches(spark, sf)
    edited = (F.col("event_id") % 50 == 0)
    touched = m.filter(edited).select("entity_id", "match").distinct()
    affected = cut_lineage(m.join(touched, ["entity_id", "match"], "left_semi"))
    old = replay(affected).select("event_id", F.struct("set1", "set2", "gm1", "gm2", "pts", "svr").alias("o"))
    new = replay(affected.withColumn("winner", F.when(edited, 3 - F.col("winner")).otherwise(F.col("winner"))))
    j = new.join(old, "event_id").filter(F.struct("set1", "set2", "gm1", "gm2", "pts", "svr") != F.col("o"))
    return j.select("entity_id", "match", "event_id", F.col("o.pts").alias("old_pts"), F.col("pts").alias("new_pts"), "set1", "set2", "gm1", "gm2", "svr")


@query("winner_conflicts", f"""WITH RECURSIVE {POINTS_SQL}, {replay_sql('m', f"SELECT match_id AS k, row_number() OVER (PARTITION BY match_id ORDER BY pt, part, supp, attested, flags, rel) AS i, attested AS w, rel, flags FROM (SELECT *, coalesce({winner_sql('first_', 'second_')}, 0) AS rel FROM pts)")}
  SELECT k AS match_id, count(*) AS points, count(*) FILTER (WHERE c) AS conflicts, count(*) FILTER (WHERE u) AS underivable, count(*) FILTER (WHERE c OR u) = 0 AS exportable
  FROM (SELECT k, w = 0 AND derived = 0 AS u, w > 0 AND derived > 0 AND flags <> 'unseen' AND derived <> w AS c FROM m) GROUP BY 1""")
def winner_conflicts(spark, sf):
    """Points whose string contradicts the attested winner under the replayed server;
    a match with one may not be exported."""
    df = points(spark, sf).select("match_id", "pt", "part", "supp", "attested", "flags", "first_", "second_")
    df = once(df, f=F.trim("first_"), s=F.trim("second_")).drop("first_", "second_")
    df = once(df, p=F.when(F.col("s") != "", F.col("s")).otherwise(F.col("f"))).drop("f")
    df = once(df, rel=F.coalesce(N.winner_of(F.col("s"), F.col("p")), F.lit(0))).drop("s", "p")

    df = df.repartition("match_id").sortWithinPartitions("match_id", "pt", "part", "supp", "attested", "flags", "rel")
    g = df.select("match_id", "attested", (F.col("flags") == "unseen").alias("unseen"), "rel").mapInArrow(count_conflicts, "match_id long, points long, conflicts long, underivable long")
    return g.withColumn("exportable", (F.col("conflicts") == 0) & (F.col("underivable") == 0))


STATES = 1 << 16


def count_conflicts(batches):
    """One row a match from its ordered points. The counters are numbered as they come up; what follows from them is looked up."""
    rules = Rules()
    known, counts, server, after = {}, [], [], ([], [], [])

    def number(c):
        c = c._replace(game_no=1)               # nothing depends on it
        if c not in known:
            known[c] = len(counts)
            counts.append(c)
            server.append(rules.server(c))
            for to in after:
                to.append(-1)
        return known[c]

    key, told = None, [0, 0, 0]
    for batch in batches:
        out = []
        for match, attested, unseen, rel in zip(*(batch.column(c).to_pylist() for c in ("match_id", "attested", "unseen", "rel"))):
            if match != key or not counts:
                if told[0]:
                    out.append((key, *told))
                if len(counts) > STATES:
                    known.clear()
                    for held in (counts, server, *after):
                        held.clear()
                key, told, at = match, [0, 0, 0], number(Count())
            told[0] += 1
            svr = server[at]
            derived = 0 if rel == 0 else svr if rel == 1 else 3 - svr
            w = attested or derived
            if not w:
                told[2] += 1
                continue
            if derived and derived != w and not unseen:
                told[1] += 1
            to = after[w][at]
            if to < 0:
                to = after[w][at] = number(rules.after(counts[at], w))
            at = to
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], POINTS)
    if told[0]:
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()) for c in (key, *told)], POINTS)


POINTS = ["match_id", "points", "conflicts", "underivable"]


# ---- plateaus ----
def plateaus(spark, sf, rows=None, name="event_id", call=None):
    """Plateau of every row, called by its column `name`, or by the whole number `call`, then named so. An entity of more than `rows` rows is
    many tasks, whether or not it ever pauses."""
    level = (F.floor(F.col("x") / 25) * 25).cast("double")
    df = sliced_track(spark, sf, rows).select("entity_id", "slice", F.lit(0).cast("long").alias("part"), "seq", F.col("event_id").alias("tie"),
                                               (F.col(name) if call is None else call).alias("event_id"), level.alias("level"), (F.col("kind") != "error").alias("present"))
    return composed_fold(df, ["entity_id"], ["seq", "tie"], LEVELS).select("entity_id", F.col("event_id").alias(name), F.col("plateau").cast("long").alias("plateau"))


# The machine as a recursion: the state before row i of an entity, then what the row and rows waiting before it get.
PLATEAU_SQL = f"""pl_in AS MATERIALIZED (SELECT entity_id, event_id, seq, kind <> 'error' AS present, floor(x / 25) * 25 AS lv, row_number() OVER (PARTITION BY entity_id ORDER BY seq, event_id) AS i FROM t),
  pl AS (
    SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, 'closed' AS phase, CAST(-1 AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS level,
           CAST([] AS DOUBLE[]) AS settling, CAST(0 AS BIGINT) AS waiting, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS own, CAST(NULL AS BIGINT) AS theirs FROM pl_in
    UNION ALL
    SELECT entity_id, i, event_id, CASE WHEN full_ THEN 'held' ELSE phase END, id, CASE WHEN full_ THEN list_aggregate(list_slice(settling, -5, -1), 'median') ELSE level END,
           settling, waiting, seen, own, theirs FROM (
      SELECT entity_id, i, event_id, phase, id, level, settling, phase = 'settling' AND present AND len(settling) >= {LEVELS.settle} AS full_, waiting, seen, own, theirs FROM (
        SELECT entity_id, i, event_id, present, phase, id, level, waiting, seen, own, theirs,
               CASE WHEN phase = 'settling' AND present THEN list_append(CASE WHEN starts THEN CAST([] AS DOUBLE[]) ELSE settling END, lv) ELSE settling END AS settling FROM (
          SELECT entity_id, i, event_id, present, lv, settling, level, seen, event = 'sure' OR (event = 'seen' AND phase = 'closed') AS starts,
                 id + CAST(event = 'sure' OR (event = 'seen' AND phase = 'closed') AS BIGINT) AS id,
                 CASE event WHEN 'far' THEN waiting + 1 ELSE 0 END AS waiting,
                 CASE event WHEN 'seen' THEN 'settling' WHEN 'sure' THEN 'settling' WHEN 'near' THEN 'held' WHEN 'far' THEN 'doubt' ELSE CASE phase WHEN 'doubt' THEN 'held' ELSE phase END END AS phase,
                 CASE WHEN event = 'far' THEN NULL WHEN event = 'absent' THEN -1 WHEN event = 'near' OR (event = 'seen' AND phase = 'settling') THEN id ELSE id + 1 END AS own,
                 CASE event WHEN 'far' THEN NULL WHEN 'near' THEN id WHEN 'sure' THEN id + 1 ELSE -1 END AS theirs FROM (
            SELECT *, CASE WHEN NOT present THEN 'absent' WHEN phase IN ('closed', 'settling') THEN 'seen' WHEN abs(lv - level) <= {LEVELS.change} THEN 'near'
                           WHEN waiting + 1 >= {LEVELS.confirm} THEN 'sure' ELSE 'far' END AS event FROM (
              SELECT e.entity_id, e.i, e.event_id, e.present, e.lv, r.id, r.level, r.settling, r.waiting, CASE WHEN e.present THEN e.seq ELSE r.seen END AS seen,
                     CASE WHEN e.present AND e.seq - r.seen > {LEVELS.close} THEN 'closed' ELSE r.phase END AS phase
              FROM pl r JOIN pl_in e ON e.entity_id = r.entity_id AND e.i = r.i + 1)))))),
  pl_out AS (SELECT entity_id, event_id, CASE WHEN own IS NOT NULL THEN own ELSE coalesce(first_value(theirs IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) END AS plateau
    FROM pl WHERE i > 0)"""


@query("plateau_label", f"WITH RECURSIVE {TRACK_SQL}, {PLATEAU_SQL} SELECT entity_id, event_id, plateau FROM pl_out")
def plateau_label(spark, sf):
    return plateaus(spark, sf)


@query("plateau_online", f"WITH RECURSIVE {TRACK_SQL}, {PLATEAU_SQL} SELECT entity_id, event_id, plateau FROM pl_out")
def plateau_online(spark, sf):
    """The same machine fed by a file stream in event time: every row of plateau_label, with its label. A long silence closes an entity by its timer."""
    ev = events_stream(spark, sf, "events*.parquet")
    k = F.floor(F.regexp_extract("props", r'"k": *(\d+)', 1).cast("double") / 25) * 25
    df = ev.select(F.col("user_id").alias("entity_id"), F.lit(0).cast("long").alias("part"), millis("ts").alias("seq"), "event_id", k.alias("level"), (F.col("event_type") != "error").alias("present"))
    df, end = ending(spark, df, ["entity_id", "part"], "seq")
    return drain(timed_fold(df, ["entity_id", "part"], ["seq", "event_id"], LEVELS, "seq", "1 day", P.absent_close), "plateau", end).drop("part")


BY_RUN = dict(order=("start_seq", "plateau"))      # plateaus are numbered in the order of rows, so runs that start at one time stay in order too
LAST_LETTER = 0xD7FF                               # of the code points from 'a' on that stand in one stretch


def piece_name(i):
    """The letter of a segment's run i (from 0): a, b, ... and on by code points; where those end, its number."""
    letter = F.decode(F.unhex(F.lpad(F.hex(i + ord("a")), 4, "0")), "UTF-16BE")
    return F.when(i <= LAST_LETTER - ord("a"), letter).otherwise(F.concat(F.lit("."), i.cast("string")))


@query("segment_split_merge")
def segment_split_merge(spark, sf):
    """Segments cut at plateau handovers; those mostly absent and slivers dropped, neighbours of one plateau merged.

    src tells what a row is made of: segments as `bool_smooth_runs` numbers them, each with the letter of its piece if it was cut, such as 4b+7."""
    segs = cut_lineage(flag_segments(spark, sf).select("entity_id", "seg", "start_seq", "end_seq"))
    present = F.coalesce(F.col("kind") != "error", F.lit(False)).cast("long")
    lab = plateaus(spark, sf, name="call", call=F.col("seq") * 2 + present)          # of a time, it does not matter which row is first
    lab = lab.select("entity_id", F.shiftright("call", 1).alias("seq"), F.col("call").bitwiseAND(1).alias("present"), "plateau", F.lit(0).cast("long").alias("event_id"))
    from .signals import in_segments
    inside = in_segments(lab.withColumn("slice", F.lit(0)), segs).select("entity_id", "segm.seg", F.col("segm.start_seq").alias("a"), F.col("segm.end_seq").alias("b"), "plateau", "seq", "present")
    # runs of one plateau inside a segment; its rows without one (-1) count for the share that is present
    runs = inside.groupBy("entity_id", "seg", "a", "b", "plateau").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n"), F.sum("present").alias("present"))
    runs = cut_lineage(runs)
    there = runs.groupBy("entity_id", "a").agg((F.sum("present") / F.sum("n")).alias("share")).filter(F.col("share") >= P.present_share)
    # from its first to its last row a run has `confirm` (2) rows if and only if it has two of its own
    runs = runs.filter((F.col("plateau") >= 0) & (F.col("n") >= LEVELS.confirm)).join(there, ["entity_id", "a"], "left_semi")
    r = S.adjacent(S.derived_slice(cut_lineage(runs), P.slice_ms, "start_seq"), ["start_seq", "end_seq", "a"], **BY_RUN)
    same = lambda side: F.coalesce(F.col(f"{side}.a") == F.col("a"), F.lit(False))
    mid = lambda x, y: F.floor((x + y) / 2)
    r = S.running_sum(r, {"i": F.lit(1)}, **BY_RUN)
    r = S.carry(r, {"first": F.when(~same("prev"), F.col("i"))}, **BY_RUN)
    p0 = F.when(same("prev"), mid(F.col("prev.end_seq"), F.col("start_seq")) + 1).otherwise(F.col("a"))
    p1 = F.when(same("next"), mid(F.col("end_seq"), F.col("next.start_seq"))).otherwise(F.col("b"))
    tick = F.when(same("next"), 1).otherwise(P.frame)           # to where the next piece starts, or the segment's last frame ends
    pieces = r.withColumns({"p0": p0, "p1": p1, "tick": tick, "split": same("prev") | same("next")}).filter(F.col("p1") + F.col("tick") - F.col("p0") >= P.min_run)
    src = F.concat(F.col("seg").cast("string"), F.when(F.col("split"), piece_name(F.col("i") - F.col("first"))).otherwise(""))
    pieces = pieces.select("entity_id", "plateau", F.col("p0").alias("start_seq"), F.col("p1").alias("end_seq"), "split", src.alias("src"))
    m = S.adjacent(S.derived_slice(pieces, P.slice_ms, "start_seq"), ["plateau", "end_seq"], **BY_START)
    new = F.col("prev").isNull() | (F.col("prev.plateau") != F.col("plateau")) | (F.col("start_seq") - F.col("prev.end_seq") > 12 * P.second)
    m = S.islands(m, new, "piece", **BY_START)
    lineage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_seq", "src"))), lambda p: p["src"]), "+")
    g = m.groupBy("entity_id", "piece").agg(F.max("plateau").alias("plateau"), F.min("start_seq").alias("start_seq"), F.max("end_seq").alias("end_seq"), F.count("*").alias("parts"),
                                            F.max("split").alias("split"), lineage.alias("src"))
    return g.withColumn("action", F.when(F.col("parts") > 1, "merged").when(F.col("split"), "split").otherwise("keep")).drop("split")


# ---- gated tracking ----
# The gate as a recursion: (x, y) is the last kept place, b the best row of the frame; a row of another frame gives out what was best before it.
GATE_SQL = f"""ga_in AS MATERIALIZED (SELECT entity_id, event_id, CAST(floor(seq / {4 * HOUR}) AS BIGINT) AS frame, cx, cy, y AS score, row_number() OVER (PARTITION BY entity_id ORDER BY seq, event_id) AS i FROM t),
  ga AS (
    SELECT DISTINCT entity_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y,
           CAST(NULL AS STRUCT(event_id BIGINT, frame BIGINT, cx DOUBLE, cy DOUBLE, score DOUBLE)) AS b, CAST(NULL AS STRUCT(event_id BIGINT, frame BIGINT, cx DOUBLE, cy DOUBLE, score DOUBLE)) AS given FROM ga_in
    UNION ALL
    SELECT entity_id, i, frame, x, y, CASE WHEN (x IS NULL OR sqrt((row_.cx - x) ** 2 + (row_.cy - y) ** 2) < 6.0) AND (b IS NULL OR row_.score > b.score) THEN row_ ELSE b END, given FROM (
      SELECT e.entity_id, e.i, e.frame, {{'event_id': e.event_id, 'frame': e.frame, 'cx': e.cx, 'cy': e.cy, 'score': e.score}} AS row_,
             CASE WHEN e.frame = r.frame THEN r.x WHEN e.frame - r.frame > 1 THEN NULL ELSE r.b.cx END AS x,
             CASE WHEN e.frame = r.frame THEN r.y WHEN e.frame - r.frame > 1 THEN NULL ELSE r.b.cy END AS y,
             CASE WHEN e.frame = r.frame THEN r.b END AS b, CASE WHEN e.frame <> r.frame THEN r.b END AS given
      FROM ga r JOIN ga_in e ON e.entity_id = r.entity_id AND e.i = r.i + 1)),
  ga_out AS (SELECT entity_id, given AS g FROM ga WHERE given IS NOT NULL
    UNION ALL SELECT entity_id, arg_max(b, i) FROM ga GROUP BY entity_id HAVING arg_max(CAST(b IS NOT NULL AS INT), i) = 1)"""


@query("gap_tracker", f"WITH RECURSIVE {TRACK_SQL}, {GATE_SQL} SELECT entity_id, g.event_id, g.frame, {q6('g.cx')} AS x, {q6('g.cy')} AS y FROM ga_out")
def gap_tracker(spark, sf):
    """Best detection per frame near the last one; a frame without one resets the gate."""
    df = sliced_track(spark, sf).select("entity_id", "slice", "seq", "event_id", F.floor(F.col("seq") / (4 * HOUR)).alias("frame"), "cx", "cy", F.col("y").alias("score"))
    out = composed_fold(df, ["entity_id"], ["seq", "event_id"], Gate(6.0))
    return out.select("entity_id", "event_id", "frame", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))
