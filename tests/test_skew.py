"""The oracles again on tables where one key holds a third of all rows."""

from collections import Counter

import duckdb
import pytest

from check import TABLES, compare, connect
from lanewise.operators.slices import row_slices
from lanewise.presets import HOUR
from lanewise.sources import tables
from lanewise.sources.tables import track

HOT = {
    "events": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id",
    "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey",
    "lineitem": "CASE WHEN (l_partkey + l_suppkey + l_linenumber) % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey",
    "documents": "CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE source END AS source",
}
NAMES = """net_crossings chain_split bool_smooth_runs cusp_candidates toss_peak crossing_extrapolate active_time session_gap gated_fill asof_nearest
edit_effort_curve label_from_evidence tokenize_chart_rows sink_partitioned score_key_join monotonic_check dedupe_first winner_conflicts prev_next_features prior_rerank score_replay tier_table standardize latest_wins""".split()


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory, sf):
    out = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for t in TABLES:
        swap = f"* REPLACE ({HOT[t]})" if t in HOT else "*"
        con.sql(f"COPY (SELECT {swap} FROM '{sf}/{t}.parquet') TO '{out}/{t}.parquet'")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(spark, hot_dir, name):
    message, _, ok = compare(spark, connect(hot_dir), name, hot_dir)
    assert ok, message


def test_hot_entity_is_spread_by_rows(spark, hot_dir):
    """An entity with a third of all rows is many slices of about equal size, in order of time."""
    df = row_slices(track(spark, hot_dir), 20, HOUR).filter("entity_id = 1")
    rows = sorted((r.seq, r.slice) for r in df.select("seq", "slice").collect())
    sizes = Counter(s for _, s in rows)
    assert [s for _, s in rows] == sorted(s for _, s in rows)
    assert len(sizes) >= 16 and max(sizes.values()) <= 2 * len(rows) / len(sizes)


@pytest.mark.parametrize("name", ["net_crossings", "chain_split", "gated_fill", "active_time"])
def test_many_slices_give_the_same(spark, hot_dir, name, monkeypatch):
    monkeypatch.setattr(tables, "SLICE_ROWS", 9)
    message, _, ok = compare(spark, connect(hot_dir), name, hot_dir)
    assert ok, message
