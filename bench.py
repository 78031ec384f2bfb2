"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from lanewise.session import local_session

HEADLINE = """edit_effort_curve scorecard tokenize_points explode_shots notation_violations derive_winner counterfactual_headroom
moving_average_edge gradient_nonuniform gap_holes cusp_candidates net_crossings chain_split bool_smooth_runs identity_continuity gap_interpolate
asof_nearest grid_search_offset score_key_join truth_join wildcard_prior_join dedupe_first latest_wins sliding_rollup session_gap
score_model tier_table coverage_curve score_replay plateau_label active_time alternation_map prior_rerank""".split()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    from lanewise.plans import QUERIES
    QUERIES["gap_holes"](spark, sf_dir).count()         # warm up the JVM and the Python workers
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
