"""Headline queries, timed. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import time

from paceshift.driver.queries import QUERIES
from paceshift.session import local_session

HEADLINE = """
q_season_runners q_season_first_pitch q_team_change q_pitcher_change q_leader_mean_fast q_leader_median_slow
q_leader_change_max q_cohort_both_seasons q_pitch_codes q_pitch_leaderboards q_season_by_type q_season_delta_velo
q_ols_velo q_fit_line q_histogram_unit q_density_not_first q_density_facet_first q_density_flag q_park_tempo
q_flag_summary q_fe_flag q_fe_flag_all_rows q_fe_altitude q_running_counts q_tempo q_enriched q_topk_ties
q_histogram q_density q_missing_profile q_manifest_ingest q_park_dim q_altitude_rank
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    # One small job, so that the first query is not charged with starting the executors.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
