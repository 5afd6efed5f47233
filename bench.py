"""Benchmark: batch scoring job + serving queries over its snapshot.

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fairband.operators import analytics as A  # noqa: E402
from fairband.operators import filters as FL  # noqa: E402
from fairband.operators.ranking import paginate, top_overpaid  # noqa: E402
from fairband.plans.context import Ctx  # noqa: E402
from fairband.session import build_session  # noqa: E402
from fairband.sources.io import load_snapshot, save_snapshot  # noqa: E402


def timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return out, time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    ctx = Ctx(spark, sf_dir, persist_panel=True)
    spec = ctx.spec
    q = {}

    # warm-up: JVM, codegen caches (not timed)
    ctx.table("part").limit(1).collect()

    # 1. batch job: panel -> eligibility -> peer ranges -> status, trained ∪ untrained -> snapshot
    tag = "bench_" + sf_dir.strip("/").replace("/", "_")
    path, q["score_batch"] = timed(lambda: save_snapshot(ctx.combined_status, tag))
    snap = load_snapshot(spark, path).cache()
    snap.count()

    # 2. serving queries over the snapshot (each collected)
    def run(name, df_fn):
        _, q[name] = timed(lambda: df_fn().collect())

    run("filter_league", lambda: paginate(FL.filter_league(snap, "eco", spec), spec, per_page=50))
    run("filter_position", lambda: paginate(FL.filter_position(snap, "defend", spec), spec, per_page=50))
    run("filter_league_position", lambda: paginate(
        FL.filter_position(FL.filter_league(snap, "promo", spec), "attack", spec), spec, per_page=50))
    run("name_search", lambda: FL.search_name(snap, "blue gear", spec))
    for p in (1, 2, 3):
        run(f"page_{p}_of_200", lambda p=p: paginate(snap, spec, "actual_salary", "desc", p, 200))
    run("top_overpaid", lambda: top_overpaid(snap, spec, 20))
    run("league_stats", lambda: A.league_stats(snap, spec))
    run("position_stats", lambda: A.position_stats(snap, spec))
    run("percentile_rank", lambda: A.percentile_rank(snap, "gross_annual_eur").agg(F.max("percentile_rank")))

    # 3. model path: forest fit + native per-tree P25/P75 ranges for every trained row
    def forest():
        from fairband.plans.q_models import q_predict_range
        return q_predict_range(spark, sf_dir).agg(F.count(F.lit(1)), F.avg("predicted_center_eur")).collect()
    _, q["forest_range"] = timed(forest)

    total = sum(q.values())
    print(json.dumps({"metric": "total_query_seconds", "value": round(total, 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in q.items()}, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
