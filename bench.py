"""Wall-clock of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

from redebit.plans import catalog
from redebit.session import local_session

HEADLINE = [
    "recovery_by_rail", "project_cycles", "mandate_state", "dedupe_events", "parse_envelope", "segment_priors",
    "presence_curve", "survival_curve", "customer_history", "payday_posterior", "lifecycle_steps", "revocation_hazard",
    "rolling_issuer_health", "issuer_cusum", "cause_observations", "legality_mask", "plan_notice", "best_retry_slot",
    "rank_candidates", "policy_sweep", "run_arms", "retry_plan", "evaluate_rules", "shadow_audit", "append_decisions",
    "verify_chain", "arm_summary", "matched_pair", "kaplan_meier", "log_rank", "batch_report", "psi", "hazard_rows",
    "presence_rows", "redact_documents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="redebit-bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
