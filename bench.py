"""Time headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from larkfield.plans import load_all  # noqa: E402
from larkfield.plans.registry import PLANS, Tables  # noqa: E402
from larkfield.session import local_session  # noqa: E402

HEADLINE = [
    "d1_monthly_revenue", "c4_fact_reference_grain", "c5_denormalised_star", "d2_revenue_by_category", "d6_rfm",
    "d13_percentile_fences", "g1_interaction_union", "d4_completion_funnel", "e5_history_split", "a6_keyed_upsert",
    "c16_feed_posts", "h2_2_ngram_counts", "i2_multi_field_cosine", "i3_bm25_top10", "i4_char_channel",
    "i7_nearest_neighbours", "i14_mmr", "j1_item_similarity", "j2_recommend_for_user", "k4_mean_metrics",
    "k6_temporal_split", "k16_roc_auc", "n5_current_state",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=2 * int(cpus) if cpus.isdigit() else 16)
    load_all()
    tables = Tables(spark, folder)
    # One small job first, so that session start is not charged to a query.
    tables.orders.write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        PLANS[name](tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": pathlib.Path(folder).name}))


if __name__ == "__main__":
    main()
