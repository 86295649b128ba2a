"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion (every row and column computed, nothing collected).
``queries`` holds the best of two warm runs, ``first`` the first run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mediasignals import catalog  # noqa: E402
from mediasignals.session import build_session  # noqa: E402

HEADLINE = [
    "d3_daily_global_news", "i1_topic_classification", "i3_signals", "c7_first_url_wins",
    "h4_strip_html", "i4_gazetteer", "i5_entity_resolution", "i6_geo_level",
    "d3_daily_global", "d4_daily_topic", "d5_daily_region", "d6_daily_entity", "d7_daily_source",
    "d8_rollup_all", "d9_count_by_topic", "d10_top_entities", "d14_topic_region",
    "d20_top_entities_of_period", "d25_weekly_totals_all", "d28_compare_periods",
    "d37_municipality_counts", "d41_topic_day_pivot", "d43_name_counts", "d49_anomalies",
    "d50_feed_profile", "c6_top_entity_series", "c10_region_lookup", "c14_subregion",
    "e3_headlines_per_topic", "m1_daily_payload", "k3_touched_days",
    "b9_stored_metrics", "b16_stored_source_series", "d29_stored_compare", "d30_stored_day_over_day",
    "d31_stored_kpis", "d49_stored_anomalies",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    best: dict[str, float] = {}
    first: dict[str, float] = {}
    for name in HEADLINE:
        run = catalog.runnable(name)
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        first[name], best[name] = round(times[0], 3), round(min(times[1:]), 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "first": first,
                "articles_per_sec": round(documents / best["d3_daily_global_news"], 1),
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
