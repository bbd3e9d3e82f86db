"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pricepanel.registry.queries import QUERIES
from pricepanel.session import build_session

HEADLINE = [
    "clean_quotes", "dedup_seller_day", "outlier_median", "outlier_list_price", "snapshot_rank", "panel_clean",
    "panel_lags", "quote_distances", "price_changes", "pair_change_counts", "pair_profile", "pair_features",
    "seller_profile", "price_variability", "displacement", "fluctuation", "seasonal_index", "quantile_thresholds",
    "shrunken_effects", "text_clean", "ngram_counts", "phrase_usage", "text_repeat", "page_listing_explode",
    "insert_ignore_listings", "stream_price_changes", "kmeans_pairs", "ols_change_gap", "probit_change",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
        spark.sparkContext.setLogLevel("ERROR")
        QUERIES["clean_quotes"](spark, sf_dir).limit(1).collect()
        seconds = {}
        for name in names:
            start = time.perf_counter()
            # noop runs the whole plan and moves no result to the driver
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
