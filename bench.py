"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from larkspur.plans import catalog
from larkspur.session import session

HEADLINE = ["filter_expr", "project_with_column", "agg_pricing_summary", "agg_kinds", "agg_filtered", "agg_mode", "agg_pivot", "join_inner", "join_star", "over_partition", "shift_and_diff", "rolling_rows", "rolling_time", "resample_every", "unique_first", "explode_list", "list_functions", "set_intersect", "haversine_distance", "geo_points", "geo_measures", "geo_spatial_join", "geo_reproject"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("OFF")
    found = {}
    for name in HEADLINE:
        run = lambda: catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()  # compiles, and warms the file cache
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        found[name] = round(sorted(times)[1], 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 4), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
