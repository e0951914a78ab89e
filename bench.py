"""Time the headline queries on one data folder and print one JSON line.

Every query runs from the raw driver tables unless it reads a layer table; building the layers is
timed on its own. Results go to a sink that reads every row and column.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from outletry.catalog import QUERIES  # noqa: E402
from outletry.session import build_session  # noqa: E402
from outletry.workload.lake import lake  # noqa: E402

LAYERS = (
    "outlets", "coordinates", "seasonality", "holiday_dates", "holiday_months", "labelled", "density",
    "multipliers", "context", "monthly_gold", "features", "outlet_gold",
)
HEADLINE = (
    "clean_text", "dedupe_exact", "price_bounds", "monthly_sales", "primary_key_mode", "outlet_features",
    "calendar_collapse", "context_score", "radius_sum", "spatial_nearest", "nearest_lookup",
    "hierarchical_fill", "percentile_bands", "cluster_benchmarks", "potential",
    # Models, with the published number of trees, folds and restarts.
    "impute_category", "cv_metrics", "k_selection",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        # Small splits, so that the one file per table of the bench data feeds every core.
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
            "spark.sql.files.maxPartitionBytes": "2m", "spark.sql.files.openCostInBytes": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    tables = lake(spark, folder)
    for name in LAYERS:
        start = time.time()
        getattr(tables, name)
        times[f"layer_{name}"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "layers and headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
