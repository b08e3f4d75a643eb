"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from porescreen.plans import load_queries

HEADLINE = (
    "path_descriptors", "path_jump_repair", "path_extremes", "external_lookup", "predictions", "shapley_rows",
    "pair_energy_grid", "free_radius_field", "pore_components", "limiting_diameter", "axis_traversal",
    "crossing_barrier", "crossing_path", "displacement_by_lag", "message_tables", "reassembled_turns",
    "missing_value_audit", "descriptor_display",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    known = load_queries()
    # Start the JVM compiler and the Python workers once, outside the timings.
    known["contributions_by_magnitude"].build(spark, folder).write.format("noop").mode("overwrite").save()
    known["predictions"].build(spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
