"""Time the headline jobs; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). The source files have one row group
each, so they are first landed as many-file text and typed tables, the form a warehouse keeps them in;
that landing is timed too. Every job runs twice and the second (warm) run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from checks.common import STAMP, STAR_SCHEMA, silver, star  # noqa: E402
from starloom.operators import access, calendar, profile, quality, relate, typed  # noqa: E402
from starloom.plans.star import recommend_star, wide_table  # noqa: E402
from starloom.session import local_session, scratch_path  # noqa: E402
from starloom.sources.ingest import land  # noqa: E402


def drain(df: DataFrame) -> None:
    """Run the whole plan without keeping its rows."""
    df.write.mode("overwrite").format("noop").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(str(cpus), shuffle_partitions=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    bronze_dir, typed_dir = scratch_path(spark, "bronze"), scratch_path(spark, "typed")

    sources = star(spark, sf_dir)
    sources["lineitem"] = sources["lineitem"].withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    sources["orders"] = sources["orders"].withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))

    def land_all() -> None:
        for name, df in sources.items():
            files = cpus if name in ("lineitem", "orders") else 1
            land(df.repartition(files), STAMP).write.mode("overwrite").parquet(f"{bronze_dir}/{name}")

    def spread_typed() -> None:
        for name, df in silver(spark, sf_dir).items():
            files = cpus if name in ("lineitem", "orders") else 1
            df.repartition(files).write.mode("overwrite").parquet(f"{typed_dir}/{name}")

    def stored(folder: str) -> dict[str, DataFrame]:
        return {n: spark.read.parquet(f"{folder}/{n}") for n in STAR_SCHEMA}

    def wide() -> DataFrame:
        return wide_table(t["lineitem"], {
            "part": (t["part"], "part_key", "part_key"), "supplier": (t["supplier"], "supplier_key", "supplier_key"),
            "orders": (t["orders"], "order_key", "order_key"),
        })

    timings: dict[str, float] = {}

    def timed(name: str, job: Callable[[], object]) -> None:
        for _ in range(2):
            began = time.perf_counter()
            job()
            timings[name] = round(time.perf_counter() - began, 3)

    timed("land_bronze", land_all)
    spread_typed()
    b, t = stored(bronze_dir), stored(typed_dir)
    timed("profile_statistics", lambda: profile.column_statistics(t).collect())
    timed("discover_types", lambda: profile.discover(b).collect())
    specs = typed.column_specs(profile.discover({"lineitem": b["lineitem"]}), "lineitem")
    timed("stage1_lineitem", lambda: typed.build_stage1(b["lineitem"], specs).write.mode("overwrite").parquet(
        f"{typed_dir}/stage1"))
    timed("overlap_relationships", lambda: relate.join_candidates_by_overlap(t).collect())

    timed("recommend_star", lambda: recommend_star(t).collect())
    timed("quality_report", lambda: quality.catalog_quality(profile.catalog_profile(t)).collect())
    timed("k_table", lambda: drain(wide()))
    wide().write.mode("overwrite").parquet(f"{typed_dir}/lineitem_k")
    spark.read.parquet(f"{typed_dir}/lineitem_k").createOrReplaceTempView("lineitem_k")
    report = "SELECT part_part_brand, sum(sales_amount) AS sales FROM lineitem_k GROUP BY part_part_brand"
    timed("gold_query", lambda: access.gold_query(spark, report, {"lineitem_k"}).collect())
    timed("calendar_2014_2030", lambda: calendar.calendar_range(spark, "2014-01-01", "2030-12-31").collect())
    timed("reconcile_counts", lambda: typed.reconcile_counts({n: (t[n], b[n]) for n in STAR_SCHEMA}).collect())

    print(json.dumps({"metric": "headline_jobs_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
