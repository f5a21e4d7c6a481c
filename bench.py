"""Times the headline queries; prints one JSON line.

All queries run once, which is thrown away, and then in BENCH_REPS rounds (default 3), so the runs of a symbolic query lie
next to those of its plain partner; the median counts. ``ratios`` divides the times of a pair in each round and takes the
median, ``spread`` is the largest over the smallest of these: only ratios are comparable across machines and
data sizes. ``consumed`` times selection and product alone: their rows with all witness columns, no text.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from provframe import tune  # noqa: E402
from provframe.plans.catalogue import QUERIES  # noqa: E402
from provframe.plans.registry import tables  # noqa: E402
from provframe.plans.workloads import cross_dense, selection_control  # noqa: E402

HEADLINE = [
    *[f"b{i}_{s}" for i in range(1, 6) for s in ("nat", "bx")],
    *[f"q3_{s}" for s in ("bool", "nat", "bx", "nx")],
    *[f"{q}_{s}" for q in ("q5", "q7", "q10", "q11", "q16", "q18", "q19") for s in ("bool", "bx")],
    *[f"{q}_bx_exists" for q in ("q3", "q5", "q7", "q10", "q11", "q16", "q18", "q19")],
    *[f"{q}_{s}" for q in ("cross", "b6", "b9") for s in ("nat", "bx")],
    "b5_nx",
    "b11_nat",
    "b11_bx",
    "sel_nested",
    "proj_collapse_nat",
    "proj_collapse_bx",
    "absorb_mixed_hot",
    "selfjoin_nation_bx",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("provframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    tables_of = lambda semiring: tables(spark, path, semiring)
    alone = {
        f"{name}_{tag}": (lambda plan=plan, semiring=semiring: plan(tables_of(semiring)).df)
        for name, plan in (("select", selection_control), ("product", cross_dense))
        for tag, semiring in (("nat", "N"), ("bx", "B[X]"))
    }
    jobs = {name: (lambda name=name: QUERIES[name](spark, path)) for name in HEADLINE} | alone
    runs: dict[str, list[float]] = {name: [] for name in jobs}
    for _ in range(reps + 1):
        for name, job in jobs.items():
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - start)
    runs = {name: own[1:] for name, own in runs.items()}
    median = {name: round(statistics.median(own), 3) for name, own in runs.items()}
    times = {name: median[name] for name in HEADLINE}
    scaling = {}
    for folder in sorted(Path(path).parent.glob("sf*"), key=lambda f: float(f.name[2:])):
        for name in ("q3_bool", "q3_bx"):
            start = time.perf_counter()
            QUERIES[name](spark, str(folder)).write.format("noop").mode("overwrite").save()
            scaling[f"{name}@{folder.name}"] = round(time.perf_counter() - start, 3)
    spark.stop()
    ratios, spread = {}, {}
    for name, plain in (
        [(f"b{i}", "nat") for i in range(1, 6)]
        + [(q, "bool") for q in ("q3", "q5", "q7", "q10", "q11", "q16", "q18", "q19")]
        + [(q, "nat") for q in ("b11", "cross", "b6", "b9", "select", "product")]
    ):
        for symbolic in ("bx", "bx_exists"):
            if f"{name}_{symbolic}" in runs:
                each = [a / b for a, b in zip(runs[f"{name}_{symbolic}"], runs[f"{name}_{plain}"])]
                ratios[f"{name}_{symbolic}/{plain}"] = round(statistics.median(each), 2)
                spread[f"{name}_{symbolic}/{plain}"] = round(max(each) / min(each), 2)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "ratios": ratios,
                "spread": spread,
                "consumed": {name: median[name] for name in alone},
                "scaling": scaling,
                "sf": Path(path).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
