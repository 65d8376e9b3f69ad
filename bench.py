"""Time the headline work; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8).

``ingest`` reads a CSV export (the order lines as raw text, written before the clock starts) and stores,
verifies, validates and records it.  The other work reads the canonical table of all datasets, as a
user of the library would; every query runs to the end through the ``noop`` sink.
``ingest_1000`` and ``decision_run_1000`` do the same for an export of 1,000 rows, the size
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from costlens import session, sources
from costlens.operators import anomaly, forecast, opportunity, panel, quality, spend
from costlens.plans import decision_run, ingest
from verification.inputs import raw_focus, table
from verification.source_queries import everything


def finish(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def whole_run(billing) -> None:
    with decision_run(billing) as run:
        finish(run.decisions)


def opportunities(billing) -> None:
    finish(opportunity.ranked(opportunity.find(billing, anomaly.run_detection(billing))))


def smoothing(billing) -> None:
    finish(forecast.holt_winters(panel.daily_series(billing)))


WORK = {
    "quality_report": lambda b: finish(quality.quality_report(b)),
    "quality_gate_only": lambda b: finish(quality.quality_report(b, "none")),
    "spend_summary": lambda b: finish(spend.spend_summary(b)),
    "top_breakdowns": lambda b: finish(spend.top_breakdowns(b)),
    "spend_trend_daily": lambda b: finish(spend.spend_trend(b)),
    "cost_drivers": lambda b: finish(spend.cost_drivers(b)),
    "daily_series": lambda b: finish(panel.daily_series(b)),
    "anomaly_report": lambda b: finish(anomaly.ranked(anomaly.run_detection(b))),
    "ranked_opportunities": opportunities,
    "holt_winters": smoothing,
    "decision_run": whole_run,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("costlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.openCostInBytes", "262144")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    finish(table(spark, sf_dir, "region"))
    path = session.scratch_table(spark, "bench")
    seconds = {}

    def timed(name: str, work) -> None:
        started = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - started, 3)

    exports = {name: session.scratch_table(spark, name) + ".csv" for name in ("ingest", "ingest_1000")}
    raw_focus(spark, sf_dir).write.option("header", True).option("escape", '"').csv(exports["ingest"])
    # any 1,000 rows of it
    raw_focus(spark, sf_dir).limit(1000).coalesce(1).write.option("header", True).csv(exports["ingest_1000"])
    small = None
    for name, export in exports.items():
        store = session.scratch_table(spark, "store")

        def work() -> None:
            nonlocal small
            small = ingest(spark, export, store, dataset_id=name)
            finish(small.quality)
            finish(small.provenance)

        timed(name, work)
    timed("decision_run_1000", lambda: whole_run(small.rows))
    sources.write_canonical(everything(spark, sf_dir), path)
    billing = sources.read_table(spark, path)
    charges = billing.count()
    for name, work in WORK.items():
        timed(name, lambda: work(billing))
    session.drop_table(spark, path)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "charges": charges,
                "rows_per_sec": {q: round((1000 if q.endswith("_1000") else charges) / s) for q, s in seconds.items() if q != "ingest"},
                "published": {"ingest_1000": 0.30, "decision_run_1000": 9.25},
            }
        )
    )


if __name__ == "__main__":
    main()
