"""Headline timings, one JSON line.

``models`` run lazily from the driver's tables into a no-op sink. The remaining
steps follow an installation's day: load the raw store, build every model into
tables, run all checks, gather the evidence of all flagged moves.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans import evidence, quality  # noqa: E402
from revlens.plans.models import REPORTING, Now, Workspace  # noqa: E402
from revlens.session import local_session, shared_dir  # noqa: E402
from revlens.sources.model_store import ModelStore  # noqa: E402
from revlens.sources.raw_store import RawStore  # noqa: E402
from revlens.sources.testtables import AS_OF, RUN_TS, raw_tables  # noqa: E402

NOW = Now(AS_OF, RUN_TS)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8)
    times: dict[str, float] = {}

    def timed(name: str, step) -> None:
        began = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - began, 3)

    def model(name: str) -> None:
        run(Workspace(raw_tables(spark, folder), NOW)[name])

    model("mart_mrr")  # starts the JVM's compilers; measured below
    for name in ("fact_subs_by_day", *REPORTING):
        timed(name, lambda: model(name))

    raw, models = RawStore(spark, shared_dir(spark)), ModelStore(spark, shared_dir(spark))

    timed("load_raw_tables", lambda: raw.replace_all(raw_tables(spark, folder)))
    workspace = Workspace(raw.read_all(), NOW)
    timed("build_models", lambda: workspace.build(models))
    timed("quality_report", lambda: run(quality.quality_report(workspace)))
    flagged = evidence.flagged_anomalies(workspace["mart_anomaly_candidates"])
    timed("investigate_all", lambda: run(evidence.investigate_all(workspace, flagged)))
    timed("report_text", lambda: run(evidence.report_text(workspace, flagged)))

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
