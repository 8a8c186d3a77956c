"""The batch job: three input tables in, eight result tables out.

    python -m footfall.plans.job IN_DIR OUT_DIR [--input-format parquet]
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import SparkSession

from footfall.operators import experiment, retention
from footfall.operators.users import user_facts
from footfall.plans.analyses import funnel_tables, segment_table
from footfall.session import session
from footfall.sources import (
    read_events,
    read_products,
    read_users,
    work_folder,
    write_artifact,
    written_table,
)
from footfall.sources.publication import Folder, publish, published, withdraw

#: Whole runs whose tables stay: readers of the former one aren't disturbed.
KEPT_RUNS = 2


def run(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    input_format: str = "csv",
    output_format: str = "csv",
    attribute: str = "gender",
    multi_line: bool = False,
    pattern: str | None = None,
    zone: str = "UTC",
) -> list[str]:
    """Read ``in_dir/{events,users,products}.<format>`` and write all results.

    The log is scanned twice: once for the per-user facts, which are written for the length
    of the run and serve every analysis, and once (cart events only) for the users' primary
    categories. The last three options are the readers'.

    The tables are written to a folder of the run's own and published together at its end, so
    that ``read_artifact`` finds all of one run; a run that stops halfway leaves the former
    results as they were. Returns the names of the tables.
    """
    def source(name: str) -> tuple[SparkSession, str, str]:
        return spark, f"{in_dir}/{name}.{input_format}", input_format

    events = read_events(*source("events"), multi_line, pattern, zone)
    users = read_users(*source("users"), attribute, multi_line)
    products = read_products(*source("products"), multi_line)

    number, _ = published(spark, out_dir)
    folder = f"runs/{number + 1:08d}-{uuid.uuid4().hex}"
    target = f"{out_dir}/{folder}"
    with work_folder(spark, out_dir) as work:
        facts = written_table(user_facts(events), "user_facts", work)
        funnel = funnel_tables(facts)
        results = written_table(experiment.ab_results(facts), "ab_results", work)
        reports = {
            "funnel_stages": funnel.stages,
            "funnel_rates": funnel.rates,
            "funnel": funnel.long,
            "cohort_retention": retention.cohort_retention(facts),
            "segment_conversion": segment_table(facts, events, users, products, attribute),
            "ab_results_by_variant": results.orderBy("variant"),
            "ab_results_summary": experiment.ab_summary(results),
        }
        for name, table in reports.items():
            write_artifact(table, target, name, output_format, single_file=True)
        # One row per user, so it keeps its partitions.
        write_artifact(
            experiment.assignments(facts), target, "experiment_assignments", output_format
        )
    names = [*reports, "experiment_assignments"]
    publish(spark, out_dir, {"folder": folder, "format": output_format, "tables": names}, number)
    gone, _ = withdraw(spark, out_dir, KEPT_RUNS)
    for run_ in gone:
        Folder(spark, out_dir).delete(run_["folder"])
    return names


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("in_dir")
    parser.add_argument("out_dir")
    parser.add_argument("--input-format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--output-format", default="csv", choices=["csv", "parquet"])
    parser.add_argument("--attribute", default="gender")
    args = parser.parse_args()
    names = run(
        session(), args.in_dir, args.out_dir, args.input_format, args.output_format, args.attribute
    )
    print("Wrote", ", ".join(names), "to", args.out_dir)


if __name__ == "__main__":
    main()
