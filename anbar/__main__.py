"""The whole job for spark-submit: python -m anbar --transactions ... --calendar ... --out ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from anbar.config import MODEL_CODES, MODEL_NAMES
from anbar.plans.run import run
from anbar.sources.tables import read_transactions, read_working_days, text_columns


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="anbar", description=__doc__)
    parser.add_argument("--transactions", required=True, nargs="+", help="files or folders")
    parser.add_argument("--format", default="parquet", choices=("parquet", "orc", "csv", "json"))
    parser.add_argument("--calendar", required=True, help="CSV of Date (dd/mm/yyyy), WorkingDay")
    parser.add_argument("--out", required=True, help="folder of the written tables")
    parser.add_argument(
        "--models", nargs="+", default=["gbt", "rf"],
        choices=("all", *MODEL_NAMES, *MODEL_CODES), metavar="MODEL",
    )
    parser.add_argument("--headers", action="store_true", help="write Persian header texts")
    parser.add_argument(
        "--checkpoints", help="shared folder for intermediate rows; default: spark.checkpoint.dir"
    )
    parser.add_argument("--stages", help="shared folder that lets a stopped run go on behind its finished models")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    chosen = arguments(args)
    spark = SparkSession.builder.appName("anbar").getOrCreate()
    if chosen.checkpoints:
        spark.sparkContext.setCheckpointDir(chosen.checkpoints)
    schema = text_columns() if chosen.format == "json" else None
    raw = read_transactions(spark, chosen.transactions, chosen.format, schema)
    calendar = read_working_days(spark, chosen.calendar)
    outcome = run(
        raw, calendar, models=chosen.models, out_dir=chosen.out, headers=chosen.headers, stages_dir=chosen.stages
    )
    for code in outcome.skipped:
        print(f"not fitted, too few months: {MODEL_NAMES[code]}")


if __name__ == "__main__":
    main()
