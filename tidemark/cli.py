"""Command line: ``python -m tidemark.cli simulate|train|analyse ...``"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    sim = sub.add_parser("simulate", help="features, signals and trades of stored bars")
    sim.add_argument("bars")
    sim.add_argument("out")
    sim.add_argument("--symbols", nargs="*")
    sim.add_argument("--timeframes", nargs="*")
    sim.add_argument("--start")
    sim.add_argument("--end")
    sim.add_argument("--pip", type=float, default=0.0001)
    sim.add_argument("--runner", default="sr_atr_trail")
    train = sub.add_parser("train", help="walk-forward filter on stored data sets")
    train.add_argument("data")
    train.add_argument("out")
    train.add_argument("--target", default="label_positive")
    train.add_argument("--trees", type=int, default=400)
    train.add_argument("--named", action="store_true", help="store below OUT in a folder named by series, days and time")
    analyse = sub.add_parser("analyse", help="classification metrics of stored trainings")
    analyse.add_argument("runs")
    analyse.add_argument("out")
    got = parser.parse_args(args)

    from pyspark.sql import SparkSession

    from tidemark.operators.model import TrainConfig
    from tidemark.plans.config import ExecutionConfig, FeatureConfig
    from tidemark.plans.workflows import run_analysis, run_simulation, run_training, training_folder
    from tidemark.sources.bars import read_bars

    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if got.command == "simulate":
        bars = read_bars(spark, got.bars, symbols=got.symbols, timeframes=got.timeframes, start=got.start, end=got.end)
        run_simulation(bars, got.out, FeatureConfig(pip=got.pip), ExecutionConfig(pip=got.pip, runner=got.runner))
    elif got.command == "analyse":
        run_analysis(spark, got.runs, got.out)
    else:
        out = training_folder(spark, got.data, got.out) if got.named else got.out
        run_training(spark, got.data, out, TrainConfig(target=got.target, trees=got.trees))


if __name__ == "__main__":
    main()
