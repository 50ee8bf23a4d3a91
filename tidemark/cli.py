"""Command line: tidemark run settings.toml [-d key=value], tidemark info."""

from __future__ import annotations

import argparse
import cProfile
import logging
import pstats
import sys
from pathlib import Path

from . import __version__
from .plans import checks, geom_model, grid_model
from .plans.config import Config, parsed_value

log = logging.getLogger("tidemark")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tidemark")
    p.add_argument("--version", action="version", version=f"tidemark {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info", help="what this is")
    run = sub.add_parser("run", help="run the models of a settings file")
    run.add_argument("config")
    run.add_argument("-t", "--threads", type=int, help="local threads")
    run.add_argument("-d", "--set", action="append", default=[], metavar="KEY=VALUE", help="overrides a setting")
    run.add_argument("-p", "--profile", action="store_true", help="write profile.txt to the output folder")
    run.add_argument("-q", "--quiet", action="count", default=0)
    run.add_argument("-v", "--verbose", action="count", default=0)
    return p


def settings(args: argparse.Namespace) -> Config:
    config = Config.from_file(args.config)
    for item in args.set:
        key, _, value = item.partition("=")
        config[key.strip()] = parsed_value(value)
    return config


def run_models(spark, config: Config) -> None:
    if any(k.startswith("exposure.geom.file") for k in config):
        geom_model.run(spark, config)
    if checks.grid_entries(config):
        grid_model.run(spark, config)


def profiled(work, path: Path) -> None:
    """Runs the work under the profiler of the driver's Python."""
    profile = cProfile.Profile()
    profile.runcall(work)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w") as f:
        pstats.Stats(profile, stream=f).sort_stats("cumulative").print_stats(50)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "info":
        print(f"tidemark {__version__}: hazard impact assessment on Spark")
        return 0
    logging.basicConfig(level=logging.INFO + 10 * (args.quiet - args.verbose), format="%(asctime)s %(levelname)s %(message)s")
    from pyspark.sql import SparkSession

    try:
        config = settings(args)
        builder = SparkSession.builder.appName("tidemark")
        spark = (builder.master(f"local[{args.threads}]") if args.threads else builder).getOrCreate()
        if args.profile:
            profiled(lambda: run_models(spark, config), Path(config.output) / "profile.txt")
        else:
            run_models(spark, config)
    except (ValueError, OSError) as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
