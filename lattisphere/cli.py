"""Command line: python -m lattisphere.cli FILE --r-max 10 --calculators RDF,PAD --out results."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.analysis import CALCULATORS, MATERIALS, Analysis, Options, get_calculator
from .sources.reader import read_structures
from .sources.sinks import summary_text, write_hist


def options_of(args: argparse.Namespace) -> Options:
    base = dict(vars(MATERIALS[args.material])) if args.material else {"angle_width": 0.25}
    for name in ("r_max", "dr", "q_max", "dq", "angle_width", "ring_size", "time_step", "sigma", "kernel", "xrd_from"):
        if getattr(args, name) is not None:
            base[name] = getattr(args, name)
    base["start"], base["end"] = max(0, args.first - 1), args.last
    base["disabled_groups"] = tuple(filter(None, args.disable_groups.split(",")))
    base["active"] = {n: True for n in filter(None, args.calculators.split(","))}
    return Options(**base)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattisphere", description="Structure and trajectory analysis on Spark.")
    p.add_argument("path")
    p.add_argument("--format")
    p.add_argument("--out", default="lattisphere-results")
    p.add_argument("--write", default="csv", help="csv, parquet, h5 separated by commas")
    p.add_argument("--material", choices=sorted(MATERIALS))
    for name, kind in (("r-max", float), ("dr", float), ("q-max", float), ("dq", float), ("angle-width", float), ("ring-size", int), ("time-step", float), ("sigma", float), ("kernel", str)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--first", type=int, default=1, help="first frame, from 1")
    p.add_argument("--last", type=int, default=-1)
    p.add_argument("--calculators", default="", help=", ".join(CALCULATORS))
    p.add_argument("--disable-groups", default="")
    p.add_argument("--xrd-from", choices=("S", "g"))
    p.add_argument("--no-smoothing", action="store_true")
    p.add_argument("--summary", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    options = options_of(args)
    spark = SparkSession.builder.appName("lattisphere").getOrCreate()
    analysis = Analysis(*read_structures(spark, args.path, args.format), options)
    failed = 0
    for short, found in analysis.run().items():
        found = found.persist()  # bins and keys of a few histograms
        for name in [r[0] for r in found.select("hist").distinct().collect()]:  # a few names
            own = found.where(found["hist"] == name)
            if not args.no_smoothing and not get_calculator(short).trajectory:
                own = analysis.smoothed(own)
            errors = write_hist(own, f"{args.out}/{name.replace(' ', '_')}", tuple(args.write.split(",")))
            failed += bool(errors)
            for kind, why in errors.items():
                print(f"{short}: {kind}: {why}")
        found.unpersist()
    if args.summary:
        print(summary_text(analysis.summary()))
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())
