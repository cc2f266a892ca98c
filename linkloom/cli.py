"""Command line: run a configured chain on a file, or convert configurations."""

from __future__ import annotations

import argparse
import importlib.util

import yaml
from pyspark.sql import SparkSession

from linkloom.operators.errors import StripErrors
from linkloom.plans import config
from linkloom.plans.base import Configurable, empty_table
from linkloom.sources.files import FromFile, ToFile
from linkloom.toolbox import load_all


def _options(pairs: list[str]) -> dict:
    out = {}
    for pair in pairs:
        key, found, value = pair.partition("=")
        if not found:
            raise SystemExit(f"{pair!r} is not key=value")
        out[key] = yaml.safe_load(value)
    return out


def _plugin(path: str | None) -> None:
    """Runs a file that registers own links."""
    if path:
        spec = importlib.util.spec_from_file_location("linkloom_plugin", path)
        spec.loader.exec_module(importlib.util.module_from_spec(spec))


def run(args: argparse.Namespace) -> None:
    load_all()
    _plugin(args.custom_links)
    link = Configurable.from_config_file(args.config)
    if args.debug_level:
        link.set_log_level(args.debug_level)
    spark = SparkSession.builder.appName("linkloom").getOrCreate()
    sep = {"sep": args.sep}
    df = empty_table(spark.range(0))
    if args.in_file:
        df = FromFile(args.in_file, sep | _options(args.pd_read_option))(df)
    out = link(df).persist()
    if args.error_file:
        strip = StripErrors(args.error_file)
        out = strip(out)
    if args.out_file:
        ToFile(args.out_file, sep | _options(args.pd_write_option))(out)
    else:
        out.show()


def convert(args: argparse.Namespace) -> None:
    load_all()
    _plugin(args.custom_links)
    link = Configurable.from_config_file(args.source)
    config.save_dict(link.get_params(args.defaults, args.version, args.loglevel), args.target)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkloom", description=__doc__)
    commands = parser.add_subparsers(required=True)
    r = commands.add_parser("run", help="apply a chain to a file")
    r.add_argument("config")
    for name in ("in_file", "out_file", "error_file", "debug_level", "custom_links"):
        r.add_argument(f"--{name}")
    r.add_argument("--sep", default=",")
    r.add_argument("--pd_read_option", action="append", default=[], metavar="KEY=VALUE")
    r.add_argument("--pd_write_option", action="append", default=[], metavar="KEY=VALUE")
    r.set_defaults(call=run)
    k = commands.add_parser("config", help="read a configuration and write it anew")
    k.add_argument("source")
    k.add_argument("target")
    k.add_argument("--custom_links")
    for name in ("defaults", "version", "loglevel"):
        k.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=True)
    k.set_defaults(call=convert)
    args = parser.parse_args(argv)
    args.call(args)


if __name__ == "__main__":
    main()
