"""What the jobs' command lines share: settings from a JSON file, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from typing import TypeVar

from pyspark.sql import SparkSession

Settings = TypeVar("Settings")


def settings_of(kind: type[Settings], path: str | None) -> Settings:
    """Settings of a job: defaults, with what a JSON file says in place of them. An unknown name is an error."""
    if path is None:
        return kind()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    unknown = sorted(given.keys() - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"{path}: unknown settings {', '.join(unknown)}")
    return kind(**given)


def command(about: str, name: str, kind: type[Settings], paths: dict[str, str], run: Callable[..., dict], argv: list[str] | None = None) -> dict:
    """Parses a command line of paths and a config file, and runs the job in a session of its own."""
    parser = argparse.ArgumentParser(description=about, formatter_class=argparse.RawDescriptionHelpFormatter)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", help="JSON file of settings; see the one beside the job")
    args = vars(parser.parse_args(argv))
    settings = settings_of(kind, args.pop("config"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        return run(spark, settings=settings, **args)
    finally:
        spark.stop()
