"""What the command lines of the jobs share: settings, the session, the log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession


def loaded(kind: type, path: str | None, **paths: str):
    """Settings of ``kind``: its defaults, then the JSON file, then what the command line says. An unknown name in the file is an error."""
    found = json.loads(Path(path).read_text()) if path else {}
    if unknown := sorted(set(found) - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown settings in {path}: {', '.join(unknown)}")
    return kind(**found | {k: v for k, v in paths.items() if v is not None})


def main(kind: type, run: Callable, about: str, args: list[str] | None = None) -> int:
    """Run a job with a session of its own; paths on the command line replace those in the settings file."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file of settings")
    for f in fields(kind):
        if f.type == "str":
            parser.add_argument(f"--{f.name}")
    given = vars(parser.parse_args(args))
    settings = loaded(kind, given.pop("config"), **given)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about).getOrCreate()
    try:
        run(spark, settings)
    finally:
        spark.stop()
    return 0
