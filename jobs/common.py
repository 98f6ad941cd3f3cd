"""What the jobs share: arguments, configuration, logging, and folders by Spark alone."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("labelscope.jobs")
HERE = os.path.dirname(os.path.abspath(__file__))


def configured(spark: SparkSession, path: str, known: dict) -> dict:
    """The JSON object in the file at ``path``, over ``known`` defaults; a name that is not known is an error.

    A file beside the jobs is part of the code and read where the job is started; any other
    path, which may be remote, is read by Spark.
    """
    if os.path.dirname(path) == HERE:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
    else:
        given = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    if odd := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings {odd} in {path}")
    return known | given


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or no rows where nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(description: str, arguments: dict[str, str], default_config: str, run: Callable[..., None]) -> None:
    """Parse ``arguments`` (name to help) and --config, make a session, run, and stop it."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in arguments.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", default=default_config, help="JSON file with the settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(description).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, config=given.pop("config"), **given)
    finally:
        spark.stop()
