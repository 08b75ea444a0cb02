"""What a session has to know so that plans of this package run well wherever their tasks are."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: bytes of a method from which on HotSpot leaves it interpreted
COMPILED = 8000
LIMIT_KEY = "spark.sql.codegen.hugeMethodLimit"


def findable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; elsewhere such a path does no harm."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def compiled(spark: SparkSession) -> None:
    """Let selects of many columns be generated in parts that HotSpot compiles (for the session: Spark reads the limit when a plan runs)."""
    if int(spark.conf.get(LIMIT_KEY)) > COMPILED:
        spark.conf.set(LIMIT_KEY, str(COMPILED))
