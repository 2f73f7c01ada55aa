"""SRC4: URL list files (one URL per line, '#' comment lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_url_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Strip lines, drop blank ones and lines whose first (unstripped) character is '#'."""
    v = F.col(col)
    return (lines.filter(~v.startswith("#"))
                 .select(F.regexp_replace(v, r"(?U)^\s+|\s+$", "").alias("url"))
                 .filter(F.col("url") != ""))


def load_url_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_url_lines(spark.read.text(path))
