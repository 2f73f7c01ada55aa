"""Report sinks and reading reports back (SNK1-SNK4, SRC5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.schemas import SAVED_REPORT

FORMATS = ("json", "markdown", "both")


def output_name(post_id, ext: str = "json", ts=None) -> Column:
    """SNK4: ``{id}_{yyyyMMdd_HHmmss}.{ext}`` with a timestamp, else ``{id}.{ext}``."""
    pid = F.col(post_id) if isinstance(post_id, str) else post_id
    if ts is None:
        return F.concat(pid.cast("string"), F.lit("." + ext))
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(pid.cast("string"), F.lit("_"), F.date_format(t, "yyyyMMdd_HHmmss"), F.lit("." + ext))


def write_reports_json(reports: DataFrame, path: str, partition_by: str | None = None,
                       mode: str = "overwrite") -> None:
    """SNK1: one JSON line per post report (UTF-8, non-ASCII kept)."""
    w = reports.write.mode(mode).option("ignoreNullFields", "false")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def write_reports_markdown(reports: DataFrame, path: str, md_col: str = "markdown",
                           key: str = "post_id", ts: str | None = None, mode: str = "overwrite") -> None:
    """SNK2: the Markdown rendering per post as JSON lines (post_id, file_name, markdown).

    One row per post in a few large files: a folder or file per post would put millions of
    small files on the shared file system at scale. ``file_name`` is SNK4's name.
    """
    (reports.select(F.col(key).cast("string").alias(key),
                    output_name(F.col(key), "md", ts).alias("file_name"),
                    F.col(md_col).alias("markdown"))
            .write.mode(mode).json(path))


def save_reports(reports: DataFrame, path: str, output_format: str = "both",
                 save_to_file: bool = True) -> list[str]:
    """SNK3: the json / markdown / both switch; returns the folders written."""
    if output_format not in FORMATS:
        raise ValueError(f"output_format must be one of {FORMATS}")
    if not save_to_file:
        return []
    if output_format == "both":
        # both sinks read one reliable checkpoint (shared folder) instead of computing twice
        from threadlens.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(reports.sparkSession)
        reports = reports.checkpoint(eager=True)
    written = []
    if output_format in ("json", "both"):
        write_reports_json(reports.drop("markdown") if "markdown" in reports.columns else reports,
                           f"{path}/json")
        written.append(f"{path}/json")
    if output_format in ("markdown", "both") and "markdown" in reports.columns:
        write_reports_markdown(reports, f"{path}/markdown")
        written.append(f"{path}/markdown")
    return written


def load_reports(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """SRC5: read saved JSON reports back, as ``(post_id, report)`` unless another schema is given.

    The schema is fixed, so label maps stay maps and the files are read once.
    """
    return spark.read.schema(schema or SAVED_REPORT).json(path)
