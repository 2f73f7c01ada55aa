"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark whatever store the path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: what follows re-reads these files when an executor is lost, and several
    consumers share one computation.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame | None) -> None:
    """Delete the files of frames that ``store`` returned and that nothing will read again."""
    for df in stored:
        if df is not None:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, order: list, out: str = "pos") -> DataFrame:
    """Number the (narrow) rows of ``df`` from 0 along a total order, over many tasks.

    Rows are range-partitioned and sorted, so no task holds them all; each row's number is its
    place in its partition plus the rows of the partitions before it. The per-partition counts
    (one row a partition, so bounded by the partition count) are the only broadcast data.
    """
    s = (df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
           .withColumn("_part", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    s = store(s, "positions")
    seg = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (s.join(F.broadcast(seg), "_part")
             .withColumn(out, F.col("_mid") + F.col("_shift")).drop("_part", "_mid", "_shift"))


def ascii_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z in lower case."""
    return text.lower().split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bounded number of words."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known = {}
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping arithmetic), so that any of their bits can be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


GRAM_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
             0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (empty if there are fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m, out = len(h) - n + 1, np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out += h[k:k + m] * np.uint64(GRAM_KEYS[k])
    return mix(out)
