"""Positions within groups without sending a whole group to one task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` runs each group in a single task; a
thread holding a third of all comments would then be one straggler task. Here a narrow
projection (group, row key, order columns) is range-partitioned on (g, k), so a hot group
spans as many tasks as its size needs; each sorted partition numbers its rows locally,
and a small per-(group, partition) count table supplies the offset of every segment.

The partition ids and local numbers must be the same for the rows and for the count
table, so the numbered projection is written once with a reliable ``checkpoint()`` to the
shared checkpoint folder (``spark.checkpoint.dir``): recomputation after a lost executor
re-reads it instead of re-sampling range bounds. Positions are joined back to the full
rows on the unique row key, a join without skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.session import ensure_checkpoint_dir


def group_positions(df: DataFrame, by: list[str], order: list, key: list[str], out: str = "pos",
                    size: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row within its ``by`` group.

    ``order``: list of ``(expression, descending)`` pairs; ``key``: columns identifying a row
    within its group, which must end the order (a total order). ``size`` (when given) adds
    the group's row count.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    extra = [k for k in key if k not in by]
    exprs = [(F.col(e) if isinstance(e, str) else e) for e, _ in order]
    narrow = df.select(*by, *extra, *[e.alias(f"_o{i}") for i, e in enumerate(exprs)])
    okeys = [F.col(c) for c in by] + [F.col(f"_o{i}").desc() if d else F.col(f"_o{i}")
                                      for i, (_, d) in enumerate(order)]
    s = (narrow.repartitionByRange(n, *okeys).sortWithinPartitions(*okeys)
               .withColumn("_part", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    seg = s.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_segn"), F.min("_mid").alias("_m0"))
    w_before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_off", F.coalesce(F.sum("_segn").over(w_before), F.lit(0)))
    cols = [*by, *extra, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint").alias(out)]
    if size:
        seg = seg.withColumn(size, F.sum("_segn").over(Window.partitionBy(*by)))
        cols.append(F.col(size))
    pos = s.join(seg, [*by, "_part"]).select(*cols)
    return df.join(pos, [*by, *extra])
