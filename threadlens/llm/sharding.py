"""Sharding along a Hilbert curve.

Several metadata dimensions are cut into ``2 ** bits`` levels of about equal row counts, the
levels of a row give its place on the curve, and the rows in curve order are cut into runs of
equal length. Neighbours on the curve are near in every dimension, so each shard spans a small
box and a filter on any dimension skips most files.

Scale: only DataFrame expressions. Levels come from mergeable quantile sketches over all rows, for text
dimensions from counts by value; rows are numbered by a range-partitioned sort of narrow rows in which the document's own fields
break ties, so a hot value is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import positions, shuffle_partitions, store

SHARDS = 16
BITS = 5
DIMENSIONS = ("source", "lang", "size")


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with the given levels (0 to ``2 ** bits - 1``).

    The transposed form is undone bit by bit from the top (Skilling's method): where a
    dimension's bit is set the lower bits of the first are inverted, else the two are exchanged;
    then the Gray code is applied and the bits are interleaved.
    """
    n = len(levels)
    point = F.array(*[x.cast("bigint") for x in levels])

    def at(x, i):
        return F.element_at(x, F.lit(i + 1))

    # one small step per dimension and bit; each is an aggregate step, so expressions stay short
    steps = F.array(*[F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(x, s):
        a, b, low = at(x, 0), F.element_at(x, s["i"] + 1), s["q"] - 1
        is_set = b.bitwiseAND(s["q"]) != 0
        swap = F.when(is_set, F.lit(0).cast("bigint")).otherwise(a.bitwiseXOR(b).bitwiseAND(low))
        flip = F.when(is_set, low).otherwise(swap)
        return F.transform(x, lambda v, k: v.bitwiseXOR(
            F.when(k == 0, flip).when(k == s["i"], swap).otherwise(F.lit(0).cast("bigint"))))

    def gray(x):
        return F.aggregate(F.sequence(F.lit(2), F.lit(n)), x, lambda y, i: F.transform(
            y, lambda v, k: F.when(k == i - 1, v.bitwiseXOR(F.element_at(y, i - 1))).otherwise(v))) if n > 1 else x

    def finish(y):
        top = F.element_at(y, F.lit(n))
        t = F.aggregate(steps, F.lit(0).cast("bigint"), lambda t, s: F.when(
            (s["i"] == 0) & (top.bitwiseAND(s["q"]) != 0), t.bitwiseXOR(s["q"] - 1)).otherwise(t))
        return F.transform(y, lambda v: v.bitwiseXOR(t))

    order = F.array(*[F.struct(F.lit(1 << b).cast("bigint").alias("q"), F.lit(i).alias("i"))
                      for b in range(bits - 1, -1, -1) for i in range(n)])

    def interleave(y):
        return F.aggregate(order, F.lit(0).cast("bigint"), lambda h, s: h * 2 + F.when(
            F.element_at(y, s["i"] + 1).bitwiseAND(s["q"]) != 0, 1).otherwise(0))

    def let(value, use):
        return F.element_at(F.transform(F.array(value), use), F.lit(1))

    return let(gray(F.aggregate(steps, point, step)), lambda y: let(finish(y), interleave))


def _value_marks(df: DataFrame, c: str, bits: int) -> list:
    """The least value of each level of a text dimension: levels of about equal row counts.

    Rows are first counted by value; the values, range-partitioned, get the rows before them.
    """
    v = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    v = store(v.repartitionByRange(shuffle_partitions(df.sparkSession), c).withColumn("part", F.spark_partition_id()), "values")
    parts = v.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy(c))
    rows = v.agg(F.sum("n")).first()[0] or 1
    v = v.withColumn("upto", within).join(F.broadcast(parts), "part")
    level = F.expr(f"(ahead + upto - n) * {1 << bits} div {rows}")
    return sorted(r["least"] for r in v.groupBy(level.alias("level")).agg(F.min(c).alias("least")).collect())


def curve_order(df: DataFrame, dims=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Add ``curve`` (the place on the curve) for the dimensions ``dims`` of ``df``.

    A null value has the lowest level. Equal values have equal levels, however many there are.
    """
    kinds, shares = dict(df.dtypes), [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [c for c in dims if kinds[c] != "string"]
    cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10000).alias(c) for c in numbers]).first() if numbers else {}
    levels = []
    for c in dims:
        marks = sorted(set(cuts[c] or [])) if c in numbers else _value_marks(df, c, bits)
        over = [F.when(F.col(c) >= F.lit(m), 1).otherwise(0) for m in marks]
        levels.append(reduce(lambda a, b: a + b, over, F.lit(0)))
    return df.withColumn("curve", hilbert_index([F.least(x, F.lit((1 << bits) - 1)) for x in levels], bits))


def _placed(docs: DataFrame) -> DataFrame:
    """The narrow rows; ``at_source`` and ``at_lang`` are those of the smallest doc_id with the same text."""
    text = F.col("text").cast("string")
    d = store(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")), "metadata")
    # the smallest doc_id, then source, then lang; nulls last
    order = F.struct(*[x for c in ("doc_id", "source", "lang") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])
    groups = d.where("digest is not null").groupBy("digest").agg(F.min(order).alias("g"), F.count(F.lit(1)).alias("n"))
    groups = store(groups.where("n > 1").select("digest", "g.source", "g.lang"), "groups").select(
        F.col("digest").alias("_digest"), F.col("source").alias("_source"), F.col("lang").alias("_lang"))
    own = F.col("_digest").isNull()
    return d.join(groups, F.col("digest") == F.col("_digest"), "left").select(
        d["*"], F.when(own, F.col("source")).otherwise(F.col("_source")).alias("at_source"),
        F.when(own, F.col("lang")).otherwise(F.col("_lang")).alias("at_lang"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, dims=DIMENSIONS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, source, lang, curve, shard, slot``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. Rows in the order of the curve,
    then source, lang, size, text and doc_id (nulls first), are cut into ``shards`` runs whose
    counts differ by one at most; ``slot`` numbers a shard's rows from 0. Equal texts lie next to
    each other, at the source and lang of their smallest doc_id; only a run's end parts them. Repeated
    rows get slots of their own; with fewer rows than shards some shards are empty; an empty table
    gives no rows. Only ``doc_id, text, source, lang`` are read.
    """
    at = {"source": "at_source", "lang": "at_lang"}
    d = store(_placed(docs), "placed")
    n = d.count()
    s = positions(curve_order(d, [at.get(c, c) for c in dims], bits),
                  ["curve", "at_source", "at_lang", "size", "digest", "doc_id"]).drop("at_source", "at_lang", "digest")
    s = s.withColumn("shard", F.expr(f"pos * {shards} div {max(n, 1)}").cast("int"))
    return s.withColumn("slot", F.expr(f"pos - (shard * {n}L + {shards - 1}) div {shards}")).drop("pos")


def write_shards(docs: DataFrame, path: str, **params) -> None:
    """Write ``docs`` as Parquet, one folder ``shard=k`` for each shard, in the order of the slots.

    Ids must be unique here, for the plan is joined back on them.
    """
    plan = hilbert_shards(docs, **params).select(F.col("doc_id").alias("_id"), "shard", "slot")
    j = docs.join(plan, docs["doc_id"].cast("bigint") == plan["_id"]).drop("_id")
    (j.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
      .write.partitionBy("shard").parquet(path))
