"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the word budget in proportion to its weight, but at most ``epochs``
times its own words; what a clamped source can't take is shared among the rest by weight, until
no source is above its cap. A document is then repeated ``floor(target / source words)`` whole
times, and a seeded part of the source's documents once more, for the fraction.

Scale: only DataFrame expressions. Word counts and a hash per document are written once as narrow
rows; a source's words are added up in ``SLOTS`` ranges of the hash, and the threshold that ends
the fraction is found from these sums and, inside one range, from its documents. So a source with
a third of all rows is never in one task. The level of the water comes from a few one-row
aggregates over the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import positions, store

EPOCHS = 3
CYCLE = (5, 2, 1)     # weights of the sources in code-point order, repeating
SLOTS_BITS = 12
HASH_BITS = 52
SALTS = 16
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def _source_key(c):
    """A key that is never null: sources are compared as they are, null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit("null"))


def _hash(seed: int):
    """A 52-bit hash of the doc_id, the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit("null")))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def cycle_weights(sources: DataFrame, cycle=CYCLE) -> DataFrame:
    """``key, weight`` for a table of distinct ``key, source``, by code point, null last."""
    ranked = positions(sources.select("key", "source"), [F.col("source").isNull(), F.col("source")])
    which = F.pmod(F.col("pos"), F.lit(len(cycle))).cast("int")
    return ranked.select("key", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), which + 1).alias("weight"))


def water_fill(sources: DataFrame, budget: float | None = None, epochs: float = EPOCHS) -> DataFrame:
    """Add ``target`` to ``key, source_size, weight``: shares of ``budget`` (default: all words).

    Each round clamps the sources whose share is above ``epochs * source_size`` and shares the
    rest of the budget among the others; it ends when no further one is clamped.
    """
    cap, share = F.col("source_size") * F.lit(float(epochs)), None
    if budget is None:
        budget = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        full, open_weight = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)),
                                        F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        old, level = level, (budget - full) / open_weight
        if level == old:
            break
    share = F.lit(0.0) if level is None else F.least(F.col("weight") * F.lit(level), cap)
    return sources.withColumn("target", share)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS,
                budget: float | None = None, seed: int = SEED, cycle=CYCLE) -> DataFrame:
    """How often the mix takes each document: one row per row of ``docs``.

    Returns ``doc_id, source, size`` (words of the text; null: 0), ``source_size, target`` (of its
    source), ``repeats`` and ``taken = size * repeats``. ``weights(source, weight)`` gives the
    sources' weights; without it they are ``cycle`` by rank. Only ``doc_id, source, text`` are read.

    A null source is a source of its own; one without words has target 0 and repeats 0. Repeated
    rows and ties of the hash are taken or left together. An empty table gives no rows.
    """
    d = store(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _hash(seed).alias("hash")).withColumn("key", _source_key(F.col("source"))), "sizes")
    low = HASH_BITS - SLOTS_BITS
    slots = store(d.groupBy("key", "source", F.shiftright("hash", low).alias("slot"))
                   .agg(F.sum("size").alias("words")), "slots")
    sources = store(slots.groupBy("key", "source").agg(F.sum("words").alias("source_size")), "sources")
    if weights is None:
        w = cycle_weights(sources, cycle)
    else:
        w = weights.groupBy(_source_key(F.col("source").cast("string")).alias("key")).agg(
            F.max(F.col("weight").cast("double")).alias("weight"))
    sources = store(sources.join(w, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))), "weights")
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    sources = store(water_fill(sources, budget, epochs).withColumn("whole", F.floor(share).cast("bigint"))
                    .withColumn("want", (share - F.floor(share)) * F.col("source_size")), "targets")
    # the range of hashes in which the fraction ends, and the words before it
    up_to = Window.partitionBy("key").orderBy("slot")
    edge = (slots.withColumn("upto", F.sum("words").over(up_to)).join(sources.select("key", "want"), "key")
                 .where("upto > want and upto - words <= want and want > 0")
                 .groupBy("key").agg(F.min("slot").alias("slot"), F.min("want").alias("want"),
                                     F.min(F.col("upto") - F.col("words")).alias("before")))
    inside = d.withColumn("slot", F.shiftright("hash", low)).join(edge, ["key", "slot"])
    run = Window.partitionBy("key").orderBy("hash").rangeBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("ahead", F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("before"))
    last = inside.groupBy("key").agg(
        F.max(F.when(F.col("ahead") + F.col("size") / 2.0 <= F.col("want"), F.col("hash") + 1)).alias("top"))
    ends = edge.join(last, "key", "left").select(
        "key", F.coalesce("top", F.shiftleft("slot", low)).alias("below"))
    table = sources.join(ends, "key", "left").select(
        "key", "source_size", "target", "whole", F.coalesce("below", F.lit(0)).alias("below"))
    table = store(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "plan")
    j = d.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")).join(table, ["key", "salt"])
    j = j.withColumn("repeats", F.col("whole") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0))
    return j.select("doc_id", "source", "size", "source_size", "target", "repeats",
                    (F.col("size") * F.col("repeats")).alias("taken"))


def mixture(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus: the columns and rows of ``docs``, each row as often as the mix takes it."""
    plan = mix_sources(docs, **params).where("repeats > 0").groupBy(F.col("doc_id").alias("_id"),
                                                                   F.col("source").alias("_source")).agg(
        F.max("repeats").cast("int").alias("_repeats"))
    j = docs.join(plan, docs["doc_id"].cast("bigint").eqNullSafe(plan["_id"])
                  & docs["source"].cast("string").eqNullSafe(plan["_source"]))
    return j.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select(docs["*"])
