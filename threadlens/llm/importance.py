"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed buckets are estimated, one of the target text (documents
labelled good) and one of all raw text. A document's importance weight is the ratio of the
probabilities that the models give it, and the selection is a sample without replacement in
proportion to the weights: Gumbel noise is added to each log weight and the k largest stay.
k is the number of documents whose own text is nearer to the target than the cut that best
separates the labelled good from the labelled bad documents, so the share that is kept follows
the data.

Scale: the models are two arrays of ``buckets`` numbers, whatever the corpus; each task adds its
own before the shuffle. Labelled rows are a sample of bounded size (``labelled``), joined on the
map side; texts are never shuffled. Ranks for the top-k come from a range-partitioned sort of
narrow rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import gram_hashes, mix, positions, store

BUCKETS = 10_000
LABELLED = 20_000
SEED = 7
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
SMOOTH = 1.0
KNOWN_TOKENS = 1 << 20


def _shape(token: bytes) -> int:
    """0 mark, 1 number, 2 one letter, 3 lower case, 4 capitalised, 5 capitals, 6 mixed."""
    s = token.decode("utf-8", "replace")
    if not (s[0].isalnum() or s[0] == "_"):
        return 0
    if s.isdigit():
        return 1
    if len(s) == 1:
        return 2
    if s.islower():
        return 3
    if s.isupper():
        return 5
    return 4 if s[0].isupper() and s[1:].islower() else 6


class Featurizer:
    """Hashed n-gram buckets of a text: words, word pairs, and pairs of word shapes.

    Words are compared in lower case; the shape of a pair also says whether a word repeats.
    """

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        if len(self.known) > KNOWN_TOKENS:
            self.known = {}
        known, out = self.known, []
        for t in TOKEN.findall(text or b""):
            h = known.get(t)
            if h is None:
                word = t.decode("utf-8", "replace").lower().encode()
                h = known[t] = (xxhash.xxh3_64_intdigest(word) & ~7) | _shape(t)
            out.append(h)
        h = np.array(out, np.uint64)
        shape, word = (h & np.uint64(7)), h >> np.uint64(3)
        grams = [mix(word), gram_hashes(word, 2)]
        if len(h) > 1:
            pair = (shape[1:] * np.uint64(8) + shape[:-1]) * np.uint64(2) + (word[1:] == word[:-1])
            grams.append(mix(pair.astype(np.uint64) + np.uint64(0x5A17E50F00000000)))
        return (np.concatenate(grams) % np.uint64(self.buckets)).astype(np.int64)


def _counter(buckets: int):
    def run(batches):
        f, raw, target = Featurizer(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for text, good in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("good").to_pylist()):
                c = np.bincount(f(text), minlength=buckets)
                raw += c
                if good:
                    target += c
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])],
                                         ["bucket", "raw", "target"])
    return run


def _weigher(ratio: np.ndarray):
    def run(batches):
        f = Featurizer(len(ratio))
        for b in batches:
            w, n = [], []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                at = f(text)
                w.append(float(ratio[at].sum()))
                n.append(len(at))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("good"), pa.array(w, pa.float64()), pa.array(n, pa.int64())],
                ["doc_id", "good", "log_weight", "n_grams"])
    return run


def label_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids ``(label_id, good)``, the same ones each time.

    Good: quality 1 and not toxic; bad: quality 0. An id labelled twice counts with its worse
    label; ids or qualities that are null are left out.
    """
    per = labels.groupBy(F.col("doc_id").cast("bigint").alias("label_id")).agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    per = per.where("label_id is not null and quality is not null and (quality = 0 or toxic = 0)")
    return (per.select("label_id", (F.col("quality") > 0).alias("good"))
               .orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id").limit(limit))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The mean log ratio that separates best: fewest errors, each class weighing the same.

    Among equally good cuts the middle one; with one class missing, everything passes.
    """
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    edges = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), edges) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), edges) / len(bad)
    cost = lost + passed
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(edges[best[len(best) // 2]])


def importance(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> DataFrame:
    """``doc_id, log_weight, n_grams, fits, lead``: the importance weight of every document.

    ``lead`` is the weight over that of a text of the same length whose mean log ratio is the calibrated
    cut, so that long and short texts compare; ``fits`` says that it is above 0. Only
    ``doc_id`` and ``text`` are read. A null or empty text has no n-grams, weight 0, and does not
    fit; repeated rows are weighed each; an empty table gives no rows.
    """
    sample = store(label_sample(labels, labelled), "labels")
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "text", "good")
    counts = (d.mapInArrow(_counter(buckets), "bucket int, raw bigint, target bigint")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.any():      # nothing is labelled good: every text is as near to the target
        target = raw
    ratio = (np.log((target + SMOOTH) / (target.sum() + SMOOTH * buckets))
             - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * buckets)))
    weights = store(d.mapInArrow(_weigher(ratio), "doc_id bigint, good boolean, log_weight double, n_grams bigint"),
                    "weights")
    # one row a labelled id, however often its row is repeated
    own = weights.where("good is not null and n_grams > 0").groupBy("doc_id").agg(
        F.max("good").alias("good"), F.avg(F.col("log_weight") / F.col("n_grams")).alias("mean")).toPandas()
    is_good = own["good"].to_numpy(bool)
    cut = best_cut(own["mean"].to_numpy()[is_good], own["mean"].to_numpy()[~is_good])
    if not np.isfinite(cut):
        return weights.select("doc_id", "log_weight", "n_grams", (F.col("n_grams") > 0).alias("fits"),
                              F.col("log_weight").alias("lead"))
    lead = F.col("log_weight") - cut * F.col("n_grams")
    return weights.select("doc_id", "log_weight", "n_grams", (lead > 0).alias("fits"), lead.alias("lead"))


def _key(seed: int):
    """Lead plus Gumbel noise; the noise depends on the id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(2.0 ** 53)
    return F.col("lead") - F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED,
             seed: int = SEED) -> DataFrame:
    """The k documents that Gumbel top-k draws: ``doc_id, log_weight, n_grams, key, rank`` (from 1).

    Ties of the key go to the smaller doc_id, null first. Documents without n-grams are never drawn.
    """
    weights = importance(docs, labels, buckets, labelled).where("n_grams > 0")
    k = weights.where("fits").count()
    ranked = positions(weights.withColumn("key", _key(seed)).drop("fits", "lead"),
                       [F.col("key").desc(), F.col("doc_id")])
    return ranked.where(F.col("pos") < k).select(
        "doc_id", "log_weight", "n_grams", "key", (F.col("pos") + 1).alias("rank"))


def keep_sample(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows and columns of ``docs`` whose doc_id is drawn, once for each row.

    Repeated rows share a key and stay or go together. Joined on the narrow ids only.
    """
    drawn = store(resample(docs, labels, **params).select(F.col("doc_id").alias("_drawn")).distinct(), "drawn")
    return docs.join(drawn, docs["doc_id"].cast("bigint").eqNullSafe(F.col("_drawn")), "left_semi")
