"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its letter 1- to 4-grams, hashed to ``BUCKETS`` rows; a
linear softmax on it gives the language. Both are trained by stochastic gradient descent in numpy
on pieces of a bounded sample of labelled texts. Part of the sample is kept apart to fit the
temperature that makes the scores probabilities, and the score under which an answer is rejected.

Scale: the sample is bounded (``PER_LANG`` texts a language and ``SAMPLE`` in all, chosen by hash),
and so is the model. Since the mean is linear, the model is folded into one table of a row of
logits per bucket, which is broadcast; every text is read whole, once, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
WIDTH = 16
ORDERS = (1, 2, 3, 4)
PER_LANG = 300
SAMPLE = 4000
LANGS = 400
PIECES = 6
PIECE_CHARS = 400
EPOCHS = 6
RATE = 0.5
EMB_STEP = 0.1
SEED = 7
PRECISION = 0.99
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SLAB = 1 << 20
KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_IS_LETTER = None


def _letters() -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])
    return _IS_LETTER


def grams(text: str, buckets: int = BUCKETS):
    """Bucket arrays of a text's letter n-grams, slab by slab; words are apart by one space.

    ``buckets`` is a power of two.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for lo in range(0, len(points), SLAB):  # a slab begins a few letters early
        p = points[max(0, lo - max(ORDERS) + 1):lo + SLAB]
        p = np.where(_letters()[np.minimum(p, 0xFFFF)] | (p > 0xFFFF), p, 32).astype(np.uint64)
        p = np.concatenate([[32], p, [32]]).astype(np.uint64)
        p = p[(p != 32) | np.concatenate([[True], p[:-1] != 32])]
        for n in ORDERS:
            if len(p) >= n:
                h = np.full(len(p) - n + 1, n, np.uint64)
                for k in range(n):
                    h += p[k:len(p) - n + 1 + k] * KEYS[k]
                yield ((h * SPREAD) >> shift).astype(np.int64)


def _bag(text: str, buckets: int):
    every = np.concatenate([np.zeros(0, np.int64), *grams(text, buckets)])
    at, n = np.unique(every, return_counts=True)
    return at, n / max(1, n.sum())


def _softmax(z):
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """``table`` (a row of logits per bucket), ``bias``, ``langs``, ``heat`` and ``least`` score."""

    def __init__(self, langs, table, bias, heat, least):
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the score is high enough to be relied on."""
        if not text or not LETTER.search(text) or not self.langs:
            return UNKNOWN, 0.0, False
        total, n = np.zeros(len(self.langs)), 0
        for at in grams(text, len(self.table)):
            total += np.bincount(at, minlength=len(self.table)) @ self.table
            n += len(at)
        p = _softmax((total / n + self.bias) * self.heat)
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] >= self.least)


def train(texts: list[str], langs: list[str], buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = SEED) -> Model:
    """Fit on pieces of the texts; a fifth of the texts calibrates. No texts: a model that knows nothing."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0, 1.0)
    rng, bags = np.random.default_rng(seed), ([], [])
    for i in rng.permutation(len(texts)):
        own = [texts[i]]
        if len(texts[i]) > PIECE_CHARS:
            own = [texts[i][a:a + int(PIECE_CHARS * rng.uniform(0.1, 1.5))]
                   for a in rng.integers(0, len(texts[i]) - PIECE_CHARS + 1, PIECES)]
        side = bags[int(rng.random() < 0.2)]
        side += [(*_bag(t, buckets), names.index(langs[i])) for t in own if LETTER.search(t)]
    fit, kept = bags[0] or bags[1], bags[1] or bags[0]
    emb, out, bias = rng.normal(0, 0.1, (buckets, width)), np.zeros((width, len(names))), np.zeros(len(names))
    for e in range(epochs):
        step = rate * (1 - e / epochs)
        for i in rng.permutation(len(fit)):
            at, share, y = fit[i]
            hidden = share @ emb[at]
            err = _softmax(hidden @ out + bias)
            err[y] -= 1
            back = out @ err
            out -= step * np.outer(hidden, err)
            bias -= step * err
            # scaled so that the mean of the embeddings moves by the same step for texts of any length
            emb[at] -= np.outer(share / (share @ share), EMB_STEP * step * back / max(1.0, np.sqrt(back @ back)))
    table = emb @ out
    z = np.array([share @ table[at] + bias for at, share, _ in kept]).reshape(-1, len(names))
    y = np.array([k for _, _, k in kept], int)
    if not len(y):
        return Model(names, table, bias, 1.0, 0.0)
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z * h)[np.arange(len(y)), y], 1e-12)).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(z * heat)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    ok = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(y) + 1))
    least = float(top[order][ok[-1]]) if len(ok) else 1.0
    return Model(names, table, bias, heat, least)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, total: int = SAMPLE) -> tuple[list[str], list[str]]:
    """About ``per_lang`` labelled texts for each of the ``LANGS`` most frequent languages, ``total`` at most.

    Held-out rows, null languages and texts without a letter are left out. Rows are chosen by a hash of
    id and text, so the choice is the same each time and no language is brought together in a task.
    """
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    d = d.where(F.col("text").rlike(r"\p{L}"))
    counts = d.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()
    if not counts:
        return [], []
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) / F.lit(2.0 ** 53)
    rows = (d.withColumn("_u", u).where(F.col("_u") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
             .select((F.col("_u") / F.try_element_at(share, F.col("lang"))).alias("_u"), "doc_id", "text", "lang")
             .orderBy("_u", "doc_id").limit(total).select("text", "lang").collect())
    return [r["text"] for r in rows], [r["lang"] for r in rows]


OUT = "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean"


def identify(docs: DataFrame, per_lang: int = PER_LANG, total: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` for every row of ``docs(doc_id, text, lang)``.

    ``lang_pred`` is a language seen in training, or ``und`` with score 0 if the text is null or has no
    letter, or nothing could be learnt. ``accepted`` says that the score reaches the calibrated least
    score. A null doc_id is not held out. Ties go to the language first in code-point order; repeated
    rows each get a row; other columns are not read; an empty table gives no rows.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    F.col("lang").cast("string").alias("lang"))
    model = d.sparkSession.sparkContext.broadcast(train(*training_sample(d, per_lang, total)))

    def run(batches):
        for b in batches:
            got = [model.value.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())],
                [c.split()[0] for c in OUT.split(", ")])

    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, OUT)
