"""Benchmark decontamination: BM25 retrieval of test items with block-max pruning, then overlap.

The test items form an inverted index. Every window of words of every document is a query: a
window meets all items whose BM25 score reaches ``least_score`` of the score that the item gives
itself. For each block of items the index holds the largest impact of each term; their sums over
the distinct terms of each half window bound all windows at once, and only the blocks whose bound
reaches the threshold are scored exactly (block-max WAND, block at a time). What is retrieved is
verified over all the document's words: a document leaks an item if it holds, wherever, nearly all
five-word shingles of its question and of its answer, or of the whole item.

Scale: one pass over the texts without a shuffle. Term statistics are counted by Spark over all
items. An index is broadcast in parts of at most ``PART_ITEMS`` items; a larger benchmark takes
more passes, so what is broadcast stays bounded.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import positions, store

TOKEN = re.compile(rb"[0-9a-z_\x80-\xff]+")
K1, B = 1.2, 0.75
LEAST_SCORE = 0.5
SHINGLE = 5
PERCENT = 80
BLOCK_ITEMS = 4
PART_ITEMS = 256
SLAB_WORDS = 1 << 16


def tokens(text: bytes | None) -> list[bytes]:
    return TOKEN.findall(text.lower()) if text else []


def _binary(column) -> list[bytes | None]:
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def split_item(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words: up to the last question mark, or else the first half."""
    head, mark, tail = (text or b"").rpartition(b"?")
    if mark and tokens(head) and tokens(tail):
        return tokens(head), tokens(tail)
    w = tokens(text)
    return w[:(len(w) + 1) // 2], w[(len(w) + 1) // 2:]


def shingles(words: list[bytes], size: int = SHINGLE) -> set:
    """Distinct runs of ``size`` words; fewer words make one run, none make none."""
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def held(words: list[bytes], wanted: set) -> set:
    """Those of the ``wanted`` runs that occur in ``words``; runs of fewer than ``SHINGLE`` words, too."""
    return {g for n in {len(g) for g in wanted} for g in zip(*(words[k:] for k in range(n))) if g in wanted}


def _item_terms(batches):
    for b in batches:
        rows = []
        for i, t in zip(b.column("item_id").to_pylist(), _binary(b.column("text"))):
            w = tokens(t)
            for term in set(w):
                rows.append((i, term, w.count(term), len(w)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(
            (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["item_id", "term", "tf", "words"])


class Index:
    """An inverted index over a bounded part of the items."""

    def __init__(self, postings, texts: dict, least_score: float, percent: int, longest: int):
        """``longest``: words of the longest item of all parts."""
        self.percent = percent
        self.items = sorted(texts)
        at = {i: k for k, i in enumerate(self.items)}
        self.terms = {t: k for k, t in enumerate(sorted(set(postings["term"])))}
        impact, own = defaultdict(dict), np.zeros(len(self.items))
        for i, t, v in zip(postings["item_id"], postings["term"], postings["impact"]):
            impact[self.terms[t]][at[i]] = v
            own[at[i]] += v
        self.blocks = -(-len(self.items) // BLOCK_ITEMS)
        self.impact = np.zeros((len(self.terms), self.blocks * BLOCK_ITEMS))
        self.postings = [[[] for _ in range(self.blocks)] for _ in self.terms]
        for t, row in impact.items():
            for k, v in row.items():
                v /= least_score * own[k]       # 1 is the threshold
                self.impact[t, k] = v
                self.postings[t][k // BLOCK_ITEMS].append((k, v))
        self.high = self.impact.reshape(len(self.terms), self.blocks, BLOCK_ITEMS).max(axis=2)
        self.least_score = least_score
        self.grams = [(shingles(q), shingles(a), shingles(q + a)) for q, a in (split_item(texts[i]) for i in self.items)]
        self.window = max(16, 2 * longest)

    def retrieve(self, words: list[bytes]):
        """``(item index, score, first word of the window)`` for each window and item above the threshold."""
        get, half = self.terms.get, self.window // 2
        for lo in range(0, max(1, len(words) - half), SLAB_WORDS):
            slab = words[lo:lo + SLAB_WORDS + half]
            ids = np.array([get(w, -1) for w in slab], np.int64)
            known = np.flatnonzero(ids >= 0)
            if not len(known):
                continue
            # the distinct terms of each half window; a term in both halves of a window counts twice in
            # the bound, which may only be too high
            pairs = np.unique(known // half * len(self.terms) + ids[known])
            part, term = pairs // len(self.terms), pairs % len(self.terms)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            starts = np.arange(0, max(1, len(slab) - half), half)
            bound = np.zeros((max(len(starts), int(part[-1])) + 2, self.blocks))
            bound[part[first]] = np.add.reduceat(self.high[term], first, axis=0)
            bound = bound[:len(starts)] + bound[1:len(starts) + 1]
            for w, block in zip(*np.nonzero(bound >= 1 - 1e-9)):
                own = np.unique(term[np.searchsorted(part, w):np.searchsorted(part, w + 2)])
                at = block * BLOCK_ITEMS
                score = self.impact[own, at:at + BLOCK_ITEMS].sum(axis=0)
                for k in np.flatnonzero(score >= 1 - 1e-9):
                    yield int(at + k), float(score[k]) * self.least_score, lo + int(starts[w])

    def leaks(self, words: list[bytes]) -> list[tuple]:
        """``(item_id, score, question share, answer share, first word, words)`` of verified items."""
        best = {}
        for k, score, start in self.retrieve(words):
            best[k] = min(best.get(k, (0.0, 0)), (-score, start))
        own = held(words, {g for k in best for part in self.grams[k] for g in part})
        out = []
        for k, (score, start) in sorted(best.items()):
            q, a, both = ((100 * len(g & own) / len(g) if g else 100.0) for g in self.grams[k])
            if both >= self.percent or q >= self.percent and a >= self.percent:
                out.append((self.items[k], min(1.0, -score), q / 100, a / 100, start, self.window))
        return out


def indexes(benchmark: DataFrame, least_score: float = LEAST_SCORE, percent: int = PERCENT) -> list[Index]:
    """Indexes over all items that have words, in parts of at most ``PART_ITEMS`` items.

    Items without words, or with a null id, are left out; of rows with one id the texts are joined.
    """
    items = benchmark.where("item_id is not null and text is not null").groupBy(
        F.col("item_id").cast("bigint").alias("item_id")).agg(
        F.array_join(F.sort_array(F.collect_set(F.col("text").cast("string"))), "\n").alias("text"))
    items = positions(items, ["item_id"])
    terms = store(items.select("item_id", "text").mapInArrow(
        _item_terms, "item_id bigint, term binary, tf bigint, words bigint"), "terms")
    n, mean, longest = terms.groupBy("item_id").agg(F.max("words").alias("w")).agg(
        F.count(F.lit(1)), F.avg("w"), F.max("w")).first()
    if not n:
        return []
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / F.lit(mean)))
    parts = items.select("item_id", "text", F.expr(f"pos div {PART_ITEMS}").alias("part"))
    postings = terms.join(df, "term").join(parts.select("item_id", "part"), "item_id").select(
        "part", "item_id", "term", (idf * tf).alias("impact"))
    out = []
    for k in range(-(-items.count() // PART_ITEMS)):
        p = postings.where(F.col("part") == k).toPandas()
        if len(p):
            own = set(p["item_id"])
            texts = {r.item_id: r.text.encode() for r in parts.where(F.col("part") == k).collect() if r.item_id in own}
            out.append(Index(p, texts, least_score, percent, longest))
    return out


LEAK = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, first_word bigint, n_words bigint"


def leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE, percent: int = PERCENT) -> DataFrame:
    """Each leak: the document, the item, and the window with the best score (``LEAK``).

    ``score`` is the share of the item's own score, the overlaps are the shares of its five-word
    shingles that the whole document holds. A null or empty text leaks nothing; repeated rows are listed each; an empty
    benchmark or table gives no rows. Only ``doc_id`` and ``text`` are read. Ties of the score go
    to the earlier window.
    """
    d = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = d.sparkSession.createDataFrame([], LEAK)
    for index in indexes(benchmark, least_score, percent):
        shared = d.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                rows = [(i, *leak) for i, t in zip(b.column("doc_id").to_pylist(), _binary(b.column("text")))
                        for leak in shared.value.leaks(tokens(t))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                    [c.split()[0] for c in LEAK.split(", ")])

        out = out.unionAll(d.mapInArrow(run, LEAK))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE,
                  percent: int = PERCENT) -> DataFrame:
    """The rows and columns of ``docs`` that leak no item. Rows are judged one by one, in place."""
    for index in indexes(benchmark, least_score, percent):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                ok = [not shared.value.leaks(tokens(t)) for t in _binary(b.column("text"))]
                yield b.filter(pa.array(ok, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
