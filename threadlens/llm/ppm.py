"""Language-model scoring by prediction by partial matching (PPM) over bytes.

Counts of what follows each byte context of up to ``ORDER`` bytes form a trie. A symbol is coded
in the longest known context; one that has not been seen there costs an escape (method C: the
number of distinct symbols over that number plus the count) and is looked for in the next shorter
context, where the symbols already refused are excluded. The model is pretrained: the trie is
counted over all training documents, and the code lengths of a text's bytes and of its end add up
to its log probability. A unigram word model over the same documents is the base to compare with.

Scale: every context is kept and every count is exact over all training documents. Documents are
split into chunks by hash; each chunk sends its sorted distinct word hashes and byte grams to
buckets, packed, and gets the words' corpus counts and the grams' log probabilities back, so no
word or gram, however frequent, meets in one task. A gram is its context from the nearest byte
outwards and then its symbol, so a context of the trie is a run of the sorted grams, and a bucket,
a range of them, holds all that its grams need, except the contexts that a bucket's edge cuts: at
most ``ORDER + 1`` an edge, counted beforehand in one pass and broadcast. The edges are quantiles
of a sample and change no result. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import WordHashes, ascii_words, store

ORDER = 5
START, END = 0xFE, 0xFF        # neither occurs in UTF-8
SYMBOLS = 256
CHUNK_BYTES = 10_000_000
BUCKET_BYTES = 32_000_000
LEAST_PARTS = 64
SAMPLE_BYTES = 4_000_000
SAMPLE_TEXT = 20_000
SLAB = 1 << 20


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def framed(text: bytes | None) -> bytes:
    """The lower-cased text between its start and end marks."""
    return bytes([START]) * ORDER + (text or b"").lower() + bytes([END])


def byte_grams(framed_texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte (and end) after the ``ORDER`` bytes before it, the nearest first, as one integer;
    and the place of its text."""
    a = np.frombuffer(b"".join(framed_texts), np.uint8)
    if len(a) <= ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.zeros(len(a) - ORDER, np.uint64)
    for k in [*range(ORDER - 1, -1, -1), ORDER]:
        keys = (keys << np.uint64(8)) | a[k:len(a) - ORDER + k]
    coded = a[ORDER:] != START
    return keys[coded], np.repeat(np.arange(len(framed_texts)), [len(t) for t in framed_texts])[ORDER:][coded]


def slabs(texts: list[bytes | None]):
    """``(grams, place of each gram's text)``, about ``SLAB`` bytes at a time; a longer text in parts."""
    slab, first, size = [], 0, 0
    for i, t in enumerate(texts):
        f = framed(t)
        if slab and size + len(f) > SLAB:
            grams, at = byte_grams(slab)
            yield grams, at + first
            slab, size = [], 0
        if len(f) > SLAB:
            for k in range(0, len(f) - ORDER, SLAB):
                grams, at = byte_grams([f[k:k + SLAB + ORDER]])
                yield grams, at + i
            continue
        if not slab:
            first = i
        slab.append(f)
        size += len(f)
    if slab:
        grams, at = byte_grams(slab)
        yield grams, at + first


def _cuts(every: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(every, edges), [len(every)]])


def _chunk_words(texts: list[bytes | None]):
    """Word hashes of each text and the chunk's sorted distinct ones."""
    hashes = WordHashes()
    own = [hashes(ascii_words(t)) for t in texts]
    return own, np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))


SENT = "kind int, bucket int, chunk int, keys binary, counts binary"


def _count_sender(buckets: int, edges: np.ndarray):
    word_edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)

    def run(key, table):
        texts, train = table.column("text").to_pylist(), table.column("train").to_pylist()
        own, words = _chunk_words(texts)
        seen = np.concatenate([np.zeros(0, np.uint64), *[h for h, t in zip(own, train) if t]])
        at = np.searchsorted(words, seen)
        grams = [np.unique(g, return_counts=True) for g, _ in slabs([t for t, ok in zip(texts, train) if ok])]
        asked = [np.unique(g) for g, _ in slabs([t for t, ok in zip(texts, train) if not ok])]
        grams += [(g, np.zeros(len(g), np.int64)) for g in asked]       # to be scored, not counted
        keys, where = np.unique(np.concatenate([np.zeros(0, np.uint64), *[g for g, _ in grams]]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([[], *[c for _, c in grams]]), minlength=len(keys))
        rows = []
        for kind, every, counts, ends in ((0, words, np.bincount(at, minlength=len(words)), word_edges),
                                          (1, keys, n, edges)):
            cuts = _cuts(every, ends)
            for k in range(len(cuts) - 1):
                i, j = cuts[k], cuts[k + 1]
                if j > i:
                    # sorted keys travel as differences, which compress
                    rows.append((kind, k, key[0].as_py(), np.diff(every[i:j], prepend=np.uint64(0)).astype("<u8").tobytes(),
                                 counts[i:j].astype("<u4").tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                        names=[c.split()[0] for c in SENT.split(", ")])
    return run


class Shared:
    """Symbol counts of the contexts that the ``edges`` between the buckets cut."""

    def __init__(self, edges: np.ndarray):
        self.contexts = [np.unique(edges >> np.uint64(8 * (ORDER + 1 - o))) for o in range(ORDER + 1)]
        self.first = np.concatenate([[0], np.cumsum([len(c) for c in self.contexts])])
        self.counts = np.zeros((self.first[-1], SYMBOLS), np.int64)

    def add(self, grams: np.ndarray) -> None:
        """Count sorted ``grams``."""
        symbols = (grams & np.uint64(0xFF)).astype(np.int64)
        for o, own in enumerate(self.contexts):
            shift = np.uint64(8 * (ORDER + 1 - o))
            lo, hi = np.searchsorted(grams, own << shift), np.searchsorted(grams, (own + np.uint64(1)) << shift)
            for k in np.flatnonzero(hi > lo):
                self.counts[self.first[o] + k] += np.bincount(symbols[lo[k]:hi[k]], minlength=SYMBOLS)

    def of(self, order: int, context: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.contexts[order], np.uint64(context)))
        if k < len(self.contexts[order]) and self.contexts[order][k] == context:
            return self.counts[self.first[order] + k]
        return None


def _shared_counter(edges: np.ndarray):
    def run(batches):
        shared = Shared(edges)
        for b in batches:
            for grams, _ in slabs(b.column("text").to_pylist()):
                shared.add(np.sort(grams))
        node, symbol = np.nonzero(shared.counts)
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), pa.array(symbol, pa.int32()),
                                          pa.array(shared.counts[node, symbol], pa.int64())], ["node", "symbol", "n"])
    return run


def chances(grams: np.ndarray, counts: np.ndarray, shared: Shared) -> np.ndarray:
    """Log10 probability of the symbol of each of the sorted distinct ``grams`` of a bucket.

    ``counts`` are corpus counts, 0 for grams that are only asked for. What a context has seen its
    shorter contexts have seen too, so what is excluded in one is what the next longer one has seen.
    """
    m, symbols = len(grams), grams & np.uint64(0xFF)
    out, mass, todo = np.zeros(m), np.zeros(m), np.ones(m, bool)
    below = None                                # the contexts that are one byte longer
    for o in range(ORDER, -1, -1):
        own = grams >> np.uint64(8 * (ORDER + 1 - o))
        cut = [(c, n) for c in sorted({int(own[0]), int(own[-1])}) if (n := shared.of(o, c)) is not None]
        more = [np.flatnonzero(n).astype(np.uint64) | np.uint64(c << 8) for c, n in cut]
        pairs, at = np.unique(np.concatenate([(own << np.uint64(8)) | symbols, *more]), return_inverse=True)
        at = at[:m]
        seen = np.bincount(at, weights=counts, minlength=len(pairs))
        for c, n in cut:
            i, j = np.searchsorted(pairs, np.array([c << 8, (c + 1) << 8], np.uint64))
            seen[i:j] = n[(pairs[i:j] & np.uint64(0xFF)).astype(np.int64)]
        new = np.diff(pairs >> np.uint64(8), prepend=~np.uint64(0)) != 0
        heads, node = np.flatnonzero(new), np.cumsum(new) - 1
        total, kinds = np.add.reduceat(seen, heads), np.add.reduceat((seen > 0).astype(np.float64), heads)
        if below is None:
            n, left, every, which = total, kinds, kinds, node[at]
        else:
            pairs_b, seen_b, heads_b, kinds_b, which = below
            up = np.searchsorted(pairs, (pairs_b >> np.uint64(16) << np.uint64(8)) | (pairs_b & np.uint64(0xFF)))
            of = node[up[heads_b]]
            n = total[of] - np.add.reduceat(np.where(seen_b > 0, seen[up], 0.0), heads_b)
            left, every = kinds[of] - kinds_b, kinds[of]
        escapes = np.where(every < SYMBOLS, left, 0)        # nothing is left to escape to: no escape
        whole = np.maximum(n + escapes, 1)
        hit = todo & (seen[at] > 0)
        out[hit] = mass[hit] + np.log10(seen[at[hit]]) - np.log10(whole[which[hit]])
        todo &= ~hit
        mass += np.where((n > 0) & (escapes > 0), np.log10(np.maximum(escapes, 1) / whole), 0.0)[which]
        below = pairs, seen, heads, kinds, node[at]
    return np.where(todo, mass - np.log10(max(SYMBOLS - kinds[0], 1)), out)


ADDED = "kind int, chunk int, bucket int, totals binary, distinct_words bigint, all_words bigint"


def _adder(shared):
    """Of a range, back to each chunk in its order: words' corpus counts (kind 0), and once the
    range's sums (kind 1); byte grams' log probabilities (kind 2)."""
    def run(key, table):
        rows = [np.cumsum(np.frombuffer(x, "<u8"), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()])
        every, at = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.bincount(at, weights=counts)
        ends, chunk = np.cumsum([len(r) for r in rows])[:-1], table.column("chunk").to_pylist()
        if key[0].as_py():
            logs = chances(every, total, shared.value).astype("<f4")[at]
            out = {"kind": [2] * len(rows), "chunk": chunk, "totals": [x.tobytes() for x in np.split(logs, ends)]}
        else:
            total = total.astype("<u8")
            out = {"kind": [0] * len(rows) + [1], "chunk": [*chunk, None],
                   "totals": [*[x.tobytes() for x in np.split(total[at], ends)], None],
                   "distinct_words": [None] * len(rows) + [int((total > 0).sum())],
                   "all_words": [None] * len(rows) + [int(total.sum())]}
        k = len(out["kind"])
        out["bucket"] = [key[1].as_py()] * k
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in ADDED.split(", ")]
        return pa.table([pa.array(out[c], t) if c in out else pa.nulls(k, t) for c, t in zip(names, kinds)], names=names)
    return run


class Trie:
    """A small trie with the log10 probability of every symbol in every context, as one dense table.

    What ``chances`` is compared with; no corpus is scored by it.
    """

    def __init__(self, contexts: list[tuple[int, int, list[int], list[int]]]):
        """``contexts``: ``(order, context, symbols, counts)``; a context comes with its suffixes."""
        rows = sorted(contexts, key=lambda r: (r[0], r[1]))
        if not rows or rows[0][0]:
            rows = [(0, 0, [], []), *rows]
        self.orders = np.array([r[0] for r in rows], np.uint8)
        self.contexts = np.array([r[1] for r in rows], np.uint64)
        self.sizes = np.array([len(r[2]) for r in rows], np.uint16)
        self.symbols = np.array([x for r in rows for x in r[2]], np.uint8)
        self.counts = np.array([x for r in rows for x in r[3]], np.int64)
        at = {(r[0], r[1]): i for i, r in enumerate(rows)}
        self.parent = np.array([at[o - 1, c & ((1 << 8 * (o - 1)) - 1)] if o else -1 for o, c, _, _ in rows], np.int32)
        self.log = None

    def build(self) -> None:
        """Make the table from the counts."""
        n = len(self.orders)
        counts = np.zeros((n, SYMBOLS), np.float32)
        counts[np.repeat(np.arange(n), self.sizes), self.symbols] = self.counts
        self.log = np.empty((n, SYMBOLS), np.float32)
        for lo in range(0, n, 2048):
            hi = min(lo + 2048, n)
            self.log[lo:hi] = np.log10(self._chances(counts, self.parent, np.arange(lo, hi)))

    @staticmethod
    def _chances(counts, parent, ids):
        """Escape, exclude and descend, for many contexts at once."""
        p, mass = np.zeros((len(ids), SYMBOLS)), np.ones((len(ids), 1))
        out, level = np.zeros((len(ids), SYMBOLS), bool), ids.copy()
        while (level >= 0).any():
            c = np.where(out | (level < 0)[:, None], 0.0, counts[np.maximum(level, 0)].astype(np.float64))
            n, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
            left = SYMBOLS - out.sum(axis=1, keepdims=True) - kinds
            escapes = np.where(left > 0, kinds, 0)  # nothing is left to escape to: no escape
            total = np.maximum(n + escapes, 1)
            p += mass * c / total
            mass = np.where(n > 0, mass * escapes / total, mass)
            out |= c > 0
            level = np.where(level >= 0, parent[np.maximum(level, 0)], -1)
        rest = SYMBOLS - out.sum(axis=1, keepdims=True)
        return p + np.where(out, 0.0, mass / np.maximum(rest, 1))


def _scores(texts: list[bytes | None], logs: np.ndarray) -> np.ndarray:
    """Log10 probability of each whole text and its end; ``logs`` of the sorted distinct grams of all."""
    own = []
    for grams, at in slabs(texts):
        keys, where = np.unique(grams, return_inverse=True)
        own.append((keys, where.astype(np.int32), at.astype(np.int32)))
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for k, _, _ in own]]))
    out = np.zeros(len(texts))
    for keys, where, at in own:
        first = int(at[0]) if len(at) else 0
        part = np.bincount(at - first, weights=logs[np.searchsorted(every, keys)][where])
        out[first:first + len(part)] += part
    return out


def gram_edges(d: DataFrame, size: int, buckets: int) -> np.ndarray:
    """Quantiles of the distinct grams of a sample, between the buckets."""
    some = d.sample(False, min(1.0, SAMPLE_BYTES / max(size, 1)), 7).select(F.expr(f"substring(text, 1, {SAMPLE_TEXT})").alias("text"))
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *[g for g, _ in slabs(
        some.toArrow().column("text").to_pylist())]]))
    return np.unique(grams[np.arange(1, buckets) * len(grams) // buckets]) if len(grams) else grams


def shared_counts(train: DataFrame, edges: np.ndarray) -> Shared:
    shared = Shared(edges)
    n = train.select("text").mapInArrow(_shared_counter(edges), "node int, symbol int, n bigint").groupBy(
        "node", "symbol").agg(F.sum("n").alias("n")).toArrow()
    shared.counts[n.column("node").to_numpy(), n.column("symbol").to_numpy()] = n.column("n").to_numpy()
    return shared


OUT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
       "base_score double, score double")


def ppm_scores(docs: DataFrame) -> DataFrame:
    """One row (``OUT``) per row of ``docs(doc_id, text)``.

    A null text is empty: it has its end alone. A null doc_id is not held out. Repeated rows count
    and are scored each. Without a training document nothing is known and every symbol is as likely.
    Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("binary").alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(LEAST_PARTS, size // CHUNK_BYTES), max(LEAST_PARTS, size // BUCKET_BYTES)
    d = d.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"),
                 F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    edges = gram_edges(d, size, buckets)
    shared = d.sparkSession.sparkContext.broadcast(shared_counts(d.where("train"), edges))
    added = store(d.groupBy("chunk").applyInArrow(_count_sender(buckets, edges), SENT)
                   .groupBy("kind", "bucket").applyInArrow(_adder(shared), ADDED), "counts")
    back = added.where("kind in (0, 2)").select("chunk", "kind", "bucket", "totals")
    distinct, every = added.where("kind = 1").agg(F.sum("distinct_words"), F.sum("all_words")).first()
    ends = d.where("train").count()
    distinct, every = (distinct or 0) + (ends > 0), (every or 0) + ends

    def run(key, left, right):
        texts = left.column("text").to_pylist()
        own, known = _chunk_words(texts)
        parts = sorted(zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(),
                           right.column("totals").to_pylist()))
        totals = np.frombuffer(b"".join(t for k, _, t in parts if k == 0), "<u8").astype(np.float64)
        logs = np.frombuffer(b"".join(t for k, _, t in parts if k == 2), "<f4").astype(np.float64)
        rest = np.log10(every + 0.5 * (distinct + 1))
        tokens, hits, base = [], [], []
        for h in own:
            c = np.append(totals[np.searchsorted(known, h)], ends)
            tokens.append(len(c))
            hits.append(int((c > 0).sum()))
            base.append(float((np.log10(c + 0.5) - rest).sum()))
        return pa.table([left.column("doc_id"), pa.array([not t for t in left.column("train").to_pylist()]),
                         pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()),
                         pa.array([every] * len(own), pa.int64()), pa.array(base, pa.float64()),
                         pa.array(_scores(texts, logs), pa.float64())],
                        names=[c.split()[0] for c in OUT.split(", ")])

    return d.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, OUT)
