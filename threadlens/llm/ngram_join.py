"""N-gram Jaccard join: all documents whose sets of 4-word shingles are alike.

The method is a prefix-filtered set join. Shingles are put in one global order, rarest first;
two sets with Jaccard similarity t share one of their first ``n - ceil(t * n) + 1`` shingles.
Those prefixes, without the shingles that occur in one text only, are the index. A pair that
meets there passes the length, positional and suffix filters before its whole sets are compared
once.

Scale: equal texts are one *class* and only one text of each is processed (copies are first
dropped inside each task, so a hot text never meets in one place). Shingle counts are exact over
the whole corpus, but travel packed: texts are split into chunks, each chunk sends its sorted
distinct shingles, 4 bytes each, to buckets by hash range, and one byte each comes back. A group
of near copies is not expanded into pairs: first every text is compared with one leader per index
entry and the links are joined to components. Then tasks that each hold a block of an entry's texts
propose, by their sketches, the fewest pairs that would join all the components they see (a spanning
forest, so no more pairs than texts); these are verified and joined. Last, the pairs that are still
*between* components are compared, so no link between different components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import WordHashes, ascii_words, discard, gram_hashes, store
from threadlens.llm.components import components

SHINGLE = 4
PERCENT = 85
CHUNK_WORDS = 1_000_000    # words in a chunk of texts, which one task holds at a time
BUCKET_WORDS = 2_000_000   # shingles in a hash range, which one task holds at a time
LEAST_PARTS = 64
SKETCH_BITS = 9            # the suffix filter's sketches have 2 ** 9 bits
BLOCK = 1000               # texts of an index entry that meet in one task; more make more tasks
TASK_ROWS = 20_000         # index rows in a task that proposes pairs
BEFORE = 16                # earlier index entries by which a pair is known to have met before


def shingle_set(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``size`` make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(gram_hashes(hashes(words), size))


def _binary(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _digests(batches):
    for b in batches:
        digest, n = [], []
        for t in _binary(b.column("text")):
            w = ascii_words(t)
            digest.append(xxhash.xxh3_128_digest(b" ".join(w)) if w else None)
            n.append(len(w))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(n, pa.int64())],
            ["doc_id", "digest", "n_words"])


def membership(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, n_words)``: equal word sequences share a digest; null without words."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _digests, "doc_id bigint, digest binary, n_words bigint")


def _first_texts(chunks: int):
    def run(batches):
        seen = set()
        for b in batches:
            rows = []
            for t in _binary(b.column("text")):
                w = ascii_words(t)
                if w:
                    body = b" ".join(w)
                    d = xxhash.xxh3_128_digest(body)
                    if d not in seen:
                        seen.add(d)
                        rows.append((int.from_bytes(d[:6], "big") % chunks, d, body))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], ["chunk", "digest", "words"])
    return run


def _chunk_sets(table: pa.Table, size: int):
    """Digests (sorted, each once), their shingle sets, and the chunk's distinct shingles."""
    texts = dict(zip(table.column("digest").to_pylist(), table.column("words").to_pylist()))
    hashes, digests = WordHashes(), sorted(texts)
    sets = [shingle_set(texts[d].split(), hashes, size) for d in digests]
    every, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), [])
    return digests, sets, every, counts


def _cuts(every: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(every, edges), [len(every)]])


def _count_sender(size: int, buckets: int):
    def run(key, table):
        _, _, every, counts = _chunk_sets(table, size)
        cuts, rows = _cuts(every, buckets), []
        short = ((every << np.uint64(8)) >> np.uint64(32)).astype("<u4")
        counts = np.minimum(np.asarray(counts), 65535).astype("<u2")
        for k in range(buckets):
            i, j = cuts[k], cuts[k + 1]
            if j > i:
                rows.append((k, key[0].as_py(), short[i:j].tobytes(), counts[i:j].tobytes()))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()),
                         "chunk": pa.array([r[1] for r in rows], pa.int32()),
                         "shingles": pa.array([r[2] for r in rows], pa.binary()),
                         "counts": pa.array([r[3] for r in rows], pa.binary())})
    return run


def _rarity(total: np.ndarray) -> np.ndarray:
    """One byte that grows with the count: exact below 128, then by its logarithm; 0 means once."""
    high = 128 + np.minimum(127, 4 * np.log2(np.maximum(total, 128) / 128.0)).astype(np.int64)
    return np.where(total <= 128, total - 1, high).astype(np.uint8)


def _count_adder(key, table):
    rows = [np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()]
    counts = [np.frombuffer(x, "<u2") for x in table.column("counts").to_pylist()]
    _, at = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    byte, ends = _rarity(total)[at], np.cumsum([len(r) for r in rows])[:-1]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "rarity": pa.array([x.tobytes() for x in np.split(byte, ends)], pa.binary())})


SETS = "digest binary, n bigint, shingles array<bigint>, places array<int>, sketch array<bigint>, members array<bigint>"


def _lists(arrays: list, kind) -> pa.Array:
    """A list column from numpy arrays; an empty one gives null."""
    ends = np.cumsum([0, *(len(a) for a in arrays)])
    values = np.concatenate([a for a in arrays if len(a)] or [np.zeros(0, np.int64)])
    none = pa.array([not len(a) for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values).cast(kind), mask=none)


def _prefixes(size: int, percent: int):
    def run(key, left, right):
        digests, sets, every, _ = _chunk_sets(left, size)
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("rarity").to_pylist()))
        rarity = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
        none, rows = np.zeros(0, np.int64), []
        for s in sets:
            n = len(s)
            r = rarity[np.searchsorted(every, s)]
            prefix = n - -(-percent * n // 100) + 1
            order = np.argsort(r, kind="stable")[:prefix]       # rarest first, ties by hash
            places = np.flatnonzero(r[order])                   # those that occur in one text only find nobody
            if not len(places):
                rows.append((none, none, none, none))
                continue
            cells = np.bincount((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            rows.append((s[order[places]].view(np.int64), places, np.packbits((cells & 1).astype(np.uint8)).view("<i8"),
                         s.view(np.int64)))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays(
            [pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
             *[_lists([r[k] for r in rows], t) for k, t in enumerate(kinds)]],
            names=["digest", "n", "shingles", "places", "sketch", "members"])
    return run


def prefix_index(docs: DataFrame, words: int, size: int, percent: int) -> DataFrame:
    """One row per class (``SETS``): its set size and, if any prefix shingle is shared, the prefix.

    ``words`` (the corpus size) sets the numbers of chunks and buckets, so that each stays small.
    """
    chunks, buckets = max(LEAST_PARTS, words // CHUNK_WORDS), max(LEAST_PARTS, words // BUCKET_WORDS)
    texts = docs.select(F.col("text").cast("string")).mapInArrow(
        _first_texts(chunks), "chunk int, digest binary, words binary")
    counts = texts.groupBy("chunk").applyInArrow(
        _count_sender(size, buckets), "bucket int, chunk int, shingles binary, counts binary")
    rarity = counts.groupBy("bucket").applyInArrow(_count_adder, "chunk int, bucket int, rarity binary")
    return texts.groupBy("chunk").cogroup(rarity.groupBy("chunk")).applyInArrow(_prefixes(size, percent), SETS)


def _need(percent: int, a: str, b: str) -> str:
    """SQL for the least overlap of two linked sets of the given sizes."""
    return f"(({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent})"


def _met(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs x, y that meet at an index entry and pass the length and positional filters."""
    met = pairs.where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)").where(
        f"least(x.place, y.place) + least(x.n - x.place, y.n - y.place) >= {_need(percent, 'x', 'y')}")
    return met.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def _suffix_filter(percent: int) -> str:
    """SQL: the sketches of x and y differ in no more places than linked sets can."""
    apart = " + ".join(f"bit_count(x.sketch[{k}] ^ y.sketch[{k}])" for k in range(1 << SKETCH_BITS - 6))
    return f"{apart} <= x.n + y.n - 2 * {_need(percent, 'x', 'y')}"


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b, linked)`` of distinct pairs: by the sketches where they rule a link out, else the whole sets."""
    s = sets.where("members is not null")
    x = s.select(F.col("cls").alias("a"), "n", "sketch").alias("x")
    y = s.select(F.col("cls").alias("b"), "n", "sketch").alias("y")
    p = pairs.join(x, "a").join(y, "b").where(_suffix_filter(percent)).select(
        "a", "b", (F.col("x.n") + F.col("y.n")).alias("n"))
    p = p.join(s.select(F.col("cls").alias("b"), F.col("members").alias("sb")), "b").join(
        s.select(F.col("cls").alias("a"), F.col("members").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return p.select("a", "b", (100 * both >= percent * (F.col("n") - both)).alias("linked"))


def index_rows(sets: DataFrame, percent: int) -> DataFrame:
    """The inverted index: a row for each class and shared shingle of its prefix, rarest first.

    ``band`` has the class's size on a scale on which sizes that are apart by more than one can't be linked.
    """
    e = sets.where("shingles is not null").select(
        "cls", "n", F.floor(F.log("n") / -F.log(F.lit(percent / 100.0))).cast("int").alias("band"),
        F.posexplode(F.arrays_zip("shingles", "places")).alias("at", "e"))
    return e.select("cls", "n", "band", F.col("e.shingles").alias("shingle"), F.col("e.places").alias("place"), "at")


def _rooted(index: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return index.withColumn("root", F.col("cls"))
    return index.join(roots, index["cls"] == roots["node"], "left").select(
        index["*"], F.coalesce("root", "cls").alias("root"))


def _forest(left: np.ndarray, right: np.ndarray, slack: np.ndarray, roots: np.ndarray) -> list[int]:
    """Edges of a least spanning forest of the ``roots`` of nodes ``left[k]``, ``right[k]`` (no ties in ``slack``)."""
    _, label = np.unique(roots, return_inverse=True)
    chosen = []
    while True:
        a, b = label[left], label[right]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            return chosen
        open_ = open_[np.argsort(slack[open_], kind="stable")]
        ends = np.concatenate([a[open_], b[open_]])
        order = np.argsort(np.tile(np.arange(len(open_)), 2), kind="stable")
        _, first = np.unique(ends[order], return_index=True)       # the least edge at each component
        up = np.arange(label.max() + 1)
        for k in np.unique(open_[order[first] % len(open_)]):
            x, y = label[left[k]], label[right[k]]
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                chosen.append(int(k))
        while (up != up[up]).any():
            up = up[up]
        label = up[label]


def _proposals(percent: int):
    """Pairs of a task's blocks whose sketches allow a link, as a forest over the components."""
    def block(cls, n, root, sketch, side):
        own = np.flatnonzero(side <= 1)
        cross = np.flatnonzero(side == 2)
        lefts, rights, slacks = [], [], []
        for at, i in enumerate(own):
            j = cross if len(cross) else own[at + 1:]
            j = j[root[j] != root[i]]
            size = n[i] + n[j]
            need = (percent * size + 99 + percent) // (100 + percent)
            apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            over = apart - (size - 2 * need)
            ok = (over <= 0) & (need <= np.minimum(n[i], n[j]))
            lefts.append(np.full(int(ok.sum()), i))
            rights.append(j[ok])
            slacks.append(over[ok])
        left, right = np.concatenate(lefts), np.concatenate(rights)
        # ties go by the pair, so that the entries two texts share propose the same pairs
        lo, hi = np.minimum(cls[left], cls[right]), np.maximum(cls[left], cls[right])
        order = np.lexsort([hi, lo, np.concatenate(slacks)])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return [(int(lo[k]), int(hi[k])) for k in _forest(left, right, rank, root)]

    def run(key, table):
        shingle, i, j, side = (table.column(c).to_numpy() for c in ("shingle", "i", "j", "side"))
        cls, n, root = (table.column(c).to_numpy() for c in ("cls", "n", "root"))
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cls), -1)
        order = np.lexsort([j, i, shingle])
        new = (np.diff(shingle[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
        pairs = set()
        for k in np.split(order, np.flatnonzero(new) + 1):
            pairs.update(block(cls[k], n[k], root[k], sketch[k], side[k]))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})
    return run


def proposed(mixed: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Distinct pairs ``a, b`` that would join the components met at each index entry.

    An entry with more than ``block`` texts is cut into blocks, and each two blocks meet in one
    group; a task takes whole groups, about ``TASK_ROWS`` rows of them.
    """
    rows = mixed.agg(F.sum(F.ceil(F.col("k") / block))).first()[0] or 0
    tasks, blocks = max(LEAST_PARTS, int(rows) // TASK_ROWS), F.ceil(F.col("k") / block).cast("int")
    x = mixed.withColumn("own", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    x = x.select("cls", "n", "root", "sketch", "shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                 F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    x = x.withColumn("task", F.pmod(F.xxhash64("shingle", "i", "j"), F.lit(tasks)))
    return x.groupBy("task").applyInArrow(_proposals(percent), "a bigint, b bigint").distinct()


def _mixed(index: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The index rows, with sketches, of the ``k`` texts at each entry that more than one component has."""
    x = _rooted(index, roots)
    mixed = x.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi")
    x = x.join(mixed.select("shingle", "k"), "shingle")
    # their class's first entries before them come along: a pair is made only where it meets first
    before = F.slice("shingles", F.lit(1), F.least(F.col("at"), F.lit(BEFORE))).alias("before")
    return store(x.join(sets.select("cls", "shingles", "sketch"), "cls").select(
        "cls", "n", "shingle", "place", "root", "k", "sketch", before), "mixed")


def roots_of(sets: DataFrame, percent: int) -> DataFrame | None:
    """``(node, root)`` of the components of all verified links, for classes that have one.

    Pairs inside a component found already are not compared; every other pair that the filters
    let through is, once.
    """
    index, done = store(index_rows(sets, percent), "index"), []
    x = index.withColumn("root", F.col("cls"))
    leaders = x.groupBy("shingle", "band").agg(
        F.min(F.struct(F.xxhash64("cls").alias("h"), "cls", "n", "place", "root")).alias("y"),
        F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle", "band", "y")
    met = x.alias("x").join(leaders, ["shingle", "band"]).where("x.root <> y.root")
    roots = _compare(_met(met, percent), sets, percent, done, None)
    x = _mixed(index, sets, roots)
    roots = _compare(proposed(x, percent), sets, percent, done, roots)
    discard(x)
    x = _mixed(index, sets, roots)
    # the texts of a large entry are dealt to parts, each of which meets all of them
    parts = F.ceil(F.col("k") / BLOCK).cast("int")
    y = x.withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    x_all = x.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = x_all.alias("x").join(y.alias("y"), ["shingle", "part"]).where(
        "x.cls < y.cls and x.root <> y.root and not arrays_overlap(x.before, y.before)").where(_suffix_filter(percent))
    roots = _compare(_met(met, percent), sets, percent, done, roots)
    discard(index, x, *done)
    return roots


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, done: list, roots: DataFrame | None) -> DataFrame:
    """Verify the pairs that are not in ``done``, which gets them; the roots with their links."""
    for old in done:
        pairs = pairs.join(old, ["a", "b"], "left_anti")
    new = store(verified(pairs, sets, percent), "links")
    done.append(new)
    edges = new.where("linked").select("a", "b")
    if roots is None:
        return components(edges)
    if edges.isEmpty():
        return roots
    # links between components become links between their roots, which are few
    for end in ("a", "b"):
        edges = edges.join(roots.select(F.col("node").alias(end), F.col("root").alias("_r")), end, "left").withColumn(
            end, F.coalesce("_r", end)).drop("_r")
    found = components(edges).select(F.col("node").alias("k"), F.col("root").alias("r"))
    more = roots.join(found, roots["root"] == found["k"], "left").select("node", F.coalesce("r", "root").alias("root"))
    alone = found.join(roots, found["k"] == roots["node"], "left_anti").select(F.col("k").alias("node"), F.col("r").alias("root"))
    out = store(more.unionAll(alone), "roots")
    discard(roots)
    return out


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever their names.
    ``class_id`` is the smallest doc_id with the same word sequence, ``component_id`` the smallest
    doc_id reachable over links. A null, empty or blank text has 0 shingles, no link, and itself
    as component. Repeated rows each get a row. Rows whose doc_id is null take part but name no
    component. An empty table gives an empty result.
    """
    members = store(membership(docs), "members")
    words = members.agg(F.sum("n_words")).first()[0] or 0
    sets = store(prefix_index(docs, words, size, percent).withColumn("cls", F.monotonically_increasing_id()), "sets")
    roots = roots_of(sets, percent)
    classes = members.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(sets.select("digest", "n", "cls"), "digest").join(
        roots, F.col("cls") == F.col("node"), "left").select(
        "digest", "n", "class_id", F.coalesce("root", "cls").alias("root"))
    classes = store(classes, "classes")
    discard(sets, roots)
    least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(least, "root").select("digest", "n", "class_id", "component_id")
    full = members.where("digest is not null").join(classes, "digest").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    blank = members.where("digest is null").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.col("doc_id").alias("class_id"))
    return full.unionAll(blank)


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The columns and rows of ``docs``, with one document (the smallest doc_id) of each component.

    Documents without words, and rows without a doc_id, are all kept.
    """
    comp = jaccard_components(docs, size, percent)
    gone = comp.where("n_shingles > 0").groupBy("doc_id").agg(
        F.max(F.col("doc_id") != F.col("component_id")).alias("_gone"), F.count(F.lit(1)).alias("_copies"))
    gone = gone.where("_gone or _copies > 1").where("doc_id is not null").select(
        F.col("doc_id").alias("_id"), "_gone")
    j = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_id"], "left")
    once = j.where("_gone is null").select(docs["*"])
    return once.unionByName(j.where("not _gone").select(docs["*"]).dropDuplicates(["doc_id"]))
