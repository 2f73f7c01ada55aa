"""Conversation structure repair: the cheapest edits that give a well-formed sequence of roles.

A conversation's rows are damaged, checked, and then kept, given another role, deleted, or joined by
inserted turns, so that the role initials read ``(s?(ua)+)?`` at the least cost; of edits that cost the
same, those whose initials are least in ASCII order.

Method: rank-convergence parallel Viterbi. The costs to the end, one for each of four automaton states,
are computed backwards. A conversation is cut into chunks; all chunks run at once, each from a
speculative cost vector at its right end. In a fix-up pass a chunk takes the vector that the chunk after
it has found, and runs again only until its vector differs from its former one by a constant: from there
on all choices are as they were. Passes go on until no vector changes but by a constant. The vectors, with
the chunks' constants, are then the costs of the whole conversation, and a forward trace takes in each
state the least initial among the edits that lie on a cheapest path.

Scale: rows are range-partitioned by conversation and turn, so a hot conversation spans many tasks; the
row number given there cuts chunks of a bounded number of rows, held as one letter a row. Repeated rows
are found by grouped minima of digests. Only multi-chunk conversations enter the passes, as narrow chunk
rows. The trace writes SHA-256 over a conversation's repaired text, which can't be split; it runs as a
stream over sorted rows and holds one chunk's letters and the audit, never the conversation's texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import shuffle_partitions, store

CHUNK_BITS = 14              # a chunk has at most 2 ** 14 rows
SPACE = " \t\n\x0b\f\r"
ENDINGS = ".!?"

# Fixed values of the contract: costs, and the automaton of (s?(ua)+)?
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, ASKED, PAIRED = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): PAIRED, (PAIRED, "u"): ASKED}
WANTED = {START: "u", SYSTEM: "u", ASKED: "a", PAIRED: "u"}      # the one user or assistant role that fits
ROLES = {"u": "user", "a": "assistant"}
GOAL = (0, 2 * INSERT, INSERT, 0)                                # costs after the last row


# ---- damage and faults, in SQL functions

def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` after damage; null roles and texts are one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    d = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                             F.coalesce(F.col("role").cast("string"), space).alias("role"),
                             F.coalesce(F.col("text").cast("string"), space).alias("text"),
                             (F.crc32(key.cast("binary")) % 20).alias("code")).where("code <> 0")
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select(
        "conv", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), copies.alias("copy")).drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with ``seq``, which grows along conversation and turn, stored.

    Nulls come first; rows that share a turn come by the MD5 of ``role:text``, which also splits a
    conversation whose turns are all alike. Equal rows are interchangeable.
    """
    d = rows.withColumn("digest", F.md5(F.concat("role", F.lit(":"), "text").cast("binary")))
    d = d.withColumn("mid", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("mid")]
    d = d.repartitionByRange(shuffle_partitions(d.sparkSession), *order).sortWithinPartitions(*order).drop("mid")
    return store(d.withColumn("seq", F.monotonically_increasing_id()), "turns")


def _letter() -> Column:
    """A row as one letter: b(lank), else its role's initial (o: other), in capitals if truncated."""
    body = F.rtrim("text", F.lit(SPACE))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("o"))
    return F.when(body == "", F.lit("b")).when(
        F.right(body, F.lit(1)).isin(*ENDINGS), initial).otherwise(F.upper(initial))


def letters(rows: DataFrame) -> DataFrame:
    """``conv, seq, letter``; a row that repeats an earlier one's role and text is ``d``, unless blank."""
    r = rows.select("conv", "seq", "digest", _letter().alias("letter"))
    first = r.where("letter <> 'b'").groupBy("conv", "digest").agg(
        F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("conv").alias("_conv"), F.col("digest").alias("_digest"), "first")
    j = r.join(first, r["conv"].eqNullSafe(first["_conv"]) & (r["digest"] == first["_digest"]), "left")
    repeated = (F.col("letter") != "b") & (F.col("seq") > F.col("first"))
    return j.select("conv", "seq", F.when(repeated, F.lit("d")).otherwise(F.col("letter")).alias("letter"))


def chunks_of(marked: DataFrame, chunk_bits: int) -> DataFrame:
    """``conv, chunk, seq, letters, after``: a chunk's letters in order, and the number of the next one."""
    c = marked.groupBy("conv", F.shiftright("seq", chunk_bits).alias("chunk")).agg(
        F.min("seq").alias("seq"),
        F.array_sort(F.collect_list(F.struct("seq", "letter"))).alias("rows"))      # at most 2 ** chunk_bits
    c = c.select("conv", "chunk", "seq", F.array_join(F.transform("rows", lambda x: x["letter"]), "").alias("letters"))
    # one narrow row a chunk: the window holds numbers only
    n = c.select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"))
    n = n.withColumn("after", F.lead("_chunk").over(Window.partitionBy("_conv").orderBy("_chunk")))
    return c.join(n.where("after is not null"), c["conv"].eqNullSafe(F.col("_conv")) & (c["chunk"] == F.col("_chunk")),
                  "left").select("conv", "chunk", "seq", "letters", "after")


# ---- the automaton

@lru_cache(maxsize=1 << 16)
def edits(letter: str, state: int) -> tuple:
    """``(initial, cost, state after)`` of the edits of a row, without inserts."""
    if letter in "bd":
        return (("D", DELETE, state),)
    more, role = CUT_OFF * letter.isupper(), letter.lower()
    out = [("D", DELETE, state)]
    if (state, role) in NEXT:
        out.append(("K", more, NEXT[state, role]))
    out.append(("R", REROLE + more, NEXT[state, WANTED[state]]))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def before_row(letter: str, after: tuple) -> tuple[tuple, int]:
    """Costs to the end before a row from those after it, less their least, and that least cost."""
    own = [min(cost + after[to] for _, cost, to in edits(letter, s)) for s in range(4)]
    costs = tuple(min(own[s], INSERT + own[NEXT[s, WANTED[s]]], 2 * INSERT + own[_after_two(s)]) for s in range(4))
    low = min(costs)
    return tuple(c - low for c in costs), low


def _after_two(state: int) -> int:
    one = NEXT[state, WANTED[state]]
    return NEXT[one, WANTED[one]]


def backwards(text: str, end: tuple) -> tuple[list[tuple], int]:
    """The cost vectors before each row and at the end (each less its least), and what was taken off."""
    out, off = [end], 0
    for letter in reversed(text):
        vector, low = before_row(letter, out[-1])
        out.append(vector)
        off += low
    out.reverse()
    return out, off


def fix_up(text: str, old_end: tuple, new_end: tuple, start: tuple, off: int) -> tuple[tuple, int, int]:
    """The first vector and constant for a new end, run until it is parallel to the former run.

    Returns the vector, the constant and the number of rows that were run again.
    """
    a, b, oa, ob = old_end, new_end, 0, 0
    for k, letter in enumerate(reversed(text)):
        if a == b:
            return start, off + ob - oa, k
        (a, x), (b, y) = before_row(letter, a), before_row(letter, b)
        oa, ob = oa + x, ob + y
    return b, off + ob - oa, len(text)


@lru_cache(maxsize=1 << 16)
def step(letter: str, here: tuple, after: tuple, low: int, state: int) -> tuple[str, int]:
    """The least initials on a cheapest path from ``state`` through a row (inserts before it and its own
    edit), and the state after it. ``here`` and ``after`` are the vectors around it, ``low`` the constant."""
    audit = ""
    while True:
        left = here[state] + low
        options = [(name, to) for name, cost, to in edits(letter, state) if cost + after[to] == left]
        to = NEXT[state, WANTED[state]]
        if INSERT + here[to] + low == left:
            options.append(("I", to))
        name, state = min(options)
        audit += name
        if name != "I":
            return audit, state


def ending(state: int) -> str:
    """Inserts after the last row."""
    return "I" * (GOAL[state] // INSERT)


# ---- passes over chunks

VECTOR = "array<int>"
PASS = "conv bigint, chunk bigint, after bigint, seq bigint, letters string, end array<int>, start array<int>, off bigint"


def _speculate(batches):
    for b in batches:
        ends, starts, offs = [], [], []
        for text in b.column("letters").to_pylist():
            vectors, off = backwards(text, GOAL)
            ends.append(GOAL)
            starts.append(vectors[0])
            offs.append(off)
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("conv", "chunk", "after", "seq", "letters")], pa.array(ends, pa.list_(pa.int32())),
             pa.array(starts, pa.list_(pa.int32())), pa.array(offs, pa.int64())],
            ["conv", "chunk", "after", "seq", "letters", "end", "start", "off"])


def _rerun(batches):
    for b in batches:
        starts, offs, ends = [], [], []
        cols = [b.column(c).to_pylist() for c in ("letters", "end", "given", "start", "off")]
        for text, end, given, start, off in zip(*cols):
            s, o, _ = fix_up(text, tuple(end), tuple(given), tuple(start), off)
            starts.append(s)
            offs.append(o)
            ends.append(given)
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in ("conv", "chunk", "after", "seq", "letters")], pa.array(ends, pa.list_(pa.int32())),
             pa.array(starts, pa.list_(pa.int32())), pa.array(offs, pa.int64())],
            ["conv", "chunk", "after", "seq", "letters", "end", "start", "off"])


def solve(chunks: DataFrame) -> DataFrame:
    """The chunks with the true vector at their ``end``, up to a constant; each pass is stored."""
    t = store(chunks.mapInArrow(_speculate, PASS), "speculated")
    single = t.where("after is null")              # its end is the conversation's: right from the start
    t = t.where("after is not null")
    while True:
        found = t.unionByName(single).select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"),
                                             F.col("start").alias("given"))
        j = t.join(found, t["conv"].eqNullSafe(F.col("_conv")) & (t["after"] == F.col("_chunk"))).drop("_conv", "_chunk")
        wrong = F.col("given") != F.col("end")
        if j.where(wrong).isEmpty():
            return t.unionByName(single)
        t = store(j.where(wrong).mapInArrow(_rerun, PASS).unionByName(j.where(~wrong).drop("given")), "fixed")


# ---- the trace

REPAIRED = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
            "cost bigint, audit string, repaired_sha256 string, rows bigint, chunks bigint")
LEGAL = {"su", "ua", "au"}


class Trace:
    """One conversation's results, fed its chunks and rows in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit, self.sha, self.lines = conv, START, 0, [], hashlib.sha256(), 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "rows", "chunks"), 0)
        self.low = self.high = self.turn = self.initial = None
        self.turns = 0

    def chunk(self, text: str, end: list[int], start: list[int], off: int):
        if not self.counts["chunks"]:
            self.cost += start[START]
        self.cost += off
        self.counts["chunks"] += 1
        self.counts["blank"] += text.count("b")
        self.counts["duplicate"] += text.count("d")
        self.counts["truncated"] += sum(text.count(x) for x in "SUAO")
        vectors, _ = backwards(text, tuple(end))
        self.ahead = zip(text, vectors, vectors[1:])

    def line(self, role: str, text: str):
        self.sha.update(("\n" * (self.lines > 0) + role + ":" + text).encode())
        self.lines += 1

    def insert(self):
        role = WANTED[self.state]
        self.line(ROLES[role], "")
        self.state = NEXT[self.state, role]

    def row(self, turn, role: str, text: str):
        letter, here, after = next(self.ahead)
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if self.counts["rows"] and self.initial + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = role[:1]
        self.counts["rows"] += 1
        audit, _ = step(letter, here, after, before_row(letter, after)[1], self.state)
        for name in audit:
            if name == "I":
                self.insert()
        if audit[-1] == "K":
            self.line(role, text)
            self.state = NEXT[self.state, letter.lower()]
        elif audit[-1] == "R":
            role = WANTED[self.state]
            self.line(ROLES[role], text)
            self.state = NEXT[self.state, role]
        self.audit.append(audit)

    def result(self) -> tuple:
        if self.counts["rows"]:
            for name in ending(self.state):
                self.audit.append(name)
                self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        c = self.counts
        return (self.conv, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], self.cost, "".join(self.audit),
                self.sha.hexdigest(), c["rows"], c["chunks"])


def _trace(batches):
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]

    def batch(done):
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names)

    now = None
    for b in batches:
        done = []
        cols = [b.column(c).to_pylist() for c in ("conv", "kind", "turn", "role", "text", "end", "start", "off")]
        for conv, kind, turn, role, text, end, start, off in zip(*cols):
            if kind == 0:                                  # every conversation begins with such a row
                if now is not None:
                    done.append(now.result())
                now = Trace(conv)
            elif kind == 1:
                now.chunk(text, end, start, off)
            else:
                now.row(turn, role, text)
        yield batch(done)
    if now is not None:
        yield batch([now.result()])


def repair(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row a conversation: its gaps, faults, and the cheapest repair (see ``REPAIRED``).

    ``conversations`` has ``conv_id, turn, role, text``; other columns are ignored, whatever their names.
    A null conv_id is a conversation of its own; null turns come first and take no part in gaps; null
    roles and texts are one space, so such a text is blank. Rows that share a turn are ordered as in
    ``in_order``; repeated rows are duplicates. A conversation that loses every row has zeros, an empty
    audit and the hash of nothing. An empty table gives no row.
    """
    rows = in_order(damaged(conversations))
    marked = store(solve(chunks_of(letters(rows), chunk_bits)), "chunks")
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"),
                                                ("end", VECTOR), ("start", VECTOR), ("off", "bigint"))}

    def like(df: DataFrame, kind: int, seq: Column, **own: Column) -> DataFrame:
        return df.select("conv", seq.alias("seq"), F.lit(kind).alias("kind"),
                         *[own.get(c, none[c]).alias(c) for c in none])

    ids = conversations.select(F.col("conv_id").cast("bigint").alias("conv")).distinct()
    every = like(ids, 0, F.lit(-1).cast("bigint")).unionAll(
        like(marked, 1, F.col("seq"), text=F.col("letters"), end=F.col("end"), start=F.col("start"), off=F.col("off"))).unionAll(
        like(rows, 2, F.col("seq"), turn=F.col("turn"), role=F.col("role"), text=F.col("text")))
    streams = every.repartition(shuffle_partitions(every.sparkSession), "conv").sortWithinPartitions("conv", "seq", "kind")
    return streams.mapInArrow(_trace, REPAIRED)
