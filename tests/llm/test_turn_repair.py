"""Conversation repair against an exhaustive search and a plain restatement of the rules."""

import hashlib
import random
import re
import zlib

import pytest

from threadlens.llm import turn_repair as T

GOAL = re.compile(r"(s?(ua)+)?")


def exhaustive(rows):
    """Cheapest and then least audit over all edit sequences of a few rows ``(initial, must_delete, cut)``."""
    best = (4 * len(rows) + 1, "")

    def go(k, made, cost, audit):
        nonlocal best
        if cost > best[0] or len(made) > 2 * len(rows) + 2:
            return
        if k == len(rows) and GOAL.fullmatch(made):
            best = min(best, (cost, audit))
        if not re.fullmatch(r"(s?(ua)*u?)?", made):
            return
        for role in "ua":
            go(k, made + role, cost + 3, audit + "I")
        if k < len(rows):
            initial, must, cut = rows[k]
            go(k + 1, made, cost + 4, audit + "D")
            if not must:
                go(k + 1, made + initial, cost + 3 * cut, audit + "K")
                for role in "ua":
                    go(k + 1, made + role, cost + 3 + 3 * cut, audit + "R")

    go(0, "", 0, "")
    return best


def plain(rows):
    """The same by costs and whole audits from the end, for any number of rows."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    fits = {"": "u", "s": "u", "u": "a", "a": "u"}

    def insert(costs):
        for _ in range(3):
            for s in fits:
                c, a = costs[step[s, fits[s]]]
                costs[s] = min(costs[s], (c + 3, "I" + a))
        return costs

    after = insert({"": (0, ""), "a": (0, ""), "s": (10 ** 9, ""), "u": (10 ** 9, "")})
    for initial, must, cut in reversed(rows):
        now = {}
        for s in fits:
            options = [(after[s][0] + 4, "D" + after[s][1])]
            if not must:
                if (s, initial) in step:
                    c, a = after[step[s, initial]]
                    options.append((c + 3 * cut, "K" + a))
                c, a = after[step[s, fits[s]]]
                options.append((c + 3 + 3 * cut, "R" + a))
            now[s] = min(options)
        after = insert(now)
    return after[""]


def letters_of(rows):
    return "".join("b" if must else (i.upper() if cut else i) for i, must, cut in rows)


def some_rows(rng, n):
    return [(rng.choice("suao" if rng.random() < 0.5 else "ua"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_plain_restatement_equals_exhaustive_search():
    rng = random.Random(1)
    for _ in range(300):
        rows = some_rows(rng, rng.randint(0, 4))
        assert plain(rows) == exhaustive(rows), rows


def test_chunks_with_speculative_ends():
    """Any cut into chunks, any pass order: the same costs as one run; passes end soon."""
    rng = random.Random(2)
    for _ in range(200):
        rows = some_rows(rng, rng.randint(0, 60))
        text = letters_of(rows)
        vectors, off = T.backwards(text, T.GOAL)
        assert vectors[0][T.START] + off == plain(rows)[0]
        cut = rng.randint(1, 9)
        parts = [text[i:i + cut] for i in range(0, len(text), cut)]
        guess = [T.GOAL for _ in parts]
        runs = [(v[0], o) for v, o in (T.backwards(p, T.GOAL) for p in parts)]
        for _ in range(len(parts) + 1):
            given = [runs[k + 1][0] if k + 1 < len(parts) else T.GOAL for k in range(len(parts))]
            if given == guess:
                break
            runs = [T.fix_up(p, g, n, *r)[:2] if g != n else r for p, g, n, r in zip(parts, guess, given, runs)]
            guess = given
        assert given == guess
        if parts:
            assert runs[0][0] == vectors[0] and sum(o for _, o in runs) == off


def test_fix_up_stops_where_vectors_are_parallel():
    rng = random.Random(4)
    text = letters_of(some_rows(rng, 5000))
    vectors, off = T.backwards(text, T.GOAL)
    for end in ((0, 3, 6, 2), (5, 0, 1, 9)):
        want, o = T.backwards(text, end)
        start, const, run = T.fix_up(text, T.GOAL, end, vectors[0], off)
        assert (start, const) == (want[0], o) and run < 200


def code(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def restated(table):
    """The whole operator in plain Python."""
    out, by = [], {}
    for conv, turn, role, text in table:
        rows, c = by.setdefault(conv, []), code(conv, turn)
        role, text = " " if role is None else role, " " if text is None else text
        if c == 4:
            role = "user"
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        rows += [(turn, role, text)] * (0 if c == 0 else 2 if c == 3 else 1)
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, marks, n = set(), [], dict(b=0, d=0, t=0)
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            blank, again = not body, (role, text) in seen
            cut = not blank and not again and body[-1] not in ".!?"
            seen.add((role, text))
            n["b"] += blank
            n["d"] += again and not blank
            n["t"] += cut
            marks.append((role[:1], blank or again, cut))
        cost, audit = plain(marks)
        made, lines, k = "", [], 0
        for x in audit:
            fit = {"": "u", "s": "u", "u": "a", "a": "u"}[made[-1:]]
            if x == "I":
                lines.append({"u": "user:", "a": "assistant:"}[fit])
                made += fit
                continue
            _, role, text = rows[k]
            k += 1
            if x == "K":
                lines.append(f"{role}:{text}")
                made += role[:1]
            elif x == "R":
                lines.append({"u": "user", "a": "assistant"}[fit] + ":" + text)
                made += fit
        assert GOAL.fullmatch(made) and k == len(rows)
        turns = {r[0] for r in rows if r[0] is not None}
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["b"], n["d"], n["t"],
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng, rows = random.Random(7), []
    words = ["Fine.", "why?", "no end", "", " \n", None, "Ok!", "same.", "é.", "tail. ", "stop. \t\r\n"]
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, ""] if conv % 3 else ["user", "assistant"]),
                         rng.choice(words) if conv % 2 else f"text {conv} {turn}."))
    rows += [(None, t, "user", f"n{t}.") for t in (None, 1, 4, 4)] + [(900, None, "user", f"k{t}.") for t in range(20)]
    rows += [(901, t, "assistant", "long " * 200_000 + ".") for t in range(4)] + [rows[0]] * 3
    rows += [(1000, t, "user" if rng.random() < 0.6 else "assistant", f"{t % 50} said." if t % 7 else "same") for t in range(700)]
    gone = next(c for c in range(2000, 9000) if code(c, 0) == 0)
    return rows + [(gone, 0, "user", "x.")]


@pytest.mark.parametrize("chunk_bits", [1, 14])
def test_repair_against_plain_python(spark, chunk_bits):
    table = conversations()
    schema = "conv_id bigint, turn bigint, role string, text string, conv string, seq int, kind int, letter string"
    df = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in table], schema).repartition(5)
    got = sorted((tuple(r)[:9] for r in T.repair(df, chunk_bits).collect()), key=str)
    assert got == restated(table)
    assert T.repair(df.where("false")).count() == 0
