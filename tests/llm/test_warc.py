"""The WARC writer and the salvage reader: round trips, and damage at known places."""

import gzip
import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from threadlens.llm import warc

LONG = "<p>" + "long é " * 20 + "</p>"


class Memory:
    """A file in memory, as FileView reads it."""

    def __init__(self, data):
        self.data, self.place = data, 0

    def seek(self, k):
        self.place = k

    def read(self, n):
        out = self.data[self.place:self.place + n]
        self.place += len(out)
        return out


def read(data):
    return list(warc.salvage(warc.FileView(Memory(data), len(data))))


def records(data):
    return [(r["record_id"], r["payload"]) for _, _, r, _ in read(data) if r]


def page(k, body):
    body = body.encode()
    return warc.page_record(k, f"http://h/{k} x", body, hashlib.sha256(body).hexdigest(), None)


def tiles(data, found):
    """Records and gaps follow each other and leave out line ends only."""
    here = 0
    for at, n, _, _ in found:
        assert not data[here:at].strip(b"\r\n") and at >= here
        here = at + n
    assert not data[here:].strip(b"\r\n")


BODIES = ["", "a", "x" * 99, LONG, "text WARC/1.1\r\nWARC-Type: response\r\nno record\r\n\r\n" * 3, "é\x00\x1f\x8b\x08" * 50, "z" * 200_000]


@pytest.mark.parametrize("compress", [True, False])
def test_a_sound_archive_reads_back(compress):
    wrap = warc.member if compress else bytes
    data = b"".join(wrap(page(k, b)) for k, b in enumerate(BODIES))
    assert records(data) == [(f"urn:page:{k}", b.encode()) for k, b in enumerate(BODIES)]
    assert all(why is None for *_, why in read(data))
    tiles(data, read(data))


@pytest.mark.parametrize("compress", [True, False])
def test_damage_loses_only_what_it_touches(compress):
    rng, wrap = random.Random(3), (warc.member if compress else bytes)
    for _ in range(150):
        parts = [wrap(page(k, "".join(rng.choice("ab WARC/1.1\r\n") for _ in range(rng.choice([0, 5, 300, 3000])))))
                 for k in range(rng.randint(1, 8))]
        data, ends = b"".join(parts), []
        for p in parts:
            ends.append((ends[-1] if ends else 0) + len(p))
        whole = dict(records(data))
        assert len(whole) == len(parts)
        kind, at = rng.choice(["flip", "cut", "add", "drop", "zero"]), rng.randrange(len(data))
        n = rng.randint(1, 400)
        if kind == "flip":
            bad, lo, hi = data[:at] + bytes([data[at] ^ 0x41]) + data[at + 1:], at, at + 1
        elif kind == "cut":
            bad, lo, hi = data[:at], at, len(data)
        elif kind == "add":
            bad, lo, hi = data[:at] + rng.randbytes(n) + data[at:], at, at
        elif kind == "drop":
            bad, lo, hi = data[:at] + data[at + n:], at, at + n
        else:
            bad, lo, hi = data[:at] + b"\0" * len(data[at:at + n]) + data[at + n:], at, min(at + n, len(data))
        found, got = read(bad), dict(records(bad))
        for k, p in enumerate(parts):
            start, end = ends[k] - len(p), ends[k]
            if end <= lo or start >= hi:
                assert got[f"urn:page:{k}"] == whole[f"urn:page:{k}"], (kind, k)
        if compress:                    # no digest covers the header lines of a plain record
            assert all(whole[i] == b for i, b in got.items())
        assert all(any(r["payload"].endswith(b) for b in whole.values()) for _, _, r, _ in found if r)
        tiles(bad, found)
        if compress and len(got) < len(whole) and kind != "cut":
            assert any(why for *_, why in found)


def test_gaps_say_where_and_why():
    a, b, c = (warc.member(page(k, LONG)) for k in range(3))
    bad = a + b[:40] + b"\xff\xff" + b[42:] + c
    (_, _, first, _), (at, n, none, why), (start, size, last, _) = read(bad)
    assert first["record_id"] == "urn:page:0" and none is None and (at, n) == (len(a), len(b)) and "member" in why
    assert (start, size, last["record_id"]) == (len(a) + len(b), len(c), "urn:page:2")
    plain = page(0, LONG)
    wrong = plain.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    bad = plain + wrong + page(2, LONG) + b"tail"
    assert [(r and r["record_id"], why) for _, _, r, why in read(bad)] == [
        ("urn:page:0", None), (None, "the record is cut off"), ("urn:page:2", None), (None, "no record")]
    assert read(b"") == [] and read(b"\r\n\r\n") == []
    assert [(at, n) for at, n, _, _ in read(b"no archive")] == [(0, 10)]


def test_many_records_in_one_member():
    data = gzip.compress(b"".join(page(k, LONG * 400) for k in range(30)))
    assert [i for i, _ in records(data)] == [f"urn:page:{k}" for k in range(30)]
    cut = data[:len(data) * 2 // 3]
    got = [i for i, _ in records(cut)]
    assert got == [f"urn:page:{k}" for k in range(len(got))] and 5 <= len(got) < 30
    assert [why for *_, why in read(cut)][-1] == "the member is cut off"
    broken = page(5, LONG).replace(b"WARC-Type", b"WARC Type\x00", 1).replace(b"WARC-Block-Digest: sha256:", b"WARC-Block-Digest: sha256:0")
    inner = gzip.compress(page(1, LONG) + broken + page(2, LONG))
    assert [i for i, _ in records(inner)] == ["urn:page:1", "urn:page:2"]


def test_awkward_bytes_take_linear_time():
    began = time.time()
    for junk in (b"WARC/1.1\r\n" * 200_000, b"\r\nWARC/1.1\r\na: b\r\n" * 100_000, b"\x1f\x8b\x08\x00" * 200_000, b"\r\n" * 300_000):
        data = page(0, LONG) + junk + page(1, LONG)
        assert [i for i, _ in records(data)] == ["urn:page:0", "urn:page:1"]
    assert time.time() - began < 60


PAGES = [(5, "http://a/1", LONG), (3, "http://a/2\r\nWARC-Type: x", LONG), (9, None, LONG), (None, "http://n", LONG),
         (7, "u", None), (8, "u", ""), (2, "u", "short"), (1, "u", "short"), (4, "u", "y" * 100), (6, "u", "y" * 100),
         (10, "u", "w" * 99), (11, "u", "w" * 99), (12, "u", "q" * 500), (12, "u", "q" * 500), (13, "u", "q" * 500),
         (None, "u", "only null " * 20), (None, None, "only null " * 20), (14, "u", "é" * 50), (15, "u", "é" * 50),
         (16, "u", "long " * 600_000), (17, "u", "\x00\x01  ")]


def expected(rows):
    first = {}
    for k, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100:
            first[b] = min([x for x in (first.get(b), k) if x is not None], default=None)
    out = []
    for k, _, html in rows:
        b = (html or "").encode()
        again = b in first and first[b] != k
        out.append((k, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_archived_pages(spark, tmp_path):
    schema = "page_id bigint, url string, html string, digest string, payload int, `first` string, refers_to int"
    pages = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in PAGES], schema).repartition(3)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = warc.archived_pages(pages).select(names).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(PAGES)
    assert warc.archived_pages(pages.where("false")).count() == 0
    made = warc.write_warc(pages, f"file://{tmp_path}/w", file_bytes=2000, compress=False)
    assert made.agg(F.sum("records")).first()[0] == len(PAGES) and made.count() > 3
    again = warc.read_warc(warc.archives(spark, f"{tmp_path}/w"))
    texts = {r.payload.decode() for r in again.where("warc_type = 'response'").collect()}
    assert texts == {r[2] or "" for r in PAGES}
    assert again.where("warc_type = 'revisit' and payload is not null or reason is not null").count() == 0
    name = sorted(os.listdir(tmp_path / "w"))[0]
    data = bytearray((tmp_path / "w" / name).read_bytes())
    data[len(data) // 2] ^= 1
    (tmp_path / "w" / "damaged.warc").write_bytes(data)
    rows = warc.read_warc(spark.createDataFrame([(f"{tmp_path}/w/damaged.warc",)], "file string")).collect()
    assert sum(r.reason is not None for r in rows) <= 1 and sum(r.length for r in rows) == len(data)
