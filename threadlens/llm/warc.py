"""WARC archives: a writer, and a reader that salvages what a damaged archive still holds.

Writer: one record a page, each in a gzip member of its own (or plain), files cut at a size. Of pages
with one payload the smallest page_id is written as ``response``; the others become ``revisit``
records that carry the payload's digest and its HTTP headers, but not the payload.

Reader: a record counts when its checks pass: the gzip member inflates and its CRC holds, the version
line, the header fields and Content-Length can be read, the record ends where it says, and the
digests agree. After a failed check the reader searches for the next gzip member that starts with a
version line, or the next version line, whose record passes, goes on there, and logs the bytes between as
a quarantined gap.

Scale: pages are written by the tasks that scan them; only digests are grouped, and payloads are not
shuffled while the table of repeated payloads is small enough to broadcast (its size is known, as it is
stored first). A file is read as a stream, one window and one record at a time. A task that is run again
writes files under new names; only those in the manifest, which Spark commits, are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import store
from threadlens.session import ensure_checkpoint_dir

LEAST_REVISIT = 100          # shorter payloads are always written in full
FILE_BYTES = 64 << 20        # a file is closed when it has reached this size
LEVEL = 4                    # of compression
DATE = "2024-01-01T00:00:00Z"
WINDOW = 1 << 20             # bytes of a file held at once, beside the record being read
PIECE = 1 << 16              # compressed bytes inflated at once
HEADER_BYTES = 1 << 16       # a longer header block is not one

# Fixed values of the format.
VERSION_LINE = re.compile(rb"WARC/\d\.\d+\r\n")
GZIP, VERSION, END, BLANK = b"\x1f\x8b\x08", b"WARC/", b"\r\n\r\n", b"\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "urn:page:"


# ---- writer

def _uri(url: str) -> str:
    """The URL without white space and control characters, which would end a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(kind: str, record_id: str, block: bytes, content_type: str, fields: list[tuple[str, str]]) -> bytes:
    """One WARC record, ready to be written plain or as a gzip member."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *fields, ("Content-Type", content_type),
            ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + BLANK + block + END


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """The record of a page; with ``refers_to`` a revisit, which leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.insert(0, ("WARC-Target-URI", _uri(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{PAGE_ID}{refers_to}>")]
    name = f"{PAGE_ID}{'null' if page_id is None else page_id}"
    return record("response" if refers_to is None else "revisit", name,
                  http + payload if refers_to is None else http, "application/http; msgtype=response", fields)


def member(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _writer(path: str, file_bytes: int, compress: bool, date: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        out, name, done = None, None, []
        wrap = member if compress else bytes

        def close():
            if out is not None:
                done.append((f"{path}/{name}", out.tell(), count))
                out.close()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None or out.tell() >= file_bytes:
                    close()
                    fs.create_dir(root, recursive=True)
                    name, count = f"pages-{uuid.uuid4().hex}.warc" + ".gz" * compress, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"software: threadlens\r\nformat: WARC File Format 1.1\r\n"
                    out.write(wrap(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", info, "application/warc-fields",
                                          [("WARC-Date", date), ("WARC-Filename", name)])))
                out.write(wrap(page_record(*row, date)))
                count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], ["file", "bytes", "records"])
    return run


def with_referred(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: which page's response holds the same payload."""
    p = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"),
                     F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    first = p.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return p.join(store(first, "payloads"), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.expr("CASE WHEN NOT page_id <=> first THEN first END").alias("refers_to"))


def write_warc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, compress: bool = True,
               date: str = DATE) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a WARC record below ``path``.

    Returns the manifest ``file, bytes, records``. A null html is an empty payload, a null url leaves
    WARC-Target-URI out. Rows that repeat a page_id and its payload are all responses if that page_id
    is the smallest; rows without a page_id revisit one that has one. Payloads of fewer than 100 bytes
    are all written as responses. Other columns are ignored, whatever their names. An empty table
    writes no file. ``date`` is given, so that runs agree.
    """
    rows = with_referred(pages).mapInArrow(_writer(path, file_bytes, compress, date),
                                           "file string, bytes bigint, records bigint")
    return store(rows, "manifest")


# ---- reader

class Failed(Exception):
    """A check that a record does not pass."""


class Broken(Failed):
    """The gzip member around a record ends early, does not inflate, or has another CRC."""


class FileView:
    """Bytes of a file by offset, through a window."""

    def __init__(self, f, size: int):
        self.f, self.size, self.start, self.held = f, size, 0, b""

    def at(self, start: int, n: int) -> bytes:
        end = min(start + n, self.size)
        if start < self.start or end > self.start + len(self.held):
            self.f.seek(start)
            self.start, self.held = start, self.f.read(min(max(n, WINDOW), self.size - start))
        return self.held[start - self.start:end - self.start]

    def find(self, what: bytes, start: int) -> int:
        """Offset of the next ``what``, or the end of the file."""
        while start < self.size:
            part = self.at(start, WINDOW)
            k = part.find(what)
            if k >= 0:
                return start + k
            start += max(1, len(part) - len(what) + 1) if start + len(part) < self.size else len(part)
        return self.size

    def done(self, start: int) -> None:
        pass


class MemberView:
    """Inflated bytes of a gzip member by offset; what lies before the current record is let go."""

    def __init__(self, source: FileView, start: int):
        self.source, self.next, self.inflate = source, start, zlib.decompressobj(31)
        self.first, self.held, self.ended = 0, bytearray(), False

    @property
    def size(self) -> int:
        """Bytes known so far; all of them once the member has ended."""
        return self.first + len(self.held)

    def more(self) -> bool:
        """Inflate another piece; false at the member's end."""
        if self.ended:
            return False
        piece = self.source.at(self.next, PIECE)
        if not piece:
            raise Broken("the member is cut off")
        try:
            self.held += self.inflate.decompress(piece)
        except zlib.error as e:
            raise Broken(f"the member does not inflate: {e}") from None
        self.ended = self.inflate.eof
        self.next += len(piece) - len(self.inflate.unused_data)
        return True

    def at(self, start: int, n: int) -> bytes:
        while start + n > self.size and self.more():
            pass
        return bytes(self.held[start - self.first:start - self.first + n])

    def find(self, what: bytes, start: int) -> int:
        while True:
            k = self.held.find(what, start - self.first)
            if k >= 0:
                return self.first + k
            start = max(start, self.size - len(what) + 1)
            if not self.more():
                return self.size

    def done(self, start: int) -> None:
        del self.held[:start - self.first]
        self.first = start


def _digest_holds(said: str | None, data: bytes) -> bool:
    """Whether a labelled digest (hexadecimal or base 32) agrees; unknown labels are not checked."""
    label, _, value = (said or "").strip().partition(":")
    if label.lower().replace("-", "") not in ("sha1", "sha256", "sha512", "md5"):
        return True
    own = hashlib.new(label.lower().replace("-", ""), data).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def _fields(block: bytes) -> dict[str, str]:
    """Named fields of a header block; a line that starts with white space continues the one before."""
    out, last = {}, None
    for line in block.split(BLANK):
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            raise Failed("a header line has no name")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _strip(urn: str | None) -> str | None:
    return None if urn is None else urn.strip().removeprefix("<").removesuffix(">")


def read_record(view, start: int) -> tuple[int, dict]:
    """The record at ``start`` and the offset after it; ``Failed`` when a check does not pass."""
    head = view.at(start, 4096)
    if not VERSION_LINE.match(head):
        raise Failed("no version line")
    if b":" not in head[head.index(BLANK) + 2:].split(BLANK, 1)[0]:
        raise Failed("no header line")
    if END not in head:
        head = view.at(start, HEADER_BYTES)
    at = head.find(END)
    if at < 0:
        raise Failed("the header block does not end")
    fields = _fields(head[head.index(BLANK) + 2:at])
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Failed("no Content-Length")
    if not fields.get("warc-type") or not fields.get("warc-record-id"):
        raise Failed("no WARC-Type or WARC-Record-ID")
    body, end = start + at + 4, start + at + 4 + int(length)
    if isinstance(view, FileView) and view.at(end, 4) != END:     # before the block is read
        raise Failed("the record is cut off" if end + 4 > view.size else "no record end after Content-Length bytes")
    block = view.at(body, int(length))
    if view.at(end, 4) != END:
        raise Failed("no record end after Content-Length bytes")
    if not _digest_holds(fields.get("warc-block-digest"), block):
        raise Failed("the block digest differs")
    kind, payload, said = fields["warc-type"].lower(), block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(END)
        said = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", http)
    if kind == "revisit":
        payload = None
    elif not _digest_holds(fields.get("warc-payload-digest"), payload):
        raise Failed("the payload digest differs")
    return end + 4, {
        "warc_type": kind, "record_id": _strip(fields["warc-record-id"]), "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"), "refers_to": _strip(fields.get("warc-refers-to")),
        "payload_digest": (fields.get("warc-payload-digest", "").rpartition(":")[2] or None) if payload is None
        else hashlib.sha256(payload).hexdigest(),
        "payload_bytes": (int(said[1]) if said else None) if payload is None else len(payload), "payload": payload}


def _plain(view, start: int):
    """Records and gaps of the inflated bytes of a member: ``(start, end, record or None, reason)``."""
    bad, reason = None, None
    while True:
        first = view.at(start, 1)
        if not first:
            break
        if bad is None and first in b"\r\n":
            start += 1
            continue
        try:
            end, rec = read_record(view, start)
        except Broken:
            raise
        except Failed as e:
            if bad is None:
                bad, reason = start, str(e)
            start = view.find(VERSION, start + 1)
            continue
        if bad is not None:
            yield bad, start, None, reason
            bad = None
        yield start, end, rec, None
        start = end
        view.done(start)
    if bad is not None:
        yield bad, view.size, None, reason


def salvage(view: FileView):
    """Records and quarantined gaps of a file, in order: ``(offset, length, record or None, reason)``.

    A record's place is that of its bytes in the file, or of its member when it is compressed (the length
    is null for all but the last record of a member). Line ends between records are padding. Of a member that holds several records and fails, those are kept that
    were followed by another before the failure; the gap then starts at the member.
    """
    here, bad, reason, ahead = 0, None, None, {GZIP: -1, VERSION: -1}
    while here < view.size:
        first, held, gap = view.at(here, 5), None, bad
        if bad is None and first[:1] in (b"\r", b"\n"):
            here += 1
            continue
        try:
            if first[:3] == GZIP:
                inner = MemberView(view, here)
                if not VERSION_LINE.match(inner.at(0, 16).lstrip(BLANK)):
                    raise Failed("no version line in the member")
                for item in _plain(inner, 0):
                    if held is not None:
                        if gap is not None:
                            yield gap, here - gap, None, reason
                            gap = bad = None
                        yield here, None, held[2], held[3]
                    held = item
                while inner.more():
                    pass
                end, items = inner.next, [held] if held else []
            elif first == VERSION:
                end, rec = read_record(view, here)
                items = [(here, end, rec, None)]
            else:
                raise Failed("no record")
        except Failed as e:
            if bad is None:
                bad, reason = here, str(e)
            for what in ahead:
                if ahead[what] <= here:
                    ahead[what] = view.find(what, here + 1)
            here = min(ahead.values())
            continue
        if gap is not None:
            yield gap, here - gap, None, reason
            bad = None
        for _, _, rec, why in items:
            yield here, end - here, rec, why
        here = end
    if bad is not None:
        yield bad, view.size - bad, None, reason


FIELDS = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()),
          ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
          ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
          ("payload", pa.binary())]
READ = ("file string, offset bigint, length bigint, reason string, warc_type string, record_id string, target_uri string, "
        "date string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")
BATCH_BYTES = 16 << 20


def _reader(payloads: bool):
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in FIELDS], [c for c, _ in FIELDS])

    def run(batches):
        for b in batches:
            for path in b.column("file").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for offset, length, rec, reason in salvage(FileView(f, f.size())):
                        row = {"file": path, "offset": offset, "length": length, "reason": reason, **(rec or {})}
                        if not payloads:
                            row.pop("payload", None)
                        held += 500 + len(row.get("payload") or b"")
                        rows.append(row)
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)
    return run


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of every ``*.warc`` and ``*.warc.gz`` below ``path``; the files are listed, not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.warc{,.gz}").load(path).select(F.col("path").alias("file")))


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record and every quarantined gap (``reason`` not null) of the archives in column ``file``.

    Each file is streamed by one task; a file without bytes gives no row, one without any record a
    single gap. ``payload`` is null without ``payloads``, for revisits and for gaps.
    """
    n = max(1, files.count())
    return files.select("file").repartitionByRange(n, "file").mapInArrow(_reader(payloads), READ)


def page_number(urn: str) -> Column:
    return F.regexp_extract(urn, f"^{PAGE_ID}(-?[0-9]+)$", 1).try_cast("bigint")


def archived_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages`` and read the archives back: one row a page, taken from its record.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, file, offset``. ``path`` is a
    new folder below the shared checkpoint folder unless it is given. See ``write_warc`` for nulls,
    repeated rows and empty tables.
    """
    if path is None:
        path = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    read = read_warc(write_warc(pages, path), payloads=False)
    return read.where(F.col("warc_type").isin("response", "revisit")).select(
        page_number("record_id").alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), page_number("refers_to").alias("refers_to"), "file", "offset")
