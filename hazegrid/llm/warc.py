"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own. The reader takes member after member (in a plain file:
record after record) and checks the decompression with its checksum, the header, the lengths and
the SHA-1 of block and payload. After a failed check it searches, byte by byte, for the next place
where a member opens that begins with a version line (or where a version line stands) and goes on
there; what lies between is logged as a gap with file, first byte, end and reason. A record whose
member is whole but whose contents fail is a gap of that one member. So a damaged record costs
itself, never those behind it.

Of records with equal payloads, that with the smallest page id is the response and the others are
revisits that name it. A task writes files under names of its own attempt, which count once the
manifest has them; files are read through a window of fixed size, a record at a time.

Defined results: a null html is an empty payload; a null url is written empty; rows that share the
smallest id of a payload are all responses, and so are rows whose group has no id at all.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import attempt_name, join_measured, open_store, scratch, stored, texts

VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROTATE = 256 << 20  # bytes after which a task begins another file
READ = 4 << 20
FEED = 32 << 10
MOST_HEADER = 1 << 20


class Damaged(ValueError):
    """A record that fails a check; ``end``: where its bytes end, if that is sure."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_text(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed. With ``refers_to`` it is a revisit, without the payload."""
    digest = sha1_32(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += payload if refers_to is None else b""

    def name(i):
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"

    head = [f"{VERSION.decode()}1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {_header_text(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_32(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _compressed(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row; returns the manifest (path, n_records)."""
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), body.alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha1("html")))
    repeated = keyed.where(F.octet_length("html") >= min_bytes).groupBy(F.col("sha").alias("_sha")).agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_first")
    joined = join_measured(keyed, stored(repeated, "repeated"), [("sha", "_sha")])
    first = F.when(F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_first"))), F.col("_first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        stream, size, n, done = None, 0, 0, []
        for b in batches:
            for i, u, payload, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), texts(b.column("html")), b.column("first").to_pylist()):
                if stream is None:
                    store.create_dir(base, recursive=True)
                    _, name = attempt_name(f"pages-{len(done):04d}", ".warc.gz")
                    stream, size, n = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = _compressed(record(i, u, payload, refers))
                stream.write(data)
                size, n = size + len(data), n + 1
                if size >= ROTATE:
                    stream.close()
                    done.append((f"{folder}/{name}", n))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((f"{folder}/{name}", n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "n_records": pa.array([n for _, n in done], pa.int64())})

    return stored(joined.select("page_id", "url", "html", first.alias("first")).mapInArrow(write, "path string, n_records long"), "manifest")


class Window:
    """Bytes of a file by position, read ahead."""

    def __init__(self, file):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = min(n, self.size - start)
        if start < self.at or start + n > self.at + len(self.data):
            self.at, self.data = start, self.file.read_at(min(max(n, READ), self.size - start), start)
        return self.data[start - self.at:start - self.at + n]

    def find(self, what: bytes, start: int) -> int:
        """Position of ``what`` at or after ``start``, or -1."""
        while start < self.size:
            hit = self.get(start, READ).find(what)
            if hit >= 0:
                return start + hit
            start += max(1, min(READ, self.size - start) - len(what) + 1)
        return -1


def _member(w: Window, start: int) -> tuple[bytes, int]:
    z, out, at = zlib.decompressobj(31), [], start
    try:
        while not z.eof:
            chunk = w.get(at, FEED)
            if not chunk:
                raise Damaged("truncated member")
            out.append(z.decompress(chunk))
            at += len(chunk)
            if len(out) == 1 and out[0] and not out[0].startswith(VERSION[:len(out[0])]):
                raise Damaged("member without version line")
    except zlib.error as e:
        raise Damaged("broken member") from e
    return b"".join(out), at - len(z.unused_data)


def _headers(head: bytes) -> dict[str, str]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(VERSION) or not lines[0][len(VERSION):].isdigit():
        raise Damaged("no version line")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("broken header")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not out.get("content-length", "").isdigit():
        raise Damaged("no length")
    return out


def _checked(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url"""
    if "warc-block-digest" in head and head["warc-block-digest"].removeprefix("sha1:") != sha1_32(block):
        raise Damaged("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response":
        if digest and digest != sha1_32(payload):
            raise Damaged("payload digest")
        n, digest = len(payload), digest or sha1_32(payload)
    else:
        length = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        n = int(length[0]) if length and length[0].isdigit() else None

    def number(name):
        return int(head[name]) if head.get(name, "").lstrip("-").isdigit() else None

    return number("x-page-id"), n, digest or None, kind, number("x-refers-to-page-id"), head.get("warc-target-uri")


def _take(w: Window, start: int, zipped: bool) -> tuple[tuple, int]:
    """The record at ``start`` and where the next begins."""
    if zipped:
        data, end = _member(w, start)
        head, gap, rest = data.partition(b"\r\n\r\n")
        if not gap:
            raise Damaged("no header end", end)
        try:
            fields = _headers(head)
            n = int(fields["content-length"])
            if len(rest) < n or rest[n:] != b"\r\n\r\n":
                raise Damaged("wrong length")
            return _checked(fields, rest[:n]), end
        except Damaged as e:
            raise Damaged(str(e), end) from e
    stop = w.find(b"\r\n\r\n", start)
    if stop < 0 or stop - start > MOST_HEADER:
        raise Damaged("no header end")
    fields = _headers(w.get(start, stop - start))
    n = int(fields["content-length"])
    if stop + 8 + n > w.size or w.get(stop + 4 + n, 4) != b"\r\n\r\n":
        raise Damaged("wrong length")
    return _checked(fields, w.get(stop + 4, n)), stop + 8 + n


def _next_start(w: Window, start: int, zipped: bool) -> int:
    """The next place that opens like a record, or the end of the file."""
    while True:
        at = w.find(MAGIC if zipped else VERSION, start)
        if at < 0:
            return w.size
        if zipped:
            z = zlib.decompressobj(31)
            try:
                if z.decompress(w.get(at, FEED), 64).startswith(VERSION):
                    return at
            except zlib.error:
                pass
        elif at == 0 or w.get(at - 1, 1) == b"\n":
            return at
        start = at + 1


def salvage(file) -> Iterator[tuple[str, int, int, tuple | str]]:
    """("record", start, end, fields) and ("gap", start, end, reason) that cover the file."""
    w = Window(file)
    zipped = _next_start(w, 0, True) < _next_start(w, 0, False)  # by what opens first
    at = 0
    while at < w.size:
        try:
            fields, end = _take(w, at, zipped)
            yield "record", at, end, fields
        except Damaged as e:
            end = e.end if e.end is not None else _next_start(w, at + 1, zipped)
            yield "gap", at, end, str(e)
        at = end


FOUND = (("kind", "string"), ("path", "string"), ("start", "long"), ("end", "long"), ("reason", "string"), ("page_id", "long"),
         ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long"), ("url", "string"))
_ARROW = {"string": pa.string(), "long": pa.int64()}


def read_warc(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path) -> records and gaps. Each file is read once, by one task."""
    spark = manifest.sparkSession
    paths = [(r.path,) for r in manifest.select("path").orderBy("path").collect()]  # file names only

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    rows = []
                    for kind, start, end, got in salvage(file):
                        rows.append((kind, path, start, end, *((None, *got) if kind == "record" else (got, *[None] * 6))))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    files = spark.createDataFrame(paths, "path string").repartition(max(1, len(paths)))
    found = stored(files.mapInArrow(read, ", ".join(f"`{c}` {t}" for c, t in FOUND)), "salvaged")
    records = found.where("kind = 'record'").drop("kind", "reason")
    return records, found.where("kind = 'gap'").select("path", "start", "end", "reason")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(FOUND)], [c for c, _ in FOUND])


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to for each row."""
    records, _ = read_warc(write_warc(pages, scratch(pages.sparkSession, "warc"), min_bytes=min_bytes))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
