"""WARC archives: written as one gzip stream a file, then normalised to one member a record with an offset index.

`write_archives` lays the records of each partition into a single gzip stream
(what careless writers leave). `normalise` inflates such a stream once, from
end to end, and rewrites every record as a gzip member of its own beside a
sidecar index of (offset, length), so that a record can be read with one seek.
All files lie in the shared folder and get their final name by a rename, so
repeated tasks leave whole files only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import materialize, open_fs, workdir

CHUNK = 1 << 20
#: A record of the sidecar index: offset, length, id (and whether it has one).
ENTRY = struct.Struct("<QQqB")
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str | None) -> str:
    """A header value without line breaks."""
    return " ".join((value or "").split())


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record that names the page it repeats."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Splitter:
    """Cuts a byte stream into records; holds no more than one record and one chunk."""

    def __init__(self):
        self.held, self.need = bytearray(), None

    def feed(self, data: bytes):
        self.held += data
        while True:
            if self.need is None:
                at = self.held.find(b"\r\n\r\n")
                if at < 0:
                    return
                size = next(int(x.split(b":")[1]) for x in bytes(self.held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                self.need = at + 4 + size + 4
            if len(self.held) < self.need:
                return
            out = bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = None
            yield out

    def close(self) -> None:
        if self.held:
            raise ValueError("the archive ends inside a record")


def inflate(stream):
    """Bytes of a gzip stream of one or many members, a chunk at a time; a member without its trailer is an error."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            out = z.decompress(data, CHUNK)
            if out:
                yield out
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if out := z.flush():
        yield out
    if begun and not z.eof:
        raise ValueError("the archive ends inside a gzip member")


class _Replace:
    """Output stream that takes its final name when it is closed without an error."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.spare = fs, path, f"{path}.{uuid.uuid4().hex[:8]}"

    def __enter__(self):
        self.out = self.fs.open_output_stream(self.spare)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.spare, self.path)
        else:
            self.fs.delete_file(self.spare)


def write_archives(pages: DataFrame, uri: str, level: int = 5) -> DataFrame:
    """(part, file, records) of one gzip stream for each partition of pages(page_id, url, html, refers_to); `part` is its number."""

    def work(batches):
        from pyspark import TaskContext

        fs, top = open_fs(uri)
        fs.create_dir(top, recursive=True)
        part = TaskContext.get().partitionId()
        path, n = f"{top}/part-{part:06d}.warc.gz", 0
        with _Replace(fs, path) as out:
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            for b in batches:
                for page, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                    out.write(z.compress(record(page, url, (html or "").encode(), refers)))
                    n += 1
            out.write(z.flush())
        yield pa.RecordBatch.from_arrays([pa.array([part] * (n > 0), pa.int32()), pa.array([path] * (n > 0), pa.string()), pa.array([n] * (n > 0), pa.int64())], names=["part", "file", "records"])

    return pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInArrow(work, FILES)


FILES = "part int, file string, records long"


def one_by_one(files: DataFrame) -> DataFrame:
    """(part, file), each file in a task of its own: the list is tiny, its work is not."""
    most = files.agg(F.max("part")).first()[0]
    return files.select("part", "file").repartitionById((most or 0) + 1, F.col("part"))


def normalise_file(uri: str, file: str, level: int = 5) -> str:
    """Rewrite one archive with a member a record and a sidecar index; returns the new file's path.

    The sidecar is written last and is the sign that the work is done; a
    repeat finds it and has nothing to do. The monolithic file goes then.
    """
    fs, _ = open_fs(uri)
    target = file.removesuffix(".warc.gz") + ".members.warc.gz"
    if fs.get_file_info(target + ".idx").is_file:
        return target
    split, at, index = Splitter(), 0, []
    with fs.open_input_stream(file, compression=None) as stream, _Replace(fs, target) as out:
        for chunk in inflate(stream):
            for raw in split.feed(chunk):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                fields = parse(raw)[0]
                index.append(ENTRY.pack(at, len(member), int(fields.get("x-page-id", 0)), "x-page-id" in fields))
                out.write(member)
                at += len(member)
        split.close()
    with _Replace(fs, target + ".idx") as out:
        out.write(b"".join(index))
    fs.delete_file(file)
    return target


def read_index(fs, target: str) -> list[tuple[int, int, int, bool]]:
    """(offset, length, id, has an id) of each record."""
    with fs.open_input_stream(target + ".idx", compression=None) as f:
        return list(ENTRY.iter_unpack(f.read()))


def normalise(files: DataFrame, uri: str) -> DataFrame:
    """(part, file, records) of the normalised archives; one task handles one file."""

    def work(batches):
        fs, _ = open_fs(uri)
        for b in batches:
            done = [normalise_file(uri, f) for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string()), pa.array([len(read_index(fs, f)) for f in done], pa.int64())], names=["part", "file", "records"])

    return one_by_one(files).mapInArrow(work, FILES)


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(files: DataFrame, uri: str, payloads: bool = False) -> DataFrame:
    """Every record of the normalised archives, through the index; a response's digest is computed from what was read."""

    def work(batches):
        fs, _ = open_fs(uri)
        for b in batches:
            for file in b.column(1).to_pylist():
                rows, held = [], 0
                with fs.open_input_file(file) as f:
                    for offset, length, _, _ in read_index(fs, file):
                        f.seek(offset)
                        fields, payload = parse(zlib.decompress(f.read(length), 31))
                        revisit = fields["warc-type"] == "revisit"
                        stated = fields["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (digest(payload) != stated or len(payload) != int(fields["x-payload-length"])):
                            raise ValueError(f"{file}: the record at {offset} is damaged")
                        page, refers = (int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id"))
                        rows.append((page, fields["warc-target-uri"], int(fields["x-payload-length"]), stated, fields["warc-type"], refers, payload if payloads else None))
                        held += len(payload) if payloads else 200
                        if held > 16 * CHUNK:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    return one_by_one(files).mapInArrow(work, RECORD)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RECORD.split(", ")])


def archive_pages(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = 0, uri: str | None = None, payloads: bool = False) -> DataFrame:
    """Archive the pages, normalise the archives, read them back: one row per page.

    Of pages with equal payloads of at least `least` bytes the one with the
    largest page_id is the response and the others are revisits of it; smaller
    payloads are all responses. A null html counts as empty. Rows that share
    the largest id are all responses; rows without an id are revisits where a
    page with an id has the payload, else responses. Other columns are ignored,
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    uri = uri or workdir(spark, "warc")
    rows = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    raw = F.col("html").cast("binary")
    keyed = rows.select("page_id", F.sha1(raw).alias("sha"), F.length(raw).alias("size"))
    # only payloads that occur twice are looked up; the pages themselves stay where they are if those are few
    copies = keyed.filter(F.col("size") >= least).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1 AND winner IS NOT NULL").select("sha", "winner")
    copies = materialize(copies, "warc-copies")
    refers = F.when((F.length(raw) >= least) & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    marked = rows.withColumn("sha", F.sha1(raw)).join(copies, "sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    files = materialize(write_archives(marked, uri), "warc-files")
    done = materialize(normalise(files, uri), "warc-normalised")
    return read_archives(done, uri, payloads)
