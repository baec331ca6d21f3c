"""Legacy archive converter: ARC files to WARC files.

A task streams through an ARC file, compressed (a gzip member a record) or plain;
each record's header line is parsed by the version that the file's first record
declares, and its length field says how many bytes belong to it. The converter
synthesises what WARC asks for: record ids from the record's place, timestamps from the
14-digit dates, SHA-256 payload digests, and types: the smallest page of each payload of
100 bytes or more is the response and its copies are revisits that refer to it.

Only an index of the records (digest, length, place) is shuffled to find the copies;
bodies never are: what a file's revisits refer to is brought to the task that converts
the file. A task reads and writes its archives by streams in the shared folder, a record
at a time, begins a new file after ROLL_BYTES, and names its files after its partition.
They are moved into place when they are whole, so a repeated task replaces its own files.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import drop_path, drop_stored, make_dir, new_path, stored

#: Bytes of an archive after which its task begins another.
ROLL_BYTES = 256 << 20
_STEP = 1 << 15
REVISIT_BYTES = 100
#: The fields of a header line by ARC version.
ARC_FIELDS = {
    1: "url ip date type length".split(),
    2: "url ip date type status checksum location offset filename length".split(),
}
_RECORD_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("n", pa.int64()), ("digest", pa.string()), ("file", pa.string()), ("at", pa.int64()), ("member", pa.binary()), ("length", pa.int64())])
_PAGES_DDL = "page_id long, url string, date string, n long, digest string, file string, at long, member binary, length long"


def _deflated(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _stream(path: str):
    """A file of the shared folder, opened for reading."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return io.BufferedReader(system.open_input_stream(path, compression=None), 1 << 20)


def members(source):
    """(start, raw, content) of each gzip member of a stream or of bytes."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    at, rest = 0, b""
    while rest := rest or stream.read(_STEP):
        z, raw, content = zlib.decompressobj(31), [], []
        while not z.eof:
            if not (rest := rest or stream.read(_STEP)):
                raise ValueError(f"gzip member at {at} is cut off")
            content.append(z.decompress(rest))
            raw.append(rest[: len(rest) - len(z.unused_data)])
            rest = z.unused_data
        raw = b"".join(raw)
        yield at, raw, b"".join(content)
        at += len(raw)


def _plain_members(stream):
    """The same for an uncompressed ARC file, whose records end where their length says."""
    at = 0
    while line := stream.readline():
        size = re.search(rb" (\d+)\r?\n$", line)
        if not size:
            raise ValueError(f"header line at {at} ends without a length")
        raw = line + stream.read(int(size[1])) + stream.read(1)
        yield at, raw, raw
        at += len(raw)


class _File:
    """The archives of one task, one after another; a task without records leaves none."""

    def __init__(self, folder: str, prefix: str, suffix: str, head):
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.prefix, self.suffix, self.head, self.out, self.files = f"{prefix}{TaskContext.get().partitionId():06d}", suffix, head, None, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.prefix}-{self.files:04d}{self.suffix}"
            self.fs.create_dir(self.folder)
            self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
            self.files, self.size = self.files + 1, 0
            self._write(self.head(self.name))
        self._write(record)
        if self.size >= ROLL_BYTES:
            self.close()

    def _write(self, record: bytes) -> None:
        data = _deflated(record)
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.folder}/{self.name}")
            self.out = None


def _one_line(x: str | None) -> str:
    return re.sub(r"\s", lambda m: "%%%02X" % ord(m[0]) if ord(m[0]) < 256 else "%20", x or "") or "-"


def write_arc(pages: DataFrame, folder: str, version: int, date: str = "20200101000000") -> None:
    """Writes rows (page_id, url, html) as ARC files of a version, an HTTP response
    a record with the page's id in X-Page-Id. Null html is an empty payload, a
    null id has no such header, and white space in urls is percent-encoded."""
    fields = ARC_FIELDS[version]

    def line(**v) -> bytes:
        return " ".join(str(v.get(f, "-")) for f in fields).encode() + b"\n"

    def head(name: str) -> bytes:
        body = f"{version} 0 twinlens\n{' '.join(x.title() for x in fields)}\n\n".encode()
        return line(url=f"filedesc://{name}", ip="0.0.0.0", date=date, type="text/plain", length=len(body)) + body

    def write(batches):
        out, n = _File(folder, f"v{version}-", ".arc.gz", head), 0
        for b in batches:
            n += b.num_rows
            for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
                own = b"" if page is None else b"X-Page-Id: %d\r\n" % page
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"\r\n" + (html or b"")
                out.add(line(url=_one_line(url), ip="0.0.0.0", date=date, type="text/html", status=200, offset=0, length=len(body)) + body + b"\n")
        out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    make_dir(pages.sparkSession, folder)
    pages.select("page_id", "url", F.col("html").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def parse_arc(source):
    """(start, raw, header fields, body) of the records of an ARC file, a stream or bytes;
    the first, its version block, says how to read the others' header lines."""
    stream = io.BufferedReader(io.BytesIO(source)) if isinstance(source, bytes) else source
    fields = None
    for at, raw, member in members(stream) if stream.peek(2)[:2] == b"\x1f\x8b" else _plain_members(stream):
        line, _, rest = member.partition(b"\n")
        values = line.decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with its version block")
            fields = ARC_FIELDS[int(rest.split(b" ", 1)[0])]
            continue
        if len(values) != len(fields):
            raise ValueError(f"header line at {at} has {len(values)} of {len(fields)} fields")
        v = dict(zip(fields, values))
        n = int(v["length"])
        if len(rest) < n:
            raise ValueError(f"record at {at} declares {n} bytes and has {len(rest)}")
        yield at, raw, v, rest[:n]


def _files_in(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path) of a folder's files; their contents are not read here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def _page(block: bytes) -> tuple[int | None, bytes, bytes]:
    http, gap, payload = block.partition(b"\r\n\r\n")
    m = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", http)
    return int(m[1]) if m else None, http + gap, payload


def read_arc(spark: SparkSession, folder: str, members: bool = True) -> DataFrame:
    """The records of all ARC files (.arc, .arc.gz) in a folder: page_id, url, date, n
    (bytes of the payload), digest, file, at, member (the record as it is stored in the
    file, null where not asked for) and length (bytes of its body)."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PAGES.types)], schema=_PAGES)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                name, rows, size = path.rsplit("/", 1)[-1], [], 0
                with _stream(path) as f:
                    for at, raw, v, body in parse_arc(f):
                        page, _, payload = _page(body)
                        rows.append((page, v["url"], v["date"], len(payload), hashlib.sha256(payload).hexdigest(), name, at, raw if members else None, len(body)))
                        size += len(raw) if members else 256
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return _files_in(spark, folder, "*.{arc,arc.gz}").mapInArrow(read, _PAGES_DDL)


def arc_body(member: bytes, length: int) -> bytes:
    """The body of a stored record of read_arc()."""
    record = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    return record.partition(b"\n")[2][:length]


def record_id(file: str, at: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORD_SPACE, f'{file}:{at}')}>"


def _stamp(d: str) -> str:
    d = (d + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(spark: SparkSession, arc_folder: str, warc_folder: str) -> None:
    """Writes the ARC records of one folder as WARC files in another.

    Equal payloads of REVISIT_BYTES or more have one response, that of the smallest
    page id (null ids last; then by place, so repeated rows have one too); the rest
    are revisits without payload. Smaller payloads, empty ones included, are
    always responses.
    """
    index = stored(read_arc(spark, arc_folder, members=False).where(F.col("n") >= REVISIT_BYTES).select("page_id", "digest", "file", "at"), "arc-index")
    order = [F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("file").alias("f"), F.col("at").alias("a")]
    firsts = index.groupBy(F.col("digest").alias("d")).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies"))
    # stored, so that a payload of very many pages is a skewed join, which Spark splits
    firsts = stored(firsts.where("copies > 1").select("d", F.col("first.f").alias("first_file"), F.col("first.a").alias("first_at")), "arc-firsts")
    again = index.join(firsts, index["digest"] == firsts["d"]).where("first_file <> file or first_at <> at")
    # a file's marks are no more than its records
    marks = again.groupBy("file").agg(F.collect_list(F.struct("at", "first_file", "first_at")).alias("marks"))
    files = _files_in(spark, arc_folder, "*.{arc,arc.gz}").withColumn("name", F.element_at(F.split("path", "/"), -1))
    n = files.count()
    work = files.join(marks, files["name"] == marks["file"], "left").select("path", "name", "marks")
    work = work.repartition(max(n, 1), "path").sortWithinPartitions("path")

    def head(name: str) -> bytes:
        return _warc({"WARC-Type": "warcinfo", "WARC-Filename": name, "WARC-Record-ID": record_id(name, 0), "WARC-Date": _stamp(""), "Content-Type": "application/warc-fields"}, b"software: twinlens\r\n")

    def write(batches):
        out, n = _File(warc_folder, "", ".warc.gz", head), 0
        for b in batches:
            for path, name, marks in zip(*(c.to_pylist() for c in b.columns)):
                first = {m["at"]: (m["first_file"], m["first_at"]) for m in marks or ()}
                with _stream(path) as f:
                    for at, _, arc, body in parse_arc(f):
                        _, http, payload = _page(body)
                        of = first.get(at)
                        v = {"WARC-Type": "revisit" if of else "response", "WARC-Target-URI": arc["url"], "WARC-Date": _stamp(arc["date"]), "WARC-Record-ID": record_id(name, at), "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type": "application/http; msgtype=response"}
                        if of:
                            v |= {"WARC-Refers-To": record_id(*of), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                        out.add(_warc(v, http if of else body))
                        n += 1
        out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    make_dir(spark, warc_folder)
    work.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    drop_stored(index, firsts)


def _warc(headers: dict[str, str], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_warc(source):
    """(headers, block) of each record of a WARC file, a stream or bytes."""
    for at, _, member in members(source):
        head, _, rest = member.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        v = dict(x.split(": ", 1) for x in lines[1:])
        n = int(v["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where its length says")
        yield v, rest[:n]


_INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("refers", pa.string())])


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """record_id, page_id, url, type, payload_bytes, digest and refers of each
    response and revisit; digests of payloads are taken anew and must agree."""

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX.types)], schema=_INDEX)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with _stream(path) as f:
                    for v, block in parse_warc(f):
                        if v["WARC-Type"] == "warcinfo":
                            continue
                        page, _, payload = _page(block)
                        digest, response = v["WARC-Payload-Digest"].removeprefix("sha256:"), v["WARC-Type"] == "response"
                        if response and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{v['WARC-Record-ID']} has another payload than its digest says")
                        rows.append((v["WARC-Record-ID"], page, v["WARC-Target-URI"], v["WARC-Type"], len(payload) if response else None, digest, v.get("WARC-Refers-To")))
                        if len(rows) >= 10_000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return _files_in(spark, folder, "*.warc.gz").mapInArrow(read, "record_id string, page_id long, url string, type string, payload_bytes long, digest string, refers string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as ARC files, converted to WARC files and read back. Null html is
    an empty payload; repeated rows have a record each, of which one is the response;
    without pages there are no rows; other columns are not read."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    for version in ARC_FIELDS:  # the odd pages as version 2
        write_arc(pages.where((F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(0)) + 1) == version), arc, version)
    convert(spark, arc, warc)
    drop_path(spark, arc)
    records = stored(read_warc(spark, warc), "warc-index")
    # a response refers to itself here, so that no key is null and shared by most rows
    response = F.coalesce("refers", "record_id")
    seen = records.where("type = 'response'").select(F.col("record_id").alias("r"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("n"))
    out = records.withColumn("of", response).join(seen, F.col("of") == F.col("r"), "left")
    to_page = F.when(F.col("type") == "revisit", F.col("to_page"))
    return out.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), to_page.alias("refers_to"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
