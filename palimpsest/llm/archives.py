"""Legacy archive converter: ARC files of version 1 or 2 become WARC 1.1 files.

An ARC file begins with a version block (filedesc), whose second line names the version and whose third the fields of
each record's header line: five for version 1, ten for version 2. A record is its header line, as many bytes as the
line's last field declares, and a newline. The converter synthesises for each record a WARC identifier (a UUID of the
record's place and content), the ISO timestamp of its 14-digit date, its type and its digests; a record whose payload
an earlier one has (that with the smallest page_id) becomes a revisit that refers to that one.

op8 writes the pages as ARC files, converts these and reads the WARC files back. All files are made of gzip members,
one a record, in the shared folder; a task writes under a name of its own attempt and moves the finished file to the
partition's name, in place of what a lost attempt has left there, so retries and lost executors do no harm. A task
holds one record at a time.

Results for odd input: null html is an empty payload; null url becomes `about:blank`; null page_id stays null and
comes after all others; of rows that repeat a page_id and payload the first is the response and the rest revisit it;
an empty table gives an empty one; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import arrow_rows, saved, scratch_path, ship, table

V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
LEVEL = 1  # of gzip
MOST_PARTS = 100_000
#: Date of records that tell none.
EPOCH = "20000101000000"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def store_of(path: str):
    """The file system of a folder that all executors share, and the folder's name there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def settle(store, own: str, name: str) -> None:
    """Moves an attempt's finished file to its name; where a store won't move onto a file, that of a lost attempt goes first."""
    try:
        store.move(own, name)
    except OSError:
        store.delete_file(name)
        store.move(own, name)


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(source) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a file, one in memory at a time."""
    offset, left = 0, b""
    while True:
        begin, z, out = offset, zlib.decompressobj(31), []
        while not z.eof:
            left = left or source.read(1 << 18)
            if not left:
                if out or begin != offset:
                    raise ValueError("the archive ends inside a record")
                return
            out.append(z.decompress(left))
            offset += len(left) - len(z.unused_data)
            left = z.unused_data
        yield begin, b"".join(out)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- ARC -------------------------------------------------------------------------------------------------------------


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 palimpsest\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {EPOCH} text/plain "
    line += str(len(body)) if version == 1 else f"200 - - 0 {name} {len(body)}"
    return line.encode() + b"\n" + body


def arc_record(url: str, date: str, content: bytes, version: int, checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "about:blank"
    line = f"{safe} 0.0.0.0 {date} text/html "
    line += str(len(content)) if version == 1 else f"200 {checksum} - {offset} {name} {len(content)}"
    return line.encode("utf-8", "surrogatepass") + b"\n" + content + b"\n"


class ArcReader:
    """Reads the version block, then records as (header fields by name, content)."""

    def __init__(self, version_block: bytes) -> None:
        line, rest = version_block.split(b"\n", 1)
        if not line.startswith(b"filedesc://"):
            raise ValueError("not an ARC file: no version block")
        body = rest[: int(line.rsplit(b" ", 1)[1])].decode()
        self.version = int(body.split(" ", 1)[0])
        self.fields = body.split("\n")[1].split(" ")
        if len(self.fields) != {1: 5, 2: 10}.get(self.version):
            raise ValueError(f"unknown ARC version {self.version}")

    def record(self, data: bytes) -> tuple[dict[str, str], bytes]:
        line, rest = data.split(b"\n", 1)
        values = line.decode("utf-8", "surrogatepass").rsplit(" ", len(self.fields) - 1)
        if len(values) != len(self.fields):
            raise ValueError("the header line has another number of fields than the version block names")
        header = dict(zip(self.fields, values, strict=True))
        n = int(header["Archive-length"])
        if len(rest) < n:
            raise ValueError("the record is shorter than its header line declares")
        return header, rest[:n]


def http_message(page_id: int | None, payload: bytes) -> bytes:
    known = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(message: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, _, payload = message.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:])
    return head + b"\r\n\r\n", fields, payload


# --- WARC ------------------------------------------------------------------------------------------------------------


def iso(date: str) -> str:
    try:
        return datetime.strptime((date + EPOCH[len(date) :])[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return iso(EPOCH)


def warc_id(url: str, date: str, digest: str, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url, date, digest, place)))}>"


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_parts(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if len(rest) < n:
        raise ValueError("the record is shorter than it declares")
    return fields, rest[:n]


def convert(header: dict[str, str], content: bytes, place: str, first: dict | None) -> bytes:
    """The WARC record of an ARC record; first: id, url, date and page_id of the record that has the payload, for a revisit."""
    head, _, payload = http_parts(content)
    url, digest = header["URL"], sha1_base32(payload)
    fields = [("WARC-Record-ID", warc_id(url, header["Archive-date"], digest, place)), ("WARC-Date", iso(header["Archive-date"])), ("WARC-Target-URI", url)]
    fields += [("WARC-IP-Address", header["IP-address"]), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        return warc_record("response", [*fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(content)}")], content)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", first["id"])]
    fields += [("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Date", iso(first["date"])), ("WARC-Block-Digest", f"sha1:{sha1_base32(head)}")]
    if first["page_id"] is not None:
        fields.append(("X-Refers-To-Page-Id", str(first["page_id"])))
    return warc_record("revisit", fields, head)


# --- jobs ------------------------------------------------------------------------------------------------------------

INDEX = "page_id long, url string, date string, digest string, size long, file string, offset long"


def write_arc(pages: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC files; returns the index of their records. Without a version, partitions take turns."""
    ship(pages.sparkSession)
    arrow_rows(pages.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        v, name = version or 1 + part % 2, f"part-{part:06d}.arc.gz"
        store, place = store_of(folder)
        store.create_dir(place, recursive=True)
        own = f"{place}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(own, compression=None) as out:
            out.write(member(arc_version_block(name, v)))
            for b in batches:
                rows = []
                for page_id, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    payload, at = (page or "").encode("utf-8", "surrogatepass"), out.tell()
                    digest = sha1_base32(payload)
                    data = arc_record(url or "", EPOCH, http_message(page_id, payload), v, digest, at, name)
                    out.write(member(data))
                    rows.append((page_id, data.split(b" ", 1)[0].decode("utf-8", "surrogatepass"), EPOCH, digest, len(payload), name, at))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "date", "digest", "size", "file", "offset"])
        settle(store, own, f"{place}/{name}")

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, INDEX)


def arc_to_warc(index: DataFrame, arc_folder: str, warc_folder: str, least: int = 0) -> DataFrame:
    """Converts each ARC file of the index to a WARC file; returns the files' names. Payloads under `least` bytes never make revisits."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "offset", "url", "date")
    first = index.where(F.col("size") >= least).groupBy("digest").agg(F.min(order).alias("first"))
    rows = index.join(first, "digest", "left").where(F.col("first").isNotNull() & ((F.col("first.file") != F.col("file")) | (F.col("first.offset") != F.col("offset"))))
    revisits = rows.select("file", "offset", "digest", F.col("first.page_id").alias("f_page"), F.col("first.url").alias("f_url"), F.col("first.date").alias("f_date"), F.col("first.file").alias("f_file"), F.col("first.offset").alias("f_offset"))
    # Each file's own row comes first (offset -1), so that files without revisits are converted as well.
    files = index.select("file").distinct().select("file", F.lit(-1).cast("long").alias("offset"), *(F.lit(None).cast(t).alias(c) for c, t in (("digest", "string"), ("f_page", "long"), ("f_url", "string"), ("f_date", "string"), ("f_file", "string"), ("f_offset", "long"))))
    # As many partitions as there may be files: the rows are few, so they would else all be put into one.
    n = max(1, min(files.count(), MOST_PARTS))
    work = files.unionByName(revisits).repartition(n, "file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = store_of(arc_folder)
        to_store, to = store_of(warc_folder)
        to_store.create_dir(to, recursive=True)
        out = source = own = name = None
        rest: Iterator[tuple[int, bytes]] = iter(())

        def until(offset: int | None) -> tuple[int, bytes] | None:
            """Converts what comes before a revisit as responses; returns the revisit's own record."""
            for at, data in rest:
                if at == offset:
                    return at, data
                header, content = reader.record(data)
                out.write(member(convert(header, content, f"{name}:{at}", None)))
            return None

        def finish() -> str:
            until(None)
            source.close()
            out.close()
            settle(to_store, own, f"{to}/{name.replace('.arc.', '.warc.')}")
            return name.replace(".arc.", ".warc.")

        def names(done: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

        for b in batches:
            done = []
            for x in (SimpleNamespace(**r) for r in b.to_pylist()):
                if x.offset < 0:
                    if name is not None:
                        done.append(finish())
                    name, own = x.file, f"{to}/.{x.file}.{uuid.uuid4().hex}"
                    source, out = store.open_input_stream(f"{place}/{name}", compression=None), to_store.open_output_stream(own, compression=None)
                    rest = members(source)
                    reader = ArcReader(next(rest)[1])
                    info = f"software: palimpsest\r\nformat: WARC File Format 1.1\r\nconverted-from: {name}\r\n".encode()
                    out.write(member(warc_record("warcinfo", [("WARC-Record-ID", warc_id(name, EPOCH, "", "info")), ("WARC-Date", iso(EPOCH)), ("WARC-Filename", name.replace(".arc.", ".warc.")), ("Content-Type", "application/warc-fields")], info)))
                    continue
                at, data = until(x.offset)
                header, content = reader.record(data)
                known = {"id": warc_id(x.f_url, x.f_date, x.digest, f"{x.f_file}:{x.f_offset}"), "url": x.f_url, "date": x.f_date, "page_id": x.f_page}
                out.write(member(convert(header, content, f"{name}:{at}", known)))
            yield names(done)
        if name is not None:
            yield names([finish()])

    return work.mapInArrow(run, "file string")


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """The response and revisit records of WARC files (a column of names)."""

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "target_uri": pa.string(), "record_id": pa.string(), "record_date": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = store_of(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{place}/{name}", compression=None) as source:
                    for _, data in members(source):
                        fields, block = warc_parts(data)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        _, http, payload = http_parts(block)
                        given = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http["Content-Length"])
                        if fields["WARC-Type"] == "response" and (sha1_base32(payload) != given or len(payload) != size):
                            raise ValueError(f"{name}: a payload does not match its digest or length")
                        number = lambda x: None if x is None else int(x)
                        rows.append((number(http.get("X-Page-Id")), size, given, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-Id")), fields["WARC-Target-URI"], fields["WARC-Record-ID"], fields["WARC-Date"]))
                        if len(rows) == 2000:
                            yield frame(rows)
                            rows = []
                yield frame(rows)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return files.repartition(max(1, min(files.count(), MOST_PARTS)), "file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, record_id string, record_date string")


def through_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    spark = pages.sparkSession
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    index = saved(spark, write_arc(pages, arcs), "arc-index")
    files = saved(spark, arc_to_warc(index, arcs, warcs, least), "warc-files")
    return read_warc(files, warcs)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    letter = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((v >> {shift}) & 31) + 1)::int, 1)"
    return f"""
with p as (select row_number() over () as row, page_id, encode(coalesce(html, '')) as body from pages),
h as (select row, page_id, octet_length(body) as n, sha1(body) as hex from p),
g as (select row, page_id, n, hex, unnest(range(0, 8)) as i from h),
v as (select row, page_id, n, hex, i, ('0x' || substr(hex, (i * 5 + 1)::int, 5))::bigint as v from g),
b as (select row, page_id, n, string_agg({letter(15)} || {letter(10)} || {letter(5)} || {letter(0)}, '' order by i) as digest from v group by row, page_id, n),
r as (select *, min(page_id) over (partition by digest) as first, row_number() over (partition by digest order by page_id nulls last, row) as k from b)
select page_id, n as payload_bytes, digest as payload_digest, case when k = 1 then 'response' else 'revisit' end as record_type,
       case when k = 1 then null else first end as refers_to
from r"""
