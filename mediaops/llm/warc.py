"""WARC archives: pages written as records, monolithic gzip files normalised to a member per record, read by index.

A monolithic archive is one gzip stream, which only one task can read and only from its start.  The normaliser inflates
that stream once, rewrites every record as a gzip member of its own and writes a sidecar beside the new archive, one
line per record: offset, length, record type, record id, payload digest, target URI, divided by tabs.  After that any
slice of any archive is read by itself.

Files are written by the tasks through ``pyarrow.fs`` under names that no other attempt uses, and Spark commits a table
of the names; files it does not name are left-overs of lost attempts and are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import partitions, read_table
from mediaops.plans.staging import cut_lineage, scratch_folder

ARCHIVE_BYTES = 256_000_000  # of records before compression; a task starts a new archive beyond it
SLICE_BYTES = 16_000_000  # of compressed records that are read at a time
BROADCAST_GROUPS = 500_000  # at 40 bytes each; beyond it pages find their group by a shuffled join
LEAST_REVISIT = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, sidecar string, n_records long, n_bytes long"
_ARCHIVES = pa.schema([("archive", pa.string()), ("sidecar", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file named as Spark names it."""
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


def mark_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = LEAST_REVISIT, max_broadcast: int = BROADCAST_GROUPS,
) -> DataFrame:
    """page_id, url, payload (binary), digest (SHA-1), record_type, refers_to for every row of ``pages``.

    Of rows with equal payloads of at least ``least`` bytes those with the largest page_id are responses and the others
    revisit them.  Equal means equal SHA-256.  A hot payload is counted per salt before its digest is gathered.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    salts = max(64, pages.count() // 100_000)
    rows = rows.select("*", F.unhex(F.sha1("payload")).alias("digest"), F.unhex(F.sha2("payload", 256)).alias("same"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    parts = rows.filter(F.octet_length("payload") >= least).groupBy("same", "salt").agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("best")
    )
    groups = parts.groupBy("same").agg(F.sum("n").alias("n"), F.max("best").alias("best"), F.collect_set("salt").alias("salts"))
    groups = cut_lineage(groups.filter("n > 1").select("same", "best", "salts", F.lit(True).alias("shared")))
    if groups.count() <= max_broadcast:
        joined = rows.join(F.broadcast(groups.drop("salts")), "same", "left")
    else:
        joined = rows.join(groups.withColumn("salt", F.explode("salts")).drop("salts"), ["same", "salt"], "left")
    revisit = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    return joined.select(
        "page_id", "url", "payload", "digest", kind.alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to")
    )


def record_id(page_id: int | None, digest: bytes) -> str:
    """The name of the response for a page and a payload, which revisits know without reading it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest.hex()}')}>"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(raw).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of its page and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    name = record_id(page_id, digest) if kind == "response" else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{url}/{refers_to}/{digest.hex()}')}>"
    # Control characters and blanks would break the header and the lines of the sidecar.
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    head.append(f"WARC-Payload-Digest: {_digest(digest)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record(name: str) -> bytes:
    body = b"software: mediaops\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>\r\nWARC-Date: {DATE}\r\n"
    head += f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Named fields of a record, names in lower case; a line that begins with white space continues the one before."""
    version, *lines = re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\r\n")
    if not version.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if x)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def inflate(stream: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or of many, read and inflated once."""
    tool = zlib.decompressobj(31)
    while part := stream.read(size):
        while part:
            if tool.eof:
                tool = zlib.decompressobj(31)
            yield tool.decompress(part, 4 * size)
            while tool.unconsumed_tail:
                yield tool.decompress(tool.unconsumed_tail, 4 * size)
            part = tool.unused_data if tool.eof else b""
    if not tool.eof:
        raise ValueError("the gzip stream ends too early")


def split_records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of a stream of records; holds one record and one part at a time."""
    held, wanted = bytearray(), 1
    fields: dict[str, str] | None = None
    head = 0
    for part in parts:
        held += part
        while len(held) >= wanted:
            if fields is None:
                end = held.find(b"\r\n\r\n", max(head - 3, 0))
                if end < 0:
                    head, wanted = len(held), len(held) + 1
                    break
                fields = parse_head(bytes(held[:end]))
                wanted = end + 4 + int(fields["content-length"]) + 4
            else:
                record = bytes(held[:wanted])
                if not record.endswith(b"\r\n\r\n"):
                    raise ValueError(f"record {fields.get('warc-record-id')} does not end where its length says")
                yield fields, record
                del held[:wanted]
                fields, head, wanted = None, 0, 1
    if held or fields is not None:
        raise ValueError("the archive ends inside a record")


def _archive_row(archive: str, sidecar: str | None, n: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((archive, sidecar, n, size), _ARCHIVES)], schema=_ARCHIVES)


def write_monolithic(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write ``rows`` of ``mark_revisits`` as archives that are one gzip stream each; returns the table of the archives.

    A task writes the rows of its partition as they come and holds one batch.  A partition without rows writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path)
        out = None
        for batch in batches:
            for values in zip(*(batch.column(i) for i in range(6))):
                if out is None:
                    name = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, tool = fs.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(level, wbits=31)
                    out.write(tool.compress(info_record(name)))
                    n, size = 0, 0
                record = build_record(*(v.as_py() for v in values))
                out.write(tool.compress(record))
                n, size = n + 1, size + len(record)
                if size >= archive_bytes:
                    out.write(tool.flush())
                    out.close()
                    out = None
                    yield _archive_row(f"{folder}/{name}", None, n, size)
        if out is not None:
            out.write(tool.flush())
            out.close()
            yield _archive_row(f"{folder}/{name}", None, n, size)

    return cut_lineage(rows.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(write, ARCHIVES))


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrite the gzip files named in the column ``archive`` with a member per record and a sidecar each.

    One task inflates one archive, as a gzip stream allows no other way; it holds one record.  Files that already have
    a member per record pass unchanged in content.  Damaged gzip or records end the job with the name of the file.
    """
    count = max(1, archives.count())

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        fs.create_dir(path)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                name = re.sub(r"(-[0-9a-f]{32})?(\.warc)?(\.gz)?$", "", archive.rsplit("/", 1)[-1]) + f"-{uuid.uuid4().hex}.warc.gz"
                source, place = open_folder(archive)
                offset, lines = 0, []
                with source.open_input_stream(place, compression=None) as stream, fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                    try:
                        for fields, record in split_records(inflate(stream)):
                            tool = zlib.compressobj(level, wbits=31)
                            member = tool.compress(record) + tool.flush()
                            out.write(member)
                            named = (fields.get(x, "-") for x in ("warc-type", "warc-record-id", "warc-payload-digest", "warc-target-uri"))
                            lines.append("\t".join([str(offset), str(len(member)), *named]))
                            offset += len(member)
                    except (ValueError, KeyError, zlib.error) as error:
                        raise ValueError(f"{archive}: {error}") from error
                with fs.open_output_stream(f"{path}/{name}.idx", compression=None) as out:
                    out.write(("\n".join(lines) + "\n").encode())
                yield _archive_row(f"{folder}/{name}", f"{folder}/{name}.idx", len(lines), offset)

    dealt = archives.select("archive").repartitionByRange(count, "archive")
    return cut_lineage(dealt.mapInArrow(rewrite, ARCHIVES))


def read_slices(archives: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(archive, begin, lengths) from the sidecars: neighbouring records of about ``slice_bytes`` compressed bytes."""
    fields = pa.schema([("archive", pa.string()), ("begin", pa.int64()), ("lengths", pa.list_(pa.int64()))])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                fs, path = open_folder(sidecar)
                with fs.open_input_stream(path, compression=None) as stream:
                    lines = stream.read().decode().splitlines()
                begin, lengths, size = 0, [], 0
                for at, line in enumerate(lines):
                    offset, length = map(int, line.split("\t", 2)[:2])
                    if not lengths:
                        begin = offset
                    lengths.append(length)
                    size += length
                    if size >= slice_bytes or at == len(lines) - 1:
                        arrays = [pa.array([v], f.type) for v, f in zip((archive, begin, lengths), fields)]
                        yield pa.RecordBatch.from_arrays(arrays, schema=fields)
                        lengths, size = [], 0

    return archives.select("archive", "sidecar").mapInArrow(slices, "archive string, begin long, lengths array<long>")


RECORDS = (
    "archive string, offset long, length long, record_id string, record_type string, target_uri string, page_id long, "
    "refers_to_id string, refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def read_record(member: bytes) -> tuple | None:
    """The columns of ``RECORDS`` behind ``length`` for one gzip member, None for records that are no page."""
    record = zlib.decompress(member, 31)
    head = record.index(b"\r\n\r\n")
    fields = parse_head(record[:head])
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    block = record[head + 4 : head + 4 + int(fields["content-length"])]
    http = block.index(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", block[:http])[1])
    payload = block[http + 4 :] if kind == "response" else None
    if payload is not None and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"damaged payload of {fields['warc-record-id']}")
    number = lambda x: int(x) if x and x != "None" else None
    ids = number(fields.get("x-page")), fields.get("warc-refers-to"), number(fields.get("x-refers-to-page"))
    return (fields["warc-record-id"], kind, fields.get("warc-target-uri"), *ids, size, digest.hex(), payload)


def read_pages(archives: DataFrame, payload: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Records of pages in normalised archives, one row each (``RECORDS``); payloads are checked against their digest.

    Slices of archives are read wherever there is room.  A revisit has no payload but the size and digest of it.
    """
    slices = read_slices(archives, slice_bytes)
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    fields = pa.schema(list(zip([x.split()[0] for x in RECORDS.split(", ")], kinds)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], schema=fields)
        for batch in batches:
            for archive, begin, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, path = open_folder(archive)
                with fs.open_input_file(path) as file:
                    data = file.read_at(sum(lengths), begin)
                at, rows, size = 0, [], 0
                for length in lengths:
                    found = read_record(data[at : at + length])
                    if found is not None:
                        rows.append((archive, begin + at, length, *(found if payload else (*found[:-1], None))))
                        size += found[-3] if payload else 100
                        if size > 8_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
                    at += length
                if rows:
                    yield batch_of(rows)

    dealt = slices.repartitionByRange(partitions(archives.sparkSession), "archive", "begin")
    return dealt.mapInArrow(read, RECORDS)


def pages_through_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write ``pages`` as monolithic archives below ``folder``, normalise them and return the records read back.

    A null html is an empty payload, a null url gets a name made from the id, a null page_id has no id field and comes
    back null; it is the smallest of its group, and a group of such rows has responses only.  Rows that repeat the
    largest page_id of a payload are all responses.  Other repeated rows are records of their own.  Payloads below the
    limit are never revisits.  An empty table writes no archive and gives an empty result; other columns are ignored.
    A payload is one unit of work, held whole, of any length.
    """
    written = write_monolithic(mark_revisits(pages, **columns), f"{folder}/monolithic")
    return read_pages(normalise(written, f"{folder}/records"), payload=False)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    found = pages_through_archives(read_table(spark, sf_dir, "pages"), scratch_folder(spark))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM g
"""
