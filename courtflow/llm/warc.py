"""WARC archives: writing, normalising monolithic gzip streams, and reading by offset.

An archive that is one gzip stream can only be read from its start.  The
normaliser inflates such a stream once, record by record, writes every record as
a gzip member of its own, and leaves an index of offsets beside the new archive.
Any record can then be read alone.  The normaliser holds one record at a time, the
writer the batch of rows that it was given, the reader some megabytes.

Archives lie in a folder that all executors share.  A task's files carry its
attempt in their names and only those of attempts that ended are listed, so lost
and repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.tables import keep, shared_folder

#: Payloads of fewer bytes are never revisits.
REVISIT_FROM = 1000
#: Bytes of records after which a new archive begins.
ARCHIVE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDED = "2000-01-01T00:00:00Z"
READ = 1 << 20
#: Bytes of blocks that the reader holds before it passes them on.
YIELD = 8 << 20


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (SHA-1 of the payload), record_type and refers_to of every page.

    Of pages with equal payloads of at least ``REVISIT_FROM`` bytes the one with
    the largest page_id is a response and the others revisit it; pages that share
    that page_id are all responses.  Null html is an empty payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= REVISIT_FROM
    heads = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    revisit = long & F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return rows.join(heads, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head")).alias("refers_to")
    )


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP header of its payload only."""
    head = {
        "WARC-Type": record_type, "WARC-Record-ID": _urn(page_id), "WARC-Date": RECORDED,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if record_type == "revisit":
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _urn(refers_to)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def records(stream) -> Iterator[bytes]:
    """The records of a gzip stream, of one or several members, inflated once from start to end."""
    unzip, pending, out = zlib.decompressobj(31), b"", bytearray()
    need = None
    while True:
        # A record is complete with its header, its block and two line ends.
        if need is None and (at := out.find(b"\r\n\r\n")) >= 0:
            length = re.search(rb"(?im)^content-length:\s*(\d+)", out[:at])
            if length is None:
                raise ValueError("a record without Content-Length")
            need = at + 4 + int(length[1]) + 4
        if need is not None and len(out) >= need:
            yield bytes(out[:need])
            del out[:need]
            need = None
            continue
        if not pending:
            pending = stream.read(READ)
            if not pending:
                break
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        out += unzip.decompress(pending, READ)
        pending = unzip.unconsumed_tail or unzip.unused_data
    if out or not unzip.eof and unzip.unconsumed_tail:
        raise ValueError("the archive ends within a record")


def _member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open_folder(uri: str):
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path, recursive=True)
    return files, path


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``mark_revisits`` as whole-file gzip streams; returns name and records of each archive."""

    def write(batches):
        files, path = _open_folder(folder)
        attempt = TaskContext.get().taskAttemptId()
        name, sink, zipper, held, size, serial = None, None, None, 0, 0, 0
        listed = {"archive": [], "records": []}

        def close():
            sink.write(zipper.flush())
            sink.close()
            listed["archive"].append(name)
            listed["records"].append(held)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if sink is None:
                    name = f"stream-{attempt:08d}-{serial:04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    sink, zipper = files.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    serial, held, size = serial + 1, 0, 0
                data = record_bytes(**row)
                sink.write(zipper.compress(data))
                held, size = held + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": pa.array(listed["archive"], pa.string()), "records": pa.array(listed["records"], pa.int64())})

    return keep(pages.mapInArrow(write, "archive string, records long"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive with a gzip member per record and an index beside it.

    Returns the index rows: archive (new name), offset, length, record_id and
    record_type.  The index file has the same, a JSON object per line.
    """

    def rewrite(batches):
        files, path = _open_folder(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                new = f"records-{name.removeprefix('stream-').removesuffix('.warc.gz')}-{attempt:08d}.warc.gz"
                index = {"archive": [], "offset": [], "length": [], "record_id": [], "record_type": []}
                at = 0
                with (
                    files.open_input_stream(f"{path}/{name}", compression=None) as source,
                    files.open_output_stream(f"{path}/{new}", compression=None) as sink,
                    files.open_output_stream(f"{path}/{new}.idx", compression=None) as sidecar,
                ):
                    for data in records(source):
                        head, _ = parse_record(data)
                        packed = _member(data)
                        sink.write(packed)
                        line = {"archive": new, "offset": at, "length": len(packed), "record_id": head["warc-record-id"], "record_type": head["warc-type"]}
                        sidecar.write((json.dumps(line) + "\n").encode())
                        for k, v in line.items():
                            index[k].append(v)
                        at += len(packed)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64() if k in ("offset", "length") else pa.string()) for k, v in index.items()})

    # Each name is listed once; a ``distinct`` here would let its own shuffle replace the one asked for.
    names = archives.select("archive")
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(names.repartition(parts, "archive").mapInArrow(rewrite, "archive string, offset long, length long, record_id string, record_type string"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read each record by its offset: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload and intact.

    Bytes and digest of a response are those of the payload that was read; ``intact``
    tells whether its headers say the same.  A revisit has no payload (null) and the
    bytes and digest of its headers.
    """

    def page_of(urn: str | None):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def read(batches):
        files, path = _open_folder(folder)
        name, source = None, None
        for batch in batches:
            out, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, files.open_input_file(f"{path}/{archive}")
                head, block = parse_record(zlib.decompress(source.read_at(length, offset), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                told = (int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1]), base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex())
                whole = head["warc-type"] == "response"
                seen = (len(payload), hashlib.sha1(payload).hexdigest()) if whole else told
                out.append({
                    "page_id": page_of(head["warc-record-id"]), "url": head["warc-target-uri"], "payload_bytes": seen[0], "payload_digest": seen[1],
                    "record_type": head["warc-type"], "refers_to": page_of(head.get("warc-refers-to")), "payload": payload if whole else None, "intact": seen == told,
                })
                held += len(block)
                if held > YIELD:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, kind)

    kind = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()),
    ])
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean")


def archive_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as WARC, normalise the archives and read them back by their index.

    Every row of ``pages`` (page_id, url, html) gives one record, repeated rows
    and rows without page_id too; an empty table gives none.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(normalise(write_archives(mark_revisits(pages), folder), folder), folder)
