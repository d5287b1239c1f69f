"""WARC archives: writing captures and assembling them from their records.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; request and metadata name the
response's record in WARC-Concurrent-To.  Records are single gzip members, so a file is read record by record.  Each task writes one
file under a name of its own attempt and returns it; only returned names count, so lost or repeated attempts leave no trace.
"""

import base64
import hashlib
import uuid
import zlib
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.folders import opened, shared_folder
from ridgeline.session import staged

LEAST_BYTES = 0  # a smaller payload is never replaced by a revisit
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
READ_BYTES = 1 << 18
RECORD = ("record_id string, type string, concurrent_to string, uri string, digest string, payload_bytes long, "
          "fields map<string,string>, block binary")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in (*headers, ("Content-Length", str(len(block))))]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{''.join(lines)}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _one_line(value) -> str:
    return " ".join(str(value or "").split())


def capture_records(page_id, url, payload: bytes, digest: str, original) -> list[bytes]:
    """Request, response or revisit, and metadata record of one page; original: the page whose response it revisits, or None."""
    uri = _one_line(url)
    try:
        parts = urlsplit(uri)
    except ValueError:  # not an address: ask for the root of no host
        parts = urlsplit("")
    response, common = f"<urn:uuid:{uuid.uuid4()}>", [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    to_it = [("WARC-Concurrent-To", response)]

    def head(kind):
        return [("WARC-Type", kind), ("WARC-Record-ID", response if kind in ("response", "revisit") else f"<urn:uuid:{uuid.uuid4()}>")]

    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    asked = f"GET {path} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    http = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    kept = f"page_id: {'' if page_id is None else page_id}\r\n"
    if original is None:
        body = _record([*head("response"), *common, *http], answer + payload)
    else:
        kept += f"refers_to: {original}\r\n"
        body = _record([*head("revisit"), *common, *http, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Date", DATE)], answer)
    return [_record([*head("request"), *common, *to_it, ("Content-Type", "application/http; msgtype=request")], asked), body,
            _record([*head("metadata"), *common, *to_it, ("Content-Type", "application/warc-fields")], kept.encode())]


def _write(batches, folder):
    store = out = None
    count, path = 0, f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                store, where = opened(path)
                store.create_dir(where.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(where, compression=None)
            digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
            records = capture_records(row["page_id"], row["url"], (row["html"] or "").encode(), digest, row["original"])
            out.write(b"".join(records))
            count += len(records)
    if out is not None:
        out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages(page_id, url, html, ...) below folder; returns the files (path, records).

    Of pages with equal payloads of least_bytes or more, the one with the largest page_id becomes a response, the others revisits of
    it.  A null html is an empty payload, a null url an empty address, a page without an id revisits another if there is one.  A row
    repeated with the same id is captured each time, with the same type.  Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    hashed = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keepers = (hashed.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper")))
    marked = hashed.join(keepers, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("original"))
    return staged(marked.mapInArrow(partial(_write, folder=folder), "path string, records long"))


def _members(source):
    """Uncompressed gzip members of an open file, one after the other."""
    raw = source.read(READ_BYTES)
    while raw:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not raw:
                raise EOFError("a record is cut off")
            parts.append(unpack.decompress(raw))
            raw = unpack.unused_data or (b"" if unpack.eof else source.read(READ_BYTES))
        yield b"".join(parts)
        raw = raw or source.read(READ_BYTES)


def _fields(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw.decode("utf-8", "replace").split("\r\n") if line)


def parsed(member: bytes, blocks: bool) -> dict:
    """One record as a row; the digest and size of a response are those of the payload found, checked against its header."""
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = _fields(head.partition(b"\r\n")[2])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    kind, digest, size, fields = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, None, {}
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = _fields(http.partition(b"\r\n")[2])
        size = int(fields["Content-Length"])
        if kind == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError("a payload differs from its digest")
        block = payload
    elif kind == "metadata":
        fields = _fields(block)
    return {"record_id": headers["WARC-Record-ID"], "type": kind, "concurrent_to": headers.get("WARC-Concurrent-To"),
            "uri": headers.get("WARC-Target-URI"), "digest": digest, "payload_bytes": size, "fields": list(fields.items()),
            "block": block if blocks else None}


_RECORD_SCHEMA = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("uri", pa.string()),
                            ("digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
                            ("block", pa.binary())])


def _read(batches, blocks, most_rows=256):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, where = opened(path)
            with store.open_input_stream(where, compression=None) as source:
                rows = []
                for member in _members(source):
                    rows.append(parsed(member, blocks))
                    if len(rows) == most_rows:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _RECORD_SCHEMA)


def read_records(files: DataFrame, blocks: bool = True) -> DataFrame:
    """All records of the files (path, ...), one row each; without blocks their contents stay behind."""
    spread = files.select("path").repartition(max(1, files.count()))  # a file to a task
    return spread.mapInArrow(partial(_read, blocks=blocks), RECORD)


def assembled(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, uri, request, response, metadata), joined through concurrent-to identifiers.

    `response` holds the response or revisit record.  A request or metadata record whose response is missing makes a capture without
    response; several requests or metadata records of one response make a row for each combination.
    """
    def part(name, *types):
        key = "record_id" if name == "response" else "concurrent_to"
        return (records.where(F.col("type").isin(*types))
                .select(F.coalesce(key, "record_id").alias("capture_id"), F.struct(*records.columns).alias(name)))

    joined = (part("response", "response", "revisit").join(part("request", "request"), "capture_id", "full")
              .join(part("metadata", "metadata"), "capture_id", "full"))
    return joined.select("capture_id", F.coalesce("response.uri", "request.uri", "metadata.uri").alias("uri"), "request", "response",
                         "metadata")


def captures(pages: DataFrame, least_bytes: int = LEAST_BYTES, blocks: bool = True) -> DataFrame:
    """Archives of all pages in a new shared folder, read back as nested captures; without blocks their contents stay behind."""
    files = write_archives(pages, shared_folder(pages.sparkSession, "warc"), least_bytes)
    return assembled(read_records(files, blocks))


def page_digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its capture.

    A revisit finds the page it refers to by the payload digest of the responses in the archives.
    """
    files = write_archives(pages, shared_folder(pages.sparkSession, "warc"))
    records = staged(read_records(files, blocks=False))  # the archives are read once, for all three sides of the join
    found = assembled(records).select(
        F.expr("try_cast(metadata.fields['page_id'] as bigint)").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("response.type").alias("record_type"))
    found = staged(found)
    originals = (found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("page_id").alias("original")))
    return found.join(originals, "payload_digest", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("original")).alias("refers_to"))
