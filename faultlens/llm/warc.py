"""WARC archives whose records are Zstandard frames over a dictionary that the archive itself carries.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on its
first records; each record then is one frame, so that it can be read alone. The archives are files
in the shared folder, listed by a stored manifest: what a lost or repeated task left behind is in no
manifest and never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import shared_dir, stored

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records a dictionary is trained on, at most, and of the dictionary itself.
SAMPLE_BYTES, DICT_BYTES = 1_000_000, 32_768
#: An archive is closed after so many bytes.
ARCHIVE_BYTES = 1_000_000_000
LEVEL = 6
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(text: str | None) -> int | None:
    value = text and text.rpartition(":")[2].rstrip(">")
    return None if not value or value == "none" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record: a response with its payload, or a revisit with its HTTP header only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%!#$&'()*+,/:;=?@[]~"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record. A response's digest is taken anew from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or size != len(payload):
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": _page_id(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest, "payload": None if revisit else payload}


def dictionary(samples: list[bytes]):
    """Trained on the samples; if they are too few to train on, their own bytes."""
    import zstandard

    try:
        made = zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        made = zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(level=LEVEL)
    return made


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sample: list[bytes] = []
        size, out, made, done = 0, None, None, []

        def start() -> None:
            nonlocal out, made
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            words = dictionary(sample)
            made = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
            out = store.open_output_stream(path)
            raw = words.as_bytes()
            out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
            done.append([path.removeprefix(root + "/"), 0, 8 + len(raw)])
            for r in sample:
                put(r)
            sample.clear()

        def put(r: bytes) -> None:
            frame = made.compress(r)
            out.write(frame)
            done[-1][1] += 1
            done[-1][2] += len(frame)

        for batch in batches:
            for page, url, html, first, revisit in zip(*[batch.column(k) for k in range(5)], strict=True):
                html = html.as_py()
                r = record(page.as_py(), url.as_py(), b"" if html is None else html.encode("utf-8"), first.as_py(), revisit.as_py())
                if out is None:
                    sample.append(r)
                    size += len(r)
                    if size >= SAMPLE_BYTES:
                        start()
                else:
                    put(r)
                    if done[-1][2] >= ARCHIVE_BYTES:
                        out.close()
                        out, size = None, 0
        if sample:
            start()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write every page as a WARC record; the manifest (path, records, bytes) and the archives' folder.

    pages: page_id, url, html. The payload is the html in UTF-8 (null: empty). Of pages with equal
    payloads of at least min_bytes, the one with the smallest page_id becomes a response and the
    others revisit records that refer to it; below min_bytes all are responses. Rows that repeat the
    smallest page_id with one payload are all responses. A null page_id comes after all others: it
    revisits if another page has its payload, else it is a response. An empty table makes no archive.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("_digest", F.sha1(F.coalesce("html", F.lit(""))))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    same = rows.filter(size >= min_bytes).groupBy("_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("_digest", "first")
    revisit = F.coalesce(F.col("first").isNotNull() & (size >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    marked = rows.join(same, "_digest", "left").select("page_id", "url", "html", "first", revisit.alias("revisit"))
    return stored(marked.mapInArrow(_writer(folder), MANIFEST), "manifest"), folder


def _reader(folder: str):
    def frames(store, path: str) -> Iterator[bytes]:
        import zstandard

        with store.open_input_stream(path) as f:
            magic, size = struct.unpack("<II", f.read(8))
            if magic != SKIPPABLE:
                raise ValueError(f"{path} does not begin with a dictionary")
            d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
            one, parts, rest = d.decompressobj(), [], b""
            while chunk := rest or f.read(1 << 16):
                parts.append(one.decompress(chunk))
                rest = b""
                if one.eof:
                    yield b"".join(parts)
                    rest = one.unused_data
                    one, parts = d.decompressobj(), []
            if any(parts):
                raise ValueError(f"{path} ends inside a record")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()
        names = [c.split()[0] for c in RECORDS.split(", ")]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for data in frames(store, f"{root}/{path}"):
                    rows.append(parse(data))
                    size += len(data)
                    if size >= 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    return read


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives listed: its page, type, payload and digest."""
    n = max(1, manifest.count())
    spread = manifest.select("path").repartition(min(n, 4096))
    return spread.mapInArrow(_reader(folder), RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back: a row per page."""
    return read_archives(*write_archives(pages, min_bytes))
