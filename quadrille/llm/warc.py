"""WARC archives compressed record by record with Zstandard.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary;
each record is one Zstandard frame of its own, compressed with that dictionary. The
reader loads the dictionary from the leading frame, decodes one frame for each record,
and checks the version line, the header fields, the content length and the digest.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest
page_id is written as a response, the others as revisits that name it and keep the HTTP
header alone. Defined results: a null html is an empty payload; a null page_id is written
without an id and counts as larger than all ids; rows that repeat the smallest page_id
with one payload are each a response. Null urls have no target header. The page_id must
be an integer. Archives are written under names of their own for each attempt; only those
in the manifest, which Spark commits, are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import emit, fresh_path, materialize, open_fs, rows, small_frame, spread_join

MIN_REVISIT = 100
_MAGIC = b"\x5d\x2a\x4d\x18"
_FRAME = b"\x28\xb5\x2f\xfd"
_CRLF = b"\r\n"
ARCHIVE_BYTES = 256 << 20


def mark_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses). Payloads are counted by
    digest before the shuffle; a digest of very many pages, and payloads too short for a
    revisit, are dealt to all tasks."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("key", F.when(F.octet_length("html") >= least, F.col("digest")))
    many = p.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    j = spread_join(p, materialize(many, "digests"), ["key"], "n", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return j.select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"))


def _value(s: str) -> str:
    return s.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: header, blank line, HTTP header and (for responses) payload, end."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_value(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _CRLF * 2 + block + _CRLF * 2


def _headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = data.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header line has no colon: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def parse(data: bytes) -> dict:
    """Checks one record and returns its page_id, url, type, refers_to, digest, length of
    the full payload, and payload (empty for revisits)."""
    head, blank, rest = data.partition(_CRLF * 2)
    version, fields = _headers(head)
    if not blank or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no header {name}")
    n = int(fields["content-length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != _CRLF * 2:
        raise ValueError("the content length is wrong")
    http, blank, payload = block.partition(_CRLF * 2)
    status, told = _headers(http)
    if not blank or not status.startswith("HTTP/"):
        raise ValueError("no HTTP header")
    kind, digest, size = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:"), int(told["content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit has a payload, or names no record")

    def page(urn: str) -> int | None:
        if not (urn.startswith("<urn:page:") and urn.endswith(">")):
            raise ValueError(f"not a record id: {urn[:80]}")
        return int(urn[10:-1]) if urn[10:-1] else None

    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "type": kind, "refers_to": page(fields["warc-refers-to"]) if kind == "revisit" else None, "digest": digest, "size": size, "payload": payload}


def train_dictionary(pages: DataFrame, samples: int = 400, size: int = 16 << 10) -> bytes:
    """A dictionary from the first 16 KiB of at most ``samples`` payloads, those of the pages
    with the smallest hashes of their ids; it decides the size of archives and nothing else.
    Too few samples for training give a raw dictionary of their beginnings (or an empty one)."""
    html = F.substring(F.coalesce(F.col("html").cast("string"), F.lit("")), 1, 16 << 10)
    chosen = pages.select(F.xxhash64("page_id").alias("h"), F.col("page_id").cast("long").alias("i"), html.alias("html")).orderBy("h", "i", "html").limit(samples).collect()
    got = [g for r in chosen if len(g := r["html"].encode("utf-8", "surrogatepass")[: 16 << 10]) >= 16]
    try:
        return zstandard.train_dictionary(size, got).as_bytes()
    except zstandard.ZstdError:
        return b"".join(g[:1024] for g in got[:16])


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(marked: DataFrame, dictionary: bytes, folder: str | None = None, level: int = 3) -> DataFrame:
    """Writes the rows of ``mark_revisits`` to archives; returns the manifest."""
    folder = folder or fresh_path(marked.sparkSession, "warc")
    shared = marked.sparkSession.sparkContext.broadcast(dictionary)  # of bounded size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        words = shared.value
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_content_size=True, write_checksum=True)

        def found():
            out = None
            for r in rows(batches):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, n, size = fs.open_output_stream(f"{top}/{name}"), 0, 0
                    out.write(_MAGIC + len(words).to_bytes(4, "little") + words)
                frame = press.compress(record(*r))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield f"{folder}/{name}", n, size
                    out = None
            if out:
                out.close()
                yield f"{folder}/{name}", n, size

        return emit(found(), MANIFEST, 1)

    made = marked.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long, bytes long")
    return materialize(made, "manifest", f"{folder}/manifest")


def iter_archive(stream) -> Iterator[dict]:
    """Records of an archive, read from a file object in pieces: each frame is decoded
    alone, and memory holds one record and one piece."""
    head = stream.read(8)
    if head[:4] != _MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    n = int.from_bytes(head[4:], "little")
    words = stream.read(n)
    if len(words) != n:
        raise ValueError("the dictionary is cut short")
    if words[:4] == _FRAME:  # a dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    data = stream.read(1 << 20)
    while data:
        if data[:4] != _FRAME[: len(data[:4])]:
            raise ValueError("not a Zstandard frame")
        frame, parts = unpress.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data
                break
            data = stream.read(1 << 20)
            if not data:
                raise ValueError("a frame is cut short")
        yield parse(b"".join(parts))
        data = data or stream.read(1 << 20)


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_archives(manifest: DataFrame) -> DataFrame:
    """Reads every archive of a manifest; one row a record."""
    plan = [(m["path"], m["records"]) for m in manifest.collect()]  # one row a file

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for path, records in rows(batches):
                fs, at = open_fs(path)
                n = 0
                with fs.open_input_stream(at) as f:
                    for n, r in enumerate(iter_archive(f), 1):
                        yield r["page_id"], r["size"], r["digest"], r["type"], r["refers_to"], r["url"]
                if n != records:
                    raise ValueError(f"{path} has {n} records, its manifest {records}")

        return emit(found(), READ)

    return small_frame(manifest.sparkSession, plan, "path string, records long").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
