"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Tasks write gzip members, one record each, straight into the shared folder; a file counts once it
is in the manifest that the job returns, so a retried task leaves nothing behind that is read. The
reader checks every record (framing, length, digests), goes through a file by a moving window and
holds one record or gzip member at a time. After a failed check it searches for the next valid gzip
member or version line, goes on there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_left_join, shared_dir, ship, stored

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/[01]\.\d{1,2}\r\n")
MAGIC = b"\x1f\x8b\x08"
BEGINNING = re.compile(rb"WARC/[01]\.\d{1,2}\r\n|\x1f\x8b\x08")
LONGEST_BEGINNING, LONGEST_HEADER = 16, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_END = b"\r\n\r\n"

#: Up to so many revisits are broadcast to the writers; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record. A revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d%s" % (len(payload), HTTP_END)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]+", " ", url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:x-page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + head.encode("utf-8", "replace") + b"\r\n" + block + HTTP_END


class Window:
    """The bytes of a seekable file, through one window that moves on."""

    def __init__(self, file, size: int, width: int = 1 << 20):
        self.file, self.size, self.width = file, size, width
        self.base, self.held = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes at a place, fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if not (self.base <= at and at + n <= self.base + len(self.held)):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, min(self.width, self.size - at)))
        return self.held[at - self.base : at - self.base + n]

    def next_beginning(self, at: int) -> int:
        """Where the next version line or gzip magic is; the file's size if there is none."""
        while at < self.size:
            block = self.get(at, self.width)
            found = BEGINNING.search(block)
            if found:
                return at + found.start()
            at = self.size if at + len(block) >= self.size else at + len(block) - LONGEST_BEGINNING
        return self.size


def of_bytes(data: bytes) -> Window:
    return Window(io.BytesIO(data), len(data))


def agrees(stated: str, data: bytes) -> bool:
    """Whether a digest of a known algorithm, hexadecimal or base32, is that of data; unknown ones prove nothing."""
    name, sep, value = stated.partition(":")
    name = name.lower().replace("-", "")
    if not sep or name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(name, data, usedforsecurity=False)
    return value.lower() == digest.hexdigest() or value.upper().rstrip("=") == base64.b32encode(digest.digest()).decode().rstrip("=")


def parse(source: Window, at: int) -> tuple[dict, int] | None:
    """The record at a place and where it ends; None if any check fails."""
    if not VERSION_LINE.match(source.get(at, LONGEST_BEGINNING)):
        return None
    n = 4096
    while (end := (head := source.get(at, n)).find(HTTP_END)) < 0:
        if len(head) < n or n >= LONGEST_HEADER:
            return None
        n *= 4
    fields = {}
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, sep, v = line.partition(":")
        if not sep:
            return None
        fields[k.strip().lower()] = v.strip()
    length = fields.get("content-length", "")
    if not length.isdigit() or at + end + 8 + int(length) > source.size:
        return None
    block = source.get(at + end + 4, int(length) + 4)
    if block[-4:] != HTTP_END:
        return None
    block = block[:-4]
    kind, size = fields.get("warc-type"), fields.get("x-payload-length", "")
    http = fields.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(HTTP_END)[2] if http else block
    revisit = kind == "revisit"
    if not agrees(fields.get("warc-block-digest", ""), block) or (not revisit and not agrees(fields.get("warc-payload-digest", ""), payload)):
        return None
    if size and (not size.isdigit() or (not revisit and int(size) != len(payload))):
        return None
    number = lambda k: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(k, ""))) else None
    stated = fields.get("warc-payload-digest")
    return {
        "page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"),
        "payload_bytes": int(size) if size else len(payload), "payload_digest": (stated or "").removeprefix("sha256:") or None if revisit else hashlib.sha256(payload).hexdigest(),
        "record_id": fields.get("warc-record-id"), "stated_digest": stated, "payload": None if revisit else payload,
    }, at + end + 8 + int(length)


def member(source: Window, at: int, most: int) -> tuple[bytes, int] | None:
    """The gzip member at a place, checked by its CRC, and where it ends; fed piece by piece."""
    z, out, size = zlib.decompressobj(31), [], 0
    while not z.eof:
        piece = source.get(at, 1 << 16)
        if not piece:
            return None
        try:
            out.append(z.decompress(piece))
        except zlib.error:
            return None
        at += len(piece)
        size += len(out[-1])
        if size > most:
            return None
    return b"".join(out), at - len(z.unused_data)


def salvage(source: Window | bytes, max_member_mb: float = 2200):
    """Records and gaps of an archive that may mix gzip members and plain records, damaged or not.

    offset and length are places in the file. Of a member with several records or with damage
    inside, they are the member's, and inner_offset and inner_length are places in what it holds.
    A member that holds over max_member_mb is taken for damage, as one member is held in memory.
    """
    source = of_bytes(source) if isinstance(source, bytes) else source
    at, bad = 0, None
    while at < source.size:
        found = None
        if source.get(at, 3) == MAGIC:
            got = member(source, at, int(max_member_mb * 1e6))
            if got is not None:
                inside = list(plain_records(got[0]))
                place = {"offset": at, "length": got[1] - at}
                found = [x | place | ({} if len(inside) == 1 and x["kind"] == "record" else {"inner_offset": x["offset"], "inner_length": x["length"]}) for x in inside], got[1]
        else:
            got = parse(source, at)
            if got is not None:
                found = [got[0] | {"kind": "record", "offset": at, "length": got[1] - at}], got[1]
        if found is None:
            bad = at if bad is None else bad
            at = source.next_beginning(at + 1)
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad}
            bad = None
        yield from found[0]
        at = found[1]
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": source.size - bad}


def plain_records(data: bytes):
    """Records of uncompressed bytes, and gaps."""
    source, at, bad = of_bytes(data), 0, None
    while at < len(data):
        got = parse(source, at)
        if got is None:
            bad = at if bad is None else bad
            found = VERSION_LINE.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad}
            bad = None
        yield got[0] | {"kind": "record", "offset": at, "length": got[1] - at}
        at = got[1]
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad}


def revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of payloads that a smaller page_id has too. pages: page_id, payload, digest. A page_id may occur with several payloads."""
    thin = pages.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return salted_left_join(thin, first, "digest").where("refers_to < page_id").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 100, file_mb: float = 32, level: int = 4, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row; returns the manifest (path, records, bytes).

    Null html: empty payload. Of equal payloads of at least least_bytes the smallest page_id is a
    response, other page_ids are revisits of it; rows that repeat that page_id are responses too,
    and so are rows without an id. That holds for each row: a page_id that comes with several
    payloads is a revisit with one and a response with another. path: a folder that all executors reach (default: one in the
    shared folder). Files are closed at about file_mb of payload.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = path or f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}"
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    again = stored(revisits(p, least_bytes), "revisits")
    p = p.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again.hint("shuffle_merge"), ["page_id", "digest"], "left").select("page_id", "url", "payload", "refers_to", "digest")

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, records, size, raw, made = None, "", 0, 0, 0, []
        for b in batches:
            for page_id, url, payload, refers_to, digest in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size, raw = store.open_output_stream(name, compression=None), 0, 0, 0
                z = zlib.compressobj(level, wbits=31)
                data = z.compress(record(page_id, url, payload, digest, refers_to)) + z.flush()
                out.write(data)
                records, size, raw = records + 1, size + len(data), raw + len(payload)
                if raw >= file_mb * 1e6:
                    out.close()
                    made.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, records, size))
        scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else "file://"
        yield pa.RecordBatch.from_arrays([pa.array([scheme + m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "records", "bytes"])

    return stored(p.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read(files: DataFrame, keep_payload: bool = False, max_member_mb: float = 2200) -> DataFrame:
    """Records and gaps of the archives named in column path of files, damaged files included.

    Columns: path, kind (record or gap), offset, length, inner_offset, inner_length (places inside a
    gzip member with several records or damage), page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (SHA-256; of revisits as stated), record_id and stated_digest as
    they are written and, with keep_payload, payload (null for revisits). Only places are set for
    gaps. The payload of an application/http record is what follows the HTTP header, of others the
    whole block. A gzip member that holds over max_member_mb is taken for damage; the default is
    more than a record of the largest payload that Spark can hold.
    """
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = ["path", "kind", "offset", "length", "inner_offset", "inner_length", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_id", "stated_digest"] + ["payload"] * keep_payload
        text, number = pa.string(), pa.int64()
        types = [text, text, number, number, number, number, number, text, text, number, number, text, text, text, pa.binary()]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types)], names=names)

        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_file(name) as f:
                    for x in salvage(Window(f, f.size()), max_member_mb):
                        if not keep_payload:
                            x.pop("payload", None)
                        rows.append(x | {"path": path})
                        size += len(x.get("payload") or b"")
                        if len(rows) == 500 or size > 1 << 24:
                            yield table(rows)
                            rows, size = [], 0
                yield table(rows)

    schema = "path string, kind string, offset long, length long, inner_offset long, inner_length long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, stated_digest string" + ", payload binary" * keep_payload
    return files.select("path").mapInArrow(run, schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    found = read(manifest.repartition(max(1, min(manifest.count(), 4096)), "path"))
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Digests, types and references by SQL; sha256 takes the UTF-8 bytes.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
r AS (SELECT page_id, n, digest, min(page_id) OVER (PARTITION BY digest) AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first < page_id THEN first END AS refers_to
FROM r
"""
