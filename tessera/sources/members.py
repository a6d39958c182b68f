"""Folders and archives (zip, tar, tar.gz, tar.bz2, tar.xz) as a Spark data source: a row per file.

What an archive is, its first bytes say. The directory at the end of a zip and the headers of a tar
give the place of each member without reading the others, so ranges of members are partitions of
their own and one large archive is read by many tasks; conditions on the path choose members before
any is read. A compressed tar has no places to jump to and is read by one task, in one go.

The module imports nothing of the package: Spark plans data sources in a process that may not have it.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import os
import re
import struct
import sys
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "tessera_members"
LISTED = "source string, kind string, path string, length long, offset long, packed long, method int, crc long"
WITH_CONTENT = "path string, length long, content binary"
CHUNK = 1 << 20
#: The first bytes of archives.
BEGINNINGS = {b"PK\x03\x04": "zip", b"PK\x05\x06": "zip", b"\x1f\x8b": "gz", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz"}


class Member(NamedTuple):
    """source: the archive, or the folder; offset, packed: where its bytes are and how many; method: 0 stored, 8 deflated, others by zipfile; crc: -1 unknown."""

    source: str
    kind: str
    path: str
    length: int
    offset: int = 0
    packed: int = 0
    method: int = 0
    crc: int = -1


def opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def kind_of(store, path: str) -> str | None:
    """zip, tar, gz, bz2 or xz by a file's content; folder; None for anything else."""
    from pyarrow import fs

    info = store.get_file_info(path)
    if info.type == fs.FileType.Directory:
        return "folder"
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    with store.open_input_file(path) as f:
        head = f.read(512)
    found = next((k for b, k in BEGINNINGS.items() if head.startswith(b)), None)
    return found or ("tar" if head[257:262] == b"ustar" or (len(head) == 512 and not head.strip(b"\0")) else None)


def unpacking(f, kind: str):
    """The unpacked bytes of a file that may be several compressed pieces behind one another."""
    return gzip.GzipFile(fileobj=f) if kind == "gz" else (bz2.BZ2File if kind == "bz2" else lzma.LZMAFile)(f)


def listed(uri: str) -> Iterator[Member]:
    """The files of a folder or an archive, without their contents (a compressed tar has to be unpacked for it)."""
    from pyarrow import fs

    store, base = opened(uri)
    kind = kind_of(store, base)
    if kind is None:
        raise TypeError(f"no folder and no known archive: {uri}")
    if kind == "folder":
        for f in store.get_file_info(fs.FileSelector(base, recursive=True)):  # hidden ones too, which Spark's sources pass over
            if f.type == fs.FileType.File:
                yield Member(uri, kind, f.path[len(base.rstrip("/")) + 1 :], f.size, 0, f.size)
        return
    with store.open_input_file(base) as f:
        if kind == "zip":
            with zipfile.ZipFile(f) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield Member(uri, kind, i.filename, i.file_size, i.header_offset, i.compress_size, i.compress_type, i.CRC)
        elif kind == "tar":
            with tarfile.open(fileobj=f, mode="r:") as t:
                for i in t:
                    if i.isreg():
                        yield Member(uri, kind, i.name, i.size, i.offset_data, i.size)
        else:
            with tarfile.open(fileobj=unpacking(f, kind), mode="r|") as t:
                for i in t:
                    if i.isreg():
                        yield Member(uri, kind, i.name, i.size, i.offset_data, 0)


def pieces(members: list[Member]) -> Iterator[tuple[Member, Iterator[bytes]]]:
    """Members with their contents in pieces; each has to be taken before the next. Damage raises."""
    at: tuple[str, object] | None = None
    for m in members:
        if m.kind == "folder":
            store, base = opened(m.source)
            with store.open_input_stream(f"{base}/{m.path}", compression=None) as f:
                yield m, iter(lambda f=f: f.read(CHUNK), b"")
            continue
        if at is None or at[0] != m.source:
            store, base = opened(m.source)
            f = store.open_input_file(base)
            at = (m.source, f if m.kind in ("zip", "tar") else tarfile.open(fileobj=unpacking(f, m.kind), mode="r|"))
        if m.kind == "zip":
            yield m, unzipped(at[1], m)
        elif m.kind == "tar":
            yield m, stretch(at[1], m.offset, m.packed)
        else:  # forward only: members come in the order they have in the archive
            info = next(i for i in at[1] if i.offset_data == m.offset)
            inner = at[1].extractfile(info)
            yield m, iter(lambda inner=inner: inner.read(CHUNK), b"")


def stretch(f, offset: int, n: int) -> Iterator[bytes]:
    f.seek(offset)
    while n and (piece := f.read(min(CHUNK, n))):
        n -= len(piece)
        yield piece
    if n:
        raise EOFError(f"the archive ends {n} bytes early")


def unzipped(f, m: Member) -> Iterator[bytes]:
    """A zip member from its local header on, checked by its CRC."""
    f.seek(m.offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no header for {m.path}")
    flags, = struct.unpack("<H", head[6:8])
    name, extra = struct.unpack("<HH", head[26:30])
    if m.method not in (0, 8) or flags & 1:
        with zipfile.ZipFile(f) as z, z.open(m.path) as inner:
            yield from iter(lambda: inner.read(CHUNK), b"")
        return
    unpack, crc = zlib.decompressobj(-15) if m.method == 8 else None, 0
    for piece in stretch(f, m.offset + 30 + name + extra, m.packed):
        piece = unpack.decompress(piece) if unpack else piece
        crc = zlib.crc32(piece, crc)
        yield piece
    rest = unpack.flush() if unpack else b""
    if zlib.crc32(rest, crc) != m.crc:
        raise zipfile.BadZipFile(f"bad CRC of {m.path}")
    if rest:
        yield rest


ENTRY, ENTRY_BYTES = "<4sHHHHHHLLLHHHHHLL", 46  # of a zip's directory; name, extra and comment follow
FULL = 0xFFFFFFFF  # the number is a longer one, in the extra


def directory(f) -> tuple[int, int, int]:
    """Where a zip's directory begins, its bytes, and what its offsets lack (bytes put before the archive)."""
    size = f.size()
    f.seek(max(0, size - (1 << 16) - 22))
    tail = f.read()
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise zipfile.BadZipFile("no end of a directory")
    length, offset = struct.unpack_from("<LL", tail, end + 12)
    at = size - len(tail) + end
    if at >= 76:
        f.seek(at - 76)
        longer = f.read(76)
        if longer[56:60] == b"PK\x06\x07" and longer[:4] == b"PK\x06\x06":
            length, offset = struct.unpack_from("<QQ", longer, 40)
            at -= 76
    return at - length, length, at - length - offset


def ranges(f, start: int, length: int, most: float, rows: int) -> Iterator[tuple[int, int]]:
    """(begin, bytes) of stretches of whole entries of a directory, of at most `rows` entries or about `most` bytes of files. Only lengths are looked at."""
    at = begin = start
    n, size, held, base = 0, 0.0, b"", start
    while at < start + length:
        if at + ENTRY_BYTES > base + len(held):
            f.seek(at)
            held, base = f.read(min(1 << 24, start + length - at)), at
        if held[at - base : at - base + 4] != b"PK\x01\x02" or at + ENTRY_BYTES > base + len(held):
            raise zipfile.BadZipFile("a damaged directory")
        packed, own, *more = struct.unpack_from("<LLHHH", held, at - base + 20)
        if n and (n >= rows or size + max(packed, own) > most):
            yield begin, at - begin
            begin, n, size = at, 0, 0.0
        n, size = n + 1, size + max(packed, own)
        at += ENTRY_BYTES + sum(more)
    if at > begin:
        yield begin, at - begin


def entries(uri: str, data: bytes, shift: int) -> Iterator[Member]:
    """The files of a stretch of a directory."""
    at = 0
    while at < len(data):
        _, _, _, flags, method, _, _, crc, packed, length, nl, el, cl, _, _, _, offset = struct.unpack_from(ENTRY, data, at)
        at += ENTRY_BYTES
        raw, extra = data[at : at + nl], data[at + nl : at + nl + el]
        at += nl + el + cl
        name = raw.decode("utf-8" if flags & 0x800 else "cp437")
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            own, extra = extra[4 : 4 + n], extra[4 + n :]
            if kind == 1:
                values = iter(struct.unpack(f"<{len(own) // 8}Q", own[: len(own) // 8 * 8]))
                length = next(values) if length == FULL else length
                packed = next(values) if packed == FULL else packed
                offset = next(values) if offset == FULL else offset
            elif kind == 0x7075 and len(own) > 5 and own[0] == 1 and struct.unpack_from("<L", own, 1)[0] == zlib.crc32(raw):
                name = own[5:].decode()
        name = name.split("\0", 1)[0]
        if not name.endswith("/"):
            yield Member(uri, "zip", name, length, offset + shift, packed, method, crc)


class Range(InputPartition):
    """Members, or a stretch of a zip's directory that the task reads: archive, where it begins, bytes, shift of its offsets."""

    def __init__(self, members: list[Member], place: tuple[str, int, int, int] | None = None):
        self.members, self.place = members, place


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = json.loads(options["sources"])
        self.names = set(json.loads(options["names"])) if options.get("names") else None
        self.content = options.get("content", "true") == "true"
        self.most = float(options.get("partition_mb", 32)) * 1e6
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]):
        """Conditions on the path choose members before they are read."""
        for f in filters:
            test = self._test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    @staticmethod
    def _test(f: Filter):
        if getattr(f, "attribute", None) != ("path",):
            return None
        if isinstance(f, EqualTo):
            return lambda p: p == f.value
        if isinstance(f, In):
            values = set(f.value)
            return lambda p: p in values
        return next(((lambda p, m=m: m(p, f.value)) for c, m in ((StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)) if isinstance(f, c)), None)

    def _wanted(self, path: str) -> bool:
        return (self.names is None or re.sub(".*/", "", path) in self.names) and all(t(path) for t in self.tests)

    def partitions(self) -> list[Range]:
        """Ranges of neighbours in an archive, of at most partition_mb packed and unpacked; a compressed tar is one. Of a zip only lengths of entries are read here."""
        out = []
        for uri in self.sources:
            store, base = opened(uri)
            if kind_of(store, base) == "zip":
                with store.open_input_file(base) as f:
                    start, length, shift = directory(f)
                    out += [Range([], (uri, begin, n, shift)) for begin, n in ranges(f, start, length, self.most if self.content else float("inf"), 4096 if self.content and self.names is None else 1 << 15)]
                continue
            part, size = [], 0
            for m in listed(uri):
                if not self._wanted(m.path):
                    continue
                if part and self.content and m.kind in ("zip", "tar", "folder") and (size + max(m.packed, m.length) > self.most or len(part) >= 4096):
                    out.append(Range(part))
                    part, size = [], 0
                part.append(m)
                size += max(m.packed, m.length)
            if part:
                out.append(Range(part))
        return out or [Range([])]

    def read(self, partition: Range):
        found = partition.members
        if partition.place is not None:
            uri, begin, n, shift = partition.place
            store, base = opened(uri)
            with store.open_input_file(base) as f:
                f.seek(begin)
                found = [m for m in entries(uri, f.read(n), shift) if self._wanted(m.path)]
        if not self.content:
            yield from (tuple(m) for m in found)
            return
        for m, data in pieces(found):
            yield m.path, m.length, b"".join(data)


class Members(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return WITH_CONTENT if self.options.get("content", "true") == "true" else LISTED

    def reader(self, schema):
        return Reader(dict(self.options))


def members(spark, origin: str, content: bool = True, names: tuple[str, ...] = (), partition_mb: float = 32):
    """The files of a folder, an archive or (by a pattern) of several: (path, length, content), or without content their places.

    names: only files of these names, whatever their folders.
    """
    origin = origin if "://" in origin else os.path.abspath(origin)
    sources = [origin]
    if re.search(r"[*?\[]", origin):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(origin)
        sources = sorted(f.getPath().toString() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or [])
    spark.dataSource.register(Members)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).option("sources", json.dumps(sources)).option("content", str(content).lower()).option("partition_mb", partition_mb)
    return (reader.option("names", json.dumps(names)) if names else reader).load()
