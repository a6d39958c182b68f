"""Archives written by many tasks: each packs its files into a part, one step joins the parts.

A part of a zip is a zip; joined, their bytes up to the directories stand behind one another and one
directory names all. A part of a tar is a piece of one, compressed by itself: gzip, bzip2 and xz all
read compressed pieces that follow each other as one. The step that joins copies bytes and never holds
a file, and the archive gets its name once it is whole.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import tarfile
import uuid
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WorkspaceError
from ..functions.leaves import working_folder
from ..functions.shipping import ship
from .members import directory
from .workspace import CHUNK, Layout, _opened

KINDS = {".zip": "zip", ".tar": "tar", ".gz": "gz", ".bz2": "bz2", ".xz": "xz"}


class Out:
    """A stream that can be written and told, but not rewound: so zip members have their lengths behind them."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


class In:
    """Pieces as a file to read."""

    def __init__(self, pieces):
        self.pieces, self.held = iter(pieces), b""

    def read(self, n: int) -> bytes:
        while len(self.held) < n and (piece := next(self.pieces, b"")):
            self.held += piece
        out, self.held = self.held[:n], self.held[n:]
        return out


def compressed(kind: str, out):
    """A file that compresses into another; closing it ends the piece, not the file below."""
    return {"gz": lambda: gzip.GzipFile(fileobj=out, mode="wb", mtime=0), "bz2": lambda: bz2.BZ2File(out, "wb"), "xz": lambda: lzma.LZMAFile(out, "wb")}[kind]()


class Part:
    """One part being written."""

    def __init__(self, kind: str, stream):
        self.kind, self.out = kind, Out(stream)
        self.inner = self.out if kind in ("zip", "tar") else compressed(kind, self.out)
        self.archive = zipfile.ZipFile(self.out, "w") if kind == "zip" else tarfile.open(fileobj=self.inner, mode="w:")

    def add(self, member: str, size: int, pieces) -> None:
        if self.kind == "zip":
            info = zipfile.ZipInfo(member)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            with self.archive.open(info, "w", force_zip64=size >= 1 << 31) as f:
                for piece in pieces:
                    f.write(piece)
            if info.file_size != size:
                raise WorkspaceError(f"{member} has {info.file_size} bytes instead of {size}")
        else:
            info = tarfile.TarInfo(member)
            info.size, info.mode = size, 0o644
            self.archive.addfile(info, In(pieces))  # raises if there are fewer bytes

    def close(self) -> None:
        if self.kind == "zip":
            self.archive.close()
        elif self.inner is not self.out:
            self.inner.close()  # the tar itself is not ended: more parts follow


def write_archive(rows: DataFrame, target: str, kind: str, root: str | None = None, layout: Layout = Layout()) -> int:
    """Write (member, content, job_id, path, length) as an archive; returns the number of members.

    Where content is null, the file `path` of the job below root is streamed. Tasks pack, in parts
    below the shared folder.
    """
    spark = rows.sparkSession
    ship(spark)
    folder = working_folder(spark)

    def run(batches):
        import pyarrow as pa

        to, home = _opened(folder)
        to.create_dir(home, recursive=True)
        name = f"{home}/{uuid.uuid4().hex}"
        n = 0
        with to.open_output_stream(name, compression=None) as stream:
            part = Part(kind, stream)
            for b in batches:
                for member, content, job, path, length in zip(*(c.to_pylist() for c in b.columns)):
                    n += 1
                    if content is not None:
                        part.add(member, len(content), [content])
                        continue
                    store, base = _opened(root)
                    with store.open_input_stream(f"{base}/{layout.workspace}/{job}/{path}", compression=None) as f:
                        part.add(member, length, iter(lambda: f.read(CHUNK), b""))  # noqa: B023
            part.close()
        data = part.archive.start_dir if kind == "zip" else None
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([data], pa.int64())], names=["name", "n", "data"])

    parts = [r for r in rows.select("member", "content", "job_id", "path", "length").mapInArrow(run, "name string, n long, data long").collect() if r["n"]]  # one row a task
    if kind == "zip" and parts:
        begins = [0]
        for r in parts:
            begins.append(begins[-1] + r["data"])
        shifted = spark.createDataFrame([(r["name"], b) for r, b in zip(parts, begins)], "name string, begin long").repartition(len(parts))
        shifted.mapInArrow(lambda batches: _directories(batches, folder), "n long").agg(F.sum("n")).collect()
    (store, _), (to, at) = _opened(folder), _opened(target)
    try:
        with to.open_output_stream(f"{at}.part", compression=None) as stream:
            join(store, parts, kind, Out(stream))
        to.move(f"{at}.part", at)
    except BaseException:
        from pyarrow import fs

        if to.get_file_info(f"{at}.part").type != fs.FileType.NotFound:
            to.delete_file(f"{at}.part")
        raise
    finally:
        for r in parts:
            store.delete_file(r["name"])
            if kind == "zip":
                store.delete_file(f"{r['name']}.dir")
    return sum(r["n"] for r in parts)


def _directories(batches, folder: str):
    """Writes beside each part of a zip its directory, with the places that its members will have: (name, begin) rows."""
    import pyarrow as pa

    store, _ = _opened(folder)
    for b in batches:
        for name, begin in zip(*(c.to_pylist() for c in b.columns)):
            with store.open_input_file(name) as f, zipfile.ZipFile(f) as part:
                found = part.infolist()
            with store.open_output_stream(f"{name}.dir.all", compression=None) as stream, zipfile.ZipFile(Out(stream), "w") as whole:
                for m in found:
                    m.header_offset += begin
                    whole.filelist.append(m)
                whole.start_dir, whole._didModify = 0, True
            with store.open_input_file(f"{name}.dir.all") as f:
                start, length, _ = directory(f)
                f.seek(start)
                with store.open_output_stream(f"{name}.dir", compression=None) as stream:
                    while length and (piece := f.read(min(CHUNK, length))):
                        stream.write(piece)
                        length -= len(piece)
            store.delete_file(f"{name}.dir.all")
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], names=["n"])


def join(store, parts: list, kind: str, out: Out) -> None:
    """One archive from its parts: rows (name, n, data), data the bytes before a zip's directory. Only bytes are copied."""

    def copy(f, n: int | None = None) -> None:
        while piece := f.read(CHUNK if n is None else min(CHUNK, n)):
            out.write(piece)
            n = None if n is None else n - len(piece)

    if kind != "zip":
        for r in parts:
            with store.open_input_stream(r["name"], compression=None) as f:
                copy(f)
        end = out if kind == "tar" else compressed(kind, out)
        end.write(bytes(tarfile.RECORDSIZE))  # the end of a tar: blocks of zeros
        if end is not out:
            end.close()
        return
    for r in parts:
        with store.open_input_stream(r["name"], compression=None) as f:
            copy(f, r["data"])
    start, n = out.tell(), sum(r["n"] for r in parts)
    for r in parts:
        with store.open_input_stream(f"{r['name']}.dir", compression=None) as f:
            copy(f)
    end = out.tell()
    if n >= 0xFFFF or end >= 0xFFFFFFFF:
        out.write(struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, end - start, start))
        out.write(struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1))
    out.write(struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(end - start, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))


def tasks_for(files: DataFrame, mb: float = 64) -> int:
    """So many tasks that each packs about `mb` of files (job_id, path, length)."""
    return max(1, int((files.agg(F.sum("length")).first()[0] or 0) / (mb * 1e6)) + 1)
