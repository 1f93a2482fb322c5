"""Avro object container files of flat records, as a Spark data source.

Fields are the primitive types, each with or without null. Files are written
and read by Spark tasks through the file system that a path's URI names; a task
writes under a temporary name, and its file gets its place when the job commits.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

from pyarrow import fs
from pyspark.sql import types as S
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.schema import TYPES

MAGIC, BLOCK_ROWS, FORMAT = b"Obj\x01", 4000, "sievework_avro"
#: Bytes of a file that a task reads.
SPLIT = 64 << 20


def schema_json(schema: S.StructType, name: str = "record") -> str:
    names = {v: k for k, v in TYPES.items()}
    fields = []
    for f in schema.fields:
        if f.dataType not in names:
            raise ValueError(f"field {f.name!r}: {f.dataType.simpleString()} can't be written")
        kind = names[f.dataType]
        fields.append({"name": f.name, "type": ["null", kind] if f.nullable and kind != "null" else kind})
    return json.dumps({"type": "record", "name": name, "fields": fields})


def struct_of(text: str) -> S.StructType:
    out = []
    for f in json.loads(text)["fields"]:
        members = f["type"] if isinstance(f["type"], list) else [f["type"]]
        solid = [m for m in members if m != "null"]
        out.append(S.StructField(f["name"], TYPES[solid[0] if solid else "null"], "null" in members))
    return S.StructType(out)


def zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def unzigzag(f: io.BufferedIOBase) -> int:
    shift = n = 0
    while True:
        b = f.read(1)
        if not b:
            raise EOFError
        n |= (b[0] & 0x7F) << shift
        shift += 7
        if b[0] < 0x80:
            return (n >> 1) ^ -(n & 1)


def _put_text(v: str) -> bytes:
    raw = v.encode()
    return zigzag(len(raw)) + raw


def _get_text(f) -> str:
    return f.read(unzigzag(f)).decode()


_PUT = {"string": _put_text, "int": zigzag, "long": zigzag, "float": lambda v: struct.pack("<f", v), "double": lambda v: struct.pack("<d", v), "boolean": lambda v: b"\x01" if v else b"\x00", "null": lambda v: b""}
_GET = {"string": _get_text, "int": unzigzag, "long": unzigzag, "float": lambda f: struct.unpack("<f", f.read(4))[0], "double": lambda f: struct.unpack("<d", f.read(8))[0], "boolean": lambda f: f.read(1) == b"\x01", "null": lambda f: None}


def _members(schema: str) -> list[list[str] | str]:
    return [f["type"] for f in json.loads(schema)["fields"]]


def put_row(row: Any, kinds: list[list[str] | str]) -> bytes:
    out = []
    for v, kind in zip(row, kinds, strict=True):
        if isinstance(kind, list):
            at = kind.index("null") if v is None else next(i for i, k in enumerate(kind) if k != "null")
            out.append(zigzag(at))
            kind = kind[at]
        out.append(_PUT[kind](v))
    return b"".join(out)


def get_row(f, kinds: list[list[str] | str]) -> tuple:
    return tuple(_GET[kind[unzigzag(f)] if isinstance(kind, list) else kind](f) for kind in kinds)


def write_container(out, rows: Iterator, schema: str) -> int:
    """Rows as a container with deflated blocks; returns how many."""
    sync, kinds, n = os.urandom(16), _members(schema), 0
    meta = {"avro.schema": schema.encode(), "avro.codec": b"deflate"}
    out.write(MAGIC + zigzag(len(meta)) + b"".join(_put_text(k) + zigzag(len(v)) + v for k, v in meta.items()) + zigzag(0) + sync)
    block: list[bytes] = []

    def flush() -> None:
        if block:
            packed = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = packed.compress(b"".join(block)) + packed.flush()
            out.write(zigzag(len(block)) + zigzag(len(body)) + body + sync)
            block.clear()

    for row in rows:
        block.append(put_row(row, kinds))
        n += 1
        if len(block) >= BLOCK_ROWS:
            flush()
    flush()
    return n


def read_header(f) -> tuple[str, str, bytes]:
    if f.read(4) != MAGIC:
        raise ValueError("not an Avro container")
    meta = {}
    while n := unzigzag(f):
        if n < 0:
            unzigzag(f)
        for _ in range(abs(n)):
            key = _get_text(f)
            meta[key] = f.read(unzigzag(f))
    return meta["avro.schema"].decode(), meta.get("avro.codec", b"null").decode(), f.read(16)


class _Counted:
    """A stream that knows where it is in its file."""

    def __init__(self, f, at: int = 0) -> None:
        self.f, self.at = f, at

    def read(self, n: int) -> bytes:
        got = self.f.read(n)
        self.at += len(got)
        return got


def read_container(f, end: int | None = None, head: tuple[str, str, bytes] | None = None) -> Iterator[tuple]:
    """Rows of the blocks that follow, up to the first whose sync mark begins at end or later; head where f is behind the header."""
    f = f if isinstance(f, _Counted) else _Counted(f)
    schema, codec, sync = head or read_header(f)
    kinds = _members(schema)
    if codec not in ("null", "deflate"):
        raise ValueError(f"no such codec: {codec}")
    while end is None or f.at - len(sync) < end:
        try:
            n = unzigzag(f)
        except EOFError:
            return
        body = f.read(unzigzag(f))
        rows = io.BytesIO(zlib.decompress(body, -15) if codec == "deflate" else body)
        for _ in range(n):
            yield get_row(rows, kinds)
        if f.read(16) != sync:
            raise ValueError("a block of an Avro container is damaged")


def _behind_sync(file, start: int, sync: bytes) -> int | None:
    """Where the first block begins whose sync mark begins at start or later."""
    file.seek(start)
    held, at = b"", start
    while chunk := file.read(1 << 16):
        held += chunk
        if (found := held.find(sync)) >= 0:
            return at + found + len(sync)
        at += max(0, len(held) - len(sync) + 1)
        held = held[-len(sync) + 1 :]
    return None


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _files(path: str) -> list[str]:
    where, root = _where(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.File:
        return [root]
    found = where.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".avro") and "/_" not in i.path[len(root) :])


class _Part(InputPartition):
    """Of a file, the blocks whose sync marks begin from start to before end."""

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        where = _where(self.path)[0]
        return [_Part(i.path, at, min(i.size, at + SPLIT)) for i in where.get_file_info(_files(self.path)) for at in range(0, max(1, i.size), SPLIT)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, start, end = partition.value
        with _where(self.path)[0].open_input_file(path) as file:
            f = _Counted(io.BufferedReader(_Raw(file), 1 << 20))
            head = read_header(f)
            if start:
                at = _behind_sync(file, start, head[2])
                if at is None:
                    return
                file.seek(at)
                f = _Counted(io.BufferedReader(_Raw(file), 1 << 20), at)
            yield from read_container(f, end, head)


class _Raw(io.RawIOBase):
    """A stream of pyarrow as one that io can buffer."""

    def __init__(self, f) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.f.read(len(into))
        into[: len(got)] = got
        return len(got)


class _Done(WriterCommitMessage):
    def __init__(self, name: str) -> None:
        self.name = name


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: S.StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema_json(schema), overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        where, root = _where(self.path)
        where.create_dir(f"{root}/{self.job}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.avro"
        with where.open_output_stream(f"{root}/{self.job}/{name}") as out:
            write_container(out, rows, self.schema)
        return _Done(name)

    def commit(self, messages: list) -> None:
        """New files come before old ones go, so that what fails here loses nothing."""
        where, root = _where(self.path)
        old = [i for i in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name != self.job] if self.overwrite else []
        for m in messages:
            if m is not None:
                where.move(f"{root}/{self.job}/{m.name}", f"{root}/{m.name}")
        for info in old:
            (where.delete_dir if info.type == fs.FileType.Directory else where.delete_file)(info.path)
        where.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list) -> None:
        where, root = _where(self.path)
        if where.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.job}")


class AvroSource(DataSource):
    """format("sievework_avro"), once registered."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> S.StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no .avro files in {self.options['path']}")
        with _where(self.options["path"])[0].open_input_stream(files[0]) as f:
            return struct_of(read_header(io.BufferedReader(_Raw(f)))[0])

    def reader(self, schema: S.StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: S.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)
