"""Media columns: payloads in tar shards by content, and rows that point into them.

A payload is bytes in a whole number of lines of LINE samples, kept as a grey
8-bit PNG (lossless). Each task writes tar files of about SHARD bytes into the
shared folder; a payload it has met before is not written again, and its name
in the tar is its SHA-256. A row carries digest, shard, offset and length; of
payloads that several tasks have written, all rows point to one. Metadata
columns come from range reads of the first HEADER bytes of each member.

Files are written and read through the file system that the folder's URI names
(pyarrow.fs). A task that is lost leaves a file that no row points to, and its
successor writes its own. The texts are read where they are and not shuffled;
shuffled are rows of about 150 bytes. Digests are 32 bytes in tables between
steps, and hexadecimal in what is returned.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._join import answered
from ._store import new_folder, release, stored

LINE, SHARD, HEADER = 576, 64 << 20, 33
#: Bytes of media that a task reads back.
READ = 16 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    """UTF-8, filled up with bytes 255 to the next positive multiple of LINE."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // LINE)) * LINE - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(raw: bytes) -> bytes:
    """A grey 8-bit PNG with LINE samples a line and no filter."""
    lines = np.frombuffer(raw, np.uint8).reshape(-1, LINE)
    body = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], 1).tobytes()
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body, 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first HEADER bytes of a PNG."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not the start of a PNG")
    return struct.unpack(">IIB", start[16:25])


def decoded(media: bytes) -> bytes:
    """The samples of a PNG made by encoded(); each chunk is checked."""
    width, height, _ = header(media[:HEADER])
    at, parts = 8, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk of a PNG is damaged")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(raw: bytes) -> str:
    """Lines, mean, spread and entropy of the samples."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    share = counts / counts.sum()
    mean = float(share @ np.arange(256))
    spread = float(np.sqrt(share @ (np.arange(256) - mean) ** 2))
    some = share[share > 0]
    return f"lines={len(raw) // LINE};mean={mean:.4f};spread={spread:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f}"


class ShardWriter:
    """Appends members to tar files in a folder and tells where their bytes begin."""

    def __init__(self, folder: str) -> None:
        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.out, self.seen = None, {}

    def add(self, digest: str, raw: bytes) -> tuple[str, int, int]:
        if digest not in self.seen:
            if self.out is None:
                self.fs.create_dir(self.path, recursive=True)
                self.name, self.at = f"{uuid.uuid4().hex}.tar", 0
                self.out = self.fs.open_output_stream(f"{self.path}/{self.name}")
            media = encoded(raw)
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512))
            self.seen[digest] = self.name, self.at + 512, len(media)
            self.at += 512 + len(media) + -len(media) % 512
            if self.at >= SHARD:
                self.close()
        return self.seen[digest]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def _writing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                raw = payload(text)
                digest = hashlib.sha256(raw)
                rows.append((len((text or "").encode()), digest.digest(), *writer.add(digest.hexdigest(), raw)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (("n_bytes", pa.int64()), ("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))
            yield T.with_columns(batch.drop_columns(["text"]), {name: pa.array(x, kind) for (name, kind), x in zip(kinds, columns, strict=True)})
        writer.close()

    return run


def _hex(digest: str):
    return F.lower(F.hex(digest))


_REF = ("n_bytes", "digest", "shard", "offset", "length")


def _written(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows with n_bytes and digest, and for each digest the one place that rows are to point to, and how many rows there are."""
    docs = docs.drop(*_REF)
    rest = [f for f in docs.schema if f.name != "text"]
    refs = stored(docs.mapInArrow(_writing(folder), T.schema_of(rest, "n_bytes bigint", "digest binary", "shard string", "offset bigint", "length bigint")), "media-refs")
    return refs, _placed(refs)


def _placed(refs: DataFrame) -> DataFrame:
    """(__digest, shard, offset, length, copies): each payload once."""
    one = refs.groupBy(F.col("digest").alias("__digest")).agg(F.min(F.struct("shard", "offset", "length")).alias("__at"), F.count(F.lit(1)).alias("copies"))
    return stored(one.select("__digest", "__at.*", "copies"), "media-places")


def store_media(docs: DataFrame, folder: str) -> DataFrame:
    """docs without text, and with n_bytes, digest, shard (a file in folder), offset, length of its payload.

    Defined cases: a null text is empty; an empty one is a payload of one line;
    equal texts point to the same bytes; columns of docs by these names are
    replaced, others pass; an empty table writes no file.
    """
    refs, one = _written(docs, folder)
    rows = answered(refs.drop("shard", "offset", "length"), one, {"digest": "__digest"}, how="inner")
    whole = stored(rows.withColumn("digest", _hex("digest")), "media-rows")
    release(refs, one)
    return whole


def _ranges(folder: str, batch: pa.RecordBatch, size: int | None) -> Iterator[bytes]:
    """The first size bytes of each row's member, or all of it."""
    (where, path), name, file = fs.FileSystem.from_uri(folder), None, None
    for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != name:
            if file is not None:
                file.close()
            name, file = shard, where.open_input_file(f"{path}/{shard}")
        yield file.read_at(min(length, size or length), offset)
    if file is not None:
        file.close()


def _members(places: DataFrame) -> DataFrame:
    """Payloads in the order of the shards, about READ bytes to a task, so that each reads few files from front to back."""
    size = places.agg(F.sum("length")).first()[0] or 0
    return places.repartitionByRange(max(1, -(-size // READ)), F.col("shard"), F.col("offset")).sortWithinPartitions("shard", "offset")


_HEADER = ("width int", "height int", "bits int")


def _heads(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(header(x) for x in _ranges(folder, batch, HEADER)), strict=True)) or [()] * 3
            yield T.with_columns(batch, {c: pa.array(x, pa.int32()) for c, x in zip(("width", "height", "bits"), found, strict=True)})

    return run


def with_headers(refs: DataFrame, folder: str) -> DataFrame:
    """refs with width, height and bits of its media, from reads of HEADER bytes."""
    refs = refs.drop("width", "height", "bits")
    places = _placed(refs)
    heads = _members(places).mapInArrow(_heads(folder), T.schema_of(places.schema, *_HEADER))
    return answered(refs, stored(heads.drop("shard", "offset", "length"), "media-heads"), {"digest": "__digest"}, how="inner")


def read_media(refs: DataFrame, folder: str) -> DataFrame:
    """(digest, payload, media): each payload of refs once, read back from its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in enumerate(_ranges(folder, batch, None)):
                yield pa.RecordBatch.from_pydict({"digest": batch.column("__digest").slice(i, 1), "payload": pa.array([decoded(media)], pa.binary()), "media": pa.array([media], pa.binary())})

    return _members(_placed(refs)).mapInArrow(run, "digest string, payload binary, media binary")


_DIGESTS = ("payload_bytes bigint", "tail_crc32 bigint", "media_bytes bigint", "media_digest binary", "feature string")


def _digested(folder: str):
    heads = _heads(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in heads(batches):
            rows = []
            for digest, media in zip(batch.column("__digest").to_pylist(), _ranges(folder, batch, None), strict=True):
                raw = decoded(media)
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError("a payload differs from its digest")
                rows.append((len(raw), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).digest(), feature(raw)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (("payload_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_digest", pa.binary()), ("feature", pa.string()))
            yield T.with_columns(batch, {name: pa.array(x, kind) for (name, kind), x in zip(kinds, columns, strict=True)})

    return run


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text as a picture in a tar shard, read back: digests and features of what was stored.

    What is read back, headers by range reads and then whole payloads, goes on
    with the payload's place, and is joined once to the rows.
    """
    folder = new_folder(spark, "media")
    refs, places = _written(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    found = _members(places).mapInArrow(_digested(folder), T.schema_of(places.schema, *_HEADER, *_DIGESTS))
    known = stored(found.drop("length", "bits"), "media-known")
    release(places)
    rows = answered(refs.select("doc_id", "n_bytes", "digest"), known, {"digest": "__digest"}, how="inner")
    # The digest is that of the bytes read back: any other is an error there.
    return rows.select("doc_id", "n_bytes", "payload_bytes", _hex("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", _hex("media_digest").alias("media_sha256"), "feature", "width", "height", "shard", "offset")
