"""Token-id sequences as length-delimited binary records with an offset index.

A data file is a run of frames.  A frame is, little-endian:

    uint32  length of the payload
    uint32  masked checksum of those four bytes
    payload
    uint32  masked checksum of the payload
    uint8   10, the end of a frame

and a payload is

    uint8   1 if there is a doc_id, else 0
    uint8   bytes of an id, 2 or 4
    int64   doc_id, 0 if there is none
    ids     unsigned

A masked checksum is the CRC-32 turned right by 15 bits plus a constant, so
that checksums of data that hold checksums stay useful.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.tokens import default_tokenizer, encoder, utf8
from folioscope.session import fresh_path

MASK = 0xA282EAD8
HEAD = struct.Struct("<II")
LEAD = struct.Struct("<BBq")
TAIL = struct.Struct("<I")
#: Bytes of text for each data file.
FILE_BYTES = 24 << 20
#: Files grow beyond that rather than be more than so many.
MOST_FILES = 200_000

INDEX = (
    "file string, position long, doc_id long, frame_offset long, frame_length long, "
    "start long, n_tokens long, ids_crc32 long"
)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One frame without its last byte, which the writer adds."""
    payload = LEAD.pack(doc_id is not None, width, doc_id or 0) + ids
    size = struct.pack("<I", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id, ids and the offset after the frame at ``at``; raises on damage."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 4])) != check:
        raise ValueError(f"damaged length at byte {at}")
    end = at + HEAD.size + size
    payload = bytes(data[at + HEAD.size : end])
    if len(payload) != size or TAIL.unpack_from(data, end)[0] != masked(payload) or data[end + TAIL.size] != 10:
        raise ValueError(f"damaged record at byte {at}")
    has, width, doc = LEAD.unpack_from(payload)
    return doc if has else None, np.frombuffer(payload, f"<u{width}", offset=LEAD.size), end + TAIL.size + 1


def _frames(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        width = np.dtype(words.dtype).itemsize
        end = np.array([end_id], dtype=words.dtype).tobytes()
        for batch in batches:
            docs, out, size = batch.column(0).to_pylist(), [], 0
            for doc, ids in zip(docs, words.encode(utf8(batch.column(1)))):
                out.append(frame(doc, ids + end, width))
                size += len(out[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> str:
    """Write the ids of all documents in ascending doc_id order under ``path``.

    Documents are placed by range of doc_id (null first) and, among equal ids,
    of a hash of the text, then sorted and encoded where they are.  Spark's
    writer stores the frames as lines of raw bytes, so any file system that
    Spark knows will do, and a lost task leaves no half file.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(-(-size // max(FILE_BYTES, size // MOST_FILES)) or 1, *order).sortWithinPartitions(*order)
    frames = placed.mapInArrow(_frames(tokenizer or default_tokenizer(), end_id), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("compression", "none").text(f"{path}/data")
    return path


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*[f.split() for f in INDEX.split(", ")])
    for batch in batches:
        for name, content in zip(batch.column(0), batch.column(1)):
            data, at, start, rows = memoryview(content.as_buffer()), 0, 0, []
            while at < len(data):
                doc, ids, after = unframe(data, at)
                rows.append((name.as_py(), len(rows), doc, at, after - at, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at, start = after, start + len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*rows), kinds)], names=list(names)
                )


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Read all data files back, check every frame, and write the offset index."""
    _files(spark, path).mapInArrow(_scan, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, wanted in zip(batch.column(0), batch.column(1)):
            data = memoryview(content.as_buffer())
            found = [unframe(data, at) for at in wanted.as_py()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc for doc, _, _ in found], pa.int64()),
                    pa.array([ids.astype("<i4").tolist() for _, ids, _ in found], pa.list_(pa.int32())),
                ],
                names=["doc_id", "ids"],
            )


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(doc_id, ids) of all records in an order fixed by the seed.

    The index names the frames of each file, so only whole frames at known
    offsets are decoded; the sort key is drawn from file and offset.
    """
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    wanted = index.groupBy("file").agg(F.collect_list("frame_offset").alias("at"))
    rows = _files(spark, path).join(wanted, "file").select("content", "at")
    ids = rows.mapInArrow(_slices, "doc_id long, ids array<int>")
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("ids")))


def file_number(name: str) -> Column:
    """The place of a data file: the number in its name, which has no fixed width."""
    return F.regexp_extract(name, r"^part-(\d+)", 1).cast("long")


def stored_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write, read back, and return per document what the files hold.

    doc_id, start (ids of all documents before it), n_tokens (with the end
    id), ids_crc32.  Null and empty texts are their end id alone; a null id is
    stored as such and comes first; repeated rows are stored each.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    index = index_records(spark, write_records(docs, fresh_path(spark, "records"), tokenizer, end_id))
    before = Window.orderBy(file_number("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(files, "file").select("doc_id", (F.col("_before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
