"""Token ids as length-delimited binary records, with a separate offset index.

A file holds records one after another, documents in ascending doc_id order, files in
the order of their numbers. A record is

    8 bytes  length of the payload
    4 bytes  masked CRC-32 of those 8 bytes
    n bytes  payload: 4 bytes flags, 8 bytes doc_id, 2 or 4 bytes per id
    4 bytes  masked CRC-32 of the payload
    1 byte   line feed

all little-endian. Flag 1 says that the doc_id is null, flag 2 that ids have two bytes, as
in a vocabulary of at most 65,536. The mask rotates a checksum right by 15 bits and adds a constant,
so that the checksum of a stretch that holds checksums does not degenerate. Spark's own
writer commits the files, task by task, on any file system Spark can write to; the
closing line feed is its row separator. The index is a Parquet table with each record's
file, number, offset and length, so that a shuffled reader fetches any record alone.

Defined results: a null text counts as an empty one and gives the end id alone; a null
doc_id comes first and is kept as null; repeated rows become records of their own, equal
doc_ids in the order of their text's hash; ids are whole numbers; a text of any length
is one record, below 2 GB; an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.tokens import encoder, numbers

FILE_BYTES = 16 << 20  # text per file
END_ID = 1
_HEAD, _CRC, _KEY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Iq")
_MASK = 0xA282EAD8  # fixed value of the usual masking


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


_NULL, _NARROW = 1, 2  # flags


def frame(doc_id: int | None, ids: bytes, width: int = 4) -> bytes:
    """One record without the closing line feed; ids of ``width`` bytes."""
    flags = _NULL * (doc_id is None) | _NARROW * (width == 2)
    payload = _KEY.pack(flags, doc_id or 0) + ids
    head = _HEAD.pack(len(payload))
    return b"".join((head, _CRC.pack(masked_crc(head)), payload, _CRC.pack(masked_crc(payload))))


def records(data: memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of every record of a file; an error if a checksum does not hold."""
    at = 0
    while at < len(data):
        head = bytes(data[at:at + 8])
        if len(head) < 8 or _CRC.unpack(data[at + 8:at + 12])[0] != masked_crc(head):
            raise ValueError(f"broken record length at byte {at}")
        size = _HEAD.unpack(head)[0]
        payload = bytes(data[at + 12:at + 12 + size])
        end = at + 12 + size + 4
        if len(payload) < size or _CRC.unpack(data[end - 4:end])[0] != masked_crc(payload) or data[end] != 0x0A:
            raise ValueError(f"broken record at byte {at}")
        flags, doc_id = _KEY.unpack_from(payload)
        ids = numbers(payload[_KEY.size:], 2 if flags & _NARROW else 4)
        yield at, end + 1 - at, None if flags & _NULL else doc_id, ids
        at = end + 1


def _framer(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encode = encoder(path)
        end = end_id.to_bytes(encode.width, "little")
        for batch in batches:
            texts = batch.column("text")
            for first in range(0, len(texts), 256):  # a few texts at a time as Python strings
                part = texts.slice(first, 256).to_pylist()
                keys = batch.column("doc_id").slice(first, 256).to_pylist()
                framed = [frame(k, encode.ids(t) + end, encode.width) for k, t in zip(keys, part)]
                yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["record"])
    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
                  file_bytes: int = FILE_BYTES) -> None:
    """Encode every text and write the record files."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    # The drawn column lets rows equal in id and text spread over files.
    order = [F.col("doc_id"), F.col("tie"), F.col("any")]
    lined = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"), F.rand(0).alias("any"))
             .repartitionByRange(files, *order).sortWithinPartitions(*order).drop("tie", "any"))
    framed = lined.mapInArrow(_framer(tokenizer, end_id), "record binary")
    framed.select(F.col("record").cast("string")).write.text(folder)  # the cast keeps every byte


_INDEX = "file long, number long, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _INDEX.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            file, data = batch.column("file")[i].as_py(), memoryview(batch.column("content")[i].as_buffer())
            out, before = [], 0
            for number, (offset, length, doc_id, ids) in enumerate(records(data)):
                out.append((file, number, offset, length, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                before += len(ids)
            columns = zip(*out) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def build_index(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Read the record files back, check them, and write one index row per record."""
    files = (spark.read.format("binaryFile").load(folder)
             .where(F.col("length") > 0)
             .select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("long").alias("file"), "content"))
    files.mapInArrow(_index, _INDEX).write.parquet(index)
    return spark.read.schema(_INDEX).parquet(index)


def starts(index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and the place of each record."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = (index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
             .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    return index.join(files, "file").select(
        "doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32",
        "file", "number", "offset", "length")


def _fetcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = memoryview(batch.column("content")[i].as_buffer())
            wanted = batch.column("wanted")[i].as_py()
            found = [next(records(data[w["offset"]:w["offset"] + w["length"]])) for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[2] for f in found], pa.int64()),
                 pa.array([f[3].astype(np.int64) for f in found], pa.list_(pa.int64()))],
                ["doc_id", "ids"])


def read_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of some rows of the index, each cut out of its file by offset and length."""
    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("wanted"))
    files = (spark.read.format("binaryFile").load(folder)
             .select(F.regexp_extract("path", r"part-(\d+)-", 1).cast("long").alias("file"), "content"))
    return (files.join(places, "file").select("content", "wanted")
            .mapInArrow(_fetcher, "doc_id long, ids array<long>"))
