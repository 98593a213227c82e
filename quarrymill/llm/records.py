"""Token ids in length-delimited binary record files with masked checksums, and a separate offset index for shuffled reads.

A record: payload length (4 bytes), its masked checksum (4), payload, the payload's masked checksum (4), all little-endian. A payload:
doc_id (8, signed), id width with 128 added if compressed and 64 if the doc_id is null (1), ids. Files hold records in ascending doc_id order, and so do files by
their number. The index is a Parquet table with each record's file, place and count of ids; Spark's commit of it names the files that
count, so files of tasks that ran twice or failed are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

FILE, END_ID = "byte_bpe_50k.json", 2
MASK_DELTA = 0xA282EAD8
COLUMNS = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])
INDEX = "doc_id long, file string, part int, at long, size long, n_tokens long, before long"


def masked(data: bytes) -> int:
    """A CRC that stays well-behaved when data hold CRCs themselves."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


@cache
def press():
    """One compressor a Python worker."""
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True)


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    raw = ids.astype(f"<u{width}").tobytes()
    small = press().compress(raw)
    pressed = len(small) < len(raw)  # the flag and the bytes follow this alone, so that equal lengths can't part them
    kind = width | (128 if pressed else 0) | (64 if doc_id is None else 0)
    body = struct.pack("<qB", doc_id or 0, kind) + (small if pressed else raw)
    size = struct.pack("<I", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body))


def unframe(record: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of one record; raises ValueError where a length or checksum is wrong."""
    import zstandard

    size, check = struct.unpack_from("<II", record)
    if masked(record[:4]) != check or len(record) != size + 12:
        raise ValueError("record length is damaged")
    body = record[8:-4]
    if masked(body) != struct.unpack("<I", record[-4:])[0]:
        raise ValueError("record payload is damaged")
    doc_id, kind = struct.unpack_from("<qB", body)
    raw = zstandard.ZstdDecompressor().decompress(body[9:]) if kind & 128 else body[9:]
    return None if kind & 64 else doc_id, np.frombuffer(raw, f"<u{kind & 63}")


def store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: str | None = None, files: int | None = None, special: bool = False) -> DataFrame:
    """Encode docs, write record files and the index under path, and return the index.

    Documents are range-partitioned by doc_id, one file a partition. A null text counts as empty: the end id alone; rows with the
    same doc_id each get a record, in the order of their texts; null ids stand before all others. An empty table gives no files and
    an empty index. path: where Spark and pyarrow's file systems both write. special: a special token's string in a text is that
    token, as the library has it unless told otherwise; else it is ordinary text.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    vocabulary = vocabulary or tokens.default_path(FILE)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, special)
        part, before, at, out = TaskContext.get().partitionId(), 0, 0, None
        name = f"part-{part:05d}-{uuid.uuid4().hex}.rec"
        try:
            for b in common.batches(it, 1500, 6 << 20):
                if out is None:
                    files_at, folder = store(path)
                    files_at.create_dir(f"{folder}/data")
                    out = files_at.open_output_stream(f"{folder}/data/{name}")
                rows = []
                for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                    record = frame(doc, np.append(ids, np.uint32(end_id)))
                    out.write(record)
                    rows.append((doc, name, part, at, len(record), len(ids) + 1, before))
                    at, before = at + len(record), before + len(ids) + 1
                columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.types, strict=True)], schema=COLUMNS)
        finally:
            if out is not None:
                out.close()

    dealt = common.id_text(docs, id_col, text_col).repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    common.write_once(dealt.mapInArrow(common.lean(task), INDEX), f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str, index: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), and ids, read from record files by the index or a part of it, in any order.

    packed: ids as little-endian unsigned 32-bit integers in one binary value, else as an array.
    """
    whole = spark.read.schema(INDEX).parquet(f"{path}/index")
    totals = whole.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    totals = totals.select(F.col("part"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = (whole if index is None else index).join(totals, "part").select("file", "at", "size", (F.col("base") + F.col("before")).alias("start"))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(path)
        source, name = None, None
        for b in common.batches(it, 500):
            docs, ids, starts = [], [], []
            for r in b.to_pylist():
                if r["file"] != name:
                    name, source = r["file"], files.open_input_file(f"{folder}/data/{r['file']}")
                doc, x = unframe(source.read_at(r["size"], r["at"]))
                docs.append(doc)
                ids.append(x)
                starts.append(r["start"])
            if packed:
                lists = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
            else:
                values = pa.array(np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32), values)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), lists], ["doc_id", "start", "ids"])

    common.ship(spark)
    return rows.mapInArrow(common.lean(task), f"doc_id long, start long, ids {'binary' if packed else 'array<int>'}")


def task_pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        at, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy().astype("<u4")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([values[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "start", "ids"])


def digests(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what read() returns, arrays or packed; packed ids need no Python."""
    if records.schema["ids"].dataType.typeName() == "array":
        records = records.mapInArrow(common.lean(task_pack), "doc_id long, start long, ids binary")
    return records.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_records(spark, sf_dir: str) -> DataFrame:
    """Write all documents, read the files back and digest what they hold."""
    path = common.fresh_path(spark, "records")
    write(common.table(spark, sf_dir, "documents"), path, special=True)
    return digests(read(spark, path, packed=True))
