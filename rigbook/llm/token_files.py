"""Token ids as binary files: each id in the fewest bits the vocabulary needs.

A file is a header, the table of its documents, the offsets of its blocks, and the blocks: ids of the same width,
end to end, from the lowest bit up. Every block but the last holds the same number of ids, so that an id's place
is arithmetic: numpy takes any range of ids out of a mapped file without reading what stands before it. Spark's
own committed writer puts the files wherever it can write; a file is one row of it and ends with a line end,
which belongs to no block.

    header   magic, width, ids per block, documents, slice, ids, ids of the slice before (little-endian, 32 bytes)
    table    doc_id, then ids (8 bytes each, per document), then whether the id is known (a byte per document)
    offsets  where each block begins, and where the last one ends (8 bytes each, from the file's begin)

Files are written slice by slice of the order; the table ``_slices`` beside them says how many ids stand before
each slice.
"""

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rigbook.llm.common import columns_of
from rigbook.llm.packing import ids_for

HEADER = "<4sHHIIQQ"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"TID1"
#: Ids of a block, a multiple of 8, so that blocks end at whole bytes whatever the width.
BLOCK_IDS = 1 << 15
#: Ids after which a file is closed; a document is never divided. 8 MB at 16 bits.
FILE_IDS = 1 << 22
#: Least ids worth a task of their own, and the most slices of the order (a slice becomes one file or more).
LEAST_IDS, MOST_SLICES = 1 << 18, 10_000


def width_of(vocabulary_size: int) -> int:
    """The fewest bits that hold every id below this."""
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids end to end in ``width`` bits each, lowest bits first; the last byte is filled up with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(packed, width: int, begin: int, end: int) -> np.ndarray:
    """The ids from ``begin`` up to ``end`` of packed ones, as unsigned 32-bit numbers.

    Each id is cut out of the eight bytes from its first one on, all ids at once.
    """
    if end <= begin:
        return np.zeros(0, np.uint32)
    first = begin * width // 8
    part = np.frombuffer(packed, np.uint8)[first:(end * width + 7) // 8]
    if width in (8, 16, 32):
        return part.view(f"<u{width // 8}").astype(np.uint32)
    part = np.concatenate([part, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
    at = np.arange(begin, end, dtype=np.int64) * width - first * 8
    return (eight[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


def file_bytes(doc_ids: list, lengths: list[int], ids: np.ndarray, of_slice: int, before: int, width: int) -> bytes:
    """A file of these documents; their ids stand end to end in ``ids``, and ``before`` ids in the slice's files
    before this one."""
    blocks = [pack_bits(ids[k:k + BLOCK_IDS], width) for k in range(0, len(ids), BLOCK_IDS)]
    table = HEADER_BYTES + 17 * len(doc_ids)
    offsets = table + 8 * (len(blocks) + 1) + np.cumsum([0, *map(len, blocks)])
    return b"".join([
        struct.pack(HEADER, MAGIC, width, BLOCK_IDS >> 3, len(doc_ids), of_slice, len(ids), before),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(),
        bytes(x is not None for x in doc_ids), offsets.astype("<i8").tobytes(), *blocks])


class TokenFile:
    """A file's bytes, or a mapped file, opened for reading."""

    def __init__(self, content):
        magic, self.width, eighths, n, self.slice, self.n_ids, self.before = struct.unpack_from(HEADER, content)
        if magic != MAGIC:
            raise ValueError("no file of token ids")
        self.content, self.block_ids = content, eighths << 3
        at = HEADER_BYTES
        ids = np.frombuffer(content, "<i8", n, at)
        lengths = np.frombuffer(content, "<i8", n, at + 8 * n)
        known = np.frombuffer(content, np.uint8, n, at + 16 * n)
        self.doc_ids = [int(x) if k else None for x, k in zip(ids, known, strict=True)]
        #: Where each document begins among the ids of this file, and where the last one ends.
        self.begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.offsets = np.frombuffer(content, "<i8", -(-self.n_ids // self.block_ids) + 1, at + 17 * n)

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids by their place in the file; only blocks that hold some of them are touched."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        parts = []
        while begin < end:
            block, skip = divmod(begin, self.block_ids)
            many = min(end - begin, self.block_ids - skip)
            packed = memoryview(self.content)[int(self.offsets[block]):int(self.offsets[block + 1])]
            parts.append(unpack_bits(packed, self.width, skip, skip + many))
            begin += many
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        """The ids of one of the file's documents, by its number there."""
        return self.ids(int(self.begins[number]), int(self.begins[number + 1]))


def numbered(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (a number of its own for each row, in the order of reading) and text."""
    return columns_of(documents, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")


def cuts(rows: DataFrame, slices: int) -> list[tuple]:
    """The last (id known, id, row) of each of so many slices of the order, but for the last slice; found by
    Spark's range partitioner."""
    last = (rows.select("doc_id", "row").repartitionByRange(slices, "doc_id", "row")
            .groupBy(F.spark_partition_id().alias("slice")).agg(F.max(F.struct("doc_id", "row")).alias("last")))
    return sorted((r.last.doc_id is not None, r.last.doc_id or 0, r.last.row) for r in last.collect())[:-1]


def write_ids(documents: DataFrame, path: str, vocabulary: str, *, end_id: int = 0, file_ids: int = FILE_IDS,
              doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of whole texts, each followed by ``end_id``, to files in a new folder, in order of doc_id.

    A null text counts as empty, a null id comes first, and rows that share an id follow each other in the order
    in which they were read (so ``documents`` should be a stored table, whose rows come in one order whenever a
    task is repeated). Special strings in a text are taken as the library takes them by default.

    Every text is encoded once, and its ids are shuffled once: to slices of the order, cut by (doc_id, row), so
    that a hot id is cut like any other range. The driver holds one key for each slice. Slices are then written as
    they are sorted; a slice becomes one file or more. An empty table gives a folder without ids.
    """
    spark = documents.sparkSession
    rows = numbered(documents, doc_id, text)
    # Some four bytes of text give an id.
    many = (rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] or 0) // 4
    slices = max(-(-many // file_ids), min(spark.sparkContext.defaultParallelism, -(-many // LEAST_IDS)), 1)
    slices = min(slices, MOST_SLICES)
    last = cuts(rows, slices)
    width = width_of(max(len(ids_for(vocabulary).coded), end_id + 1))
    kind = "<u2" if width <= 16 else "<u4"
    size = int(kind[-1])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = ids_for(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                keys = zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), strict=True)
                ids = (np.frombuffer(known.of(t or "") + end, "<u4") for t in part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([bisect.bisect_left(last, (x is not None, x or 0, r)) for x, r in keys],
                                      pa.int32()),
                    "doc_id": part.column("doc_id"), "row": part.column("row"),
                    "ids": pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())})

    def files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, before, doc_ids, ids, held = None, 0, [], [], 0

        def one() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(ids), kind)
            content = file_bytes(doc_ids, [len(x) // size for x in ids], whole, of, before, width)
            return pa.RecordBatch.from_pydict({"content": pa.array([content], pa.binary())})

        for batch in batches:
            for part, key, coded in zip(*(batch.column(c).to_pylist() for c in ("slice", "doc_id", "ids")),
                                        strict=True):
                if doc_ids and (part != of or held >= file_ids):
                    yield one()
                    before, doc_ids, ids, held = before + held, [], [], 0
                if part != of:
                    of, before = part, 0
                doc_ids.append(key)
                ids.append(coded)
                held += len(coded) // size
        if doc_ids:
            yield one()

    ordered = (rows.mapInArrow(encode, "slice int, doc_id long, row long, ids binary")
               .repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "doc_id", "row"))
    (ordered.select("slice", "doc_id", "ids").mapInArrow(files, "content binary")
     .select(F.col("content").cast("string").alias("value"))
     .write.mode("errorifexists").option("compression", "none").option("maxRecordsPerFile", 1).text(path))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    (_heads(spark, path).groupBy("slice").agg(F.sum("n_ids").alias("n_ids"))
     .select("slice", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
     .write.mode("errorifexists").parquet(f"{path}/_slices"))


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """path, slice, before, n_ids and n_documents of each file."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [struct.unpack(HEADER, x) for x in batch.column("head").to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": batch.column("path")} | {
                name: pa.array([h[k] for h in heads], pa.int64())
                for name, k in (("slice", 4), ("before", 6), ("n_ids", 5), ("n_documents", 3))})

    head = F.substring("content", 1, HEADER_BYTES).alias("head")
    return (_contents(spark, path).select("path", head)
            .mapInArrow(read, "path string, slice long, before long, n_ids long, n_documents long"))


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 1").select("path", "content")


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """path, start, n_ids and n_documents of each file: where to look for the id at some place of the whole."""
    return (_heads(spark, path).join(spark.read.parquet(f"{path}/_slices"), "slice")
            .select("path", (F.col("start") + F.col("before")).alias("start"), "n_ids", "n_documents"))


def read_ids(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """The documents in the files of a folder: doc_id, start (ids of all documents before), n_tokens, ids_crc32
    (unsigned, of the ids as little-endian 32-bit numbers), and the ids themselves if asked for. Narrow."""
    starts = {r.slice: r.start for r in spark.read.parquet(f"{path}/_slices").collect()}    # at most MOST_SLICES

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held = TokenFile(content.as_buffer())
                start = starts[held.slice] + held.before
                for k in range(0, len(held.doc_ids), 256):
                    places = held.begins[k:k + 257]
                    ids = held.ids(int(places[0]), int(places[-1])).astype("<u4")
                    each = [ids[a:b] for a, b in zip(places[:-1] - places[0], places[1:] - places[0], strict=True)]
                    out = {"doc_id": pa.array(held.doc_ids[k:k + 256], pa.int64()),
                           "start": pa.array(start + places[:-1]), "n_tokens": pa.array(np.diff(places)),
                           "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return _contents(spark, path).select("content").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
