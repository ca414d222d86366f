"""Token-id files: Simple-8b blocks of whole documents in ascending order.

A token folder is a Parquet table with one row per block.  ``block`` is the binary block;
the other columns are its index, so a reader finds a document's block without decoding any.
A block, little endian:

    4 bytes   magic "S8B1"
    u32       number of documents d
    u64       number of ids
    u32[d]    ids of each document; running sums are the offsets inside the block
    u64[]     Simple-8b words of all ids

Blocks end at document ends and hold at least one document.  ``shard`` and ``number`` order
the blocks; ``first`` counts the ids before a block in its shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsieve.llm import simple8b
from gridsieve.llm.memory import giving_back
from gridsieve.llm.tokens import encoded
from gridsieve.session import scratch_path

MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
INDEX = "shard int, number int, n_ids bigint, first bigint, doc_ids array<bigint>"
_FIELDS = pa.schema(
    [
        ("shard", pa.int32()),
        ("number", pa.int32()),
        ("n_ids", pa.int64()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("block", pa.binary()),
    ]
)


def pack_block(documents: list[bytes]) -> bytes:
    """One block from the ids of its documents (little-endian unsigned 32-bit)."""
    lengths = np.array([len(d) // 4 for d in documents], dtype="<u4")
    ids = np.frombuffer(b"".join(documents), dtype="<u4")
    head = MAGIC + struct.pack("<IQ", len(documents), len(ids))
    return head + lengths.tobytes() + simple8b.encode(ids).tobytes()


def unpack_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each document, all ids) of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, n = struct.unpack_from("<IQ", block, 4)
    lengths = np.frombuffer(block, dtype="<u4", count=docs, offset=16)
    words = np.frombuffer(block, dtype="<u8", offset=16 + 4 * docs)
    return lengths.astype(np.int64), simple8b.decode(words, n).astype("<u4")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_ids: int = BLOCK_IDS,
    added_tokens: bool = False,
) -> None:
    """Encode every whole text and write its ids, documents in ascending id order.

    Rows are dealt by ranges of (id, hash of the text), so repeated ids may cross shards and
    no range must hold them all; null ids come first.  A null text counts as empty.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select(F.col(id_col).cast("bigint").alias("d"), F.col(text_col).alias("t"))
        .withColumn("h", F.xxhash64("t"))
        .repartitionByRange(parts, "d", "h")
        .sortWithinPartitions("d", "h")
        .select("d", "t")
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        owners: list = []
        size = 0

        def out():
            row = [[shard], [number], [size], [first], [owners], [pack_block(held)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(row, _FIELDS)], schema=_FIELDS
            )

        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = encoded(tokenizer_path, texts, end_id, at_once=128, added_tokens=added_tokens)
            for owner, own in zip(batch.column(0).to_pylist(), ids):
                held.append(own)
                owners.append(owner)
                size += len(own) // 4
                if size >= block_ids:
                    yield out()
                    number, first = number + 1, first + size
                    held, owners, size = [], [], 0
        if held:
            yield out()

    (
        rows.mapInArrow(giving_back(blocks), INDEX + ", block binary")
        .write.option("compression", "none")
        .option("parquet.block.size", 8 * 1024 * 1024)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document, decoded from the files.

    ``start`` counts the ids of all documents before; ``ids`` is binary, little-endian
    unsigned 32-bit.  Running sums need one row per shard only.
    """
    table = spark.read.parquet(path)
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        table.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    )
    # One narrow row per shard.  Without the hint the blocks themselves are shuffled before
    # adaptive execution sees how small that side is.
    placed = table.join(F.broadcast(bases), "shard").select(
        (F.col("base") + F.col("first")).alias("start"), "doc_ids", "block"
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lengths, ids = unpack_block(batch.column(2)[k].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = ids.tobytes()
                cut = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[k].values,
                        pa.array(starts + batch.column(0)[k].as_py(), pa.int64()),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["doc_id", "start", "ids"],
                )

    return placed.mapInArrow(giving_back(documents), "doc_id bigint, start bigint, ids binary")


def token_file_digest(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, added_tokens: bool = False
) -> DataFrame:
    """Write ``docs`` as token files, read them back, and describe each document.

    Columns: doc_id, start, n_tokens, ids_crc32.  An empty table gives no rows; an empty or
    null text has the end id alone; repeated rows each have their own ids and place.  Names
    of added tokens are these tokens with ``added_tokens``, else plain text.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id, added_tokens=added_tokens)
    return read_token_files(spark, path).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.crc32("ids").cast("bigint").alias("ids_crc32"),
    )
