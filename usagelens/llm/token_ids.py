"""Token ids in files: frequency-ranked, byte-aligned variable-length coding.

A block holds the ids of successive documents. Its ids are replaced by their rank by
frequency among the ids of the block, so frequent ids are small numbers. A number
takes 1 to 4 little-endian bytes; the sizes stand apart, two bits each, in control
bytes of four numbers. A block carries its ranks, so that it can be read without any
other, and a lost task is repeated without a count over the corpus.

Blocks are rows of parquet files in ascending order of ids: ``part`` and ``block``
order them. Documents are not cut; a block ends with the document that fills it, so one
very long document takes one block and the memory of its task.

Null texts count as empty and give the end id alone. Null ids come first. Rows with
equal ids are ordered by text and each keeps its own entry; other columns are ignored.
An empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import new_path
from .common import whole_text
from .tokenizers_memo import encoder

BLOCK_IDS = 1 << 20
SCHEMA = (
    "part int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>,"
    " ranks binary, control binary, data binary"
)
# Sizes that a control byte states for its four numbers.
SIZES = np.array([[(byte >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for byte in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    values = np.ascontiguousarray(values, "<u4")
    sizes = (1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = sizes - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    taken = np.arange(4, dtype=np.uint8) < sizes[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[taken].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: a table gives four sizes for each control byte."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    spread = np.zeros((n, 4), np.uint8)
    spread[np.arange(4, dtype=np.uint8) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return spread.view("<u4").reshape(-1)


def _block(part: int, block: int, first: int, doc_ids: list, texts: list[np.ndarray]) -> dict:
    ids = np.concatenate(texts)
    # Counted by id, of which there are no more than the tokenizer has, and not sorted.
    seen = np.bincount(ids)
    used = np.flatnonzero(seen)
    order = np.lexsort((used, -seen[used]))
    rank = np.empty(len(seen), np.uint32)
    rank[used[order]] = np.arange(len(used), dtype=np.uint32)
    control, data = pack(rank[ids])
    return {
        "part": part, "block": block, "first": first, "n_ids": len(ids), "doc_ids": doc_ids,
        "counts": [len(text) for text in texts], "ranks": used[order].astype("<u4").tobytes(),
        "control": control, "data": data,
    }


def blocks(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the format, ordered over all tasks by document id."""
    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
        ("ranks", pa.binary()), ("control", pa.binary()), ("data", pa.binary()),
    ])
    end = np.array([end_id], "<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode_many, TaskContext.get().partitionId()
        block = first = held = 0
        doc_ids: list = []
        texts: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist())):
                    doc_ids.append(doc_id)
                    texts.append(np.concatenate([np.frombuffer(ids, "<u4"), end]))
                    held += len(texts[-1])
                    if held >= BLOCK_IDS:
                        yield pa.RecordBatch.from_pylist([_block(part, block, first, doc_ids, texts)], schema)
                        block, first, held, doc_ids, texts = block + 1, first + held, 0, [], []
        if doc_ids:
            yield pa.RecordBatch.from_pylist([_block(part, block, first, doc_ids, texts)], schema)

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(write, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, **columns: str) -> None:
    """Write the ids of all documents as files of the format."""
    blocks(docs, tokenizer, end_id, **columns).write.parquet(path)


def _documents(spark: SparkSession, path: str, take, fields: str, types: list) -> DataFrame:
    """A row for each document of the files at ``path``: doc_id, start, n_tokens, then what ``take(ids)`` gives."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    # One row for each written part: as many as the writing job had tasks.
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    located = stored.join(F.broadcast(starts), "part").select(
        (F.col("before") + F.col("first")).alias("start"), "n_ids", "doc_ids", "counts", "ranks", "control", "data"
    )
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *types])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                ranks = np.frombuffer(block["ranks"], "<u4")
                ids = ranks[unpack(block["control"], block["data"], block["n_ids"])]
                ends = np.cumsum(block["counts"])
                begins = ends - block["counts"]
                taken = [take(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block["doc_ids"], pa.int64()), pa.array(begins + block["start"], pa.int64()),
                     pa.array(block["counts"], pa.int64()), *[pa.array(taken, kind) for _, kind in types]],
                    schema=schema,
                )

    return located.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint{fields}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their ids: doc_id, start, n_tokens, ids."""
    return _documents(spark, path, lambda ids: ids.tolist(), ", ids array<bigint>", [("ids", pa.list_(pa.int64()))])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Documents with the crc32 of their ids as little-endian unsigned 32-bit integers."""
    return _documents(
        spark, path, lambda ids: zlib.crc32(ids.tobytes()), ", ids_crc32 bigint", [("ids_crc32", pa.int64())]
    )


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents and describe them from the files."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, end_id)
    return digests(docs.sparkSession, path)
