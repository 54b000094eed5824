"""Token ids in files: fixed-size blocks transposed into bit or byte planes, each plane compressed with zstandard.

A file set is a Parquet table whose rows are chunks of whole documents in ascending doc_id order:
part, chunk, part_offset (ids before it in its part), n_ids, doc_ids, doc_counts, payload_bytes, payload_crc32, payload.
Beside it the table ``index`` tells, without any payload, where each chunk begins: part, chunk, first_id, n_ids,
first_doc, n_docs, payload_bytes, payload_crc32.

Payload, little-endian: magic, plane kind, block size and number of ids; per block the compressed sizes of its planes
(0: all zero), then the planes.  Bit planes are 32 per block, byte planes 4.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediaops.llm.common import partitions, read_table, texts
from mediaops.llm.tokens import encoder
from mediaops.llm.words import text_slices
from mediaops.plans.staging import scratch_folder

MAGIC = b"IDPLANE1"
HEAD = struct.Struct("<8sBIQ")
PLANES = {"bit": (0, 32), "byte": (1, 4)}
CHUNK_SCHEMA = (
    "part int, chunk int, part_offset long, n_ids long, doc_ids array<long>, doc_counts array<long>, "
    "payload_bytes long, payload_crc32 long, payload binary"
)


def encode_planes(ids: np.ndarray, planes: str = "byte", block: int = 65536, level: int = 3) -> bytes:
    kind, count = PLANES[planes]
    squeeze = zstandard.ZstdCompressor(level=level)
    out = [HEAD.pack(MAGIC, kind, block, len(ids))]
    for at in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[at : at + block], dtype="<u4")
        if planes == "bit":
            rows = [np.packbits((part >> np.uint32(p)).astype(np.uint8) & 1) for p in range(count)]
        else:
            rows = list(np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T))
        stored = [squeeze.compress(r.tobytes()) if r.any() else b"" for r in rows]
        out.append(struct.pack(f"<{count}I", *map(len, stored)))
        out += stored
    return b"".join(out)


def decode_planes(payload: bytes) -> np.ndarray:
    magic, kind, block, n = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a payload of id planes")
    planes, count = next((k, c) for k, (i, c) in PLANES.items() if i == kind)
    expand = zstandard.ZstdDecompressor()
    ids = np.zeros(n, dtype="<u4")
    at = HEAD.size
    for begin in range(0, n, block):
        size = min(block, n - begin)
        stored = struct.unpack_from(f"<{count}I", payload, at)
        at += 4 * count
        part = ids[begin : begin + size]
        for p, length in enumerate(stored):
            if not length:
                continue
            raw = np.frombuffer(expand.decompress(payload[at : at + length]), np.uint8)
            at += length
            if planes == "bit":
                part |= np.unpackbits(raw, count=size).astype(np.uint32) << np.uint32(p)
            else:
                part.view(np.uint8).reshape(-1, 4)[:, p] = raw
    return ids


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 0,
    planes: str = "byte",
    block: int = 65536,
    chunk_ids: int = 500_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending id order below ``folder``.

    Documents are dealt by ranges of the id, so parts follow each other and no task holds more than a chunk and the
    document it works on.  Spark commits the files, so a lost executor only repeats its parts.

    A null text counts as empty (it has the end id alone), a null id comes first, rows that repeat an id follow each
    other by text.  A text longer than a chunk is one chunk.  An empty table writes files without rows.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ordered = texts(docs, id_col, text_col).repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    end = np.array([end_id], np.uint32)
    fields = pa.schema(
        [("part", pa.int32()), ("chunk", pa.int32()), ("part_offset", pa.int64()), ("n_ids", pa.int64()),
         ("doc_ids", pa.list_(pa.int64())), ("doc_counts", pa.list_(pa.int64())), ("payload_bytes", pa.int64()),
         ("payload_crc32", pa.int64()), ("payload", pa.binary())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(tokenizer), TaskContext.get().partitionId()
        chunk, offset, held, names, counts, size = 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            payload = encode_planes(np.concatenate(held), planes, block)
            values = [part, chunk, offset, size, names, counts, len(payload), zlib.crc32(payload), payload]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=fields)

        for batch in batches:
            for rows, data, offsets in text_slices(batch):
                found, at = tool.encode(data, offsets)
                for name, a, b in zip(rows.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    if held and size + b - a + 1 > chunk_ids:
                        yield row()
                        chunk, offset, held, names, counts, size = chunk + 1, offset + size, [], [], [], 0
                    held += [found[a:b], end]
                    names.append(name)
                    counts.append(b - a + 1)
                    size += counts[-1]
        if held:
            yield row()

    ordered.mapInArrow(encode, CHUNK_SCHEMA).write.parquet(f"{folder}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    bases = part_bases(chunks)
    index = chunks.join(F.broadcast(bases), "part").select(
        "part",
        "chunk",
        (F.col("base") + F.col("part_offset")).alias("first_id"),
        "n_ids",
        F.col("doc_ids")[0].alias("first_doc"),
        F.size("doc_ids").alias("n_docs"),
        "payload_bytes",
        "payload_crc32",
    )
    index.write.parquet(f"{folder}/index")


def part_bases(chunks: DataFrame) -> DataFrame:
    """Ids before each part; one row per task that wrote, which is also why it may be broadcast."""
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a file set: doc_id, start (ids before it in the set), n_tokens, ids (binary, unsigned 32 bit).

    Every chunk is checked against its checksum and decoded by itself, so reading needs no shuffle.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{folder}/chunks")
    placed = chunks.join(F.broadcast(part_bases(chunks)), "part").select(
        (F.col("base") + F.col("part_offset")).alias("first"), "doc_ids", "doc_counts", "payload_crc32", "payload"
    )
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, names, counts, crc, payload = (batch.column(c)[i].as_py() for c in range(5))
                if zlib.crc32(payload) != crc:
                    raise ValueError("damaged chunk")
                raw = decode_planes(payload).tobytes()
                ends = np.cumsum(np.array(counts, np.int64))
                begins = ends - counts
                ids = [raw[4 * a : 4 * b] for a, b in zip(begins, ends)]
                columns = [names, (first + begins).tolist(), counts, ids]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, fields)], schema=fields)

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_folder(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer, planes="bit")
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
