"""Token-id files: ids of whole texts in document order, range coded in independent checksummed blocks.

Format: a Parquet table, one row a block. `shard` and `seq` give the order of
blocks (shards follow the order of ids), `offset` the ids of the shard before the
block, `n_ids` its ids, `crc` the CRC-32 of its ids as little-endian unsigned
32-bit integers, `index` the zlib-packed documents in it (id, ids of the
document before this part, parts, count; signed 64-bit little-endian), `payload` the bytes of the range coder. A block holds whole documents,
about `block_ids` ids together; a longer document has blocks of its own, its
parts. Any block can be decoded without any other.

Null text counts as empty: the end id alone. Rows with a null id come first and
keep the null. Repeated rows are repeated; of rows with one id the one with the
smaller text comes first. An empty table gives an empty file.
Damaged blocks raise an error that names shard and block. Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jvm_coder
from .byte_bpe import byte_bpe
from .store import new_path, written
from .textkit import lean

BLOCK_IDS = 4096
#: Texts that are tokenised in one call, and ids that a task holds before it passes them on.
ROWS = 5000
HELD_IDS = 2_000_000
#: Blocks that are cut into documents in one call.
BLOCKS = 500
NULL_ID = -(1 << 63)
FORMAT = "shard long, seq long, offset long, n_ids long, crc long, index binary, payload binary"
PLAIN = FORMAT.replace("payload", "ids")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _blocks(tokenizer: str, end_id: int, block_ids: int):
    """Texts to blocks, before they are coded: ids as little-endian unsigned 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        seq = offset = 0
        blocks: list[np.ndarray] = []
        index: list[list[tuple[int, int, int, int]]] = []
        room = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal blocks, index, seq, offset, room, held
            sizes = np.array([len(b) for b in blocks])
            rows = [
                [shard] * len(blocks), list(range(seq, seq + len(blocks))), (offset + np.cumsum(sizes) - sizes).tolist(), sizes.tolist(),
                [_crc(b) for b in blocks], [zlib.compress(np.array(x, dtype="<i8").tobytes()) for x in index], [b.astype("<u2").tobytes() for b in blocks],
            ]
            seq, offset = seq + len(blocks), offset + int(sizes.sum())
            blocks, index, room, held = [], [], 0, 0
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], ["shard", "seq", "offset", "n_ids", "crc", "index", "ids"])

        pending: list[np.ndarray] = []
        entries: list[tuple[int, int, int, int]] = []

        def close() -> None:
            nonlocal pending, entries, room
            if entries:
                blocks.append(np.concatenate(pending))
                index.append(entries)
            pending, entries, room = [], [], 0

        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                names = [NULL_ID if v is None else v for v in part.column(0).to_pylist()]
                flat, ends = byte_bpe(tokenizer).encode(part.column(1), ROWS)
                flat = np.insert(flat, ends, end_id)  # after each document
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                for name, a, b in zip(names, [0, *ends], ends, strict=False):
                    n = b - a
                    if n > block_ids:
                        close()
                        parts = -(-n // block_ids)
                        for k in range(a, b, block_ids):
                            own = flat[k : min(k + block_ids, b)]
                            pending, entries = [own], [(name, k - a, parts, len(own))]
                            close()
                    else:
                        if room + n > block_ids:
                            close()
                        pending.append(flat[a:b])
                        entries.append((name, 0, 1, n))
                        room += n
                    held += n
                if held > HELD_IDS:
                    close()
                    yield flush()
        close()
        if blocks:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, in ascending order of id, each followed by end_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    blocks = ordered.mapInArrow(lean(_blocks(tokenizer, end_id, block_ids), models=True), PLAIN)
    blocks.withColumn("payload", jvm_coder.encoded(docs.sparkSession, "ids")).drop("ids").write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, decoded, to documents and parts of documents: (shard, at, id, part, parts, ids)."""
    for whole in batches:
        for s in range(0, whole.num_rows, BLOCKS):
            batch = whole.slice(s, BLOCKS)
            shard, seq, offset, _, crc, index_, ids = (batch.column(i).to_pylist() for i in range(7))
            out: list[list] = [[] for _ in range(6)]
            for r, block in enumerate(ids):
                wide = np.frombuffer(block or b"", "<u2").astype("<u4").tobytes()
                if zlib.crc32(wide) != crc[r]:
                    raise ValueError(f"shard {shard[r]}, block {seq[r]}: checksum does not match")
                index = np.frombuffer(zlib.decompress(index_[r]), "<i8").reshape(-1, 4)
                ends = np.cumsum(index[:, 3])
                for (name, part, parts, n), end in zip(index.tolist(), ends.tolist(), strict=True):
                    for x, v in zip(out, (shard[r], offset[r] + end - n, None if name == NULL_ID else name, part, parts, wide[4 * (end - n) : 4 * end]), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], ["shard", "at", "id", "part", "parts", "ids"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decoded(batches):
        raw = [x.as_py() for x in batch.column(5)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["shard", "at", "id", "part", "parts", "n", "crc"])


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


#: How a CRC-32 register moves over 2**i zero bytes, as matrices over GF(2); made when first needed.
_shifts: list[list[int]] = []


def crc_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings one behind the other, from the CRC-32 of each: the first is moved over as many zeros."""
    at = 0
    while second_bytes:
        if at == len(_shifts):
            step = _shifts[-1] if _shifts else [0xEDB88320] + [1 << i for i in range(31)]  # the latter: one zero bit
            for _ in range(1 if _shifts else 3):
                step = [_times(step, row) for row in step]
            _shifts.append(step)
        if second_bytes & 1:
            first = _times(_shifts[at], first)
        second_bytes >>= 1
        at += 1
    return first ^ second


def _crc_of_parts(parts) -> int:
    """CRC of a long document from (part, n, crc) of its blocks; only documents of more than a block come here."""
    total = 0
    for p in sorted(parts):
        total = crc_joined(total, p.crc, 4 * p.n) if total or p.part else p.crc
    return total


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(the blocks of the files, the same with their ids for the payload)."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    return blocks, blocks.withColumn("ids", jvm_coder.decoded(spark, "payload", "n_ids")).drop("payload")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, before): ids of all shards before each; one row a file."""
    spark = blocks.sparkSession
    totals = [(r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()]
    before, rows = 0, []
    for shard, n in totals:
        rows.append((shard, before))
        before += n
    return spark.createDataFrame(rows, "shard long, before long")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, part, parts, start, ids): the documents, long ones in parts (part: ids of the document before it); ids little-endian unsigned 32-bit."""
    blocks, plain = _stored(spark, path)
    rows = plain.mapInArrow(lean(_decoded), "shard long, at long, id long, part long, parts long, ids binary")
    return rows.join(F.broadcast(shard_starts(blocks)), "shard").select("id", "part", "parts", (F.col("before") + F.col("at")).alias("start"), "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, read back from the files."""
    blocks, plain = _stored(spark, path)
    rows = written(plain.mapInArrow(lean(_checked), "shard long, at long, id long, part long, parts long, n long, crc long"), "token-digests")  # decoded once
    rows = rows.join(F.broadcast(shard_starts(blocks)), "shard").withColumn("start", F.col("before") + F.col("at"))
    whole = rows.where("parts = 1").select("id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    parts = rows.where("parts > 1").withColumn("start", F.col("start") - F.col("part"))
    long = parts.groupBy("id", "start").agg(F.sum("n").alias("n_tokens"), F.collect_list(F.struct("part", "n", "crc")).alias("p"))
    return whole.union(long.select("id", "start", "n_tokens", F.udf(_crc_of_parts, "long")("p").alias("ids_crc32")))


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .store import documents

    path = new_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, path).withColumnRenamed("id", "doc_id")
