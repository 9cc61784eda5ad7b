"""Token ids as files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

A token folder holds ``codes`` (id, bits: the code lengths, from which the canonical codes follow) and ``blocks``.
A block has whole documents in ascending order, each starting at a byte, and for every document the bit offset of
each STEP-th id. Blocks decode alone, and inside a block all checkpoints decode at once by table look-up.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lapak.llm.batches import slices, written
from lapak.llm.registry import query, table
from lapak.llm.words import TOKENIZER, word_ids
from lapak.session import checkpoint_dir

END_ID = 2
MAX_BITS = 17
STEP = 256
BLOCK_TOKENS = 1 << 16


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for ascending positive counts (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    row, leaf_rows = counts, []
    for level in range(limit):
        if level:
            row = np.concatenate((counts, row[:-1:2] + row[1::2] if len(row) % 2 == 0 else row[:-2:2] + row[1:-1:2]))
        order = np.argsort(row, kind="stable")
        leaf_rows.append(order < n if level else np.ones(n, bool))
        row = row[order]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaves in reversed(leaf_rows):
        taken = int(leaves[:take].sum())
        lengths[:taken] += 1
        take = 2 * (take - taken)
    return lengths


def canonical(bits: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in canonical order with their lengths and codes."""
    pairs = sorted((b, i) for i, b in bits.items())
    length = np.array([b for b, _ in pairs], np.int64)
    ids = np.array([i for _, i in pairs], np.int64)
    if not len(pairs):
        return ids, length, ids
    top = int(length.max())
    room = np.left_shift(1, top - length)
    return ids, length, (np.cumsum(room) - room) >> (top - length)


def document_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id and its ids as little-endian unsigned 16-bit (or 32-bit) numbers, the end id last."""
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, wide boolean, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, counts = encoder.encode(batch.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
                width = 4 if wide else 2
                counts = counts + 1
                ends = np.concatenate(([0], np.cumsum(counts))) * width
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts),
                    [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(f"<u{width}"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([wide] * len(counts)), data],
                    ["doc_id", "n", "wide", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, out)


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    wide, ids = batch.column("wide").to_pylist(), batch.column("ids").to_pylist()
    return np.concatenate([np.frombuffer(x, "<u4" if w else "<u2").astype(np.uint32) for w, x in zip(wide, ids)])


def count_ids(ids: DataFrame) -> DataFrame:
    """id and its number of uses; counted inside the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for whole in batches:
            for batch in slices(whole, "ids"):
                found = np.bincount(_numbers(batch))
                if len(found) > len(total):
                    total, found = found, total
                total[:len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    return ids.select("wide", "ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(ids: DataFrame, path: str, max_bits: int = MAX_BITS) -> None:
    """Write a token folder from the rows of ``document_ids`` in ascending doc_id order.

    The counts that reach the driver are at most one per id of the vocabulary. Null ids come first; rows of one doc_id
    are ordered by their ids.
    """
    spark = ids.sparkSession
    counted = sorted((r["n"], r["id"]) for r in count_ids(ids).collect())
    limit = max(max_bits, (len(counted) - 1).bit_length(), 1)
    lengths = code_lengths(np.array([n for n, _ in counted], np.int64), limit)
    bits = {i: int(b) for (_, i), b in zip(counted, lengths)}
    spark.createDataFrame([(i, b) for i, b in bits.items()], "id int, bits int").coalesce(1).write.parquet(f"{path}/codes")
    order, length, code = canonical(bits)
    code_of, length_of = (np.zeros(int(order.max()) + 1 if len(order) else 1, np.int64) for _ in range(2))
    code_of[order], length_of[order] = code, length
    doc_type = ids.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids", 1 << 20):
                numbers, n = _numbers(batch), batch.column("n").to_numpy()
                size, first = length_of[numbers], np.concatenate(([0], np.cumsum(n)))
                flat = np.concatenate(([0], np.cumsum(size)))
                held = (flat[first[1:]] - flat[first[:-1]] + 7) // 8
                begin = np.concatenate(([0], np.cumsum(held)))
                bit = flat[:-1] + np.repeat(begin[:-1] * 8 - flat[first[:-1]], n)
                value = code_of[numbers] << (32 - size - (bit & 7))
                total = int(begin[-1]) + 4
                packed = np.zeros(total, np.uint8)
                for k in range(4):
                    packed += np.bincount((bit >> 3) + k, (value >> (24 - 8 * k)) & 255, total).astype(np.uint8)
                raw, marks = packed.tobytes(), []
                for r in range(len(n)):
                    marks.append((bit[first[r]:first[r + 1]:STEP] - begin[r] * 8).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()),
                     pa.array([raw[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())], pa.binary()),
                     pa.array(marks, pa.list_(pa.int64()))], ["doc_id", "n", "bits", "marks"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held, rows = TaskContext.get().partitionId(), 0, 0, 0, []

        def made():
            payload, marks, at = b"".join(r[2] for r in rows), [], 0
            for _, _, data, own in rows:
                marks += [m + at * 8 for m in own]
                at += len(data)
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": number, "first": before, "doc_ids": [r[0] for r in rows],
                "sizes": [r[1] for r in rows], "marks": marks, "payload": payload}], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()),
                           ("doc_ids", pa.list_(key_type)), ("sizes", pa.list_(pa.int64())),
                           ("marks", pa.list_(pa.int64())), ("payload", pa.binary())])
        for whole in batches:
            for row in zip(*(whole.column(c).to_pylist() for c in ("doc_id", "n", "bits", "marks"))):
                rows.append(row)
                held += row[1]
                if held >= BLOCK_TOKENS:
                    yield made()
                    number, before, held, rows = number + 1, before + held, 0, []
        if rows:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(ids.schema["doc_id"].dataType)
    encoded = ids.mapInArrow(encode, f"doc_id {doc_type}, n long, bits binary, marks array<long>")
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "bits")
    ordered.mapInArrow(block, f"part int, block int, first long, doc_ids array<{doc_type}>, sizes array<long>, "
                              "marks array<long>, payload binary").write.option("compression", "none").parquet(
        f"{path}/blocks")


def decode_block(payload: bytes, marks: np.ndarray, lanes: np.ndarray, symbols: np.ndarray, lengths: np.ndarray,
                 top: int) -> np.ndarray:
    """Ids of all lanes in order; a lane starts at a bit offset and holds up to STEP ids."""
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at, last = marks.copy(), (len(words) - 1) * 8
    steps = int(lanes.max()) if len(lanes) else 0
    out = np.empty((steps, len(lanes)), np.uint32)
    for k in range(steps):
        found = (words[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(32 - top)
        out[k] = symbols[found]
        at = np.minimum(at + lengths[found], last)
    return out.T[np.arange(steps) < lanes[:, None]]


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a token folder in its order: doc_id, start, n_tokens, ids_crc32 (and ids).

    ``start`` needs the sizes of the written parts only, one small row each.
    """
    bits = {r["id"]: r["bits"] for r in spark.read.schema("id int, bits int").parquet(f"{path}/codes").collect()}
    order, length, _ = canonical(bits)
    top = int(length.max()) if len(length) else 1
    room = np.left_shift(1, top - length)
    symbols, lengths = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    symbols[:room.sum()], lengths[:room.sum()] = np.repeat(order, room), np.repeat(length, room)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("base"))
    # One row of two numbers per written part, of which there are as many as shuffle partitions.
    placed = blocks.join(F.broadcast(base), "part").withColumn("first", F.col("first") + F.col("base")).select(
        "first", "doc_ids", "sizes", "marks", "payload")
    doc_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    out = f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload"):
                payloads = batch.column("payload").to_pylist()
                base_bits = np.concatenate(([0], np.cumsum([len(p) for p in payloads])))[:-1] * 8
                marks = np.concatenate([np.array(m, np.int64) + b for m, b in zip(
                    batch.column("marks").to_pylist(), base_bits)])
                sizes = batch.column("sizes").to_pylist()
                n = np.array([x for s in sizes for x in s], np.int64)
                per = -(-n // STEP)
                lanes = np.full(len(marks), STEP, np.int64)
                ends = np.cumsum(per) - 1
                lanes[ends] = n - (per - 1) * STEP
                ids = decode_block(b"".join(payloads), marks, lanes, symbols, lengths, top).astype("<u4")
                at = np.concatenate(([0], np.cumsum(n)))
                begin = [int(f) + int(x) for f, s in zip(batch.column("first").to_pylist(), sizes)
                         for x in np.cumsum([0, *s])[:-1]]
                columns = [batch.column("doc_ids").flatten(), pa.array(begin, pa.int64()), pa.array(n, pa.int64()),
                           pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return placed.mapInArrow(run, out)


def token_round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Encode, write below the shared folder, and read back.

    A null text counts as empty; every row, repeated or with a null id, is a document; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/lapak-tokens-{uuid.uuid4().hex}"
    write_tokens(written(document_ids(docs, tokenizer, end_id), "ids"), path)
    return read_tokens(spark, path)


@query("op9_token_file")
def _(spark, sf_dir):
    return token_round_trip(table(spark, sf_dir, "documents"))
