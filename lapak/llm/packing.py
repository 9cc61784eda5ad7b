"""Best-fit packing of token sequences by minimum bin slack.

Piece lengths are whole numbers up to the capacity, so their counts are one small histogram (at most ``capacity``
rows) however many documents there are. The packing is planned on it: the longest free length opens a bin, a bitset
subset-sum finds the fullest feasible combination of the free lengths for the rest, and the same combination is taken
as often as the counts allow. Each piece then finds its bin from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lapak.llm.batches import slices, written
from lapak.llm.registry import query, table
from lapak.llm.words import TOKENIZER, word_ids

CAPACITY = 4096
END_ID = 1
SALTS = 256


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids).

    A null text is an empty one and has its end id only. Only documents longer than the capacity have more pieces.
    """
    keyed = docs.schema["doc_id"]
    out = f"doc_id {keyed.dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    out += ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, counts = encoder.encode(batch.column("text"))
                ends = np.cumsum(counts)
                counts = counts + 1
                ids = np.insert(ids, ends, end_id).astype("<u4")
                starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), pieces)
                nth = np.arange(len(row)) - np.concatenate(([0], np.cumsum(pieces)))[:-1][row]
                size = np.minimum(counts[row] - nth * capacity, capacity)
                begin = starts[row] + nth * capacity
                crc = [zlib.crc32(ids[b:b + n]) for b, n in zip(begin.tolist(), size.tolist())]
                columns = [batch.column("doc_id").take(pa.array(row)), pa.array(nth, pa.int32()),
                           pa.array(nth * capacity, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.concatenate((begin, [len(ids)])), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(cut, out)


def fullest(free: dict[int, int], slack: int) -> dict[int, int]:
    """Lengths and how often each is taken, with the largest sum up to ``slack`` that ``free`` counts allow."""
    reach, limit, steps = 1, (1 << (slack + 1)) - 1, []
    for length in sorted((x for x in free if x <= slack and free[x]), reverse=True):
        left, part = min(free[length], slack // length), 1
        while left and not reach >> slack & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & limit
            left, part = left - part, part * 2
        if reach >> slack & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            total -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many, lengths in each). Every entry uses up a length or leaves fewer of it than one bin takes."""
    free, bins = {n: c for n, c in counts.items() if c}, []
    for longest in sorted(free, reverse=True):
        while free[longest]:
            free[longest] -= 1
            need = fullest(free, capacity - longest)
            free[longest] += 1
            need[longest] = need.get(longest, 0) + 1
            times = min(free[n] // k for n, k in need.items())
            for n, k in need.items():
                free[n] -= k * times
            bins.append((times, need))
    return bins


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """Place the pieces of all documents in sequences of at most ``capacity`` ids.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids). Inside a sequence the pieces lie
    without gaps. Null ids, repeated rows and extra columns are allowed: each row is packed as a document of its own.
    An empty table gives no rows.

    Ranks inside a length are made per (length, salt) and shifted by the sizes of earlier salts, so a length that a
    third of all pieces share is many small groups.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    order = ["doc_id", "piece", "ids_crc32"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1
    ranked = salted.withColumn("_in", inside).join(before, ["length", "_salt"]).withColumn(
        "_rank", (F.col("_before") + F.col("_in")).cast("long"))

    # At most one row per possible length reaches the driver.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    used, spans, first_bin = dict.fromkeys(counts, 0), [], 0
    for times, need in plan(counts, capacity):
        offset = 0
        for length, each in need.items():
            spans.append((length, used[length], each, offset, first_bin))
            used[length] += each * times
            offset += each * length
        first_bin += times
    spans.sort()
    place = np.array(spans, np.int64).reshape(-1, 5)
    keys = (place[:, 0] << 48) + place[:, 1]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    out = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = place[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(at[:, 4] + nth // at[:, 2]),
                                                    pa.array(at[:, 3] + nth % at[:, 2] * length)],
                [*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(assign, out)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from ``pack(..., with_ids=True)``. A group holds at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


@query("op6_best_fit_packing")
def _(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
