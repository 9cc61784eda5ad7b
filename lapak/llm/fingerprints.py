"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once. The high bits of the hash choose one of BINS bins, the rest competes for the
minimum there. Empty bins are filled by optimal densification: each draws other bins by a hash until it meets one that
had a shingle. The lowest eight bits of every bin make the fingerprint; equal bins by chance are taken out of the
estimated likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lapak.llm.batches import slices
from lapak.llm.registry import query, table
from lapak.llm.words import GOLDEN, mix, shingles

BINS = 256
WORDS = 5
CHANCE = 1 / 256


def fingerprint(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (one byte per bin) and whether a text has any word; without words the bytes are zero."""
    hashes, counts = shingles(texts, WORDS)
    n, high = len(counts), np.uint64(64 - BINS.bit_length() + 1)
    unset = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full(n * BINS, unset)
    slot = np.repeat(np.arange(n), counts) * BINS + (hashes >> high).astype(np.int64)
    np.minimum.at(least, slot, hashes & ((np.uint64(1) << high) - np.uint64(1)))
    least = least.reshape(n, BINS)
    filled, some = least != unset, counts > 0
    row, bin_ = np.nonzero(~filled & some[:, None])
    out, attempt = least.copy(), 0
    while len(row):
        attempt += 1
        with np.errstate(over="ignore"):
            other = (mix(bin_.astype(np.uint64) * GOLDEN + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        hit = filled[row, other]
        out[row[hit], bin_[hit]] = least[row[hit], other[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    out[~some] = 0
    return (out & np.uint64(255)).astype(np.uint8), some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles; two texts without words are alike, one such text is like no other."""
    same = ((a == b).mean(1) - CHANCE) / (1 - CHANCE)
    return np.where(some_a & some_b, np.clip(same, 0.0, 1.0), (some_a == some_b).astype(float))


def _hex(prints: np.ndarray, some: np.ndarray) -> list[str]:
    return [p.tobytes().hex() if s else "" for p, s in zip(prints, some)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of every text, without a shuffle. Null and wordless texts have an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(_hex(*fingerprint(batch.column("text"))), pa.string())],
                    ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edit(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the following text."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _compared(ids: pa.Array, texts: list[str], following: list[str], chained: bool) -> pa.RecordBatch:
    """Result rows; ``chained``: ``following`` is ``texts`` moved up by one, with one text more at its end."""
    edited = [edit(t, f) for t, f in zip(texts, following)]
    all_texts = texts + following[-1:] if chained else texts + following
    prints, some = fingerprint(pa.array(all_texts, pa.string()))
    changed, some_changed = fingerprint(pa.array(edited, pa.string()))
    n = len(texts)
    after = slice(1, n + 1) if chained else slice(n, None)
    return pa.RecordBatch.from_arrays([
        ids, pa.array(map(len, texts), pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
        pa.array(_hex(prints[:n], some[:n]), pa.string()), pa.array(_hex(changed, some_changed), pa.string()),
        pa.array(likeness(prints[:n], some[:n], changed, some_changed)),
        pa.array(likeness(prints[:n], some[:n], prints[after], some[after]))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edited form, in descending doc_id order, the first following the last.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is an
    empty one. Null ids come last; rows of one doc_id are ordered by their texts. A single row follows itself. An
    empty table gives no rows.

    One range shuffle brings neighbours together; only the first and last text of each partition meet once more.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), "text")
    out = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held = None, []
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id")
                texts = held + batch.column("text").to_pylist()
                if held:
                    ids = pa.concat_arrays([held_id, ids])
                if len(texts) > 1:
                    yield _compared(ids.slice(0, len(texts) - 1), texts[:-1], texts[1:], True)
                held_id, held = ids.slice(len(texts) - 1), texts[-1:]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or batch.column("text").slice(0, 1)
                last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), first, last.column("doc_id"),
                 last.column("text")], ["part", "head", "doc_id", "text"])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                if batch.num_rows:
                    yield _compared(batch.column("doc_id"), batch.column("text").to_pylist(),
                                    batch.column("head").to_pylist(), False)

    # One row per partition of the range shuffle, so this window without a key stays as small as their number.
    along = Window.orderBy("part")
    tails = ordered.mapInArrow(ends, f"part int, head string, doc_id {kind}, text string")
    joined = tails.select("doc_id", "text", F.coalesce(
        F.lead("head").over(along), F.first("head").over(along)).alias("head"))
    return ordered.mapInArrow(inner, out).unionByName(joined.mapInArrow(outer, out))


@query("op8_document_fingerprints")
def _(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
