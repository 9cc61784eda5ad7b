"""Removal of repeated byte strings: suffixes that may repeat are range-partitioned, sorted and compared.

A string of SPAN bytes that occurs twice shows the same minimal PIECE bytes at the same place in both (the leftmost
ones with the least hash). So only suffixes that start at such anchors, about one in fifteen, need to be known:

1. The anchors of all texts are grouped by the hash of their piece; pieces seen in one document only are dropped.
2. The suffixes left, with the bytes before them that a string of SPAN bytes can reach, go to buckets by splitters of
   their leading bytes. The splitters are a bounded sample; they only balance the load. Equal leading bytes always
   meet, so no comparison is open across a boundary.
3. A bucket sorts its suffixes by their bytes. Where neighbours share the piece, every window of SPAN bytes around it
   is compared, and a window that also starts in a document with a smaller id is marked.

Groups are pre-aggregated before each shuffle: inside a task, pieces known to repeat and contexts known to be copies
are settled at once and only one of each travels on. Texts are shuffled once; whole copies of texts are settled first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapak.llm.batches import slices
from lapak.llm.registry import query, table
from lapak.llm.words import mix

SPAN = 50
PIECE = 20
REACH = SPAN - PIECE
WIDTH = REACH + SPAN
SAMPLE = 20_000
BUCKET = 64 << 20  # bytes of text for each task and bucket
CHUNK = 1 << 18
FLUSH = 8 << 20
PART = 1 << 14
KEY = 6  # bytes of a piece hash that travel; equal ones by chance are told apart by the bytes themselves
LOW = np.uint64((1 << 20) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
NAMES = ["bucket", "kind", "a", "b", "c", "d", "e"]


def powers(n: int) -> list[np.uint64]:
    out, x = [], 1
    for _ in range(n):
        out.append(np.uint64(x))
        x = x * int(BASE) % (1 << 64)
    return out


POWER = powers(WIDTH + 1)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``width`` bytes along the last axis, by doubling."""
    size, hashed, done, out = 1, BYTE[data], 0, None
    while True:
        if width & size:
            if out is None:
                out, done = hashed, size
            else:
                keep = hashed.shape[-1] - done
                out = hashed[..., :keep] * POWER[done] + out[..., size:size + keep]
                done += size
        if done == width:
            return out[..., :data.shape[-1] - width + 1]
        n = hashed.shape[-1] - size
        hashed = hashed[..., :n] * POWER[size] + hashed[..., size:size + n]
        size *= 2


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and piece hashes of the anchors of all windows of SPAN bytes inside the texts that end at ``ends``."""
    found, hashes = [], []
    for begin in range(0, len(data) - SPAN + 1, CHUNK):
        part = data[begin:begin + CHUNK + SPAN - 1]
        piece = rolling(part, PIECE)
        key = (piece & ~LOW) | np.arange(len(piece), dtype=np.uint64)
        width = 1
        while width < REACH + 1:
            step = min(width, REACH + 1 - width)
            key = np.minimum(key[:-step], key[step:])
            width += step
        # Windows must end inside the text in which they start.
        texts = ends[np.searchsorted(ends, begin, "right"):np.searchsorted(ends, begin + len(key)) + 1]
        sizes = np.diff(np.minimum(np.concatenate(([begin], texts)), begin + len(key)))
        inside = np.arange(begin, begin + len(key)) <= np.repeat(texts, sizes) - SPAN
        at = (key[inside] & LOW).astype(np.int64)
        if len(at):
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            found.append(at + begin)
            hashes.append(piece[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, piece = np.concatenate(found), np.concatenate(hashes)
    fresh = np.concatenate(([True], at[1:] != at[:-1]))
    return at[fresh], piece[fresh]


def _planes(x: np.ndarray, size: int | None = None) -> bytes:
    """The low ``size`` bytes of numbers, bytes of equal weight side by side: zero bytes then vanish in compression."""
    return x.view(np.uint8).reshape(len(x), x.itemsize)[:, :size].T.tobytes()


def _unplane(raw: list[bytes], kind: str, size: int | None = None) -> np.ndarray:
    size = size or np.dtype(kind).itemsize
    out = np.zeros((sum(map(len, raw)) // size, np.dtype(kind).itemsize), np.uint8)
    at = 0
    for r in raw:
        n = len(r) // size
        out[at:at + n, :size] = np.frombuffer(r, np.uint8).reshape(size, n).T
        at += n
    return out.view(kind).ravel()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(columns)], NAMES)


def _spread(bucket: np.ndarray, arrays: list[np.ndarray]) -> list[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    return [(int(bucket[rows[0]]), [a[rows] for a in arrays]) for rows in np.split(order, cut) if len(rows)]


def _runs(sorted_key: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(sorted_key) else np.zeros(
        0, np.int64)


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets[1:] - offsets[0]


def _map_pieces(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0

        def flush():
            nonlocal turn
            doc, at, piece = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, piece))
            doc, at, piece = doc[order], at[order], piece[order]
            start = _runs(piece)
            length = np.diff(np.append(start, len(piece)))
            several = doc[start] != doc[start + length - 1]
            known = np.repeat(several, length)
            turn += 1
            rows = [(turn % buckets, 1, b"", _planes(doc[known]), _planes(at[known].astype(np.uint32)), b"", b"")]
            # Of a piece seen in several documents here, one row tells the other tasks.
            send = ~known
            send[start[several]] = True
            code = mix(piece[send])
            where = (code % np.uint64(buckets)).astype(np.int64)
            for b, (p, d, a, k) in _spread(where, [code >> np.uint64(16), doc[send], at[send], known[send]]):
                rows.append((b, 0, _planes(p, KEY), _planes(d), _planes(a.astype(np.uint32)), np.packbits(k).tobytes(), b""))
            return _batch(rows)

        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                ids = batch.column("doc_id")
                copies = batch.column("copies").to_pylist()
                text_hash = batch.column("text_hash").to_pylist()
                use = [i is not None and not (c and h in c) for i, c, h in zip(ids.to_pylist(), copies, text_hash)]
                kept = batch.filter(pa.array(use, pa.bool_()))
                if not kept.num_rows:
                    continue
                data, ends = _text_bytes(kept.column("text"))
                at, piece = anchors(data, ends)
                if not len(at):
                    continue
                row = np.searchsorted(ends, at, "right")
                doc = kept.column("doc_id").to_numpy().astype(np.int64)
                held.append((doc[row], at - np.concatenate(([0], ends))[row], piece))
                size += len(data)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _reduce_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(doc, at):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at.astype(np.int32))], ["doc_id", "at"])

    held = []
    for batch in batches:
        for kind, *cells in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b", "c", "d"))):
            if kind:
                yield out(_unplane([cells[1]], "<i8"), _unplane([cells[2]], "<u4"))
            else:
                held.append(cells)
    if held:
        piece = _unplane([c[0] for c in held], "<u8", KEY)
        doc, at = _unplane([c[1] for c in held], "<i8"), _unplane([c[2] for c in held], "<u4")
        known = np.concatenate([np.unpackbits(np.frombuffer(c[3], np.uint8))[:len(c[0]) // KEY] for c in held]).astype(bool)
        order = np.lexsort((doc, piece))
        piece, doc, at, known = piece[order], doc[order], at[order], known[order]
        start = _runs(piece)
        length = np.diff(np.append(start, len(piece)))
        take = np.repeat(doc[start] != doc[start + length - 1], length) & ~known
        yield out(doc[take], at[take])


def _map_contexts(splitters: np.ndarray):
    buckets = len(splitters) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0

        def flush():
            nonlocal turn
            doc, text_hash, at, left, right, context = (np.concatenate(x) for x in zip(*held))
            code = rolling(context, WIDTH)[:, 0] * BASE + left.astype(np.uint64) * np.uint64(64) + right.astype(np.uint64)
            order = np.lexsort((doc, code))
            doc, text_hash, at, left, right, context = (x[order] for x in (doc, text_hash, at, left, right, context))
            start = _runs(code[order])
            length = np.diff(np.append(start, len(order)))
            later = doc > np.repeat(doc[start], length)
            full = later & (left.astype(int) + right >= SPAN)
            turn += 1
            rows = [(turn % buckets, 1, _planes(doc[full]), _planes(text_hash[full]),
                     _planes((at[full] - left[full]).astype(np.uint32)), _planes((at[full] + right[full]).astype(np.uint32)),
                     b"")]
            lead = np.ascontiguousarray(context[:, REACH:REACH + 8]).view(">u8").ravel().astype(np.uint64)
            where = np.searchsorted(splitters, lead[~later], "right")
            for b, (d, h, a, lr, c) in _spread(where, [doc[~later], text_hash[~later], at[~later].astype(np.uint32),
                                                       np.stack((left, right), 1)[~later], context[~later]]):
                rows.append((b, 0, _planes(d), _planes(h), _planes(a), lr.tobytes(), c.tobytes()))
            return _batch(rows)

        for whole in batches:
            for batch in slices(whole, "text", CHUNK):
                some = batch.filter(batch.column("at").is_valid())
                if not some.num_rows:
                    continue
                data, ends = _text_bytes(some.column("text"))
                begin = np.concatenate(([0], ends))[:-1]
                lists = some.column("at")
                row = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy())
                at = lists.flatten().to_numpy().astype(np.int64)
                order = np.lexsort((at, row))
                row, at = row[order], at[order]
                fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])))
                fresh &= at + PIECE <= (ends - begin)[row]  # another text of the same id may be shorter
                row, at = row[fresh], at[fresh]
                doc, text_hash = (some.column(c).to_numpy() for c in ("doc_id", "text_hash"))
                spread = np.arange(-REACH, SPAN)
                for first in range(0, len(row), PART):
                    r, p = row[first:first + PART], at[first:first + PART]
                    left, right = np.minimum(p, REACH), np.minimum(ends[r] - begin[r] - p, SPAN)
                    index = np.clip((begin[r] + p)[:, None] + spread, 0, len(data) - 1)
                    inside = (spread >= -left[:, None]) & (spread < right[:, None])
                    context = np.where(inside, data[index], 0).astype(np.uint8)
                    held.append((doc[r], text_hash[r], p, left.astype(np.uint8), right.astype(np.uint8), context))
                    size += context.size
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return run


def _reduce_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(doc, text_hash, start, end):
        return pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(text_hash), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
            ["doc_id", "text_hash", "start", "end"])

    held = []
    for batch in batches:
        for kind, *cells in zip(*(batch.column(c).to_pylist() for c in NAMES[1:])):
            if kind:
                doc, text_hash = (_unplane([c], "<i8") for c in cells[:2])
                yield out(doc, text_hash, *(_unplane([c], "<u4") for c in cells[2:4]))
            else:
                held.append(cells)
    if not held:
        return
    doc, text_hash = (_unplane([c[k] for c in held], "<i8") for k in (0, 1))
    at = _unplane([c[2] for c in held], "<u4").astype(np.int64)
    left, right = np.frombuffer(b"".join(c[3] for c in held), np.uint8).reshape(-1, 2).T.astype(np.int64)
    context = np.frombuffer(b"".join(c[4] for c in held), np.uint8).reshape(-1, WIDTH)
    order = np.argsort(np.ascontiguousarray(context[:, REACH:]).view(f"S{SPAN}").ravel(), kind="quicksort")
    doc, text_hash, at, left, right, context = (x[order] for x in (doc, text_hash, at, left, right, context))
    piece = context[:, REACH:REACH + PIECE]
    start = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]).any(1))))
    length = np.diff(np.append(start, len(piece)))
    several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
    group = np.repeat(np.arange(len(start), dtype=np.uint64), length)[np.repeat(several, length)]
    rows = np.flatnonzero(np.repeat(several, length))
    # Whole groups, about PART suffixes at a time.
    cuts = np.unique(np.append(np.searchsorted(group, group[::PART]), len(rows))) if len(rows) else []
    for a, b in zip(cuts, cuts[1:]):
        here = rows[a:b]
        windows = rolling(context[here], SPAN)  # column k starts REACH - k bytes before the anchor
        hit = np.zeros(windows.shape, bool)
        for k in range(REACH + 1):
            before = REACH - k
            valid = np.flatnonzero((before <= left[here]) & (SPAN - before <= right[here]))
            code, owner = mix(windows[valid, k] + group[a:b][valid] * BASE), doc[here][valid]
            by = np.lexsort((owner, code))
            first = _runs(code[by])
            least = np.repeat(owner[by][first], np.diff(np.append(first, len(by))))
            hit[valid[by], k] = owner[by] > least
        # Neighbouring windows of one anchor are one stretch.
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, opens = np.nonzero(edge == 1)
        closes = np.nonzero(edge == -1)[1] - 1
        row = here[row]
        yield out(doc[row], text_hash[row], at[row] - REACH + opens, at[row] - REACH + closes + SPAN)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            data, ends = _text_bytes(batch.column("text"))
            lists = batch.column("spans")
            flat = lists.flatten()
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            offset = np.concatenate(([0], np.cumsum(counts)))
            hashes, starts, stops = (flat.field(c).to_numpy() for c in ("text_hash", "start", "end"))
            rows, kept = [], []
            for i, (begin, end, own, copies) in enumerate(zip(
                    np.concatenate(([0], ends))[:-1].tolist(), ends.tolist(), batch.column("text_hash").to_pylist(),
                    batch.column("copies").to_pylist())):
                text, size = data[begin:end], end - begin
                if copies and own in copies and size >= SPAN:
                    runs = np.array([[0, size]])
                else:
                    s = slice(offset[i], offset[i + 1])
                    mine = hashes[s] == own
                    order = np.argsort(starts[s][mine], kind="stable")
                    a, b = starts[s][mine][order], np.maximum.accumulate(stops[s][mine][order]) if mine.any() else stops[:0]
                    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1]))) if len(a) else np.zeros(0, np.int64)
                    runs = np.stack((a[new], b[np.append(new[1:], len(a)) - 1]), 1) if len(a) else np.zeros((0, 2), np.int64)
                keep = np.ones(size, bool)
                for a, b in runs.tolist():
                    keep[a:b] = False
                left = text[keep].tobytes() if len(runs) else text.tobytes()
                kept.append(left)
                rows.append((size, size - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    A byte goes if a string of SPAN bytes that covers it also starts in a document with a smaller id; strings are
    judged on the input. Texts are UTF-8 bytes, a null text is empty. Rows of one id never remove from each other;
    rows with a null id neither remove nor lose anything. ``kept`` may end inside a character, so it is binary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # Tasks and buckets follow the size of the texts, so what one of them holds does not grow with the table.
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    hashed = rows.select("doc_id", F.md5("text").alias("m"), F.xxhash64("text").alias("text_hash"))
    first = hashed.groupBy("m").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    later = hashed.join(first, "m").filter("doc_id > first")
    copies = later.groupBy("doc_id").agg(F.collect_set("text_hash").alias("copies"))

    # The one shuffle of texts; all three uses below read it.
    placed = rows.repartition(n, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    marked = placed.join(copies.hint("shuffle_hash"), "doc_id", "left")
    pieces = marked.select("doc_id", "text", "text_hash", "copies").mapInArrow(_map_pieces(n), PACKED)
    repeated = pieces.repartitionById(n, F.col("bucket")).mapInArrow(_reduce_pieces, "doc_id long, at int")
    places = repeated.groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    located = placed.join(places.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "text_hash", "at")
    contexts = located.mapInArrow(_map_contexts(splitters(rows, total, n)), PACKED)
    spans = contexts.repartitionById(n, F.col("bucket")).mapInArrow(
        _reduce_contexts, "doc_id long, text_hash long, start int, end int")
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "start", "end")).alias("spans"))
    all_known = marked.join(per_doc.hint("shuffle_hash"), "doc_id", "left").select(
        "doc_id", "text", "text_hash", "copies", "spans")
    return all_known.mapInArrow(
        _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def splitters(rows: DataFrame, total: int, buckets: int) -> np.ndarray:
    """Ascending leading bytes that cut the suffixes into ``buckets`` ranges, from a sample of at most about SAMPLE."""
    at = F.pmod(F.xxhash64("text", F.lit(7)), F.greatest(F.length("text") - 8, F.lit(1))) + 1
    part = rows.sample(False, min(1.0, SAMPLE / max(total, 1)), 11).select(
        F.encode(F.substring("text", at.cast("int"), F.lit(8)), "utf-8").alias("lead"))
    lead = sorted(int.from_bytes(bytes(r["lead"][:8]).ljust(8, b"\0"), "big") for r in part.collect())
    if not lead:
        return np.zeros(0, np.uint64)
    return np.unique(np.array([lead[len(lead) * k // buckets] for k in range(1, buckets)], np.uint64))


@query("op10_suffix_array_dedup")
def _(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
