"""Near duplicates by ProbMinHash.

Texts are weighted sets of five-word shingles, the weight being the count. Every shingle is a Poisson process: its
arrivals come at rates of its weight, and each arrival draws one of SLOTS slots. A slot keeps the shingle that arrives
first; a shingle stops as soon as its next arrival is later than all slots. Two signatures agree in a slot with the
probability Jaccard similarity of the texts. Eight slots make a band, and texts that share a band are candidates.

Candidates are verified by the exact probability Jaccard similarity. In a band bucket every member is verified against
one member first, and then against one of a random small group; what falls into one component needs no comparison any
more. For what is left, the members outside a bucket's largest component meet all others in blocks inside the tasks: pairs
of different components that come within six standard errors of the threshold by their slots are verified there, the most
alike first, and a component found in a task is not compared again. So a task returns links of a forest, never the pairs
it has looked at, and a pair is looked at only in the first band that both texts share. Every two texts that share a
bucket either are in one component, or were verified, or are unlike by their slots; a link falls out with less than 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lapak.llm.batches import slices, written
from lapak.llm.components import components
from lapak.llm.registry import query, table
from lapak.llm.words import GOLDEN, mix, shingles

WORDS = 5
SIMILAR = 0.8
BANDS = 64
ROWS = 8
SLOTS = BANDS * ROWS
SLICE_BYTES = 1 << 19
SLICE_ROWS = 400
CELLS = 1 << 14
STAR = 8
BLOCK = 1024
BLOCK_CHARS = 8 << 20
# Six standard errors of the estimate from the slots, below which a pair is taken for unlike.
MARGIN = 6 * (SIMILAR * (1 - SIMILAR) / SLOTS) ** 0.5


def weighted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: shingle, count, row of the text; sorted by row and shingle."""
    hashes, counts = shingles(texts, WORDS)
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if not len(row):
        return hashes, counts[:0], row
    start = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))))
    return hashes[start], np.diff(np.append(start, len(row))), row[start]


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """ProbMinHash signatures (one shingle per slot) and whether a text has any word."""
    shingle, weight, row = weighted(texts)
    n = len(texts)
    size = np.bincount(row, minlength=n)
    arrival, signature = np.full(n * SLOTS, np.inf), np.zeros(n * SLOTS, np.uint64)
    last, drawn = np.zeros(len(row)), np.zeros(len(row), np.uint64)
    active, first = np.arange(len(row)), True
    while len(active):
        # As many arrivals at once as fill the slots of a text in the mean, then fewer.
        blocks = np.maximum(1, (SLOTS * 6 if first else SLOTS) // size[row[active]])
        first = False
        for block in np.unique(blocks).tolist():
            same, height = active[blocks == block], max(1, CELLS // block)
            steps = np.arange(1, block + 1, dtype=np.uint64) * GOLDEN
            for at in range(0, len(same), height):
                part = same[at:at + height]
                draw = mix((shingle[part] + drawn[part] * GOLDEN)[:, None] + steps)
                gap = np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / -weight[part][:, None]
                when = np.cumsum(gap, axis=1) + last[part][:, None]
                last[part] = when[:, -1]
                drawn[part] += np.uint64(block)
                slot = (row[part] * SLOTS)[:, None] + (draw & np.uint64(SLOTS - 1)).astype(np.int64)
                early = when < arrival[slot]
                slot, when, who = slot[early], when[early], part[np.nonzero(early)[0]]
                np.minimum.at(arrival, slot, when)
                won = arrival[slot] == when
                signature[slot[won]] = shingle[who[won]]
        latest = arrival.reshape(n, SLOTS).max(1)
        active = active[last[active] < latest[row[active]]]
    return signature.reshape(n, SLOTS), size > 0


def band_hashes(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = mix(out + parts[:, :, k] * GOLDEN)
    return out.view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets of sorted distinct elements.

    Rounded to ten digits, so that a pair at the threshold is on one side of it in whichever order the two come.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = x / x.sum(), y / y.sum()
    u, v = x[i], y[j]
    order = np.argsort(v / u, kind="stable")
    u, v = u[order], v[order]
    ratio = v / u
    upto = np.searchsorted(ratio, ratio * (1 + 1e-12), "right")
    left = (1 - u.sum()) + np.concatenate(([0], np.cumsum(u)))[upto]
    right = (1 - v.sum()) + v.sum() - np.concatenate(([0], np.cumsum(v)))[upto]
    return round(float((1 / (left / u + right / v)).sum()), 10)


def _signed(docs: DataFrame) -> DataFrame:
    """md5 of each text, its band hashes (none without words), and one byte of each slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES, SLICE_ROWS):
                signature, some = signatures(batch.column("text"))
                bands = band_hashes(signature)
                offsets = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
                sketch = (mix(signature) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("md5"),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[some].ravel())),
                     pa.array([row.tobytes() for row in sketch], pa.binary())], ["doc_id", "md5", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "md5", "text").mapInArrow(run, f"doc_id {kind}, md5 binary, bands array<long>, sketch binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and their similarity. One text per pair is shuffled; adaptive execution splits a node with many pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held = None, None
        for whole in batches:
            for batch in slices(whole, "text_b", 1 << 21):
                a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
                new = [k for k in range(len(a)) if k == 0 or a[k] != a[k - 1]]
                sets = []
                for column in (batch.column("text_a").take(pa.array(new)), batch.column("text_b")):
                    shingle, weight, row = weighted(column)
                    cut = np.searchsorted(row, np.arange(len(column) + 1))
                    sets.append([(shingle[p:q], weight[p:q]) for p, q in zip(cut[:-1], cut[1:])])
                at, out = -1, []
                for k in range(len(a)):
                    at += k == 0 or a[k] != a[k - 1]
                    out.append(probability_jaccard(*sets[0][at], *sets[1][k]))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "similarity"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(second, "b").join(first, "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Candidate pairs (a, b) of different components: every bucket is dealt into groups of about STAR members, anew each
    turn, and one member of each group meets the others. So a member meets another one in each of its buckets."""
    order = F.xxhash64("node", F.lit(turn))
    dealt = members.withColumn("_group", F.pmod(order, F.ceil(F.col("size") / STAR)))
    centre = dealt.groupBy("key", "_group").agg(
        F.min(F.struct(order.alias("o"), "node", "root")).alias("c"), F.max("root").alias("_high"), F.min("root").alias("_low")
    ).filter("_low < _high").select("key", "_group", F.col("c.node").alias("a"), F.col("c.root").alias("_root"))
    return dealt.join(centre, ["key", "_group"]).filter(F.col("root") != F.col("_root")).select(
        F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots (node, root) after the components that ``links`` connect have become one; nodes without a row are alone."""
    if roots is None:
        return components(links)
    for side in ("a", "b"):
        links = _rooted(links, side, roots, f"_{side}")
    joined = components(links.filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    up = joined.select(F.col("node").alias("_from"), F.col("root").alias("_top"))
    moved = roots.join(up, roots["root"] == up["_from"], "left").select("node", F.coalesce("_top", "root").alias("root"))
    fresh = joined.join(roots.select("node"), "node", "left_anti")
    return written(moved.unionByName(fresh), "roots")


def _rooted(rows: DataFrame, node: str, roots: DataFrame, out: str) -> DataFrame:
    named = roots.select(F.col("node").alias("_of"), F.col("root").alias("_root_of"))
    return rows.join(named, F.col(node) == F.col("_of"), "left").withColumn(out, F.coalesce("_root_of", node)).drop(
        "_of", "_root_of")


def near_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, md5 (of its text), text_id and class_id.

    ``text_id`` is the least doc_id with the same text, ``class_id`` the least of all texts connected by similarities of
    at least ``similar``. A null text counts as an empty one. Texts without words are like none but their copies; a text
    of fewer than five words has one shingle of all its words. Rows with a null id join classes, and a class of such
    rows only has a null class_id. Repeated rows each give a row; an empty table gives none.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("md5", F.unhex(F.md5("text")))
    signed = _signed(rows)
    distinct = signed.groupBy("md5").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands"),
                                         F.first("sketch").alias("sketch"))
    nodes = written(distinct.withColumn("node", F.monotonically_increasing_id()), "texts")
    bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(bands.join(shared, "key").select("key", "node", "low", "size"), "members")
    wanted = nodes.select("node", "md5").join(members.select("node").distinct(), "node")
    found = rows.select("md5", "text").join(wanted, "md5")
    texts = written(found.groupBy("node").agg(F.first("text").alias("text")), "candidates")

    pairs = members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    known = written(_verified(pairs, texts), "checked")
    roots = _merged(None, known.filter(F.col("similarity") >= similar).select("a", "b"))
    placed = written(_rooted(members, "node", roots, "root"), "placed")
    checked = written(_verified(_stars(placed, 1).join(known, ["a", "b"], "left_anti"), texts), "checked")
    roots = _merged(roots, checked.filter(F.col("similarity") >= similar).select("a", "b"))
    placed = written(_rooted(members, "node", roots, "root"), "placed")
    links = written(_open_links(placed, nodes, texts, similar), "rest")
    if not links.isEmpty():
        roots = _merged(roots, links)

    rooted = nodes.select("node", "md5", "text_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("text_id").alias("class_id"))
    classes = rooted.join(least, "root").select("md5", "text_id", "class_id")
    return rows.select("doc_id", "md5").join(classes, "md5").select("doc_id", "md5", "text_id", "class_id")


def _open_links(placed: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links (a, b) that join different components of a bucket: a forest for every two blocks that meet.

    A bucket's largest component and the rest are dealt into blocks of bounded number and length. Blocks of the rest meet
    each other and those of the component, which need not meet each other. So a member is sent as often as there are
    blocks of the rest, which is once for all but very large buckets.
    """
    sized = placed.join(texts.select("node", F.length("text").alias("chars")), "node")
    parts_of = sized.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    mixed = parts_of.groupBy("key").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.max(F.struct("n", "root", "chars")).alias("m"),
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    cut = lambda n, chars: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(chars / BLOCK_CHARS)).cast("int")
    cuts = mixed.select("key", "main", cut(F.col("m.n"), F.col("m.chars")).alias("mains"),
                        cut(F.col("n") - F.col("m.n"), F.col("chars") - F.col("m.chars")).alias("others"))
    is_main = F.col("root") == F.col("main")
    held = placed.join(cuts, "key").withColumn("own", F.when(is_main, F.pmod(F.xxhash64("node"), "mains")).otherwise(
        F.col("mains") + F.pmod(F.xxhash64("node"), "others")).cast("int"))
    meets = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    dealt = held.withColumn("other", F.explode(meets)).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "root")
    shown = dealt.join(nodes.select("node", "sketch", "bands"), "node").join(texts, "node")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = similar - MARGIN

    def forest(key: int, one: bool, rows: pa.Table) -> list[tuple[int, int]]:
        """``one``: a block meets itself; otherwise only pairs across the two blocks count."""
        own, node, root = (rows.column(c).to_numpy() for c in ("own", "node", "root"))
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        bits = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(own), SLOTS)
        share, left, right = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(own) - 1):
            open_ = np.flatnonzero((root[i + 1:] != root[i]) & (one | (own[i + 1:] != own[i]))) + i + 1
            alike = (bits[open_] == bits[i]).mean(1)
            near, alike = open_[alike >= least], alike[alike >= least]
            here = bands[i][(bands[near] == bands[i]).argmax(1)] == key
            share.append(alike[here])
            right.append(near[here])
            left.append(np.full(len(right[-1]), i))
        share, left, right = map(np.concatenate, (share, left, right))
        order = np.lexsort((right, left, -share))
        left, right = left[order], right[order]
        wanted = np.unique(np.concatenate((left, right)))
        shingle, weight, row = weighted(rows.column("text").combine_chunks().take(pa.array(wanted)))
        cuts = np.searchsorted(row, np.arange(len(wanted) + 1))
        at = dict(zip(wanted.tolist(), zip(cuts[:-1].tolist(), cuts[1:].tolist())))
        up = {r: r for r in root.tolist()}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        links = []
        for i, j in zip(left, right):
            p, q = top(int(root[i])), top(int(root[j]))
            if p != q:
                (a, b), (c, d) = at[int(i)], at[int(j)]
                if probability_jaccard(shingle[a:b], weight[a:b], shingle[c:d], weight[c:d]) >= similar:
                    up[max(p, q)] = min(p, q)
                    links.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(group: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            links = forest(group[0], group[1] == group[2], rows) if len(rows) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

        group, held = None, []
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")], 1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                if b > a:
                    if held and tuple(names[a].tolist()) != group:
                        yield from told(group, held)
                        held = []
                    group = tuple(names[a].tolist())
                    held.append(batch.slice(a, b - a))
        if held:
            yield from told(group, held)

    order = ["key", "low", "high"]
    return shown.select(*order, "own", "node", "root", "sketch", "bands", "text").repartition(parts, *order).sortWithinPartitions(
        *order).mapInArrow(run, "a long, b long")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents with one of each class: the one with the least id (nulls last), whole rows with all columns."""
    classes = near_classes(docs, similar)
    order = Window.partitionBy("class_id", "_group").orderBy(F.col("doc_id").asc_nulls_last(), "md5")
    # Classes of rows without ids have no class_id; their texts keep them apart.
    group = F.when(F.col("class_id").isNull(), F.col("md5"))
    chosen = classes.distinct().withColumn("_group", group).withColumn("_n", F.row_number().over(order)).filter(
        "_n = 1").select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"))
    keyed = docs.select(F.struct(*docs.columns).alias("_doc")).select(
        "_doc", F.col("_doc.doc_id").alias("_key"), F.unhex(F.md5(F.coalesce("_doc.text", F.lit("")))).alias("_own"))
    kept = keyed.join(chosen, (F.col("_own") == F.col("_md5")) & F.col("_key").eqNullSafe(F.col("_id")), "left_semi")
    once = Window.partitionBy("_own", "_key").orderBy(F.lit(0))
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_doc.*")


@query("op3_minhash_near_dedup")
def _(spark, sf_dir):
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_id", "class_id")
