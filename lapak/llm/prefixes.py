"""Prefix trie of conversations, as balanced parentheses per shard.

A conversation is a path of turns, a turn the digest of its role and text. Equal paths are counted first, so that a
conversation with many copies is one row. Distinct paths are range partitioned and sorted; each shard, a bounded run of
neighbouring paths, writes its trie as balanced parentheses:

* blocks of 64 parentheses with the least and greatest excess, and a tree over them, give findclose, which delimits the
  subtree of a node; its nodes are neighbours in preorder;
* the rank of leaf pairs "()" inside a subtree counts its leaves;
* cumulative arrays over preorder give members and savings.

Only the spines of a shard, the nodes on its first and last path, can have members in other shards. What is known of
them is handed on as two weighted paths, and these are the input of the next level, until they fit one shard. All other
nodes are complete; if their parent lies on a spine its smallest member is joined in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lapak.llm.batches import written
from lapak.llm.periods import ragged
from lapak.llm.registry import query, table

SHARD_TURNS = 1 << 18
MIN_PATHS = 8
DIGEST = 16
BLOCK = 64
ID_RANGE = 1 << 16
HEAD_GROUP, HEAD_MOST = 5, 8
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

WEIGHT = "struct<depth: long, convs: long, least: long, children: long, leaves: long, saved: long, ends: string>"
PATH = f"path binary, bytes array<long>, weights array<{WEIGHT}>"
NODE = ("conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
WEIGHTS = ("depth", "convs", "least", "children", "leaves", "saved")
ARROW_WEIGHT = pa.struct([*[(c, pa.int64()) for c in WEIGHTS], ("ends", pa.string())])
ARROW_OUT = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()), ("key", pa.binary()),
    *[(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()),
    ("path", pa.binary()), ("bytes", pa.list_(pa.int64())), ("weights", pa.list_(ARROW_WEIGHT))])


class Parentheses:
    """Balanced parentheses with a tree of least and greatest excess over blocks; True opens."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.excess = bits, np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // BLOCK)
        padded = np.pad(self.excess, (0, blocks * BLOCK - len(bits)), mode="edge").reshape(blocks, BLOCK)
        low, high = [padded.min(1)], [padded.max(1)]
        while len(low[-1]) > 1:
            odd = len(low[-1]) % 2
            low.append(np.pad(low[-1], (0, odd), mode="edge").reshape(-1, 2).min(1))
            high.append(np.pad(high[-1], (0, odd), mode="edge").reshape(-1, 2).max(1))
        self.begin = np.cumsum([0] + [len(x) for x in low])
        self.low, self.high = np.concatenate(low), np.concatenate(high)
        pair = bits & ~np.concatenate((bits[1:], [True]))
        self.pairs = np.concatenate(([0], np.cumsum(pair)))

    def _scan(self, at: np.ndarray, target: np.ndarray, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Look for ``target`` from ``at`` to the end of its block; what is found goes to ``out``, the other rows return."""
        left = []
        while len(rows):
            inside = at < len(self.excess)
            hit = inside & (self.excess[np.minimum(at, len(self.excess) - 1)] == target)
            out[rows[hit]] = at[hit]
            edge = ~hit & ((at + 1) % BLOCK == 0)
            left.append(rows[edge])
            more = ~hit & ~edge
            rows, at, target = rows[more], at[more] + 1, target[more]
        return np.concatenate([np.zeros(0, np.int64), *left])

    def close(self, opens: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each of ``opens``."""
        out, goal = np.full(len(opens), -1), self.excess[opens] - 1
        fresh = (opens + 1) % BLOCK != 0
        rows = np.concatenate((self._scan(opens[fresh] + 1, goal[fresh], out, np.flatnonzero(fresh)), np.flatnonzero(~fresh)))
        level, block, target = np.zeros(len(rows), np.int64), opens[rows] // BLOCK + 1, goal[rows]

        def holds(level: np.ndarray, block: np.ndarray, target: np.ndarray) -> np.ndarray:
            at = self.begin[level] + block
            return (self.low[at] <= target) & (self.high[at] >= target)

        climbing = np.arange(len(rows))
        while len(climbing):
            climbing = climbing[~holds(level[climbing], block[climbing], target[climbing])]
            up = block[climbing] % 2 == 1
            level[climbing] += up
            block[climbing] = np.where(up, block[climbing] // 2 + 1, block[climbing] + 1)
        sinking = np.flatnonzero(level > 0)
        while len(sinking):
            level[sinking] -= 1
            block[sinking] *= 2
            block[sinking] += ~holds(level[sinking], block[sinking], target[sinking])
            sinking = sinking[level[sinking] > 0]
        self._scan(block * BLOCK, target, out, rows)
        return out

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        """Number of leaf pairs between each pair of parentheses, itself included."""
        return self.pairs[closes + 1] - self.pairs[opens]


def least_in(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:stop]`` for each pair."""
    rows, step = [values], 1
    while 2 * step <= len(values):
        rows.append(np.minimum(rows[-1][:-step], rows[-1][step:]))
        step *= 2
    level = np.frexp(stop - start)[1] - 1
    out = np.empty(len(start), values.dtype)
    for k, row in enumerate(rows):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[start[at]], row[stop[at] - (1 << k)])
    return out


class Trie:
    """Trie of sorted distinct paths and the values of its nodes, in preorder."""

    def __init__(self, paths: pa.Table):
        raw = paths.column("path").combine_chunks()
        self.length = np.fromiter(map(len, raw.to_pylist()), np.int64, len(raw)) // DIGEST
        self.start = np.cumsum(self.length) - self.length
        self.raw = b"".join(raw.to_pylist())
        ids = np.frombuffer(self.raw, f"V{DIGEST}")
        shared = self.length.copy()
        shared[1:] = np.minimum(self.length[1:], self.length[:-1])
        shared[0] = 0
        owner, place = ragged(shared)
        differ = np.flatnonzero(ids[self.start[owner] + place] != ids[self.start[owner - 1] + place])
        np.minimum.at(shared, owner[differ], place[differ])
        closed = np.concatenate(([0], self.length[:-1] - shared[1:]))
        opened = self.length - shared
        opened[0] += 1
        steps = np.concatenate((np.stack((closed, opened), 1).ravel(), [self.length[-1] + 1]))
        self.tree = Parentheses(np.repeat(np.arange(len(steps)) % 2 == 1, steps))
        row, place = ragged(opened)
        self.depth = place + np.where(row > 0, shared[row] + 1, 0)
        self.last = np.cumsum(opened) - 1
        self.count = len(row)
        self.opens = np.flatnonzero(self.tree.bits)
        self.closes = self.tree.close(self.opens)
        self.stop = np.arange(self.count) + (self.closes - self.opens + 1) // 2
        self.order = np.lexsort((np.arange(self.count), self.depth))
        self.keys = (self.depth * (self.count + 1) + np.arange(self.count))[self.order]
        self.parent = np.concatenate(([-1], self.above(np.arange(1, self.count) - 1, self.depth[1:] - 1)))
        self.cost = np.concatenate(([0], paths.column("bytes").combine_chunks().flatten().to_numpy(zero_copy_only=False)))[
            np.where(self.depth > 0, self.start[row] + self.depth, 0)].astype(np.int64)
        self.weigh(paths.column("weights").combine_chunks())

    def above(self, node: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last node of ``depth`` that is not after ``node`` in preorder."""
        return self.order[np.searchsorted(self.keys, depth * (self.count + 1) + node, "right") - 1]

    def weigh(self, weights: pa.Array) -> None:
        """Add the given weights to their nodes, and sum up subtrees."""
        flat = weights.flatten()
        owner = np.repeat(np.arange(len(weights)), np.diff(weights.offsets.to_numpy()))
        cells = {c: flat.field(c).fill_null(NONE if c == "least" else 0).to_numpy() for c in WEIGHTS}
        node = self.above(self.last[owner], cells["depth"])
        self.own = {c: np.zeros(self.count, np.int64) for c in ("convs", "children", "leaves", "saved")}
        for c, into in self.own.items():
            np.add.at(into, node, cells[c])
        self.own["least"] = np.full(self.count, NONE)
        np.minimum.at(self.own["least"], node, cells["least"])
        self.ends = np.full(self.count, None, object)
        ends = flat.field("ends").to_pylist()
        for at, text in zip(node.tolist(), ends):
            if text is not None:
                self.ends[at] = text
        self.convs = self.within(self.own["convs"])
        self.least = least_in(self.own["least"], np.arange(self.count), self.stop)
        self.children = self.own["children"] + np.bincount(self.parent[1:], minlength=self.count)
        bare = self.tree.pairs[self.opens + 1] > self.tree.pairs[self.opens]
        self.leaves = self.tree.leaves(self.opens, self.closes) + self.within(
            self.own["leaves"] - (bare & (self.own["children"] > 0)))
        self.saved = self.within(self.own["saved"] + (self.convs - 1) * self.cost)

    def within(self, values: np.ndarray) -> np.ndarray:
        """Sum over the subtree of each node, by differences of one cumulative array."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.stop] - total[:-1]

    def spine(self, row: int) -> np.ndarray:
        """Nodes on a path, from the root on."""
        return self.above(np.full(self.length[row] + 1, self.last[row]), np.arange(self.length[row] + 1))

    def prefix_keys(self, row: int) -> list[bytes]:
        """Digest of each prefix of a path, from the empty one on."""
        state, start, out = hashlib.md5(), self.start[row], []
        for k in range(self.length[row] + 1):
            out.append(state.copy().digest())
            state.update(self.raw[(start + k) * DIGEST:(start + k + 1) * DIGEST])
        return out


def shard(paths: pa.Table, level: int, final: bool) -> pa.RecordBatch:
    """Complete nodes of the trie of ``paths``, and its spines as weighted paths unless it is the last one."""
    trie = Trie(paths)
    rows = range(len(trie.length)) if level else sorted({0, len(trie.length) - 1})
    keys = np.full(trie.count, None, object)
    for row in rows:
        for node, key in zip(trie.spine(row).tolist(), trie.prefix_keys(row)):
            keys[node] = key
    open_, spines = np.zeros(trie.count, bool), []
    if not final:
        for row in sorted({0, len(trie.length) - 1}):
            nodes = trie.spine(row)
            spines.append((row, nodes[~open_[nodes]]))
            open_[nodes] = True
    done = np.flatnonzero(~open_)
    parent = trie.parent[done]
    waits = (parent >= 0) & open_[parent]
    known = (parent >= 0) & ~waits
    out = [pa.array(trie.least[done]), pa.array(trie.depth[done]), pa.array(trie.least[parent], mask=~known),
           pa.array([keys[p] if w else None for p, w in zip(parent.tolist(), waits.tolist())], pa.binary()),
           pa.array(keys[done].tolist() if level else [None] * len(done), pa.binary()),
           *[pa.array(v[done]) for v in (trie.convs, trie.children, trie.leaves, trie.saved)],
           pa.array([NO_ENDS if e is None else e for e in trie.ends[done].tolist()], pa.string())]
    own = {c: v.copy() for c, v in trie.own.items()}
    child, into = done[waits], parent[waits]
    for c, value in (("convs", trie.convs), ("leaves", trie.leaves), ("saved", trie.saved), ("children", np.ones(trie.count, np.int64))):
        np.add.at(own[c], into, value[child])
    np.minimum.at(own["least"], into, trie.least[child])
    made = {"path": [], "bytes": [], "weights": []}
    for row, nodes in spines:
        made["path"].append(paths.column("path")[row].as_py())
        made["bytes"].append(paths.column("bytes")[row].as_py())
        made["weights"].append([
            {"depth": int(trie.depth[n]), **{c: int(own[c][n]) for c in ("convs", "children", "leaves", "saved")},
             "least": None if own["least"][n] == NONE else int(own["least"][n]), "ends": trie.ends[n]} for n in nodes.tolist()])
    columns = []
    for k, field in enumerate(ARROW_OUT):
        node = out[k] if k < len(out) else pa.nulls(len(done), field.type)
        path = pa.array(made[field.name], field.type) if field.name in made else pa.nulls(len(spines), field.type)
        columns.append(pa.concat_arrays([node.cast(field.type), path]))
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_OUT)


def blocks(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[pa.Table]:
    """Neighbouring paths of about ``turns`` turns together, a few paths at least."""
    held, rows, size = [], 0, 0
    for batch in batches:
        ends = np.cumsum([len(p) // DIGEST for p in batch.column("path").to_pylist()])
        start = before = 0
        for at, end in enumerate(ends.tolist()):
            if size + end - before >= turns and rows + at + 1 - start >= MIN_PATHS:
                yield pa.Table.from_batches([*held, batch.slice(start, at + 1 - start)])
                held, rows, size, start, before = [], 0, 0, at + 1, end
        if start < len(ends):
            held.append(batch.slice(start))
            rows, size = rows + len(ends) - start, size + int(ends[-1]) - before
    if held:
        yield pa.Table.from_batches(held)


def trie_level(paths: DataFrame, level: int, turns: int, final: bool) -> DataFrame:
    """Nodes and spines of all shards of ``paths`` (distinct)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, NONE if final else turns):
            yield shard(block, level, final)

    return paths.select("path", "bytes", "weights").sortWithinPartitions("path").mapInArrow(run, f"{NODE}, {PATH}")


def trie_nodes(paths: DataFrame, turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of distinct weighted paths (``PATH``). Only two counts a level reach the driver."""
    done, level, final = [], 0, False
    parts = paths.repartitionByRange("path")
    while True:
        made = written(trie_level(parts, level, turns, final), "trie")
        done.append(made.filter("path is null").select(*[c.split()[0] for c in NODE.split(", ")]))
        if final:
            break
        level += 1
        rest = made.filter("path is not null")
        rows, size = rest.agg(F.count("*"), F.coalesce(F.sum(F.size("bytes")), F.lit(0))).first()
        if not rows:
            break
        final = rows <= MIN_PATHS or size <= turns
        parts = rest.repartition(1) if final else rest.repartitionByRange(
            max(1, min(-(-size // turns), rows // MIN_PATHS)), "path")
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    spines = [d.filter("key is not null").select("key", F.col("conv_id").alias("above")) for d in done[1:]]
    if not spines:
        return nodes
    known = spines[0]
    for more in spines[1:]:
        known = known.unionByName(more)
    waiting = nodes.filter("parent_key is not null").drop("key").join(
        known.withColumnRenamed("key", "parent_key"), "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    columns = [c for c in nodes.columns if c not in ("key", "parent_key")]
    return nodes.filter("parent_key is null").select(*columns).unionByName(waiting.select(*columns))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (array of turn, digest, n_bytes) of every conversation, begun with turns of its group's first.

    Turns are ordered by number, null first, then by digest. Texts stay where they are: only digests are shuffled, once.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"))
    group = F.col("conv_id") - F.col("conv_id") % HEAD_GROUP
    own = narrow.withColumn("_group", group).repartition("_group").groupBy("_group", "conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "digest", "n_bytes"))).alias("turns"))
    head = F.first(F.when(F.col("conv_id") == F.col("_group"), F.slice("turns", 1, HEAD_MOST)), ignorenulls=True)
    led = own.withColumn("head", head.over(Window.partitionBy("_group")))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_MOST + 1)).cast("int")
    none = F.slice("turns", 1, 0)
    return led.select("conv_id", F.concat(
        F.slice(F.coalesce("head", none), F.lit(1), taken),
        F.slice("turns", taken + 1, F.greatest(F.size("turns") - taken, F.lit(0)))).alias("turns"))


def member_digests(members: DataFrame) -> DataFrame:
    """leaf and ends: SHA-256 of the ascending, comma-joined conv_ids of each leaf.

    Ids are sorted and joined in ranges of 65,536 first; a task then only feeds these pieces to the hash, one at a time.
    """
    pieces = members.groupBy("leaf", F.floor(F.col("conv_id") / ID_RANGE).alias("part")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, state = None, None

        def ready(leaves: list, hashes: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(leaves, pa.string()), pa.array(hashes, pa.string())], ["leaf", "ends"])

        for batch in batches:
            leaves, hashes = [], []
            for name, piece in zip(batch.column("leaf").to_pylist(), batch.column("piece").to_pylist()):
                if name != leaf:
                    if leaf is not None:
                        leaves.append(leaf)
                        hashes.append(state.hexdigest())
                    leaf, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield ready(leaves, hashes)
        if leaf is not None:
            yield ready([leaf], [state.hexdigest()])

    return pieces.repartition("leaf").sortWithinPartitions("leaf", "part").select("leaf", "piece").mapInArrow(
        run, "leaf string, ends string")


def prefix_trie(rows: DataFrame, turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of ``rows(conv_id, turns)``, turns being an array of (digest, n_bytes) and more.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. The
    empty prefix is the root; a conversation without turns ends there. conv_id is not null and no two rows share one.
    An empty table gives no rows.
    """
    members = written(rows.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["n_bytes"]).alias("bytes")).withColumn("leaf", F.md5("path")), "members")
    paths = members.groupBy("leaf").agg(
        F.count("*").alias("convs"), F.min("conv_id").alias("least"), F.first(F.struct("path", "bytes")).alias("p"))
    zero = F.lit(0).cast("long")
    weight = F.struct(F.size("p.bytes").cast("long").alias("depth"), "convs", "least", zero.alias("children"),
                      zero.alias("leaves"), zero.alias("saved"), "ends")
    weighted = paths.join(member_digests(members.select("leaf", "conv_id")), "leaf").select("p.*", F.array(weight).alias("weights"))
    return trie_nodes(written(weighted, "paths"), turns)


@query("op12_prefix_trie")
def _(spark, sf_dir):
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))
