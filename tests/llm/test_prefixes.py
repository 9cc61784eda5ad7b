"""Prefix trie of conversations against a trie of dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lapak.llm import prefixes
from lapak.llm.registry import QUERIES


def turn_key(row):
    """Order of the turns of a conversation: number, null first, then digest."""
    role, text = row[2] or "", row[3] or ""
    return (row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def brute(rows):
    """All nodes of the trie of rebuilt conversations, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_key):
        own[row[0]].append((row[2] or "", row[3] or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(set)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].add(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] = sum(leaves[c] for c in children[prefix]) or 1
        mine = (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        saved[prefix] = mine + sum(saved[c] for c in children[prefix])
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def plain(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    data = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(QUERIES["op12_prefix_trie"](spark, data)) == brute(rows)


def talk(seed, n=60):
    """Conversations with shared beginnings, copies, prefixes of others, ties, nulls and one of many turns."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        size = rng.choice([1, 2, 3, 9, 12])
        rows += [(c * rng.choice([1, 1, 3]), rng.choice([t, t, t, None]), rng.choice(["user", None, ""]), rng.choice(["a", "bé", "", None, "ccc"]))
                 for t in range(size)]
    rows += [(c, t, "user", "x" * t) for c in range(1000, 1040) for t in range(4)] + [(c, t, "r", "long") for c in (2001, 2006) for t in range(500)]
    return rows + [(None, 1, "user", "a"), (-7, 0, "user", "a"), (1 << 40, 0, "user", "a")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, turns, parts", [(1, 1 << 18, 3), (2, 40, 3), (3, 10, 7), (4, 1, 2), (5, 5, 1)])
def test_shards_and_levels(spark, seed, turns, parts):
    rows = talk(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert plain(prefixes.prefix_trie(prefixes.rebuilt(docs), turns)) == brute(rows)


def test_single_and_empty(spark):
    one = [(5, 0, "user", "hello"), (5, 1, "assistant", "é")]
    assert plain(prefixes.prefix_trie(prefixes.rebuilt(spark.createDataFrame(one, SCHEMA)))) == brute(one)
    assert prefixes.prefix_trie(prefixes.rebuilt(spark.createDataFrame([], SCHEMA))).collect() == []
    clash = spark.createDataFrame([(*r, "x", b"y", [1], 7, "z") for r in talk(9, 20)], SCHEMA + ", path string, leaf binary, "
                                  "turns array<int>, _group long, digest string")
    assert plain(prefixes.prefix_trie(prefixes.rebuilt(clash))) == brute(talk(9, 20))


def test_a_third_of_all_conversations_are_copies(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 900, 3) for t in range(2)] + [(c, 0, "user", f"own{c}") for c in range(900) if c % 3]
    assert plain(prefixes.prefix_trie(prefixes.rebuilt(spark.createDataFrame(rows, SCHEMA)), 50)) == brute(rows)


def test_findclose():
    rng = random.Random(4)
    for size in [1, 2, 31, 32, 33, 64, 500, 3000] * 3:
        bits, left, depth = [], size, 0
        bias = rng.choice([0.5, 0.6, 0.95])
        while left or depth:
            if left and (not depth or rng.random() < bias):
                bits.append(True)
                left, depth = left - 1, depth + 1
            else:
                bits.append(False)
                depth -= 1
        tree, stack, close = prefixes.Parentheses(np.array(bits)), [], {}
        for at, bit in enumerate(bits):
            if bit:
                stack.append(at)
            else:
                close[stack.pop()] = at
        opens = np.array(sorted(close))
        closes = tree.close(opens)
        assert closes.tolist() == [close[o] for o in opens.tolist()]
        assert tree.leaves(opens, closes).tolist() == [sum(bits[i] and not bits[i + 1] for i in range(o, close[o])) for o in opens.tolist()]
