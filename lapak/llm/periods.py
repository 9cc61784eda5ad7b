"""Periodic runs of words, found in a Re-Pair grammar of the words.

A run is a stretch of words with smallest period q that lasts three periods and 24 words at least, and that no neighbour
extends. Words of a run after its first period are repetitions and can be dropped.

1. Every run lies inside words covered by windows of 16 words that come again in the same document: a run of L words has
   q <= L / 3, so its windows of L - q >= 16 words come again q words later, and together they cover it. Only such
   stretches are compressed; all other words are literals of the grammar that no rule could shorten.
2. Re-Pair in rounds: a pair of neighbours that comes twice is replaced wherever it is more frequent than the pairs it
   touches, until no pair is left that comes twice; then neighbours are paired as they stand, up to one symbol a stretch.
3. For each nonterminal, once, the runs that cross its boundary: the longer side shows the period by four words that come
   again, and the extent follows from longest common extensions.
4. Runs are moved to all places where the nonterminal is derived, and intervals of one period that overlap by a period
   are merged. A run that reaches the end of a nonterminal may go on beyond it; it is then found whole at the lowest
   nonterminal that holds it, which the merge keeps.

Work is numpy over slices of a few megabytes of text, so memory is bounded by the slice or by the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lapak.llm.batches import slices
from lapak.llm.registry import query, table
from lapak.llm.words import GOLDEN, mix, word_lists

MIN_WORDS = 24
TIMES = 3
CHUNK = 1 << 22
# Two prime moduli below 2^31 and a base for each, for the hashes of word sequences.
PRIMES = ((2147483647, 1234567891), (2147483629, 987654321))

Rewrite = Callable[[list, np.ndarray, np.ndarray], np.ndarray]


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place inside the owner of each of ``sizes[k]`` elements of all k."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]


class Extensions:
    """Longest common extensions in a sequence of numbers, by hashes of its prefixes."""

    def __init__(self, codes: np.ndarray):
        n, self.tables = len(codes), []
        for prime, base in PRIMES:
            power = np.ones(n + 1, np.int64)
            done = 1
            while done <= n:
                step = min(done, n + 1 - done)
                power[done:done + step] = power[:step] * (int(power[done - 1]) * base % prime) % prime
                done += step
            total = np.concatenate(([0], np.cumsum((codes + 1) % prime * power[:n] % prime))) % prime
            self.tables.append((prime, power, total))

    def same(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` elements from ``at`` on equal those ``apart`` further on."""
        ok = np.ones(len(at), bool)
        for prime, power, total in self.tables:
            one = (total[at + length] - total[at]) % prime
            two = (total[at + apart + length] - total[at + apart]) % prime
            ok &= one * power[apart] % prime == two
        return ok

    def reach(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Largest length up to ``most`` for which ``same`` holds from ``at`` on, or back from ``at``."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            ok = self.same(at[open_] - (mid if back else 0), apart[open_], mid)
            low[open_[ok]] = mid[ok]
            high[open_[~ok]] = mid[~ok] - 1


@dataclass
class Grammar:
    """Rules in the order they were made. Symbols below ``terminals`` are words; ``first`` is a place of a symbol."""

    terminals: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    first: np.ndarray
    rounds: list[int]
    roots: np.ndarray
    places: np.ndarray


def repair(codes: np.ndarray, stretch: np.ndarray) -> Grammar:
    """Re-Pair over sequences that lie one after another; ``stretch`` tells them apart and never decreases."""
    terminals = int(codes.max()) + 1 if len(codes) else 0
    sym, at, own = codes.astype(np.int64), np.arange(len(codes)), stretch
    left, right, first, rounds = [], [], [], [terminals]
    size = np.ones(terminals, np.int64)
    rng = np.random.default_rng(1)
    repeated = True
    while len(sym) > 1:
        inside = own[:-1] == own[1:]
        if not inside.any():
            break
        names = rounds[-1]
        if repeated:
            pair = np.where(inside, sym[:-1] * names + sym[1:], -1)
            kinds, kind, count = np.unique(pair, return_inverse=True, return_counts=True)
            live = inside & (count[kind] >= 2)
            if not live.any():
                repeated = False
                continue
            rank = (count * len(kinds) + rng.permutation(len(kinds)))[kind]
            rank[~live] = -1
            same = pair[1:] == pair[:-1]
            begins = np.concatenate(([True], ~same))
            offset = np.arange(len(pair)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            over_left = np.concatenate(([True], same | (rank[1:] > rank[:-1])))
            over_right = np.concatenate((same | (rank[:-1] > rank[1:]), [True]))
            chosen = np.flatnonzero(live & (offset % 2 == 0) & over_left & over_right)
            _, index, rule = np.unique(kind[chosen], return_index=True, return_inverse=True)
        else:
            begins = np.concatenate(([True], ~inside))
            offset = np.arange(len(sym)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
            chosen = np.flatnonzero(inside & (offset[:-1] % 2 == 0))
            index = rule = np.arange(len(chosen))
        source = chosen[index]
        left.append(sym[source])
        right.append(sym[source + 1])
        first.append(at[source])
        size = np.concatenate((size, size[left[-1]] + size[right[-1]]))
        rounds.append(names + len(source))
        sym = sym.copy()
        sym[chosen] = names + rule
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        sym, at, own = sym[keep], at[keep], own[keep]
    none = np.zeros(0, np.int64)
    return Grammar(terminals, np.concatenate([none, *left]), np.concatenate([none, *right]), size,
                   np.concatenate([none, *first]), rounds, sym, at)


def crossing(grammar: Grammar, codes: np.ndarray, min_words: int, times: int) -> np.ndarray:
    """Rows (nonterminal, start, end, period): runs that cross its boundary, counted from its first word."""
    width = min_words * (times - 2) // (2 * times)
    node = np.flatnonzero(grammar.size[grammar.terminals:] >= min_words)
    if not len(node):
        return np.zeros((0, 4), np.int64)
    extent = Extensions(codes)
    gram = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            gram[:len(codes) - k] = mix(gram[:len(codes) - k] + (codes[k:].astype(np.uint64) + np.uint64(1)) * GOLDEN)
    begin = grammar.first[node]
    cut = begin + grammar.size[grammar.left[node]]
    end = begin + grammar.size[grammar.terminals + node]
    found = []
    for to_right in (True, False):
        reach = np.clip(np.minimum((end - cut if to_right else cut - begin) - width, (end - begin) // times), 0, None)
        total, start = np.cumsum(reach), 0
        while start < len(node):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CHUNK, "right")))
            owner, place = ragged(reach[start:stop])
            owner, q = owner + start, place + 1
            near = cut[owner] - (0 if to_right else width)
            hit = gram[near] == gram[near + (q if to_right else -q)]
            owner, q = owner[hit], q[hit]
            x = cut[owner] - (0 if to_right else q)
            s = x - extent.reach(x, q, x - begin[owner], True)
            e = x + q + extent.reach(x, q, end[owner] - x - q, False)
            ok = (s < cut[owner]) & (e > cut[owner]) & (e - s >= np.maximum(min_words, times * q))
            found.append(np.stack((node[owner] + grammar.terminals, s - begin[owner], e - begin[owner], q), 1)[ok])
            start = stop
    return least_period(np.concatenate(found))


def least_period(rows: np.ndarray) -> np.ndarray:
    """Of rows that agree in all but the last column, the one where that is least; in order."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(1)
    return rows[new]


def derived(grammar: Grammar, runs: np.ndarray) -> np.ndarray:
    """Rows (period, start, end) at every place where a nonterminal with runs is derived."""
    terminals, total = grammar.terminals, len(grammar.size)
    count = np.bincount(runs[:, 0], minlength=total)
    offset = np.cumsum(count) - count
    holds = count > 0
    for low, high in zip(grammar.rounds, grammar.rounds[1:]):
        rule = slice(low - terminals, high - terminals)
        holds[low:high] |= holds[grammar.left[rule]] | holds[grammar.right[rule]]
    sym, at, out = grammar.roots, grammar.places, [np.zeros((0, 3), np.int64)]
    while len(sym):
        live = holds[sym]
        sym, at = sym[live], at[live]
        owner, place = ragged(count[sym])
        own = runs[offset[sym][owner] + place]
        out.append(np.stack((own[:, 3], own[:, 1] + at[owner], own[:, 2] + at[owner]), 1))
        inner = sym >= terminals
        sym, at = sym[inner] - terminals, at[inner]
        left = grammar.left[sym]
        sym, at = np.concatenate((left, grammar.right[sym])), np.concatenate((at, at + grammar.size[left]))
    return np.concatenate(out)


def merged(rows: np.ndarray) -> np.ndarray:
    """Maximal rows (start, end, period): intervals of one period are one if they overlap by a period."""
    if not len(rows):
        return np.zeros((0, 3), np.int64)
    q, s, e = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].T
    lift = np.cumsum(np.concatenate(([0], q[1:] != q[:-1]))) * (int(e.max()) + 1)
    far = np.maximum.accumulate(e + lift) - lift
    begins = np.concatenate(([True], (q[1:] != q[:-1]) | (s[1:] > far[:-1] - q[1:])))
    ends = np.concatenate((np.flatnonzero(begins)[1:] - 1, [len(q) - 1]))
    return least_period(np.stack((s[begins], far[ends], q[begins]), 1))


def runs_of(codes: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs in sequences that lie one after another, ``counts`` numbers each.

    Places are counted over all sequences; runs never span two. ``times`` must be three at least.
    """
    if times < 3:
        raise ValueError("times must be three at least")
    codes = codes.astype(np.int64)
    window = -(-min_words * (times - 1) // times)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = len(codes) - window + 1
    if starts <= 0:
        return np.zeros((0, 3), np.int64)
    with np.errstate(over="ignore"):
        word = mix(codes.astype(np.uint64) * GOLDEN + np.uint64(1))
        hashes = mix(owner[:starts].astype(np.uint64) + GOLDEN)
        for k in range(window):
            hashes = (hashes ^ word[k:k + starts]) * GOLDEN
            hashes ^= hashes >> np.uint64(29)
    whole = owner[:starts] == owner[window - 1:]
    ordered = np.sort(hashes[whole])
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros((0, 3), np.int64)
    place = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    at = np.flatnonzero(whole & (twice[place] == hashes))
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    live = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    breaks = np.concatenate(([False], (live[1:] != live[:-1] + 1) | (owner[live[1:]] != owner[live[:-1]])))
    _, inside = np.unique(codes[live], return_inverse=True)
    grammar = repair(inside, np.cumsum(breaks))
    found = merged(derived(grammar, crossing(grammar, inside, min_words, times)))
    found[:, :2] = np.stack((live[found[:, 0]], live[found[:, 1] - 1] + 1), 1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted(ids: list, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words in which a tenth of the documents, by the checksum of their ids, end in a repeated passage.

    A null id changes nothing.
    """
    codes, ends = codes.copy(), np.cumsum(counts)
    for doc, n, end in zip(ids, counts.tolist(), ends.tolist()):
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = codes[end - n:end]
            own[a:] = own[a + np.arange(n - a) % p]
    return codes


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None, min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed.

    Words are what stands between white space ``[\\x20\\x09-\\x0D]``. ``collapsed`` is the text without repetitions, its
    words joined by one space. A null or empty text has no word and no run; repeated rows are each searched; other
    columns are not read; an empty table gives no rows. ``rewrite(ids, codes, counts)`` may change the words first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pc.fill_null(batch.column("text"), "")
        codes, distinct, counts = word_lists(texts)
        changed = codes
        if rewrite is not None:
            changed = rewrite(batch.column("doc_id").to_pylist(), codes, counts)
        runs = runs_of(changed, counts, min_words, times)
        begin = np.concatenate(([0], np.cumsum(counts)))
        edge = np.zeros(len(codes) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 1], -1)
        kept = np.cumsum(edge)[:-1] == 0
        spoiled = np.concatenate(([0], np.cumsum((changed != codes) | ~kept)))[begin]
        names = distinct.to_pylist() if spoiled[-1] else []
        collapsed = []
        for k, raw in enumerate(texts.cast(pa.large_binary()).to_pylist()):
            if spoiled[k] == spoiled[k + 1]:
                collapsed.append(b" ".join(raw.split()).decode())
            else:
                own = slice(begin[k], begin[k + 1])
                collapsed.append(" ".join(map(names.__getitem__, changed[own][kept[own]].tolist())))
        owner = np.searchsorted(begin, runs[:, 0], "right") - 1
        cells = [pa.array(x) for x in (runs[:, 0] - begin[owner], runs[:, 1] - runs[:, 0], runs[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(counts) + 1)), pa.int32()),
                                         pa.StructArray.from_arrays(cells, fields=list(shape)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), lists,
                                           pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield one(batch)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with most periods; of equal ones the first, then the one of the smallest period. Null without runs."""
    def order(a: Column, b: Column) -> Column:
        one, two = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(one != two, F.when(one > two, -1).otherwise(1))
                .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)))

    return F.get(F.array_sort(runs, order), 0)


@query("op11_periodic_runs")
def _(spark, sf_dir):
    found = find_runs(table(spark, sf_dir, "documents"), planted).withColumn("best", strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
