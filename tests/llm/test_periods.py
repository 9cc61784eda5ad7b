"""Periodic runs against a search of all periods at all places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lapak.llm import periods
from lapak.llm.registry import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, min_words=24, times=3):
    """(start, end, period) of every maximal stretch, of all periods the least."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def collapsed(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(doc, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words)
    best = None
    for s, e, q in runs:
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *best, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(collapsed(words, runs)))


def test_query(spark, data, texts):
    rows = QUERIES["op11_periodic_runs"](spark, data).collect()
    assert sorted(tuple(r) for r in rows) == sorted(digest(d, t) for d, t in texts)
    assert sum(r.n_runs for r in rows) > 10 and any(r.n_runs == 0 for r in rows)


def sequences(seed):
    rng = random.Random(seed)
    for _ in range(rng.randrange(1, 6)):
        words = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            if len(words) > 2:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // rng.randrange(3, 11)
                words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
                words += rng.choice([[], words[:rng.randrange(len(words))], [7] * rng.randrange(40)])
        yield words


@pytest.mark.parametrize("seed", range(150))
def test_against_all_periods(seed):
    docs = list(sequences(seed))
    min_words, times = [(24, 3), (6, 3), (10, 4), (24, 5)][seed % 4]
    found = periods.runs_of(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs]), min_words, times)
    expected, offset = [], 0
    for words in docs:
        expected += [(s + offset, e + offset, q) for s, e, q in all_runs(words, min_words, times)]
        offset += len(words)
    assert sorted(map(tuple, found.tolist())) == sorted(expected)


@pytest.mark.parametrize("words, runs", [
    ([0] * 200_000, [(0, 200_000, 1)]), ([i % 7001 for i in range(100_000)], [(0, 100_000, 7001)]),
    ([i % 40_000 for i in range(119_999)], []), ([i % 40_000 for i in range(120_000)], [(0, 120_000, 40_000)]),
    (list(range(50_000)) * 2, []), ([0, 1] * 12, [(0, 24, 2)]), ([0, 1] * 11 + [0], [])])
def test_long_sequences(words, runs):
    assert list(map(tuple, periods.runs_of(np.array(words), np.array([len(words)])).tolist())) == runs


def test_thue_morse_has_no_run():
    words = np.array([0])
    while len(words) < 1 << 14:
        words = np.concatenate((words, 1 - words))
    assert not len(periods.runs_of(words, np.array([len(words)]), 6, 3))


def test_grammar_derives_its_words():
    for seed in range(30):
        docs = [d for d in sequences(seed) if d]
        codes = np.array(sum(docs, []), np.int64)
        stretch = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        made = periods.repair(codes, stretch)

        def words_of(symbol):
            if symbol < made.terminals:
                return [symbol]
            return words_of(made.left[symbol - made.terminals]) + words_of(made.right[symbol - made.terminals])

        assert len(made.roots) == len(docs)
        assert [words_of(r) for r in made.roots] == docs
        for k in range(len(made.left)):
            symbol, at = made.terminals + k, made.first[k]
            assert words_of(symbol) == codes[at:at + made.size[symbol]].tolist()


def test_odd_documents(spark, odd_docs, no_docs):
    rows = periods.find_runs(odd_docs).collect()
    expected = []
    for doc, text in [(r.doc_id, r.text) for r in odd_docs.collect()]:
        words = WORD.findall(text or "")
        runs = all_runs(words)
        expected.append((doc, len(words), [(s, e - s, q) for s, e, q in runs], collapsed(words, runs)))
    key = str
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows), key=key) == sorted(expected, key=key)
    assert any(r.runs for r in rows)
    assert sorted(((r.doc_id, r.n_words) for r in periods.find_runs(odd_docs, periods.planted).collect()), key=key) == sorted(
        ((r.doc_id, r.n_words) for r in rows), key=key)
    assert periods.find_runs(no_docs).collect() == []
    assert periods.find_runs(odd_docs).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_a_text_of_a_million_words(spark):
    passage = " ".join(f"w{i}" for i in range(1000))
    docs = spark.createDataFrame([(1, f"a b {passage} " + f"{passage}\n" * 999)], "doc_id long, text string")
    row = periods.find_runs(docs).first()
    assert [tuple(r) for r in row.runs] == [(2, 1_000_000, 1000)] and row.collapsed == f"a b {passage}"


def test_strongest_run_is_exact(spark):
    runs = [(5, 48, 16), (9, 30, 10), (2, 72, 24), (7, 30, 10)]
    docs = spark.createDataFrame([(runs,), ([],)], "runs array<struct<start: long, length: long, period: long>>")
    best = [r.b for r in docs.select(periods.strongest(docs.runs).alias("b")).collect()]
    assert tuple(best[0]) == (2, 72, 24) and best[1] is None
