"""Quality, line dedup, near duplicates, personal data, fingerprints, repeated strings, preference pairs, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapak.llm import components, fingerprints, lines, near, preferences, private, quality, repeats
from lapak.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, data, ordered, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "labels"):
        con.execute(f"create view {table} as select * from '{data}/{table}.parquet'")
    found = QUERIES[name](spark, data)
    result = con.execute(ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in found.columns]
    assert ordered(found.collect()) == ordered([[r[i] for i in at] for r in result.fetchall()])


def base_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed)


def test_quality_counts(spark, data, texts, odd_docs, no_docs):
    rows = QUERIES["op5_quality_rules"](spark, data).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r[f] for f in fields) for r in rows} == {d: base_counts(t) for d, t in texts}
    assert not any(r.kept and r.base_failed for r in rows) and any(r.kept for r in rows)
    odd = quality.judge(odd_docs).collect()
    assert Counter((r.doc_id, *(r[f] for f in fields)) for r in odd) == Counter(
        (r.doc_id, *base_counts(r.text)) for r in odd_docs.collect())
    assert quality.keep_good(odd_docs).columns == odd_docs.columns
    assert quality.judge(no_docs).collect() == []


def test_quality_distance(spark):
    p, q = [4, 0, 4], [1, 1, 2]
    a, b = np.array(p) / 8, np.array(q) / 4
    m = (a + b) / 2
    part = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    row = spark.createDataFrame([(p, q, [0, 0, 0])], "p array<long>, q array<long>, z array<long>").select(
        quality.js_distance(F.col("p"), F.col("q")).alias("d"), quality.js_distance(F.col("p"), F.col("p")).alias("same"),
        quality.js_distance(F.col("p"), F.col("z")).alias("none")).first()
    assert abs(row.d - ((part(a) + part(b)) / 2) ** 0.5) < 1e-12 and row.same == 0 and row.none is None


def test_quality_rejects_symbol_noise_and_keeps_prose(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice("the of and to in a is that house river stone bridge walked along".split())
                      for _ in range(200)) + "." for _ in range(30)]
    noise = " ".join(rng.choice("the river%%% stone### walked&&& bridge*** $$$ of".split()) + str(k) for k in range(200))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*prose, noise])], "doc_id long, text string, lang string")
    assert [r.doc_id for r in quality.judge(docs).filter("not kept").collect()] == [30]


def test_short_symbol_noise_is_judged_on_its_characters(spark, data):
    """Texts below the length guard: junk goes, clean ones stay; longer ones are judged as before."""
    rng = random.Random(1)
    words = "the of and to in a is that house river stone bridge walked along".split()
    prose = [" ".join(rng.choice(words) for _ in range(n)) + "." for n in [200] * 30 + [20, 25, 40, 70]]
    junk = [" ".join(f"{rng.choice(words)}{rng.choice(['***', '%%%', '&&&', '$$$'])}{k}" for k in range(n)) for n in (25, 60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*prose, *junk])], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in quality.judge(docs, short=True).filter("not kept").collect()) == [34, 35]
    stage = dict(corpus_pipeline.STAGES)["quality_rules"]
    assert sorted(r.doc_id for r in stage(spark, docs, data).collect()) == list(range(34))


def without_runs(rows, k):
    """Text left of each (doc_id, text), by brute force; earlier means smaller id, hash of the text, place."""
    first, units = {}, {}
    for row in rows:
        parts = re.split(r"\n(?=[^\n]*[^\x20\x09-\x0D])", row[1] or "")
        units[row] = parts
        heads = [p.split("\n")[0] for p in parts]
        for i in range(len(parts) - k + 1):
            run = tuple(heads[i:i + k])
            if all(h.strip(" \t\n\x0b\x0c\r") for h in run):
                place = ((row[0] is not None, row[0] or 0), row[2], i)
                first[run] = min(first.get(run, place), place)
    out = {}
    for row, parts in units.items():
        heads, gone = [p.split("\n")[0] for p in parts], set()
        for i in range(len(parts) - k + 1):
            run = tuple(heads[i:i + k])
            if run in first and first[run] != ((row[0] is not None, row[0] or 0), row[2], i):
                gone.update(range(i, i + k))
        out[row[:2]] = "\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else row[1]
    return out


def without_sized_runs(rows, k, words):
    """Every length on its own: of k lines, or of fewer with so many words."""
    place = lambda row, i: ((row[0] is not None, row[0] or 0), row[2], i)
    units = {row: re.split(r"\n(?=[^\n]*[^\x20\x09-\x0D])", row[1] or "") for row in rows}
    first, runs = {}, []
    for row, parts in units.items():
        heads = [p.split("\n")[0] for p in parts]
        for n in range(1, k + 1):
            for i in range(len(heads) - n + 1):
                run = tuple(heads[i:i + n])
                if all(WORD.search(h) for h in run) and (n == k or sum(len(WORD.findall(h)) for h in run) >= words):
                    first[run] = min(first.get(run, place(row, i)), place(row, i))
                    runs.append((row, i, run))
    gone = {row: set() for row in rows}
    for row, i, run in runs:
        if first[run] != place(row, i):
            gone[row].update(range(i, i + len(run)))
    return {row[:2]: "\n".join(p for i, p in enumerate(parts) if i not in gone[row]) if gone[row] else row[1]
            for row, parts in units.items()}


@pytest.mark.parametrize("min_lines, words", [(3, 4), (4, 3), (3, 1)])
def test_sized_line_runs(spark, odd_docs, min_lines, words):
    rng = random.Random(min_lines + words)
    extra = [(100 + i % 9, "\n".join(rng.choice(["a", "b b", "", " ", "c c c", "d d d d"]) for _ in range(rng.randrange(12))))
             for i in range(40)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    found = lines.without_repeats(docs, min_lines, words).select("_doc.*", "_left").collect()
    assert {(r.doc_id, r.text): r._left for r in found} == without_sized_runs(rows, min_lines, words)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_runs(spark, odd_docs, min_lines):
    rng = random.Random(min_lines)
    extra = [(100 + i % 9, "\n".join(rng.choice(["a", "b", "", " ", "c c"]) for _ in range(rng.randrange(12)))) for i in range(40)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]
    expected = without_runs(rows, min_lines)
    found = lines.without_repeats(docs, min_lines, None).select("_doc.*", "_left").collect()
    assert len(found) == len(rows)
    assert {(r.doc_id, r.text): r._left for r in found} == expected


def test_long_lines_count_by_their_words(spark):
    """One or two repeated lines go if they have enough words, as three lines do; shorter ones stay."""
    long, half, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("l", 50), ("h", 25), ("o", 25)))
    docs = spark.createDataFrame([
        (1, f"{long}\n\nx\n{half}\n{other}\nend"), (2, f"a\n{long}\nb\n{half}\nc"), (3, f"{half}\n{other}\nx\nd"),
        (4, f"{long}\n{long} more\n{half}\n{other}\n{half}\n{other}"), (4, f"{long}\n{long} more\n{half}\n{other}\n{half}\n{other}"),
        (5, f"p\nq\nr\ns"), (6, f"p\nq\nr\nt\n{long}"), (None, long)], "doc_id long, text string")
    found = {r.doc_id: (r._left, r._n_removed, r._n_runs) for r in lines.without_repeats(docs, 3, 50).select(
        "_doc.doc_id", "_left", "_n_removed", "_n_runs").collect()}
    assert found == {
        None: (long, 0, 0), 1: (f"x\n{half}\n{other}\nend", 1, 1), 2: (f"a\nb\n{half}\nc", 1, 1), 3: ("x\nd", 2, 1),
        4: (f"{long} more", 5, 2), 5: ("p\nq\nr\ns", 0, 0), 6: ("t", 4, 2)}
    assert lines.without_repeats(docs, 4, 3).filter("_doc.doc_id = 6").first()._left == "t"


def test_line_dedup_keeps_columns(odd_docs, no_docs):
    found = lines.deduplicated(odd_docs)
    assert found.columns == odd_docs.columns and found.count() == odd_docs.count()
    assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in found.collect())
    assert lines.deduplicated(no_docs).collect() == []


def weights(text):
    words = WORD.findall(text or "")
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def exact(a, b):
    if not a or not b:
        return float(not a and not b)
    x = {k: v / sum(a.values()) for k, v in a.items()}
    y = {k: v / sum(b.values()) for k, v in b.items()}
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})


def classes(rows):
    """Least id per connected class, by comparing all texts that share a shingle."""
    parent = {t: t for _, t in rows}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets, holders = {t: weights(t) for t in parent}, defaultdict(set)
    for t, s in sets.items():
        for shingle in s:
            holders[shingle].add(t)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if (a or "") < (b or "")}
    for a, b in pairs:
        if find(a) != find(b) and exact(sets[a], sets[b]) >= 0.8:
            parent[find(b)] = find(a)
    least = {}
    for d, t in rows:
        if d is not None:
            least[find(t)] = min(least.get(find(t), d), d)
    return Counter((d, least.get(find(t))) for d, t in rows)


def test_near_classes(spark, data, texts, odd_docs, no_docs):
    found = QUERIES["op3_minhash_near_dedup"](spark, data).collect()
    assert Counter((r.doc_id, r.class_id) for r in found) == classes(texts)
    odd = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    assert Counter((r.doc_id, r.class_id) for r in near.near_classes(odd_docs).collect()) == classes(odd)
    assert near.near_classes(no_docs).collect() == []


def test_near_chains_and_large_groups(spark):
    """A chain in which only neighbours are alike, and a group whose members are alike through one of them only."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    docs, current = [], list(base)
    for i in range(25):
        docs.append((i, " ".join(current)))
        at = rng.randrange(280)
        current[at:at + 8] = [f"c{i}_{k}" for k in range(8)]
    centre = [f"v{k}" for k in range(300)]
    for i in range(40):
        own = list(centre)
        for k in range(4 if i else 0):
            own[(i * 7 + k * 70) % 300] = f"own{i}_{k}"
        docs.append((100 + i, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in near.near_classes(frame).collect()) == classes(docs)


@pytest.mark.parametrize("block", [4, 17, 1024])
def test_open_links_lose_no_link(spark, monkeypatch, block):
    """Blocks of a bucket, each member alone or in a component: what they join is what all verified pairs join."""
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(120)]
    texts = []
    for i in range(90):
        own = list(base) if i % 9 else [f"x{rng.randrange(10 ** 6)}" for _ in range(120)]
        for _ in range(rng.randrange(5)):
            own[rng.randrange(120)] = f"o{i}_{rng.random()}"
        texts.append(" ".join(own))
    signature, _ = near.signatures(pa.array(texts))
    sketch = (near.mix(signature) & np.uint64(255)).astype(np.uint8)
    bands = near.band_hashes(signature)
    nodes = spark.createDataFrame([(i, sketch[i].tobytes(), bands[i].tolist()) for i in range(90)], "node long, sketch binary, bands array<long>")
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    keys = Counter(k for row in bands.tolist() for k in row)
    root = {i: 1 if i % 9 and i % 4 == 1 else i for i in range(90)}
    placed = spark.createDataFrame([(k, i, keys[k], root[i]) for i in range(90) for k in bands[i].tolist() if keys[k] > 1],
                                   "key long, node long, size long, root long")
    links = [tuple(r) for r in near._open_links(placed, nodes, frame, 0.8).collect()]
    up = {i: r for i, r in root.items()}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    whole = [weights(t) for t in texts]
    assert all(a < b and root[a] != root[b] and exact(whole[a], whole[b]) >= 0.8 for a, b in links)
    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    for a in range(90):
        for b in range(a):
            if top(a) != top(b) and (bands[a] == bands[b]).any():
                assert exact(whole[a], whole[b]) < 0.8


def test_keep_one(odd_docs):
    kept = near.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    chosen = {c for _, c in classes([(r.doc_id, r.text or "") for r in odd_docs.collect()])}
    assert {r.doc_id for r in rows} == chosen and len(rows) == len(chosen)


def test_signatures_estimate_the_similarity():
    rng = random.Random(2)
    pairs = []
    for _ in range(30):
        words = [str(rng.randrange(10 ** 6)) for _ in range(rng.randrange(30, 400))]
        cut = rng.randrange(len(words))
        pairs.append((" ".join(words), " ".join(words[:cut] + [str(rng.random()) for _ in range(rng.randrange(200))] + words[:9])))
    flat = [t for p in pairs for t in p]
    signature, some = near.signatures(pa.array(flat))
    alone = np.concatenate([near.signatures(pa.array([t]))[0] for t in flat])
    assert some.all() and np.array_equal(signature, alone)
    errors = [(signature[2 * i] == signature[2 * i + 1]).mean() - exact(weights(a), weights(b)) for i, (a, b) in enumerate(pairs)]
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12
    a, x, r = near.weighted(pa.array(flat[:2]))
    assert abs(near.probability_jaccard(a[r == 0], x[r == 0], a[r == 1], x[r == 1]) - exact(*map(weights, flat[:2]))) < 1e-9


def test_pairs_at_the_threshold():
    """Eight of ten shingles shared: 0.8 in either order and under any weight common to all."""
    for weight in (1, 3, 7):
        for shift in range(20):
            a, b = (np.arange(first, first + 9, dtype=np.uint64) + np.uint64(shift) for first in (0, 1))
            x = np.full(9, weight)
            assert near.probability_jaccard(a, x, b, x) == near.probability_jaccard(b, x, a, x) == 0.8


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60) if i % 20] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    changed, expected = True, {n: n for link in links for n in link}
    while changed:
        changed = False
        for a, b in links:
            low = min(expected[a], expected[b])
            changed |= expected[a] != low or expected[b] != low
            expected[a] = expected[b] = low
    assert roots == expected


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def strict(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        total = sum(sum(map(int, str(int(d) * (1 + k % 2)))) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_strict_spans():
    rng = random.Random(1)
    for alphabet, size in (("a@.1-2+ 5(", 30), ("1234567890 -.+", 60)):
        for _ in range(8000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))
            assert private.base_spans(text) == strict(text)
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 100_000, "@a." * 50_000):
        private.candidates(text)


def test_private_query(spark, data, texts, odd_docs, no_docs):
    rows = {r.doc_id: r for r in QUERIES["op4_private_data"](spark, data).collect()}
    for doc, text in texts:
        base, row = strict(text), rows[doc]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        listed = [f"{private.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row.spans.split(","))
    odd = private.find(odd_docs).collect()
    assert len(odd) == odd_docs.count() and [r.n_email for r in odd if r.doc_id == 14] == [1]
    masked = private.mask(odd_docs)
    assert masked.columns == odd_docs.columns
    text = next(r.text for r in masked.collect() if r.doc_id == 14)
    assert text == "write [EMAIL] or [PHONE] from [IP], [CARD]"
    assert private.find(no_docs).collect() == [] and private.mask(no_docs).collect() == []


def test_private_model_adds_sure_spans_only(spark):
    rng = random.Random(7)
    docs = []
    for i in range(300):
        number = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        docs.append((i, f"please phone {number} or mail u{i}@mail{i % 9}.example.com today"))
        docs.append((1000 + i, f"version {rng.randrange(10)}.{rng.randrange(300, 999)}.1.{i} of order 1234 5678 90{i:02d} section 12 345 6789"))
    docs += [(5000, "mail jane.doe (at) example (dot) org now"), (5001, "phone 0049 30 1234567 tonight"),
             (5002, "we met 12 345 6789 times in 1999-2003")]
    found = {r.doc_id: r for r in private.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[5000].spans == "email:5:36" and found[5000].n_email == 0
    # Nothing is added that looks like a version, an order or a count.
    assert all(r.n_added == 0 for d, r in found.items() if 1000 <= d < 5000 or d == 5002)


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.4
    said = np.stack([np.where(rng.random(len(truth)) < good, truth, ~truth) * 2 for good in (0.95, 0.9, 0.8, 0.7, 0.9)], 1)
    code = said @ (3 ** np.arange(private.LABELERS)[::-1])
    patterns, n = np.unique(code, return_counts=True)
    posterior, table = private.estimate(patterns, n)
    assert np.abs(table[:, 1, 2] - [0.95, 0.9, 0.8, 0.7, 0.9]).max() < 0.03
    guess = dict(zip(patterns.tolist(), posterior > 0.5))
    assert np.mean([guess[c] == t for c, t in zip(code.tolist(), truth)]) > 0.97


def test_fingerprints(spark, data, texts, odd_docs, no_docs):
    rows = {r.doc_id: r for r in QUERIES["op8_document_fingerprints"](spark, data).collect()}
    down, errors = texts[::-1], []
    for (doc, text), (_, after) in zip(down, down[1:] + down[:1]):
        cut, row = len(text) // 3, rows[doc]
        changed = text[:len(text) - cut] + after[:cut]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = set(weights(text)), set(weights(changed))
        errors.append(row.near_edited - (len(a & b) / len(a | b) if a | b else 1))
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and abs(np.mean(errors)) < 0.01
    simple = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert simple == {d: r.fingerprint for d, r in rows.items()}
    odd = fingerprints.compare_with_next(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    same = defaultdict(set)
    given = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in odd:
        same[given[r.doc_id] if r.doc_id not in (None, 10) else r.fingerprint].add(r.fingerprint)
    assert all(len(s) == 1 for s in same.values())
    assert fingerprints.compare_with_next(no_docs).collect() == []
    one = fingerprints.compare_with_next(odd_docs.filter("doc_id = 15")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_sparse_bins_are_filled_alike():
    short, some = fingerprints.fingerprint(pa.array(["a b c d e f", "a b c d e f", "q r s t u v", "", None]))
    assert some.tolist() == [True, True, True, False, False]
    near_ = lambda i, j: float(fingerprints.likeness(short[[i]], some[[i]], short[[j]], some[[j]])[0])
    assert near_(0, 1) == 1 and near_(0, 2) < 0.1 and near_(0, 3) == 0 and near_(3, 4) == 1


def removed(rows):
    first, out = {}, []
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49 if doc is not None else 0):
            first[raw[i:i + 50]] = min(first.get(raw[i:i + 50], doc), doc)
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 49 if doc is not None else 0):
            if first[raw[i:i + 50]] < doc:
                gone[i:i + 50] = True
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(left).hexdigest()))
    return out


def test_repeated_strings(spark, data, texts, odd_docs, no_docs, ordered):
    small = [r for r in texts if len(r[1]) < 6000]
    frame = spark.createDataFrame(small, "doc_id long, text string").repartition(4)
    assert ordered(repeats.remove_repeats(frame).drop("kept").collect()) == ordered(removed(small))
    rng = random.Random(3)
    base = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(20, 400))) for _ in range(6)]
    rows = [(3, "a" * 49), (4, "a" * 49), (6, "a" * 50), (7, "a" * 50), (8, "a" * 51), (9, "a" * 3000), (10, "ab" * 700 + "é"),
            (11, "ab" * 500)]
    for i in range(60):
        one, two, at = rng.choice(base), rng.choice(base), rng.randrange(20)
        rows.append((20 + i % 50, one[at:at + rng.randrange(200)] + rng.choice(["", "x", "a" * 40]) + two[:rng.randrange(len(two))]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(repeats.remove_repeats(frame).drop("kept").collect()) == ordered(removed(rows))
    odd = [(r.doc_id, r.text) for r in odd_docs.filter("doc_id is null or doc_id <> 11").collect()]
    found = repeats.remove_repeats(odd_docs.filter("doc_id is null or doc_id <> 11")).drop("kept").collect()
    assert ordered(found) == ordered(removed(odd))
    assert repeats.remove_repeats(no_docs).collect() == []


def test_anchors_are_those_of_each_window(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(200))) for _ in range(30)]
    data, ends = repeats._text_bytes(pa.array(texts))
    whole = repeats.anchors(data, ends)
    monkeypatch.setattr(repeats, "CHUNK", 64)
    parts = repeats.anchors(data, ends)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_preference_edges(spark):
    turn = lambda role, text: (role, text)
    a, b, c = turn("user", "hi"), turn("assistant", "hello"), turn("assistant", "no")
    rows = [(1, [a, b], [a, c]), (2, [a, b], [a, b]), (3, [a, b], [a]), (4, None, [a]), (5, [], []), (6, [a, b], None)]
    turns = "array<struct<role:string,text:string>>"
    found = {r.pair_id: r for r in preferences.format_pairs(
        spark.createDataFrame(rows, f"pair_id int, chosen {turns}, rejected {turns}")).collect()}
    assert found[1].prompt == "<|im_start|>user\nhi<|im_end|>\n" and found[1].n_prompt_turns == 1
    s, e = map(int, found[1].chosen_mask.split(":"))
    assert found[1].chosen_text[s:e] == "hello<|im_end|>"
    assert found[2].n_prompt_turns == 2 and found[2].chosen_text == found[2].rejected_text == ""
    assert found[3].rejected_text == "" and found[3].chosen_text
    assert found[4].prompt == "" and found[4].rejected_text and found[5].prompt == "" and found[6].rejected_mask == ""


def test_long_and_odd_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(1000)] + [
        (1, 5, None, None), (None, 0, "user", "x"), (2, None, "user", "b"), (2, None, "user", "a"), (2, 0, "user", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.pair_id: r for r in preferences.format_pairs(preferences.derived_pairs(turns)).collect()}
    assert set(found) == {1, 2}
    spans = [tuple(map(int, s.split(":"))) for s in found[1].chosen_mask.split(",")]
    assert len(spans) == 500 and [found[1].chosen_text[s:e] for s, e in spans] == [f"t{k}<|im_end|>" for k in range(1, 1000, 2)]
    empty = spark.createDataFrame([], turns.schema)
    assert preferences.format_pairs(preferences.derived_pairs(empty)).collect() == []


def test_pipeline(spark, data, odd_docs):
    """Each stage against a brute-force version of its decision, on what the stage before has kept."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "private_data", "best_fit_packing"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, data).cache()
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    short = stage["line_dedup"](spark, good, data).cache()
    rows = [tuple(r) for r in good.select("doc_id", "text", F.xxhash64("text")).collect()]
    expected = without_sized_runs(rows, 3, 50)
    assert {r.doc_id: r.text for r in short.collect()} == {d: t for (d, _), t in expected.items()}
    single = stage["near_dedup"](spark, short, data).cache()
    assert {r.doc_id for r in single.collect()} == {c for _, c in classes([(r.doc_id, r.text) for r in short.collect()])}
    masked = stage["private_data"](spark, single, data)
    assert masked.columns == docs.columns and masked.count() == single.count()
    assert not any(strict(r.text) for r in masked.collect())
    packed = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in masked.collect()}
