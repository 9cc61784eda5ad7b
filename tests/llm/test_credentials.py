"""Secrets: base spans by plain regular expressions, and decisions by an ownership count over all candidates."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lapak.llm import credentials
from lapak.llm.registry import QUERIES

A = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
SAID = {"assign": (A, 2, 8), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}


def plain_base(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, (rule, group, least)) in enumerate(SAID.items())
             for m in rule.finditer(text) if len(m[group]) >= least]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(spans)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, max_owners=credentials.MAX_OWNERS):
    """(doc_id, counts, base digest, spans, n_added, live, n_copied) of (doc_id, text, owner) rows, all in memory."""
    owners, out = defaultdict(set), []
    for _, text, owner in rows:
        for *_, value, _ in credentials.candidates(text or ""):
            owners[value].add(owner)
    for doc, text, _ in rows:
        base, spans, live, added, copied = plain_base(text or ""), [], [], 0, 0
        for s, k, e, value, strict in credentials.candidates(text or ""):
            name, own = f"{credentials.KINDS[k]}:{s}:{e}", credentials.looks_live(value) and len(owners[value]) <= max_owners
            copied += len(owners[value]) > max_owners
            if own:
                live.append(name)
            if strict or own:
                spans.append(name)
                added += not strict
        out.append((doc, *(sum(b.startswith(k) for b in base) for k in credentials.KINDS), sha(",".join(base)), ",".join(spans),
                    added, ",".join(live), copied))
    return out


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def test_query(spark):
    data = "/root/testdata/sf0.01"  # the smallest table holds no secret
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = QUERIES["op13_secret_scan"](spark, data).collect()
    assert sorted(map(tuple, rows), key=key) == sorted(brute([tuple(d) for d in docs]), key=key)
    assert sum(r.n_assign + r.n_hex for r in rows) > 0


def test_base_spans_on_random_strings():
    rng = random.Random(3)
    parts = ["password", "PassWD", "Secret", "token", "api_key", "apikey", "API_KEY", "\"", "'", " ", "  ", ":", "=", "AKIA", "akia",
             "A", "Z9", "0a", "ffff", "deadbeef", "0123456789abcdef", "é", "ſ", "K", "\n", "\t", "/", "+", "-", "_", ".", "x", "tokenſ"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 24)))
        found = credentials.candidates(text)
        assert credentials.listed([s for s in found if s[4]]) == ",".join(plain_base(text))
        if found:
            assert credentials.pc.match_substring_regex(credentials.pa.array([text]), credentials.ANY)[0].as_py(), text
        loose = [s for s in found if not s[4]]
        assert all(a[2] <= b[0] or b[2] <= a[0] for a in loose for b in found if a is not b)


SECRET, COPIED, ONCE = "q7Rt2xVb9Lm4Zk8w", "h3Jp6sNd1Gy5Tc0f", "pwd => z8Kd0qLw4Xn7Bv2m"


def test_owners_tell_examples_from_live_ones(spark):
    rows = [(i, f"see pwd => {COPIED} here", f"owner{i % 7}") for i in range(40)]
    rows += [(100 + i, f"our pwd => {SECRET} stays", "owner1") for i in range(30)]
    rows += [(200, ONCE, None), (201, "pwd => changeme123 and pwd => your-key-99", "owner2"), (202, f"password={COPIED}", "owner2"),
             (203, "ghp_a8Xk2Lq9Zt4Vw7Rb1Nc6Md3Pf5Gh0Jy2Ts", "owner3"), (204, "https://bob:Zx81kQp0vT@db.example/", "owner4")]
    found = {r.doc_id: r for r in credentials.find(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(found[i].spans == "" and found[i].n_copied == 1 and found[i].n_added == 0 for i in range(40))
    assert all(found[100 + i].spans == found[100 + i].live == "assign:4:27" for i in range(30))
    assert found[200].n_added == 1 and found[201].spans == "" and found[201].n_copied == 0
    assert found[202].spans == "assign:0:25" and found[202].live == "" and found[202].n_copied == 1
    assert found[203].spans == "access:0:38" and found[204].spans == "assign:5:23"
    assert sorted(map(tuple, found.values()), key=key) == sorted(brute(rows), key=key)


def test_ownership_counts_distinct_owners_and_repositories(spark):
    rows = [(b"a", "o1", 1), (b"a", "o1", 1), (b"a", "o1", 2), (b"a", "o2", 2), (b"a", None, 2), (b"a", None, None), (b"b", "o1", 1)]
    found = credentials.ownership(spark.createDataFrame(rows, "hash binary, owner string, repository long")).collect()
    assert sorted((bytes(r.hash), r.n_owners, r.n_repositories) for r in found) == [(b"a", 3, 5), (b"b", 1, 1)]


def test_odd_documents(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(50, "é🙂 token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", None), (51, "token: " + "a" * 300_000, "s"),
                                   (52, "token" + " " * 200_000 + "x", "s"), (53, "eyJ" * 100_000, "s"), (54, "://" * 100_000, "t"),
                                   (55, "ABCDEF0123" * 50_000, "t"), (56, "password " * 50_000, "t")], "doc_id long, text string, source string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    found = credentials.find(docs)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute(rows), key=key)
    assert credentials.find(no_docs).collect() == []
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added", "live", "n_copied"]
    clash = docs.select("doc_id", "text", "source", F.lit(1).alias("row"), F.lit(2).alias("hash"), F.lit("x").alias("owner"),
                        F.lit("y").alias("found"), F.lit("z").alias("_text"))
    assert sorted(map(tuple, credentials.find(clash).collect()), key=key) == sorted(brute(rows), key=key)
