"""Secrets, told from copied examples by who owns them across the whole corpus.

Strict rules give the base spans (assign, access, hex), which always stay. Looser rules give more candidates: other key
words and separators, other providers' prefixes, passwords in addresses, mixed-case digests and random strings. Only a
hash of a candidate's value leaves its task. Over all documents each hash is counted by distinct repositories and
distinct owners: a value that many owners have is an example that is copied around; a value that only few owners have,
and that looks random, is a live credential of theirs. Loose candidates of that kind are added to the spans.

Counting is a chain of partial aggregations: (hash, owner, repository), then (hash, owner), then hash, so a value that
stands in a third of all documents is summed up in its tasks first.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lapak.llm.batches import slices, written
from lapak.llm.registry import query, table

KINDS = ("assign", "access", "hex")
MAX_OWNERS = 3
MIN_ENTROPY = 2.8

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# (kind, pattern): the value is the last group. Every pattern starts at a place that ends what went before.
LOOSE = (
    (0, re.compile(r"(?<![A-Za-z])(?:pass(?:word|wd|code|phrase)?|pwd|secret|token|api[_-]?key|client[_-]?secret|"
                   r"private[_-]?key|access[_-]?key|credential)s?[\"']?(?:[\x20\t]*(?::=|=>|->|[:=])[\x20\t]*|\x20is\x20)"
                   r"[\"'`]?([A-Za-z0-9+/_.=~!@#$%^&*-]{8,200})", re.ASCII | re.IGNORECASE)),
    (0, re.compile(r"(?<![A-Za-z])(?:bearer|basic)\x20([A-Za-z0-9+/_.=-]{16,2000})", re.ASCII | re.IGNORECASE)),
    (0, re.compile(r"://[^\s/:@]{1,64}:([^\s/:@]{8,200})@")),
    (1, re.compile(r"(?<![A-Za-z0-9])((?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{12,60})(?![A-Za-z0-9])")),
    (1, re.compile(r"(?<![A-Za-z0-9_-])(gh[opsur]_[A-Za-z0-9]{30,255}|github_pat_[A-Za-z0-9_]{30,255}|glpat-[A-Za-z0-9_-]{20,64}|"
                   r"sk_live_[A-Za-z0-9]{16,128}|xox[abprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{30,64})(?![A-Za-z0-9_-])")),
    (1, re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,4000}\.[A-Za-z0-9_-]{10,4000})")),
    (2, re.compile(r"(?<![A-Za-z0-9])([0-9A-Fa-f]{32,128})(?![A-Za-z0-9])")),
    (2, re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+]{32,128}={0,2})(?![A-Za-z0-9+/_=-])")),
)
# Whatever one of the rules above can find; for Arrow's matcher, which goes over a whole batch of texts at once.
ANY = (r"(?i:pass|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credential|bearer|basic)|://[^\s/:@]+:[^\s/:@]+@|"
       r"AKIA|ASIA|AIDA|AROA|AGPA|ANPA|gh[opsur]_|github_pat_|glpat-|sk_live_|xox[abprs]-|AIza|eyJ|[A-Za-z0-9+]{32}")
# Parts of values that stand for a secret instead of being one.
PLACEHOLDERS = ("example", "sample", "test", "dummy", "placeholder", "change", "your", "xxxx", "password", "secret", "insert",
                "todo", "fake", "foobar", "12345", "abcdef", "qwerty", "0000", "1111", "redacted", "hidden", "****", "....")
SPAN = "struct<start: long, kind: int, end: long, base: boolean, live: boolean, hash: binary>"


def entropy(value: str) -> float:
    """Bits per character by the frequencies of its own characters."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_live(value: str) -> bool:
    """Whether a value looks random: letters and digits, many different ones, no placeholder and no counting up."""
    lower = value.lower()
    if not (re.search("[a-z]", lower) and re.search("[0-9]", value)) or any(p in lower for p in PLACEHOLDERS):
        return False
    steps = sum(ord(b) - ord(a) in (0, 1) for a, b in zip(value, value[1:]))
    return entropy(value) >= MIN_ENTROPY and 3 * steps < len(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the strict rules; each kind is searched from left to right by itself."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(start, kind, end, value, base): base spans, and looser ones that touch no base span nor each other."""
    base = base_spans(text)
    loose = sorted((m.start(), kind, m.end(), m[m.lastindex]) for kind, rule in LOOSE for m in rule.finditer(text))
    taken, more, at, furthest = sorted((s, e) for s, _, e, _ in base), [], 0, 0
    for s, kind, e, value in loose:
        while at < len(taken) and taken[at][0] < s:
            furthest, at = max(furthest, taken[at][1]), at + 1
        if furthest <= s and (at == len(taken) or taken[at][0] >= e):
            more.append((s, kind, e, value, False))
            furthest = e
    return sorted([(*b, True) for b in base] + more)


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, *_ in spans)


def candidate_rows(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """One row per document: row, doc_id, owner, repository, counts and list of base spans, and all candidates.

    No text is kept, and of values only 128 bits of their SHA-256.
    """
    kinds = [docs.schema[c].dataType.simpleString() for c in ("doc_id", owner, repository)]
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()),
                      ("live", pa.bool_()), ("hash", pa.binary())])

    def one(text: str | None) -> tuple:
        spans = candidates(text or "")
        base = [s for s in spans if s[4]]
        cells = [{"start": s, "kind": k, "end": e, "base": b, "live": looks_live(v),
                  "hash": hashlib.sha256(v.encode(errors="replace")).digest()[:16]} for s, k, e, v, b in spans]
        return *(sum(s[1] == k for s in base) for k in range(3)), listed(base), cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                texts = pc.fill_null(batch.column("_text"), "")
                some = pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False)
                rows = [(0, 0, 0, "", [])] * len(texts)
                for at in some.nonzero()[0].tolist():
                    rows[at] = one(texts[at].as_py())
                cells = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("doc_id", "owner", "repository")],
                     *[pa.array(c, pa.int64()) for c in cells[:3]], pa.array(cells[3], pa.string()),
                     pa.array(cells[4], pa.list_(span))],
                    ["doc_id", "owner", "repository", *[f"n_{k}" for k in KINDS], "base", "found"])

    read = docs.select("doc_id", F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.col("text").alias("_text"))
    return read.mapInArrow(run, f"doc_id {kinds[0]}, owner {kinds[1]}, repository {kinds[2]}, "
                           + ", ".join(f"n_{k} long" for k in KINDS) + f", base string, found array<{SPAN}>").withColumn(
        "row", F.monotonically_increasing_id())


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories from rows of (hash, owner, repository); null is an owner and a repository too."""
    own = spans.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(
        F.count("*").alias("repositories"))
    return own.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (all), and more columns.

    n_added counts added spans. live lists the spans, base ones included, whose value looks random and has at most
    ``max_owners`` owners; n_copied counts those whose value has more. Offsets are code points, ends exclusive. A null
    text is an empty one; a null owner or repository is one of its own; repeated rows are each searched, and count as
    one repository; an empty table gives no rows. Other columns are not read.
    """
    every = written(candidate_rows(docs, owner, repository), "secrets")
    counts = [f"n_{k}" for k in KINDS]
    some = every.filter(F.size("found") > 0)
    spans = some.select("row", "owner", "repository", F.inline("found"))
    own = ownership(spans.select("hash", "owner", "repository"))
    told = spans.select("row", "start", "kind", "end", "base", "live", "hash").join(own, "hash").select(
        "row", F.struct("start", "kind", "end", "base", (F.col("live") & (F.col("n_owners") <= max_owners)).alias("own"),
                        (F.col("n_owners") > max_owners).alias("copied")).alias("span"))
    judged = told.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("all"))
    kept = F.filter("all", lambda s: s["base"] | s["own"])
    live = F.filter("all", lambda s: s["own"])
    judged = judged.select(
        "row", _joined(kept).alias("spans"), (F.size(kept) - F.size(F.filter("all", lambda s: s["base"]))).cast("long").alias("n_added"),
        _joined(live).alias("live"), F.size(F.filter("all", lambda s: s["copied"])).cast("long").alias("n_copied"))
    last = ("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "live", "n_copied")
    none = every.filter(F.size("found") == 0).select(
        "*", F.lit("").alias("spans"), F.lit(0).cast("long").alias("n_added"), F.lit("").alias("live"),
        F.lit(0).cast("long").alias("n_copied"))
    return none.select(*last).unionByName(some.join(judged, "row").select(*last))


@query("op13_secret_scan")
def _(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
