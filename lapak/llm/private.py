"""Personal data by weak supervision.

Strict rules give the base spans (email, ip, card, phone). Looser patterns give more candidates: spelled-out addresses,
numbers without a country code, odd separators. For every candidate, base spans included, five labelers vote yes, no
or nothing: the strict rule, a structure check, a gazetteer, the words around it, and its borders. Votes are counted
over the whole corpus; expectation-maximisation estimates from the counts how reliable each labeler is, and its
posteriors train a logistic span classifier that never sees the strict rule. Candidates the classifier is sure of are
added to the base spans, which always stay; as a corpus may hold no counter-example of a kind, the structure and one of
gazetteer and context must say yes as well, and none of the others no.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lapak.llm.batches import slices
from lapak.llm.registry import query, table

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
LABELERS = 5
BITS = 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]|[\[(]\x20?at\x20?[\])]", re.IGNORECASE)

LOOSE = {
    "email": re.compile(r"(?<![\w.+-])[\w+-][\w.+-]{0,63}(?:@|\x20?[\[(]\x20?(?:at|@)\x20?[\])]\x20?)[\w-]{1,63}"
                        r"(?:(?:\.|\x20?[\[(]\x20?(?:dot|\.)\x20?[\])]\x20?)[\w-]{1,63}){0,4}", re.IGNORECASE | re.ASCII),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,4}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{4}){2}[\x20._/-]{0,2}[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,8}\)?){1,4}(?![0-9])"),
}
# Common top-level domains, country calling codes, issuer prefixes, words near each kind.
DOMAINS = frozenset("at au be biz br ca ch cn co com de dk edu es eu fi fr gov ie in info int io it jp mil mx net nl no nz "
                    "org pl pt ru se uk us".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48",
           "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90",
           "91", "351", "353", "358", "420", "971")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|36|6011|65")
NEAR = {
    "email": frozenset("mail email e-mail contact contacto kontakt courriel correo write address".split()),
    "ip": frozenset("ip host server address adresse address: ping ssh client remote".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta cc".split()),
    "phone": frozenset("tel phone call mobile cell fax telefon téléphone telefono teléfono tél whatsapp handy".split()),
}
AGAINST = frozenset("version v release isbn issn sku order ref serial id token page section chapter invoice".split())
EDGE = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[0::2] + [sum(divmod(2 * d, 10)) for d in values[1::2]]) % 10 == 0


def _small(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict rules; each kind is searched from left to right by itself, in linear time."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, 0, free))
        at = text.find("@", max(at + 1, free))
    for chain in NUMBERS.finditer(text):
        if chain[0].count(".") >= 3:
            parts, at = chain[0].split("."), chain.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k:k + 4]
                size = sum(map(len, four)) + 3
                if all(map(_small, four)):
                    found.append((at, 1, at + size))
                at += size + 1
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, int]:
    """Votes (one base-3 digit per labeler: 0 no, 1 none, 2 yes) and shape bits of a candidate."""
    piece, name = text[start:end], KINDS[kind]
    digits = re.sub(r"[^0-9]", "", piece)
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9]+", piece.rstrip(")]"))[-1].lower()
        structure = 2 if re.search(r"\.|dot", piece, re.IGNORECASE) and last.isalpha() and 2 <= len(last) <= 6 else 0
        listed = 2 if last in DOMAINS else 1
    elif kind == 1:
        parts = re.findall(r"[0-9]+", piece)
        structure = 2 if all(map(_small, parts)) else 0
        listed = 0 if parts[0].strip("0") == "" or any(p[0] == "0" and len(p) > 1 for p in parts) else 1
    elif kind == 2:
        structure = 2 if 12 <= len(digits) <= 19 and luhn(digits) else 0
        listed = 2 if ISSUERS.match(digits) and 13 <= len(digits) <= 19 else 0
    else:
        structure = 2 if 9 <= len(digits) <= 13 else 0 if len(digits) < 7 or len(digits) > 15 else 1
        listed = 2 if piece[0] == "+" and digits.startswith(CALLING) or digits[:2] == "00" else 1
    words = {w.lower() for w in EDGE.findall(text[max(0, start - 40):start])[-4:]}
    context = 2 if words & NEAR[name] else 0 if words & AGAINST else 1
    touching = (start > 0 and (text[start - 1].isalnum() or text[start - 1] in "_/=\"")) or (
        end < len(text) and (text[end].isalnum() or text[end] in "_/\""))
    code = 0
    for vote in (2 if strict else 0, structure, listed, context, 0 if touching else 2):
        code = code * 3 + vote
    shape = (piece[0] == "+", "(" in piece or "[" in piece, " " in piece, len(digits) >= 10)
    return code, sum(1 << i for i, on in enumerate(shape) if on)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and looser ones that touch no base span nor each other (kinds in their order, then from the left)."""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    loose = sorted((m.start(), kind, m.end()) for kind, name in enumerate(KINDS) for m in LOOSE[name].finditer(text))
    taken, more, at = sorted((s, e) for s, _, e in base), [], 0
    furthest = 0
    for s, kind, e in loose:
        while at < len(taken) and taken[at][0] < s:
            furthest, at = max(furthest, taken[at][1]), at + 1
        if furthest <= s and (at == len(taken) or taken[at][0] >= e):
            more.append((s, kind, e))
            furthest = e
    return base, more


def vote_counts(docs: DataFrame) -> DataFrame:
    """kind, votes, shape and the number of such candidates in all texts, counted inside the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                base, more = candidates(text or "")
                for strict, spans in ((True, base), (False, more)):
                    for s, kind, e in spans:
                        key = (kind, *votes(text, s, kind, e, strict))
                        total[key] = total.get(key, 0) + 1
        rows = [(*k, n) for k, n in total.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int32() if i < 3 else pa.int64()) for i in range(4)],
            ["kind", "votes", "shape", "n"])

    return docs.select("text").mapInArrow(run, "kind int, votes int, shape int, n long").groupBy(
        "kind", "votes", "shape").agg(F.sum("n").alias("n"))


def _digits(code: np.ndarray) -> np.ndarray:
    return np.stack([code // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)], 1)


def estimate(code: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and the labelers' reliabilities P(vote | truth), by expectation-maximisation."""
    said = _digits(code)
    weight = (said == 2).sum(1) - (said == 0).sum(1)
    truth = 1 / (1 + np.exp(-1.5 * weight))
    table_ = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        both = np.stack(((1 - truth) * n, truth * n), 1)
        prior = (both.sum(0) + 1) / (n.sum() + 2)
        for k in range(LABELERS):
            for v in range(3):
                table_[k, :, v] = both[said[:, k] == v].sum(0) + 1
        table_ /= table_.sum(2, keepdims=True)
        score = np.log(prior) + sum(np.log(table_[k][:, said[:, k]]).T for k in range(LABELERS))
        truth = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
    return truth, table_


def _inputs(code: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Classifier inputs: votes of all labelers but the strict rule, shape bits, constant."""
    said = _digits(code)[:, 1:] - 1
    return np.concatenate((said == 1, said == -1, shape[:, None] >> np.arange(BITS) & 1, np.ones((len(code), 1))), 1).astype(
        float)


def train(rows: list[tuple[int, int, int, int]], steps: int = 100) -> dict[int, np.ndarray]:
    """Weights of the span classifier per kind, from (kind, votes, shape, n)."""
    model = {}
    for kind in range(len(KINDS)):
        own = np.array(sorted(r[1:] for r in rows if r[0] == kind), np.int64).reshape(-1, 3)
        if not len(own):
            continue
        code, shape, n = own.T
        patterns, back = np.unique(code, return_inverse=True)
        truth = estimate(patterns, np.bincount(back, n))[0][back]
        x, w, share = _inputs(code, shape), np.zeros(2 * (LABELERS - 1) + BITS + 1), n / n.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (share * (p - truth)) + 1e-3 * w
            bend = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w = w - np.linalg.solve(bend, slope)
        model[kind] = w
    return model


def fit(docs: DataFrame) -> dict[int, np.ndarray]:
    """Train on all texts. What reaches the driver are counts of vote patterns: at most 4 * 3^5 * 2^4 rows."""
    return train([tuple(r) for r in vote_counts(docs).collect()])


def spans_of(text: str, model: dict[int, np.ndarray]) -> tuple[list, list]:
    """Base spans, and base and added spans together."""
    base, more = candidates(text)
    added = []
    for s, kind, e in more:
        if kind in model:
            code, shape = votes(text, s, kind, e, False)
            z = float((_inputs(np.array([code]), np.array([shape])) @ model[kind])[0])
            _, structure, listed, context, border = _digits(np.array([code]))[0]
            backed = structure == 2 and 2 in (listed, context) and 0 not in (listed, context, border)
            if backed and z > np.log(SURE / (1 - SURE)):
                added.append((s, kind, e))
    return base, sorted(base + added)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added.

    Offsets are code points, ends exclusive. A null text is an empty one; repeated rows are each searched; an empty
    table gives no rows.
    """
    model = fit(docs)
    out = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
           + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, n_added long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    base, every = spans_of(text or "", model)
                    rows.append([sum(k == i for _, k, _ in base) for i in range(4)]
                                + [_listed(base), _listed(every), len(every) - len(base)])
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4]),
                     pa.array(columns[5]), pa.array(columns[6], pa.int64())],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"])

    found = docs.select("doc_id", "text").mapInArrow(run, out)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in square brackets; n_chars follows the text.

    All other columns stay as they are. Overlapping spans are replaced as one, under the kind of the first.
    """
    model = fit(docs)

    def clean(text: str) -> str:
        parts, at = [], 0
        for s, kind, e in spans_of(text, model)[1]:
            if s >= at:
                parts += [text[at:s], f"[{KINDS[kind].upper()}]"]
            at = max(at, e)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t if t is None else clean(t) for t in batch.column("text").to_pylist()]
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    masked = docs.mapInArrow(run, docs.schema)
    length: Column = F.length("text").cast("long")
    return masked.withColumn("n_chars", length) if "n_chars" in docs.columns else masked


@query("op4_private_data")
def _(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
