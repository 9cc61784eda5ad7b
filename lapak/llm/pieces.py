"""SentencePiece encoding and decoding with a max-plus scan over chunks.

A text is cut into vocabulary pieces so that the sum of their scores is largest (the unigram rule); at equal sums the
longer last piece wins, as in the library's own search. Characters without a piece become bytes.

Long documents are split into chunks. What crosses a chunk border is known by how many characters of the next chunk the
crossing piece takes: one of as many states as the longest piece has characters. A chunk is a matrix of best scores from
entry to exit state, and matrices combine by max-plus products, which are associative. Prefix products give every chunk
its entry scores; with them each chunk knows by itself which entry state leads to each exit state; composing these maps
from the end gives the one path, and every chunk then reads off its own pieces.

In most vocabularies no piece has a space behind another character. Then every word starts a piece, so inside a chunk
words are encoded once each and only its first and last words depend on its neighbours. Two neighbouring characters that
no piece holds side by side, such as a letter and a full stop in most vocabularies, are always cut apart; so words are
made of smaller units, which are searched once each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lapak.llm.batches import slices, worker_cache, written
from lapak.llm.registry import query, table
from lapak.llm.words import GOLDEN, mix, tokenizer_path

MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 15
SPACE = "▁"
NEVER = -(1 << 60)
TABLE_WORDS = 250_000
TOGETHER, TOGETHER_WORDS = 64, 8192
FILTER_BITS = 22
FILTER = np.uint64((1 << FILTER_BITS) - 1)


class Vocabulary:
    """Pieces and whole-number scores of a model, and the best cuts of single words."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in usable}
        # Whole numbers add up alike in any order.
        scale = 1 if all(float(s).is_integer() for s in scores.values()) else 1 << 20
        self.scores = {i: round(s * scale) for i, s in scores.items()}
        self.unknown_score = min(self.scores.values()) - 10 * scale
        self.pieces = {model.id_to_piece(i): i for i in usable}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.pieces))
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        self.words_cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        self.pairs = np.array(sorted({ord(p[k]) << 32 | ord(p[k + 1]) for p in self.pieces for k in range(len(p) - 1)} or {0}),
                              np.uint64)
        raw = [bytes([b]) for b in range(256)]
        named = {i: p.encode() for p, i in self.pieces.items()} | {i: raw[b] for b, i in self.byte.items()}
        self.bytes_of = pa.array([named.get(i, b"") for i in ids], pa.large_binary())
        order = sorted((self.hash_of(p), i) for p, i in self.pieces.items())
        self.hashes = np.array([h for h, _ in order], np.uint64)
        self.hashed = np.array([i for _, i in order], np.int64)
        self.hashed_scores = np.array([self.scores[i] for _, i in order], np.int64)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.hashes & FILTER] = True
        self.clear()

    @staticmethod
    def hash_of(piece: str) -> int:
        """Polynomial hash of a text, the number of a character being mixed first. No two pieces share one."""
        found = 0
        for code in mix(np.array([ord(c) for c in piece], np.uint64) + GOLDEN).tolist():
            found = (found * int(GOLDEN) + code) % (1 << 64)
        return found

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.begin, self.length, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, np.int32)

    def steps(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, score) of every piece that starts at ``start``; the character itself is always one."""
        single = False
        for end in range(start + 1, min(len(text), start + self.longest) + 1):
            piece = text[start:end]
            if piece not in self.prefixes:
                break
            found = self.pieces.get(piece)
            if found is not None:
                single = single or end == start + 1
                yield end, self.scores[found]
        if not single:
            yield start + 1, self.unknown_score

    def search(self, text: str, entry: list[int], stop: int) -> tuple[list[int], list[int]]:
        """Best scores and predecessors of all positions, from the entry scores of the first ones (-1: entered there),
        over pieces that start before ``stop``."""
        best = [NEVER] * (len(text) + 1)
        back = [-1] * (len(text) + 1)
        best[:len(entry)] = entry[:len(best)]
        for start in range(min(stop, len(text))):
            value = best[start]
            if value > NEVER:
                for end, score in self.steps(text, start):
                    if value + score > best[end]:
                        best[end], back[end] = value + score, start
        return best, back

    def read(self, text: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path to ``end`` and the position where it entered."""
        cuts = [end]
        while back[cuts[-1]] >= 0:
            cuts.append(back[cuts[-1]])
        ids: list[int] = []
        for a, b in zip(reversed(cuts), list(reversed(cuts))[1:]):
            found = self.pieces.get(text[a:b])
            if found is not None:
                ids.append(found)
            else:
                ids += [self.byte[x] for x in text[a:b].encode()] if self.byte else [self.unknown]
        return ids, cuts[-1]

    def cut_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best cuts of many words at once, as ``search`` and ``read`` give them: ids of all words one after another,
        their number and the score of each word, and whether it holds a character without a piece.

        Position by position, all words take the best piece that ends there; pieces are known by rolling hashes.
        """
        length = np.fromiter(map(len, words), np.int64, len(words))
        most, n = int(length.max()), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length)
        chars = np.zeros((most, n), np.uint64)
        chars[at, np.repeat(np.arange(n), length)] = mix(codes.astype(np.uint64) + GOLDEN)
        begun, power = np.zeros((most + 1, n), np.uint64), [np.uint64(1)]
        best, back, piece = (np.zeros((most + 1, n), np.int64) for _ in range(3))
        with np.errstate(over="ignore"):
            for k in range(most):
                begun[k + 1] = begun[k] * GOLDEN + chars[k]
                power.append(power[-1] * GOLDEN)
            for end in range(1, most + 1):
                value, start, chosen = np.full(n, NEVER), np.full(n, end - 1), np.full(n, -1)
                for size in range(min(end, self.longest), 0, -1):
                    hashed = begun[end] - begun[end - size] * power[size]
                    rows = np.flatnonzero(self.seen[hashed & FILTER])
                    place = np.minimum(np.searchsorted(self.hashes, hashed[rows]), len(self.hashes) - 1)
                    hit = self.hashes[place] == hashed[rows]
                    rows, place = rows[hit], place[hit]
                    if size == 1:
                        alone = np.ones(n, bool)
                        alone[rows] = False
                        alone &= best[end - 1] + self.unknown_score > value
                        value[alone], start[alone], chosen[alone] = best[end - 1][alone] + self.unknown_score, end - 1, -1
                    reached = best[end - size][rows] + self.hashed_scores[place]
                    better = reached > value[rows]
                    rows = rows[better]
                    value[rows], start[rows], chosen[rows] = reached[better], end - size, self.hashed[place[better]]
                best[end], back[end], piece[end] = value, start, chosen
        word, place, path, owner = np.arange(n), length.copy(), [], []
        while len(word):
            path.append(piece[place, word])
            owner.append(word)
            place = back[place, word]
            word, place = word[place > 0], place[place > 0]
        step = np.repeat(np.arange(len(path)), list(map(len, path)))
        path, owner = np.concatenate(path), np.concatenate(owner)
        order = np.lexsort((-step, owner))
        unknown = np.bincount(owner, path < 0, n) > 0
        return path[order], np.bincount(owner, minlength=n), best[length, np.arange(n)], unknown

    def units(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Parts of all words, cut between characters that stand side by side in no piece, and where each word begins
        among them. The best cuts of a word are those of its parts."""
        text, length = "".join(words), np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate(([0], np.cumsum(length)))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        pair = codes[:-1] << np.uint64(32) | codes[1:]
        place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = self.pairs[place] != pair
        cut[begin] = True
        at = np.flatnonzero(cut).tolist()
        return [text[a:b] for a, b in zip(at, at[1:])], np.concatenate(([0], np.cumsum(cut[:-1])))[begin]

    def learn(self, words: list[str]) -> None:
        """Best cuts of words that are not known yet, put together from those of their units."""
        new = list(dict.fromkeys([w for w in words if w not in self.place]))
        if not new:
            return
        units, begin = self.units(new)
        self.learn_units([u for u in dict.fromkeys(units) if u not in self.place])
        row = np.fromiter(map(self.place.__getitem__, units), np.int64, len(units))
        # A word that is one unit is known by now.
        joined = np.diff(begin) != 1
        row = row[np.repeat(joined, np.diff(begin))]
        begin = np.concatenate(([0], np.cumsum(np.diff(begin)[joined])))
        ids, size = self.words(row)
        self.add([w for w, j in zip(new, joined.tolist()) if j], ids, np.diff(np.concatenate(([0], np.cumsum(size)))[begin]),
                 np.diff(np.concatenate(([0], np.cumsum(self.score[row])))[begin]))

    def learn_units(self, new: list[str]) -> None:
        """Best cuts of new units: short ones together, those of like length at once."""
        by_size: dict[int, list[str]] = {}
        for w in new:
            by_size.setdefault((len(w) + 3) // 4 if len(w) <= TOGETHER else TOGETHER, []).append(w)
        alone, words, made = by_size.pop(TOGETHER, []), [], []
        for same in by_size.values():
            for first in range(0, len(same), TOGETHER_WORDS):
                part = same[first:first + TOGETHER_WORDS]
                ids, count, score, unknown = self.cut_together(part)
                if unknown.any():
                    alone += [w for w, strange in zip(part, unknown.tolist()) if strange]
                    part = [w for w, strange in zip(part, unknown.tolist()) if not strange]
                    ids, count, score = ids[np.repeat(~unknown, count)], count[~unknown], score[~unknown]
                words += part
                made.append((ids, count, score))
        for w in alone:
            best, back = self.search(w, [0], len(w))
            ids = self.read(w, back, len(w))[0]
            words.append(w)
            made.append((np.array(ids, np.int64), np.array([len(ids)]), np.array([best[-1]])))
        if words:
            self.add(words, *map(np.concatenate, zip(*made)))

    def add(self, words: list[str], ids: np.ndarray, size: np.ndarray, score: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.begin), len(self.begin) + len(words))))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(size) - size))
        self.length = np.concatenate((self.length, size))
        self.score = np.concatenate((self.score, score))
        self.pool = np.concatenate((self.pool, ids.astype(np.int32)))

    def words(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words by their places, one after another, and their number per word."""
        size = self.length[row]
        total = np.concatenate(([0], np.cumsum(size)))
        return self.pool[np.repeat(self.begin[row] - total[:-1], size) + np.arange(total[-1])], size

    def split(self, text: str) -> list[str]:
        """Words of an escaped text; each starts with its spaces."""
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if self.words_cut else [text]


def vocabulary(name: str) -> Vocabulary:
    return worker_cache("pieces_" + name.replace(".", "_"), lambda: Vocabulary(tokenizer_path(name)))


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode_batch(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, their number and the score per text; null counts as empty."""
    if len(v.place) > TABLE_WORDS:
        v.clear()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    odd = pc.match_substring_regex(texts, f"^ | $|  |{SPACE}|^$").to_numpy(zero_copy_only=False)
    if not v.words_cut:
        odd = np.ones(len(texts), bool)
    # One space between words everywhere: words by Arrow, each distinct one looked up once.
    lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    coded = lists.flatten().dictionary_encode()
    n = len(coded.dictionary)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), pa.scalar(" " + SPACE, pa.large_string()))
    plain = (SPACE + joined[0].as_py()).split(" ") if n else []
    v.learn(plain)
    places = np.fromiter(map(v.place.__getitem__, plain), np.int64, len(plain))
    count = np.zeros(len(texts), np.int64)
    count[~odd] = lists.value_lengths().to_numpy() if len(lists) else 0
    rest = [v.split(escaped(t)) for t in texts.filter(pa.array(odd)).to_pylist()]
    v.learn([w for words in rest for w in words])
    count[odd] = list(map(len, rest))
    row = np.zeros(int(count.sum()), np.int64)
    from_odd = np.repeat(odd, count)
    row[~from_odd] = places[coded.indices.to_numpy()]
    row[from_odd] = [v.place[w] for words in rest for w in words]
    ids, size = v.words(row)
    cut = np.concatenate(([0], np.cumsum(count)))
    per_text = np.concatenate(([0], np.cumsum(size)))[cut]
    score = np.concatenate(([0], np.cumsum(v.score[row])))[cut]
    return ids, np.diff(per_text), np.diff(score)


def resets(v: Vocabulary, text: str) -> tuple[int, int] | None:
    """First and last position inside ``text`` where a word starts, if words always start a piece."""
    if not v.words_cut:
        return None
    first = re.search(f"(?<=[^{SPACE}]){SPACE}", text)
    if first is None:
        return None
    last = len(text) - 1
    while not (text[last] == SPACE and text[last - 1] != SPACE):
        last -= 1
    return first.start(), last


def transfer(v: Vocabulary, text: str, ahead: str) -> np.ndarray:
    """Max-plus matrix of a chunk: best score from each entry state to each exit state, less the score of its inner words,
    which all paths share."""
    n, out = v.longest, np.full((v.longest, v.longest), NEVER, np.int64)
    at = resets(v, text)
    head = at[0] if at else None
    tail = None
    if at:
        tail, _ = v.search(text[at[1]:] + ahead, [0], len(text) - at[1])
    for i in range(min(n, len(text) + 1) if head is None else min(n, head + 1)):
        if head is None:
            best, _ = v.search(text + ahead, [NEVER] * i + [0], len(text))
            values = best[len(text):]
        else:
            best, _ = v.search(text[:head], [NEVER] * i + [0], head)
            values = [best[head] + x if x > NEVER and best[head] > NEVER else NEVER for x in tail[len(text) - at[1]:]]
        out[i, :len(values)] = values
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    out = np.full(a.shape, NEVER, np.int64)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k:k + 1] + b[..., k:k + 1, :], out=out)
    out[out < NEVER // 2] = NEVER
    return out


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """Products of all prefixes, by doubling."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = product(out[:-step], out[step:])
        step *= 2
    return out


def entries(matrices: np.ndarray) -> np.ndarray:
    """Entry scores of each chunk of a document, from its chunks' matrices."""
    first = np.full(matrices.shape[-1], NEVER, np.int64)
    first[0] = 0
    return np.concatenate((first[None], prefix_products(matrices)[:-1, 0, :]))


def trace(v: Vocabulary, text: str, ahead: str, entry: list[int]) -> list[int]:
    """Entry state of the best path to each exit state (-1: no path)."""
    at = resets(v, text)
    if at:
        best, back = v.search(text[:at[0]], entry[:at[0] + 1], at[0])
        return [v.read(text[:at[0]], back, at[0])[1]] * v.longest
    best, back = v.search(text + ahead, entry, len(text))
    ends = range(len(text), len(text) + v.longest)
    return [v.read(text + ahead, back, e)[1] if e < len(best) and best[e] > NEVER else -1 for e in ends]


def suffix_maps(maps: np.ndarray) -> np.ndarray:
    """Entry state of each chunk on the path that ends in exit state 0 of the last one, by doubling from the end."""
    out, step = maps.copy(), 1
    while step < len(out):
        # out[c] maps an exit state of chunk min(c + step, last) to an entry state of c.
        later = out[step:]
        out[:-step] = np.where(later >= 0, np.take_along_axis(out[:-step], np.maximum(later, 0), 1), -1)
        step *= 2
    return out[:, 0]


def chunk_ids(v: Vocabulary, text: str, ahead: str, entry: list[int], exit_: int) -> list[int]:
    """Ids of the pieces that start in the chunk, on the path that leaves it in state ``exit_``."""
    end, at = len(text) + exit_, resets(v, text)
    if at is None:
        return v.read(text + ahead, v.search(text + ahead, entry, len(text))[1], end)[0]
    head = v.read(text[:at[0]], v.search(text[:at[0]], entry[:at[0] + 1], at[0])[1], at[0])[0]
    # The space that begins the inner words is the one that stands for the start of a text.
    inner = encode_batch(v, pa.array([text[at[0] + 1:at[1]].replace(SPACE, " ")]))[0].tolist()
    last = text[at[1]:] + ahead
    return head + inner + v.read(last, v.search(last, [0], len(text) - at[1])[1], end - at[1])[0]


def cut_chunks(text: str, longest: int, size: int) -> list[tuple[str, str]]:
    """Chunks of an escaped text with the characters that follow; none is shorter than the longest piece but an only one."""
    starts = list(range(0, len(text), size)) or [0]
    if len(starts) > 1 and len(text) - starts[-1] < longest:
        starts.pop()
    ends = [*starts[1:], len(text)]
    return [(text[a:b], text[b:b + longest - 1]) for a, b in zip(starts, ends)]


def _scanned(chunks: DataFrame, model: str) -> DataFrame:
    """key, chunk, ids, score: the ids of each chunk; the score of the text stands at its first chunk."""
    def per_chunk(work, extra, out):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, kind = vocabulary(model), pa.int32() if out == "ids" else pa.int64()
            for whole in batches:
                for batch in slices(whole, "text", 1 << 19):
                    if len(v.place) > TABLE_WORDS:
                        v.clear()
                    columns = [batch.column(c).to_pylist() for c in ("text", "ahead", *extra)]
                    made = [np.array(work(v, *row), kind.to_pandas_dtype()) for row in zip(*columns)]
                    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(
                        made, pa.list_(kind))], ["key", "chunk", out])

        return run

    def scan(values: str, out: str, combine):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("chunk")
            return pd.DataFrame({"key": frame["key"], "chunk": frame["chunk"], out: combine(
                np.array(frame[values].tolist(), np.int64))})

        return run

    def matrices(flat: np.ndarray) -> list:
        side = int(flat.shape[1] ** 0.5)
        return entries(flat.reshape(-1, side, side)).tolist()

    def exits(maps: np.ndarray) -> list:
        return [*suffix_maps(maps)[1:].tolist(), 0]

    # The rows of one document in a scan are small: at most 2^31 / CHUNK of them, as a text is at most 2 GB long.
    flat = chunks.mapInArrow(per_chunk(lambda v, t, a: transfer(v, t, a).ravel().tolist(), (), "m"),
                             "key binary, chunk int, m array<long>")
    entered = written(flat.groupBy("key").applyInPandas(scan("m", "entry", matrices), "key binary, chunk int, entry array<long>"),
                      "entries")
    known = chunks.join(entered, ["key", "chunk"])
    maps = known.mapInArrow(per_chunk(trace, ("entry",), "m"), "key binary, chunk int, m array<long>")
    left = maps.groupBy("key").applyInPandas(scan("m", "exit", exits), "key binary, chunk int, exit int")
    return known.join(left, ["key", "chunk"]).mapInArrow(
        per_chunk(chunk_ids, ("entry", "exit"), "ids"), "key binary, chunk int, ids array<int>")


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, ids, score.

    A null text is an empty one and has no ids. Repeated rows and null doc_ids each give a row; an empty table none.
    Texts longer than ``chunk`` are found by their md5 and encoded once for all their copies.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for big in batches:
            for batch in slices(big, "text"):
                ids, count, score = encode_batch(v, batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids)), pa.array(score)],
                    ["doc_id", "ids", "score"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = vocabulary(model).longest
        for big in batches:
            for key, text in zip(*(big.column(c).to_pylist() for c in ("key", "text"))):
                parts = cut_chunks(escaped(text), longest, chunk)
                for at in range(0, len(parts), 64):
                    part = parts[at:at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(part)), pa.array(range(at, at + len(part)), pa.int32()),
                         pa.array([p[0] for p in part]), pa.array([p[1] for p in part])], ["key", "chunk", "text", "ahead"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        value = np.full(len(v.bytes_of), v.unknown_score, np.int64)
        for i, s in v.scores.items():
            value[i] = s
        for i in v.byte.values():
            value[i] = 0
        # The first byte of a character stands for the whole unknown character.
        heads = {i for b, i in v.byte.items() if b & 0xC0 != 0x80}
        for i in heads:
            value[i] = v.unknown_score
        for whole in batches:
            for batch in slices(whole, "ids"):
                ids = batch.column("ids")
                sums = np.concatenate(([0], np.cumsum(value[ids.flatten().to_numpy()])))
                cut_ = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
                yield pa.RecordBatch.from_arrays([batch.column("key"), ids, pa.array(np.diff(sums[cut_]))],
                                                 ["key", "ids", "score"])

    short = rows.filter(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {kind}, ids array<int>, score long")
    giant = rows.filter(F.length("text") > chunk).withColumn("key", F.unhex(F.md5("text")))
    once = giant.groupBy("key").agg(F.first("text").alias("text"))
    chunks = once.mapInArrow(cut, "key binary, chunk int, text string, ahead string").repartition("key", "chunk")
    found = _scanned(written(chunks, "chunks"), model)
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    texts = found.groupBy("key").agg(F.flatten(F.transform(ordered, lambda c: c["ids"])).alias("ids"))
    scored = texts.mapInArrow(total, "key binary, ids array<int>, score long")
    return short.unionByName(giant.select("doc_id", "key").join(scored, "key").select("doc_id", "ids", "score"))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The rows of ``encode`` with the text of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole in batches:
            for batch in slices(whole, "ids"):
                yield batch.append_column("text", decode_batch(v, batch.column("ids")))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, text string")


def decode_batch(v: Vocabulary, ids: pa.Array) -> pa.Array:
    flat = v.bytes_of.take(ids.flatten())
    offsets = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.scalar(b"", pa.large_binary()))
    text = pc.replace_substring(joined, SPACE.encode(), b" ")
    # The leading space stands for the start of the text.
    return pc.replace_substring_regex(text, "^ ", "", max_replacements=1).cast(pa.string())


def digests(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, score, ids_crc32 and decoded_sha256 of encoded documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole in batches:
            for batch in slices(whole, "ids"):
                ids = batch.column("ids")
                flat, size = ids.flatten().to_numpy().astype("<u4"), ids.value_lengths().to_numpy()
                at = np.concatenate(([0], np.cumsum(size)))
                decoded = decode_batch(v, ids).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(size, pa.int64()), batch.column("score"),
                     pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()),
                     pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())],
                    ["doc_id", "n_tokens", "score", "ids_crc32", "decoded_sha256"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens long, score long, ids_crc32 long, decoded_sha256 string")


@query("op1_sentencepiece")
def _(spark, sf_dir):
    return digests(encode(table(spark, sf_dir, "documents")))
