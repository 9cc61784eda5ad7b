"""Words of texts as numbers: hashes for shingles, and token ids that equal those of whole texts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from lapak.llm.batches import worker_cache

TOKENIZER = "word_bpe_49k.json"
TABLE_WORDS = 700_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_lists(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: codes of all words in order, the distinct words, words per text.

    A null text has no word. ``lower`` folds ASCII letters.
    """
    # A copy that starts at offset 0: Arrow's ascii_lower spoils slices.
    data = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(data) if lower else data)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    counts = np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[lists.offsets.to_numpy()])
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, counts


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text by text, and their number per text.

    A text with fewer words, but at least one, has one shingle of all its words; one without words has none.
    """
    codes, distinct, counts = word_lists(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes]
    starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), made)
    first = starts[owner] + np.arange(len(owner)) - np.concatenate(([0], np.cumsum(made)))[:-1][owner]
    out = np.full(len(owner), GOLDEN, np.uint64)
    end = (starts + counts)[owner]
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = first + k < end
            add = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else out
            out = np.where(inside, mix(out + add * GOLDEN), out)
    return out, made


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer drops white space and no token spans it, so the ids of a text are the ids of its words one after
    another. A full stop or comma behind an ASCII letter is always a token of its own and is split off, and case is
    folded as the tokenizer does, so fewer words are distinct; each is encoded once. A word of letters only is one
    unit of the tokenizer's byte-pair model and goes to it directly. The rules are tested against whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._encode([" \x00 "])[0]
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(others)}
        self.clear()

    def clear(self) -> None:
        """Forget all words. The first two places of the pool are the split-off full stop and comma."""
        self.place: dict[str, int] = {}
        self.pool = np.array([self._encode([m])[0][0] for m in ".,"], np.uint32)
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _learn(self, words: list[str]) -> None:
        found: list[list[int]] = [[]] * len(words)
        letters, mixed, alone = [], [], []
        for at, w in enumerate(words):
            if w.isalpha():
                if w.isascii():
                    found[at] = self._unit(w.lower())
                else:
                    letters.append(at)
            else:
                (alone if "\x00" in w or "<|" in w else mixed).append(at)
        for k in range(0, len(letters), 1000):
            part = letters[k:k + 1000]
            normal = self.tokenizer.normalizer.normalize_str(" ".join(words[at] for at in part)).split(" ")
            if len(normal) != len(part):
                alone += part
                continue
            for at, w in zip(part, normal):
                if w.isalpha():
                    found[at] = self._unit(w.encode().decode("latin-1").translate(self.alphabet))
                else:
                    alone.append(at)
        # The others are joined by a mark that is always a token of its own, which is faster than one by one.
        for k in range(0, len(mixed), 100):
            part = mixed[k:k + 100]
            ids = self._encode([" \x00 ".join(words[at] for at in part)])[0]
            cuts = [-1, *[i for i, x in enumerate(ids) if x == self.mark[0]], len(ids)]
            if len(self.mark) != 1 or len(cuts) != len(part) + 1:
                alone += part
                continue
            for at, a, b in zip(part, cuts, cuts[1:]):
                found[at] = ids[a + 1:b]
        for at, ids in zip(alone, self._encode([words[at] for at in alone])):
            found[at] = ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        self.place.update(zip(words, range(len(self.begin), len(self.begin) + len(words))))
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(size) - size))
        self.length = np.concatenate((self.length, size))
        self.pool = np.concatenate((self.pool, np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) in order and the number of ids per text; null counts as an empty text."""
        special = pc.any(pc.match_substring(pc.fill_null(texts, ""), "<|")).as_py()
        codes, distinct, counts = word_lists(texts, lower=not special)
        ends = np.where(pc.match_substring_regex(distinct, "[A-Za-z][.]$").to_numpy(zero_copy_only=False), 0,
                        np.where(pc.match_substring_regex(distinct, "[A-Za-z],$").to_numpy(zero_copy_only=False), 1, -1))
        tailed = pa.array(ends >= 0)
        bare = pc.utf8_slice_codeunits(distinct, 0, -1)
        cores = pc.if_else(tailed, bare, distinct).dictionary_encode()
        names = cores.dictionary.to_pylist()
        if len(self.place) > TABLE_WORDS:
            self.clear()
        self._learn([w for w in names if w not in self.place])
        row = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[cores.indices.to_numpy()]
        begin, core_size = self.begin[row], self.length[row]
        size = (core_size + (ends >= 0))[codes]
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(begin[codes] - total[:-1], size) + np.arange(total[-1])
        tail = ends[codes]
        with_tail = tail >= 0
        at[total[1:][with_tail] - 1] = tail[with_tail]
        return self.pool[at], np.diff(total[np.concatenate(([0], np.cumsum(counts)))])


def word_ids(name: str) -> WordIds:
    """The worker's encoder for a public tokenizer."""
    return worker_cache("ids_" + name.replace(".", "_"), lambda: WordIds(tokenizer_path(name)))
