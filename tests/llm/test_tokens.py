"""Token ids word by word, packing, token files, SentencePiece."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
from tokenizers import Tokenizer

from lapak.llm import packing, pieces, token_file
from lapak.llm.batches import slices
from lapak.llm.registry import QUERIES
from lapak.llm.words import WordIds, shingles, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_of_words_are_ids_of_texts(tokenizer):
    rng = random.Random(2)
    alphabet = "abcAB.,'’ \n\té́ÉßΣσςİ0129<|>endoftext\x00\x1c\x85\xa0中ǅﬁ🙂-_ſK"
    odd = ["", None, "it's. don't, x.y. A.B,C.. <|endoftext|> x <|ENDOFTEXT|>. ok", "a" * 5000, "́abc ́ . , .. ,."]
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)]
    expected = [e.ids for e in tokenizer.encode_batch([t or "" for t in odd], add_special_tokens=False)]
    encoder = WordIds(tokenizer_path())
    for texts in (odd, odd[:200]):
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == expected[:len(texts)]


def test_slices_give_the_same_ids_and_shingles(texts):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in texts])], ["text"])
    encoder = WordIds(tokenizer_path())
    parts = [(encoder.encode(b.column("text"))[0], shingles(b.column("text"), 5)[0]) for b in slices(batch, "text", 1 << 15)]
    assert len(parts) > 5
    assert np.array_equal(np.concatenate([p[0] for p in parts]), encoder.encode(batch.column("text"))[0])
    assert np.array_equal(np.concatenate([p[1] for p in parts]), shingles(batch.column("text"), 5)[0])


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        free = {rng.randrange(1, 40): rng.randrange(0, 4) for _ in range(5)}
        slack = rng.randrange(0, 60)
        sums = {0}
        for n, c in free.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = packing.fullest(free, slack)
        assert all(k <= free[n] for n, k in taken.items())
        assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= slack)


def packed_well(rows, capacity=4096):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_query(spark, data, texts, tokenizer):
    rows = QUERIES["op6_best_fit_packing"](spark, data).collect()
    expected = {}
    for (doc, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)):
        ids = e.ids + [1]
        for k in range(0, len(ids), 4096):
            expected[doc, k // 4096] = (k, len(ids[k:k + 4096]), crc(ids[k:k + 4096]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    assert packed_well(rows) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_packing_odd_documents(odd_docs, no_docs):
    rows = packing.pack(odd_docs, capacity=64, with_ids=True)
    found = rows.collect()
    assert {r.doc_id for r in found} >= {None, 1, 2} and sum(r.piece == 0 for r in found) == odd_docs.count()
    packed_well(found, 64)
    whole = packing.sequences(rows).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in found)
    assert packing.pack(no_docs).collect() == []


def test_code_lengths_are_optimal_under_a_limit():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free = token_file.code_lengths(counts, 20)
    assert int((free * counts).sum()) == 363 and abs(sum(2.0 ** -free) - 1) < 1e-12
    tight = token_file.code_lengths(counts, 5)
    assert tight.max() == 5 and abs(sum(2.0 ** -tight) - 1) < 1e-12
    assert token_file.code_lengths(np.array([7]), 4).tolist() == [1]


def test_token_file_query(spark, data, texts, tokenizer):
    start, expected = 0, set()
    for (doc, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False)):
        ids = e.ids + [2]
        expected.add((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op9_token_file"](spark, data).collect()} == expected


def test_token_file_odd_documents(spark, odd_docs, no_docs, tmp_path):
    token_file.write_tokens(token_file.document_ids(odd_docs), str(tmp_path / "t"), max_bits=9)
    rows = sorted(token_file.read_tokens(spark, str(tmp_path / "t"), with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in odd_docs.collect()], key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == 2 and crc(r.ids) == r.ids_crc32
        at += r.n_tokens
    assert token_file.token_round_trip(no_docs).collect() == []


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(tokenizer_path(pieces.MODEL))


def best_score(v, text):
    best = [0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            known = v.pieces.get(text[start:end])
            score = v.scores[known] if known is not None else v.unknown_score if end == start + 1 else None
            if score is not None and (best[end] is None or best[start] + score > best[end]):
                best[end] = best[start] + score
    return best[-1]


ALPHABET = "abetho nrs  ,.\n\té中🙂▁ñ123"


def test_pieces_have_the_best_score_and_decode(vocabulary):
    rng = random.Random(1)
    texts = ["", "▁", " x", "the ▁ end"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    ids, count, score = pieces.encode_batch(vocabulary, pa.array(texts))
    assert score.tolist() == [best_score(vocabulary, pieces.escaped(t)) for t in texts]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids))
    assert pieces.decode_batch(vocabulary, lists).to_pylist() == [t.replace("▁", " ") for t in texts]


def test_pieces_agree_with_the_library(vocabulary, texts):
    """The same pieces and scores as a unigram model of the library; its n-best search is exact."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(tokenizer_path(pieces.MODEL), "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    library = SentencePieceProcessor(model_proto=proto.SerializeToString())
    lines = [t.split("\n")[0][:200].rstrip() for _, t in texts]
    ids, count, score = pieces.encode_batch(vocabulary, pa.array(lines))
    for line, own, total in zip(lines, np.split(ids, np.cumsum(count)), score):
        if line and total > -10 ** 8:  # an unknown character exceeds the library's float precision
            assert library.nbest_encode_as_ids(line, 2)[0] == own.tolist() or total == sum(
                library.get_score(i) for i in library.nbest_encode_as_ids(line, 2)[0])


def test_chunks_give_the_pieces_of_the_whole(vocabulary):
    v, rng = vocabulary, random.Random(3)
    samples = ["".join(rng.choice(letters) for _ in range(rng.randrange(40, 400)))
               for letters in (ALPHABET, "thean") for _ in range(60)] + [" " * 70, "a" * 300]
    for text in samples:
        words = v.split(pieces.escaped(text))
        v.learn(words)
        whole = v.words(np.array([v.place[w] for w in words]))[0].tolist()
        for size in (16, 17, 40):
            chunks = pieces.cut_chunks(pieces.escaped(text), v.longest, size)
            entry = pieces.entries(np.array([pieces.transfer(v, *c) for c in chunks])).tolist()
            maps = np.array([pieces.trace(v, *c, e) for c, e in zip(chunks, entry)])
            exits = [*pieces.suffix_maps(maps)[1:].tolist(), 0]
            assert [i for c, e, x in zip(chunks, entry, exits) for i in pieces.chunk_ids(v, *c, e, x)] == whole


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(-50, 0, (3, 4, 4))
    assert np.array_equal(pieces.product(pieces.product(a, b), c), pieces.product(a, pieces.product(b, c)))


def test_sentencepiece_jobs(spark, odd_docs, no_docs, data, texts, vocabulary):
    ids, count, score = pieces.encode_batch(vocabulary, pa.array([t for _, t in texts]))
    expected = {d: (x.tolist(), int(s)) for (d, _), x, s in zip(texts, np.split(ids, np.cumsum(count)), score)}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    decoded = pieces.decode(pieces.encode(docs, chunk=2000)).collect()
    assert {r.doc_id: (r.ids, r.score) for r in decoded} == expected
    assert {r.doc_id: r.text for r in decoded} == dict(texts)
    odd = pieces.decode(pieces.encode(odd_docs, chunk=100)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in odd) == sorted(str((r.doc_id, r.text or "")) for r in odd_docs.collect())
    assert pieces.encode(no_docs).collect() == []


def test_words_cut_together_equal_words_cut_alone(texts):
    """Ids and scores of many words at once, with characters without a piece, spaces inside, and long words."""
    v = pieces.vocabulary(pieces.MODEL)
    rng = random.Random(6)
    words = sorted({pieces.SPACE + w for _, t in texts[:60] for w in t.split()})[:2000]
    words += ["▁" + "".join(rng.choice("abeéü漢🙂▁ \x00x<") for _ in range(rng.randrange(30))) for _ in range(1000)]
    words += ["", "▁", "🙂", "a" * 64, "ab" * 33, "the" * 400]
    v.clear()
    v.learn(words)
    for w in words:
        best, back = v.search(w, [0], len(w))
        at = v.place[w]
        assert v.pool[v.begin[at]:v.begin[at] + v.length[at]].tolist() == v.read(w, back, len(w))[0] and v.score[at] == best[-1]


def test_words_are_searched_by_units(vocabulary, monkeypatch):
    """Parts that no piece joins are searched once each, and a chunk's inner words only where its ids are made."""
    v, searched = vocabulary, []
    words = [f"▁{a}.\n{b},漢🙂" for a in ("the", "and", "of") for b in ("with", "from", "der")] + ["", "\n", "▁\n▁a", "the"]
    expected = [(v.read(w, v.search(w, [0], len(w))[1], len(w))[0], v.search(w, [0], len(w))[0][-1]) for w in words]
    v.clear()
    search = v.search
    monkeypatch.setattr(v, "search", lambda text, *more: searched.append(text) or search(text, *more))
    v.learn(words)
    assert len(searched) == len(set(searched)) and max(map(len, searched), default=0) <= 2
    rows = [v.place[w] for w in words]
    assert [(v.pool[v.begin[r]:v.begin[r] + v.length[r]].tolist(), v.score[r]) for r in rows] == expected
    v.clear()
    pieces.transfer(v, "▁the▁inner▁words▁of▁a▁chunk", "▁behind▁a▁chunk")
    assert not v.place
