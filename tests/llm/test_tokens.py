"""Encoders against their libraries; packing and the digest cache."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shopgroups.llm.common import work_folder
from shopgroups.llm.packing import best_fit, pack_documents
from shopgroups.llm.piecewise import MARK, decode_pieces, encode_pieces, text_pieces
from shopgroups.llm.piecewise import coder
from shopgroups.llm.token_counts import PieceCounter, cached_counts, token_counts, tokenizer_digest
from shopgroups.llm.wordbpe import WordBpe

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b ", "\t\n", "don't I'LL we'Re 'tis", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "İstanbul ΟΔΟΣ ſt ẞ ŉx",
       "12½ ²³ 3.14 x×y a÷b", "漢字 \U0001F600 ªº", "a" * 450 + " " + "é" * 250, "\x00a \x7f b\x85c d", "▁x▁ y", "<s> </s> <unk>", "...,,,---", "ÀÉÎ Straße ñandú"]
TEXTS = st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abeth sing,.'<|>\n ÀéßŸ12")), max_size=60), min_size=1, max_size=8)


@pytest.fixture(scope="module")
def words():
    return WordBpe(WORDS)


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(PIECES)


def same_words(words, texts):
    ids, bounds = words.encode(pa.array(texts, pa.large_string()))
    for i, e in enumerate(words.library.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i]: bounds[i + 1]].tolist() == e.ids, texts[i]


def test_word_ids_of_odd_texts(words):
    same_words(words, ODD)


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_word_ids(words, texts):
    same_words(words, texts)


def test_word_memory_is_emptied(words, monkeypatch):
    monkeypatch.setattr("shopgroups.llm.wordbpe.MEMORY", 3)
    for text in ("one two three four", "five six one two", "one"):
        same_words(words, [text])


@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_piece_counts(counter, texts):
    assert counter.by_word
    assert counter.count(pa.array(texts, pa.large_string())).tolist() == [len(e) for e in counter.library.encode(texts)]


def test_piece_counts_of_odd_texts(counter):
    assert counter.count(pa.array(ODD, pa.large_string())).tolist() == [len(e) for e in counter.library.encode(ODD)]


def best_by_hand(text):
    """Viterbi a character at a time; ties to the longer last piece."""
    pieces, scores, kind = text_pieces(PIECES)
    by_piece = {p: i for i, (p, k) in enumerate(zip(pieces, kind)) if k == 0}
    bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kind)) if k == 1}
    unknown = min(scores[i] for i in by_piece.values()) - 10
    text = (MARK + text).replace(" ", MARK) if text else ""
    best = [(0.0, 0, None)] + [None] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - 16), j):
            piece = by_piece.get(text[i:j])
            if piece is None and j - i > 1:
                continue
            score = best[i][0] + (scores[piece] if piece is not None else unknown)
            if best[j] is None or score > best[j][0]:
                best[j] = (score, i, piece)
    out, j = [], len(text)
    while j:
        _, i, piece = best[j]
        out = ([piece] if piece is not None else [bytes_[b] for b in text[i:j].encode()]) + out
        j = i
    return out


@settings(max_examples=100, deadline=None)
@given(texts=TEXTS)
def test_viterbi_and_round_trip(texts):
    check_viterbi(texts)


def test_viterbi_of_odd_texts():
    check_viterbi([t for t in ODD if len(t) < 100] + ["and for you that with the then", "x" * 40])


def check_viterbi(texts):
    c = coder(PIECES)
    ids, bounds = c.encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i]: bounds[i + 1]].tolist() == best_by_hand(t), t
    assert c.decode(ids, bounds).to_pylist() == [t.replace(MARK, " ") for t in texts]


def test_library_agrees_on_the_best_pieces():
    """The library's n-best search over the same pieces finds the same best segmentation."""
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(PIECES, "rb").read()))
    texts = ["the", "and for you", "attention there", "with this"]
    ids, bounds = coder(PIECES).encode(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert library.nbest_encode(t, nbest_size=8)[0] == ids[bounds[i]: bounds[i + 1]].tolist()


def as_unigram(raw):
    """The model file with its type set to unigram."""
    def number(b, i):
        v = s = 0
        while True:
            v |= (b[i] & 127) << s
            s, i = s + 7, i + 1
            if not b[i - 1] & 128:
                return v, i

    def written(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    out, i = b"", 0
    while i < len(raw):
        tag, i = number(raw, i)
        n, i = number(raw, i)
        body, i = raw[i:i + n], i + n
        if tag >> 3 == 2:
            kept, j = b"", 0
            while j < len(body):
                begin = j
                field, j = number(body, j)
                if field & 7 == 0:
                    _, j = number(body, j)
                else:
                    n, j = number(body, j) if field & 7 == 2 else (4, j)
                    j += n
                if field >> 3 != 3:
                    kept += body[begin:j]
            body = kept + written(3 << 3) + written(1)
        out += written(tag) + written(len(body)) + body
    return out


def test_encode_and_decode_tables(spark, table):
    rows = [(1, "the cat  sat", "a"), (2, None, "a"), (None, "x\ny", None), (2, "", "b"), (3, "long " * 30_000, "a")]
    coded = encode_pieces(table(rows), PIECES)
    back = [(r.doc_id, r.text) for r in decode_pieces(coded, PIECES).collect()]
    assert sorted(back, key=str) == sorted([(i, t or "") for i, t, _ in rows], key=str)
    assert encode_pieces(table([]), PIECES).count() == 0


def brute_best_fit(sizes, capacity):
    left, bins = [], np.zeros(len(sizes), int)
    for i in np.argsort(-np.asarray(sizes), kind="stable"):
        fits = [(l, b) for b, l in enumerate(left) if l >= sizes[i]]
        if fits:
            tight = min(l for l, _ in fits)
            b = next(b for l, b in fits if l == tight)
        else:
            left.append(capacity)
            b = len(left) - 1
        left[b] -= sizes[i]
        bins[i] = b
    return sorted(left)


@settings(max_examples=100, deadline=None)
@given(sizes=st.lists(st.integers(1, 20), max_size=80), capacity=st.sampled_from([20, 23, 32]))
def test_best_fit_matches_a_scan_of_all_bins(sizes, capacity):
    bins, offsets = best_fit(np.array(sizes, np.int64), capacity)
    filled = defaultdict(list)
    for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes):
        filled[b].append((o, s))
    for inside in filled.values():
        at = 0
        for o, s in sorted(inside):
            assert o == at
            at += s
        assert at <= capacity
    assert sorted(capacity - sum(s for _, s in v) for v in filled.values()) == brute_best_fit(sizes, capacity)


def test_packing(spark, table):
    rows = [(1, "one two three", "a"), (1, "one two three", "a"), (2, None, "a"), (None, "four", "b"), (3, "word " * 70, "a"), (4, "word " * 63, "a")]
    out = pack_documents(table(rows), capacity=32, group_pieces=4, keep_ids=True).collect()
    library = Tokenizer.from_file(WORDS)
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in [r for r in rows if r[0] is not None])
    got, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length <= 32 and r.start == 32 * r.piece and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        sequences[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.piece, r.ids))
    assert sorted(x for p in got[3] for x in [p[0]]) == [0, 1, 2] and [i for _, p in sorted(got[3]) for i in p] == dict(want)[3]
    assert len(got[1]) == 2 and len(got[None]) == 1 and got[2] == [(0, [0])]
    for inside in sequences.values():
        at = 0
        for o, n in sorted(inside):
            assert o == at
            at += n
        assert at <= 32
    assert pack_documents(table([])).count() == 0


def test_token_counts_and_cache(spark, table):
    rows = [(1, "a b c", "s"), (2, "a b c", "s"), (2, "other", "s"), (None, "null id", None), (3, None, "s"), (4, "w " * 50_000, "s"), (4, "a b c", "s")]
    cache = work_folder(spark, "cache")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted([(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t, _ in rows], key=str)
    assert sorted(map(tuple, token_counts(table(rows), PIECES, cache).collect()), key=str) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == 5  # distinct texts
    # a second run encodes only the text that is new
    again = token_counts(table(rows + [(9, "new text", "s")]), PIECES, cache)
    assert again.count() == 8 and spark.read.parquet(cache).count() == 6
    assert cached_counts(spark, cache, tokenizer_digest(PIECES)).count() == 6
    assert cached_counts(spark, cache, tokenizer_digest(WORDS)).count() == 0
    own = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r.n_tokens for r in token_counts(table([(1, "one two", "s")]), WORDS, cache).collect()}
    assert got == {1: len(own.encode("one two", add_special_tokens=False).ids)}
    assert token_counts(table([]), PIECES, work_folder(spark, "cache")).count() == 0
