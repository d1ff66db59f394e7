"""Ids of a word-level BPE tokenizer, for many distinct words at once.

White space separates words for this kind of tokenizer, so the ids of a text
are the ids of its words. Words are cut into letter runs, digits and other
runs; distinct runs of one byte length are merged together in NumPy: each
round merges every run's best pair and so moves the whole group one length
down. Words with other than plain Latin letters, over-long ones, contractions
and ones that may hold a special token go to the library itself.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .ragged import distinct, span_hashes, starts_of, sums_of, take_ragged, text_bytes, words_of

#: Runs kept with their ids from chunk to chunk; the memory is emptied when it is full.
MEMORY = 400_000
#: Longer words go to the library.
LONGEST = 200
# classes of bytes in a plain word
LETTER, DIGIT, OTHER, WHITE, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[33:127] = OTHER
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[32, *range(9, 14)]] = WHITE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class PairTable:
    """(left id, right id) -> (rank, merged id), open addressing with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(len(left), 1) * 8))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NO_RANK, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = (left.astype(np.int64) << 20) | right
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.rank[at[placed]] = todo[placed]
            self.merged[at[placed]] = merged[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; a slot without rank where there is no such pair."""
        shape = left.shape
        keys = ((left.astype(np.int64) << 20) | right).ravel()
        at = self.slot(keys)
        got = self.keys[at]
        more = np.flatnonzero((got != keys) & (got >= 0))
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            got = self.keys[at[more]]
            more = more[(got != keys[more]) & (got >= 0)]
        return at.reshape(shape)


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def merge(self, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(concatenated ids, number of ids) of the runs of bytes ``flat[at:at + size]``."""
        done_rows, done_ids = [], []
        rows, ids, rank = np.zeros(0, np.int64), None, None
        for n in range(int(size.max(initial=0)), 0, -1):
            new = np.flatnonzero(size == n)
            if len(new):
                letters = flat[at[new][:, None] + np.arange(n)]
                fresh = self.inner[letters]
                fresh[:, -1] = self.last[letters[:, -1]]
                fresh_rank = self.pairs.rank[self.pairs.find(fresh[:, :-1], fresh[:, 1:])]
                if len(rows):
                    rows, ids, rank = np.concatenate([rows, new]), np.concatenate([ids, fresh]), np.concatenate([rank, fresh_rank])
                else:
                    rows, ids, rank = new, fresh, fresh_rank
            if not len(rows):
                continue
            if n > 1:
                best = rank.argmin(1)
                over = rank[np.arange(len(rows)), best] == NO_RANK
            else:
                over = np.ones(len(rows), bool)
            done_rows.append(rows[over])
            done_ids.append(ids[over])
            rows, ids = rows[~over], ids[~over]
            if not len(rows):
                continue
            rank, best = rank[~over], best[~over]
            every = np.arange(len(rows))
            pair = self.pairs.find(ids[every, best], ids[every, best + 1])
            ids[every, best] = self.pairs.merged[pair]
            keep = np.ones(ids.shape, bool)
            keep[every, best + 1] = False
            ids = ids[keep].reshape(len(rows), n - 1)
            keep = np.ones(rank.shape, bool)
            keep[every, best] = False
            rank = rank[keep].reshape(len(rows), n - 2)
            for shift in (0, 1):  # the pairs that end and begin at the merged id
                has = np.flatnonzero(best >= 1 if not shift else best < n - 2)
                col = best[has] - 1 + shift
                rank[has, col] = self.pairs.rank[self.pairs.find(ids[has, col], ids[has, col + 1])]
        lengths = np.zeros(len(size), np.int64)
        for r, i in zip(done_rows, done_ids):
            lengths[r] = i.shape[1]
        bounds = starts_of(lengths)
        out = np.zeros(int(bounds[-1]), np.int32)
        for r, i in zip(done_rows, done_ids):
            out[bounds[r][:, None] + np.arange(i.shape[1])] = i
        return out, lengths

    def runs(self, flat: np.ndarray, bounds: np.ndarray):
        """(lower-cased bytes, starts, lengths, is whole odd word, bounds of each text's runs).

        A run is a word's longest piece of letters, a digit, or a longest piece of other
        characters; a word that is not plain stays whole.
        """
        low = LOWER[flat]
        kind = CLASS[low]
        # two-byte Latin letters C3 80 to C3 BF without the signs 97 and B7; capitals move by 32
        lead = np.flatnonzero(flat[:-1] == 0xC3) if len(flat) else np.zeros(0, np.int64)
        second = flat[lead + 1]
        lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        low[lead + 1] = np.where(second < 0x9F, second + 32, second)
        odd = kind == ODD
        if len(flat) > 1:  # contractions and special tokens
            quote = np.flatnonzero(flat[:-1] == 39)
            odd[quote[kind[quote + 1] == LETTER]] = True
            angle = np.flatnonzero(flat[:-1] == 60)
            odd[angle[flat[angle + 1] == 124]] = True
        starts, lengths, _ = words_of(flat, bounds)
        whole = (sums_of(odd, np.append(starts, len(flat)))[: len(starts)] > 0) | (lengths > LONGEST)
        begins = kind != WHITE
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins[starts] = True
        if whole.any():
            inner = take_ragged(np.arange(len(flat)), starts[whole] + 1, lengths[whole] - 1)
            begins[inner] = False
        at = np.flatnonzero(begins)
        ends = np.append(at[1:], len(flat))
        word = np.searchsorted(starts, at, "right") - 1
        ends = np.minimum(ends, (starts + lengths)[word])
        return low, at, ends - at, whole[word], np.searchsorted(at, bounds)

    def learn(self, keys: list, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        ids, lengths = self.merge(flat, at, size)
        self.remember(keys, ids, lengths)

    def remember(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(keys, range(len(self.lengths), len(self.lengths) + len(keys))))
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(concatenated ids of all texts, bounds of each text's ids)."""
        flat, bounds = text_bytes(texts)
        low, at, size, whole, run_bounds = self.runs(flat, bounds)
        if len(self.known) > MEMORY:
            self.forget()
        run = np.zeros(len(at), np.int64)
        plain = np.flatnonzero(~whole)
        numbers, keys, first = distinct(span_hashes(low, at[plain], size[plain]))
        keys = keys.tolist()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        if missing:
            place = plain[first[missing]]
            self.learn([keys[i] for i in missing], low, at[place], size[place])
        run[plain] = np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[numbers]
        odd = np.flatnonzero(whole)
        if len(odd):
            words = [flat[a: a + n].tobytes() for a, n in zip(at[odd].tolist(), size[odd].tolist())]
            new = [w for w in dict.fromkeys(words) if w not in self.known]
            if new:
                found = [e.ids for e in self.library.encode_batch([w.decode() for w in new], add_special_tokens=False)]
                self.remember(new, np.array([i for f in found for i in f], np.int32), np.array([len(f) for f in found], np.int64))
            run[odd] = [self.known[w] for w in words]
        lengths = self.lengths[run]
        return take_ragged(self.ids, starts_of(self.lengths)[run], lengths), starts_of(lengths)[run_bounds]
