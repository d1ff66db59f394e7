"""SentencePiece encoding and decoding: batched NumPy Viterbi.

A text is encoded as the best segmentation into pieces by the sum of their
scores (the unigram algorithm, over the pieces and scores of a model file).
Spaces become marks, a mark is put before the text, and a unit is a run of
marks with what follows up to the next mark; pieces that cross units are none
of the usual models' and are refused. Distinct units of equal length advance
together: hashes of all their substrings of one length probe the sorted keys of
the pieces of that length, and vectorised maxima over the last piece's length
store scores and backpointers. Characters without a piece cost ``UNKNOWN``
below the worst piece and become byte pieces. Ties go to the longer last piece.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, python_ready
from .ragged import chunks, distinct, mix, span_hashes, starts_of, strings, take_ragged, text_bytes

#: Units kept with their ids from chunk to chunk; the memory is emptied when it is full.
MEMORY = 400_000
#: By which a character without a piece costs more than the worst piece.
UNKNOWN = 10.0
MARK = "▁"
MARK_BYTES = MARK.encode()
#: Longer units are cut into windows for the forward pass only in memory terms: characters times units of one pass.
PASS_CELLS = 1 << 20


def text_pieces(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces, scores, kind: 0 normal, 1 byte, 2 other) of a model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    kind = [1 if model.is_byte(i) else 2 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 0 for i in range(n)]
    return pieces, np.array([model.get_score(i) for i in range(n)], np.float64), np.array(kind)


def code_hash(sums: np.ndarray, n: int) -> np.ndarray:
    return mix(sums + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))


class PieceCoder:
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        pieces, scores, kind = text_pieces(path)
        crossing = [p for p, k in zip(pieces, kind) if not k and MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"the model has pieces that cross a space: {crossing[:3]}")
        normal = np.flatnonzero(kind == 0)
        self.unknown = float(scores[normal].min()) - UNKNOWN
        self.byte_ids = np.zeros(256, np.int32)
        for i in np.flatnonzero(kind == 1):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.has_bytes = bool((kind == 1).any())
        self.unknown_id = next((i for i, (p, k) in enumerate(zip(pieces, kind)) if k == 2 and p == "<unk>"), 0)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[int]] = {}
        for i in normal:
            by_length.setdefault(len(pieces[i]), []).append(int(i))
        for n, ids in by_length.items():
            codes = np.array([[ord(c) for c in pieces[i]] for i in ids], np.uint64)
            sums = np.zeros(len(ids), np.uint64)
            for j in range(n):
                sums = sums * self.BASE + codes[:, j]
            keys = code_hash(sums, n)
            order = np.argsort(keys)
            self.keys[n] = (keys[order], np.array(ids, np.int32)[order], scores[np.array(ids)][order])
        self.longest = max(self.keys, default=1)
        raw = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(MARK, " ").encode() for p, k in zip(pieces, kind)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = starts_of(self.raw_lengths)[:-1]
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def best(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in order, number of ids) for the units of equal length in the rows of ``codes``."""
        rows, n = codes.shape
        score = np.full((rows, n + 1), -np.inf)
        score[:, 0] = 0
        back = np.zeros((rows, n + 1), np.int16)  # length of the best last piece
        last = np.zeros((rows, n + 1), np.int32)  # its id, -1 for an unknown character
        found = {}
        sums = np.zeros((rows, n), np.uint64)
        for m in range(1, min(n, self.longest) + 1):
            sums = sums[:, : n - m + 1] * self.BASE + codes[:, m - 1:]
            if m in self.keys:
                keys, ids, scores = self.keys[m]
                wanted = code_hash(sums, m)
                at = np.minimum(np.searchsorted(keys, wanted.ravel()).reshape(wanted.shape), len(keys) - 1)
                hit = keys[at] == wanted
                if m == 1:
                    found[m] = (np.where(hit, scores[at], self.unknown), np.where(hit, ids[at], -1))
                elif hit.any():
                    found[m] = (np.where(hit, scores[at], -np.inf), ids[at])
            elif m == 1:
                found[m] = (np.full((rows, n), self.unknown), np.full((rows, n), -1, np.int32))
        lengths = sorted(found, reverse=True)  # the longer last piece first: it wins ties
        for j in range(1, n + 1):
            own = [m for m in lengths if m <= j]
            options = np.stack([score[:, j - m] + found[m][0][:, j - m] for m in own])
            pick = options.argmax(0)
            every = np.arange(rows)
            score[:, j] = options[pick, every]
            back[:, j] = np.array(own)[pick]
            last[:, j] = np.stack([found[m][1][:, j - m] for m in own])[pick, every]
        # back from the ends, all rows a piece at a time
        at = np.full(rows, n)
        steps_row, steps_at, steps_id = [], [], []
        active = np.arange(rows)
        while len(active):
            steps_row.append(active)
            steps_at.append(at[active] - back[active, at[active]])
            steps_id.append(last[active, at[active]])
            at[active] = steps_at[-1]
            active = active[at[active] > 0]
        row, place, ids = map(np.concatenate, (steps_row, steps_at, steps_id))
        order = np.lexsort((place, row))
        row, place, ids = row[order], place[order], ids[order]
        unknown = np.flatnonzero(ids < 0)
        if len(unknown) and not self.has_bytes:
            ids[unknown] = self.unknown_id
        elif len(unknown):
            spelled = [chr(c).encode() for c in codes[row[unknown], place[unknown]].tolist()]
            width = np.ones(len(ids), np.int64)
            width[unknown] = [len(s) for s in spelled]
            row, ids = np.repeat(row, width), np.repeat(ids, width)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return ids.astype(np.int32), np.bincount(row, minlength=rows)

    def best_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(concatenated ids, number of ids) of the units, grouped by length."""
        size = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        at = starts_of(size)
        order, ids, lengths = [], [], []
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            step = max(1, PASS_CELLS // int(n * 16))
            for k in range(0, len(rows), step):
                some = rows[k: k + step]
                got = self.best(codes[at[some][:, None] + np.arange(n)].astype(np.uint64))
                order.append(some)
                ids.append(got[0])
                lengths.append(got[1])
        order, ids, counts = np.concatenate(order), np.concatenate(ids), np.concatenate(lengths)
        out_counts = np.zeros(len(units), np.int64)
        out_counts[order] = counts
        first = np.zeros(len(units), np.int64)
        first[order] = starts_of(counts)[:-1]
        return take_ragged(ids, first, out_counts), out_counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(concatenated ids of all texts, bounds of each text's ids); empty texts have none."""
        flat, bounds = text_bytes(texts)
        space = flat == 32
        # a mark in the text counts as a space
        if len(flat) > 2:
            lead = np.flatnonzero((flat[:-2] == MARK_BYTES[0]) & (flat[1:-1] == MARK_BYTES[1]) & (flat[2:] == MARK_BYTES[2]))
        else:
            lead = np.zeros(0, np.int64)
        if len(lead):  # rewritten with spaces
            keep = np.ones(len(flat), bool)
            keep[lead + 1] = keep[lead + 2] = False
            flat = flat.copy()
            flat[lead] = 32
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            flat = flat[keep]
            space = flat == 32
        # a unit begins at a space that follows no space, and at the text's begin
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        edges = np.unique(bounds[:-1][bounds[:-1] < np.repeat(bounds[-1:], len(bounds) - 1)])
        begins[edges] = True
        at = np.flatnonzero(begins)
        size = np.diff(np.append(at, len(flat)))
        opens = np.zeros(len(at), bool)  # units that the mark before the text precedes
        opens[np.searchsorted(at, edges)] = True
        hashes = span_hashes(flat, at, size)
        hashes[opens] = mix(hashes[opens] + np.uint64(1))
        numbers, keys, first = distinct(hashes)
        keys = keys.tolist()
        if len(self.known) > MEMORY:
            self.forget()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        if missing:
            spans = zip(at[first[missing]].tolist(), size[first[missing]].tolist(), opens[first[missing]].tolist())
            units = [MARK * o + flat[a: a + n].tobytes().decode().replace(" ", MARK) for a, n, o in spans]
            ids, lengths = self.best_units(units)
            self.known.update(zip([keys[i] for i in missing], range(len(self.lengths), len(self.lengths) + len(missing))))
            self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        unit = np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[numbers]
        lengths = self.lengths[unit]
        return take_ragged(self.ids, starts_of(self.lengths)[unit], lengths), starts_of(lengths)[np.searchsorted(at, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of the ids: byte pieces joined, marks as spaces, without the mark before the text.
        Bytes that are no UTF-8 become replacement characters."""
        lengths = self.raw_lengths[ids]
        raw = take_ragged(self.raw, self.raw_starts[ids], lengths)
        at = starts_of(lengths)[bounds]
        begin = at[:-1] + ((np.diff(at) > 0) & (np.append(raw, 0)[at[:-1]] == 32))
        data = raw.tobytes()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), at[1:].tolist())], pa.large_string())


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids`` (array of int) of every row.

    Null and empty texts: no ids. Null and repeated ids: each row is encoded. Empty input: no rows.
    Other columns are ignored.
    """
    python_ready(df.sparkSession)
    slim = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, bounds = coder(model).encode(strings(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("rec_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], names=["rec_id", "ids"])

    return slim.mapInArrow(run, f"rec_id {dict(slim.dtypes)['rec_id']}, ids array<int>").withColumnRenamed("rec_id", id_col)


def decode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and ``text`` of every row; null ids: an empty text."""
    python_ready(df.sparkSession)
    slim = df.select(F.col(id_col).alias("rec_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets).astype(np.int64)
            ids = np.asarray(lists.values)[bounds[0]: bounds[-1]]
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), coder(model).decode(ids, bounds - bounds[0]).cast(pa.string())], names=["rec_id", "text"])

    return slim.mapInArrow(run, f"rec_id {dict(slim.dtypes)['rec_id']}, text string").withColumnRenamed("rec_id", id_col)


def op2_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number and CRC-32 of the ids (little-endian unsigned
    32-bit), digest of the decoded text, and whether it is the text itself."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    python_ready(spark)
    slim = documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        import hashlib

        for batch in batches:
            for part in chunks(batch, "text"):
                texts = strings(part.column("text"))
                ids, bounds = coder(model).encode(texts)
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                back, own = coder(model).decode(ids, bounds).to_pylist(), texts.to_pylist()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([a == b for a, b in zip(back, own)])], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
