"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs (lines, long ones at content-defined places, so
that an edit moves few cuts). Each paragraph's 48-bit digest with a 16-bit
checksum is a key; the n-th repetition of a paragraph has a key of its own. A
sketch has three tables of cells; a key is counted and XORed into one cell of
each. The sketches of two versions are subtracted cell by cell, which cancels
what they share; peeling takes keys from cells that hold a single one until
nothing is left, and so recovers the digests that differ. Where it gets stuck,
both versions are sketched again four times larger, until it succeeds or a sketch
would be larger than the keys themselves, which then are compared one by one. All
texts of a chunk are sketched and peeled together in NumPy.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import documents, python_ready, stored, text_or_empty, work_folder
from .ragged import CHUNK_BYTES, mix, span_hashes, text_bytes

#: Cells of each of the three tables of a stored fingerprint, and of the first attempt.
CELLS = 4
#: Bytes of a paragraph's piece, about.
PIECE_BYTES = 32
LARGER = 4
CHECK = np.uint64(0xFFFF)


def paragraph_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all texts' paragraphs, bounds of each text's keys); empty texts have none."""
    flat, bounds = text_bytes(texts)
    begins = np.zeros(len(flat), bool)
    if len(flat) > 8:
        window = flat[:-8].astype(np.uint64)
        for j in range(1, 8):
            window = (window << np.uint64(8)) | flat[j:len(flat) - 8 + j]
        begins[8:] = mix(window) % np.uint64(PIECE_BYTES) == 0
    if len(flat):
        begins[1:] |= flat[:-1] == 10
        begins[bounds[:-1][bounds[:-1] < len(flat)]] = True
    # a cut that depends on the text before its own eight bytes is no cut
    at = np.flatnonzero(begins)
    own = np.searchsorted(bounds, at, "right") - 1
    near = (at - bounds[own] < 8) & (at != bounds[own]) & (flat[at - 1] != 10)
    at, own = at[~near], own[~near]
    # repeats are told by what a key keeps of the digest: equal ones would cancel
    digest = span_hashes(flat, at, np.diff(np.append(at, len(flat)))) & ~CHECK
    order = np.lexsort((digest, own))
    same = np.zeros(len(at), bool)
    same[1:] = (digest[order][1:] == digest[order][:-1]) & (own[order][1:] == own[order][:-1])
    place = np.arange(len(at))
    repeat = np.zeros(len(at), np.int64)
    repeat[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    digest = np.where(repeat > 0, mix(digest + repeat.astype(np.uint64)), digest)
    return checked(digest), np.searchsorted(own, np.arange(len(bounds)))


def checked(digest: np.ndarray) -> np.ndarray:
    """48 bits of the digests with 16 bits that check them."""
    high = digest & ~CHECK
    return high | (mix(high) & CHECK)


def cells_of(keys: np.ndarray, size: int) -> np.ndarray:
    """The three cells (columns) of each key in a sketch of 3 * size cells."""
    return np.stack([mix(keys + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size) + np.uint64(j * size) for j in range(3)], 1).astype(np.int64)


def sketches(keys: np.ndarray, owner: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, XORs) of the n owners' sketches, one after another."""
    at = (cells_of(keys, size) + owner[:, None] * (3 * size)).ravel()
    xors = np.zeros(n * 3 * size, np.uint64)
    np.bitwise_xor.at(xors, at, np.repeat(keys, 3))
    return np.bincount(at, minlength=len(xors)).astype(np.int32), xors


def peel(counts: np.ndarray, xors: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, +1 or -1 of every recovered key, whether each owner's sketch came out empty)."""
    cells = 3 * size
    out = []
    at = np.arange(len(counts))
    while True:
        at = at[np.abs(counts[at]) == 1]
        at = at[checked(xors[at]) == xors[at]]
        key, owner = xors[at], at // cells
        at_own = at - owner * cells
        pure = (cells_of(key, size) == at_own[:, None]).any(1)
        key, owner, sign = key[pure], owner[pure], counts[at[pure]]
        if not len(key):
            break
        order = np.lexsort((key, owner))
        key, owner, sign = key[order], owner[order], sign[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        key, owner, sign = key[new], owner[new], sign[new]
        out.append((owner, key, sign))
        at = (cells_of(key, size) + owner[:, None] * cells).ravel()
        np.subtract.at(counts, at, np.repeat(sign, 3))
        np.bitwise_xor.at(xors, at, np.repeat(key, 3))
        at = np.unique(at)
        if len(out) > 4 * size + 64:  # wrongly taken keys can go in circles
            break
    left = ((counts != 0) | (xors != 0)).reshape(n, cells).any(1)
    owner, key, sign = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return owner, key, sign, ~left


def differences(old: np.ndarray, old_bounds: np.ndarray, new: np.ndarray, new_bounds: np.ndarray, size: int = CELLS):
    """(owner, key, +1 if only the old version has it, -1 if only the new one) for all pairs of versions."""
    n = len(old_bounds) - 1
    todo, out = np.arange(n), []
    held = np.diff(old_bounds) + np.diff(new_bounds)
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        # sketches far larger than the keys fail only on keys that are in one text more than once
        beyond = todo[held[todo] * LARGER < size - CELLS]
        if len(beyond):
            out.append(compared(old, old_bounds, new, new_bounds, beyond))
            todo = todo[held[todo] * LARGER >= size - CELLS]
            continue
        parts = []
        for keys, bounds in ((old, old_bounds), (new, new_bounds)):
            owner = place[np.repeat(np.arange(n), np.diff(bounds))]
            parts.append(sketches(keys[owner >= 0], owner[owner >= 0], len(todo), size))
        owner, key, sign, done = peel(parts[0][0] - parts[1][0], parts[0][1] ^ parts[1][1], len(todo), size)
        keep = done[owner]
        out.append((todo[owner[keep]], key[keep], sign[keep]))
        todo, size = todo[~done], size * LARGER
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))


def compared(old: np.ndarray, old_bounds: np.ndarray, new: np.ndarray, new_bounds: np.ndarray, which: np.ndarray):
    """As ``differences`` for the pairs ``which``, by sorting their keys; a key that one text has n times more is there n times."""
    out = []
    for i in which.tolist():
        keys = np.concatenate([old[old_bounds[i]: old_bounds[i + 1]], new[new_bounds[i]: new_bounds[i + 1]]])
        signs = np.repeat([1, -1], [old_bounds[i + 1] - old_bounds[i], new_bounds[i + 1] - new_bounds[i]])
        found, own = np.unique(keys, return_inverse=True)
        more = np.bincount(own, signs, len(found)).astype(np.int64)
        times = np.abs(more)
        out.append((np.full(int(times.sum()), i), np.repeat(found, times), np.repeat(np.sign(more), times).astype(np.int32)))
    return tuple(np.concatenate(c) for c in zip(*out))


def likeness(old_bounds: np.ndarray, new_bounds: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Part of both versions' paragraphs that the versions share; 1 for two empty versions."""
    both = np.diff(old_bounds) + np.diff(new_bounds)
    differ = np.bincount(owner, minlength=len(both))
    return np.where(both > 0, (both - differ) / np.maximum(both, 1), 1.0)


def written(keys: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The fingerprints: base64 of the cells' counts (16 bits) and XORs of a sketch with 3 * CELLS cells."""
    n = len(bounds) - 1
    counts, xors = sketches(keys, np.repeat(np.arange(n), np.diff(bounds)), n, CELLS)
    cells = np.zeros((n, 3 * CELLS), [("count", "<u2"), ("xor", "<u8")])
    cells["count"], cells["xor"] = counts.reshape(n, -1), xors.reshape(n, -1)
    return [base64.b64encode(c.tobytes()).decode() for c in cells]


def compare_versions(df: DataFrame, id_col: str, old_col: str, new_col: str) -> DataFrame:
    """id_col, the fingerprints of both texts, likeness, and the digests of the paragraphs that only
    the old or only the new text has (``removed``, ``added``), for every row.

    Null text: empty. Two empty texts are alike (1.0). Null and repeated ids: each row is compared.
    Empty input: no rows. Other columns are ignored.
    """
    python_ready(df.sparkSession)
    slim = df.select(F.col(id_col).alias("rec_id"), text_or_empty(old_col).alias("old"), text_or_empty(new_col).alias("new"))
    names = ["rec_id", "old_fingerprint", "new_fingerprint", "likeness", "removed", "added"]

    def run(batches):
        for batch in batches:
            (a, ab), (b, bb) = (paragraph_keys(batch.column(c).cast(pa.large_string())) for c in ("old", "new"))
            owner, key, sign = differences(a, ab, b, bb)
            lists = []
            for s in (1, -1):
                chosen = np.flatnonzero(sign == s)
                chosen = chosen[np.lexsort((key[chosen], owner[chosen]))]
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[chosen], np.arange(len(ab))).astype(np.int32)), pa.array(key[chosen].view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), pa.array(written(a, ab)), pa.array(written(b, bb)), pa.array(likeness(ab, bb, owner)), *lists], names=names)

    schema = f"rec_id {dict(slim.dtypes)['rec_id']}, old_fingerprint string, new_fingerprint string, likeness double, removed array<long>, added array<long>"
    return slim.mapInArrow(run, schema).withColumnRenamed("rec_id", id_col)


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def pair_results(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of RESULT for texts and the ones that follow them."""
    tail = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - k] + f[:k] for t, f, k in zip(texts, following, tail)]
    (a, ab), (e, eb), (f, fb) = (paragraph_keys(pa.array(x, pa.large_string())) for x in (texts, edited, following))
    near = [likeness(ab, b, differences(a, ab, k, b)[0]) for k, b in ((e, eb), (f, fb))]
    return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(written(a, ab)), pa.array(written(e, eb)), *map(pa.array, near)]


def chain_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter gives way to as much of
    the next text's begin; next by ascending id, the first after the last.

    Null text: empty. Rows of one id are put in order by a hash of their texts; null ids come first.
    A single row is its own next one. Empty input: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    python_ready(spark)
    folder = work_folder(spark, "versions")
    texts = df.select(F.col(id_col).alias("rec_id"), text_or_empty(text_col).alias("text")).withColumn("digest", F.xxhash64("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    # slim rows in ranges of ids; each range's first key, one per range, splits the texts alike
    slim = stored(texts.select("rec_id", "digest"), folder, "ids")
    key = F.struct("rec_id", "digest")
    firsts = slim.repartitionByRange(n, "rec_id", "digest").groupBy(F.spark_partition_id()).agg(F.min(key).alias("k"))
    firsts = stored(firsts.agg(F.array_sort(F.collect_list("k")).alias("firsts")), folder, "firsts")
    ranges = F.size("firsts")
    steps = F.lit([1 << b for b in reversed(range(n.bit_length()))])
    number = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(
        (lo + s < ranges) & (F.get("firsts", lo + s) <= key), lo + s).otherwise(lo))
    # the first text of a range is also a guest at the end of the range before it
    own = texts.crossJoin(F.broadcast(firsts)).withColumn("range", number)
    place = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("range") - 1, ranges).alias("range"), F.lit(True).alias("guest"))
    dealt = own.select("rec_id", "digest", "text", F.explode(F.when(
        F.get("firsts", F.col("range")) == key, F.array(place, guest)).otherwise(F.array(place))).alias("p")).select("p.*", "rec_id", "digest", "text")
    ordered = dealt.repartition(n, "range").sortWithinPartitions("range", "guest", "rec_id", "digest").select("range", "guest", "rec_id", "text")
    id_type = dict(texts.dtypes)["rec_id"]
    names = ["rec_id", *(c.split()[0] for c in RESULT.split(", "))]

    def run(batches):
        at, ids, held, size = None, [], [], 0  # of the range that is read, the texts that wait for the next one
        for batch in batches:
            for number, is_guest, rec_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "rec_id", "text"))):
                if number != at:
                    at, ids, held, size = number, [], [], 0
                elif not ids and is_guest:  # equal guests; the first closed the range
                    continue
                ids.append(rec_id)
                held.append(text)
                size += len(text)
                if is_guest or size > CHUNK_BYTES and len(held) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], arrow_type), *pair_results(held[:-1], held[1:])], names=names)
                    ids, held, size = ([], [], 0) if is_guest else (ids[-1:], held[-1:], len(held[-1]))

    arrow_type = to_arrow_type(texts.schema["rec_id"].dataType)
    return ordered.mapInArrow(run, f"rec_id {id_type}, {RESULT}").withColumnRenamed("rec_id", id_col)


def op1_versions(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return chain_versions(documents(spark, sf_dir))
