"""NumPy and Arrow helpers for texts as ragged arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task works on at a time; one longer text is worked on alone.
CHUNK_BYTES = 3 << 20


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def take_ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s:s + n]`` for all (s, n)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts - (ends - lengths), lengths)
    index += np.arange(total, dtype=index.dtype)
    return flat[index]


def sums_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``; 0 for empty slices."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about CHUNK_BYTES of text each."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(size)
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def strings(column) -> pa.Array:
    """The column as 64-bit string array, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, bounds of each text); the bytes are a view, not to be written to."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[bounds[0]: bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WEIGHTS = mix(np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def span_hashes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans (none empty): sums of bytes with random weights by place, scrambled."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = starts_of(lengths)[:-1]
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    longest = int(lengths.max())
    weights = WEIGHTS if longest < len(WEIGHTS) else mix(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    products = weights[place]
    place += np.repeat(starts, lengths)
    products *= flat[place].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(products, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs_of(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of True."""
    edge = np.flatnonzero(np.diff(kind.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2] - edge[::2]


#: Bytes of white space: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def words_of(flat: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, bounds of each text's words) of the words between white space; texts are apart too."""
    inside = ~space[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(flat)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    upto = np.append(starts[1:], len(flat))
    # the word ends at the first white space or text end after its start
    stops = np.flatnonzero(np.append(~inside, True))
    ends = stops[np.searchsorted(stops, starts)]
    ends = np.minimum(ends, upto)
    text_end = bounds[np.searchsorted(bounds, starts, "right")]
    return starts, np.minimum(ends, text_end) - starts, np.searchsorted(starts, bounds)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each hash, distinct hashes in order of appearance, place of each one's first appearance)."""
    coded = pa.array(hashes).dictionary_encode()
    numbers = np.asarray(coded.indices)
    first = np.zeros(len(coded.dictionary), np.int64)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    return numbers, np.asarray(coded.dictionary), first
