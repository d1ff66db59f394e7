"""Best-fit packing of tokenised documents into sequences.

Documents are encoded inside Arrow tasks and cut into pieces only where they
are longer than a sequence. The pieces' slim rows are written once, dealt
evenly to groups by a hash of their row number, and each group is packed
best-fit decreasing: a segment tree over remaining capacities finds the
tightest open bin for a piece in logarithmic time. A group has about
``GROUP_PIECES`` pieces at every input size, so a task's memory is bounded and
the groups' last bins are a vanishing part of all bins.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, python_ready, stored, work_folder
from .ragged import chunks, strings
from .wordbpe import WordBpe

#: Pieces of a group, full ones not counted.
GROUP_PIECES = 50_000
#: The id after every document.
END_ID = 0


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds with ``end_id`` after every document."""
    sizes = np.diff(bounds)
    new = bounds + np.arange(len(bounds))
    out = np.full(int(new[-1]), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, new


def cut(bounds: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in the document, length) of all pieces of at most ``capacity`` ids."""
    sizes = np.diff(bounds)
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
    return doc, start, np.minimum(sizes[doc] - start, capacity)


def pieces_of(df: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 and, if asked for, the ids.

    Null text: empty, a piece of the end id alone. Null and repeated ids: each row is a
    document. Empty input: no rows. Other columns are ignored.
    """
    python_ready(df.sparkSession)
    slim = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(slim.dtypes)["rec_id"]
    schema = f"rec_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def encode(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, bounds = with_end(*encoder(tokenizer).encode(strings(part.column("text"))), end_id)
                doc, start, length = cut(bounds, capacity)
                at = bounds[doc] + start
                raw = memoryview(ids.astype("<u4").view(np.uint8))
                crc = [zlib.crc32(raw[4 * a: 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                columns = [part.column("rec_id").take(pa.array(doc)), pa.array((start // capacity).astype(np.int32)),
                           pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return slim.mapInArrow(encode, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, best-fit decreasing; ``sizes`` from 1 to ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << capacity.bit_length()
    #: tree[i]: some open bin has a remaining capacity below node i; leaf c is at leaves + c
    tree = bytearray(2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n_bins = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    for i in order.tolist():
        size = int(sizes[i])
        node = leaves + size
        if not tree[node]:  # climb to the next subtree on the right that has a bin, then down its left edge
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            left = node - leaves
            chosen = open_bins[left].pop()
            if not open_bins[left]:
                while node and tree[node] and not (node < leaves and (tree[2 * node] or tree[2 * node + 1])):
                    tree[node] = 0
                    node >>= 1
        else:
            left, chosen, n_bins = capacity, n_bins, n_bins + 1
        bins[i], offsets[i] = chosen, capacity - left
        left -= size
        if left:
            open_bins[left].append(chosen)
            node = leaves + left
            while node and not tree[node]:
                tree[node] = 1
                node >>= 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, folder: str, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with a column ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Sequences hold at most ``capacity`` ids; offsets are gapless from 0 in each. Empty input: no rows.
    """
    python_ready(pieces.sparkSession)
    numbered = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), folder, "pieces")
    partial = numbered.filter(F.col("length") < capacity).count()
    groups = max(1, -(-partial // group_pieces))
    # a full piece is a sequence by itself; its ids lie below 0, out of the groups' way
    full = numbered.filter(F.col("length") == capacity).select(
        *pieces.columns, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = (numbered.filter(F.col("length") < capacity)
            .withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
            .select("_group", "_row", "length"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"_row": pdf["_row"], "sequence_id": (pdf["_group"].to_numpy() << 32) + bins, "offset": offsets})

    placed = rest.groupBy("_group").applyInPandas(fill, "_row long, sequence_id long, offset long")
    packed = numbered.filter(F.col("length") < capacity).join(placed, "_row").select(*pieces.columns, "sequence_id", "offset")
    return full.unionByName(packed)


def pack_documents(df: DataFrame, capacity: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Encode, cut and pack all texts; see ``pieces_of`` and ``pack``."""
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = pieces_of(df, tokenizer, capacity, id_col, text_col, keep_ids=keep_ids)
    packed = pack(pieces, capacity, work_folder(df.sparkSession, "packing"), group_pieces)
    return packed.withColumnRenamed("rec_id", id_col)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack_documents(documents(spark, sf_dir))
