"""Compression of vectors to codes, with Orchard's search for the nearest entry.

Vectors are cut into parts, and every part position has a small codebook. For
each entry of a codebook the other entries are listed by distance. The search
for a part starts at some entry and walks the list of the nearest entry found so
far: an entry that is nearer makes it jump to that entry's list, visited entries
are marked, and beyond twice the distance to the part no entry of the list can
be as near, by the triangle inequality. All rows of an Arrow batch walk
together, each with its own place.

The codebooks are refined in rounds: every task adds up its parts by entry, and
the sums of all tasks, one row per entry and component, give the next codebook.
All numbers are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgroups.sources.tables import read_table

from .common import python_ready, stored, work_folder

#: Parts of a vector, entries of a part's codebook (256 at most: two hex digits), and rounds.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Units of a component.
SCALE = 256
#: Labels with at least this part of all rows are joined by a broadcast, so that there are at most as many.
HOT_LABELS = 1_000


def integer_vectors(df: DataFrame, vector_col: str, scale: int, *others) -> DataFrame:
    """``others`` and z, floor(scale * component), of the rows whose vector has no null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(good).select(*others, F.transform(v, lambda c: F.floor(c * float(scale))).alias("z"))


def shape(vectors: DataFrame, times: int = 1) -> tuple[int, int, int]:
    """(rows, longest vector, largest absolute component); an error if ``times`` the sum of a vector's squares may need more than 62 bits."""
    size = F.array_max(F.transform("z", lambda c: F.abs(c.cast("decimal(20,0)"))))
    row = vectors.agg(F.count("*").alias("n"), F.max(F.size("z")).alias("width"), F.max(size).alias("top")).first()
    width, top = max(1, row["width"] or 0), int(row["top"] or 0)
    if times * width * top * top >= 1 << 62:
        raise ValueError(f"vectors of {width} components of up to {top} units need more than 64 bits")
    return row["n"], width, top


def matrix(column, width: int) -> np.ndarray:
    """Rows of an Arrow list column as integers, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Orchard:
    """A codebook with its entries' neighbour lists."""

    def __init__(self, book: np.ndarray):
        self.book, n = book, len(book)
        far = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        np.fill_diagonal(far, -1)
        order = np.argsort(far, axis=1, kind="stable")[:, 1:]
        # a last place that no search goes beyond
        self.lists = np.concatenate([order, np.zeros((n, 1), np.int64)], axis=1)
        self.gaps = np.concatenate([np.take_along_axis(far, order, axis=1), np.full((n, 1), np.iinfo(np.int64).max)], axis=1)
        # where searches start: the entry nearest to a corner, by the signs of up to four components
        self.signs = min(4, book.shape[1])
        self.middle = book.mean(axis=0)
        corners = np.tile(self.middle, (1 << self.signs, 1))
        bits = (np.arange(1 << self.signs)[:, None] >> np.arange(self.signs)) & 1
        corners[:, :self.signs] += np.where(bits, 1, -1) * book.std(axis=0)[:self.signs]
        self.starts = ((corners[:, None, :] - book[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest entry, squared distance) of every row, of equally near entries the first, and how many distances that took."""
        book, rows = self.book, len(x)
        corner = ((x[:, :self.signs] > self.middle[:self.signs]) << np.arange(self.signs)).sum(axis=1)
        at = self.starts[corner]
        near = ((x - book[at]) ** 2).sum(axis=1)
        seen = np.zeros((rows, len(book)), bool)
        seen[np.arange(rows), at] = True
        # what walks: row, entry whose list it reads, place in it, distance to the entry
        row, place, taken = np.arange(rows), np.zeros(rows, np.int64), rows
        while len(row):
            entry, far = at[row], near[row]
            on = self.gaps[entry, place] <= 4 * far
            row, entry, place, far = row[on], entry[on], place[on], far[on]
            other = self.lists[entry, place]
            place = place + 1
            new = np.flatnonzero(~seen[row, other])
            r, o = row[new], other[new]
            seen[r, o] = True
            taken += len(r)
            d = ((x[r] - book[o]) ** 2).sum(axis=1)
            nearer = (d < far[new]) | ((d == far[new]) & (o < entry[new]))
            at[r[nearer]], near[r[nearer]] = o[nearer], d[nearer]
            place[new[nearer]] = 0
        return at, near, taken


def refined(books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The next codebooks: floored means of the parts of each entry; entries without parts stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def compress_vectors(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE, others=()) -> tuple[DataFrame, np.ndarray]:
    """(id, ``others``, code, error) of every row that takes part, and the codebooks (part, entry, component).

    ``code`` has two hex digits per part, ``error`` is the sum of the squared distances. A codebook starts as
    that part of the rows with the smallest ids; rows of one id come by their vector, null ids last.

    Rows whose vector is null or holds a null or non-finite component take no part; repeated rows are rows of
    their own. Vectors shorter than the longest one, or than a multiple of ``parts``, are filled up with zeros.
    Fewer rows than entries make a smaller codebook; empty table: no rows, empty codebooks. Vectors whose
    squared distances do not fit 64 bits are an error. Other columns are ignored.
    """
    spark = df.sparkSession
    python_ready(spark)
    wanted = [id_col, *others]
    names = [f"c{i}" for i in range(len(wanted))]
    kept = integer_vectors(df, vector_col, scale, *[F.col(c).alias(n) for c, n in zip(wanted, names)])
    kept = stored(kept, work_folder(spark, "codes"), "kept")
    n, longest, _ = shape(kept, 16)  # four times the squares of differences
    schema = ", ".join(f"`{c}` {kept.schema[n].dataType.simpleString()}" for c, n in zip(wanted, names)) + ", code string, error long"
    if not n:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 1), np.int64)
    width = -(-longest // parts)
    first = kept.orderBy(F.col(names[0]).asc_nulls_last(), "z").limit(entries).select("z").toArrow()  # a codebook
    books = matrix(first["z"], parts * width).reshape(-1, parts, width).transpose(1, 0, 2)

    def searched(batch, trees):
        x = matrix(batch.column("z"), parts * width).reshape(-1, parts, width)
        return x, [tree.search(x[:, p]) for p, tree in enumerate(trees)]

    for _ in range(rounds):
        def add_up(batches, books=books):
            trees = [Orchard(b) for b in books]
            counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                x, found = searched(batch, trees)
                for p, (at, _, _) in enumerate(found):
                    order = np.argsort(at, kind="stable")
                    own, begin = np.unique(at[order], return_index=True)
                    if len(own):
                        counts[p, own] += np.diff(np.append(begin, len(at)))
                        sums[p, own] += np.add.reduceat(x[order, p], begin, axis=0)
            # entry numbers over all parts; component -1 has the count
            slot, component = np.nonzero(np.concatenate([counts.reshape(-1, 1), sums.reshape(-1, books.shape[2])], axis=1))
            values = np.concatenate([counts.reshape(-1, 1), sums.reshape(-1, books.shape[2])], axis=1)[slot, component]
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(component - 1), pa.array(values)], ["slot", "component", "value"])

        partial = kept.select("z").mapInArrow(add_up, "slot long, component long, value long")
        total = partial.groupBy("slot", "component").agg(F.sum("value").alias("value")).toArrow()  # a codebook and its counts
        table = np.zeros((books.shape[0] * books.shape[1], width + 1), np.int64)
        table[total["slot"].to_numpy(), total["component"].to_numpy() + 1] = total["value"].to_numpy()
        books = refined(books, table[:, 0].reshape(books.shape[:2]), table[:, 1:].reshape(books.shape))

    def encode(batches):
        trees = [Orchard(b) for b in books]
        for batch in batches:
            _, found = searched(batch, trees)
            digits = np.column_stack([at for at, _, _ in found]).astype(np.uint8).tobytes().hex()
            error = sum(near for _, near, _ in found)
            codes = [digits[i: i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(codes, pa.string()), pa.array(error, pa.int64())],
                                             [*wanted, "code", "error"])

    return kept.mapInArrow(encode, schema), books


def with_group_total(df: DataFrame, group_col: str, value_col: str, total_col: str) -> DataFrame:
    """``df`` with the sum of a column over the rows with an equal value of ``group_col``, nulls together.

    Groups that hold a thousandth of all rows or more, at most a thousand, are joined by a broadcast,
    so that no task gets a large group; the others by a shuffle. ``df`` is read several times.
    """
    sums = df.groupBy(F.col(group_col).alias("_group")).agg(F.sum(value_col).alias(total_col), F.count("*").alias("_rows"))
    limit = max(1, df.count() / HOT_LABELS)
    hot = F.broadcast(sums.filter(F.col("_rows") >= limit).drop("_rows"))
    cold = sums.filter(F.col("_rows") < limit).drop("_rows")
    same = F.col(group_col).eqNullSafe(F.col("_group"))
    return df.join(hot, same).unionByName(df.join(hot, same, "left_anti").join(cold, same)).select(*df.columns, total_col)


def op13_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all ``embeddings``, their errors, the errors of their labels, and the codebooks' hash."""
    codes, books = compress_vectors(read_table(spark, sf_dir, "embeddings"), others=["label"])
    codes = stored(codes, work_folder(spark, "codes"), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = with_group_total(codes, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
