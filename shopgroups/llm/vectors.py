"""Approximate nearest neighbours with balanced posting lists.

Centroids come from hierarchical balanced clustering of a sample and are small
enough to hold in memory, with a neighbour graph that a beam search walks for
many vectors at once. Every vector is in the posting list of its nearest
centroid; a boundary vector also in those of other centroids that are nearly as
near. A query
reads the lists whose centroids are within a ratio of its nearest one's
distance. Lists are kept short: equal vectors are one entry, the number of
centroids grows with the table, and long lists are cut into blocks that
different groups read, as are the queries of a list that many read. A matrix
product preselects a block's nearest vectors; scores are exact differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgroups.sources.tables import read_table

from .common import python_ready, stored, unit_hash, work_folder

#: Vectors per list, about; the centroids are as many as that needs, and MAX_LISTS at most. Beyond that
#: the lists grow, in blocks.
LIST_VECTORS, MAX_LISTS = 512, 4_096
#: Sampled vectors per centroid, about: the fit reads MAX_LISTS * SAMPLE_PER_LIST vectors at most.
SAMPLE_PER_LIST = 32
#: Vectors of a block of a list, and about the queries that one group compares with it.
BLOCK, QUERY_BLOCK = 4_096, 2_048
#: Lists that a vector is in, at most, and the distance ratio up to which.
COPIES, COPY_RATIO = 4, 1.15
#: Part of the nearest vectors, in the sample, that the lists within the probe ratio must hold.
TARGET = 0.9
#: Neighbours of a centroid in the graph, and width of the search's beam for queries and for vectors to place.
DEGREE, BEAM, PLACE_BEAM = 24, 64, 16


def balanced_centroids(sample: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """About ``lists`` centroids: a group with more than its share of the sample is split by a
    balanced k-means into up to 16 groups, again and again."""
    rng, share = np.random.default_rng(seed), max(1.0, len(sample) / max(lists, 1))
    todo, out = [np.arange(len(sample))], []
    while todo:
        rows = todo.pop()
        k = min(16, int(np.ceil(len(rows) / share)))
        x = sample[rows]
        if k < 2 or (x == x[0]).all():
            out.append(x.mean(0))
            continue
        centres = x[rng.choice(len(x), k, replace=False)]
        load = np.zeros(k)
        for _ in range(8):
            far = ((x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1))
            # full groups are made farther
            own = (far + load * np.abs(far).mean()).argmin(1)
            size = np.bincount(own, minlength=k)
            load = 0.5 * load + 0.1 * (size / (len(x) / k) - 1)
            for j in np.flatnonzero(size):
                centres[j] = x[own == j].mean(0)
        if np.count_nonzero(size) < 2:
            own = np.arange(len(x)) % k
        todo += [rows[own == j] for j in range(k) if (own == j).any()]
    return np.array(out)


class CentroidGraph:
    """Centroids, the graph of their nearest ones, and a beam search over it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.norms = (centroids ** 2).sum(1)
        n, degree = len(centroids), min(DEGREE, len(centroids) - 1)
        nearest = np.zeros((n, max(degree, 1)), np.int64)
        for a in range(0, n, 1024):
            far = self.norms - 2 * centroids[a: a + 1024] @ centroids.T
            far[np.arange(len(far)), a + np.arange(len(far))] = np.inf
            if degree:
                nearest[a: a + 1024] = np.argpartition(far, degree - 1, 1)[:, :degree] if degree < n - 1 else np.argsort(far, 1)[:, :degree]
        # edges both ways, so that no centroid is without one that leads to it
        source, target = np.repeat(np.arange(n), nearest.shape[1]), nearest.ravel()
        both = np.unique(np.concatenate([source * n + target, target * n + source]))
        source, target = both // n, both % n
        place = np.arange(len(both)) - np.searchsorted(source, source)
        self.edges = np.full((n, int(place.max()) + 1), -1)
        self.edges[source, place] = target
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 64)).astype(np.int64))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) that a beam search finds nearest for each row, nearest first;
        -1 and infinity where there are fewer than ``beam``."""
        rows, n = len(x), len(self.centroids)
        every = np.arange(rows)[:, None]
        seen = np.zeros((rows, n + 1), bool)
        seen[:, n] = True
        square = (x ** 2).sum(1)[:, None]
        start = np.broadcast_to(self.entries, (rows, len(self.entries)))
        seen[every, start] = True
        node = np.full((rows, beam), -1)
        far = np.full((rows, beam), np.inf)
        open_ = np.zeros((rows, beam), bool)

        def take(new: np.ndarray) -> None:
            nonlocal node, far, open_
            d = square + self.norms[new] - 2 * np.einsum("rd,rkd->rk", x, self.centroids[new])
            d = np.where(new < 0, np.inf, np.maximum(d, 0))
            all_node, all_far = np.concatenate([node, new], 1), np.concatenate([far, d], 1)
            all_open = np.concatenate([open_, new >= 0], 1)
            best = np.argsort(all_far, 1, kind="stable")[:, :beam]
            node, far, open_ = all_node[every, best], all_far[every, best], all_open[every, best]

        take(start)
        while open_.any():
            # the nearest three open ones of every row are expanded
            order = np.argsort(~open_, 1, kind="stable")[:, :3]
            chosen = np.where(open_[every, order], node[every, order], -1)
            open_[every, order] = False
            new = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(rows, -1)
            new = np.where(seen[every, new], -1, new)
            new.sort(1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new.sort(1)
            keep = int((new >= 0).sum(1).max(initial=0))
            if not keep:
                continue
            new = new[:, new.shape[1] - keep:]
            seen[every, new] = True
            take(new)
        node[np.isinf(far)] = -1
        return node, far


def lists_of(graph: CentroidGraph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, whether it is the nearest) for all lists of the vectors."""
    node, far = graph.search(x, PLACE_BEAM)
    node, far = node[:, :COPIES], far[:, :COPIES]
    taken = (node >= 0) & (far <= COPY_RATIO ** 2 * far[:, :1])
    taken[:, 0] = True
    row, column = np.nonzero(taken)
    return row, node[row, column], column == 0


def probe_ratio(graph: CentroidGraph, sample: np.ndarray, k: int, queries: int = 256) -> float:
    """The distance ratio up to which lists must be read to find TARGET of the sample's nearest vectors.
    The whole table's nearest ones are nearer still."""
    if len(sample) <= k or len(graph.centroids) == 1:
        return float("inf")
    asked = np.unique(np.linspace(0, len(sample) - 1, queries).astype(np.int64))
    parts = [lists_of(graph, sample[a: a + 1024]) for a in range(0, len(sample), 1024)]
    row = np.concatenate([p[0] + 1024 * i for i, p in enumerate(parts)])
    own = np.concatenate([p[1] for p in parts])
    bounds = np.searchsorted(row, np.arange(len(sample) + 1))
    ratios = []
    for i in asked:
        far = ((sample - sample[i]) ** 2).sum(1)
        far[i] = np.inf
        to = ((graph.centroids - sample[i]) ** 2).sum(1)
        ratios += [to[own[bounds[j]: bounds[j + 1]]].min() / max(to.min(), 1e-300) for j in np.argpartition(far, k)[:k]]
    return float(np.sqrt(np.quantile(ratios, TARGET)))


def probes_of(graph: CentroidGraph, sizes: np.ndarray, x: np.ndarray, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that the queries read: those whose centroids lie within ``ratio`` of the
    nearest one's distance, and the next ones while they hold fewer than k + 1 vectors."""
    beam = BEAM
    while True:  # wider until the farthest one found is beyond the ratio
        node, far = graph.search(x, beam)
        held = np.cumsum(np.where(node >= 0, sizes[node], 0), 1)
        if beam >= len(sizes) or ((far[:, -1] > ratio ** 2 * far[:, 0]) & (held[:, -1] > k)).all():
            break
        beam = min(4 * beam, len(sizes))
    before = np.concatenate([np.zeros((len(x), 1)), held[:, :-1]], 1)
    row, column = np.nonzero((node >= 0) & ((far <= max(ratio, 1.0) ** 2 * far[:, :1]) | (before <= k)))
    return row, node[row, column]


def nearest_of_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple]:
    """(query id, ids, distances) of the k nearest vectors of a block for every query, whose own id is left
    out; ties to the smaller id. ``ids`` holds an array of ids per vector.

    A matrix product gives all squared distances but for rounding. Only vectors that may be among the
    k + 1 nearest within its error bound have theirs computed from differences.
    """
    times = np.array([len(i) for i in ids])
    first, flat = np.cumsum(times) - times, np.concatenate(ids)
    # an id with several vectors counts once, so that k + 1 vectors may hold fewer than k ids
    repeated = len(np.unique(flat)) < len(flat)
    few = min(k, len(x) - 1) if not repeated else len(x) - 1
    norms = (x ** 2).sum(1)
    out = []
    for a in range(0, len(q), 256):
        part = q[a: a + 256]
        own = (part ** 2).sum(1)
        with np.errstate(over="ignore", invalid="ignore"):
            far = own[:, None] + norms - 2 * part @ x.T
            error = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (own + norms.max())
            limit = np.partition(far, few, 1)[:, few] + 2 * error
            beyond = far > limit[:, None]  # where the squares overflow, nothing is beyond
        for i, query in enumerate(query_ids[a: a + 256]):
            near = np.flatnonzero(~beyond[i])
            score = np.repeat(np.sqrt(((x[near] - part[i]) ** 2).sum(1)), times[near])
            own_ids = flat[np.repeat(first[near] - np.cumsum(times[near]) + times[near], times[near]) + np.arange(len(score))]
            other = own_ids != query
            own_ids, score = own_ids[other], score[other]
            best = np.lexsort((own_ids, score))
            if repeated:  # the nearest one of each id
                best = best[np.sort(np.unique(own_ids[best], return_index=True)[1])]
            best = best[:k]
            out.append((query, own_ids[best], score[best]))
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    good = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    usual = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("v") == (usual["n"] if usual else 0))


def nearest_neighbours(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for every row for which
    ``is_query`` (a condition on vec_id) holds, its own id left out; ties to the smaller id.

    Vectors that are null, zero, hold null or non-finite components, or have another length than
    most, take no part; nor do rows with a null id. Of rows that repeat an id the nearest counts.
    Empty input: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    python_ready(spark)
    folder = work_folder(spark, "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    # repeated rows are one, so that they take no places of others
    good = stored(usable(df, id_col, vector_col).distinct(), folder, "usable")
    # equal vectors are one entry with its k + 1 smallest ids, of which a query can use k
    smallest = Window.partitionBy("v").orderBy("vec_id")
    few = good.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.collect_list("vec_id").alias("ids")), folder, "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    lists = max(1, min(MAX_LISTS, -(-n // LIST_VECTORS)))
    rate = min(1.0, lists * SAMPLE_PER_LIST / n)
    # about MAX_LISTS * SAMPLE_PER_LIST vectors at most
    sample = entries.filter(unit_hash("v") < rate).select("v").toPandas()["v"]
    sample = np.stack(sample.to_numpy()) if len(sample) else np.array([entries.first()["v"]])
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(sample, lists)))
    ratio = probe_ratio(graph.value, sample, k)

    def place(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a: a + 1024]
                row, own, first = lists_of(graph.value, np.stack(part["v"].to_numpy()))
                yield pd.DataFrame({"list": own, "first": first, "v": part["v"].to_numpy()[row], "ids": part["ids"].to_numpy()[row]})

    placed = entries.mapInPandas(place, "list long, first boolean, v array<double>, ids array<long>")
    placed = stored(placed, folder, "placed")
    # one row per list
    sizes = np.zeros(len(graph.value.centroids), np.int64)
    blocks = np.ones(len(sizes), np.int64)
    for r in placed.groupBy("list").agg(F.sum(F.when(F.col("first"), F.size("ids")).otherwise(0)).alias("s"), F.count("*").alias("c")).collect():
        sizes[r["list"]], blocks[r["list"]] = r["s"], -(-r["c"] // BLOCK)
    shape = spark.sparkContext.broadcast(sizes)

    def probe(batches):
        for pdf in batches:
            for a in range(0, len(pdf), 512):
                part = pdf.iloc[a: a + 512]
                row, own = probes_of(graph.value, shape.value, np.stack(part["v"].to_numpy()), k, ratio)
                cuts = np.searchsorted(row, np.arange(1, len(part)))
                yield pd.DataFrame({"query_id": part["vec_id"].to_numpy(), "q": part["v"].to_numpy(), "lists": np.split(own, cuts)})

    # one row per query, so that its vector is written once
    asked = good.filter(is_query(F.col("vec_id"))).mapInPandas(probe, "query_id long, q array<double>, lists array<long>")
    asked = stored(asked, folder, "asked")
    parts = np.ones(len(sizes), np.int64)
    for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        parts[r["list"]] = -(-r["count"] // QUERY_BLOCK)
    # one row per list again
    per_list = F.broadcast(spark.createDataFrame(pd.DataFrame({"list": np.arange(len(blocks)), "blocks": blocks, "parts": parts})))
    asked = (asked.select("query_id", "q", F.explode("lists").alias("list")).join(per_list, "list")
             .select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                     F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"), "query_id", "q"))
    held = (placed.join(per_list, "list")
            .select("list", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block"),
                    F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v", "ids"))

    def nearest(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            x, q = np.stack(vectors["v"].to_numpy()), np.stack(queries["q"].to_numpy())
            out = nearest_of_block(x, vectors["ids"].to_numpy(), q, queries["query_id"].to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_ids", "scores"])

    keys = ["list", "block", "part"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_ids array<long>, scores array<double>")
    found = found.select("query_id", F.explode(F.arrays_zip(F.col("vec_ids").alias("i"), F.col("scores").alias("s"))).alias("f"))
    found = found.select("query_id", F.col("f.i").alias("vec_id"), F.col("f.s").alias("score")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vectors(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth of ``embeddings``."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
