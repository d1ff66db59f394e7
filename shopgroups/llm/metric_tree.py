"""Exact search for the largest inner products with M-trees.

One more component makes all vectors equally long, so that the largest inner
product is the smallest Euclidean distance. Vectors are dealt out to trees by
their nearest pivot; a tree is a table of pages. A page has a routing vector, a
radius that covers all below it, and the distance to the routing vector of its
parent; a leaf has its vectors by their distances to its routing vector.

A search is best-first: the open page with the least lower bound is read next.
Before a distance to something in a page is computed, the stored distance to the
page's routing vector and the triangle inequality tell whether it can matter.
All queries of a block search a tree together, and those that read the same page
share a matrix product. A first round reads only the tree of a query's nearest
pivot; its k-th best product then rules out trees. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgroups.sources.tables import read_table

from .common import python_ready, stored, unit_hash, work_folder
from .orchard import integer_vectors, shape

#: Units of a component in the query.
SCALE = 1024
#: Vectors of a tree, about, and trees by pivots, at most; beyond that a pivot has several trees.
TREE_VECTORS, MAX_PIVOTS = 8_192, 2_048
#: Vectors that pivots are drawn from, per pivot.
SAMPLE_PER_PIVOT = 8
#: Vectors of a leaf and children of a page, at most.
PAGE, FAN = 128, 16
#: Queries of a block, and those that search together.
QUERY_BLOCK, TOGETHER = 8_192, 512

_FEW = -(1 << 62)


class Space:
    """Integer vectors of one width, and their distances once all are made equally long."""

    def __init__(self, width: int, top: int, norm: int):
        self.width, self.norm = width, norm
        self.kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
        # sums of doubles are exact below 2**53
        self.number = np.float64 if width * top * top < 1 << 53 else np.int64
        #: more than rounding moves a distance by
        self.slack = 1e-6 * (float(norm) ** 0.5 + 1.0)

    def pack(self, x: np.ndarray) -> bytes:
        return np.ascontiguousarray(x, self.kind).tobytes()

    def rows(self, data) -> np.ndarray:
        """Packed vectors as a matrix of exact numbers."""
        return np.frombuffer(data if isinstance(data, bytes) else b"".join(data), self.kind).astype(self.number).reshape(-1, self.width)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The vectors with the component that makes them equally long."""
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.norm - (x ** 2).sum(axis=1), 0.0))])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors."""
        return np.sqrt(np.maximum(2.0 * self.norm - 2.0 * a @ b.T, 0.0))

    def from_queries(self, q: np.ndarray, lifted: np.ndarray) -> np.ndarray:
        """Distances of queries, whose further component is 0, to lifted vectors."""
        q = q.astype(np.float64)
        return np.sqrt(np.maximum((q ** 2).sum(axis=1)[:, None] + self.norm - 2.0 * q @ lifted[:, :-1].T, 0.0))

    def reach(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance of a vector with that inner product; infinite where there is none yet."""
        q = q.astype(np.float64)
        with np.errstate(invalid="ignore"):
            far = np.sqrt(np.maximum((q ** 2).sum(axis=1) + self.norm - 2.0 * scores.astype(np.float64), 0.0))
        return np.where(scores <= _FEW, np.inf, far)


def padded(vectors, width: int) -> np.ndarray:
    """Integer lists as a matrix, shorter ones filled up with zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def build_pages(space: Space, x: np.ndarray, ids: list, pivot: np.ndarray) -> list[dict]:
    """The pages of a tree over the vectors ``x``, each with its list of ids; the root's routing vector is ``pivot``."""
    up, pages = space.lifted(x), []
    todo = [(np.arange(len(x)), pivot, space.lifted(pivot[None]), -1, 0.0)]
    while todo:
        rows, centre, lifted, parent, to_parent = todo.pop()
        far = space.between(up[rows], lifted)[:, 0]
        page = {"page": len(pages), "parent": parent, "leaf": len(rows) <= PAGE, "centre": space.pack(centre), "radius": float(far.max(initial=0.0)),
                "to_parent": to_parent, "far": b"", "vectors": b"", "sizes": b"", "ids": b""}
        pages.append(page)
        if page["leaf"]:
            order = np.argsort(far, kind="stable")
            own = [ids[i] for i in rows[order]]
            page.update(far=far[order].tobytes(), vectors=space.pack(x[rows[order]]), sizes=np.array([len(i) for i in own], np.int32).tobytes(),
                        ids=np.concatenate([np.asarray(i, np.int64) for i in own] or [np.zeros(0, np.int64)]).tobytes())
            continue
        # routing vectors spread over the rows, each row to its nearest
        chosen = rows[np.unique(np.linspace(0, len(rows) - 1, min(FAN, -(-len(rows) // (PAGE // 2)))).astype(np.int64))]
        own = space.between(up[rows], up[chosen]).argmin(axis=1)
        if (own == own[0]).all():  # all at one place but for rounding
            own = np.arange(len(rows)) % len(chosen)
        for j, c in enumerate(chosen):
            if (own == j).any():
                todo.append((rows[own == j], x[c], up[c][None], page["page"], float(space.between(up[c][None], lifted)[0, 0])))
    return pages


class Tree:
    """Pages read back, for searches."""

    def __init__(self, space: Space, pages: pd.DataFrame):
        pages = pages.sort_values("page").reset_index(drop=True)
        self.space, self.leaf = space, pages["leaf"].to_numpy(bool)
        self.centres = space.lifted(space.rows(list(pages["centre"])))
        self.radius, self.to_parent = pages["radius"].to_numpy(float), pages["to_parent"].to_numpy(float)
        self.children = [np.zeros(0, np.int64)] * len(pages)
        for parent, rows in pages.groupby("parent").groups.items():
            if parent >= 0:
                self.children[int(parent)] = np.asarray(rows, np.int64)
        self.far = [np.frombuffer(b, np.float64) for b in pages["far"]]
        self.vectors = [space.rows(b) for b in pages["vectors"]]
        self.sizes = [np.frombuffer(b, np.int32).astype(np.int64) for b in pages["sizes"]]
        self.ids = [np.frombuffer(b, np.int64) for b in pages["ids"]]

    def search(self, q: np.ndarray, own: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores, ids) of the k best for every query, best first, and how many products that took; what scores
        below ``cut`` may be missing. ``own`` are ids to leave out."""
        space, n, pages = self.space, len(q), len(self.leaf)
        scores, ids, cut, taken = np.full((n, k), _FEW, np.int64), np.full((n, k), -1, np.int64), cut.astype(np.int64).copy(), 0
        far = np.full((n, pages), np.inf)
        bound = np.full((n, pages), np.inf)  # of open pages
        far[:, 0] = space.from_queries(q, self.centres[:1])[:, 0]
        bound[:, 0] = far[:, 0] - self.radius[0]
        width = 1
        while True:
            reach = space.reach(q, cut) + 4 * space.slack
            best = np.argsort(bound, axis=1, kind="stable")[:, :width]
            within = np.take_along_axis(bound, best, axis=1) <= reach[:, None]
            within &= np.isfinite(np.take_along_axis(bound, best, axis=1))
            row, place = np.nonzero(within)
            if not len(row):
                return scores, ids, taken
            page = best[row, place]
            bound[row, page] = np.inf
            order = np.argsort(page, kind="stable")
            row, page = row[order], page[order]
            hits = []
            starts = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
            for a, b in zip(starts, np.append(starts[1:], len(page))):
                p, asked = page[a], row[a:b]
                if self.leaf[p]:
                    # only vectors whose stored distance is near the queries' distances
                    low = np.searchsorted(self.far[p], (far[asked, p] - reach[asked]).min(), "left")
                    high = np.searchsorted(self.far[p], (far[asked, p] + reach[asked]).max(), "right")
                    if low < high:
                        found = q[asked] @ self.vectors[p][low:high].T
                        taken += found.size
                        i, j = np.nonzero(found >= cut[asked][:, None])
                        hits.append((asked[i], found[i, j], p, j + low))
                else:
                    inside = self.children[p]
                    near = np.abs(far[asked, p][:, None] - self.to_parent[inside]) - self.radius[inside] <= reach[asked][:, None]
                    inside, near = inside[near.any(axis=0)], near[:, near.any(axis=0)]
                    if len(inside):
                        d = space.from_queries(q[asked], self.centres[inside])
                        taken += d.size
                        far[asked[:, None], inside] = d
                        bound[asked[:, None], inside] = np.where(near, d - self.radius[inside], np.inf)
            if hits:
                scores, ids = self._merged(scores, ids, own, hits, k)
                cut = np.maximum(cut, scores[:, -1])
            width = min(2 * width, pages)

    def _merged(self, scores, ids, own, hits, k):
        """The k best of what was known and what was found; ties to the smaller id."""
        who, what, value = [np.repeat(np.arange(len(ids)), k)], [ids.ravel()], [scores.ravel()]
        for asked, found, p, j in hits:
            sizes = self.sizes[p][j]
            begin = (np.cumsum(self.sizes[p]) - self.sizes[p])[j]
            at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            who.append(np.repeat(asked, sizes))
            what.append(self.ids[p][at])
            value.append(np.repeat(found, sizes).astype(np.int64))
        who, what, value = np.concatenate(who), np.concatenate(what), np.concatenate(value)
        other = (what != own[who]) | (value <= _FEW)
        who, what, value = who[other], what[other], value[other]
        order = np.lexsort((what, -value, who))
        who, what, value = who[order], what[order], value[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < k
        scores, ids = np.full_like(scores, _FEW), np.full_like(ids, -1)
        scores[who[top], place[top]], ids[who[top], place[top]] = value[top], what[top]
        return scores, ids


def top_products(df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every row for which ``is_query`` (a condition
    on vec_id) holds with all rows but its own, in integers floor(scale * component); ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id. Shorter
    vectors are filled up with zeros; zero vectors score 0. Of rows that repeat an id the one with the smallest
    vector counts. Fewer candidates than k: all. Empty table: no rows. Vectors whose
    products do not fit 64 bits are an error. Other columns are ignored.
    """
    spark = df.sparkSession
    python_ready(spark)
    folder = work_folder(spark, "products")
    schema = "query_id long, rank int, vec_id long, score long"
    good = integer_vectors(df, vector_col, scale, F.col(id_col).cast("long").alias("vec_id")).filter("vec_id is not null")
    good = stored(good.groupBy("vec_id").agg(F.min("z").alias("z")), folder, "vectors")
    n, width, top = shape(good)
    if not n:
        return spark.createDataFrame([], schema)
    square = F.aggregate("z", F.lit(0).cast("long"), lambda a, c: a + c * c)
    space = Space(width, top, int(good.agg(F.max(square)).first()[0]))
    # equal vectors are one entry with its k + 1 smallest ids, of which a query can use k
    nth = F.row_number().over(Window.partitionBy("z").orderBy("vec_id"))
    entries = good.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("z").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = stored(entries, folder, "entries")
    held = entries.count()
    count = max(1, min(MAX_PIVOTS, -(-held // TREE_VECTORS)))
    # MAX_PIVOTS * SAMPLE_PER_PIVOT vectors at most, about, in the driver; pivots are the first by hash
    drawn = entries.filter(unit_hash("z") < min(1.0, count * SAMPLE_PER_PIVOT / held)).orderBy(F.xxhash64("z")).limit(count).select("z").collect()
    pivots = padded([r["z"] for r in drawn] or [entries.select("z").first()["z"]], width)
    lifted = spark.sparkContext.broadcast(space.lifted(pivots))

    def place(batches):
        for pdf in batches:
            x = padded(pdf["z"].to_numpy(), width)
            yield pd.DataFrame({"tree": space.between(space.lifted(x), lifted.value).argmin(axis=1) if len(x) else np.zeros(0, np.int64),
                                "v": [space.pack(r) for r in x], "ids": pdf["ids"]})

    placed = stored(entries.mapInPandas(place, "tree long, v binary, ids array<long>"), folder, "placed")
    # one row per pivot
    blocks = np.ones(len(pivots), np.int64)
    for r in placed.groupBy("tree").count().collect():
        blocks[r["tree"]] = -(-r["count"] // TREE_VECTORS) if r["count"] > 2 * TREE_VECTORS else 1
    per_tree = F.broadcast(spark.createDataFrame(pd.DataFrame({"tree": np.arange(len(blocks)), "blocks": blocks})))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pages = build_pages(space, space.rows(list(pdf["v"])).astype(np.int64), list(pdf["ids"]), pivots[key[0]])
        return pd.DataFrame([{"tree": key[0], "block": key[1], **p} for p in pages])

    in_blocks = placed.join(per_tree, "tree").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    pages = stored(in_blocks.groupBy("tree", "block").applyInPandas(
        build, "tree long, block long, page int, parent int, leaf boolean, centre binary, radius double, to_parent double, far binary, "
               "vectors binary, sizes binary, ids binary"), folder, "pages")
    radius = np.full(len(pivots), -np.inf)  # one row per pivot
    for r in pages.filter("parent < 0").groupBy("tree").agg(F.max("radius").alias("r")).collect():
        radius[r["tree"]] = r["r"]

    def to_queries(batches):
        for pdf in batches:
            yield pd.DataFrame({"query_id": pdf["vec_id"], "v": [space.pack(r) for r in padded(pdf["z"].to_numpy(), width)]})

    asked = stored(good.filter(is_query(F.col("vec_id"))).mapInPandas(to_queries, "query_id long, v binary"), folder, "queries")
    chunks = max(1, -(-asked.count() // QUERY_BLOCK))

    def route(first: bool):
        """The trees that queries search: at first one of the nearest pivot, then all others within reach."""
        def run(batches):
            for pdf in batches:
                for a in range(0, len(pdf), 4096):
                    part = pdf.iloc[a: a + 4096]
                    q, ids = space.rows(list(part["v"])), part["query_id"].to_numpy()
                    far = space.from_queries(q, lifted.value)
                    far[:, np.isinf(radius)] = np.inf  # a pivot without vectors
                    home = far.argmin(axis=1)
                    block = ids % blocks[home]
                    if first:
                        row, tree = np.arange(len(q)), home
                    else:
                        reach = space.reach(q, part["cut"].to_numpy()) + 4 * space.slack
                        row, tree = np.nonzero(np.isfinite(far) & (far - radius <= reach[:, None]))
                        times = blocks[tree]
                        block, own = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times), block
                        row, tree = np.repeat(row, times), np.repeat(tree, times)
                        new = (tree != home[row]) | (block != own[row])
                        row, tree, block = row[new], tree[new], block[new]
                    yield pd.DataFrame({"tree": tree, "block": block, "chunk": ids[row] % chunks, "query_id": ids[row],
                                        "v": part["v"].to_numpy()[row], "cut": part["cut"].to_numpy()[row]})
        return run

    def search(queries: pd.DataFrame, tree_pages: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(tree_pages):
            tree = Tree(space, tree_pages)
            for a in range(0, len(queries), TOGETHER):
                part = queries.iloc[a: a + TOGETHER]
                own = part["query_id"].to_numpy()
                scores, ids, _ = tree.search(space.rows(list(part["v"])), own, part["cut"].to_numpy(), k)
                for query, s, i in zip(own, scores, ids):
                    known = s > _FEW
                    if known.any():
                        out.append((query, i[known], s[known]))
        return pd.DataFrame(out, columns=["query_id", "vec_ids", "scores"])

    spread = pages.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.mapInPandas(route(first), "tree long, block long, chunk long, query_id long, v binary, cut long")
        found = sent.groupBy("tree", "block", "chunk").cogroup(spread.groupBy("tree", "block", "chunk")).applyInPandas(
            search, "query_id long, vec_ids array<long>, scores array<long>")
        return found.select("query_id", F.explode(F.arrays_zip(F.col("vec_ids").alias("i"), F.col("scores").alias("s"))).alias("f")).select(
            "query_id", F.col("f.i").alias("vec_id"), F.col("f.s").alias("score"))

    home = stored(searched(asked.withColumn("cut", F.lit(_FEW).cast("long")), True), folder, "home")
    known = home.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(_FEW)).alias("cut"))
    with_cut = asked.join(known, "query_id", "left").withColumn("cut", F.coalesce("cut", F.lit(_FEW).cast("long")))
    found = home.unionByName(searched(with_cut, False))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_products(spark, sf_dir: str) -> DataFrame:
    """The 10 largest inner products of every hundredth of ``embeddings``."""
    return top_products(read_table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
