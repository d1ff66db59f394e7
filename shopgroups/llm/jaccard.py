"""N-gram Jaccard join by parity sketches.

Documents are sets of word n-gram hashes. Two sets link when
100 * intersection >= 85 * union, that is, when their symmetric difference is at
most 15/185 of the sum of their sizes. The join finds all links:

1. Size bands: a pair belongs to the band of its larger set, which bounds its
   symmetric difference by some h. In a band the hash range is cut into more than
   h parts, and each part's hashes are XORed into a word: the parity sketch. A
   token that only one set has changes one word, so the number of differing words
   is a lower bound of the symmetric difference, and by the pigeonhole principle
   sets that link agree in a word. A set emits its non-empty words, which suffice
   where there are more than h of them; else it emits the empty ones as well.
2. Words are first grouped inside each map task, then (one row per word and task)
   by a shuffle. Only words that several different sets share go on. As at most h of a
   set's non-empty words can differ from those of a set that it links with, a set
   that shares fewer than the others takes no further part in the band.
3. Sets that share words, directly or along others, make a cluster. A cluster is
   cut into units that a task can hold: one unit if it is small, else blocks of
   sets in pairs of blocks of neighbouring sizes. Every set's hashes are read
   again from the texts, only for sets in clusters. Tables and shuffles of a step
   are deleted when the next one is written, as each is about as large as the texts.
4. In a unit, parity bit sketches (one bit toggled per token; the Hamming distance
   is a lower bound too) rule pairs out, the rest is verified exactly, the
   likeliest first, and pairs that are connected already are skipped. The links
   that are left span the unit's components.

Components of these links are the components of all links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgroups.sources.tables import remove_folder

from .common import documents, python_ready, stored, unused, work_folder
from .components import components, with_group
from .ragged import chunks, mix, span_hashes, starts_of, strings, text_bytes, words_of

#: Words of a shingle, and the least similarity in hundredths, of the contract's query.
SHINGLE, PERCENT = 4, 85
#: Ratio of a size band's ends.
BAND = 1.5
#: Parts beyond the least number, by which few sets of a band have too many empty ones.
SPARE = 0.12
#: Sets and hashes that a unit holds, at most.
UNIT_SETS, UNIT_HASHES = 8_000, 4_000_000
#: Sets whose texts are read again by a broadcast of their ids (about 60 bytes each); more are joined by a shuffle.
BROADCAST_SETS = 100_000
#: Sets up to which hashes of their ids (about 30 bytes each) are broadcast first, so that only their texts are shuffled.
BROADCAST_HASHES = 4_000_000
#: Words that a task of the word shuffle takes, about.
TASK_WORDS = 2_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct word n-grams in ascending order, bounds of each text's hashes).

    A-Z are lower-cased, words are runs without white space; a text with fewer than n words has its
    whole sequence as its only n-gram, one without words has none.
    """
    flat, bounds = text_bytes(texts)
    flat = LOWER[flat]
    at, size, words = words_of(flat, bounds)
    hashes = span_hashes(flat, at, size)
    count = np.diff(words)
    weights = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    sums = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        sums += hashes[j: len(hashes) - n + 1 + j] * weights[j]
    grams = np.maximum(count - n + 1, 0)
    first = np.repeat(words[:-1] - starts_of(grams)[:-1], grams) + np.arange(int(grams.sum()))
    out, out_count = mix(sums[first]), grams.copy()
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([int(mix((hashes[words[i]: words[i + 1]] * weights[: count[i]]).sum(keepdims=True) + np.uint64(count[i]))[0]) for i in short], np.uint64)
        out_count[short] = 1
        out = np.insert(out, starts_of(grams)[short], whole)
    edges = starts_of(out_count)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[edges[:-1][out_count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[edges]


def most_different(sizes, percent: int):
    """The largest symmetric difference of a linked pair whose sizes sum to ``sizes``."""
    return sizes * (100 - percent) // (100 + percent)


class Bands:
    """Band numbers, and the number of parts of each band."""

    def __init__(self, percent: int):
        self.percent = percent

    def top(self, band: int) -> int:
        return int(BAND ** band)

    def of(self, n: int) -> int:
        band = max(0, int(math.log(max(n, 1), BAND)) - 1)
        while self.top(band) < n:
            band += 1
        return band

    def bands(self, n: int) -> set[int]:
        """The bands of all pairs that a set of size n can be in."""
        return {*range(self.of(n), self.of(n * 100 // self.percent) + 1)}

    def least_words(self, band: int) -> int:
        return most_different(2 * self.top(band), self.percent) + 1

    def parts(self, band: int) -> int:
        least = self.least_words(band)
        return least + int(least * SPARE) + 4


#: The lowest bits of a key tell its band.
BAND_BITS = np.uint64(63)


def parity_words(hashes: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int], list[int]]:
    """(the sketch words of one set, made different by band and part, as keys of the join; its bands;
    how many of its words in each band a set that links with it shares at least)."""
    keys, own, need = [], sorted(bands.bands(len(hashes))), []
    high = hashes >> np.uint64(32)
    for band in own:
        parts = bands.parts(band)
        part = (high * np.uint64(parts)) >> np.uint64(32)  # ascending, as the hashes are
        first = np.flatnonzero(np.diff(part, prepend=np.uint64(2**63)))
        number, word = part[first], np.bitwise_xor.reduceat(hashes, first)
        need.append(max(1, len(first) - bands.least_words(band) + 1))
        if len(first) < bands.least_words(band):
            words = np.zeros(parts, np.uint64)
            words[number] = word
            number, word = np.arange(parts, dtype=np.uint64), words
        keys.append(mix(word ^ mix(number + np.uint64(band << 32) + np.uint64(1 << 62))) & ~BAND_BITS | np.uint64(band))
    return np.concatenate(keys), own, need


def set_rows(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """One row per input row: rid (its number), rec_id, size, digest of the set in two columns, and for
    the first row of a set in its task: ``keys`` that no earlier set of the task has, ``shared`` keys
    that several sets of the task have, ``bands`` and ``needs`` as of ``parity_words``."""
    python_ready(df.sparkSession)
    slim = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("rec_id"), F.col(text_col).cast("string").alias("text"))
    schema = (f"rid long, rec_id {dict(slim.dtypes)['rec_id']}, size long, digest long, digest2 long, "
              "keys array<long>, shared array<long>, bands array<int>, needs array<int>")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        bands, seen, rows, keys, owners = Bands(percent), set(), [], [], []
        own_bands, own_needs = [], []
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, bounds = shingles(strings(part.column("text")), n)
                size = np.diff(bounds)
                digest, digest2 = np.zeros((2, len(size)), np.uint64)
                full = np.flatnonzero(size)
                if len(full):
                    digest[full] = mix(np.bitwise_xor.reduceat(hashes, bounds[full]) + size[full].astype(np.uint64))
                    digest2[full] = mix(np.add.reduceat(mix(hashes), bounds[full]))
                rid = part.column("rid").to_numpy()
                for i in full.tolist():
                    own = (digest[i], digest2[i])
                    if own not in seen:
                        seen.add(own)
                        words, in_bands, needs = parity_words(hashes[bounds[i]: bounds[i + 1]], bands)
                        keys.append(words)
                        owners.append(np.full(len(words), rid[i]))
                        own_bands.append((rid[i], in_bands))
                        own_needs.append((rid[i], needs))
                rows.append((rid, part.column("rec_id"), size, digest.view(np.int64), digest2.view(np.int64)))
        if not rows:
            return
        every = np.concatenate([r[0] for r in rows])
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
        lists = [_lists(every, owner[chosen], key[chosen].view(np.int64)) for chosen in (new, several)]
        for found in (own_bands, own_needs):
            lists.append(_lists(every, np.array([r for r, v in found for _ in v], np.int64), np.array([x for _, v in found for x in v], np.int32)))
        at = 0
        for rid, rec_id, size, digest, digest2 in rows:
            own = [x.slice(at, len(rid)) for x in lists]
            at += len(rid)
            yield pa.RecordBatch.from_arrays([pa.array(rid), rec_id, pa.array(size), pa.array(digest), pa.array(digest2), *own], names=names)

    return slim.mapInArrow(run, schema)


def _lists(every: np.ndarray, owner: np.ndarray, key: np.ndarray) -> pa.Array:
    """The keys of each of the ascending numbers ``every``, as lists."""
    order = np.argsort(owner, kind="stable")
    bounds = np.append(np.searchsorted(owner[order], every), len(owner))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(key[order]))


def _columns(batches, *names) -> list[np.ndarray] | None:
    """The columns of all batches of a task; none without batches."""
    kept = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in names) for b in batches]
    return [np.concatenate(c) for c in zip(*kept)] if kept else None


def _tasks(rows: int, spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_WORDS))


def _first_of(*sorted_columns) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def shared_words(rows: DataFrame, folder: str) -> DataFrame:
    """(key, sid) for all keys that several sets have; a set is named by its digest, so that its copies are one."""
    total = rows.agg(F.sum("n_keys")).first()[0] or 0
    # one row per key and map task of set_rows
    firsts = rows.filter("n_keys > 0").select(F.col("digest").alias("sid"), F.explode("keys").alias("key")).repartition(_tasks(total, rows.sparkSession), "key")

    def several(batches):
        found = _columns(batches, "key", "sid")
        if found is None:
            return
        key, sid = found
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        new = _first_of(key, sid)
        key, sid = key[new], sid[new]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        chosen = same[1:] | same[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[chosen]), pa.array(sid[chosen])], names=["key", "sid"])

    across = firsts.mapInArrow(several, "key long, sid long")
    inside = rows.filter(F.size("shared") > 0).select(F.explode("shared").alias("key"), F.col("digest").alias("sid"))
    return stored(across.unionByName(inside), folder, "shared")


def word_edges(shared: DataFrame, slim: DataFrame, folder: str) -> DataFrame:
    """(a, b): edges that connect all sets with a word in common, of sets that share enough of them in its band.

    A task reduces its sets' words to one set for each word, so that no later task takes a hot word's sets.
    """
    tasks = _tasks(shared.count(), shared.sparkSession)
    needs = slim.filter(F.size("bands") > 0).select(F.col("digest").alias("sid"), F.explode(F.map_from_arrays("bands", "needs")).alias("band", "need"))
    asked = shared.select("sid", "key", F.lit(0).alias("need")).unionByName(needs.select("sid", F.col("band").cast("long").alias("key"), "need"))

    def enough(batches):
        found = _columns(batches, "sid", "key", "need")
        if found is None:
            return
        sid, key, need = found
        word = need == 0
        key_of, sid_of = key[word], sid[word]
        order = np.lexsort((key_of, sid_of))
        key_of, sid_of = key_of[order], sid_of[order]
        new = _first_of(key_of, sid_of)
        key_of, sid_of = key_of[new], sid_of[new]
        # a set's own keys of a band, and how many it needs; the sets are numbered
        sets = np.unique(sid)
        place = lambda sid, band: np.searchsorted(sets, sid) * 64 + band
        own = place(sid_of, key_of & int(BAND_BITS))
        least = np.full(len(sets) * 64, np.iinfo(np.int64).max)
        np.minimum.at(least, place(sid[~word], key[~word]), need[~word])
        kept = np.bincount(own, minlength=len(least))[own] >= least[own]
        key_of, sid_of = key_of[kept], sid_of[kept]
        order = np.lexsort((sid_of, key_of))
        key_of, sid_of = key_of[order], sid_of[order]
        first = _first_of(key_of) if len(key_of) else np.zeros(0, bool)
        to = sid_of[first][np.cumsum(first) - 1]
        a, b = _different(sid_of[~first], to[~first])
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key_of[first]), pa.array(sid_of[first]), pa.nulls(int(first.sum()), pa.int64())], names=["key", "a", "b"])
        yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b)], names=["key", "a", "b"])

    members = stored(asked.repartition(tasks, "sid").mapInArrow(enough, "key long, a long, b long"), folder, "members")

    def joined(batches):
        found = _columns(batches, "key", "a")
        if found is None:
            return
        order = np.lexsort((found[1], found[0]))
        key, sid = found[0][order], found[1][order]
        first = _first_of(key) if len(key) else np.zeros(0, bool)
        a, b = _different(sid, sid[first][np.cumsum(first) - 1])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    words = members.filter("key is not null").select("key", "a")
    return words.repartition(_tasks(words.count(), shared.sparkSession), "key").mapInArrow(joined, "a long, b long").unionByName(
        members.filter("key is null").select("a", "b"))


def _different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of unlike numbers."""
    a, b = a[a != b], b[a != b]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = _first_of(a, b)
    return a[new], b[new]


def spanning_links(rid: np.ndarray, size: np.ndarray, hashes: list[np.ndarray], percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the sets' links. With ``block`` (0 or 1 per set) only links
    between the two blocks are looked for."""
    order = np.argsort(size, kind="stable")
    rid, size, hashes = rid[order], size[order], [hashes[i] for i in order]
    block = None if block is None else block[order]
    found: list[tuple[int, int]] = []
    if len(rid) > 2:
        words = 4 if len(rid) < 8 else max(4, min(64, 1 << int(np.median(size) * 2 // 64).bit_length()))
        sketch = np.zeros((len(rid), words), np.uint64)
        for i, h in enumerate(hashes):
            bit = h & np.uint64(words * 64 - 1)
            np.bitwise_xor.at(sketch[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    label = np.arange(len(rid))
    for i in range(1, len(rid)):
        low = int(np.searchsorted(size, -(-size[i] * percent // 100)))
        near = low + np.flatnonzero(label[low:i] != label[i])
        if block is not None:
            near = near[block[near] != block[i]]
        if not len(near):
            continue
        most = most_different(size[near] + size[i], percent)
        if len(rid) > 2:
            apart = np.bitwise_count(sketch[near] ^ sketch[i]).sum(1, dtype=np.int64)
            likely = np.flatnonzero(apart <= most)
            near, most = near[likely], most[likely]
            best = np.argsort(apart[likely], kind="stable")
            near, most = near[best], most[best]
        for j, d in zip(near.tolist(), most.tolist()):
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(hashes[i], hashes[j], assume_unique=True))
            if size[i] + size[j] - 2 * both <= d:
                found.append((int(rid[i]), int(rid[j])))
                label[label == label[i]] = label[j]
    return found


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT,
                       unit_sets: int = UNIT_SETS, unit_hashes: int = UNIT_HASHES) -> DataFrame:
    """id_col, n_shingles and component_id of every row; component_id is the smallest id that the
    row's links reach, its own included.

    Null or empty texts and texts without words have no shingles and link with nothing. Equal sets
    always link. Repeated ids: each row has its own set. Null ids stay and are no component's id,
    unless the whole component has none. Empty input: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    folder = work_folder(spark, "jaccard")
    rows = set_rows(df, id_col, text_col, n, percent).withColumn("n_keys", F.size("keys"))
    rows = stored(rows, folder, "sets")
    same_set = ["size", "digest", "digest2"]
    sets = stored(rows.filter("size > 0").groupBy(*same_set).agg(F.min("rid").alias("set_id"), F.min("rec_id").alias("least_id"),
                                                                     F.count("*").alias("copies")), folder, "classes")

    shared = shared_words(rows, folder)
    # the words are most of the disk, and not read again
    slim = stored(rows.select("rec_id", *same_set, "bands", "needs"), folder, "slim")
    remove_folder(spark, f"{folder}/sets")
    edges = stored(word_edges(shared, slim, folder), folder, "edges")
    for name in ("shared", "members"):
        remove_folder(spark, f"{folder}/{name}")
    clusters = components(edges, f"{folder}/clusters")
    clusters = stored(clusters.select(F.col("node").alias("digest"), F.col("root").alias("cluster")), folder, "cluster-of")
    sized = clusters.join(sets.drop("copies"), "digest")
    large = sized.groupBy("cluster").agg(F.count("*").alias("n_rows"), F.count("*").alias("c_sets"), F.sum("size").alias("c_hashes"))
    links = verified_links(df, with_group(sized, large, ["cluster"], clusters.count()), id_col, text_col, n, percent, unit_sets, unit_hashes, folder)
    links = stored(links, folder, "links")

    linked = components(links, f"{folder}/components").select(F.col("node").alias("set_id"), "root")
    rooted = sets.join(linked, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = stored(rooted, folder, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_rows"))
    named = with_group(rooted, least, ["root"], rooted.count()).select(*same_set, "component_id", F.col("copies").alias("n_rows"))
    named = stored(named, folder, "named")
    slim = slim.select("rec_id", *same_set)
    found = with_group(slim.filter("size > 0"), named, same_set, slim.count())
    # sets without a member are linked with nothing, and are no group
    empty = slim.filter("size = 0").withColumn("component_id", F.col("rec_id"))
    return found.unionByName(empty).select(
        F.col("rec_id").alias(id_col), F.col("size").alias("n_shingles"),
        F.coalesce("component_id", "rec_id").alias("component_id"))


def verified_links(df: DataFrame, sized: DataFrame, id_col: str, text_col: str, n: int, percent: int,
                   unit_sets: int, unit_hashes: int, folder: str) -> DataFrame:
    """(a, b): set ids of links that span each cluster's components."""
    whole = (F.col("c_sets") <= unit_sets) & (F.col("c_hashes") <= unit_hashes)
    # a block holds half a unit; sets of one size range, split evenly by a hash
    ratio = math.log(100 / percent)
    span = F.when(whole, 0).otherwise(F.floor(F.log("size") / ratio).cast("int"))
    blocks = sized.select("set_id", "cluster", "size", "digest", "digest2", F.col("least_id").alias("rep_id"), whole.alias("whole"), span.alias("span"))
    per_span = blocks.filter(~F.col("whole")).groupBy("cluster", "span").agg(
        F.ceil(F.greatest(F.count("*") * 2 / F.lit(unit_sets), F.sum("size") * 2 / F.lit(unit_hashes))).cast("int").alias("splits"))
    blocks = blocks.join(per_span, ["cluster", "span"], "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    # a large cluster's set meets all blocks of its own and the neighbouring size ranges
    near = per_span.select("cluster", F.col("span").alias("other_span"), F.col("splits").alias("other_splits"))
    own = F.pmod(F.xxhash64("set_id"), F.col("splits")).cast("int")
    blocks = blocks.withColumn("split", own)
    alone = blocks.filter("whole").select("set_id", "rep_id", "size", "digest", "digest2",
                                          F.array(F.struct(F.xxhash64("cluster").alias("unit"), F.lit(0).alias("side"))).alias("units"))
    low = F.struct("span", "split")
    met = (blocks.filter(~F.col("whole")).join(near, "cluster").filter(F.abs(F.col("span") - F.col("other_span")) <= 1)
           .withColumn("other_split", F.explode(F.sequence(F.lit(0), F.col("other_splits") - 1))))
    high = F.struct(F.col("other_span").alias("span"), F.col("other_split").alias("split"))
    met = met.select("set_id", "rep_id", "size", "digest", "digest2", F.struct(
        F.xxhash64("cluster", F.least(low, high), F.greatest(low, high)).alias("unit"),
        F.when(low == high, 0).when(low < high, 1).otherwise(2).alias("side")).alias("u"))
    met = met.groupBy("set_id", "rep_id", "size", "digest", "digest2").agg(F.collect_list("u").alias("units"))
    wanted = alone.unionByName(met)
    wanted = stored(wanted, folder, "wanted")
    text = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).cast("string").alias("text"))
    n_wanted = wanted.count()
    if n_wanted <= BROADCAST_SETS:
        wanted = F.broadcast(wanted)
    elif n_wanted <= BROADCAST_HASHES:
        # most texts are in no cluster, and stay out of the shuffle
        hashed = F.broadcast(wanted.select(F.xxhash64("rep_id").alias("hash")).distinct())
        text = text.join(hashed, F.xxhash64("rec_id") == F.col("hash"), "left_semi")
    texts = text.join(wanted, text["rec_id"].eqNullSafe(wanted["rep_id"])).select(
        "set_id", "size", "digest", "digest2", "units", "text")

    kinds = "set_id long, size long, digest long, digest2 long, units array<struct<unit:long,side:int>>, text string, hashes array<long>"

    def read(batches):
        """The hashes of sets of several units. Those of one unit go on as texts, which take less disk."""
        for batch in batches:
            several = pc.greater(pc.list_value_length(batch.column("units")), 1)
            once, batch = batch.filter(pc.invert(several)), batch.filter(several)
            if once.num_rows:
                lists = pa.nulls(once.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(once.column(c) for c in SET_COLUMNS), once.column("text").cast(pa.string()), lists], names=[*SET_COLUMNS, "text", "hashes"])
            for part in chunks(batch, "text"):
                hashes, bounds, right = _right_sets(part, n)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                found = pa.RecordBatch.from_arrays([*(part.column(c) for c in SET_COLUMNS), pa.nulls(part.num_rows, pa.string()), lists], names=[*SET_COLUMNS, "text", "hashes"])
                yield found.filter(pa.array(right))

    dealt = (texts.mapInArrow(read, kinds).withColumn("u", F.explode("units"))
             .select("u.unit", "u.side", "set_id", "size", "digest", "digest2", "text", "hashes")
             .repartition("unit").sortWithinPartitions("unit"))

    def hashes_of(batch):
        """The rows of a batch in order, texts as hashes: (unit, side, set id, hashes)."""
        given = pc.is_valid(batch.column("hashes")).to_numpy(zero_copy_only=False)
        for a, z in zip(edges := [0, *(np.flatnonzero(given[1:] != given[:-1]) + 1).tolist()], [*edges[1:], batch.num_rows]):
            rows = batch.slice(a, z - a)
            if not rows.num_rows:
                continue
            for part in [rows] if given[a] else chunks(rows, "text"):
                if given[a]:
                    lists = part.column("hashes")
                    at, flat, right = np.asarray(lists.offsets), np.asarray(lists.values).view(np.uint64), np.ones(part.num_rows, bool)
                else:
                    flat, at, right = _right_sets(part, n)
                units, sides, ids = (part.column(c).to_numpy() for c in ("unit", "side", "set_id"))
                for i in np.flatnonzero(right).tolist():
                    yield units[i], sides[i], ids[i], flat[at[i]: at[i + 1]]

    def link(batches):
        unit, rows = None, []
        for batch in batches:
            out = []
            for of, side, set_id, hashes in hashes_of(batch):
                if of != unit:
                    out += _link(rows, percent)
                    unit, rows = of, []
                rows.append((set_id, side, hashes))
            # keep only what the next batch may go on with
            rows = [(r, s, h.copy()) for r, s, h in rows]
            yield _pairs(out)
        yield _pairs(_link(rows, percent))

    return dealt.mapInArrow(link, "a long, b long")


SET_COLUMNS = ("set_id", "size", "digest", "digest2", "units")


def _right_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the texts, bounds of each text's hashes, whether they are the set of the row): of rows with one id only those with the set itself."""
    hashes, bounds = shingles(strings(batch.column("text")), n)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    digest, digest2 = np.zeros((2, len(size)), np.uint64)
    if len(full):
        digest[full] = mix(np.bitwise_xor.reduceat(hashes, bounds[full]) + size[full].astype(np.uint64))
        digest2[full] = mix(np.add.reduceat(mix(hashes), bounds[full]))
    right = (size == batch.column("size").to_numpy()) & (digest.view(np.int64) == batch.column("digest").to_numpy()) & (
        digest2.view(np.int64) == batch.column("digest2").to_numpy())
    return hashes, bounds, right


def _link(rows: list, percent: int) -> list[tuple[int, int]]:
    rows = list({r[0]: r for r in rows}.values())
    if len(rows) < 2:
        return []
    sides = np.array([r[1] for r in rows])
    block = sides if sides.any() else None
    return spanning_links(np.array([r[0] for r in rows]), np.array([len(r[2]) for r in rows]), [r[2] for r in rows], percent, block)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of every component, the one with the smallest id, with all its columns; texts without
    words all stay. Of rows with one id, or without ids, one stays too. Empty input: no rows."""
    folder = work_folder(df.sparkSession, "keep-one")
    ids = df.agg(F.count("*").alias("n"), F.count(id_col).alias("filled"), F.count_distinct(id_col).alias("distinct")).first()
    if ids["n"] == ids["filled"] == ids["distinct"]:
        slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
        found = jaccard_components(slim, "_id", "text", n, percent)
        others = stored(found.filter(F.col("component_id") != F.col("_id")).select(F.col("_id").alias(id_col)), folder, "others")
        return df.join(others, id_col, "left_anti").select(*df.columns)
    # ids that are null or repeat: row numbers instead, which both reads of the texts must share
    row = unused(df.columns, "_row")
    numbered = stored(df.withColumn(row, F.monotonically_increasing_id()), folder, "rows")
    found = jaccard_components(numbered.select(F.col(row).alias("_row"), F.col(text_col).alias("text")), "_row", "text", n, percent).select("_row", "component_id")
    ids = numbered.select(F.col(row).alias("_row"), F.col(id_col).alias("_id"))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    ranked = stored(found.join(ids, "_row").select("_row", "component_id", order.alias("o")), folder, "ranked")
    first = ranked.groupBy("component_id").agg(F.min("o")["row"].alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    others = ranked.join(first, "component_id").filter(F.col("_row") != F.col("first")).select(F.col("_row").alias(row))
    return numbered.join(others, row, "left_anti").select(*df.columns)


def op4_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles and a similarity of 0.85 or more."""
    return jaccard_components(documents(spark, sf_dir))
