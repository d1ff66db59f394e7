"""Token counts through a digest cache.

Texts are joined by content digest and tokenizer digest to the counts of
earlier runs; only distinct texts that the cache does not know are shuffled and
encoded, and their counts are appended to the cache. The cache is a Parquet
folder partitioned by tokenizer digest; two runs that append at once may store
a count twice, which readers fold away.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, python_ready, stored, text_or_empty, work_folder
from .ragged import chunks, distinct, span_hashes, strings, sums_of, text_bytes, words_of

#: Words kept with their counts from chunk to chunk; the memory is emptied when it is full.
MEMORY = 500_000
MARK = "▁"
ONLY_SPACE = np.arange(256) == 32


class PieceCounter:
    """Counts of a sentencepiece model.

    No piece of the usual models crosses from a word to the next space mark, so a text's
    count is the sum of its space-separated words' counts, and distinct words are encoded
    once. Texts with leading, trailing or repeated spaces or with the mark itself, and
    models that normalise or have crossing pieces, are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        crossing = any(MARK in p.lstrip(MARK) for p in pieces)
        probe = " ﬁ　Å  ①\t\r\n x "
        self.by_word = not crossing and self.library.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.known: dict[int, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.by_word:
            return np.array(self.whole(texts.to_pylist()), np.int64)
        flat, bounds = text_bytes(texts)
        at, size, words = words_of(flat, bounds, ONLY_SPACE)
        spaces = sums_of(flat == 32, bounds)
        plain = (np.diff(words) == spaces + 1) & ~np.asarray(pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False))
        numbers, keys, first = distinct(span_hashes(flat, at, size))
        keys = keys.tolist()
        if len(self.known) > MEMORY:
            self.known = {}
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        if missing:
            spans = zip(at[first[missing]].tolist(), size[first[missing]].tolist())
            self.known.update(zip([keys[i] for i in missing], self.whole([flat[a: a + n].tobytes().decode() for a, n in spans])))
        each = np.fromiter((self.known[k] for k in keys), np.int64, len(keys))[numbers]
        out = sums_of(each, words)
        other = np.flatnonzero(~plain)
        if len(other):
            out[other] = self.whole(texts.take(pa.array(other)).to_pylist())
        return out


class JsonCounter:
    """Counts of a model of the tokenizers library, whole texts at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(e) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)], np.int64)


@lru_cache(maxsize=2)
def counter(path: str):
    return (JsonCounter if path.endswith(".json") else PieceCounter)(path)


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the model file, the library and its version."""
    import sentencepiece
    import tokenizers

    library = tokenizers if path.endswith(".json") else sentencepiece
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def cached_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """Stored (digest, n_tokens) of one tokenizer; no rows if there is no cache yet."""
    try:
        stored_counts = spark.read.schema("digest binary, n_tokens long, tokenizer string").parquet(cache)
    except AnalysisException:
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return stored_counts.filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(df: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of every row.

    ``cache``: folder of the digest cache, shared by all executors; made where it is missing.
    Null text: empty, 0 tokens. Repeated texts are encoded once, repeated rows all returned.
    Null ids stay. Empty input: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    python_ready(spark)
    version = tokenizer_digest(tokenizer)
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("rec_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    folder = work_folder(spark, "counts")
    slim = stored(rows.select("rec_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), folder, "digests")

    known = cached_counts(spark, cache, version)
    wanted = slim.groupBy("digest").agg(F.min("rec_id").alias("one")).join(known, "digest", "left_anti")
    # one row of every unknown text; with a warm cache few rows are wanted and no text is shuffled
    misses = rows.join(wanted.hint("shuffle_hash") if known.isEmpty() else wanted,
                       (rows["digest"] == wanted["digest"]) & rows["rec_id"].eqNullSafe(wanted["one"]), "left_semi")

    def encode(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                n = counter(tokenizer).count(strings(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n)], names=["digest", "n_tokens"])

    counted = misses.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)

    counts = cached_counts(spark, cache, version)
    return slim.join(counts, "digest").select(
        F.col("rec_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents; each call has a cache of its own, so every distinct text is encoded once."""
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), work_folder(spark, "cache"))
