"""Toxicity by a weighted lexicon with exception phrases, normalised by length.

Texts are folded first: lower case, homoglyphs and accents to plain letters,
digits and signs inside words to the letters they stand for. The lexicon is
learned from labelled rows: whole words, word beginnings and word ends that are
dense in toxic texts and not in clean ones. One Aho-Corasick automaton finds all
terms; a word counts once, with its heaviest term, unless it stands in an
exception phrase that clean texts use. The score is a logistic function of the
matched weight by length and of the number of matched words.

The fit reads about ``FIT_ROWS`` labelled rows, chosen by a hash of the id, so
its cost and the model's size do not depend on the corpus; every text is scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopgroups.sources.tables import read_table

from .common import documents, python_ready, stored, unit_hash, work_folder
from .ragged import chunks

#: Labelled rows that the fit reads, about.
FIT_ROWS = 20_000
#: A term is dense in a text from this part of its words on.
DENSE = 0.005
#: Distinct toxic texts in which a term of the lexicon is dense, at least: this part of them, within the bounds.
SUPPORT_PART, SUPPORT_BOUNDS = 0.02, (3, 12)
#: Standard deviations by which they exceed what the clean texts' rate lets expect, at least.
SURPRISE = 8.0
#: Log-odds of a term, at least.
WEIGHT = 2.0
#: Terms are chosen until every toxic text has so many.
COVER = 3
#: Clean texts with an exception phrase, at least.
PHRASE_SUPPORT = 5
#: Rejected from this score on.
REJECT = 0.7

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авсԁеоріјкмнтухѕԛԝһгαβεικνορτυχω", "abcdeopijkmhtyxsqwhraeeiknoptuxw"))
LOOKALIKES |= {"β": "b", "ε": "e", "ı": "i", "ł": "l", "ø": "o", "đ": "d"}
# Digits and signs that stand for letters.
SUBSTITUTES = str.maketrans("0134578@$!", "oieastbasi")
MIXED = re.compile(r"[a-z0-9@$!]*[0134578@$!][a-z0-9@$!]*")


class Folding(dict):
    """For str.translate: character -> folded character, a blank for what is not a letter."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        base = LOOKALIKES.get(char) or unicodedata.normalize("NFKD", char)[:1].lower()
        base = LOOKALIKES.get(base, base)
        if unicodedata.category(char) in ("Mn", "Cf"):  # marks and invisible characters inside words
            base = ""
        elif not base.isalpha():
            base = " "
        self[code] = base
        return base


FOLD = Folding()


@lru_cache(maxsize=100_000)
def unmixed(word: str) -> str:
    """A word with substitutes inside as letters; numbers and punctuation as they are."""
    core = word.rstrip("!")
    letters = sum(c.isalpha() for c in core)
    return core.translate(SUBSTITUTES) if 2 * letters >= len(core) and letters else word


def folded(text: str) -> list[str]:
    """The folded words of a text."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(HOMOGLYPHS)
    if SIGNS.search(low):
        low = MIXED.sub(lambda m: unmixed(m[0]), low)
    return low.translate(FOLD).split()


HOMOGLYPHS = {ord(k): v for k, v in LOOKALIKES.items()}
SIGNS = re.compile(r"[a-z][0134578@$!]|[0134578@$!][a-z]")


def terms_of(word: str) -> list[str]:
    """The terms that hold for a word: itself, beginnings of 4 to 7 and ends of 4 to 6 letters."""
    if len(word) < 3:
        return []
    return ([f" {word} "] + [f" {word[:n]}" for n in range(4, min(8, len(word)))]
            + [f"{word[-n:]} " for n in range(4, min(7, len(word)))])


def dense_terms(words: list[str], only: set[str] | None = None) -> list[str]:
    counts: Counter[str] = Counter()
    for word, n in Counter(words).items():
        for term in terms_of(word):
            if only is None or term in only:
                counts[term] += n
    least = DENSE * len(words)
    return [t for t, n in counts.items() if n >= least]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset = frozenset()
    coefficients: tuple = (-2.0, 0.0, 0.0)  # constant, weight by length, matched words

    def __post_init__(self):
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                self._automaton.add_word(term, (term, weight))
            if self.weights:
                self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(place in the joined words, weight) of every matched word outside exception phrases."""
        if not self.weights or not words:
            return []
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        for end, (term, weight) in self.automaton().iter(line):
            at = end - len(term) + 1 if term[0] == " " else line.rfind(" ", 0, end)
            best[at] = max(best.get(at, 0.0), weight)
        if self.exceptions:
            for at in list(best):
                before, word, after = neighbours(line, at)
                if (before, word) in self.exceptions or (word, after) in self.exceptions:
                    del best[at]
        return list(best.items())

    def features(self, words: list[str]) -> tuple[float, float, int]:
        hits = self.hits(words)
        return np.log1p(1000 * sum(w for _, w in hits) / (len(words) + 10)), np.log1p(len(hits)), len(hits)

    def score(self, by_length, matched):
        a, b, c = self.coefficients
        return 1 / (1 + np.exp(-(a + b * np.asarray(by_length) + c * np.asarray(matched))))


def neighbours(line: str, at: int) -> tuple[str, str, str]:
    """The words before, at and after the blank at ``at`` of a line of words."""
    end = line.index(" ", at + 1)
    after = line[end + 1: line.find(" ", end + 1)] if end + 1 < len(line) else ""
    before = line[line.rfind(" ", 0, at) + 1: at] if at else ""
    return before, line[at + 1: end], after


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` labelled training texts (id, text, toxic), equal texts once. Rows whose
    crc32(id as text) mod 3 is 1 are held out."""
    rec_id = F.col(id_col)
    train = (labels.filter((F.crc32(rec_id.cast("string").cast("binary")) % 3 != 1) & F.col(label_col).isin(0, 1))
             .groupBy(rec_id.alias("rec_id")).agg(F.max(label_col).cast("int").alias("toxic")))
    n = train.count()
    # about fit_rows rows, whatever the number of labels
    chosen = train.filter(unit_hash(F.col("rec_id"), F.lit(11)) < min(1.0, fit_rows / max(n, 1)))
    text = docs.select(F.col(id_col).alias("rec_id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    return (text.join(F.broadcast(chosen), "rec_id").withColumn("key", F.xxhash64("text"))
            .groupBy("key").agg(F.min_by(F.struct("text", "toxic"), F.struct("rec_id", "toxic")).alias("one"))
            .select("key", "one.text", "one.toxic"))


def least_support(n_toxic: int) -> int:
    return int(np.clip(np.ceil(SUPPORT_PART * n_toxic), *SUPPORT_BOUNDS))


def choose_terms(support: dict[str, tuple[int, int]], incidence: pd.DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms by greedy cover: the next term is the one that is dense in most toxic texts with fewer than
    COVER terms so far, clean texts subtracted at their rate."""
    odds, rate, least = {}, n_toxic / max(n_clean, 1), least_support(n_toxic)
    for t, (a, c) in support.items():
        expected = (c + 1) * rate
        if a - expected >= SURPRISE * np.sqrt(expected):
            odds[t] = float(np.log((a + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)))
    rows = incidence[incidence["term"].map(odds).fillna(0) >= WEIGHT]
    texts = {t: set(g) for t, g in rows.groupby("term")["key"]}
    missing = Counter({k: COVER for k in set(rows["key"])})
    chosen: dict[str, float] = {}
    while texts:
        gain = {t: sum(missing[k] > 0 for k in s) for t, s in texts.items()}
        best = max(gain, key=lambda t: (gain[t] - support[t][1] * rate, odds[t], len(t), t))
        if gain[best] < least:
            break
        chosen[best] = odds[best]
        covered = texts.pop(best)
        for k in covered:
            missing[k] -= 1
        # a variant of the same word is no second sign
        variant = lambda t: (t.strip() in best or best.strip() in t) and len(texts[t] - covered) < least
        texts = {t: s for t, s in texts.items() if gain[t] >= least and not variant(t)}
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method with a small ridge; finite also for classes that are apart."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fit_rows: int = FIT_ROWS) -> Model:
    """Learn the model from labelled rows outside the held-out third. Without labels of both kinds
    the lexicon is empty and every score is the labels' smoothed rate."""
    spark = docs.sparkSession
    python_ready(spark)
    train = stored(labelled_sample(docs, labels, id_col, text_col, label_col, fit_rows), work_folder(spark, "toxicity"), "train")
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        return Model(coefficients=(float(np.log(rate / (1 - rate))), 0.0, 0.0))

    def dense(batches, only=None):
        for pdf in batches:
            found = [(k, t) for k, text in zip(pdf["key"], pdf["text"]) for t in dense_terms(folded(text), only)]
            yield pd.DataFrame(found, columns=["key", "term"])

    schema = "key long, term string"
    # texts are dealt to all cores, as the sample is far smaller than its files' splits
    dealt = train.repartition(spark.sparkContext.defaultParallelism)
    in_toxic = stored(dealt.filter("toxic = 1").select("key", "text").mapInPandas(dense, schema),
                      work_folder(spark, "toxicity"), "terms")
    often = in_toxic.groupBy("term").agg(F.count("*").alias("a")).filter(F.col("a") >= least_support(n_toxic))
    candidates = spark.sparkContext.broadcast({r["term"]: r["a"] for r in often.collect()})
    in_clean = (dealt.filter("toxic = 0").select("key", "text")
                .mapInPandas(lambda b: dense(b, candidates.value), schema).groupBy("term").agg(F.count("*").alias("c")))
    clean = {r["term"]: r["c"] for r in in_clean.collect()}
    support = {t: (a, clean.get(t, 0)) for t, a in candidates.value.items()}
    strong = [t for t, (a, c) in support.items() if np.log((a + 0.5) / (n_toxic + 1)) - np.log((c + 0.5) / (n_clean + 1)) >= WEIGHT]
    if not strong:
        return Model(coefficients=(float(np.log((n_toxic + 0.5) / (n_clean + 0.5))), 0.0, 0.0))
    incidence = in_toxic.join(F.broadcast(spark.createDataFrame([(t,) for t in strong], "term string")), "term").toPandas()
    model = Model(choose_terms(support, incidence, n_toxic, n_clean))

    def phrases(batches):
        for pdf in batches:
            found = Counter()
            for toxic, text in zip(pdf["toxic"], pdf["text"]):
                words = folded(text)
                line = f" {' '.join(words)} "
                near = set()
                for at, _ in model.hits(words):
                    before, word, after = neighbours(line, at)
                    near |= {p for p in ((before, word), (word, after)) if all(p)}
                found.update((*p, int(toxic)) for p in near)
            yield pd.DataFrame([(*p, n) for p, n in found.items()], columns=["first", "second", "toxic", "n"])

    near = (dealt.select("text", "toxic").mapInPandas(phrases, "first string, second string, toxic int, n long")
            .groupBy("first", "second").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
                                            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"))
            .filter((F.col("c") >= PHRASE_SUPPORT) & (F.col("c") / n_clean > 2 * F.col("a") / n_toxic)))
    model.exceptions = frozenset((r["first"], r["second"]) for r in near.collect())

    def measured(batches):
        for pdf in batches:
            rows = [model.features(folded(t))[:2] for t in pdf["text"]]
            yield pd.DataFrame({"x": [r[0] for r in rows], "m": [r[1] for r in rows], "toxic": pdf["toxic"].astype(float)})

    # fit_rows rows of three numbers, about
    sample = dealt.select("text", "toxic").mapInPandas(measured, "x double, m double, toxic double").toPandas()
    model.coefficients = tuple(float(v) for v in logistic(sample[["x", "m"]].to_numpy(), sample["toxic"].to_numpy()))
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, n_hits, n_words of every row. Null and empty texts have no words and the
    score of a text without matches. Null and repeated ids stay. Other columns are ignored."""
    spark = df.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)
    slim = df.select(F.col(id_col).alias("rec_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in chunks(batch, "text"):
                words = [folded(t or "") for t in part.column("text").to_pylist()]
                found = [model.features(w) for w in words]
                scores = model.score([f[0] for f in found], [f[1] for f in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rec_id"), pa.array(scores, pa.float64()), pa.array([f[2] for f in found], pa.int64()),
                     pa.array([len(w) for w in words], pa.int64())], names=["rec_id", "score", "n_hits", "n_words"])

    out = slim.mapInArrow(run, f"rec_id {dict(slim.dtypes)['rec_id']}, score double, n_hits long, n_words long")
    return out.withColumnRenamed("rec_id", id_col)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; the model is fitted on the labels outside the held-out third."""
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "n_hits", "n_words")


def keep_clean(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``df`` whose score is below ``reject``, all columns as they are."""
    spark = df.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in chunks(batch, text_col):
                found = [model.features(folded(t or "")) for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(model.score([f[0] for f in found], [f[1] for f in found]) < reject))

    return df.mapInArrow(run, df.schema)
