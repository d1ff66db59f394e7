"""Licence scans: TF-IDF cosine to templates, then inheritance along directories.

Texts are cut into statements (lines, and sentences inside lines); consecutive ones
are also scored as one, as texts wrap their sentences, over as many lines as it takes
to pass a template's number of words. Templates are single sentences and whole
licence texts. A statement is a sparse TF-IDF vector over words; its cosine to every template's vector
decides whether it states that licence. Document frequencies of all words are
counted over all statements of the corpus. Tasks know those of the template words
and of the most frequent other words; the rarer ones weigh at least as much as the
rarest of these, which bounds a statement's length from below and its cosines from
above and rules nearly all statements out. The others' rare words get their
frequencies by a join.

A text with a statement has its own licence. A licence file is a text that
consists of such statements to a large part, or has a licence file's name; its
licence holds for its directory. A text without an own licence inherits that of
the nearest directory above it: directories, not files, are joined to their
ancestors, and files to their directory's result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, python_ready, stored, work_folder
from .ragged import chunks, distinct, span_hashes, strings, text_bytes, words_of

# Usual statements of common licences, and whole texts of the short ones.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain, CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
)
#: Least cosine of a statement.
COSINE = 0.8
#: Most frequent words outside the templates whose frequencies every task has.
FREQUENT = 20_000
#: Part of a text's words in licence statements that makes it a licence file.
FILE_PART = 0.3
#: Base names of licence files.
FILE_NAMES = r"(?i)^(un)?licen[cs]e|^copying|^notice"

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Templates:
    """Template words by hash, and the templates' word counts."""

    names: list[str]
    hashes: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(templates=TEMPLATES) -> "Templates":
        flat, at, size, bounds = lowered_words(pa.array([t for _, t in templates], pa.large_string()))[:4]
        found = span_hashes(flat, at, size)
        hashes, number = np.unique(found, return_inverse=True)
        counts = np.zeros((len(templates), len(hashes)))
        np.add.at(counts, (np.repeat(np.arange(len(templates)), np.diff(bounds)), number), 1)
        return Templates([n for n, _ in templates], hashes, counts)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Template word of each hash, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def lowered_words(texts: pa.Array):
    """(lower-cased bytes, starts, lengths, bounds of each text's words, bounds of the texts)."""
    flat, bounds = text_bytes(texts)
    flat = LOWER[flat]
    return flat, *words_of(flat, bounds, ~WORD_BYTE), bounds


def hashed_statements(texts: pa.Array):
    """(hash of every word, statement of every word, text of every statement); a statement without words does not count."""
    flat, at, size, words, bounds = lowered_words(texts)
    ends = flat == 10
    if len(flat) > 1:  # a sentence ends before white space
        stop = (flat[:-1] == 46) | (flat[:-1] == 33) | (flat[:-1] == 63)
        ends[:-1] |= stop & ((flat[1:] == 32) | (flat[1:] == 10))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(words))
    place = np.searchsorted(np.flatnonzero(ends), at)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    return span_hashes(flat, at, size), np.cumsum(new) - 1, text[new]


def word_frequencies(df: DataFrame, text_col: str, folder: str) -> tuple[int, DataFrame]:
    """(number of statements, (h, n): number of statements with each word, by the word's hash) over all rows."""
    python_ready(df.sparkSession)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, own, text = hashed_statements(strings(part.column("text")))
                number, words, _ = distinct(hashes)
                pairs = np.unique(own * max(len(words), 1) + number)
                counts = np.bincount(pairs % max(len(words), 1), minlength=len(words))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(words.astype(np.uint64).view(np.int64), 0), mask=np.append(np.zeros(len(words), bool), True)),
                    pa.array(np.append(counts, len(text)).astype(np.int64))], names=["h", "n"])

    found = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = stored(found, folder, "words")
    # the row without a word holds the statements
    total = found.filter("h is null").agg(F.sum("n")).first()[0] or 0
    return total, found.filter("h is not null")


def corpus_licences(df: DataFrame, keep: list[str], text_col: str, folder: str, cosine: float = COSINE, lines: int | None = None) -> DataFrame:
    """The columns ``keep`` with licence, score (the best statement's; null without one) and part (of
    the words in licence statements) of every row, by the TF-IDF cosine over all words. Statements in
    a row, up to ``lines`` if given, are also scored as one: against each template until they have as many words as
    it, the last statement counted in. Of overlapping ones the best counts, then the shortest."""
    templates = Templates.of()
    total, words = word_frequencies(df, text_col, folder)
    signed = templates.hashes.view(np.int64)
    seen = {r["h"]: r["n"] for r in words.filter(F.col("h").isin(signed.tolist())).collect()}  # one row per template word
    idf_of = lambda n: np.log((total + 1) / (np.asarray(n) + 1)) + 1
    idf = idf_of([seen.get(h, 0) for h in signed.tolist()])
    vectors = templates.counts * idf
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    words_of_template = templates.counts.sum(axis=1).astype(np.int64)
    gain = (vectors * idf).T  # of one occurrence of each template word, for each template
    top = words.filter(~F.col("h").isin(signed.tolist())).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    known = np.concatenate([templates.hashes, np.array([r["h"] for r in top], np.int64).view(np.uint64)])
    weight = np.concatenate([idf, idf_of([r["n"] for r in top]).reshape(-1)])
    order = np.argsort(known)
    known, weight = known[order], weight[order]
    rare = float(idf_of(top[-1]["n"])) if len(top) == FREQUENT else float(idf_of(0))
    table = df.sparkSession.sparkContext.broadcast((known, weight))
    slim = df.select(*keep, F.monotonically_increasing_id().alias("_text_no"), F.col(text_col).cast("string").alias("text"))
    kept = [c for c in slim.columns if c != "text"]
    unit = "struct<s:int,k:int,template:int,dot:double,base:double,size:int,rest:array<struct<h:long,n:int>>>"
    schema = ", ".join(f"{c} {t}" for c, t in slim.dtypes if c != "text") + f", _words long, _units array<{unit}>"
    unit_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("template", pa.int32()), ("dot", pa.float64()), ("base", pa.float64()),
                                    ("size", pa.int32()), ("rest", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])))]))

    def run(batches):
        known, weight = table.value
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, own, text = hashed_statements(strings(part.column("text")))
                word = templates.number(hashes)
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                common = known[at] == hashes
                each = np.where(common, weight[at], rare)
                n, found = len(text), [[] for _ in range(part.num_rows)]
                bounds = np.searchsorted(own, np.arange(n + 1))
                length = np.concatenate([[0], np.cumsum(each ** 2)])[bounds]
                hit = np.flatnonzero(word >= 0)
                dots = np.concatenate([np.zeros((1, gain.shape[1])), np.cumsum(gain[word[hit]], axis=0)])[np.searchsorted(hit, bounds)]
                first = np.searchsorted(text, np.arange(part.num_rows))
                begin, k = np.arange(n), 0
                while len(begin) and k != lines:
                    k += 1
                    begin = begin[begin + k <= n]
                    begin = begin[text[begin + k - 1] == text[begin]]
                    before = bounds[begin + k - 1] - bounds[begin]
                    begin, before = begin[before < words_of_template.max()], before[before < words_of_template.max()]
                    if not len(begin):
                        break
                    open_ = np.flatnonzero(words_of_template > before.min())
                    dot = np.where(before[:, None] < words_of_template[open_], dots[begin + k][:, open_] - dots[begin][:, open_], 0.0)
                    most = dot.max(1)
                    able = (most > 0) & (most ** 2 >= cosine ** 2 * (length[begin + k] - length[begin]) * (1 - 1e-6))
                    for i in np.flatnonzero(able).tolist():
                        s = int(begin[i])
                        a, b = int(bounds[s]), int(bounds[s + k])
                        _, where, times = np.unique(hashes[a:b], return_index=True, return_counts=True)
                        where += a
                        squares, sure = (times * each[where]) ** 2, common[where]
                        best = int(open_[dot[i].argmax()])
                        if most[i] ** 2 < cosine ** 2 * squares.sum() * (1 - 1e-6):
                            continue
                        rest = [{"h": h, "n": c} for h, c in zip(hashes[where[~sure]].view(np.int64).tolist(), times[~sure].tolist())]
                        found[text[s]].append({"s": s - int(first[text[s]]), "k": k, "template": best, "dot": float(most[i]),
                                               "base": float(squares[sure].sum()), "size": b - a, "rest": rest})
                size = np.bincount(text, np.diff(bounds), minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(size), pa.array(found, unit_type)], names=[*kept, "_words", "_units"])

    def best_of(batches):
        """The best unit of each text, and the words in units that overlap no better one; rows come by text, the best first."""
        now = None
        for pdf in batches:
            out = []
            for no, s, k, template, size, score in zip(*(pdf[c].tolist() for c in ("_text_no", "s", "k", "template", "size", "score"))):
                if now is None or now[0] != no:
                    if now is not None:
                        out.append(now)
                    now, taken = [no, template, score, 0], set()
                if taken.isdisjoint(range(s, s + k)):
                    taken.update(range(s, s + k))
                    now[3] += size
            yield pd.DataFrame(out, columns=["_no", "_best", "_score", "_inside"])
        yield pd.DataFrame([] if now is None else [now], columns=["_no", "_best", "_score", "_inside"])

    texts = stored(slim.mapInArrow(run, schema), folder, "texts")
    units = texts.filter(F.size("_units") > 0).select("_text_no", F.explode("_units").alias("u")).select("_text_no", "u.*")
    rest = units.select("_text_no", "s", "k", F.explode("rest").alias("r")).select("_text_no", "s", "k", F.col("r.h").alias("h"), F.col("r.n").alias("times"))
    square = F.pow(F.col("times") * (F.log(F.lit(float(total + 1)) / (F.col("n") + 1)) + 1), 2)
    rest = rest.join(words, "h").groupBy("_text_no", "s", "k").agg(F.sum(square).alias("more"))
    scored = units.drop("rest").join(rest, ["_text_no", "s", "k"], "left")
    scored = scored.withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("base") + F.coalesce("more", F.lit(0.0))), 9)).filter(F.col("score") >= cosine)
    ordered = scored.select("_text_no", "s", "k", "template", "size", "score").repartition("_text_no").sortWithinPartitions("_text_no", F.desc("score"), "k", "s")
    found = ordered.mapInPandas(best_of, "_no long, _best int, _score double, _inside long")
    names = F.array(*[F.lit(n) for n in templates.names])
    return texts.join(found, F.col("_text_no") == F.col("_no"), "left").select(
        *keep, F.when(F.col("_best").isNotNull(), F.get(names, F.col("_best"))).alias("licence"), F.col("_score").alias("score"),
        F.coalesce(F.col("_inside") / F.greatest("_words", F.lit(1)), F.lit(0.0)).alias("part"))


def directory(path) -> "F.Column":
    """The path up to its last slash, empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licences(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                  cosine: float = COSINE, file_part: float = FILE_PART) -> DataFrame:
    """id_col, path, licence, score, how (``own``, ``inherited`` or null) and from_directory of every row.

    A directory with several licence files has the licence of most of them, then of the best score,
    then the first by name. Null or empty text: no own licence. Null path: nothing to inherit, and no
    directory's licence. Repeated rows and ids: each row has its result. Empty input: no rows. Other
    columns are ignored.
    """
    folder = work_folder(df.sparkSession, "licences")
    slim = df.select(F.col(id_col).alias("rec_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    own = corpus_licences(slim, ["rec_id", "path"], "text", folder, cosine).withColumn("dir", directory(F.col("path")))
    own = stored(own, folder, "own")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    files = own.filter(F.col("licence").isNotNull() & F.col("path").isNotNull() & ((F.col("part") >= file_part) | name.rlike(FILE_NAMES)))
    best = Window.partitionBy("dir").orderBy(F.desc("n"), F.desc("best"), "licence")
    licensed = (files.groupBy("dir", "licence").agg(F.count("*").alias("n"), F.max("score").alias("best"))
                .withColumn("r", F.row_number().over(best)).filter("r = 1")
                .select(F.col("dir").alias("above"), F.col("licence").alias("dir_licence")))
    # every directory that needs a licence with all directories above it, itself included
    parts = F.split("dir", "/")
    depth = F.when(F.col("dir") == "", 0).otherwise(F.size(parts))
    above = (own.filter(F.col("licence").isNull() & F.col("path").isNotNull()).select("dir").distinct()
             .select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
             .withColumn("above", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/")))
    nearest = (above.join(licensed, "above").groupBy("dir")
               .agg(F.max_by(F.struct("above", "dir_licence"), "depth").alias("found"))
               .select("dir", "found.*"))
    out = own.join(nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    how = F.when(has, "own").when(F.col("path").isNotNull() & F.col("dir_licence").isNotNull(), "inherited")
    return out.select(F.col("rec_id").alias(id_col), "path", how.alias("how"),
                      F.when(has, F.col("licence")).when(how == "inherited", F.col("dir_licence")).alias("licence"),
                      "score", F.when(how == "inherited", F.col("above")).alias("from_directory"))


def op10_licences(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents. The table has no paths; a document's is made of its source, its
    language and the thousand that its id lies in."""
    docs = documents(spark, sf_dir)
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licences(docs.withColumn("path", path))
