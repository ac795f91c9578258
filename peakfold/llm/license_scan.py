"""License scans by diagonal voting."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BoundedFilter, documents, giving_back, small_batches, written
from .textops import _LOWER, buffers, chunks, rolling, span_hashes, word_spans

K = 4  # words of a run that votes
LEAST = 0.8  # share of a template's words that a span must have
SHIFT = 3  # diagonals this near are one span with words put in or left out

#: Words are runs of a-z, 0-9 and characters beyond ASCII.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

# The phrases that must be found, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Rows of the template table up to which it is broadcast (some 100 bytes each); a larger one is joined.
MOST_ROWS = 200_000

# Labels of the whole license texts in the folder ``licenses``, as their publishers give them.
WHOLE = {
    "apache-2.0": "apache-2.0", "cc0-1.0": "cc0", "gpl-2.0": "gpl", "gpl-3.0": "gpl", "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "mpl-2.0": "mpl-2.0",
}

# Notices and texts of well-known licenses, with the labels the method adds.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"""),
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files"""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at"""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation"""),
    ("gpl", """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely"""),
    ("reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
]


def _words(data: np.ndarray, offs: np.ndarray):
    """Lower-cased bytes, starts and ends of the words, each row's first word, and the words' hashes."""
    low = _LOWER[data]
    starts, ends, at = word_spans(low, offs, APART)
    return low, starts, ends, at, span_hashes(low, starts, ends)


@cache
def templates() -> list[tuple[str, str]]:
    """(label, text) of all notices and whole texts."""
    folder = Path(__file__).with_name("licenses")
    return TEMPLATES + [(label, (folder / f"{name}.txt").read_text()) for name, label in WHOLE.items()]


def _template_rows(known: list[tuple[str, str]]) -> list[tuple]:
    """(template, j, hash, words of the run, words of the template, label) of each run of ``K`` words."""
    low, starts, ends, at, hashes = _words(*buffers(pa.array([text for _, text in known])))
    run, out = rolling(hashes, K), []
    for n, (label, _) in enumerate(known):
        size = int(at[n + 1] - at[n])
        for j in range(size - K + 1):
            i = int(at[n]) + j
            out.append((n, j, int(run[i].astype(np.int64)), b" ".join(low[starts[x] : ends[x]].tobytes() for x in range(i, i + K)).decode(), size, label))
    return out


_VOTE = pa.struct([("at", pa.int64()), ("hash", pa.int64()), ("run", pa.string())])
_OUT = "row long, doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, votes array<struct<at:long,hash:long,run:string>>"


def _scanned(known: BoundedFilter, phrases: list[tuple[list[bytes], str]]):
    """Of each text, the words, the places of the phrases, and the runs of words whose hash a template may
    have by a filter of bounded size."""
    firsts = [span_hashes(np.frombuffer(b" ".join(p), np.uint8), *_spans(p)) for p, _ in phrases]

    def scan(batches):
        for batch in batches:
            rows = []
            for i, j, data, offs in chunks(batch.column("text")):
                low, starts, ends, at, hashes = _words(data, offs)
                word = lambda x: low[starts[x] : ends[x]].tobytes()  # noqa: E731, B023
                places: dict[int, list] = {}
                for (phrase, label), want in zip(phrases, firsts):
                    n = len(hashes) - len(phrase) + 1
                    hit = np.ones(max(n, 0), bool)
                    for k, h in enumerate(want):
                        hit &= hashes[k : k + len(hit)] == h
                    for x in np.flatnonzero(hit).tolist():
                        row = int(np.searchsorted(at, x, "right")) - 1
                        if x + len(phrase) <= at[row + 1] and all(word(x + k) == w for k, w in enumerate(phrase)):
                            places.setdefault(row, []).append((x - int(at[row]), label))
                run = rolling(hashes, K)
                votes: dict[int, list] = {}
                if len(run):
                    for x in np.flatnonzero(known.may_hold(run.astype(np.int64))).tolist():
                        row = int(np.searchsorted(at, x, "right")) - 1
                        if x + K <= at[row + 1]:
                            votes.setdefault(row, []).append({"at": x - int(at[row]), "hash": int(run[x].astype(np.int64)), "run": b" ".join(word(x + k) for k in range(K)).decode()})
                for r in range(j - i):
                    found = places.get(r, [])
                    where = [x for x, _ in found]
                    rows.append((int(at[r + 1] - at[r]), len(found), min(where, default=None), max(where, default=None), ",".join(sorted({x for _, x in found})), votes.get(r, [])))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((*[pa.int64()] * 4, pa.string(), pa.list_(_VOTE)))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *cols], ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "votes"])

    return scan


def _spans(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1
    return ends - size, ends


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    The runs of ``K`` words of every text are hashed in one rolling pass.  All but those that no template
    can have are votes: a Bloom filter, of 4 MB at most whatever the number of templates, keeps the rest
    from being written, and misses none.  Which runs a template has is decided by Spark, which joins them
    to the template positions by hash and by the words themselves.  A vote at word i for place j of a
    template lies on diagonal i - j.  Votes are summed by diagonal, diagonals within ``SHIFT`` of each
    other are merged, and a merged span counts if the runs found in it have ``LEAST`` of the template's
    words, each compared as text.  score is the largest share any template has, 1 with a base phrase, 0
    with none.  The base is found by the phrases' own words.

    Null text is empty; texts without words have n_words 0 and no labels; a very long text is scanned
    whole, in memory of about 60 times its bytes; rows that repeat are each scanned; null ids stay;
    columns but doc_id and text are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _template_rows(templates() if known is None else known)
    table = spark.createDataFrame(rows, "template int, j long, hash long, run string, size long, label string")
    held_hashes = BoundedFilter.of(spark, np.unique(np.array([r[2] for r in rows], np.int64)))
    phrases = [([w.encode() for w in phrase.split()], label) for phrase, label in BASE.items()]
    each = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = written(each.mapInArrow(giving_back(_scanned(held_hashes, phrases)), _OUT.format(docs.schema["doc_id"].dataType.simpleString())), "scanned")
    votes = base.select("row", F.explode("votes").alias("v")).select("row", "v.*").join(F.broadcast(table) if len(rows) <= MOST_ROWS else table, ["hash", "run"])
    lines = votes.groupBy("row", "template", (F.col("at") - F.col("j")).alias("diagonal")).agg(F.collect_set("j").alias("js"), F.first("size").alias("size"), F.first("label").alias("label"))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > SHIFT, F.lit(True))
    spans = lines.withColumn("span", F.sum(apart.cast("int")).over(along)).groupBy("row", "template", "span")
    spans = spans.agg(F.first("size").alias("size"), F.first("label").alias("label"), F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"))
    held = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + K - 1)))))
    spans = spans.select("row", "label", (held / F.col("size")).alias("share"))
    found = spans.groupBy("row").agg(F.max("share").alias("share"), F.collect_set(F.when(F.col("share") >= LEAST, F.col("label"))).alias("more"))
    out = base.drop("votes").join(found, "row", "left")
    labels = F.array_union(F.filter(F.split("base_labels", ","), lambda x: x != ""), F.coalesce("more", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


BASE_SQL = r"""
WITH phrases AS (
  SELECT string_split(phrase, ' ') AS p, label FROM (VALUES ('cc by', 'cc-by'), ('general public license', 'gpl'), ('all rights reserved', 'reserved')) t(phrase, label)),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, i - 1 AS place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words) JOIN phrases ON w[i:i + len(p) - 1] = p)
SELECT doc_id, len(w)::BIGINT AS n_words, count(place)::BIGINT AS n_base, coalesce(min(place), -1)::BIGINT AS first_word, coalesce(max(place), -1)::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM words LEFT JOIN places USING (doc_id) GROUP BY doc_id, w
"""
