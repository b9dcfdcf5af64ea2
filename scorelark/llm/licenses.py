"""Licence scans by diagonal voting, in DataFrame operations only.

Every run of ``k`` words of a text is hashed and joined to the places of the
same run in the templates; a hit counts only if its words, not just its hash,
are the template's. A hit votes for the diagonal on which it lies: the word's
place in the text less the run's place in the template. Votes are gathered by
template and diagonal. Inserted or missing words shift what follows to another
diagonal, so neighbouring diagonals merge: those from one on that lie no further
apart than the words by which a span may outgrow its template, ``STRETCH`` times
its length in all. Such a band can't chain, whatever repeats beside it. A span
is verified if its runs cover ``COVER`` of the template's. A short phrase counts
where all its runs lie on one diagonal: where its words stand consecutively.

Short templates are cut into pairs of words, templates of ``LONG`` words or more
into runs of four, as pairs like "of the" are everywhere. The templates are a
parameter of at most ``MAX_RUNS`` runs, so the joined side is broadcast.

Rows are gathered by id and text: repeated rows vote the same votes once, and
each gets its row. A null text counts as an empty one: no words, no labels,
score 0. A very long text is cut into stretches of ``STRETCH_WORDS`` words that
overlap by a run, so no row grows with it. An empty table gives no rows. Of
templates with the same label, and of hits at the same place, all count. Extra
columns stay out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label, text: phrases that count wherever they stand whole. Fixed values.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: label, text: notices and licence texts that count where most of them stands.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License."""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
        specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED."""),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
        NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely."""),
)
COVER, STRETCH = 0.8, 1.5
#: Words of a template from which on it is cut into the longer runs; the two lengths of runs.
LONG, RUNS = 24, (2, 4)
MAX_RUNS = 100_000
STRETCH_WORDS = 4096
#: The frame of a band; gaps below its square root keep their order in it.
FRAME, MOST_GAP = 1 << 31, 46_000
#: The hash that every text has once, so that texts without a hit keep their row.
EACH = -1


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]


def _cut(phrases, templates) -> list[tuple[int, str, list[str], int, int, bool]]:
    """(number, label, words, k, gap, phrase) of every template."""
    out = []
    for tpl, (label, text, phrase) in enumerate([(*x, True) for x in phrases] + [(*x, False) for x in templates]):
        words = plain_words(text)
        if len(words) < 2:
            raise ValueError(f"a template has two words or more: {text}")
        out.append((tpl, label, words, RUNS[len(words) >= LONG and not phrase], min(MOST_GAP, max(1, int(len(words) * (STRETCH - 1)))), phrase))
    return out


def _runs(spark: SparkSession, phrases, templates) -> DataFrame:
    """(h, run, tpl, label, at, size, k, gap, phrase): every run of words of the templates."""
    rows = [([], EACH, "", 0, 0, 0, 1, False)]
    for tpl, label, words, k, gap, phrase in _cut(phrases, templates):
        rows += [(words[at : at + k], tpl, label, at, len(words) - k + 1, k, gap, phrase) for at in range(len(words) - k + 1)]
    if len(rows) > MAX_RUNS:
        raise ValueError(f"{len(rows)} runs of words; templates of up to {MAX_RUNS} are broadcast")
    frame = spark.createDataFrame(rows, "run array<string>, tpl int, label string, at int, size int, k int, gap int, phrase boolean")
    hashes = [F.when(F.col("k") == k, F.xxhash64(*(F.get("run", F.lit(i)) for i in range(k)))) for k in RUNS]
    return frame.withColumn("h", F.coalesce(*hashes, F.lit(EACH).cast("long")))


def words_of(text):
    """The words of a text column, A-Z in lower case. (lower() takes the Kelvin sign to k, so it goes first.)"""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00e9"))), SEPARATORS), "")


KEY = ["__id", "__text", "n_words"]


def _votes(docs: DataFrame, phrases, templates, id_col: str, text_col: str) -> DataFrame:
    """A row a text, template and diagonal: ``ats`` (places of the template that it has), ``low`` and ``high`` words, ``copies``; and a row of ``EACH`` a text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__text"), words_of(text).alias("w"))
    more = max(RUNS) - 1
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(STRETCH_WORDS)), lambda i: F.struct(i.alias("from"), F.slice("w", i + 1, F.lit(STRETCH_WORDS + more)).alias("w")))
    stretches = F.when(F.size("w") <= STRETCH_WORDS, F.array(F.struct(F.lit(0).alias("from"), F.col("w")))).otherwise(parts)
    # outer forms: for inner ones the optimiser adds a filter that splits the text again
    cut = given.select("__id", "__text", F.size("w").cast("long").alias("n_words"), F.explode_outer(stretches).alias("s")).select(*KEY, F.col("s.from").alias("from"), F.col("s.w").alias("w"))

    def hashes(k: int):
        return F.transform("w", lambda x, i: F.when(i < STRETCH_WORDS, F.xxhash64(x, *(F.get("w", i + j) for j in range(1, k)))))

    each = F.when(F.col("from") == 0, F.lit(EACH).cast("long"))
    rolled = cut.withColumn("h", F.concat(F.array(each), *map(hashes, RUNS))).select(*KEY, "from", "w", F.posexplode_outer("h").alias("pos", "h"))
    # the hash is the key; the words decide. They are looked up for hits only: the array goes along by reference
    hits = rolled.join(F.broadcast(_runs(docs.sparkSession, phrases, templates)), "h")
    place = F.pmod(F.col("pos") - 1, F.greatest(F.size("w"), F.lit(1)))
    hits = hits.where((F.col("tpl") == EACH) | (F.slice("w", place + 1, F.col("k")) == F.col("run")))
    word = (F.col("from") + place).cast("long")
    at = hits.select(*KEY, "tpl", "label", "size", "k", "gap", "phrase", "at", F.when(F.col("tpl") == EACH, 0).otherwise(word).alias("word"))
    # a text's hits come from one task, so they are gathered there before they move
    return at.groupBy(*KEY, "tpl", "label", "size", "k", "gap", "phrase", (F.col("word") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("word").alias("low"), F.max("word").alias("high"), F.count("*").alias("copies"))


def _scaled():
    """Diagonals in units of their template's gap, so that one frame serves all: they are within ``FRAME`` exactly if they are within the gap."""
    return F.col("diagonal") * F.floor(F.lit(FRAME) / F.col("gap"))


def _bands(votes: DataFrame) -> DataFrame:
    """``votes`` with what the band of diagonals from each on holds: ``share`` (null unless verified), ``start`` and ``end`` words."""
    band = Window.partitionBy(*KEY, "tpl").orderBy(_scaled()).rangeBetween(0, FRAME)
    held = F.size(F.array_distinct(F.flatten(F.collect_list("ats").over(band))))
    share = F.when(F.col("phrase"), (F.size("ats") == F.col("size")).cast("double")).when(F.col("size") > 0, held / F.col("size"))
    out = votes.withColumns({"held": share, "start": F.min("low").over(band), "end": F.max(F.col("high") + F.col("k")).over(band)})
    return out.withColumn("share", F.when(F.col("held") >= COVER, F.col("held"))).drop("held")


def spans(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a verified span: ``id_col``, ``label``, ``start_word``, ``end_word`` (exclusive), ``share``; of overlapping bands of a template the best, the first on a tie."""
    found = _bands(_votes(docs, phrases, templates, id_col, text_col)).where("share is not null")
    near = Window.partitionBy(*KEY, "tpl").orderBy(_scaled()).rangeBetween(-FRAME, FRAME)
    best = found.withColumn("best", F.max(F.struct("share", -F.col("diagonal"))).over(near)).where(F.col("phrase") | (F.col("best") == F.struct("share", -F.col("diagonal"))))
    end = F.when(F.col("phrase"), F.col("diagonal") + F.col("size") + 1).otherwise(F.col("end"))
    start = F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.col("start"))
    return best.select(F.col("__id").alias(id_col), "label", start.alias("start_word"), end.cast("long").alias("end_word"), "share")


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``score`` is the largest share of a found template that the text holds.
    """
    found = _bands(_votes(docs, phrases, templates, id_col, text_col))
    place = F.col("phrase") & F.col("share").isNotNull()
    rows = found.groupBy(*KEY).agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("diagonal"))).alias("first_word"), F.max(F.when(place, F.col("diagonal"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("share").isNotNull(), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.max(F.when(F.col("tpl") == EACH, F.col("copies"))).alias("copies"),
    )
    out = [F.col("__id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return rows.select(*out, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy")).drop("__copy")


def oracle() -> str:
    """The same rows in DuckDB's SQL, for tables with an id a row: phrases are sought word by word, bands by a join of diagonals."""
    cut = _cut(PHRASES, TEMPLATES)
    base = ", ".join(f"('{label}', {words!r})" for _, label, words, _, _, phrase in cut if phrase)
    long = ", ".join(f"({tpl}, '{label}', {words!r}, {k}, {gap})" for tpl, label, words, k, gap, phrase in cut if not phrase)
    return f"""
WITH p AS (SELECT * FROM (VALUES {base}) AS x(label, w)),
t AS (SELECT * FROM (VALUES {long}) AS x(tpl, label, w, k, gap)),
tp AS (SELECT tpl, k, i AS spot, array_to_string(list_slice(w, i + 1, i + k), ' ') AS run FROM (SELECT *, unnest(range(len(w) - k + 1)) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT doc_id, label, i FROM (SELECT doc_id, p.label, p.w AS pw, d.w, unnest(list_filter(range(len(d.w)), lambda i: d.w[i + 1] = p.w[1])) AS i FROM d, p) WHERE list_slice(w, i + 1, i + len(pw)) = pw),
br AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
dp AS (SELECT doc_id, 2 AS k, i AS word, w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT *, unnest(range(len(w) - 1)) AS i FROM d)
       UNION ALL SELECT doc_id, 4, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FROM (SELECT *, unnest(range(len(w) - 3)) AS i FROM d)),
h AS (SELECT DISTINCT doc_id, tpl, spot, word - spot AS diagonal FROM dp JOIN tp USING (k, run)),
g AS (SELECT DISTINCT doc_id, tpl, diagonal FROM h),
s AS (SELECT g.doc_id, g.tpl, g.diagonal, count(DISTINCT h.spot) AS covered FROM g JOIN t USING (tpl) JOIN h ON h.doc_id = g.doc_id AND h.tpl = g.tpl AND h.diagonal BETWEEN g.diagonal AND g.diagonal + t.gap GROUP BY ALL),
f AS (SELECT doc_id, label, covered::DOUBLE / (len(w) - k + 1) AS share FROM s JOIN t USING (tpl) WHERE covered::DOUBLE / (len(w) - k + 1) >= {COVER}::DOUBLE),
u AS (SELECT doc_id, label, share FROM f UNION ALL SELECT DISTINCT doc_id, label, 1.0::DOUBLE FROM b),
r AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN br USING (doc_id) LEFT JOIN r USING (doc_id)
"""
