"""License scan: base phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of digits, a-z and non-ASCII characters after A-Z went to lower case. A text has the label of a template
if some block of its words contains at least THRESHOLD of the template's distinct words. Blocks start at every word, and
are twice as long as the template (LEAST_BLOCK words at least), so a block holds any template whole.

The join is exact. The distinct template words are ordered by how often they occur in all documents, rarest first.
A template of n words needs at least r = ceil(THRESHOLD * n) of them, so a block must contain one of its first
n - r + 1 words (prefix filter). Around each such word, the words of the text that the templates know are taken, as far
as a block reaches; they must be at least r (length filter), and what stands before and after the common word in the
order must leave enough (positional filter). For what passes, a block is made at each word of the template from which
the common word can be reached, which is where the best block starts, and verified by intersecting the sets. Templates
are a bounded parameter (MAX_TEMPLATE_WORDS) and are joined by broadcast. DataFrame operations only.

Null text is empty text: no words, no labels, score 0. Repeated rows are rows of their own. Empty input gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, documents, materialize

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices and whole texts of public licenses.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("you can redistribute it and or modify it under the terms of the gnu", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("dedicated to the public domain", "public-domain"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
        "of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit-text",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever "
        "resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        "isc-text",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http "
        "www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0-notice",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the "
        "gnu general public license along with this program if not see http www gnu org licenses",
        "gpl-3.0-notice",
    ),
)
THRESHOLD = 0.8
LEAST_BLOCK = 32
MAX_TEMPLATE_WORDS = 4096
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, words."""
    pieces = F.split(ascii_lower(F.col(text_col)), _SPLIT)
    # Only the first and the last piece can be empty.
    first = F.when(F.element_at("pieces", 1) == "", 2).otherwise(1)
    last = F.size("pieces") - F.when(F.element_at("pieces", -1) == "", 1).otherwise(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), pieces.alias("pieces"))
    return rows.select("doc_id", F.slice("pieces", first, F.greatest(last - first + 1, F.lit(0))).alias("words"))


def _hits(words, vocabulary: list[str]):
    """(at, w) of the words of the vocabulary; w: number in the vocabulary."""
    number = F.create_map(*[F.lit(x) for i, w in enumerate(vocabulary) for x in (w, i)])
    placed = F.transform(words, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), number[w].alias("w"))))
    return F.filter(placed, lambda x: x.isNotNull())


def _phrase_places(hits, phrase: list[int]):
    """Starts of a phrase, from the hits of all phrase and template words in order."""
    n = len(phrase)

    def begins(x, i):
        found = x["w"] == phrase[0]
        for k in range(1, n):
            nxt = F.get(hits, i + k)
            found = found & (nxt["w"] == phrase[k]) & (nxt["at"] == x["at"] + k)
        return F.coalesce(found, F.lit(False))

    return F.transform(F.filter(hits, begins), lambda x: x["at"])


def word_order(found: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first over all documents; words as rare as each other by name. Bounded by the templates."""
    seen = found.select(F.explode("hits").alias("h")).groupBy(F.col("h.w").alias("w")).count()
    counts = {vocabulary[r["w"]]: r["count"] for r in seen.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def block_size(template: str, least: int = LEAST_BLOCK) -> int:
    return max(least, 2 * len(template.split()))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, least_block: int = LEAST_BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score: 1 with a base phrase, else the largest containment of a template in a block that met the threshold, else 0.
    spans: (label, first word, words, containment) of the first of the best blocks of each template that met it.
    """
    spark = docs.sparkSession
    sets = [(i, sorted(set(t.split())), label, block_size(t, least_block)) for i, (t, label) in enumerate(templates)]
    vocabulary = sorted({w for _, t, *_ in sets for w in t} | {w for p, _ in phrases for w in p.split()})
    assert len(vocabulary) <= MAX_TEMPLATE_WORDS, "templates are broadcast, so they are bounded"

    words = _words(docs, id_col, text_col).withColumn("hits", _hits(F.col("words"), vocabulary))
    words = words.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), "hits")
    words = materialize(words, "license-hits")  # the texts are split once; each row keeps the number it has got here
    rank = {w: i for i, w in enumerate(word_order(words, vocabulary))}
    rank_of = F.array(*[F.lit(rank[w]) for w in vocabulary])

    index = []
    for i, t, label, size in sets:
        ranks, need = sorted(rank[w] for w in t), math.ceil(threshold * len(t) - 1e-9)
        # The prefix: without one of these words, too few of the others are left.
        index += [(r, i, at, ranks, need, label, size) for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    probed = [i for i, w in enumerate(vocabulary) if rank[w] in {r for r, *_ in index}]
    index = spark.createDataFrame(index, "rank int, template int, at int, ranks array<int>, need int, label string, size int")

    # The hits that a block with this one can hold: a block of so many words has so many hits at most.
    most = max((size for *_, size in sets), default=0)
    near = lambda i: F.transform(F.slice("hits", F.greatest(i - most + 2, F.lit(1)), 2 * most - 1), lambda y: F.struct(y["at"].alias("at"), F.get(rank_of, y["w"]).alias("rank")))
    probes = F.filter(F.transform("hits", lambda x, i: F.when(x["w"].isin(probed), F.struct(x["at"].alias("p"), F.get(rank_of, x["w"]).alias("rank"), near(i).alias("near")))), lambda x: x.isNotNull())
    met = words.where(F.size("hits") > 0).select("row", F.explode(probes).alias("x")).select("row", "x.*").join(F.broadcast(index), "rank")
    met = met.withColumn("near", F.filter("near", lambda y: (F.abs(y["at"] - F.col("p")) < F.col("size")) & F.array_contains(F.col("ranks"), y["rank"])))
    tokens = F.array_sort(F.array_distinct(F.transform("near", lambda y: y["rank"])))
    met = met.withColumn("tokens", tokens).where(F.size("tokens") >= F.col("need"))  # length filter
    place = F.array_position("tokens", F.col("rank")) - 1
    left = F.least(F.size("tokens") - place, F.size("ranks") - F.col("at"))
    met = met.where(left + F.least(place, F.col("at")) >= F.col("need"))  # positional filter
    starts = F.array_distinct(F.transform(F.filter("near", lambda y: y["at"] <= F.col("p")), lambda y: y["at"]))
    met = met.select("row", "template", "label", "ranks", "need", "size", "near", F.explode(starts).alias("start"))
    block = F.transform(F.filter("near", lambda y: (y["at"] >= F.col("start")) & (y["at"] < F.col("start") + F.col("size"))), lambda y: y["rank"])
    common = F.size(F.array_intersect(block, F.col("ranks")))
    met = met.select("row", "template", "label", "start", "size", (common / F.size("ranks")).alias("containment"), common.alias("common"), "need").where("common >= need")
    met = met.groupBy("row", "template", "label", "size").agg(F.max(F.struct("containment", (-F.col("start")).alias("start"))).alias("best"))
    span = F.struct("label", (-F.col("best.start")).alias("first_word"), F.col("size").alias("n_words"), F.col("best.containment").alias("containment"))
    met = met.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))

    joined = words.join(met.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left")
    for k, (p, _) in enumerate(phrases):
        joined = joined.withColumn(f"p{k}", _phrase_places(F.col("hits"), [vocabulary.index(w) for w in p.split()]))
    places = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    spans = F.coalesce("spans", F.array().cast("array<struct<label:string,first_word:int,n_words:int,containment:double>>"))
    added = F.transform(spans, lambda x: x["label"])
    joined = joined.withColumns({"places": places, "base": F.array_sort(F.array_distinct(base)), "spans": spans, "added": added})
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat("base", "added"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["containment"])), F.lit(0.0))).alias("score"), "spans",
    )


def query(spark, sf_dir):
    return license_scan(documents(spark, sf_dir)).drop("spans")


def _sql() -> str:
    phrases = ",".join(f"('{p}', '{label}')" for p, label in PHRASES)
    templates = ",".join(f"({i}, {sorted(set(t.split()))}, '{label}', {block_size(t)})" for i, (t, label) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
p(phrase, label) AS (VALUES {phrases}),
places AS (
  SELECT id, label, i FROM (SELECT id, w, unnest(range(len(w))) AS i FROM d), p
  WHERE w[i + 1] = string_split(phrase, ' ')[1] AND array_to_string(w[i + 1:i + len(string_split(phrase, ' '))], ' ') = phrase
),
b AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY id),
t(template, words, label, size) AS (VALUES {templates}),
v AS (SELECT template, unnest(words) AS word FROM t),
starts AS (SELECT id, template, i FROM (SELECT id, w, unnest(range(len(w))) AS i FROM d) AS x JOIN v ON w[i + 1] = word),
m AS (
  SELECT id, label, len(list_intersect(words, w[i + 1:i + size])) / len(words) AS c FROM starts JOIN t USING (template) JOIN d USING (id)
  WHERE len(list_intersect(words, w[i + 1:i + size])) >= ceil({THRESHOLD} * len(words) - 1e-9)
),
a AS (SELECT id, max(c) AS c, list(DISTINCT label) AS labels FROM m GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(a.labels, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(a.c, 0.0) END AS score
FROM d LEFT JOIN b USING (id) LEFT JOIN a USING (id)
"""


SQL = _sql()
