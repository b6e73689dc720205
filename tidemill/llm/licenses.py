"""License scans by exact set-similarity search for notice templates (operator 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemill.llm.common import documents

#: Label and words of each notice (fixed values: sentences of the public licence texts, cut to at most STRIDE words).
TEMPLATES = (
    ("afl", "licensed under the academic free license version 3 0"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl", "if your software can interact with users remotely through a computer network you should also make sure that it provides a way for users to get its source"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "see the license for the specific language governing permissions and limitations under the license"),
    ("artistic", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed artistic license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("eupl", "licensed under the european union public licence you may not use this work except in compliance with the licence"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
)
#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Blocks are BLOCK words long and start every STRIDE words, so each run of STRIDE words lies whole in one.
BLOCK, STRIDE = 64, 32


def words_of(text: str) -> Column:
    """The words of a text in lower case; null and empty: none.

    lower() also folds letters beyond A-Z, which neither joins nor splits words nor makes one of the phrases' words.
    """
    joined = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def need(size: int, threshold: float = THRESHOLD) -> int:
    return -int(-size * threshold // 1)


def token_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The templates' words from the rarest to the most frequent, by the documents of the whole table that hold them."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    held = F.array_distinct(F.filter(words_of("text"), lambda w: w.isin(vocabulary)))
    counts = docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # a row for each template word at most
    count = {r["w"]: r["count"] for r in counts}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def index_of(spark: SparkSession, order: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The templates (tid, label, tokens, size, need) with their tokens as ranks in `order`, and the postings of their
    prefixes (rank, tid, place, size, need): a template that a block holds shares the rarest shared token within its prefix."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for tid, (label, text) in enumerate(templates):
        tokens = sorted(rank[w] for w in set(text.split()))
        rows.append((tid, label, tokens, len(tokens), need(len(tokens), threshold)))
    table = spark.createDataFrame(rows, "tid int, label string, tokens array<int>, size int, need int")
    prefix = F.slice("tokens", F.lit(1), F.col("size") - F.col("need") + 1)
    return table, table.select("tid", "size", "need", F.posexplode(prefix).alias("place", "rank"))


def _blocks(words: Column) -> Column:
    n = F.size(words)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((n - STRIDE) / STRIDE).cast("int") - 1, F.lit(0))), lambda b: F.slice(words, b * STRIDE + 1, F.lit(BLOCK)))


def _keys() -> list[Column]:
    """What tells rows apart that differ in doc_id or text; never null."""
    return [F.xxhash64("doc_id").alias("k1"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("k2")]


def similar(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """k1, k2 (of a row), block, label, share: every block that holds `threshold` of a template's distinct words, verified.

    An equi-join of the tokens in the blocks' prefixes with the postings of the templates' prefixes, under one global order
    from the rarest word of all documents. A pair is dropped unless the block has enough tokens (length) and both have
    enough of them from the first shared one on (position); what is left is verified. Only blocks that hold a word of some
    prefix are cut out of the scan. The template side is a parameter and grows with no table.
    """
    spark = docs.sparkSession
    order = token_order(docs, templates)
    table, postings = index_of(spark, order, templates, threshold)
    least = min((need(len(set(t.split())), threshold) for _, t in templates), default=1)
    rare = sorted({order[r["rank"]] for r in postings.select("rank").distinct().collect()})
    vocabulary = spark.createDataFrame(list(enumerate(order)), "rank int, word string")
    words = F.col("words")
    likely = F.filter(_blocks(words), lambda b: F.exists(b, lambda w: w.isin(rare)))
    found = docs.select(*_keys(), words_of("text").alias("words")).filter(F.exists(words, lambda w: w.isin(rare)))
    found = found.select("k1", "k2", F.posexplode(F.transform(likely, F.array_distinct)).alias("block", "words"))
    ranks = found.select("k1", "k2", "block", F.explode("words").alias("word")).join(F.broadcast(vocabulary), "word")  # the templates' words
    held = ranks.groupBy("k1", "k2", "block").agg(F.array_sort(F.collect_set("rank")).alias("held"))  # BLOCK ranks at most
    held = held.filter(F.size("held") >= least)
    prefix = F.slice("held", F.lit(1), F.size("held") - least + 1)
    pairs = held.select("k1", "k2", "block", "held", F.posexplode(prefix).alias("at", "rank")).join(F.broadcast(postings), "rank")
    first = pairs.groupBy("k1", "k2", "block", "tid").agg(F.min("at").alias("at"), F.min("place").alias("place"), F.first("held").alias("held"), F.first("size").alias("size"), F.first("need").alias("need"))
    first = first.filter((F.size("held") >= F.col("need")) & (F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at")) >= F.col("need")))
    shared = F.size(F.array_intersect("tokens", "held"))
    met = first.join(F.broadcast(table.select("tid", "label", "tokens")), "tid").filter(shared >= F.col("need"))
    return met.select("k1", "k2", "block", "label", (shared / F.col("size")).alias("share"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """For each row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels come from the phrases mit license, apache license and general public license, the others from a set-similarity
    join of blocks of words with templates (see similar). score is the largest containment met, 1 for a phrase, 0 where
    nothing is met. Null and empty texts have no words; repeated rows and null ids come out as they are, and other columns
    are ignored.
    """
    words = F.col("words")
    n = F.size(words)
    at = lambda i: F.get(words, i)
    phrase = lambda i: F.when(at(i - 1).isin("mit", "apache"), i - 1).when((at(i - 1) == "public") & (at(i - 2) == "general"), i - 2)
    ends = F.filter(F.sequence(F.lit(0), n - 1), lambda i: at(i) == "license")
    starts = F.filter(F.transform(ends, phrase), lambda s: s.isNotNull())
    none = F.array().cast("array<int>")
    label = lambda s: F.when(at(s) == "general", "gpl").otherwise(at(s))

    out = docs.select("doc_id", *_keys(), words_of("text").alias("words"))
    out = out.select("doc_id", "k1", "k2", n.cast("bigint").alias("n_words"), "words", F.when(F.array_contains(words, "license"), starts).otherwise(none).alias("starts"))
    out = out.select("doc_id", "k1", "k2", "n_words", "starts", F.array_sort(F.array_distinct(F.transform("starts", label))).alias("base"))
    met = similar(docs, templates, threshold).groupBy("k1", "k2").agg(F.collect_set("label").alias("met"), F.max("share").alias("share"))
    joined = out.join(met, ["k1", "k2"], "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))))
    return joined.select(
        "doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"), F.array_max("starts").cast("bigint").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over all documents: phrases, notice labels and the largest containment of each row."""
    return scan(documents(spark, sf_dir))


OP1_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS tid, label, list_distinct(string_split(words, ' ')) AS tokens
  FROM (VALUES {', '.join(f"('{label}', '{text}')" for label, text in TEMPLATES)}) AS v(label, words)),
d AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
spots AS (
  SELECT doc_id, unnest(list_filter(list_transform(range(1, len(w) + 1), lambda i:
    CASE WHEN w[i] <> 'license' OR i < 2 THEN NULL
      WHEN w[i - 1] = 'mit' THEN {{'s': i - 2, 'l': 'mit'}}
      WHEN w[i - 1] = 'apache' THEN {{'s': i - 2, 'l': 'apache'}}
      WHEN i > 2 AND w[i - 1] = 'public' AND w[i - 2] = 'general' THEN {{'s': i - 3, 'l': 'gpl'}} END), lambda p: p IS NOT NULL)) AS p FROM d),
base AS (SELECT doc_id, count(*) AS n, min(p.s) AS f, max(p.s) AS l, list(DISTINCT p.l) AS labels FROM spots GROUP BY doc_id),
blocks AS (SELECT doc_id, list_distinct(list_slice(w, b * {STRIDE} + 1, b * {STRIDE} + {BLOCK})) AS b
  FROM (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - {STRIDE}) / {STRIDE}.0) AS INT), 1))) AS b FROM d)),
met AS (SELECT doc_id, max(c) AS c, list(DISTINCT label) AS labels FROM (
  SELECT doc_id, label, len(list_intersect(b, tokens)) AS n, len(tokens) AS m, len(list_intersect(b, tokens)) / len(tokens) AS c FROM blocks, t)
  WHERE n >= ceil(m * {THRESHOLD}) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
  CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(met.labels, [])))), ',') AS labels,
  CAST(CASE WHEN base.n > 0 THEN 1 ELSE coalesce(met.c, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN met USING (doc_id)
"""
