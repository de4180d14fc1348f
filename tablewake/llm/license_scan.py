"""License scans by diagonal voting, with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words of letters, digits and all that is not ASCII. Base labels come
from fixed phrases. The method's own labels come from fixed notices: all rolling ``GRAM``-word grams of the
texts are joined to the grams of the notices (a table of fixed size). A shared gram votes for the diagonal on which it
lies: its place in the text less its place in the notice. Votes are summed by diagonal; diagonals at most ``GAP``
apart are merged, since a word put in or left out moves the rest by one. A merged run is verified by
its span: the part of the notice's words that lie in shared grams must reach ``COVERED``, and the span in the text
must not be longer than the notice and ``GAP`` words. The joined grams are compared word by word, not by hash alone.

Equal texts are scanned once and looked up by a 128-bit key. Nulls: a null text is empty; doc_id is only
carried. Repeated rows give a row each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewake.llm.common import LOWER, UPPER, lower_ascii, table, text_key, text_of
from tablewake.sources.scratch import cut

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening words of well-known license notices.
NOTICES = {
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
        "under the GNU General Public License, version 3",
        "released under the terms of the GPL version",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0",
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction",
        "Released under the MIT License",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Creative Commons Attribution 4.0 International",
        "licensed under CC BY 4.0",
    ),
}

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 4
GAP = 3
COVERED = 0.7


def word_line(text: Column) -> Column:
    """The words of a text with single blanks between them."""
    return F.trim(F.regexp_replace(lower_ascii(text), NOT_WORD, " "))


def n_blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def base(texts: DataFrame) -> DataFrame:
    """``texts`` (with ``line``, the words) with n_words, n_base, first_word, last_word and found (labels)."""
    n_words = F.when(F.col("line") == "", 0).otherwise(n_blanks(F.col("line")) + 1).cast("long")
    rows = texts.select("*", n_words.alias("n_words"), F.concat(F.lit(" "), "line", F.lit(" ")).alias("padded"))
    padded, counts, firsts, lasts, labels = F.col("padded"), [], [], [], []
    for phrase, label in PHRASES.items():
        around = F.lit(f" {phrase} ")
        there = F.contains(padded, around)
        counts.append(F.when(there, F.regexp_count(padded, F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, n_blanks(F.substring(padded, F.lit(1), F.instr(padded, around))) - 1))
        tail = n_blanks(F.substring_index(padded, f" {phrase} ", -1))
        lasts.append(F.when(there, F.col("n_words") - tail - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    return rows.select(
        *texts.columns,
        "n_words",
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("found"),
    )


def grams(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, gram struct): all rolling grams of ``line``."""
    words = rows.where("line <> ''").select(*keys, F.split("line", " ").alias("words"))
    columns = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))) for i in range(GRAM)]
    zipped = F.arrays_zip(*(c.alias(f"w{i}") for i, c in enumerate(columns)))
    rolled = words.select(*keys, F.posexplode(zipped).alias("place", "gram"))
    named = rolled.select(*keys, "place", *(F.col(f"gram.w{i}").alias(f"w{i}") for i in range(GRAM)))
    return named.where(f"w{GRAM - 1} IS NOT NULL").withColumn("h", F.xxhash64(*(f"w{i}" for i in range(GRAM))))


def notices(spark: SparkSession) -> DataFrame:
    """The grams of the fixed notices: label, notice, n_grams, at, h, v0.."""
    listed = [
        F.struct(F.lit(label).alias("label"), F.lit(f"{label}{i}").alias("notice"), F.lit(text).alias("text"))
        for label, texts in NOTICES.items()
        for i, text in enumerate(texts)
    ]
    rows = spark.range(1).select(F.explode(F.array(*listed)).alias("n")).select("n.*")
    rows = rows.select("label", "notice", word_line(F.col("text")).alias("line"))
    rows = rows.withColumn("n_grams", n_blanks(F.col("line")) + 2 - GRAM)
    own = grams(rows, "label", "notice", "n_grams")
    return own.select("label", "notice", "n_grams", F.col("place").alias("at"), "h", *(F.col(f"w{i}").alias(f"v{i}") for i in range(GRAM)))


def spans(texts: DataFrame) -> DataFrame:
    """Verified spans (a, b, label, notice, first, last, covered) of texts (a, b, line) that differ by (a, b).

    ``first`` and ``last`` are places of words; ``covered`` is the part of the notice that is there, 0 to 1.
    """
    fixed = F.broadcast(notices(texts.sparkSession))  # as many rows as the fixed notices have words
    same = F.expr(" AND ".join(f"w{i} = v{i}" for i in range(GRAM)))
    rolled = grams(texts, "a", "b").withColumnRenamed("h", "its_h")
    votes = rolled.join(fixed, (F.col("its_h") == F.col("h")) & same)
    votes = votes.select("a", "b", "label", "notice", "n_grams", "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))
    lanes = votes.groupBy("a", "b", "label", "notice", "n_grams", "diagonal").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("ats")
    )
    order = Window.partitionBy("a", "b", "notice").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"), F.lit(1))
    lanes = lanes.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order))
    runs = lanes.groupBy("a", "b", "label", "notice", "n_grams", "run").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"),
    )
    # Words of the notice in shared grams.
    places = F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(p, p + (GRAM - 1)))))
    n_words = F.col("n_grams") + GRAM - 1
    runs = runs.withColumn("last", F.col("last") + GRAM - 1).withColumn("covered", F.size(places) / n_words)
    return runs.where((F.col("covered") >= COVERED) & (F.col("last") - F.col("first") < n_words + GAP)).drop("ats", "n_grams", "run")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of ``docs``."""
    texts = docs.select("doc_id", text_of().alias("text"))
    texts = texts.select("doc_id", text_key(F.col("text")).alias("key"), word_line(F.col("text")).alias("line"))
    keyed = texts.select("key.a", "key.b", "line")
    found = spans(keyed).groupBy("a", "b").agg(F.collect_set("label").alias("own"), F.max("covered").alias("covered"))
    found = cut(found.select(F.col("a").alias("its_a"), F.col("b").alias("its_b"), "own", "covered"))
    rows = base(texts.select("doc_id", "key.a", "key.b", "line")).drop("line")
    rows = rows.join(found, (F.col("a") == F.col("its_a")) & (F.col("b") == F.col("its_b")), "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.coalesce("own", F.array().cast("array<string>"))
    score = F.greatest(F.coalesce("covered", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("found")).alias("base_labels"), joined(F.concat("found", own)).alias("labels"), score.alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    phrases = ", ".join(f"({quoted(' ' + p + ' ')}, {len(p.split())}, {quoted(v)})" for p, v in PHRASES.items())
    fixed = ", ".join(f"({quoted(v)}, '{v}{i}', {quoted(t)})" for v, ts in NOTICES.items() for i, t in enumerate(ts))
    line = lambda t: f"trim(regexp_replace(translate({t}, '{UPPER}', '{LOWER}'), '{NOT_WORD}', ' ', 'g'), ' ')"
    return rf"""
WITH phrases(phrase, n, label) AS (VALUES {phrases}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, {line("coalesce(text, '')")} AS line FROM documents),
worded AS (SELECT *, CASE WHEN line = '' THEN [] ELSE string_split(line, ' ') END AS words FROM docs),
starts AS (SELECT r, words, unnest(range(len(words)))::BIGINT AS place FROM worded),
hits AS (
  SELECT r, place, label FROM starts, phrases
  WHERE words[place + 1] = string_split(trim(phrase, ' '), ' ')[1]
    AND ' ' || array_to_string(words[place + 1:place + n], ' ') || ' ' = phrase),
based AS (
  SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS found
  FROM hits GROUP BY r),
notices(label, notice, raw) AS (VALUES {fixed}),
notice_words AS (SELECT label, notice, string_split({line("raw")}, ' ') AS words FROM notices),
notice_grams AS (
  SELECT label, notice, len(words) AS n, spot, words[spot + 1:spot + {GRAM}] AS gram
  FROM (SELECT *, unnest(range(len(words) - {GRAM - 1}))::BIGINT AS spot FROM notice_words)),
votes AS (
  SELECT r, label, notice, n, spot, place, place - spot AS diagonal
  FROM (SELECT r, place, words[place + 1:place + {GRAM}] AS gram FROM starts) s JOIN notice_grams g ON s.gram = g.gram),
lanes AS (
  SELECT r, label, notice, n, diagonal, min(place) AS first, max(place) AS last, list(DISTINCT spot) AS ats
  FROM votes GROUP BY ALL),
parted AS (
  SELECT *, coalesce((diagonal - lag(diagonal) OVER w > {GAP})::INT, 1) AS apart
  FROM lanes WINDOW w AS (PARTITION BY r, notice ORDER BY diagonal)),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY r, notice ORDER BY diagonal) AS run FROM parted),
runs AS (
  SELECT r, label, notice, n, run, min(first) AS first, max(last) + {GRAM - 1} AS last, flatten(list(ats)) AS ats
  FROM numbered GROUP BY ALL),
verified AS (
  SELECT r, label,
    len(list_distinct(flatten(list_transform(ats, lambda p: range(p, p + {GRAM})))))::DOUBLE / n AS covered
  FROM runs WHERE last - first < n + {GAP}),
own AS (
  SELECT r, list(DISTINCT label) AS own, max(covered) AS covered FROM verified WHERE covered >= {COVERED} GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(own, [])))), ','), '') AS labels,
  greatest(coalesce(covered, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM worded LEFT JOIN based USING (r) LEFT JOIN own USING (r)
"""


OP4_SQL = _sql()
