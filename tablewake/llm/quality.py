"""Quality rules by the divergence of distributions, with DataFrame functions only.

Base figures of a text: words, their characters, symbols, lines that repeat an earlier one, and words in
8-word windows that come back in the text. Base rules reject texts with too few words or too many repeated ones.

The verdict for the others compares two histograms of a text with those of its language, the sums over all
documents of that ``lang``: characters (outside white space) by class, and the ``COMMON`` most
frequent words of the language with all other words in one bin. A text is rejected if the Jensen-Shannon distance
(base 2, 0 to 1) of one pair exceeds its limit. Histograms of short texts are noise, so the limits hold only from
``CHARS_GUARD`` characters and ``WORDS_GUARD`` words on. The common words reach the rows as one small row per
language; histograms are counted row by row inside the scan, and no text is shuffled.

Nulls: a null text has no words; a null lang is a language of its own. Repeated rows give a row each. An empty
table gives no rows. Extra columns are not read; :func:`keep_good` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewake.llm.common import SPACE, WORD, table, text_key, text_of
from tablewake.sources.scratch import cut

LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
COMMON = 16
CHARS_GUARD = 200
WORDS_GUARD = 50
CHARS_LIMIT = 0.33
WORDS_LIMIT = 0.45
#: Classes of characters, in the order in which they are taken out of a text; the rest is a class, too.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", r"[\x21-\x7E]+")


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(its_lang, common): the most frequent words of each language, over all documents."""
    words = docs.select("lang", F.explode(F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])
    return cut(top.groupBy(F.col("lang").alias("its_lang")).agg(listed.alias("common")))


def features(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, lang, key and the base figures and histograms of each row of ``docs``."""
    langs = common.select("its_lang", "common")
    rows = docs.select("doc_id", "lang", text_of().alias("text"))
    rows = rows.join(langs, F.col("lang").eqNullSafe(F.col("its_lang")), "left")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    bare = F.regexp_replace("text", f"{SPACE}+", "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.select("doc_id", "lang", "common", text_key(F.col("text")).alias("key"), words.alias("words"), bare.alias("bare"), lines.alias("lines"))
    rows = rows.select(
        "doc_id",
        "lang",
        "key",
        "common",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        "bare",
        F.regexp_replace("bare", CLASSES[0], "").alias("rest"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    rest, sizes = F.col("rest"), [F.length("rest")]
    for pattern in CLASSES[1:]:
        rest = F.regexp_replace(rest, pattern, "")
        sizes.append(F.length(rest))
    left = [F.col("word_chars"), *sizes]
    classes = F.array(*(a - b for a, b in zip(left[:-1], left[1:], strict=True)), left[-1])
    n_symbols = F.length("rest") - F.length(F.translate("rest", "#*$%&|<>", ""))
    rolled = lambda h, step: F.zip_with(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - step, F.lit(0))), F.slice(h, step + 1, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, y)
    )
    hits = F.transform(F.coalesce("common", F.array().cast("array<string>")), lambda c: F.size("words") - F.size(F.array_remove("words", c)))
    rows = rows.select(
        "doc_id", "lang", "key", "n_words", "word_chars", n_symbols.cast("long").alias("n_symbols"), "n_dup_lines",
        classes.alias("classes"), hits.alias("hits"), rolled("h1", 1).alias("h2"),
    )
    kept = [c for c in rows.columns if c != "h2"]
    rows = rows.select(*kept, rolled("h2", 2).alias("h4"))
    rows = rows.select(*kept, rolled("h4", 4).alias("h8"))
    # Only texts in which a window comes back are looked at closely.
    again = F.size(F.array_distinct("h8")) < F.size("h8")
    numbered = F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*kept, F.when(again, numbered).alias("s"))
    at = lambda k: F.get("s", k)["h"]
    back = F.filter("s", lambda x, k: F.coalesce(x["h"] == at(k - 1), F.lit(False)) | F.coalesce(x["h"] == at(k + 1), F.lit(False)))
    rows = rows.select(*kept, F.when(F.col("s").isNotNull(), F.array_sort(F.transform(back, lambda x: x["i"]))).alias("p"))
    steps = F.transform("p", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1), x + WINDOW) - x))
    covered = F.when(F.col("p").isNotNull(), F.aggregate(steps, F.lit(0), lambda a, b: a + b)).otherwise(0)
    other = F.greatest(F.col("n_words") - F.aggregate("hits", F.lit(0), lambda a, b: a + b), F.lit(0))
    return rows.select(
        *(c for c in kept if c != "hits"),
        F.concat("hits", F.array(other.cast("int"))).alias("bins"),
        covered.cast("long").alias("n_repeat_words"),
    )


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.transform(counts, lambda c: F.when(total > 0, c / total).otherwise(0.0))


def divergence(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two lists of shares."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """The base figures, base_failed, both distances and ``kept`` of each row of ``docs`` (doc_id, text, lang)."""
    rows = cut(features(docs, common_words(docs)))
    total = lambda c, n: F.array(*(F.sum(F.get(c, F.lit(i))).cast("double") for i in range(n)))
    reference = rows.groupBy(F.col("lang").alias("its_lang")).agg(
        total("classes", len(CLASSES) + 1).alias("c"), F.max(F.size("bins")).alias("n_bins"), total("bins", COMMON + 1).alias("b")
    )
    # Languages of fewer words have fewer bins.
    whole = F.slice(F.transform("b", lambda x: F.coalesce(x, F.lit(0.0))), F.lit(1), F.col("n_bins"))
    reference = cut(reference.select("its_lang", shares(F.col("c")).alias("its_classes"), shares(whole).alias("its_bins")))
    rows = rows.join(reference, F.col("lang").eqNullSafe(F.col("its_lang")))
    far_chars = divergence(shares(F.col("classes")), F.col("its_classes"))
    far_words = divergence(shares(F.col("bins")), F.col("its_bins"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select(
        "doc_id", "lang", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), far_chars.alias("far_chars"), far_words.alias("far_words"),
    )
    off = ((F.col("word_chars") >= CHARS_GUARD) & (F.col("far_chars") > CHARS_LIMIT)) | (
        (F.col("n_words") >= WORDS_GUARD) & (F.col("far_words") > WORDS_LIMIT)
    )
    return rows.withColumn("kept", ~F.col("base_failed") & ~off)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. The verdict depends on lang and text only and is looked up by them."""
    bad = judge(docs).where(~F.col("kept")).select(F.col("lang").alias("its_lang"), "key.a", "key.b").distinct()
    bad = cut(bad)
    key = text_key(text_of())
    same = (key["a"] == bad["a"]) & (key["b"] == bad["b"]) & docs["lang"].eqNullSafe(bad["its_lang"])
    return docs.join(bad, same, "left_anti")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    counted = "\n".join(f"    length({a}) - length({b})," for a, b in [("bare", "t1"), ("t1", "t2"), ("t2", "t3"), ("t3", "t4"), ("t4", "t5")])
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    quoted = lambda p: p.replace("'", "''")
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS words, regexp_replace(text, '{SPACE}+', '', 'g') AS bare FROM docs),
places AS (SELECT r, lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
counts AS (SELECT lang, words[i] AS word, count(*) AS n FROM places GROUP BY ALL),
common AS (
  SELECT lang, word FROM counts
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON}),
windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM places WHERE i + {WINDOW - 1} <= len(words)),
back AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
repeated AS (
  SELECT r, sum(least({WINDOW}, coalesce(later, i + {WINDOW}) - i))::BIGINT AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS later FROM back) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (
  SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
left1 AS (SELECT *, regexp_replace(bare, '{CLASSES[0]}', '', 'g') AS t1 FROM worded),
left2 AS (SELECT *, regexp_replace(t1, '{CLASSES[1]}', '', 'g') AS t2 FROM left1),
left3 AS (SELECT *, regexp_replace(t2, '{CLASSES[2]}', '', 'g') AS t3 FROM left2),
left4 AS (SELECT *, regexp_replace(t3, '{quoted(CLASSES[3])}', '', 'g') AS t4 FROM left3),
left5 AS (SELECT *, regexp_replace(t4, '{CLASSES[4]}', '', 'g') AS t5 FROM left4),
classed AS (
  SELECT r, doc_id, lang, len(words) AS n_words, length(bare) AS word_chars,
    length(regexp_replace(bare, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, [
{counted}
    length(t5)] AS c FROM left5),
class_rows AS (SELECT r, lang, unnest(c) AS n, unnest(range(len(c))) AS k FROM classed),
class_far AS (
  SELECT r, sqrt(greatest(sum({part('p', 'q')} + {part('q', 'p')}) / 2, 0)) AS far_chars FROM (
    SELECT r, coalesce(n / nullif(sum(n) OVER (PARTITION BY r), 0), 0) AS p,
      coalesce(sum(n) OVER (PARTITION BY lang, k) / nullif(sum(n) OVER (PARTITION BY lang), 0), 0) AS q FROM class_rows)
  GROUP BY r),
bin_hits AS (
  SELECT p.r, c.word, count(*) AS n FROM places p JOIN common c ON p.lang IS NOT DISTINCT FROM c.lang AND p.words[p.i] = c.word
  GROUP BY ALL),
bins AS (
  SELECT w.r, w.lang, c.word, coalesce(h.n, 0) AS n
  FROM worded w JOIN common c ON w.lang IS NOT DISTINCT FROM c.lang LEFT JOIN bin_hits h ON h.r = w.r AND h.word = c.word
  UNION ALL
  SELECT w.r, w.lang, NULL, len(w.words) - coalesce(s.n, 0)
  FROM worded w LEFT JOIN (SELECT r, sum(n) AS n FROM bin_hits GROUP BY r) s USING (r)),
bin_far AS (
  SELECT r, sqrt(greatest(sum({part('p', 'q')} + {part('q', 'p')}) / 2, 0)) AS far_words FROM (
    SELECT r, coalesce(n / nullif(sum(n) OVER (PARTITION BY r), 0), 0) AS p,
      coalesce(sum(n) OVER (PARTITION BY lang, word) / nullif(sum(n) OVER (PARTITION BY lang), 0), 0) AS q FROM bins)
  GROUP BY r),
judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, far_chars, far_words,
    n_words < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {REPEAT_PERCENT} * n_words AS base_failed
  FROM classed LEFT JOIN dups USING (r) LEFT JOIN repeated USING (r) JOIN class_far USING (r) JOIN bin_far USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars >= {CHARS_GUARD} AND far_chars > {CHARS_LIMIT})
    AND NOT (n_words >= {WORDS_GUARD} AND far_words > {WORDS_LIMIT}) AS kept
FROM judged
"""


OP8_SQL = _sql()
