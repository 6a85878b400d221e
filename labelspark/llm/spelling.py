"""Spelling variants: words one edit apart by asymmetric q-chunks, grouped under their commonest form."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import query, table
from labelspark.session import materialize

RUN = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
ERROR_RATE = 199
#: Pairs of a chunk's holders that are compared as they are; beyond, the chunk is lengthened.
PAIRS = 1024


def with_errors(doc_id: Column, run: Column) -> Column:
    """The run, without one code point if crc32 of ``<doc_id>:<run>`` is a multiple of 199."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(h % ERROR_RATE == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the runs of letters in ``docs`` (doc_id, text), long and frequent enough.

    Counts combine in the task before the one shuffle. A null id stands as an empty one.
    """
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(RUN), 0)).alias("run"))
    words = runs.select(with_errors(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key() -> Column:
    """What stands before place ``lo`` and after place ``hi`` of the longer word of a pair.

    ``lag`` is how much shorter this word is; behind the edit its letters stand ``lag`` earlier.
    """
    return F.xxhash64("size", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")),
                      F.substring("word", F.col("hi") + 2 - F.col("lag"), F.length("word")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: the edit lies in the first half of its places, or in the second."""
    middle = F.expr("(lo + hi) div 2").cast("int")
    spans = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")),
                    F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
    return rows.withColumn("span", F.explode(spans)).where("span.lo <= span.hi").select(
        "word", "n", "chunked", "size", "lag", "span.lo", "span.hi").withColumn("key", _key())


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): every two of ``words`` (word, n; distinct, not empty) that are one edit apart, once.

    Of a pair the longer word (either, if of one length) is cut into two disjoint chunks. One edit
    leaves one of them whole: the first stands in the other word at the same place, the second at the
    same or one earlier. So that word contributes its grams at places within one of a chunk's, for
    both lengths the longer word may have, and equal chunks and grams are compared.

    A chunk with more than ``pairs`` pairs of holders isn't compared yet: the places where the edit may
    be are halved again, and all else of the word becomes part of the chunk. That ends at one place,
    where what is left to differ is a single letter. No pair is lost at any step, and no task gets
    all holders of a common chunk.
    """
    longer = words.select("word", "n", F.lit(True).alias("chunked"), F.lit(0).alias("lag"))
    shorter = words.select("word", "n", F.lit(False).alias("chunked"), F.explode(F.array(F.lit(0), F.lit(1))).alias("lag"))
    sized = longer.unionByName(shorter).withColumn("size", F.length("word") + F.col("lag"))
    left = _halves(sized.withColumn("lo", F.lit(0)).withColumn("hi", F.col("size") - 1))
    found = None
    if words.isEmpty():
        return words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    while True:
        left = materialize(left, "chunks")
        held = left.groupBy("key").agg(
            F.count_if("chunked").alias("chunks"), F.count_if(~F.col("chunked")).alias("grams"),
            F.max(F.col("hi") - F.col("lo")).alias("wide"))
        hot = (F.col("chunks") * F.col("grams") > pairs) & (F.col("wide") > 0)
        held = materialize(held.where("chunks > 0 and grams > 0").select("key", hot.alias("hot")), "chunk_sizes")
        now = left.join(held.where("not hot"), "key")
        own, other = now.where("chunked"), now.where("not chunked")
        met = own.select("key", F.col("word").alias("b"), F.col("n").alias("b_n")).join(
            other.select("key", "lag", F.col("word").alias("a"), F.col("n").alias("a_n")), "key"
        ).where("(lag = 1 or a < b)").where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
        met = materialize(met, "near_words")
        found = met if found is None else found.unionByName(met)
        if held.where("hot").isEmpty():
            return found.distinct()
        left = _halves(left.join(held.where("hot").select("key"), "key").where("hi > lo"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every one of ``words`` (word, n; distinct, not empty).

    ``form`` is the near word of largest n (ties: the first in code point order), if that is at least
    ``ratio`` times the word's own; ``root`` is where following forms ends, the word itself without
    any. An n grows by the ratio at every step, so the steps to a root are few whatever the table;
    each round of joins doubles those taken. Words of one letter are near those of one or two, too.
    """
    words = materialize(words.select("word", "n"), "words")
    links = near_words(words)
    both = links.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        links.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    enough = -F.col("best.down") >= ratio * F.col("n")
    made = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.down")).alias("form_n")),
        "forms")
    ends = made.where("form is not null").select("word", F.col("form").alias("root"))
    top = words.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(top, ratio)) + 1
    for _ in range(math.ceil(math.log2(steps))):
        ends = materialize(ends, "roots")
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return made.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of ``docs`` (doc_id, text).

    Null and empty texts have no words; repeated rows count each; a null id stands as an empty one;
    an empty table gives an empty frame; other columns are ignored. Texts are taken whole.
    """
    return variants(word_counts(docs))


#: Letters of two bytes, and signs of one byte that stand for them where SQL compares bytes.
_WIDE = "".join(chr(c) for c in range(0xC0, 0x100))
_NARROW = (string.digits + string.ascii_uppercase + "!#$%&()*+,-./:;<=>?@[]^_`{|}~")[: len(_WIDE)]

SQL_OP12 = f"""
WITH RECURSIVE entries AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM entries WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM entries WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(
      translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL
), walk AS (
  SELECT doc_id, run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h, 0 AS pos,
    CAST(4294967295 AS BIGINT) AS c FROM runs
  UNION ALL
  SELECT doc_id, run, k, h, pos + 1,
    xor(c >> 8, t[1 + (xor(c, CAST('0x' || substr(h, 2 * pos + 1, 2) AS BIGINT)) & 255)])
  FROM walk, tab WHERE 2 * pos < length(h)
), hashed AS (
  SELECT run, k, xor(c, 4294967295) AS h FROM walk WHERE 2 * pos = length(h)
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % 199 = 0
      THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), coded AS (SELECT word, n, translate(word, '{_WIDE}', '{_NARROW}') AS w, length(word) AS l FROM words),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM coded a JOIN coded b ON b.l = a.l AND levenshtein(a.w, b.w) = 1
  UNION ALL
  SELECT a.word, b.word, b.n FROM coded a JOIN coded b ON b.l = a.l + 1 AND levenshtein(a.w, b.w) = 1
  UNION ALL
  SELECT a.word, b.word, b.n FROM coded a JOIN coded b ON b.l = a.l - 1 AND levenshtein(a.w, b.w) = 1
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near,
    max(near_n) AS near_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
    CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chains AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL
  SELECT c.word, c.next, f.form FROM chains c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""


@query("op12_spelling_variants", SQL_OP12)
def op12(spark, sf):
    """Variants among the words of all documents."""
    return spelling_variants(table(spark, sf, "documents"))
