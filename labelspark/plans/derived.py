"""Verification inputs derived from the star-schema and text tables.

The SQL here is plain enough to run unchanged in Spark and in any ANSI engine, so checks can
derive the same inputs on both sides. Every source row is kept; residues only pick variants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import fixed_values as V

PART_BASE = "SELECT p_partkey AS k, p_name, p_brand, p_type, p_size FROM {part}"
LINE_BASE = (
    "SELECT l_orderkey * 1000000 + l_partkey AS k, p_name, p_brand, p_type, p_size "
    "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
)
_ABV = "CAST(CAST(p_size AS DOUBLE) / 2 + 4 AS STRING)"
_BRAND = "concat(p_name, ' ', p_brand)"
_W = V.OFFICIAL_WARNING

# A claim per row: some filenames repeat another row's key, some match no label.
CLAIMS = f"""
SELECT k AS row_number,
  concat(CASE WHEN k % 7 = 0 THEN ' Lost_' ELSE ' Part_' END,
         CAST(CASE WHEN k % 31 = 1 THEN k - 1 ELSE k END AS STRING), '.PNG ') AS filename,
  {_BRAND} AS brand,
  CASE WHEN k % 41 = 0 THEN 'unknown' ELSE concat({_ABV}, '%') END AS alcohol_content,
  CASE WHEN k % 3 = 0 THEN '750 mL' WHEN k % 17 = 0 THEN 'a bottle' ELSE '' END AS net_contents,
  CASE k % 12 WHEN 0 THEN 'Kentucky Straight Bourbon Whiskey' WHEN 2 THEN 'Red Table Wine'
    WHEN 4 THEN concat(p_type, ' Gin') WHEN 6 THEN 'Dessert Wine' WHEN 8 THEN p_name
    WHEN 10 THEN 'Rose Brandy' ELSE '' END AS class_type
FROM (@base) b
"""

# A label per row: brand, alcohol, volume, designation and warning lines, clean or damaged.
LABELS = f"""
SELECT k AS ordinal, concat('part_', CAST(k AS STRING), '.png') AS filename,
  CAST(40 + k % 60 AS DOUBLE) AS confidence,
  CASE WHEN k % 53 = 0 THEN 'x y' ELSE concat_ws(chr(10),
    CASE k % 5 WHEN 0 THEN upper({_BRAND}) WHEN 1 THEN replace(upper({_BRAND}), 'R', 'P')
      WHEN 2 THEN concat('THE ', upper({_BRAND}), ' BREWING CO')
      WHEN 3 THEN concat(p_name, chr(10), p_brand) ELSE concat(p_type, ' house') END,
    CASE k % 9 WHEN 0 THEN concat('ALC ', {_ABV}, '% BY VOL')
      WHEN 1 THEN concat(CAST(p_size + 8 AS STRING), ' PROOF')
      WHEN 2 THEN concat('ALC ', {_ABV}) WHEN 3 THEN 'ALC 3.1% BY VOL'
      WHEN 4 THEN 'made with 5% real fruit juice here' WHEN 5 THEN 'no statement'
      WHEN 6 THEN concat({_ABV}, '% ABV in 100% recycled glass bottles')
      WHEN 7 THEN concat('Alcohol/Vol. ', {_ABV}, ' %, or 9.25% for the other vintage')
      ELSE concat({_ABV}, ' % alc, that is ', CAST(p_size + 8 AS STRING), ' proof') END,
    CASE k % 4 WHEN 0 THEN '750 mL' WHEN 1 THEN '0,75 L' WHEN 2 THEN '1,000 mL' ELSE 'none' END,
    CASE k % 7 WHEN 0 THEN 'Straight Bourbon Whiskey' WHEN 1 THEN 'Red Table Wine'
      WHEN 2 THEN concat(p_type, ' gin') WHEN 3 THEN 'Desert Wine' ELSE 'craft drink' END,
    CASE k % 11 WHEN 0 THEN '{_W}'
      WHEN 1 THEN replace('{_W}', 'GOVERNMENT WARNING', 'Government Warning')
      WHEN 2 THEN replace('{_W}', 'birth defects', 'mild headaches')
      WHEN 3 THEN replace(replace('{_W}', 'pregnancy', 'prxgnxncx'), 'machinery', 'mxchxnxry')
      WHEN 4 THEN replace('{_W}', ' not ', ' ')
      WHEN 5 THEN ''
      WHEN 6 THEN concat('{_W}', ' Bottled by the same people')
      WHEN 7 THEN upper('{_W}')
      WHEN 8 THEN 'GOVERNMENT WARNING: drink responsibly and enjoy the evening'
      WHEN 9 THEN replace('{_W}', 'machinery', 'machmery')
      ELSE replace('{_W}', ' ', chr(10)) END) END AS text
FROM (@base) b
"""


# The true verdict of each derived label, from the same residues.
EXPECTED = """
SELECT concat('part_', CAST(k AS STRING), '.png') AS filename,
  k % 5 <> 4 AS exp_brand,
  k % 9 NOT IN (3, 4, 5) AND k % 41 <> 0 AS exp_alcohol,
  k % 11 IN (0, 3, 6, 9, 10) AS exp_warning,
  CASE WHEN k % 11 = 0 THEN 'clean' ELSE 'degraded' END AS kind
FROM (@base) b
"""

# Passages from documents, questions from benchmark texts.
CORPUS = """
SELECT doc_id, doc_id AS ordinal, lang AS beverage_type, source AS section,
  concat('(', lang, ')') AS paragraph,
  concat('doc:', CAST(doc_id AS STRING)) AS source_url,
  concat(source, ' ', lang, ' passage') AS heading, text
FROM {documents}
"""
QUESTIONS = """
SELECT item_id AS query_id, text AS question,
  CASE item_id % 3 WHEN 0 THEN 'EN' WHEN 1 THEN 'fr' ELSE '' END AS beverage_type
FROM {benchmark}
"""

# Audit rows from events; some reasons are blank, some hold quotes, breaks and formulas.
AUDIT = """
SELECT event_id * 2 AS id, CAST(user_id AS STRING) AS chain,
  concat('t', CAST(@micros AS STRING)) AS ts,
  concat('user-', CAST(user_id AS STRING)) AS actor, event_type AS action,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS target_result_id,
  CASE WHEN value > 50 THEN 'FLAG' ELSE NULL END AS old_verdict,
  CASE WHEN value > 20 THEN 'PASS' ELSE 'FLAG' END AS new_verdict,
  CASE WHEN event_id % 97 = 0 THEN '  '
    WHEN event_id % 13 = 0 THEN concat('=sum(', CAST(event_id AS STRING), ') ')
    WHEN event_id % 11 = 0 THEN concat('said "no"', chr(9), 'twice', chr(10), 'a', chr(92), 'b')
    ELSE concat(' checked by hand ', CAST(event_id AS STRING)) END AS reason
FROM {events}
"""

# Uploads from events: a thread per user, sizes in cents.
UPLOADS = """
SELECT CAST(user_id AS STRING) AS thread, event_id AS seq,
  CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS size
FROM {events}
"""


def claims_sql(base: str = PART_BASE) -> str:
    return CLAIMS.replace("@base", base)


def labels_sql(base: str = PART_BASE) -> str:
    return LABELS.replace("@base", base)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(sql: str, engine: str = "spark") -> str:
    """The one expression the engines spell differently: microseconds of a timestamp."""
    return sql.replace("@micros", "unix_micros(ts)" if engine == "spark" else "epoch_us(ts)")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run derivation SQL; ``{name}`` placeholders bind the parquet tables."""
    names = [n for n in TABLES if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def plain(sql: str) -> str:
    """The same SQL with placeholders replaced by bare table names."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def claims(spark: SparkSession, sf_dir: str, base: str = PART_BASE) -> DataFrame:
    return run(spark, sf_dir, claims_sql(base))


def labels(spark: SparkSession, sf_dir: str, base: str = PART_BASE) -> DataFrame:
    return run(spark, sf_dir, labels_sql(base))


def expected(spark: SparkSession, sf_dir: str, base: str = PART_BASE) -> DataFrame:
    return run(spark, sf_dir, EXPECTED.replace("@base", base))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, CORPUS)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, QUESTIONS)


def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows before chaining; ``unix_micros`` reads the column as an instant."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(micros(AUDIT), events=events)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir, UPLOADS)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level reads: lines split on white space, twenty lines per block, -1 marks no text."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_num", "line")
    )
    return lines.select(
        "doc_id", "line_num", F.posexplode(F.split("line", " ")).alias("word_num", "text")
    ).select(
        F.col("doc_id").cast("string").alias("label_id"),
        F.floor(F.col("line_num") / 20).cast("int").alias("block_num"),
        F.lit(0).alias("par_num"), "line_num", "word_num", "text",
        ((F.col("doc_id") * 31 + F.col("word_num") * 7) % 101 - 1).cast("double").alias("conf"),
    )
