"""Facility records and user questions derived from the given tables.

The select texts below are plain ANSI SQL, so Spark and the checking engine read
the very same records.  Every row of the base tables becomes a row here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Size below which a one-row-group file is spread over the cores before heavy work.
SPREAD_BYTES = 512 * 1024 * 1024
# Bytes of stored text, about, that one task gets for work of many searches per text.
TASK_BYTES = 8 * 1024 * 1024

FACILITIES_SQL = """
SELECT
  CASE WHEN d.doc_id < 100000 THEN lpad(CAST(d.doc_id AS STRING), 5, '0')
       ELSE CAST(d.doc_id AS STRING) END AS facility_id,
  concat('Facility ', CAST(d.doc_id % 900 AS STRING)) AS name,
  CASE WHEN d.doc_id % 40 = 0 THEN NULL ELSE n.n_name END AS address_state,
  concat(n.n_name, '_C', CAST(d.doc_id % 3 AS STRING)) AS address_city,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL
       ELSE CAST(100000 + (d.doc_id % 25) * 10 + d.doc_id % 4 AS STRING) END AS address_zip,
  CASE WHEN d.doc_id % 50 = 7 OR d.text IS NULL THEN NULL
       ELSE 8e0 + ((d.doc_id * 37) % 2900) / 100e0 END AS latitude,
  CASE WHEN d.doc_id % 50 = 7 OR d.text IS NULL THEN NULL
       ELSE 68e0 + ((d.doc_id * 91) % 2900) / 100e0 END AS longitude,
  CASE WHEN d.doc_id % 30 = 11 THEN NULL
       WHEN d.doc_id % 5 = 0 THEN 'Hospital'
       WHEN d.doc_id % 5 = 1 THEN ' clinic'
       WHEN d.doc_id % 5 = 2 THEN 'Dentist'
       WHEN d.doc_id % 5 = 3 THEN 'doctor '
       ELSE 'PHARMACY' END AS facilityTypeId,
  CASE d.doc_id % 6 WHEN 0 THEN '["oncology","emergencyMedicine"]'
       WHEN 1 THEN '["nephrology"]'
       WHEN 2 THEN concat('[', chr(39), 'psychiatry', chr(39), ']')
       WHEN 3 THEN '[]'
       WHEN 4 THEN 'null'
       ELSE 'ophthalmology' END AS specialties,
  CASE d.doc_id % 4 WHEN 0 THEN '["dialysis","surgery"]'
       WHEN 2 THEN '["delivery"]'
       WHEN 3 THEN '' END AS "procedure",
  CASE d.doc_id % 5 WHEN 0 THEN '["ventilator","monitor"]'
       WHEN 1 THEN '["mri"]' END AS equipment,
  CASE d.doc_id % 7 WHEN 0 THEN 'Has ICU with 6 ventilators. 120 bed facility.'
       WHEN 1 THEN 'Emergency and trauma care open 24/7. Closes 9pm on Sunday.'
       WHEN 2 THEN 'Surgery by team of surgeons.'
       WHEN 3 THEN 'Surgery with anaesthesiologist on call.'
       WHEN 4 THEN 'Dialysis unit, 24 hours.'
       WHEN 6 THEN 'Neonatal NICU and maternity ward.' END AS capability,
  d.text AS description,
  CASE d.doc_id % 9 WHEN 0 THEN '1' WHEN 1 THEN '12' WHEN 2 THEN 'n/a' END AS "numberDoctors",
  CASE WHEN d.doc_id % 20 = 0 THEN '50' END AS capacity,
  CASE WHEN d.doc_id % 4 <> 1 THEN concat('+91 ', CAST(2000000000 + d.doc_id AS STRING)) END
       AS officialPhone,
  CASE WHEN d.doc_id % 3 <> 2 THEN concat('https://f', CAST(d.doc_id AS STRING), '.example') END
       AS officialWebsite,
  CASE d.doc_id % 6 WHEN 1 THEN concat('desk', CAST(d.doc_id AS STRING), '@f.example')
       WHEN 2 THEN 'nan' END AS email,
  concat(CAST(d.doc_id % 200 AS STRING), ' Main Road') AS address_line1,
  CASE d.doc_id % 3 WHEN 0 THEN ' Private' WHEN 1 THEN 'PUBLIC ' END AS operatorTypeId,
  CASE WHEN d.doc_id % 8 = 3 THEN CAST(1950 + d.doc_id % 70 AS STRING) END AS yearEstablished,
  CASE d.doc_id % 3 WHEN 0 THEN '2024-05-01' WHEN 1 THEN 'null' END AS recency_of_page_update,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE CAST(d.doc_id % 6 AS INT) END AS social_count,
  CASE d.doc_id % 17 WHEN 0 THEN '{"has_icu": true}'
       WHEN 1 THEN concat('```json', chr(10),
            '{"properties": {"has_icu": true, "has_24_7": true}}', chr(10), '```')
       WHEN 2 THEN 'not json' END AS model_reply
FROM (SELECT doc_id, text FROM {documents}
      UNION ALL SELECT doc_id + 360360000, NULL FROM {documents} WHERE doc_id % 11 = 0) d
JOIN {nation} n ON d.doc_id % 25 = n.n_nationkey
"""

# User questions: every user turn, with a clinical request appended by its number so
# that each intent occurs.  The state named in the request is a nation name.
QUESTIONS_SQL = """
SELECT
  c.conv_id * 1000 + c.turn AS query_id,
  CASE c.conv_id % 9
       WHEN 0 THEN concat(c.text, ' Which districts in ', n.n_name, ' have no dialysis centre?')
       WHEN 1 THEN concat('Find hospital with ICU and emergency care in ', n.n_name,
                          ' trust above ', CAST(40 + c.turn AS STRING), '. ', c.text)
       WHEN 2 THEN concat('List clinic claiming surgery with contradictions near ', n.n_name,
                          '_C1 ', c.text)
       WHEN 3 THEN concat(c.text, ' kidney and cancer care open 24/7')
       WHEN 4 THEN concat('eye ', c.text)
       WHEN 5 THEN concat('states lack psychiatric support and maternity wards ', c.text)
       WHEN 6 THEN concat('ok ', c.text)
       WHEN 7 THEN concat('Disputed ICU beds in ', lower(n.n_name), ' ', c.text)
       ELSE c.text END AS query,
  CASE c.conv_id % 4 WHEN 0 THEN 'hi-IN' WHEN 1 THEN 'en' WHEN 2 THEN 'ur' END AS language,
  CASE c.conv_id % 3 WHEN 0 THEN 'All' WHEN 1 THEN n.n_name END AS ui_state,
  CASE c.conv_id % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 55e0 WHEN 2 THEN 70e0 END AS ui_min_trust
FROM {conversations} c JOIN {nation} n ON c.conv_id % 25 = n.n_nationkey
WHERE c.role = 'user'
"""


def _parquet(sf_dir: str, table: str) -> str:
    return f"parquet.`{sf_dir.rstrip('/')}/{table}.parquet`"


def _spark_text(sql: str, **tables: str) -> str:
    for name, source in tables.items():
        sql = sql.replace("{" + name + "}", source)
    return sql.replace('"procedure"', "procedure").replace('"numberDoctors"', "numberDoctors")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, path: str, key: str) -> DataFrame:
    """Spread a small file over the cores; big tables and tables of many files keep their own
    splits (no shuffle)."""
    spark = df.sparkSession
    if len(spark.read.parquet(path).inputFiles()) >= spark.sparkContext.defaultParallelism:
        return df
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getContentSummary(hadoop_path).getLength() > SPREAD_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


def in_small_tasks(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows dealt so that a task's share stays the same on a table of any size, also where the
    files' own splits or row groups are large."""
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    shares = -(-fs.getContentSummary(hadoop_path).getLength() // TASK_BYTES)
    return df.repartition(max(spark.sparkContext.defaultParallelism, shares), key)


def facilities(spark: SparkSession, sf_dir: str, small_tasks: bool = False) -> DataFrame:
    raw = spark.sql(_spark_text(
        FACILITIES_SQL,
        documents=_parquet(sf_dir, "documents"),
        nation=_parquet(sf_dir, "nation"),
    ))
    deal = in_small_tasks if small_tasks else spread
    return deal(raw, f"{sf_dir.rstrip('/')}/documents.parquet", "facility_id")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(_spark_text(
        QUESTIONS_SQL,
        conversations=_parquet(sf_dir, "conversations"),
        nation=_parquet(sf_dir, "nation"),
    ))
    return spread(raw, f"{sf_dir.rstrip('/')}/conversations.parquet", "query_id")


def oracle_facilities() -> str:
    return FACILITIES_SQL.replace("{documents}", "documents").replace("{nation}", "nation")


def oracle_questions() -> str:
    return (QUESTIONS_SQL.replace("{conversations}", "conversations")
            .replace("{nation}", "nation"))
