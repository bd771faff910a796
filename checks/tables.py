"""Test tables: the driver's tables with phrases planted into their texts.

Each table is written twice, as a DataFrame and as the same SQL for the oracle.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.phrases import PHRASES
from swayscan.functions.text import sql_string

N = len(PHRASES)
DOMAIN_CYCLE = ("general", "legal", "media", "financial", "all")
_AT = ("{key} % {n}", "({key} * 7 + 3) % {n}", "({key} * 13 + 5) % {n}")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Share out the rows of a small test table, which would be few tasks; one that has as many stays where it lies."""
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


def q(value: str) -> str:
    """A DuckDB string literal."""
    return "'" + value.replace("'", "''") + "'"


def phrase_no(key: str, place: int) -> str:
    """Number of the phrase planted at a place (0 front, 1 and 2 behind)."""
    return _AT[place].format(key=key, n=N)


def phrase_at(key: str, place: int):
    """The phrase planted at a place, as a column."""
    phrases = ", ".join(sql_string(p) for p, _ in PHRASES)
    return F.expr(f"get(array({phrases}), int({phrase_no(key, place)}))")


def wanted_rules(key: str, places: tuple[int, ...]):
    """Rules that the phrases at these places raise by themselves, as a column."""
    lists = ", ".join(
        "cast(array(" + ", ".join(map(sql_string, rules)) + ") as array<string>)" for _, rules in PHRASES
    )
    parts = (f"get(array({lists}), int({phrase_no(key, place)}))" for place in places)
    return F.expr(f"concat({', '.join(parts)})")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder; a temporary one if unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base}/{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder, for tables that are used more than once."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plant(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Put one phrase before and two behind each text."""
    planted = F.concat(
        phrase_at(key, 0), F.lit(" "), F.col(text), F.lit(". "),
        phrase_at(key, 1), F.lit(" "), phrase_at(key, 2),
    )
    domain = F.get(F.array(*map(F.lit, DOMAIN_CYCLE)), F.expr(f"int({key} % 5)"))
    return df.withColumns({text: planted, "doc_domain": domain})


def edged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Some rows made into ones that the scan does not accept: null, too long, of a domain that does not exist."""
    column = F.expr(f"CASE {key} % 97 WHEN 5 THEN NULL WHEN 6 THEN rpad({text}, 200001, ' x') ELSE {text} END")
    df = df.withColumn(text, column)
    if "doc_domain" not in df.columns:
        return df
    return df.withColumn("doc_domain", F.when(F.col(key) % 97 == 7, "Media").otherwise(F.col("doc_domain")))


# The same in SQL; a scan starts from the rows of ``readable``.
EDGED = """edged as materialized (select * replace (
  case doc_id % 97 when 5 then null when 6 then rpad(text, 200001, ' x') else text end as text,
  case when doc_id % 97 = 7 then 'Media' else doc_domain end as doc_domain) from planted),
readable as materialized (select * from edged where length(text) <= 200000 and doc_domain <> 'Media'),
unread as (select doc_id from edged where text is null or length(text) > 200000)"""


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return plant(spread(documents), "doc_id")


def plant_sql(table: str, key: str, text: str = "text") -> str:
    phrases = "[" + ", ".join(q(p) for p, _ in PHRASES) + "]"
    at = [f"(select l from phrase_list)[({phrase_no(key, n)}) + 1]" for n in range(3)]
    domains = "[" + ", ".join(map(q, DOMAIN_CYCLE)) + "]"
    return (
        f"phrase_list as (select {phrases} as l), "
        f"planted as materialized (select {key}, {at[0]} || ' ' || {text} || '. ' || {at[1]} || ' ' || {at[2]} as text, "
        f"{domains}[({key} % 5) + 1] as doc_domain from {table})"
    )


PLANTED = plant_sql("documents", "doc_id")
