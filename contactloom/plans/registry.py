"""Registry of queries with their DuckDB equivalents, and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Addresses for each customer, the same expression in Spark and DuckDB.
ADDRESS = """concat(
  CASE c_custkey % 7 WHEN 0 THEN 'J.Doe+news' WHEN 1 THEN 'jane.doe' WHEN 2 THEN 'INFO' WHEN 3 THEN 'a.b' WHEN 4 THEN '12user' WHEN 5 THEN 'no-reply' ELSE 'ivan.petrov' END,
  CASE WHEN c_custkey % 7 IN (2, 5) THEN '' ELSE concat('', c_custkey % 40) END, '@',
  CASE c_custkey % 6 WHEN 0 THEN 'gmail.com' WHEN 1 THEN 'GoogleMail.com' WHEN 2 THEN 'yandex.ru' WHEN 3 THEN 'mail.ru' WHEN 4 THEN 'univ.edu' ELSE 'company.ru' END)"""
#: The same with faults.
MESSY = f"""concat(
  CASE c_custkey % 13 WHEN 1 THEN '.' WHEN 2 THEN 'a..' WHEN 3 THEN 'x y' WHEN 4 THEN '+7-999-777-66-55' WHEN 5 THEN '@' WHEN 6 THEN '  ' ELSE '' END,
  {ADDRESS},
  CASE c_custkey % 11 WHEN 1 THEN '.' WHEN 2 THEN '-.c' WHEN 3 THEN '_' WHEN 4 THEN ',ru' WHEN 5 THEN 'russia' WHEN 6 THEN ').' ELSE '' END)"""
R = f"r AS (SELECT c_custkey AS pos, {ADDRESS} AS email, concat('src', c_custkey % 3) AS source, c_nationkey FROM customer)"
M = f"m AS (SELECT c_custkey AS pos, {MESSY} AS email FROM customer)"


def recipients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.expr(ADDRESS).alias("email"), F.expr("concat('src', c_custkey % 3)").alias("source"), "c_nationkey")


def messy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.expr(MESSY).alias("email"))


def sql_in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
