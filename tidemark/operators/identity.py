"""People by address: an address that two or more people hold is nobody's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import email_key


def directory(people: DataFrame) -> DataFrame:
    """email_key and employee_id of addresses that exactly one person holds."""
    keys = people.filter("email is not null").groupBy(email_key(F.col("email")).alias("email_key"))
    return keys.agg(F.count_distinct("employee_id").alias("n"), F.min("employee_id").alias("employee_id")).filter("n = 1").drop("n")


def ambiguous(people: DataFrame) -> DataFrame:
    keys = people.filter("email is not null").groupBy(email_key(F.col("email")).alias("email_key"))
    return keys.agg(F.count_distinct("employee_id").alias("holders")).filter("holders > 1")


def resolve(rows: DataFrame, people: DataFrame, email_col: str) -> DataFrame:
    """Adds employee_id, null where the address is unknown or shared. The join is left to the optimizer, which broadcasts a small directory."""
    return rows.withColumn("email_key", email_key(F.col(email_col))).join(directory(people), "email_key", "left").drop("email_key")


def unresolved(rows: DataFrame, people: DataFrame, email_col: str) -> DataFrame:
    """Addresses of rows that resolve to nobody, and how often they occur."""
    keyed = rows.withColumn("email_key", email_key(F.col(email_col)))
    return keyed.join(directory(people), "email_key", "left_anti").groupBy("email_key").agg(F.count("*").alias("n"))


def missing_managers(people: DataFrame) -> DataFrame:
    managers = people.select(F.col("employee_id").alias("manager_id"))
    return people.filter("manager_id is not null").join(managers, "manager_id", "left_anti").select("employee_id", "manager_id")
