"""The site's tables in Spark's own catalog, made from schema.py, so that SQL inserts take the same defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from vellum.schema import TABLES, Table


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def default_of(table: Table, column: str) -> str | None:
    """The DEFAULT of a column. The catalog takes constants and the time of the statement, so a random id stays the inserter's to give."""
    value = table.defaults.get(column)
    return None if value is None or value == "uuid()" else "current_timestamp()" if value == "now()" else value


def column_sql(table: Table, field: T.StructField) -> str:
    default = default_of(table, field.name)
    return f"{_quoted(field.name)} {field.dataType.simpleString().upper()}" + (f" DEFAULT {default}" if default else "")


def create_table(spark: SparkSession, database: str, table: Table, location: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS with the table's columns and defaults; a table that is there stays as it is."""
    columns = ", ".join(column_sql(table, f) for f in table.schema)
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(database)}.{_quoted(table.name)} ({columns}) USING parquet{where}")


def create_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(database)}")
    for table in TABLES.values():
        create_table(spark, database, table)


def add_column(spark: SparkSession, database: str, table: str, name: str, kind: str, default: str | None = None) -> bool:
    """ADD COLUMN IF NOT EXISTS: rows that are there read as the default, a SQL constant; whether it was added."""
    whole = f"{_quoted(database)}.{_quoted(table)}"
    if name.lower() in (c.lower() for c in spark.table(whole).columns):
        return False
    spark.sql(f"ALTER TABLE {whole} ADD COLUMNS ({_quoted(name)} {kind}" + (f" DEFAULT {default})" if default else ")"))
    return True


def missing_columns(spark: SparkSession, database: str, table: Table) -> list[str]:
    """Add the columns of the schema that the catalog's table lacks, with their defaults; their names."""
    return [f.name for f in table.schema if add_column(spark, database, table.name, f.name, f.dataType.simpleString().upper(), default_of(table, f.name))]


def drop_database(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {_quoted(database)} CASCADE")
