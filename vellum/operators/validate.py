"""Constraint violations and form validation as frames: an empty frame means that all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vellum.functions import js_length, js_trim
from vellum.schema import Table
from vellum.session import settled

#: Fixed value: what the form takes for an address. No point at its start, none after another.
EMAIL = r"^(?!\.)(?!.*\.\.)[A-Za-z0-9_'+\-.]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"


class UniqueError(Exception):
    """A row with a key that exists."""

    code = "23505"


def null_violations(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def check_violations(df: DataFrame, condition: str | Column) -> DataFrame:
    """Rows for which the condition is false; null passes."""
    return df.where(~(F.expr(condition) if isinstance(condition, str) else condition))


#: Repeated keys up to which their digests are sent to all tasks; 64 bytes each.
SENT = 500_000


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a key with a null is no duplicate.

    Texts are counted by their digests. Those that repeat are settled, and sent to all tasks if they are few: then no text travels but
    those of repeated keys, from a second read of df. If they are many they meet df by a shuffle."""
    whole = df.dropna(subset=keys)
    if any(df.schema[k].dataType != StringType() for k in keys):
        return whole.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    whole = whole.select(*keys, F.sha2(F.to_json(F.struct(*keys)), 256).alias("_digest"))
    twice = settled(whole.groupBy("_digest").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    found = whole.join(F.broadcast(twice) if twice.count() <= SENT else twice, "_digest")
    return found.groupBy("_digest").agg(*[F.first(k).alias(k) for k in keys], F.first("n").alias("n")).drop("_digest")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise UniqueError if a key occurs more than once."""
    if not unique_violations(df, keys).isEmpty():
        raise UniqueError(f"duplicate key value violates unique constraint on {', '.join(keys)}")


def insert_outcome(code: Column, message: Column) -> Column:
    """What an insert's error means to who asked for a role: exists, refused (by code or a message that names a policy), failed; null for no error."""
    refused = (code == "42501") | message.contains("policy")
    return F.when(code == "23505", "exists").when(refused, "refused").when(code.isNotNull() | message.isNotNull(), "failed")


def reference_violations(child: DataFrame, fk: str, parent: DataFrame, key: str = "id") -> DataFrame:
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)), fk, "left_anti")


def violations(df: DataFrame, table: Table, parents: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A frame of offending rows or keys for each constraint of the table."""
    out = {f"not null {c}": null_violations(df, c) for c in table.not_null}
    out |= {f"check {c}": check_violations(df, c) for c in table.checks}
    out |= {f"unique {', '.join(k)}": unique_violations(df, list(k)) for k in (*table.unique, *((c,) for c in table.unique_where_set))}
    for fk, (parent, key, _) in table.references.items():
        if parents and parent in parents:
            out[f"reference {fk}"] = reference_violations(df, fk, parents[parent], key)
    return out


def _constraints(table: Table, parents: dict[str, DataFrame]) -> tuple[dict[str, Column], dict[str, list[str]], dict[str, tuple[str, DataFrame, str]]]:
    """By name: conditions that fault a row, unique keys, references to the parents at hand."""
    rows = {f"not null {c}": F.col(c).isNull() for c in table.not_null} | {f"check {c}": ~F.expr(c) for c in table.checks}
    keys = {f"unique {', '.join(k)}": list(k) for k in (*table.unique, *((c,) for c in table.unique_where_set))}
    refs = {f"reference {fk}": (fk, parents[parent], key) for fk, (parent, key, _) in table.references.items() if parent in parents}
    return rows, keys, refs


def constraint_groups(df: DataFrame, table: Table, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """What decides each constraint, from one scan of df and one of each parent: constraint, digest of the key (null for a condition on
    a row), n rows of df (for a condition, those that break it), parent rows.

    A row brings a short entry for each condition that it breaks and for each of its keys; entries are counted before they are shuffled."""
    rows, keys, refs = _constraints(table, parents or {})
    whole = lambda cols: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    entry = lambda name, digest: F.struct(F.lit(name).alias("constraint"), digest.alias("digest"))
    digest = lambda cols: F.sha2(F.to_json(F.struct(*[F.col(c).alias(str(k)) for k, c in enumerate(cols)])), 256)
    none = F.lit(None).cast("string")
    entries = [F.when(bad, entry(name, none)) for name, bad in rows.items()]
    entries += [F.when(whole(k), entry(name, digest(k))) for name, k in keys.items()]
    entries += [F.when(F.col(fk).isNotNull(), entry(name, digest([fk]))) for name, (fk, _, _) in refs.items()]
    found = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*", F.lit(1).alias("own"), F.lit(0).alias("parent"))
    for name, (fk, parent, key) in refs.items():
        own = parent.select(F.lit(name).alias("constraint"), digest([key]).alias("digest"), F.lit(0).alias("own"), F.lit(1).alias("parent"))
        found = found.union(own.where(F.col("digest").isNotNull()))
    return found.groupBy("constraint", "digest").agg(F.sum("own").alias("n"), F.sum("parent").alias("parent"))


def constraint_counts(df: DataFrame, table: Table, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """constraint and n, for each constraint of the table: rows that break a condition or refer to nothing, keys that occur more than once."""
    rows, keys, refs = _constraints(table, parents or {})
    kind = F.substring_index("constraint", " ", 1)
    bad = F.when(kind == "unique", (F.col("n") > 1).cast("long")).when(kind == "reference", F.when(F.col("parent") == 0, F.col("n")).otherwise(0)).otherwise(F.col("n"))
    counts = constraint_groups(df, table, parents).groupBy("constraint").agg(F.sum(bad).cast("long").alias("n"))
    names = df.sparkSession.createDataFrame([(n,) for n in (*rows, *keys, *refs)], "constraint string")  # a row for each constraint of the table
    return names.join(counts, "constraint", "left").select("constraint", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def length_fault(c: Column, most: int, name: str) -> Column:
    """Message for a trimmed text that is empty or longer than most UTF-16 units; null for a good one."""
    n = js_length(js_trim(c))
    return F.when(n > most, F.lit(f"{name} must be less than {most} characters")).when(n < 1, F.lit(f"{name} is required"))


def contact_faults(name: Column, email: Column, message: Column) -> Column:
    """A struct with one message for each faulty field; the last fault of a field stands."""
    mail = F.when(js_length(js_trim(email)) > 255, "Email must be less than 255 characters").when(~js_trim(email).rlike(EMAIL), "Invalid email address")
    return F.struct(length_fault(name, 100, "Name").alias("name"), mail.alias("email"), length_fault(message, 1000, "Message").alias("message"))


def sign_in_faults(email: Column, password: Column) -> Column:
    return F.struct(F.when(~email.rlike(EMAIL), "Invalid email address").alias("email"), F.when(js_length(password) < 6, "Password must be at least 6 characters").alias("password"))
