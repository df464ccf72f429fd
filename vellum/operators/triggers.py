"""Functions that run before a row is inserted or updated, or after rows have been inserted, by table and event."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import reading_time

#: A change to the row: given the row's columns by name, and the time of the statement, the columns that it sets.
RowFunction = Callable[[dict[str, Column], dt.datetime], dict[str, Column]]
#: A change to tables: given all tables and the rows just written, the tables that it replaces.
TableFunction = Callable[[dict[str, DataFrame], DataFrame], dict[str, DataFrame]]


@dataclass(frozen=True)
class Trigger:
    name: str
    table: str
    events: frozenset[str]
    before: RowFunction | None = None
    after: TableFunction | None = None


class Registry:
    """Triggers by table; those of one table and event fire in the order of their names, each seeing what the one before has set."""

    def __init__(self, triggers: tuple[Trigger, ...] = ()):
        self._by_name = {(t.table, t.name): t for t in triggers}

    def with_trigger(self, trigger: Trigger) -> Registry:
        """This registry and the trigger, in place of one of that name and table."""
        return Registry((*(t for k, t in self._by_name.items() if k != (trigger.table, trigger.name)), trigger))

    def without(self, table: str, name: str) -> Registry:
        """This registry without a trigger; none of that name is no error."""
        return Registry(tuple(t for k, t in self._by_name.items() if k != (table, name)))

    def of(self, table: str, event: str) -> list[Trigger]:
        return sorted((t for t in self._by_name.values() if t.table == table and event in t.events), key=lambda t: t.name)

    def before(self, df: DataFrame, table: str, event: str, as_of: dt.datetime, where: Column | None = None) -> DataFrame:
        """df, whose rows (those for which where holds) are about to be written, with what the triggers set."""
        for t in self.of(table, event):
            if t.before:
                made = {c: v.cast(df.schema[c].dataType) for c, v in t.before({c: F.col(c) for c in df.columns}, as_of).items() if c in df.columns}
                df = df.withColumns(made if where is None else {c: F.when(where, v).otherwise(F.col(c)) for c, v in made.items()})
        return df

    def after(self, tables: dict[str, DataFrame], new: DataFrame, table: str, event: str) -> dict[str, DataFrame]:
        """tables after the triggers that follow the writing of new."""
        for t in self.of(table, event):
            if t.after:
                tables = {**tables, **t.after(tables, new)}
        return tables


def _touch(row: dict[str, Column], as_of: dt.datetime) -> dict[str, Column]:
    return {"updated_at": F.lit(as_of).cast("timestamp")}


def _read(row: dict[str, Column], as_of: dt.datetime) -> dict[str, Column]:
    return {"reading_time": reading_time(row["content"])} if "content" in row else {}


def _first_admin(tables: dict[str, DataFrame], new: DataFrame) -> dict[str, DataFrame]:
    from vellum.operators.mutate import appoint_first_admin

    return {"user_roles": appoint_first_admin(tables["user_roles"], new)} if "user_roles" in tables else {}


TOUCHED = ("projects", "blog_posts", "testimonials", "resume", "blog_comments")
SITE = Registry(
    (
        *(Trigger(f"update_{t}_updated_at", t, frozenset({"update"}), before=_touch) for t in TOUCHED),
        Trigger("calculate_blog_reading_time", "blog_posts", frozenset({"insert", "update"}), before=_read),
        Trigger("auto_assign_first_admin_trigger", "users", frozenset({"insert"}), after=_first_admin),
    )
)
