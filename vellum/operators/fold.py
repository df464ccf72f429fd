"""Folds over logs of changes, by aggregates that combine: no log has to be sorted or held in one group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADD, UPDATE, DISMISS, REMOVE = "add", "update", "dismiss", "remove"


def _latest(when: Column, *values: Column) -> Column:
    """Of the rows where when holds, the place of the last one and its values."""
    return F.max(F.when(when, F.struct(F.col("_at"), *values)))


def current_notice(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The notice that each key's log leaves shown: key, id, fields, open; id is null where none is left.

    log: key, order (columns that tell its rows apart), action, id, fields, open. A list holds one notice. "add" puts a new one, open, in
    place of what is there; "update" sets the fields, and open, that aren't null, if the notice has that id; "dismiss" closes and "remove"
    takes away the notice of that id, or whichever there is if id is null. A notice has an id: adds and updates without one do nothing.
    Rows of the same order count as adds first, then updates, dismissals, removals. A null key is a key; other actions do nothing.

    What a row does to the notice hangs only on the last add of the same id, so the log is summed up by key and id first: the last add, the
    last value of each field, the last dismissal and removal, each with its place. Then, by key, the id of the latest add is the notice.
    Both sums are combined before they are shuffled; the second one sees a row for each id.
    """
    rank = reduce(lambda c, kv: c.when(F.col("action") == kv[1], kv[0]), enumerate((UPDATE, DISMISS, REMOVE), 2), F.when(F.col("action") == ADD, 1))
    rows = log.withColumn("_at", F.struct(*[F.col(c) for c in order], rank.alias("rank"))).where(rank.isNotNull())
    act, named = lambda a: F.col("action") == a, F.col("id").isNotNull()
    by_id = rows.groupBy(key, "id").agg(
        _latest(act(ADD) & named, *[F.col(f) for f in fields]).alias("added"),
        *[_latest(act(UPDATE) & named & F.col(f).isNotNull(), F.col(f)).alias(f"set_{k}") for k, f in enumerate(fields)],
        F.max(F.when(act(DISMISS) | (act(UPDATE) & named & F.col("open").isNotNull()), F.struct("_at", (act(UPDATE) & F.col("open")).alias("open")))).alias("opened"),
        F.max(F.when(act(REMOVE), F.col("_at"))).alias("removed"),
    )
    own = F.struct("added", *[f"set_{k}" for k in range(len(fields))], "opened", "removed", "id")
    by_key = by_id.groupBy(key).agg(
        F.max(F.when(F.col("added").isNotNull(), own)).alias("one"), F.max(F.when(~named, F.col("opened"))).alias("closed"), F.max(F.when(~named, F.col("removed"))).alias("removed")
    )
    one, added = F.col("one"), F.col("one.added._at")
    later = lambda at: F.coalesce(at > added, F.lit(False))
    shown = one.isNotNull() & ~later(F.col("one.removed")) & ~later(F.col("removed"))
    opened = F.greatest(F.struct(added.alias("_at"), F.lit(True).alias("open")), F.col("one.opened"), F.col("closed")).open
    values = [F.when(later(F.col(f"one.set_{k}._at")), F.col(f"one.set_{k}")[f]).otherwise(F.col("one.added")[f]) for k, f in enumerate(fields)]
    return by_key.select(key, F.when(shown, F.col("one.id")).alias("id"), *[F.when(shown, v).alias(f) for f, v in zip(fields, values, strict=True)], F.when(shown, opened).alias("open"))
