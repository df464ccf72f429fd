"""Changes as functions from tables to tables. A result is lazy; write it to a new path to keep it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import js_trim
from vellum.operators.triggers import SITE, Registry
from vellum.schema import TABLES, Table
from vellum.session import settled


def _value(sql: str, as_of: dt.datetime) -> Column:
    return F.lit(as_of).cast("timestamp") if sql == "now()" else F.expr(sql)


def with_defaults(new: DataFrame, table: Table, as_of: dt.datetime) -> DataFrame:
    """new with all columns of the table: omitted ones take their default, given nulls stay null."""
    cols = []
    for f in table.schema:
        if f.name in new.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append((_value(table.defaults[f.name], as_of) if f.name in table.defaults else F.lit(None)).cast(f.dataType).alias(f.name))
    return new.select(*cols)


def insert(old: DataFrame, new: DataFrame, table: str, as_of: dt.datetime, triggers: Registry = SITE) -> DataFrame:
    """old and new, with defaults for omitted columns and what the triggers before an insert set."""
    return old.unionByName(triggers.before(with_defaults(new, TABLES[table], as_of), table, "insert", as_of))


def insert_into(tables: dict[str, DataFrame], table: str, new: DataFrame, as_of: dt.datetime, triggers: Registry = SITE) -> dict[str, DataFrame]:
    """tables after an insert into one of them and what its triggers do to the others. A table that schema.TABLES lacks takes new as it is."""
    made = triggers.before(with_defaults(new, TABLES[table], as_of) if table in TABLES else new, table, "insert", as_of)
    return triggers.after({**tables, table: tables[table].unionByName(made)}, made, table, "insert")


def _one_of_each(df: DataFrame, key: list[str]) -> DataFrame:
    """Of the rows with the same key the one whose other columns come first."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_rest")).select(*[c if c in key else F.col("_rest")[c].alias(c) for c in df.columns]) if rest else df.distinct()


def _key(key: list[str]) -> Column:
    """A digest of a key's values; null where one of them is null, as it then conflicts with nothing."""
    return F.when(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key]), F.sha2(F.to_json(F.struct(*key)), 256))


def insert_ignoring(old: DataFrame, new: DataFrame, keys: list[list[str]], order: list[str] | None = None) -> DataFrame:
    """old and those rows of new, inserted in order, that conflict on none of the keys with old or a row inserted before. A null conflicts with nothing.

    order: columns of new, its columns from the first on by default; ties are broken by the others."""
    if len(keys) == 1 and not order:
        (key,) = keys
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        kept = _one_of_each(new.where(whole), key).join(old.select(*key), key, "left_anti").select(*new.columns)
        return old.unionByName(kept.unionByName(new.where(~whole)))
    sortable = [f.name for f in new.schema if f.dataType.typeName() not in ("map", "variant")]
    ranked = new.orderBy(*dict.fromkeys([*(order or []), *sortable])).withColumn("_at", F.monotonically_increasing_id())
    ranked = settled(ranked.withColumns({f"_key{i}": _key(k) for i, k in enumerate(keys)}))
    digests = [f"_key{i}" for i in range(len(keys))]
    free = reduce(lambda a, b: a & b, [F.col(d).isNull() for d in digests])
    kept = ranked.where(free).unionByName(ranked.join(_first_come(ranked.where(~free), old, keys), "_at", "left_semi"))
    return old.unionByName(kept.select(*new.columns))


def _first_come(ranked: DataFrame, old: DataFrame, keys: list[list[str]]) -> DataFrame:
    """_at of the rows that an insert in the order of _at would take.

    In each round a row that is the first on all of its keys is taken, and what shares a key with it falls out. There are as many rounds as
    the longest chain of rows in which each one hangs on the one before; only _at and digests travel, and each round is settled."""
    digests = [f"_key{i}" for i in range(len(keys))]
    left = ranked.groupBy(*digests).agg(F.min("_at").alias("_at"))  # of rows alike in all keys only the first can be taken
    for d, key in zip(digests, keys, strict=True):
        left = left.join(old.select(_key(key).alias(d)), d, "left_anti").select("_at", *digests)
    pairs = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("k"), F.col(d).alias("d")) for i, d in enumerate(digests)]), lambda x: x.d.isNotNull())).alias("p")
    edges = settled(left.select("_at", pairs).select("_at", "p.k", "p.d"))
    taken = edges.select("_at").where(F.lit(False))
    while not edges.isEmpty():
        firsts = edges.groupBy("k", "d").agg(F.min("_at").alias("_first"))
        won = edges.join(firsts, ["k", "d"]).groupBy("_at").agg(F.bool_and(F.col("_at") == F.col("_first")).alias("won")).where("won").select("_at")
        won = settled(won)
        held = edges.join(won, "_at", "left_semi").select("k", "d")
        out = edges.join(held, ["k", "d"], "left_semi").select("_at").distinct()
        edges = settled(edges.join(out, "_at", "left_anti"))
        taken = taken.union(won)
    return taken


def update(old: DataFrame, where: Column, changes: dict[str, Column], as_of: dt.datetime, table: str = "", triggers: Registry = SITE) -> DataFrame:
    """old with changes in the rows where holds, and what the table's triggers before an update set there. Without a table only updated_at
    follows, if there is one. No such row is no error."""
    if not table and "updated_at" in old.columns:
        changes = {**changes, "updated_at": F.lit(as_of).cast("timestamp")}
    rows = old.withColumn("_hit", F.coalesce(where, F.lit(False)))
    made = {c: F.when(F.col("_hit"), v.cast(old.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()}
    new = rows.select(*[made[c].alias(c) if c in made else F.col(c) for c in old.columns], "_hit")
    return triggers.before(new, table, "update", as_of, F.col("_hit")).select(*old.columns)


def replace_or_insert(old: DataFrame, new: DataFrame, table: str, as_of: dt.datetime, key: str = "id") -> DataFrame:
    """old with the rows of new, which has one row for each key: where the key exists the given columns are replaced and the others
    stay, elsewhere the row is inserted with defaults."""
    given = [c for c in new.columns if c != key]
    changes = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in given])
    joined = old.join(changes, F.col(key) == F.col("_key"), "left")
    changed = update(joined, F.col("_key").isNotNull(), {c: F.col(f"_new_{c}") for c in given}, as_of, table).select(*old.columns)
    return insert(changed, new.join(old.select(key), key, "left_anti"), table, as_of)


def delete(old: DataFrame, where: Column) -> DataFrame:
    return old.where(~F.coalesce(where, F.lit(False)))


def cascade(child: DataFrame, fk: str, deleted: DataFrame, key: str = "id") -> DataFrame:
    """child without the rows that refer to deleted ones."""
    gone = deleted.select(F.col(key).alias(fk)).distinct()
    return child.join(gone, fk, "left_anti").select(*child.columns)


def order_of(names: Iterable[str], references: dict[str, dict[str, tuple[str, str, bool]]]) -> list[str]:
    """names with each table behind those that it refers to; an error for a ring of references."""
    names, out = list(names), []
    while len(out) < len(names):
        ready = [n for n in names if n not in out and all(parent in out or parent not in names for parent, _, _ in references[n].values())]
        if not ready:
            raise ValueError(f"references in a ring: {', '.join(n for n in names if n not in out)}")
        out += ready
    return out


class ReferenceError(Exception):
    """A row that may not be deleted, as rows of another table refer to it."""

    code = "23503"


def delete_cascading(tables: dict[str, DataFrame], table: str, where: Column, references: dict[str, dict[str, tuple[str, str, bool]]] | None = None) -> dict[str, DataFrame]:
    """tables without the rows of table for which where holds, and without all rows that refer to deleted ones, over any number of tables.

    references: for each table, column -> (table, column, deletes cascade); those of schema.TABLES by default. A reference that
    doesn't cascade raises ReferenceError if a row refers to a deleted one. Each result reads each table on its way once."""
    given = references or {}
    references = {n: given.get(n, TABLES[n].references if n in TABLES and references is None else {}) for n in tables}
    out, gone = dict(tables), {table: tables[table].where(F.coalesce(where, F.lit(False)))}
    out[table] = delete(tables[table], where)
    for name in order_of(tables, references):
        if name == table:
            continue
        hits = [(fk, gone[parent].select(F.col(key).alias("_gone")).where("_gone IS NOT NULL").distinct(), cascades) for fk, (parent, key, cascades) in references[name].items() if parent in gone]
        if not hits:
            continue
        rows, flags = tables[name], []
        for k, (fk, keys, _) in enumerate(hits):
            rows = rows.join(keys.withColumnRenamed("_gone", f"_gone{k}"), F.col(fk) == F.col(f"_gone{k}"), "left")
            flags.append(F.col(f"_gone{k}").isNotNull())
        for flag, (fk, _, cascades) in zip(flags, hits, strict=True):
            if not cascades and not rows.where(flag).isEmpty():
                raise ReferenceError(f"{name}.{fk} refers to rows that would be deleted")
        hit = reduce(lambda a, b: a | b, flags)
        out[name] = rows.where(~hit).select(*tables[name].columns)
        gone[name] = rows.where(hit).select(*tables[name].columns)
    return out


def appoint_first_admin(roles: DataFrame, users: DataFrame) -> DataFrame:
    """roles with an administrator from the earliest new user, if there is no administrator yet."""
    first = users.orderBy("created_at", "id").limit(1).select(F.uuid().alias("id"), F.col("id").alias("user_id"), F.lit("admin").alias("role"))
    admins = roles.where(F.col("role") == "admin").limit(1)
    return insert_ignoring(roles, first.join(admins.select(F.lit(1).alias("x")), F.lit(True), "left_anti"), [["user_id", "role"]])


def setup_admin(roles: DataFrame, users: DataFrame, email: str) -> DataFrame:
    """roles with the user of that address as administrator; an unknown address gives a null user_id, which the not-null check reports."""
    found = users.where(F.col("email") == email).agg(F.min("id").alias("user_id"))
    new = found.select(F.uuid().alias("id"), "user_id", F.lit("admin").alias("role"))
    return insert_ignoring(roles, new, [["user_id", "role"]])


#: What may be done with a contact in each state. Beside that a reply moves any contact to REPLIED.
NEXT_STATUS = {"unread": "read", "read": "archived"}
REPLIED = "replied"


def next_status(status: Column) -> Column:
    """The state that a contact may be moved on to; null at the end."""
    return reduce(lambda c, kv: c.when(status == kv[0], kv[1]), list(NEXT_STATUS.items())[1:], F.when(status == "unread", "read"))


def reply(contacts: DataFrame, where: Column, subject: Column, message: Column, as_of: dt.datetime) -> DataFrame:
    """contacts after a reply to those where holds: they are REPLIED from any state, unless subject or message is blank.

    The site's two schemas differ here: one lets any status be written, as replies need, and the other, whose check schema.TABLES has,
    refuses REPLIED. Leave that check out of what a table with replies is held to."""
    return update(contacts, where & (js_trim(subject) != "") & (js_trim(message) != ""), {"status": F.lit(REPLIED)}, as_of)
