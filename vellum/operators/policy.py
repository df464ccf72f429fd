"""Row-level policies as filters. Lookups of roles see the whole role table, as a definer's would."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class PolicyError(Exception):
    """A new row that no policy allows."""

    code = "42501"


@dataclass(frozen=True)
class Principal:
    user_id: str | None = None


#: The view of the role table that the SQL functions look into: the whole table, whoever asks.
ROLE_VIEW = "site_user_roles"


def install_functions(spark: SparkSession, roles: DataFrame) -> None:
    """Register has_role(user, role) and has_any_admin() as SQL functions. Their bodies become part of the plan of whatever uses them: no
    job runs beforehand. What they look up is one row at most."""
    roles.select("user_id", "role").createOrReplaceTempView(ROLE_VIEW)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION has_role(who STRING, wanted STRING) RETURNS BOOLEAN RETURN EXISTS (SELECT 1 FROM {ROLE_VIEW} WHERE user_id = who AND role = wanted)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION has_any_admin() RETURNS BOOLEAN RETURN EXISTS (SELECT 1 FROM {ROLE_VIEW} WHERE role = 'admin' LIMIT 1)")


@dataclass(frozen=True)
class Policy:
    """A rule for a command (select, insert, update, delete or all): the rows it lets through, and what a new row must be (using by
    default). SQL over the table's columns; :me is the user, and the functions of install_functions() may be called. A lookup that asks about
    the user alone is best a scalar subquery, as _IS_ADMIN is; has_role() is for a user that a column names."""

    name: str
    command: str
    using: str | None = None
    check: str | None = None


#: Whether the user is an administrator, as a scalar subquery of its own: looked up once for a plan. has_role(:me, 'admin') says the same, but
#: a function's arguments are columns to its body, so each call of it becomes a nested-loop join with every row that is asked about.
_IS_ADMIN = f"(SELECT count(*) > 0 AS role_exists FROM {ROLE_VIEW} WHERE user_id = :me AND role = 'admin')"


def _managed(noun: str, seen: str = "true", inserted: str = _IS_ADMIN) -> tuple[Policy, ...]:
    rules = (Policy(f"{noun}: view", "select", seen), Policy(f"{noun}: insert", "insert", check=inserted))
    return (*rules, Policy(f"{noun}: update", "update", _IS_ADMIN), Policy(f"{noun}: delete", "delete", _IS_ADMIN))


#: All rules of a table; any of those for a command may let a row through.
RULES: dict[str, tuple[Policy, ...]] = {
    "contacts": _managed("contacts", _IS_ADMIN, "true"),
    "projects": _managed("projects"),
    "blog_posts": _managed("posts", f"published = true OR {_IS_ADMIN}"),
    "testimonials": _managed("testimonials"),
    "resume": _managed("resume"),
    "user_roles": (
        Policy("roles: own", "select", "user_id = :me"), Policy("roles: view", "select", _IS_ADMIN), Policy("roles: manage", "all", _IS_ADMIN),
        Policy("roles: first", "insert", check="user_id = :me AND role = 'admin' AND NOT has_any_admin()"),
    ),
    "blog_comments": _managed("comments", f"approved = true OR {_IS_ADMIN}", "true"),
    "blog_tags": (Policy("tags: view", "select", "true"), Policy("tags: manage", "all", _IS_ADMIN)),
    "blog_categories": (Policy("categories: view", "select", "true"), Policy("categories: manage", "all", _IS_ADMIN)),
}


def _any(rules: Iterable[str | None], me: str | None) -> Column:
    """Whether one of the rules holds; null counts as no, and so does having none."""
    quoted = "CAST(NULL AS STRING)" if me is None else "'" + me.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = [F.expr(r.replace(":me", quoted)) for r in rules if r is not None]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False)) if found else F.lit(False)


def lets_through(table: str, command: str, me: str | None, rules: dict[str, tuple[Policy, ...]] = RULES) -> Column:
    """The rows of a table that a command of the user reaches. A change reaches only what the user also sees."""
    own = lambda c: _any([p.using for p in rules.get(table, ()) if p.command in (c, "all")], me)
    return own("select") if command == "select" else own(command) & own("select")


def accepts(table: str, command: str, me: str | None, rules: dict[str, tuple[Policy, ...]] = RULES) -> Column:
    """Whether a user may leave a row as it now is: by the check of a rule for the command, or what it lets through. A changed row must
    stay in what the user sees."""
    own = _any([p.using if p.check is None else p.check for p in rules.get(table, ()) if p.command in (command, "all")], me)
    return own & lets_through(table, "select", me, rules) if command == "update" else own


def _refused(ok: Column, table: str) -> Column:
    """A condition for where() that is true, or stops the query at a row that isn't ok."""
    message = f"new row violates row-level security policy for table {table}"
    return F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def secured(df: DataFrame, table: str, principal: Principal, command: str = "select", rules: dict[str, tuple[Policy, ...]] = RULES) -> DataFrame:
    """secure() as a predicate of the plan, by the functions of install_functions()."""
    return df.where(lets_through(table, command, principal.user_id, rules))


def secured_insert(old: DataFrame, new: DataFrame, table: str, principal: Principal, rules: dict[str, tuple[Policy, ...]] = RULES) -> DataFrame:
    """old and new; the query fails at a row that no rule accepts."""
    return old.unionByName(new.where(_refused(accepts(table, "insert", principal.user_id, rules), table)))


def secured_update(old: DataFrame, where: Column, changes: dict[str, Column], table: str, principal: Principal, rules: dict[str, tuple[Policy, ...]] = RULES) -> DataFrame:
    """old with changes in the rows that where names and the user reaches; others stay, without an error. The query fails at a changed row
    that the rules don't accept: they are asked twice, about the row before and after."""
    me = principal.user_id
    rows = old.withColumn("_hit", F.coalesce(where, F.lit(False)) & lets_through(table, "update", me, rules))
    new = rows.select(*[F.when(F.col("_hit"), changes[c].cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in old.columns], "_hit")
    kept, changed = new.where(~F.col("_hit")), new.where(F.col("_hit")).where(_refused(accepts(table, "update", me, rules), table))
    return kept.unionByName(changed).select(*old.columns)


def secured_delete(old: DataFrame, where: Column, table: str, principal: Principal, rules: dict[str, tuple[Policy, ...]] = RULES) -> DataFrame:
    """old without the rows that where names and the user reaches."""
    return old.where(~(F.coalesce(where, F.lit(False)) & lets_through(table, "delete", principal.user_id, rules)))


ANYONE, ADMIN = "anyone", "admin"
#: table -> (SQL condition under which anyone may read a row, who may insert)
POLICIES: dict[str, tuple[str, str]] = {
    "contacts": ("false", ANYONE),
    "projects": ("true", ADMIN),
    "blog_posts": ("published = true", ADMIN),
    "testimonials": ("true", ADMIN),
    "resume": ("true", ADMIN),
    "user_roles": ("user_id = :me", ADMIN),
    "blog_comments": ("approved = true", ANYONE),
    "blog_tags": ("true", ADMIN),
    "blog_categories": ("true", ADMIN),
}


def has_role(roles: DataFrame, user_id: str | None, role: str = "admin") -> bool:
    """Whether the user holds the role; false for no user. Looked up once, so it folds into plans as a constant."""
    return user_id is not None and not roles.where((F.col("user_id") == user_id) & (F.col("role") == role)).isEmpty()


def has_any_admin(roles: DataFrame) -> bool:
    return not roles.where(F.col("role") == "admin").isEmpty()


def secure(df: DataFrame, table: str, principal: Principal, roles: DataFrame | None, command: str = "select") -> DataFrame:
    """The rows of table that principal may see (select) or change (update, delete); no policy, no rows."""
    if roles is not None and has_role(roles, principal.user_id):
        return df
    if command != "select" or table not in POLICIES:
        return df.where(F.lit(False))
    rule = POLICIES[table][0]
    if ":me" in rule:
        return df.where(F.col("user_id") == F.lit(principal.user_id))
    return df.where(rule)


def check_insert(new: DataFrame, table: str, principal: Principal, roles: DataFrame) -> None:
    """Raise PolicyError unless principal may insert; the first administrator may appoint themself."""
    if POLICIES.get(table, ("", ""))[1] == ANYONE or has_role(roles, principal.user_id):
        return
    if table == "user_roles" and principal.user_id is not None and not has_any_admin(roles):
        if new.where(~((F.col("user_id") == principal.user_id) & (F.col("role") == "admin"))).isEmpty():
            return
    raise PolicyError(f"new row violates row-level security policy for table {table}")


def bucket_objects(objects: DataFrame, bucket: str, principal: Principal, roles: DataFrame, command: str = "select") -> DataFrame:
    """Stored objects of one bucket: anyone reads, administrators change."""
    own = objects.where(F.col("bucket_id") == bucket)
    return own if command == "select" or has_role(roles, principal.user_id) else own.where(F.lit(False))
