"""Row-level rules as predicates of the plan, asked about rows before and after a change."""

import pytest
from compare import DATA
from pyspark.sql import functions as F

from vellum.operators import policy as P
from vellum.plans.catalog import QUERIES
from vellum.schema import TABLES

ADMIN, USER, NOBODY = P.Principal("boss"), P.Principal("o'me\\"), P.Principal()


@pytest.fixture(scope="module")
def roles(spark):
    made = spark.createDataFrame([("r1", "boss", "admin"), ("r2", "o'me\\", "user"), ("r3", "boss", "user"), ("r4", None, "admin")], "id string, user_id string, role string")
    P.install_functions(spark, made)
    return made


def rows_of(spark, table):
    """Three rows of a table: public, hidden, undecided."""
    given = {"id": ["a", "b", "c"], "published": [True, False, None], "approved": [True, False, None], "user_id": ["boss", "o'me\\", None], "role": ["admin", "user", "admin"]}
    schema = TABLES[table].schema
    return spark.createDataFrame([tuple(given[f.name][k] if f.name in given else None for f in schema) for k in range(3)], schema)


def ids(df):
    return sorted(r.id for r in df.collect())


SEEN = {"contacts": "", "blog_posts": "a", "blog_comments": "a", "user_roles": "b"}


@pytest.mark.parametrize("table", sorted(P.RULES))
def test_each_table(spark, roles, table):
    df = rows_of(spark, table)
    assert ids(P.secured(df, table, ADMIN)) == ["a", "b", "c"]
    assert ids(P.secured(df, table, USER)) == list(SEEN.get(table, "abc"))
    assert ids(P.secured(df, table, NOBODY)) == list("" if table == "user_roles" else SEEN.get(table, "abc"))
    for who in (ADMIN, USER, NOBODY):
        assert ids(P.secured(df, table, who)) == ids(P.secure(df, table, who, roles))
        left = P.secured_delete(df, F.col("id") != "c", table, who)
        assert ids(left) == (["c"] if who is ADMIN else ["a", "b", "c"])
        new = P.secured_update(df, F.col("id") == "b", {"id": F.lit("z")}, table, who)
        assert ids(new) == (["a", "c", "z"] if who is ADMIN else ["a", "b", "c"])
        insert = P.secured_insert(df, df.where("id = 'a'"), table, who)
        if who is ADMIN or table in ("contacts", "blog_comments"):
            assert ids(insert) == ["a", "a", "b", "c"]
        else:
            with pytest.raises(Exception, match=f"row-level security policy for table {table}"):
                insert.collect()


@pytest.mark.parametrize("table", sorted(P.RULES))
def test_a_change_may_not_leave_its_rule(spark, roles, table):
    """With a rule for owners besides: they change what is theirs, and can't give it away."""
    rules = {**P.RULES, table: (*P.RULES[table], P.Policy("theirs", "update", "id = 'b' OR id = 'b2'"), P.Policy("seen", "select", "id < 'c'"))}
    df = rows_of(spark, table)
    change = lambda new, where="b": ids(P.secured_update(df, F.col("id") == where, {"id": F.lit(new)}, table, USER, rules))
    assert change("b2") == ["a", "b2", "c"]
    assert change("b3", "a") == ["a", "b", "c"]  # not theirs: no row, no error
    with pytest.raises(Exception, match="row-level security policy"):
        change("b3")
    with pytest.raises(Exception, match="row-level security policy"):  # theirs still, but they no longer see it
        seen = (P.Policy("theirs", "update", "id LIKE '_'"), P.Policy("seen", "select", "id = 'b'"))
        P.secured_update(df, F.col("id") == "b", {"id": F.lit("x")}, table, USER, {table: seen}).collect()


def test_check_of_its_own(spark, roles):
    rules = {"resume": (P.Policy("all", "select", "true"), P.Policy("own", "update", "user_id = :me", "summary <> 'bad' AND user_id = :me"))}
    df = rows_of(spark, "resume")
    new = P.secured_update(df, F.lit(True), {"summary": F.lit("good")}, "resume", USER, rules)
    assert [(r.id, r.summary) for r in new.orderBy("id").collect()] == [("a", None), ("b", "good"), ("c", None)]
    for bad in ({"summary": F.lit("bad")}, {"summary": F.lit(None)}, {"user_id": F.lit("boss")}):
        with pytest.raises(Exception, match="row-level security policy"):
            P.secured_update(df, F.lit(True), bad, "resume", USER, rules).collect()


def test_first_admin_by_rule(spark, roles):
    none = rows_of(spark, "user_roles").limit(0)
    mine = spark.createDataFrame([("n", "o'me\\", "admin")], none.schema)
    other = spark.createDataFrame([("n", "boss", "admin")], none.schema)
    with pytest.raises(Exception, match="row-level security"):
        P.secured_insert(none, mine, "user_roles", USER).collect()
    try:
        P.install_functions(spark, none)
        assert ids(P.secured_insert(none, mine, "user_roles", USER)) == ["n"]
        with pytest.raises(Exception, match="row-level security"):
            P.secured_insert(none, other, "user_roles", USER).collect()
    finally:
        P.install_functions(spark, roles)


def test_rules_are_part_of_the_plan(spark, roles):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no job runs while a rule is planned")
    df = P.secured(rows_of(spark, "blog_posts"), "blog_posts", ADMIN)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "exists" in plan.lower() and "boss" in plan and "published" in plan
    assert spark.sql("SELECT has_role('boss', 'admin') AS a, has_role(NULL, 'admin') AS b, has_any_admin() AS c").first() == (True, False, True)


def test_the_users_role_is_looked_up_apart_from_the_rows(spark, roles):
    """No join of the rows with the role table, which would ask again at each of them."""
    for who in (ADMIN, USER, NOBODY):
        for command in ("select", "update"):
            counted = rows_of(spark, "contacts").agg(F.count_if(P.lets_through("contacts", command, who.user_id)).alias("n"))
            assert "Join" not in counted._jdf.queryExecution().executedPlan().toString()
            assert counted.first().n == (3 if who is ADMIN else 0)
        changed = P.secured_update(rows_of(spark, "contacts"), F.lit(True), {"id": F.lit("z")}, "contacts", who)
        assert "Join" not in changed._jdf.queryExecution().executedPlan().toString()


def test_texts_of_posts_stay_where_only_what_is_made_of_them_is_read(spark):
    plan = QUERIES["blog_list"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "text#" not in above and "AS reading_time#" in below and "content#" not in plan
