"""Changes over several keys and tables, and checks of a whole table at once, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import mutate as M
from vellum.operators import validate as V
from vellum.schema import TABLES

THREE = "id long, name string, slug string"


def one_by_one(old, new):
    """Rows of new in order, each unless its name or slug is taken."""
    names, slugs, out = {n for _, n, _ in old if n}, {s for _, _, s in old if s}, list(old)
    for row in new:
        _, n, s = row
        if (n is None or n not in names) and (s is None or s not in slugs):
            out.append(row)
            names.add(n)
            slugs.add(s)
    return sorted(out, key=str)


def test_insert_on_any_key_keeps_what_a_rejected_row_would_take(spark):
    old = spark.createDataFrame([(1, "q", "x")], THREE)
    new = spark.createDataFrame([(2, "a", "x"), (3, "a", "y")], THREE)
    assert sorted(r.id for r in M.insert_ignoring(old, new, [["name"], ["slug"]]).collect()) == [1, 3]


def test_insert_on_any_key_is_insertion_one_by_one(spark):
    """A thousand small tables at once: each has its own keys, as if it were alone."""
    rnd = random.Random(11)
    olds, news, want = [], [], []
    for t in range(1000):
        letter = lambda: rnd.choice([None, *(f"{t}-{k}" for k in range(5))])  # noqa: E731, B023
        old, used = [], set()
        for k in range(rnd.randint(0, 2)):
            row = (t * 100 + k, letter(), letter())
            if not used & {("n", row[1]), ("s", row[2])} - {("n", None), ("s", None)}:
                used |= {("n", row[1]), ("s", row[2])}
                old.append(row)
        new = [(t * 100 + 10 + k, letter(), letter()) for k in range(rnd.randint(0, 7))]
        olds, news, want = olds + old, news + new, want + one_by_one(old, new)
    rnd.shuffle(news)
    got = M.insert_ignoring(spark.createDataFrame(olds, THREE), spark.createDataFrame(news, THREE).repartition(5), [["name"], ["slug"]])
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_insert_on_any_key_in_a_given_order(spark):
    new = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, "b", "y"), (4, None, None), (4, None, None)], THREE)
    none = new.limit(0)
    at = lambda order: sorted(r.id for r in M.insert_ignoring(none, new.withColumn("late", -F.col("id")), [["name"], ["slug"]], order).collect())
    none = none.withColumn("late", F.col("id"))
    assert at(None) == [1, 3, 4, 4]
    assert at(["late"]) == [1, 3, 4, 4]
    chain = spark.createDataFrame([(k, f"n{k // 2}", f"s{(k + 1) // 2}") for k in range(12)], THREE)  # each row hangs on the one before
    assert sorted(r.id for r in M.insert_ignoring(chain.limit(0), chain, [["name"], ["slug"]]).collect()) == [0, 2, 4, 6, 8, 10]


def test_insert_on_a_key_of_most_rows(spark):
    rows = [(k, "same", f"s{k}") for k in range(3000)] + [(k, f"n{k}", "one") for k in range(3000, 3010)]
    df = spark.createDataFrame(rows, THREE)
    assert sorted(r.id for r in M.insert_ignoring(df.limit(0), df, [["name"], ["slug"]]).collect()) == [0, 3000]


def site(spark):
    users = spark.createDataFrame([("u1",), ("u2",), (None,)], "id string")
    roles = spark.createDataFrame([("r1", "u1"), ("r2", "u2")], "id string, user_id string")
    posts = spark.createDataFrame([("p1", "u1"), ("p2", "u2"), ("p3", None)], "id string, author_id string")
    comments = spark.createDataFrame([("c1", "p1"), ("c2", "p2"), ("c3", "p3"), ("c4", None), ("c5", "p1")], "id string, blog_post_id string")
    resume = spark.createDataFrame([("s1", "u1"), ("s2", "u2")], "id string, user_id string")
    return {"blog_comments": comments, "resume": resume, "users": users, "blog_posts": posts, "user_roles": roles}


def ids(tables):
    return {n: sorted(str(r.id) for r in df.collect()) for n, df in tables.items()}


def test_cascade_follows_all_references(spark):
    left = ids(M.delete_cascading(site(spark), "users", F.col("id") == "u1"))
    assert left == {"users": ["None", "u2"], "user_roles": ["r2"], "blog_posts": ["p2", "p3"], "blog_comments": ["c2", "c3", "c4"], "resume": ["s2"]}
    left = ids(M.delete_cascading(site(spark), "blog_posts", F.col("id") == "p1"))
    assert left["users"] == ["None", "u1", "u2"] and left["blog_comments"] == ["c2", "c3", "c4"]
    assert ids(M.delete_cascading(site(spark), "users", F.col("id") == "nobody")) == ids(site(spark))
    assert ids(M.delete_cascading({"users": site(spark)["users"]}, "users", F.col("id").isNull()))["users"] == ["u1", "u2"]


def test_cascade_reads_each_table_once(spark, tmp_path):
    tables = {}
    for name, df in site(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    left = M.delete_cascading(tables, "users", F.col("id") == "u1")
    plan = left["blog_comments"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # users, posts, comments


def test_cascade_over_rings_and_restrictions(spark):
    t = site(spark)
    refs = {"blog_posts": {"author_id": ("users", "id", True)}, "blog_comments": {"blog_post_id": ("blog_posts", "id", False)}}
    with pytest.raises(M.ReferenceError):
        M.delete_cascading(t, "users", F.col("id") == "u1", refs)
    assert ids(M.delete_cascading({**t, "blog_comments": t["blog_comments"].limit(0)}, "users", F.col("id") == "u1", refs))["blog_posts"] == ["p2", "p3"]
    ring = {"users": {"id": ("resume", "id", True)}, "resume": {"user_id": ("users", "id", True)}}
    with pytest.raises(ValueError, match="ring"):
        M.delete_cascading(t, "users", F.lit(True), ring)
    two = {"blog_comments": {"id": ("resume", "id", True), "blog_post_id": ("blog_posts", "id", True)}, "blog_posts": {"author_id": ("users", "id", True)}, "resume": {"user_id": ("users", "id", True)}}
    assert ids(M.delete_cascading(t, "users", F.col("id") == "u1", two))["blog_comments"] == ["c2", "c3", "c4"]


ROLES = [("1", "u1", "admin"), ("2", "u1", "admin"), ("2", "u2", "owner"), (None, None, "user"), ("5", "u3", None), ("6", "gone", "user")]


def test_all_constraints_at_once(spark, tmp_path):
    spark.createDataFrame(ROLES, "id string, user_id string, role string").write.parquet(f"{tmp_path}/roles")
    df, users = spark.read.parquet(f"{tmp_path}/roles"), spark.createDataFrame([("u1",), ("u2",), ("u3",), (None,), ("u1",)], "id string")
    table = TABLES["user_roles"]
    got = {r.constraint: r.n for r in V.constraint_counts(df, table, {"users": users}).collect()}
    assert got == {"not null id": 1, "not null user_id": 1, "not null role": 1, "check role IN ('admin', 'user')": 1, "unique id": 1, "unique user_id, role": 1, "reference user_id": 1}
    assert got == {name: frame.count() for name, frame in V.violations(df, table, {"users": users}).items()}
    plan = V.constraint_counts(df, table, {"users": users})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    none = {r.constraint: r.n for r in V.constraint_counts(df.limit(0), table).collect()}
    assert set(none.values()) == {0} and len(none) == 6
