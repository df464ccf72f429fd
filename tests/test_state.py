"""Triggers, folds over logs, publication of tables, tables in the catalog, columns of any JSON."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from vellum import functions as S
from vellum.operators import mutate as M
from vellum.operators.fold import current_notice
from vellum.operators.triggers import SITE, TOUCHED, Registry, Trigger
from vellum.schema import TABLES
from vellum.sources import ddl
from vellum.sources.store import ConstraintError, Store

AS_OF, LATER = dt.datetime(2024, 6, 1, tzinfo=dt.UTC), dt.datetime(2024, 7, 1, tzinfo=dt.UTC)


@pytest.mark.parametrize("table", sorted(TABLES))
def test_updates_touch_five_tables(spark, table):
    given = {"id": "1", "content": "old", "blog_post_id": "1", "featured": True}
    cols = [f for f in TABLES[table].schema if f.name in given]
    new = spark.createDataFrame([tuple(given[f.name] for f in cols)] + [tuple("2" if f.name == "id" else given[f.name] for f in cols)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols))
    old = M.with_defaults(new, TABLES[table], AS_OF)
    got = {r.id: r for r in M.update(old, F.col("id") == "1", {"id": F.lit("3")}, LATER, table).collect()}
    assert set(got) == {"2", "3"}
    if "updated_at" in old.columns:
        assert table in TOUCHED
        assert got["3"].updated_at == LATER.replace(tzinfo=None) or got["3"].updated_at.month == 7
        assert got["2"].updated_at.month == 6 and got["3"].created_at.month == 6
    else:
        assert table not in TOUCHED


def test_reading_time_follows_content_only_in_changed_rows(spark):
    posts = spark.createDataFrame([("1", "w " * 250, 99), ("2", "w " * 250, 99), ("3", None, 99)], "id string, content string, reading_time int")
    inserted = M.insert(M.with_defaults(posts.limit(0), TABLES["blog_posts"], AS_OF), posts, "blog_posts", AS_OF)
    assert [(r.id, r.reading_time) for r in inserted.orderBy("id").collect()] == [("1", 2), ("2", 2), ("3", 1)]
    changed = M.update(posts, F.col("id") == "1", {"content": F.lit("short")}, LATER, "blog_posts")
    assert [(r.id, r.reading_time) for r in changed.orderBy("id").collect()] == [("1", 1), ("2", 99), ("3", 99)]


def test_triggers_fire_by_name_and_see_each_other(spark):
    add = lambda letter: lambda row, as_of: {"name": F.concat(row["name"], F.lit(letter))}
    both = frozenset({"insert", "update"})
    r = Registry((Trigger("b", "t", both, add("b")), Trigger("a", "t", both, add("a")), Trigger("c", "t", frozenset({"update"}), add("c")), Trigger("a", "other", both, add("x"))))
    df = spark.createDataFrame([("1", "n"), ("2", "n")], "id string, name string")
    names = lambda reg, event, where=None: [x.name for x in reg.before(df, "t", event, AS_OF, where).orderBy("id").collect()]
    assert names(r, "insert") == ["nab", "nab"] and names(r, "update") == ["nabc", "nabc"] and names(r, "delete") == ["n", "n"]
    assert names(r, "update", F.col("id") == "2") == ["n", "nabc"]
    assert names(r.with_trigger(Trigger("a", "t", both, add("z"))), "insert") == ["nzb", "nzb"]
    assert names(r.without("t", "a").without("t", "none"), "insert") == ["nb", "nb"]
    assert [t.name for t in SITE.of("blog_posts", "update")] == ["calculate_blog_reading_time", "update_blog_posts_updated_at"]


def test_an_insert_of_users_makes_the_first_admin(spark):
    users = spark.createDataFrame([("u1", "a@b.c", AS_OF), ("u2", "d@e.f", LATER)], "id string, email string, created_at timestamp")
    roles = spark.createDataFrame([], "id string, user_id string, role string")
    tables = M.insert_into({"users": users.limit(0), "user_roles": roles}, "users", users, AS_OF)
    assert [(r.user_id, r.role) for r in tables["user_roles"].collect()] == [("u1", "admin")] and tables["users"].count() == 2
    again = M.insert_into(tables, "users", users.where("id = 'u2'"), AS_OF)
    assert again["user_roles"].count() == 1
    posts = M.insert_into({"blog_posts": M.with_defaults(users.limit(0).select("id"), TABLES["blog_posts"], AS_OF)}, "blog_posts", spark.createDataFrame([("1", "w")], "id string, content string"), AS_OF)
    assert posts["blog_posts"].first().reading_time == 1


def folded(log):
    """One key's log, one after the other."""
    shown = None
    for action, i, title, tone, is_open in log:
        if action == "add" and i is not None:
            shown = {"id": i, "title": title, "tone": tone, "open": True}
        elif shown and action == "update" and i == shown["id"]:
            shown |= {k: v for k, v in (("title", title), ("tone", tone), ("open", is_open)) if v is not None}
        elif shown and action == "dismiss" and i in (None, shown["id"]):
            shown["open"] = False
        elif action == "remove" and shown and i in (None, shown["id"]):
            shown = None
    return (shown["id"], shown["title"], shown["tone"], shown["open"]) if shown else (None,) * 4


def test_notices_are_the_sequential_fold(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for key in (None, *range(400)):
        action = lambda: rnd.choice(["add", "add", "update", "update", "update", "dismiss", "remove", "other"])
        log = [(action(), rnd.choice([None, "a", "b"]), rnd.choice([None, "t", "u"]), rnd.choice([None, "x", "y"]), rnd.choice([None, None, True, False])) for _ in range(rnd.randint(1, 12))]
        if any(a != "other" for a, *_ in log):
            want[key] = folded(log)
        rows += [(key, t, n, *entry) for n, entry in enumerate(log) for t in [n // 3]]
    rnd.shuffle(rows)
    log = spark.createDataFrame(rows, "who long, at long, n long, action string, id string, title string, tone string, open boolean").repartition(7)
    got = {r.who: tuple(r)[1:] for r in current_notice(log, "who", ["at", "n"], ["title", "tone"]).collect()}
    assert got == want
    assert current_notice(log.limit(0), "who", ["at", "n"], ["title", "tone"]).count() == 0


def test_notices_combine_before_they_are_shuffled(spark):
    log = spark.range(10).selectExpr("0 AS who", "id AS n", "'add' AS action", "'a' AS id", "'t' AS title", "true AS open")
    plan = current_notice(log, "who", ["n"], ["title"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("partial_max") >= 2


def test_publication_is_seen_at_once_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    contacts = spark.createDataFrame([("1", "n", "e@x.y", "m", "unread", AS_OF)], TABLES["contacts"].schema)
    assert not store.exists("contacts")
    with pytest.raises(FileNotFoundError):
        store.read("contacts")
    first = store.publish("contacts", contacts, TABLES["contacts"])
    changed = M.update(first, F.col("id") == "1", {"status": F.lit("read")}, AS_OF, "contacts")
    after = store.publish("contacts", changed.unionByName(changed.withColumn("id", F.lit("2"))), TABLES["contacts"])
    assert sorted((r.id, r.status) for r in after.collect()) == [("1", "read"), ("2", "read")]
    assert [r.status for r in first.collect()] == ["unread"]  # who read before still sees what was
    fails = F.when(F.col("id") == "2", F.raise_error(F.lit("lost"))).otherwise(F.lit("archived"))
    with pytest.raises(Exception, match="lost"):
        store.publish("contacts", after.withColumn("status", fails.cast("string")), TABLES["contacts"])
    with pytest.raises(ConstraintError) as e:
        store.publish("contacts", after.withColumns({"status": F.lit("gone"), "name": F.when(F.col("id") == "1", F.col("name"))}), TABLES["contacts"])
    assert e.value.counts == {"not null name": 1, "check status IN ('unread', 'read', 'archived')": 2}
    assert sorted(r.status for r in store.read("contacts").collect()) == ["read", "read"]
    folders = lambda: sum(p.is_dir() for p in (tmp_path / "store/contacts").iterdir())
    assert folders() == 2  # failed writes leave nothing
    store.tidy("contacts")
    assert folders() == 1 and store.read("contacts").count() == 2
    assert store.publish("contacts", after.limit(0)).count() == 0


@pytest.fixture
def database(spark):
    name = f"site_{uuid.uuid4().hex}"
    ddl.create_tables(spark, name)
    yield name
    ddl.drop_database(spark, name)


def test_tables_of_the_catalog(spark, database):
    for name, table in TABLES.items():
        made = spark.table(f"{database}.{name}")
        assert [(f.name, f.dataType) for f in made.schema] == [(f.name, f.dataType) for f in table.schema]
    ddl.create_tables(spark, database)  # once more is no error
    spark.sql(f"INSERT INTO {database}.testimonials (id, name, position, company, content) VALUES ('1', 'n', 'p', 'c', 't')")
    spark.sql(f"INSERT INTO {database}.testimonials (id, name, position, company, content, rating, featured) VALUES ('2', 'n', 'p', 'c', 't', NULL, NULL)")
    rows = {r.id: r for r in spark.table(f"{database}.testimonials").collect()}
    assert (rows["1"].rating, rows["1"].featured) == (5, False) and rows["1"].created_at is not None
    assert (rows["2"].rating, rows["2"].featured) == (None, None)
    spark.sql(f"INSERT INTO {database}.resume (id, full_name, email) VALUES ('1', 'n', 'e')")
    assert spark.sql(f"SELECT to_json(skills) AS s FROM {database}.resume").first().s == "[]"


def test_columns_are_added_with_what_old_rows_read(spark, database):
    spark.sql(f"CREATE TABLE {database}.early (id STRING) USING parquet")
    spark.sql(f"INSERT INTO {database}.early VALUES ('1')")
    assert ddl.add_column(spark, database, "early", "slug", "STRING", "'none'")
    assert not ddl.add_column(spark, database, "early", "Slug", "STRING", "'other'")
    assert ddl.add_column(spark, database, "early", "note", "STRING")
    spark.sql(f"INSERT INTO {database}.early (id) VALUES ('2')")
    spark.sql(f"INSERT INTO {database}.early (id, slug) VALUES ('3', NULL)")
    assert sorted((r.id, r.slug, r.note) for r in spark.table(f"{database}.early").collect()) == [("1", "none", None), ("2", "none", None), ("3", None, None)]
    spark.sql(f"CREATE TABLE {database}.old_projects (id STRING, title STRING) USING parquet")
    spark.sql(f"INSERT INTO {database}.old_projects VALUES ('1', 't')")
    import dataclasses

    added = ddl.missing_columns(spark, database, dataclasses.replace(TABLES["projects"], name="old_projects"))
    assert len(added) == len(TABLES["projects"].schema) - 2
    row = spark.table(f"{database}.old_projects").first()
    assert row.featured is False and row.gallery_images == [] and row.slug is None


def test_columns_of_any_json(spark, tmp_path):
    """Texts, objects, lists, numbers and nulls in one column, written and read again."""
    cases = [
        ("""'{"a":1}'""", '{"a":1}'), ("""'"{\\\\"a\\\\":1}"'""", '{"a":1}'), ("""'["x"]'""", '["x"]'), ("""'"[1, 2]"'""", "[1,2]"), ("'null'", "[]"), ("NULL", "[]"),
        ("""'"not json"'""", "[]"), ("""'""'""", "[]"), ("'false'", "[]"), ("'true'", "true"), ("'0'", "[]"), ("'0.0'", "[]"), ("'7'", "7"), ("'{}'", "{}"), ("'[]'", "[]"),
    ]
    df = spark.sql(" UNION ALL ".join(f"SELECT {k} AS id, parse_json({sql}) AS skills" for k, (sql, _) in enumerate(cases)))
    df.write.parquet(f"{tmp_path}/resume")
    got = spark.read.parquet(f"{tmp_path}/resume").select("id", F.to_json(S.tolerant(F.col("skills"))).alias("v")).orderBy("id").collect()
    assert [r.v for r in got] == [want for _, want in cases]
    other = df.select(F.to_json(S.tolerant(F.col("skills"), '{"k":[]}')).alias("v"), "id").orderBy("id").collect()
    assert other[4].v == '{"k":[]}' and other[0].v == '{"a":1}'
