"""Edge cases of the core library on small inline tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vellum import functions as S
from vellum.operators import mutate as M
from vellum.operators import policy as P
from vellum.operators import relation as R
from vellum.operators import validate as V
from vellum.schema import TABLES, with_missing_columns

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)


def values(spark, kind, inputs, f):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_single_rows(spark):
    rows = lambda n: R.Relation(spark.range(n))
    assert rows(1).single().id == 0 and rows(1).maybe_single().id == 0 and rows(0).maybe_single() is None
    for n in (0, 2):
        with pytest.raises(R.CardinalityError):
            rows(n).single()
    with pytest.raises(R.CardinalityError):
        rows(2).maybe_single()


def test_null_order_and_three_valued_filters(spark):
    t = spark.createDataFrame([(1, None), (2, True), (3, False)], "id int, on boolean")
    assert [r.id for r in R.Relation(t).order("on", False).frame().collect()] == [1, 2, 3]
    assert [r.id for r in R.Relation(t).order("on").frame().collect()] == [3, 2, 1]
    assert [r.id for r in R.Relation(t).eq("on", True).frame().collect()] == [2]


def test_numbered_matches_one_window(spark):
    ids = [k * k % 1009 * 10**9 for k in range(500)]
    got = R.numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id", "place").collect()
    assert sorted(r.place for r in got) == list(range(500)) and [r.id for r in sorted(got, key=lambda r: r.place)] == sorted(ids)
    assert R.numbered(spark.range(0), "id", "place").count() == 0


def test_text_functions(spark):
    assert values(spark, "string", [None, "", "w " * 199 + "w", "w " * 200 + "w", "a  b", "a\nb"], S.reading_time) == [1, 1, 1, 2, 1, 1]
    assert values(spark, "string", [" Hello, World!  A--B "], S.slugify) == ["-hello-world-a-b-"]
    assert values(spark, "string", ["", None, "own"], lambda c: S.slug_or(c, F.lit("A Title"))) == ["a-title", "a-title", "own"]
    assert values(spark, "string", [" \tx﻿"], S.js_trim) == ["x"]
    assert values(spark, "string", ["!'()*~ a/é&"], S.encode_uri_component) == ["!'()*~%20a%2F%C3%A9%26"]
    for platform, start in (("twitter", "https://twitter.com/intent/tweet?text=t&url=u"), ("linkedin", "https://www.linkedin.com/sharing/share-offsite/?url=u"), ("facebook", "https://www.facebook.com/sharer/sharer.php?u=u"), ("other", "")):
        assert values(spark, "string", [platform], lambda c: S.share_url(c, F.lit("u"), F.lit("t"))) == [start]
    assert values(spark, "string", [" a, b ,c", ""], S.split_list) == [["a", "b", "c"], [""]]
    assert values(spark, "array<string>", [[], ["a"], None], S.empty_null) == [None, ["a"], None]
    assert values(spark, "array<string>", [[], list("abc"), list("abcd"), None], lambda a: S.overflow(a, 3)) == [None, None, 1, None]
    assert values(spark, "string", ["12px", " -7", "x1", "", None, "9" * 30], S.parse_int) == [12, -7, None, None, None, None]


def test_dates(spark):
    t = dt.datetime(2024, 3, 5, 16, 7, tzinfo=dt.UTC)
    assert values(spark, "timestamp", [None, t], S.date_short) == ["1/1/1970", "3/5/2024"]
    assert values(spark, "timestamp", [None, t], S.date_long) == ["January 1, 1970", "March 5, 2024"]
    assert values(spark, "timestamp", [None, t], S.date_time_long) == ["Invalid Date", "March 5, 2024 at 04:07 PM"]
    ages = [NOW - dt.timedelta(hours=23, minutes=59, seconds=59), NOW - dt.timedelta(hours=24), None]
    assert values(spark, "timestamp", ages, lambda c: S.within_hours(c, F.lit(NOW).cast("timestamp"))) == [True, False, False]
    assert values(spark, "timestamp", ages[1:], lambda c: S.hours_since(c, F.lit(NOW).cast("timestamp"))) == [24.0, None]


def test_tolerant_json(spark):
    inputs = [None, "not json", '{"tools":["b"],"technical":["a"],"certifications":["plain",{"name":"n"},{}]}', '["a"]', '{"tools":"x"}']
    assert values(spark, "string", inputs, lambda c: S.resume_skills(S.parsed(c))) == [[], [], ["a", "b"], [], []]
    assert values(spark, "string", inputs, lambda c: S.resume_certifications(S.parsed(c))) == [[], [], ["plain", "n", ""], [], []]
    degrees = ['{"degrees":[{"degree":"BSc","institution":"U","graduation_year":2001},{"year":"1999"},{}]}', "[]"]
    got = values(spark, "string", degrees, lambda c: S.resume_degrees(S.parsed(c)))
    assert [tuple(d) for d in got[0]] == [("BSc", "U", "2001"), ("", "", "1999"), ("", "", "")] and got[1] == []


def test_insert_defaults_and_triggers(spark):
    none = M.with_defaults(spark.createDataFrame([], "title string"), TABLES["blog_posts"], NOW)
    new = spark.createDataFrame([("A", "a", "w " * 250, 7, None)], "title string, slug string, content string, reading_time int, published boolean")
    row = M.insert(none, new, "blog_posts", NOW).first()
    assert row.reading_time == 2 and row.published is None and row.tags == [] and len(row.id) == 36 and row.created_at is not None
    one = M.insert(none, new.withColumn("id", F.lit("x")), "blog_posts", NOW - dt.timedelta(days=1))
    later = M.update(one, F.col("id") == "x", {"content": F.lit("short")}, NOW, "blog_posts").first()
    assert later.reading_time == 1 and later.updated_at > later.created_at
    assert M.update(one, F.col("id") == "y", {"content": F.lit("short")}, NOW, "blog_posts").first().reading_time == 2
    assert M.delete(one, F.col("excerpt") == "x").count() == 1


def test_insert_ignoring_several_keys(spark):
    old = spark.createDataFrame([("1", "a", "x")], "id string, name string, slug string")
    new = spark.createDataFrame([("2", "a", "y"), ("3", "b", "x"), ("4", "c", "z"), ("5", "c", "w"), ("6", None, "v"), ("7", None, "u"), ("8", "d", "v")], old.schema)
    assert sorted(r.id for r in M.insert_ignoring(old, new, [["name"], ["slug"]]).collect()) == ["1", "4", "6", "7"]
    again = M.insert_ignoring(old, new, [["name"]])
    assert sorted(r.id for r in again.collect()) == ["1", "3", "4", "6", "7", "8"]
    assert M.insert_ignoring(again, new.where("name IS NOT NULL"), [["name"]]).count() == again.count()


def test_replace_or_insert(spark):
    old = M.with_defaults(spark.createDataFrame([("1", "Ann", "a@x.yz", "5")], "id string, full_name string, email string, phone string"), TABLES["resume"], NOW - dt.timedelta(days=1))
    new = spark.createDataFrame([("1", "Anna", "a@x.yz"), ("2", "Bo", "b@x.yz")], "id string, full_name string, email string")
    got = {r.id: r for r in M.replace_or_insert(old, new, "resume", NOW).collect()}
    assert (got["1"].full_name, got["1"].phone, got["2"].full_name, got["2"].skills.toPython()) == ("Anna", "5", "Bo", [])
    assert got["1"].updated_at > got["1"].created_at


def test_cascades(spark):
    users, posts = spark.createDataFrame([("u1",)], "id string"), spark.createDataFrame([("p1", "u1"), ("p2", "u2"), ("p3", None)], "id string, author_id string")
    comments = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2")], "id string, blog_post_id string")
    left = M.cascade(posts, "author_id", users)
    assert sorted(r.id for r in left.collect()) == ["p2", "p3"]
    gone = posts.join(left, "id", "left_anti")
    assert [r.id for r in M.cascade(comments, "blog_post_id", gone).collect()] == ["c3"]


def test_first_administrators(spark):
    roles = spark.createDataFrame([], "id string, user_id string, role string")
    users = spark.createDataFrame([("b", "b@x", NOW), ("a", "a@x", NOW)], "id string, email string, created_at timestamp")
    first = M.appoint_first_admin(roles, users)
    assert [(r.user_id, r.role) for r in first.collect()] == [("a", "admin")]
    assert M.appoint_first_admin(spark.createDataFrame([("1", "z", "admin")], roles.schema), users).count() == 1
    assert [r.user_id for r in M.setup_admin(roles, users, "b@x").collect()] == ["b"]
    unknown = M.setup_admin(roles, users, "nobody@x")
    assert V.null_violations(unknown, "user_id").count() == 1


def test_constraints(spark):
    t = spark.createDataFrame([(0, "a"), (1, "b"), (5, None), (6, None), (None, "b")], "rating int, slug string")
    assert sorted(r.rating for r in V.check_violations(t, "rating >= 1 AND rating <= 5").collect()) == [0, 6]
    assert [(r.slug, r.n) for r in V.unique_violations(t, ["slug"]).collect()] == [("b", 2)]
    assert V.unique_violations(t, ["rating", "slug"]).count() == 0 and V.null_violations(t, "rating").count() == 1
    V.require_unique(t, ["rating"])
    with pytest.raises(V.UniqueError) as caught:
        V.require_unique(t, ["slug"])
    assert caught.value.code == "23505"
    posts = M.with_defaults(spark.createDataFrame([("1", "s", None), ("1", "s", "u9")], "id string, slug string, author_id string"), TABLES["blog_posts"], NOW)
    found = {k: v.count() for k, v in V.violations(posts, TABLES["blog_posts"], {"users": spark.createDataFrame([("u1",)], "id string")}).items()}
    assert found["not null title"] == 2 and found["unique id"] == 1 and found["unique slug"] == 1 and found["reference author_id"] == 1
    assert with_missing_columns(spark.range(1), TABLES["user_roles"]).columns == ["id", "user_id", "role"]


def test_error_outcomes(spark):
    rows = spark.createDataFrame([("23505", "policy"), ("42501", None), ("x", "row-level security policy"), ("x", "else"), (None, None)], "code string, message string")
    assert [r.o for r in rows.select(V.insert_outcome(F.col("code"), F.col("message")).alias("o")).collect()] == ["exists", "refused", "refused", "failed", None]


@pytest.mark.parametrize("mail, good", [("a@b.co", True), (" a.b+c@d-e.f.org ", True), (".a@b.co", False), ("a..b@c.co", False), ("a.@b.co", False), ("a@b", False), ("a@-b.co", False), ("a b@c.co", False), ("", False)])
def test_addresses(spark, mail, good):
    row = spark.range(1).select(V.contact_faults(F.lit("n"), F.lit(mail), F.lit("m")).alias("f")).first().f
    assert (row.email is None) == good


def test_form_lengths(spark):
    fault = lambda name, message="m": spark.range(1).select(V.contact_faults(F.lit(name), F.lit("a@b.co"), F.lit(message)).alias("f")).first().f
    assert fault("x" * 100).name is None and fault("x" * 101).name == "Name must be less than 100 characters" and fault("  ").name == "Name is required"
    assert fault("😀" * 50).name is None and fault("😀" * 51).name is not None and fault("n", "  ").message == "Message is required"
    f = spark.range(1).select(V.sign_in_faults(F.lit("a@b.co"), F.lit("12345")).alias("f")).first().f
    assert f.email is None and f.password == "Password must be at least 6 characters"


def test_contact_states(spark):
    states = ["unread", "read", "archived", "replied"]
    assert values(spark, "string", states, M.next_status) == ["read", "archived", None, None]
    t = spark.createDataFrame(list(enumerate(states)), "id int, status string")
    assert {r.status for r in M.reply(t, F.lit(True), F.lit("Re"), F.lit("Hi"), NOW).collect()} == {"replied"}
    assert [r.status for r in M.reply(t, F.lit(True), F.lit(" "), F.lit("Hi"), NOW).orderBy("id").collect()] == states


ROLES = [("1", "boss", "admin"), ("2", "ann", "user")]


@pytest.mark.parametrize("table, anyone, own", [("contacts", 0, 0), ("projects", 2, 2), ("blog_posts", 1, 1), ("testimonials", 2, 2), ("resume", 2, 2), ("user_roles", 0, 1), ("blog_comments", 1, 1), ("blog_tags", 2, 2), ("blog_categories", 2, 2), ("unknown", 0, 0)])
def test_policies(spark, table, anyone, own):
    roles = spark.createDataFrame(ROLES, "id string, user_id string, role string")
    rows = spark.createDataFrame([("ann", True, True), ("bob", None, False)], "user_id string, published boolean, approved boolean")
    seen = lambda who, command="select": P.secure(rows, table, P.Principal(who), roles, command).count()
    assert (seen(None), seen("ann"), seen("boss")) == (anyone, own, 2)
    for command in ("update", "delete"):
        assert (seen(None, command), seen("ann", command), seen("boss", command)) == (0, 0, 2)
    open_ = table in ("contacts", "blog_comments")
    for who in (None, "ann"):
        if open_:
            P.check_insert(rows, table, P.Principal(who), roles)
        else:
            with pytest.raises(P.PolicyError) as caught:
                P.check_insert(rows, table, P.Principal(who), roles)
            assert caught.value.code == "42501" and "policy" in str(caught.value)
    P.check_insert(rows, table, P.Principal("boss"), roles)


def test_first_administrator_may_appoint_themself(spark):
    none = spark.createDataFrame([], "id string, user_id string, role string")
    mine, other = (spark.createDataFrame([("1", who, "admin")], none.schema) for who in ("ann", "bob"))
    P.check_insert(mine, "user_roles", P.Principal("ann"), none)
    for rows, who, roles in ((other, "ann", none), (mine, "ann", other), (mine, None, none)):
        with pytest.raises(P.PolicyError):
            P.check_insert(rows, "user_roles", P.Principal(who), roles)


def test_stored_objects(spark):
    roles = spark.createDataFrame(ROLES, "id string, user_id string, role string")
    objects = spark.createDataFrame([("images", "a"), ("images", "b"), ("other", "c")], "bucket_id string, name string")
    seen = lambda who, command: P.bucket_objects(objects, "images", P.Principal(who), roles, command).count()
    assert [seen(None, "select"), seen(None, "delete"), seen("ann", "update"), seen("boss", "delete")] == [2, 0, 0, 2]


def test_repeated_texts_are_found_either_way(spark, monkeypatch):
    t = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), (None, "x"), ("b", "z"), ("b", "z"), ("b", "z")], "name string, slug string")
    for sent in (V.SENT, 0):
        monkeypatch.setattr(V, "SENT", sent)
        assert sorted(tuple(r) for r in V.unique_violations(t, ["name", "slug"]).collect()) == [("a", "x", 2), ("b", "z", 3)]


def test_passes_and_doors(spark):
    as_of, ms = F.lit(NOW).cast("timestamp"), int(NOW.timestamp() * 1000)
    rows = [("u", f"{ms - 86399999}", "u"), ("u", f"{ms - 86400000}", "u"), ("u", "soon", "u"), ("u", "", "u"), ("u", None, "u"), ("v", f"{ms}", "u"), (None, f"{ms}", "u"), ("u", f"{ms}", None), ("u", f" {ms}px", "u")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, stored string, at string, user string")
    got = df.select("k", S.bypass_state(F.col("stored"), F.col("at"), F.col("user"), as_of).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == ["admin", "purge", "purge", None, None, None, None, None, "admin"]
    doors = spark.createDataFrame([("u", True), ("u", False), ("u", None), (None, True)], "user string, admin boolean")
    assert [r[0] for r in doors.select(S.may_enter(F.col("user"), F.col("admin"))).collect()] == [True, False, False, False]


def test_trim_looks_at_the_ends_alone(spark):
    """Next line (85) is no space to JavaScript; a run of spaces within is passed once, not once from each of its characters."""
    spaces = "\t\n\x0b\f\r \xa0        　﻿"
    given = ["a \x85", f"{spaces}a b{spaces}", spaces, "​ a", "᠎", "", None, " \U0001f600 "]
    assert values(spark, "string", given, S.js_trim) == ["a \x85", "a b", "", "​ a", "᠎", "", None, "\U0001f600"]
    assert "regexp" not in spark.range(1).select(S.js_trim(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    long = "a" + " " * 300_000 + "b"
    assert values(spark, "string", [long + " "], S.js_trim) == [long]
