"""Application queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import functions as S
from vellum.operators import mutate as M
from vellum.operators.fold import current_notice
from vellum.operators import policy as P
from vellum.operators import relation as R
from vellum.operators import validate as V
from vellum.schema import TABLES
from vellum.session import settled, shared_dir
from vellum.sources import ddl, site
from vellum.sources.store import ConstraintError, Store

AS_OF = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name. In sql, {blog_posts} and the like stand for the site's tables."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = re.sub(r"\{(\w+)\}", lambda m: f"({site.SQL[m[1]]}) AS {m[1]}", sql)
        return f

    return add


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# The blog.


@query("""SELECT id, title, slug, CASE WHEN content = '' THEN 1 ELSE CAST(greatest(ceil(len(string_split(trim(content, ' '), ' ')) / 200.0), 1) AS INTEGER) END AS reading_time,
    array_to_string(tags[1:3], ',') AS first_tags, array_to_string(categories[1:2], ',') AS first_categories, CAST(CASE WHEN len(categories) > 3 THEN len(categories) - 3 END AS INTEGER) AS more,
    strftime(created_at, '%-m/%-d/%Y') AS shown_date FROM {blog_posts} WHERE published""")
def blog_list(spark, d):
    posts = P.secure(site.blog_posts(spark, d), "blog_posts", P.Principal(), None)
    shown = posts.select(
        "id", "title", "slug", "reading_time", F.array_join(S.first_items(F.col("tags"), 3), ",").alias("first_tags"), F.array_join(S.first_items(F.col("categories"), 2), ",").alias("first_categories"),
        S.overflow(F.col("categories"), 3).alias("more"), S.date_short(F.col("created_at")).alias("shown_date"), "created_at",
    )
    return R.Relation(shown).order("created_at", ascending=False).frame().drop("created_at")


@query("""SELECT id, title, slug, excerpt, published, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM {blog_posts} WHERE slug LIKE '%-17' AND id = '17'""")
def blog_post_by_slug(spark, d):
    return R.Relation(site.blog_posts(spark, d).where(F.col("slug").endswith("-17"))).eq("id", "17").select("id, title, slug, excerpt, published, created_at").frame().withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT p.id AS post_id, c.id AS comment_id, c.author_name, strftime(c.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM {blog_comments} c JOIN {blog_posts} p ON c.blog_post_id = p.id WHERE c.approved""".replace("{blog_comments} c", "(SELECT * FROM {blog_comments}) c").replace("{blog_posts} p", "(SELECT * FROM {blog_posts}) p"))
def post_with_comments(spark, d):
    c = P.secure(site.blog_comments(spark, d), "blog_comments", P.Principal(), None)
    p = site.blog_posts(spark, d).select(F.col("id").alias("post_id"))
    return c.join(p, c.blog_post_id == p.post_id).select("post_id", F.col("id").alias("comment_id"), "author_name", _time("created_at"))


@query("SELECT blog_post_id, count(*) AS n FROM {blog_comments} WHERE approved GROUP BY blog_post_id")
def comment_count_per_post(spark, d):
    return site.blog_comments(spark, d).where("approved").groupBy("blog_post_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 1 ELSE CAST(greatest(ceil(len(string_split(trim(text, ' '), ' ')) / 200.0), 1) AS INTEGER) END AS minutes FROM documents")
def reading_time(spark, d):
    return site.raw(spark, d, "documents").select("doc_id", S.reading_time(F.col("text")).alias("minutes"))


# Text.


@query(f"SELECT doc_id, {site._SLUG.format(t='text')} AS slug FROM documents")
def slugify(spark, d):
    return site.raw(spark, d, "documents").select("doc_id", S.slugify(F.col("text")).alias("slug"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '\s+', '-', 'g') AS slug FROM part")
def slugify_simple(spark, d):
    return site.raw(spark, d, "part").select("p_partkey", S.slugify_simple(F.col("p_name")).alias("slug"))


@query("SELECT p_partkey, upper(array_to_string(list_transform(string_split(p_name, ' '), lambda t: substr(t, 1, 1)), '')) AS initials, substr(upper(array_to_string(list_transform(string_split(p_name, ' '), lambda t: substr(t, 1, 1)), '')), 1, 2) AS two FROM part")
def initials(spark, d):
    return site.raw(spark, d, "part").select("p_partkey", S.initials(F.col("p_name")).alias("initials"), S.initials(F.col("p_name"), 2).alias("two"))


@query("SELECT id, coalesce(nullif(excerpt, ''), nullif(meta_description, ''), '') AS summary FROM {blog_posts}")
def coalesce_falsy(spark, d):
    return site.blog_posts(spark, d).select("id", S.first_truthy(F.col("excerpt"), F.col("meta_description")).alias("summary"))


@query("SELECT id, coalesce(published, false) AS published, nullif(excerpt, '') AS excerpt, coalesce(excerpt, '') AS edited FROM {blog_posts}")
def coalesce_nullish(spark, d):
    return site.blog_posts(spark, d).select("id", F.coalesce("published", F.lit(False)).alias("published"), S.falsy_null(F.col("excerpt")).alias("excerpt"), F.coalesce("excerpt", F.lit("")).alias("edited"))


@query("SELECT p_partkey, p_name AS js, chr(160) || chr(9) || p_name || chr(9) AS pg FROM part")
def trims(spark, d):
    padded = F.concat(F.lit("   \t"), F.col("p_name"), F.lit("\t  "))
    return site.raw(spark, d, "part").select("p_partkey", S.js_trim(padded).alias("js"), F.trim(padded).alias("pg"))


@query("SELECT p_partkey, p_name || ', ' || p_brand || ', ' || p_type AS joined, CAST(3 AS INTEGER) AS n FROM part")
def csv_split_join(spark, d):
    parts = S.split_list(F.concat(F.lit(" "), F.concat_ws(" ,", "p_name", "p_brand", "p_type"), F.lit("  ")))
    return site.raw(spark, d, "part").select("p_partkey", F.array_join(parts, ", ").alias("joined"), F.size(parts).alias("n"))


@query("SELECT page_id, list_last(string_split(url, '.')) AS extension FROM pages")
def file_extension(spark, d):
    return site.raw(spark, d, "pages").select("page_id", S.file_extension(F.col("url")).alias("extension"))


@query("""SELECT page_id, 'https://twitter.com/intent/tweet?text=' || replace(replace(replace(replace(replace(url_encode(url || ' !(*)'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') || '&url=' || replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') AS shared FROM pages""")
def url_encode_component(spark, d):
    return site.raw(spark, d, "pages").select("page_id", S.share_url(F.lit("twitter"), F.col("url"), F.concat("url", F.lit(" !(*)"))).alias("shared"))


@query("SELECT event_id, 'Re: Your message from' || name AS subject, email || ' at' || name AS place, CASE WHEN event_id % 3 <> 1 THEN 's' ELSE '' END AS plural FROM {contacts}")
def templates(spark, d):
    return site.contacts(spark, d).select("event_id", F.concat(F.lit("Re: Your message from"), "name").alias("subject"), F.concat("email", F.lit(" at"), "name").alias("place"), S.plural(F.col("event_id") % 3).alias("plural"))


# Lists.


@query("SELECT id, array_to_string(tech_stack[1:2], '|') AS first_two, CAST(CASE WHEN len(tech_stack) > 3 THEN len(tech_stack) - 3 END AS INTEGER) AS more FROM {projects}")
def array_prefix_more(spark, d):
    return site.projects(spark, d).select("id", F.array_join(S.first_items(F.col("tech_stack"), 2), "|").alias("first_two"), S.overflow(F.col("tech_stack"), 3).alias("more"))


@query("SELECT id, array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i < rating THEN '*' ELSE '-' END), '') AS stars FROM {testimonials} WHERE rating IS NOT NULL")
def star_array(spark, d):
    shown = F.transform(S.stars(F.col("rating")), lambda x: F.when(x, "*").otherwise("-"))
    return site.testimonials(spark, d).where(F.col("rating").isNotNull()).select("id", F.array_join(shown, "").alias("stars"))


@query("SELECT id, array_to_string(CASE WHEN list_contains(tech_stack, 'red') THEN tech_stack ELSE list_append(tech_stack, 'red') END, '|') AS added, array_to_string(list_filter(tech_stack, lambda x: x <> tech_stack[1]), '|') AS removed, array_to_string(tech_stack[1:1] || tech_stack[3:], '|') AS cut, array_to_string(['set'] || tech_stack[2:], '|') AS put, array_to_string(tech_stack || tech_stack[1:1], '|') AS joined FROM {projects}")
def array_edits(spark, d):
    a = F.col("tech_stack")
    show = lambda c, n: F.array_join(c, "|").alias(n)
    return site.projects(spark, d).select(
        "id", show(S.append_absent(a, F.lit(" red ")), "added"), show(S.without_item(a, F.get(a, 0)), "removed"), show(S.without_index(a, 1), "cut"), show(S.with_index(a, 0, F.lit("set")), "put"), show(S.concat_lists(a, F.lit(None).cast("array<string>"), S.first_items(a, 1)), "joined")
    )


@query("SELECT id, CAST(i - 1 AS INTEGER) AS place, tech_stack[i] AS item FROM (SELECT id, tech_stack, unnest(range(1, len(tech_stack) + 1)) AS i FROM {projects})")
def array_explode(spark, d):
    return site.projects(spark, d).select("id", F.posexplode("tech_stack").alias("place", "item"))


@query("SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) * 100 AS INTEGER) AS delay FROM {testimonials}")
def view_model_order(spark, d):
    return R.numbered(site.testimonials(spark, d).select("id"), "id", "place").select("id", (F.col("place") * 100).cast("int").alias("delay"))


# JSON.


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return site.raw(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a|b' ELSE '' END AS skills, CASE event_id % 3 WHEN 0 THEN 't:c:d1, d2' ELSE '' END AS positions, CASE event_id % 3 WHEN 0 THEN 'plain|named|' ELSE '' END AS certifications FROM events")
def json_resume(spark, d):
    good = '{"technical":["a"],"tools":["b"],"positions":[{"title":"t","company":"c","responsibilities":["d1","d2"],"description":"x"}],"certifications":["plain",{"name":"named"},{}]}'
    c = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, "not json").otherwise('["a","b"]')
    v = F.col("v")
    positions = F.transform(S.resume_positions(v), lambda p: F.concat_ws(":", p.title, p.company, p.description))
    rows = site.raw(spark, d, "events").select("event_id", S.parsed(c).alias("v"))
    return rows.select("event_id", F.array_join(S.resume_skills(v), "|").alias("skills"), F.array_join(positions, "|").alias("positions"), F.array_join(S.resume_certifications(v), "|").alias("certifications"))


@query("SELECT event_id, 'BSc:' || event_id || ':' || CASE event_id % 2 WHEN 0 THEN '2001' ELSE '1999' END AS degrees FROM events")
def json_degrees(spark, d):
    year = F.when(F.col("event_id") % 2 == 0, '"graduation_year":2001').otherwise('"year":"1999"')
    c = F.concat(F.lit('{"degrees":[{"degree":"BSc","institution":"'), F.col("event_id"), F.lit('",'), year, F.lit("}]}"))
    rows = site.raw(spark, d, "events").select("event_id", S.parsed(c).alias("v"))
    shown = F.transform(S.resume_degrees(F.col("v")), lambda x: F.concat_ws(":", x.degree, x.institution, x.year))
    return rows.select("event_id", F.array_join(shown, "|").alias("degrees"))


@query("SELECT event_id, CAST(event_id AS BIGINT) AS n FROM events")
def parse_int(spark, d):
    return site.raw(spark, d, "events").select("event_id", S.parse_int(F.concat(F.lit(" "), "event_id", F.lit("px"))).alias("n"))


# Dates.


@query("""SELECT event_id, strftime(created_at, '%-m/%-d/%Y') AS short, strftime(created_at, '%B %-d, %Y') AS long, strftime(created_at, '%B %-d, %Y at %I:%M %p') AS timed, CAST(2024 AS INTEGER) AS year_now FROM {contacts}""")
def dates(spark, d):
    t = F.col("created_at")
    return site.contacts(spark, d).select("event_id", S.date_short(t).alias("short"), S.date_long(t).alias("long"), S.date_time_long(t).alias("timed"), F.year(F.lit(AS_OF)).alias("year_now"))


@query("SELECT event_id, CAST(1717200000000 - epoch_us(created_at) // 1000 AS BIGINT) AS age_ms, 1717200000000 - epoch_us(created_at) // 1000 < 86400000 AS valid FROM {contacts}")
def ttl_valid(spark, d):
    as_of = F.lit(AS_OF).cast("timestamp")
    return site.contacts(spark, d).select("event_id", (F.unix_millis(as_of) - F.unix_millis("created_at")).alias("age_ms"), S.within_hours(F.col("created_at"), as_of).alias("valid"))


# Filters.


@query("SELECT id FROM {blog_comments} WHERE approved AND blog_post_id = '7'")
def filter_eq_chain(spark, d):
    return R.Relation(site.blog_comments(spark, d)).eq("blog_post_id", "7").eq("approved", True).select("id").frame()


@query("SELECT event_id FROM {contacts} WHERE status IN ('unread', 'read')")
def filter_in(spark, d):
    return R.Relation(site.contacts(spark, d)).is_in("status", ["unread", "read"]).select("event_id").frame()


@query("SELECT id FROM {testimonials} WHERE rating BETWEEN 2 AND 4")
def filter_between(spark, d):
    return site.testimonials(spark, d).where(F.col("rating").between(2, 4)).select("id")


@query("SELECT id FROM {projects} WHERE featured IS NOT NULL AND NOT featured")
def filter_not_null(spark, d):
    return site.projects(spark, d).where(F.col("featured").isNotNull() & ~F.col("featured")).select("id")


# Joins and subqueries.


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def exists_semi(spark, d):
    o = site.raw(spark, d, "orders").where(F.col("o_totalprice") > 200000)
    return site.raw(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def not_exists_anti(spark, d):
    o = site.raw(spark, d, "orders").where(F.col("o_totalprice") > 200000)
    return site.raw(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT ur.*, u.email FROM (SELECT * FROM {user_roles}) ur JOIN (SELECT * FROM {users}) u ON ur.user_id = u.id")
def roles_join_users(spark, d):
    ur, u = site.user_roles(spark, d).alias("ur"), site.users(spark, d).alias("u")
    return ur.join(u, F.col("ur.user_id") == F.col("u.id")).select("ur.*", "u.email")


@query("SELECT ur.*, u.email FROM (SELECT * FROM {user_roles}) ur JOIN (SELECT * FROM {users}) u ON ur.user_id = u.id WHERE u.email LIKE '%7@mail.example'")
def roles_join_users_by_email(spark, d):
    return roles_join_users(spark, d).where(F.col("email").endswith("7@mail.example"))


@query("SELECT (SELECT min(id) FROM {users} WHERE email = 'customer#000000007@mail.example') AS user_id, EXISTS (SELECT 1 FROM {user_roles} WHERE role = 'admin') AS any_admin")
def scalar_lookup(spark, d):
    found = site.users(spark, d).where(F.col("email") == "customer#000000007@mail.example").agg(F.min("id").alias("user_id"))
    return found.withColumn("any_admin", F.lit(P.has_any_admin(site.user_roles(spark, d))))


@query("SELECT (SELECT min(id) FROM {users} WHERE email = (SELECT min(email) FROM {users})) AS user_id, NOT EXISTS (SELECT 1 FROM {user_roles} WHERE role = 'admin' AND user_id = '-') AS others")
def scalar_lookup_known(spark, d):
    users = site.users(spark, d)
    found = users.join(users.agg(F.min("email").alias("email")), "email").agg(F.min("id").alias("user_id"))
    return found.withColumn("others", ~F.lit(P.has_role(site.user_roles(spark, d), "-")))


# Order and limit.


@query("SELECT event_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM {contacts} ORDER BY contacts.created_at DESC NULLS FIRST, event_id LIMIT 5")
def top_recent(spark, d):
    return R.Relation(site.contacts(spark, d).select("event_id", "created_at")).order("created_at", False).order("event_id").limit(5).frame().select("event_id", _time("created_at"))


@query("SELECT id, featured FROM {projects} ORDER BY featured DESC NULLS FIRST, created_at DESC NULLS FIRST, id LIMIT 40")
def featured_order_topk(spark, d):
    return R.Relation(site.projects(spark, d)).order("featured", False).order("created_at", False).order("id").limit(40).select("id, featured").frame()


@query("SELECT id FROM {blog_comments} ORDER BY approved ASC NULLS LAST, created_at ASC NULLS LAST, id LIMIT 30")
def asc_order_topk(spark, d):
    return R.Relation(site.blog_comments(spark, d)).order("approved").order("created_at").order("id").limit(30).select("id").frame()


# Changes.


@query("SELECT user_id, role FROM {user_roles} UNION ALL SELECT id, 'admin' FROM {users} WHERE CAST(id AS BIGINT) % 3 = 0 OR NOT EXISTS (SELECT 1 FROM {user_roles} WHERE user_roles.user_id = users.id AND user_roles.role = 'admin')")
def upsert_ignore(spark, d):
    new = site.users(spark, d).select(F.concat(F.lit("n"), "id").alias("id"), F.col("id").alias("user_id"), F.lit("admin").alias("role"))
    return M.insert_ignoring(site.user_roles(spark, d), new.union(new), [["user_id", "role"]]).select("user_id", "role")


@query("SELECT id, CASE WHEN rating IS NULL THEN 'null' ELSE CAST(rating AS VARCHAR) END AS rating, featured FROM {testimonials} UNION ALL SELECT id + 1000000, '5', false FROM {testimonials}")
def insert_defaults(spark, d):
    old = site.testimonials(spark, d).select(F.col("id").cast("string"), "name", "rating", "featured")
    new = old.select((F.col("id").cast("long") + 1000000).cast("string").alias("id"), "name")
    made = M.with_defaults(new, M.TABLES["testimonials"], AS_OF).select("id", "name", "rating", "featured")
    return old.unionByName(made).select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("rating").cast("string"), F.lit("null")).alias("rating"), "featured")


@query("SELECT event_id, CASE WHEN event_id = 12 THEN 'archived' ELSE status END AS status FROM {contacts}")
def update_by_key(spark, d):
    return M.update(site.contacts(spark, d), F.col("event_id") == 12, {"status": F.lit("archived")}, AS_OF).select("event_id", "status")


@query("SELECT event_id FROM {contacts} WHERE event_id <> 12")
def delete_by_key(spark, d):
    return M.delete(site.contacts(spark, d), F.col("event_id") == 12).select("event_id")


@query("SELECT id FROM {blog_comments} WHERE CAST(blog_post_id AS BIGINT) % 2 = 1")
def cascade_delete(spark, d):
    gone = site.blog_posts(spark, d).where(F.col("id").cast("long") % 2 == 0)
    all_ids = site.blog_comments(spark, d).select(F.col("blog_post_id").alias("id")).where(F.col("id").cast("long") % 2 == 0)
    return M.cascade(M.cascade(site.blog_comments(spark, d), "blog_post_id", gone), "blog_post_id", all_ids).select("id")


@query("SELECT id, title, reading_time, published FROM (SELECT id, title, CASE WHEN content = '' THEN 1 ELSE CAST(greatest(ceil(len(string_split(trim(content, ' '), ' ')) / 200.0), 1) AS INTEGER) END AS reading_time, false AS published FROM {blog_posts})")
def insert_with_trigger(spark, d):
    new = site.blog_posts(spark, d, labelled=False).select("id", "title", "slug", "content").withColumn("reading_time", F.lit(99))
    none = M.with_defaults(new.where(F.lit(False)), M.TABLES["blog_posts"], AS_OF)
    return M.insert(none, new, "blog_posts", AS_OF).select("id", "title", "reading_time", "published")


@query("SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'new' ELSE 'old' END AS content, 1 AS reading_time, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '2024-06-01' ELSE '2024-05-01' END AS updated FROM {blog_posts}")
def update_with_triggers(spark, d):
    import datetime as dt

    given = site.blog_posts(spark, d).select("id", "title", "slug").withColumn("content", F.lit("old"))
    before = AS_OF - dt.timedelta(days=31)
    old = M.SITE.before(M.with_defaults(given, M.TABLES["blog_posts"], before), "blog_posts", "insert", before)
    new = M.update(old, F.col("id").cast("long") % 2 == 0, {"content": F.lit("new")}, AS_OF, "blog_posts")
    return new.select("id", "content", "reading_time", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'new' ELSE 'old' END AS full_name, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'kept' ELSE NULL END AS phone FROM {users} WHERE CAST(id AS BIGINT) % 2 = 0 UNION ALL SELECT id, 'new', NULL FROM {users} WHERE CAST(id AS BIGINT) % 2 = 1")
def replace_or_insert(spark, d):
    """Half of the users have a resume, all save one."""
    users = site.users(spark, d).select("id", F.lit("new").alias("full_name"), "email")
    old = M.with_defaults(users.where(F.col("id").cast("long") % 2 == 0).withColumns({"full_name": F.lit("old"), "phone": F.lit("kept")}), M.TABLES["resume"], AS_OF)
    return M.replace_or_insert(old, users, "resume", AS_OF).select("id", "full_name", "phone")


# Checks.


@query("SELECT event_id, status FROM {contacts} WHERE status NOT IN ('unread', 'read', 'archived')")
def check_violations(spark, d):
    return V.check_violations(site.contacts(spark, d), "status IN ('unread', 'read', 'archived')").select("event_id", "status")


@query("SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def unique_violations(spark, d):
    return V.unique_violations(site.raw(spark, d, "documents"), ["text"])


@query("SELECT excerpt, count(*) AS n FROM (SELECT CASE WHEN excerpt <> '' THEN excerpt END AS excerpt FROM {blog_posts}) WHERE excerpt IS NOT NULL GROUP BY excerpt HAVING count(*) > 1")
def partial_unique_violations(spark, d):
    return V.unique_violations(site.blog_posts(spark, d).select(S.falsy_null(F.col("excerpt")).alias("excerpt")), ["excerpt"])


@query("SELECT id FROM {blog_comments} WHERE NOT EXISTS (SELECT 1 FROM labels WHERE CAST(labels.doc_id AS VARCHAR) = blog_comments.blog_post_id)")
def fk_violations(spark, d):
    parents = site.raw(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return V.reference_violations(site.blog_comments(spark, d), "blog_post_id", parents).select("id")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Name is required' END AS name, CASE WHEN event_id % 2 = 0 THEN 'Invalid email address' END AS email,
    CASE WHEN length(repeat(message, 120)) > 1000 THEN 'Message must be less than 1000 characters' END AS message FROM {contacts}""")
def contact_validation(spark, d):
    c = site.contacts(spark, d).withColumn("name", F.when(F.col("event_id") % 5 == 0, "   ").otherwise(F.col("name"))).withColumn("email", F.when(F.col("event_id") % 2 == 0, "no mail").otherwise(F.lit(" a.b@c.example ")))
    return c.select("event_id", V.contact_faults(F.col("name"), F.col("email"), F.repeat("message", F.lit(120))).alias("f")).select("event_id", "f.*")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'replied' ELSE status END AS status FROM {contacts}")
def contact_replied(spark, d):
    return M.reply(site.contacts(spark, d), F.col("event_id") % 2 == 0, F.lit("Re"), F.lit(" Hello "), AS_OF).select("event_id", "status")


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'Invalid email address' END AS email, CASE WHEN event_id % 3 = 0 THEN 'Password must be at least 6 characters' END AS password FROM events")
def sign_in_validation(spark, d):
    email, password = F.when(F.col("event_id") % 2 == 1, "a..b@c.example").otherwise("a.b@c.example"), F.when(F.col("event_id") % 3 == 0, "12345").otherwise("123456")
    return site.raw(spark, d, "events").select("event_id", V.sign_in_faults(email, password).alias("f")).select("event_id", "f.*")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'exists' WHEN 1 THEN 'refused' WHEN 2 THEN 'refused' ELSE 'failed' END AS outcome FROM events")
def insert_outcomes(spark, d):
    kind = F.col("event_id") % 4
    code, message = F.when(kind == 0, "23505").when(kind == 1, "42501"), F.when(kind == 2, "new row violates row-level security policy").otherwise("x")
    return site.raw(spark, d, "events").select("event_id", V.insert_outcome(code, message).alias("outcome"))


@query("SELECT event_id, CASE status WHEN 'unread' THEN 'read' WHEN 'read' THEN 'archived' END AS next, CASE status WHEN 'unread' THEN 'new' ELSE 'seen' END AS badge FROM {contacts}")
def contact_transitions(spark, d):
    return site.contacts(spark, d).select("event_id", M.next_status(F.col("status")).alias("next"), F.when(F.col("status") == "unread", "new").otherwise("seen").alias("badge"))


@query("SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'Sample shop'), (-2, 'Sample board'), (-3, 'Sample feed')) v(id, title)")
def fallback_when_empty(spark, d):
    none = site.projects(spark, d).select("id", "title").where(F.col("title") == "")
    return R.or_else(none, site.sample_projects(spark))


@query("SELECT id, title FROM {projects}")
def fallback_unused(spark, d):
    return R.or_else(site.projects(spark, d).select("id", "title"), site.sample_projects(spark))


@query("SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'Sample reader', 5), (-2, 'Sample editor', 5), (-3, 'Sample author', 5)) v(id, name, rating)")
def fallback_testimonials(spark, d):
    none = site.testimonials(spark, d).select("id", "name", "rating").where(F.col("rating") > 5)
    return R.or_else(none, site.sample_testimonials(spark))


@query("""SELECT id, category, skill FROM {resumes} JOIN (VALUES (0, 'Backend', 'APIs'), (0, 'Backend', 'Databases'), (1, 'Frontend', 'Pages'), (1, 'Frontend', 'Forms'), (1, 'Frontend', 'Charts')) v(k, category, skill)
    ON k = CAST(user_id AS BIGINT) // 2 % 2""")
def literal_nested(spark, d):
    """The fixed groups of skills beside each resume, one row a skill; half of the resumes show either group."""
    group = F.when((F.col("user_id").cast("long") / 2).cast("long") % 2 == 0, "Backend").otherwise("Frontend")
    groups = F.broadcast(site.skill_groups(spark))  # two rows
    return site.resumes(spark, d).select("id", group.alias("category")).join(groups, "category").select("id", "category", F.explode("skills").alias("skill"))


@query("SELECT 'Database setup completed' AS message, count(*) AS users, (SELECT count(*) FROM {user_roles} WHERE role = 'admin') AS admins FROM {users}".replace("FROM {users}", "FROM (SELECT * FROM {users}) u"))
def constant_select(spark, d):
    """The last line of a set-up: a constant, beside what is there now."""
    admins = site.user_roles(spark, d).agg(F.count_if(F.col("role") == "admin")).scalar()
    return site.users(spark, d).agg(F.count("*").alias("users")).select(F.lit("Database setup completed").alias("message"), "users", admins.alias("admins"))


# Policies.


@query("SELECT id FROM {blog_comments} WHERE approved")
def rls_comments_public(spark, d):
    return P.secure(site.blog_comments(spark, d), "blog_comments", P.Principal(), site.user_roles(spark, d)).select("id")


@query("SELECT event_id FROM {contacts} WHERE EXISTS (SELECT 1 FROM {user_roles} WHERE user_id = (SELECT min(user_id) FROM {user_roles} WHERE role = 'admin') AND role = 'admin')")
def rls_contacts_admin(spark, d):
    roles = site.user_roles(spark, d)
    admin = roles.where(F.col("role") == "admin").agg(F.min("user_id")).first()[0]
    return P.secure(site.contacts(spark, d), "contacts", P.Principal(admin), roles).select("event_id")


@query("SELECT event_id FROM {contacts} WHERE false")
def rls_contacts_public(spark, d):
    return P.secure(site.contacts(spark, d), "contacts", P.Principal(), None).select("event_id")


@query("SELECT id, user_id FROM {user_roles} WHERE user_id = (SELECT min(user_id) FROM {user_roles} WHERE role = 'user')")
def rls_roles_own(spark, d):
    roles = site.user_roles(spark, d)
    me = roles.where(F.col("role") == "user").agg(F.min("user_id")).first()[0]
    return P.secure(roles, "user_roles", P.Principal(me), roles).select("id", "user_id")


@query("SELECT user_id, role FROM {user_roles} WHERE role = 'user' UNION ALL SELECT id, 'admin' FROM {users} WHERE id = '0'")
def first_admin(spark, d):
    """Once all administrators have been deleted, the earliest user becomes one."""
    roles = M.delete(site.user_roles(spark, d), F.col("role") == "admin")
    return M.appoint_first_admin(roles, site.users(spark, d)).select("user_id", "role")


@query("SELECT count(*) AS n, count(*) FILTER (role = 'admin') AS admins FROM {user_roles}")
def first_admin_exists(spark, d):
    roles = site.user_roles(spark, d)
    return M.appoint_first_admin(roles, site.users(spark, d)).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "admin").alias("admins"))


@query("SELECT user_id, role FROM {user_roles} UNION ALL SELECT id, 'admin' FROM {users} WHERE id = '3'")
def setup_admin(spark, d):
    users = site.users(spark, d)
    email = users.where(F.col("id") == "3").first().email
    return M.setup_admin(site.user_roles(spark, d), users, email).select("user_id", "role")


@query("SELECT id FROM {blog_posts}")
def rls_posts_admin(spark, d):
    roles = site.user_roles(spark, d)
    admin = roles.where(F.col("role") == "admin").agg(F.min("user_id")).first()[0]
    return P.secure(site.blog_posts(spark, d), "blog_posts", P.Principal(admin), roles).select("id")


@query("SELECT 'projects' AS name, count(*) AS n FROM {projects} UNION ALL SELECT 'testimonials', count(*) FROM {testimonials} UNION ALL SELECT 'deletes', 0")
def rls_open_tables(spark, d):
    """Anyone reads projects and testimonials, and deletes nothing."""
    anyone, roles = P.Principal(), site.user_roles(spark, d)
    seen = lambda f, name: P.secure(f(spark, d), name, anyone, roles).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    gone = P.secure(site.projects(spark, d), "projects", anyone, roles, "delete").agg(F.lit("deletes").alias("name"), F.count("*").alias("n"))
    return seen(site.projects, "projects").union(seen(site.testimonials, "testimonials")).union(gone)


@query("SELECT id FROM {blog_comments} WHERE CAST(blog_post_id AS BIGINT) % 3 <> 0")
def cascade_from_users(spark, d):
    """Posts of deleted authors go, and with them their comments."""
    gone = site.users(spark, d).where(F.col("id").cast("long") % 3 == 0)
    ids = site.blog_comments(spark, d).select(F.col("blog_post_id").alias("id")).distinct()
    posts = ids.withColumn("author_id", F.when(F.col("id").cast("long") % 3 == 0, gone.agg(F.min("id")).scalar()))
    left = M.cascade(posts, "author_id", gone)
    return M.cascade(site.blog_comments(spark, d), "blog_post_id", ids.join(left.select("id"), "id", "left_anti")).select("id")


# Changes over several keys and tables.


@query("""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM {tags} WHERE id % 5 > 0),
    old AS (SELECT min(id) AS id, name, min(slug) AS slug FROM {tags} WHERE id % 5 = 0 AND name IS NOT NULL AND slug IS NOT NULL GROUP BY name),
    walk AS (SELECT 0::BIGINT AS k, (SELECT list(name) FROM old) AS names, (SELECT list(slug) FROM old) AS slugs, NULL::BIGINT AS id UNION ALL
      SELECT r.k, CASE WHEN ok AND r.name IS NOT NULL THEN list_append(names, r.name) ELSE names END, CASE WHEN ok AND r.slug IS NOT NULL THEN list_append(slugs, r.slug) ELSE slugs END, CASE WHEN ok THEN r.id END
      FROM (SELECT w.k, w.names, w.slugs, r.id AS rid, NOT coalesce(list_contains(w.names, r.name), false) AND NOT coalesce(list_contains(w.slugs, r.slug), false) AS ok FROM walk w JOIN ranked r ON r.k = w.k + 1) w JOIN ranked r ON r.id = w.rid)
    SELECT id FROM old UNION ALL SELECT id FROM walk WHERE id IS NOT NULL""")
def insert_any_key(spark, d):
    """Proposed tags are inserted one by one unless their name or slug is taken."""
    tags = site.tags(spark, d)
    old = tags.where("id % 5 = 0 AND name IS NOT NULL AND slug IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"), F.min("slug").alias("slug")).select("id", "name", "slug")
    return M.insert_ignoring(old, tags.where("id % 5 > 0"), [["name"], ["slug"]], order=["id"]).select("id")


_GONE = "CAST({c} AS BIGINT) % 3 = 0"


@query(f"""SELECT 'users' AS name, id FROM {{users}} WHERE NOT {_GONE.format(c="id")} UNION ALL SELECT 'user_roles', id FROM {{user_roles}} WHERE NOT {_GONE.format(c="user_id")}
    UNION ALL SELECT 'resume', id FROM {{resumes}} WHERE NOT {_GONE.format(c="user_id")}
    UNION ALL SELECT 'blog_posts', id FROM {{blog_posts}} WHERE author_id IS NULL OR NOT {_GONE.format(c="author_id")}
    UNION ALL SELECT 'blog_comments', c.id FROM (SELECT * FROM {{blog_comments}}) c LEFT JOIN (SELECT * FROM {{blog_posts}}) p ON p.id = c.blog_post_id WHERE p.author_id IS NULL OR NOT {_GONE.format(c="p.author_id")}""")
def cascade_graph(spark, d):
    """Every third user goes, and with them their roles, resumes, posts and all comments on those."""
    tables = {"users": site.users, "user_roles": site.user_roles, "resume": site.resumes, "blog_posts": site.blog_posts, "blog_comments": site.blog_comments}
    left = M.delete_cascading({n: f(spark, d) for n, f in tables.items()}, "users", F.col("id").cast("long") % 3 == 0)
    shown = [df.select(F.lit(n).alias("name"), "id") for n, df in left.items()]
    return shown[0].union(shown[1]).union(shown[2]).union(shown[3]).union(shown[4])


@query("""SELECT 'projects' AS name, CAST(id AS VARCHAR) AS id, CASE WHEN id % 2 = 0 THEN '2024-06-01' ELSE '2024-05-01' END AS updated FROM {projects}
    UNION ALL SELECT 'testimonials', CAST(id AS VARCHAR), CASE WHEN id % 2 = 0 THEN '2024-06-01' ELSE '2024-05-01' END FROM {testimonials}
    UNION ALL SELECT 'blog_posts', id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN '2024-06-01' ELSE '2024-05-01' END FROM {blog_posts}
    UNION ALL SELECT 'blog_comments', id, CASE WHEN CAST(blog_post_id AS BIGINT) % 2 = 0 THEN '2024-06-01' ELSE '2024-05-01' END FROM {blog_comments}
    UNION ALL SELECT 'resume', id, CASE WHEN CAST(user_id AS BIGINT) % 4 = 0 THEN '2024-06-01' ELSE '2024-05-01' END FROM {resumes}""")
def triggers_by_table(spark, d):
    """An update of half the rows of each of five tables; its triggers set updated_at there and nowhere else."""
    before, out = AS_OF - dt.timedelta(days=31), None
    for name, rows, hit in (
        ("projects", site.projects, F.col("id") % 2 == 0), ("testimonials", site.testimonials, F.col("id") % 2 == 0), ("blog_posts", site.blog_posts, F.col("id").cast("long") % 2 == 0),
        ("blog_comments", site.blog_comments, F.col("blog_post_id").cast("long") % 2 == 0), ("resume", site.resumes, F.col("user_id").cast("long") % 4 == 0),
    ):
        given = rows(spark, d).drop("created_at")
        old = given.withColumn("updated_at", F.lit(before).cast("timestamp"))
        new = M.update(old, hit, {"id": F.col("id")}, AS_OF, name).select(F.lit(name).alias("name"), F.col("id").cast("string").alias("id"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))
        out = new if out is None else out.union(new)
    return out


# All constraints of a table at once.


_COUNTS = " UNION ALL ".join(
    f"SELECT '{name}' AS name, '{rule}' AS \"constraint\", ({sql}) AS n"
    for name, rule, sql in (
        *((t, f"not null {c}", f"SELECT count(*) FILTER ({c} IS NULL) FROM {{{v}}}") for t, v, cs in (("blog_posts", "blog_posts", "id title slug content"), ("user_roles", "user_roles", "id user_id role"), ("blog_tags", "tags", "id name slug")) for c in cs.split()),
        *((t, f"unique {', '.join(cs)}", f"SELECT count(*) FROM (SELECT 1 FROM {{{v}}} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cs)} GROUP BY {', '.join(cs)} HAVING count(*) > 1)")
          for t, v, cs in (("blog_posts", "blog_posts", ["id"]), ("blog_posts", "blog_posts", ["slug"]), ("user_roles", "user_roles", ["id"]), ("user_roles", "user_roles", ["user_id", "role"]), ("blog_tags", "tags", ["id"]), ("blog_tags", "tags", ["name"]), ("blog_tags", "tags", ["slug"]))),
        ("user_roles", "check role IN (''admin'', ''user'')", "SELECT count(*) FROM {user_roles} WHERE role NOT IN ('admin', 'user')"),
        ("user_roles", "reference user_id", "SELECT count(*) FROM {user_roles} WHERE user_id NOT IN (SELECT id FROM {users} WHERE CAST(id AS BIGINT) % 7 > 0)"),
        ("blog_posts", "reference author_id", "SELECT count(*) FROM {blog_posts} WHERE author_id NOT IN (SELECT id FROM {users} WHERE CAST(id AS BIGINT) % 7 > 0)"),
    )
)


@query(_COUNTS)
def constraint_counts(spark, d):
    """Every constraint of three tables, each table read once; every seventh user is missing."""
    users, out = site.users(spark, d).where(F.col("id").cast("long") % 7 > 0), None
    posts = lambda *a: site.blog_posts(*a, labelled=False)  # no constraint is on published
    for name, rows in (("blog_posts", posts), ("user_roles", site.user_roles), ("blog_tags", site.tags)):
        found = V.constraint_counts(rows(spark, d), TABLES[name], {"users": users}).select(F.lit(name).alias("name"), "constraint", "n")
        out = found if out is None else out.union(found)
    return out


@query("SELECT id FROM {tags} WHERE name IS NULL")
def null_violations(spark, d):
    return V.null_violations(site.tags(spark, d), "name").select("id")


# A log of changes folded.


@query("""WITH RECURSIVE log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type, CASE WHEN event_id % 6 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 END AS id,
      CASE WHEN event_id % 2 = 0 THEN props END AS title, CASE WHEN event_id % 4 < 3 THEN CAST(value AS VARCHAR) END AS tone, CASE WHEN event_id % 7 = 0 THEN true END AS reopen FROM events),
    walk AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::VARCHAR AS title, NULL::VARCHAR AS tone, NULL::BOOLEAN AS open FROM events GROUP BY user_id UNION ALL
      SELECT w.user_id, l.k, CASE WHEN adds THEN l.id WHEN goes THEN NULL ELSE w.id END, CASE WHEN adds THEN l.title WHEN goes THEN NULL WHEN sets THEN coalesce(l.title, w.title) ELSE w.title END,
        CASE WHEN adds THEN l.tone WHEN goes THEN NULL WHEN sets THEN coalesce(l.tone, w.tone) ELSE w.tone END, CASE WHEN adds THEN true WHEN goes THEN NULL WHEN shuts THEN false WHEN sets THEN coalesce(l.reopen, w.open) ELSE w.open END
      FROM walk w JOIN (SELECT *, event_type IN ('signup', 'purchase') AND id IS NOT NULL AS adds FROM log) l ON l.user_id = w.user_id AND l.k = w.k + 1,
        LATERAL (SELECT coalesce(l.id = w.id, false) AND l.event_type = 'click' AS sets, w.id IS NOT NULL AND (l.id IS NULL OR l.id = w.id) AND l.event_type = 'view' AS shuts, w.id IS NOT NULL AND (l.id IS NULL OR l.id = w.id) AND l.event_type = 'error' AS goes))
    SELECT user_id, id, title, tone, open FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def notice_fold(spark, d):
    """Each user's events as a log of notices: what is shown in the end."""
    e, k = site.raw(spark, d, "events"), F.col("event_id")
    action = F.when(F.col("event_type").isin("signup", "purchase"), "add").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "view", "dismiss").otherwise("remove")
    notice = F.when(k % 6 > 0, F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint") % 3)
    log = e.select("user_id", "ts", "event_id", action.alias("action"), notice.alias("id"), F.when(k % 2 == 0, F.col("props")).alias("title"), F.when(k % 4 < 3, F.col("value").cast("string")).alias("tone"), F.when(k % 7 == 0, True).alias("open"))
    return current_notice(log, "user_id", ["ts", "event_id"], ["title", "tone"])


# Rules as predicates.


def _admin_of(roles):
    return P.Principal(roles.where(F.col("role") == "admin").agg(F.min("user_id")).first()[0])


@query("""WITH a AS (SELECT min(user_id) AS me FROM {user_roles} WHERE role = 'admin'), u AS (SELECT min(user_id) AS me FROM {user_roles} WHERE role = 'user'),
    seen AS (SELECT 'contacts' AS name, count(*) AS every, 0 AS open, 0 AS own FROM {contacts} UNION ALL SELECT 'projects', count(*), count(*), 0 FROM {projects} UNION ALL SELECT 'testimonials', count(*), count(*), 0 FROM {testimonials}
      UNION ALL SELECT 'resume', count(*), count(*), 0 FROM {resumes} UNION ALL SELECT 'blog_tags', count(*), count(*), 0 FROM {tags} UNION ALL SELECT 'blog_posts', count(*), count(*) FILTER (published), 0 FROM {blog_posts}
      UNION ALL SELECT 'blog_comments', count(*), count(*) FILTER (approved), 0 FROM {blog_comments} UNION ALL SELECT 'user_roles', count(*), 0, count(*) FILTER (user_id = (SELECT me FROM u)) FROM {user_roles})
    SELECT name, 'admin' AS who, every AS sees, every AS changes FROM seen UNION ALL SELECT name, 'user', open + own, 0 FROM seen UNION ALL SELECT name, 'anyone', open, 0 FROM seen""")
def rls_by_table(spark, d):
    """How many rows of each table an administrator, a user and anyone see and may change, by rules that are part of one plan."""
    roles = site.user_roles(spark, d)
    P.install_functions(spark, roles)
    user = P.Principal(roles.where(F.col("role") == "user").agg(F.min("user_id")).first()[0])
    who = {"admin": _admin_of(roles), "user": user, "anyone": P.Principal()}
    out = None
    for name, rows in (
        ("contacts", site.contacts), ("projects", site.projects), ("testimonials", site.testimonials), ("resume", site.resumes), ("blog_tags", site.tags), ("blog_posts", site.blog_posts), ("blog_comments", site.blog_comments), ("user_roles", site.user_roles),
    ):
        df = rows(spark, d)
        counted = [F.count_if(P.lets_through(name, c, p.user_id)).alias(f"{w}_{c}") for w, p in who.items() for c in ("select", "update")]
        one = df.agg(*counted).select(F.explode(F.array(*[F.struct(F.lit(w).alias("who"), F.col(f"{w}_select").alias("sees"), F.col(f"{w}_update").alias("changes")) for w in who])).alias("x"))
        one = one.select(F.lit(name).alias("name"), "x.*")
        out = one if out is None else out.union(one)
    return out


@query("SELECT id, CASE WHEN CAST(user_id AS BIGINT) % 2 = 0 THEN 'user' ELSE role END AS role FROM {user_roles}")
def rls_update_checked(spark, d):
    """An administrator makes users of half of all; each changed row is asked about again."""
    roles = site.user_roles(spark, d)
    P.install_functions(spark, roles)
    return P.secured_update(roles, F.col("user_id").cast("long") % 2 == 0, {"role": F.lit("user")}, "user_roles", _admin_of(roles)).select("id", "role")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'purge' WHEN 1717200000000 - epoch_us(ts) // 1000 < 86400000 THEN 'admin' ELSE 'purge' END AS pass,
    CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 OR NOT 1717200000000 - epoch_us(ts) // 1000 < 86400000 THEN event_id % 4 = 0 ELSE true END AS enters FROM events""")
def bypass_states(spark, d):
    """A remembered pass of each event's time: another's, one that is no number, young or expired; with it or the role the pages open."""
    e, k = site.raw(spark, d, "events"), F.col("event_id")
    at = F.when(k % 5 == 0, "soon").otherwise(F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
    user = F.col("user_id").cast("string")
    state = S.bypass_state(F.when(k % 3 == 0, "another").otherwise(user), at, user, F.lit(AS_OF).cast("timestamp"))
    rows = e.select("event_id", user.alias("user"), state.alias("pass"), (k % 4 == 0).alias("role"))
    return rows.select("event_id", "pass", S.may_enter(F.col("user"), F.coalesce(F.col("pass") == "admin", F.lit(False)) | F.col("role")).alias("enters"))


# Tables that are written and read again.


@query("SELECT event_id AS id, CASE WHEN status = 'unread' THEN 'read' ELSE status END AS status FROM {contacts} WHERE status <> 'replied'")
def read_after_write(spark, d):
    """Contacts are published, changed and published again; a change that breaks a rule of the table isn't."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = site.contacts(spark, d).where("status <> 'replied'").withColumn("id", F.col("event_id").cast("string"))
    kept = store.publish("contacts", rows, TABLES["contacts"])
    kept = store.publish("contacts", M.update(kept, F.col("status") == "unread", {"status": F.lit("read")}, AS_OF, "contacts"), TABLES["contacts"])
    try:
        store.publish("contacts", kept.withColumn("status", F.lit("replied")), TABLES["contacts"])
    except ConstraintError:
        pass  # as meant
    return store.read("contacts").select(F.col("event_id").alias("id"), "status")


@query("""SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 THEN 5 WHEN id % 3 = 1 THEN NULL ELSE rating END AS rating, CASE WHEN id % 3 = 0 THEN false ELSE featured END AS featured, 'none' AS source FROM {testimonials}""")
def catalog_defaults(spark, d):
    """Testimonials inserted by SQL into a table of the catalog: rating and featured omitted, given as null, given; then a column is added."""
    database = f"site_{uuid.uuid4().hex}"
    site.testimonials(spark, d).createOrReplaceTempView("given_testimonials")
    ddl.create_tables(spark, database)
    try:
        same = "CAST(id AS STRING), name, '', '', ''"
        into = f"INSERT INTO {database}.testimonials (id, name, position, company, content"
        spark.sql(f"{into}) SELECT {same} FROM given_testimonials WHERE id % 3 = 0")
        spark.sql(f"{into}, rating, featured) SELECT {same}, NULL, featured FROM given_testimonials WHERE id % 3 = 1")
        spark.sql(f"{into}, rating, featured) SELECT {same}, rating, featured FROM given_testimonials WHERE id % 3 = 2")
        ddl.add_column(spark, database, "testimonials", "source", "STRING", "'none'")
        return settled(spark.table(f"{database}.testimonials").select("id", "rating", "featured", "source"))
    finally:
        ddl.drop_database(spark, database)


@query("SELECT id, skills_shown AS skills FROM {resumes}")
def resume_skills(spark, d):
    """Skills as objects, texts of JSON, lists, other texts and nulls in one variant column, stored and read again."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    kept = store.publish("resume", site.resumes(spark, d), TABLES["resume"])
    v = kept.select("id", S.tolerant(F.col("skills")).alias("v"))
    return v.select("id", F.array_join(S.resume_skills(F.col("v")), "|").alias("skills"))


# Reads of whole rows and forms.


@query("""SELECT id, title, slug, excerpt, content, featured_image, published, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, author_id, array_to_string(tags, '|') AS tags, array_to_string(categories, '|') AS categories,
    CASE WHEN content = '' THEN 1 ELSE CAST(greatest(ceil(len(string_split(trim(content, ' '), ' ')) / 200.0), 1) AS INTEGER) END AS reading_time, meta_description FROM {blog_posts} WHERE published""")
def post_pages(spark, d):
    """The thirteen columns of a post's page, for all that are published."""
    columns = "id, title, slug, excerpt, content, featured_image, published, created_at, author_id, tags, categories, reading_time, meta_description"
    page = R.Relation(site.blog_posts(spark, d)).select(columns).eq("published", True).frame()
    return page.withColumns({"created_at": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), "tags": F.array_join("tags", "|"), "categories": F.array_join("categories", "|")})


@query(f"SELECT id, CASE WHEN id % 4 = 0 OR slug IS NULL THEN {site._SLUG.format(t="coalesce(name, '')")} ELSE slug END AS slug FROM {{tags}}")
def slug_or_made(spark, d):
    """The slug that a form gives, else one made from the name."""
    t = site.tags(spark, d)
    return t.select("id", S.first_truthy(F.when(F.col("id") % 4 > 0, F.col("slug")).otherwise(""), S.slugify(F.coalesce("name", F.lit("")))).alias("slug"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '1/1/1970' ELSE strftime(created_at, '%-m/%-d/%Y') END AS short, CASE WHEN event_id % 3 = 0 THEN 'Invalid Date' ELSE strftime(created_at, '%B %-d, %Y at %I:%M %p') END AS timed,
    (1717200000000 - epoch_us(created_at) // 1000) / 3600000.0 AS hours FROM {contacts}""")
def dates_missing(spark, d):
    """Dates where every third is missing, and hours since."""
    t = F.when(F.col("event_id") % 3 > 0, F.col("created_at"))
    return site.contacts(spark, d).select("event_id", S.date_short(t).alias("short"), S.date_time_long(t).alias("timed"), S.hours_since(F.col("created_at"), F.lit(AS_OF).cast("timestamp")).alias("hours"))
