"""The content site's tables as views of the driver's tables, and its literal relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import reading_time, slugify

#: Minutes from here give each row its own time.
EPOCH = "2024-01-01 00:00:00"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + 60 * n)


def blog_posts(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """Documents as posts. Those without a label have a null published, so three-valued logic is real.

    What is made of a text is made before posts meet their labels, so a whole text is shuffled only for those who read content.
    Without labelled, published is null and nothing is shuffled.
    """
    d, q = raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("published"))
    title = F.substring("text", 1, 60)
    posts = d.select(
        "doc_id",
        F.col("doc_id").cast("string").alias("id"),
        title.alias("title"),
        F.concat(slugify(title), F.lit("-"), F.col("doc_id")).alias("slug"),
        F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.substring("text", 1, 30)).alias("excerpt"),
        F.col("text").alias("content"),
        reading_time(F.col("text")).alias("reading_time"),
        F.array("source", "lang", F.lit("all")).alias("tags"),
        F.when(F.col("doc_id") % 5 > 0, F.array("lang", "source", F.lit("x"), F.lit("y"))).alias("categories"),
        F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)).otherwise("").alias("meta_description"),
        F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 150).cast("string")).alias("author_id"),
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("/images/"), "doc_id", F.lit(".png"))).alias("featured_image"),
        _minutes(F.col("doc_id")).alias("created_at"),
    )
    met = posts.join(q, "doc_id", "left") if labelled else posts.withColumn("published", F.lit(None).cast("boolean"))
    return met.drop("doc_id")


def blog_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("conv_id").cast("string").alias("blog_post_id"),
        F.col("role").alias("author_name"),
        F.col("text").alias("content"),
        F.when(F.col("turn") % 4 < 3, F.col("role") != "system").alias("approved"),
        _minutes(F.col("conv_id") * 100 + F.col("turn")).alias("created_at"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 4 == 0, "unread").when(F.col("event_id") % 4 == 1, "read").when(F.col("event_id") % 4 == 2, "archived").otherwise("replied")
    return e.select("event_id", F.concat(F.lit(" user "), F.col("user_id")).alias("name"), F.concat(F.col("event_type"), F.lit("@mail.example")).alias("email"), F.col("props").alias("message"), status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ").alias("tech_stack"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") > 25).alias("featured"), _minutes(F.col("p_partkey") % 1000).alias("created_at"), F.col("p_size").alias("size")
    )


def testimonials(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = raw(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 6 < 5, 1 + F.col("s_suppkey") % 6).cast("int").alias("rating"), (F.col("s_acctbal") > 5000).alias("featured"), _minutes(F.col("s_suppkey")).alias("created_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lower("c_name"), F.lit("@mail.example")).alias("email"), _minutes(F.col("c_custkey")).alias("created_at"))


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = raw(spark, sf_dir, "customer")
    return c.where(F.col("c_custkey") % 3 > 0).select(F.concat(F.lit("r"), F.col("c_custkey")).alias("id"), F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"))


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for every second customer; skills hold an object, a text of JSON, a list, a text that is none, or null."""
    c = raw(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0)
    k, name = F.col("c_custkey") % 10, F.col("c_mktsegment")
    listed = F.concat(F.lit('["'), name, F.lit('"]'))
    whole = F.concat(F.lit('{"technical":'), listed, F.lit(',"tools":["'), F.col("c_nationkey"), F.lit('"]}'))
    text = F.when(k == 0, whole).when(k == 2, F.to_json(F.struct(whole.alias("v")))).when(k == 4, listed).when(k == 6, F.to_json(F.struct(name.alias("v"))))
    skills = F.when(k.isin(2, 6), F.try_variant_get(F.parse_json(text), "$.v", "variant")).otherwise(F.parse_json(text))
    return c.select(F.concat(F.lit("s"), "c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("full_name"), F.concat(F.lower("c_name"), F.lit("@mail.example")).alias("email"), skills.alias("skills"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types of parts as tags that somebody proposed, one a part; many share a name or a slug."""
    p = raw(spark, sf_dir, "part")
    slug = F.concat(F.regexp_replace(F.lower("p_type"), " ", "-"), F.lit("-"), F.col("p_partkey") % 20)
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 > 0, F.concat_ws(" ", "p_brand", "p_size")).alias("name"), F.when(F.col("p_partkey") % 13 > 0, slug).alias("slug"))


def sample_projects(spark: SparkSession) -> DataFrame:
    """What the project section shows when there are none."""
    return spark.createDataFrame([(-1, "Sample shop"), (-2, "Sample board"), (-3, "Sample feed")], "id long, title string")


def sample_testimonials(spark: SparkSession) -> DataFrame:
    """What the testimonial section shows when there are none."""
    return spark.createDataFrame([(-1, "Sample reader", 5), (-2, "Sample editor", 5), (-3, "Sample author", 5)], "id long, name string, rating int")


def skill_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("Backend", ["APIs", "Databases"]), ("Frontend", ["Pages", "Forms", "Charts"])], "category string, skills array<string>")


#: The same views as DuckDB SQL.
_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9 -]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'))"
_AT = f"(TIMESTAMP '{EPOCH}' + to_minutes(CAST({{n}} AS BIGINT)))"
SQL = {
    "blog_posts": f"""SELECT CAST(d.doc_id AS VARCHAR) AS id, substr(text, 1, 60) AS title, {_SLUG.format(t="substr(text, 1, 60)")} || '-' || d.doc_id AS slug,
        CASE WHEN d.doc_id % 3 = 0 THEN '' WHEN d.doc_id % 3 = 2 THEN substr(text, 1, 30) END AS excerpt, text AS content, quality = 1 AS published,
        [source, lang, 'all'] AS tags, CASE WHEN d.doc_id % 5 > 0 THEN [lang, source, 'x', 'y'] END AS categories,
        CASE WHEN d.doc_id % 2 = 0 THEN substr(text, 1, 20) ELSE '' END AS meta_description, CASE WHEN d.doc_id % 4 > 0 THEN CAST(d.doc_id % 150 AS VARCHAR) END AS author_id,
        CASE WHEN d.doc_id % 6 = 0 THEN '/images/' || d.doc_id || '.png' END AS featured_image, {_AT.format(n="d.doc_id")} AS created_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "blog_comments": f"""SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS blog_post_id, role AS author_name, text AS content,
        CASE WHEN turn % 4 < 3 THEN role <> 'system' END AS approved, {_AT.format(n="conv_id * 100 + turn")} AS created_at FROM conversations""",
    "contacts": """SELECT event_id, ' user ' || user_id AS name, event_type || '@mail.example' AS email, props AS message,
        CASE event_id % 4 WHEN 0 THEN 'unread' WHEN 1 THEN 'read' WHEN 2 THEN 'archived' ELSE 'replied' END AS status, ts AS created_at FROM events""",
    "projects": f"""SELECT p_partkey AS id, p_name AS title, string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ') AS tech_stack,
        CASE WHEN p_partkey % 7 > 0 THEN p_size > 25 END AS featured, {_AT.format(n="p_partkey % 1000")} AS created_at, p_size AS size FROM part""",
    "testimonials": f"""SELECT s_suppkey AS id, s_name AS name, CAST(CASE WHEN s_suppkey % 6 < 5 THEN 1 + s_suppkey % 6 END AS INTEGER) AS rating, s_acctbal > 5000 AS featured, {_AT.format(n="s_suppkey")} AS created_at FROM supplier""",
    "resumes": """SELECT 's' || c_custkey AS id, CAST(c_custkey AS VARCHAR) AS user_id, c_name AS full_name, lower(c_name) || '@mail.example' AS email, CASE WHEN c_custkey % 10 IN (0, 2) THEN c_mktsegment || '|' || c_nationkey ELSE '' END AS skills_shown
        FROM customer WHERE c_custkey % 2 = 0""",
    "tags": """SELECT p_partkey AS id, CASE WHEN p_partkey % 11 > 0 THEN p_brand || ' ' || p_size END AS name, CASE WHEN p_partkey % 13 > 0 THEN replace(lower(p_type), ' ', '-') || '-' || p_partkey % 20 END AS slug FROM part""",
    "users": f"""SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) || '@mail.example' AS email, {_AT.format(n="c_custkey")} AS created_at FROM customer""",
    "user_roles": """SELECT 'r' || c_custkey AS id, CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'admin' ELSE 'user' END AS role FROM customer WHERE c_custkey % 3 > 0""",
}
