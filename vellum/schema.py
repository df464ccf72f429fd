"""Tables of a content site: columns, defaults and constraints, each constraint switchable."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    #: Unique among the rows where the column isn't null.
    unique_where_set: tuple[str, ...] = ()
    #: SQL conditions; null passes.
    checks: tuple[str, ...] = ()
    #: column -> (table, column, deletes cascade)
    references: dict[str, tuple[str, str, bool]] = field(default_factory=dict)
    #: column -> SQL of its value when an insert omits it; now() stands for the caller's as_of.
    defaults: dict[str, str] = field(default_factory=dict)


_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "variant": T.VariantType()}


def _parse(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split(":") for c in ddl.split())])


_TIMES = {"created_at": "now()", "updated_at": "now()"}
#: The two colours below.
_NAMED = "id:string name:string slug:string description:string color:string created_at:timestamp"
_NAMED_RULES = dict(not_null=("id", "name", "slug"), unique=(("id",), ("name",), ("slug",)), defaults={"id": "uuid()", "color": "'#3B82F6'", "created_at": "now()"})

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table("contacts", _parse("id:string name:string email:string message:string status:string created_at:timestamp"), ("id", "name", "email", "message"), (("id",),), (), ("status IN ('unread', 'read', 'archived')",), {}, {"id": "uuid()", "status": "'unread'", "created_at": "now()"}),
        Table(
            "projects",
            _parse("id:string title:string description:string tech_stack:strings image_url:string demo_url:string code_url:string featured:boolean slug:string case_study_content:string process_description:string challenges:string solutions:string results:string gallery_images:strings created_at:timestamp updated_at:timestamp"),
            ("id", "title", "description", "tech_stack"), (("id",),), ("slug",), (), {}, {"id": "uuid()", "featured": "false", "gallery_images": "array()"} | _TIMES,
        ),
        Table(
            "blog_posts",
            _parse("id:string title:string slug:string excerpt:string content:string featured_image:string published:boolean author_id:string tags:strings categories:strings reading_time:int meta_description:string social_image:string created_at:timestamp updated_at:timestamp"),
            ("id", "title", "slug", "content"), (("id",), ("slug",)), (), (), {"author_id": ("users", "id", True)}, {"id": "uuid()", "published": "false", "tags": "array()", "categories": "array()", "reading_time": "0"} | _TIMES,
        ),
        Table("testimonials", _parse("id:string name:string position:string company:string content:string avatar_url:string rating:int featured:boolean created_at:timestamp updated_at:timestamp"), ("id", "name", "position", "company", "content"), (("id",),), (), ("rating >= 1 AND rating <= 5",), {}, {"id": "uuid()", "rating": "5", "featured": "false"} | _TIMES),
        Table("resume", _parse("id:string user_id:string full_name:string email:string phone:string summary:string skills:variant experience:variant education:variant certifications:variant created_at:timestamp updated_at:timestamp"), ("id", "full_name", "email"), (("id",),), (), (), {"user_id": ("users", "id", True)}, {"id": "uuid()", "skills": "parse_json('[]')", "experience": "parse_json('[]')", "education": "parse_json('[]')", "certifications": "parse_json('[]')"} | _TIMES),
        Table("user_roles", _parse("id:string user_id:string role:string"), ("id", "user_id", "role"), (("id",), ("user_id", "role")), (), ("role IN ('admin', 'user')",), {"user_id": ("users", "id", True)}, {"id": "uuid()"}),
        Table("blog_comments", _parse("id:string blog_post_id:string author_name:string author_email:string content:string approved:boolean created_at:timestamp updated_at:timestamp"), ("id", "blog_post_id", "author_name", "author_email", "content"), (("id",),), (), (), {"blog_post_id": ("blog_posts", "id", True)}, {"id": "uuid()", "approved": "false"} | _TIMES),
        Table("blog_tags", _parse(_NAMED), **_NAMED_RULES),
        Table("blog_categories", _parse(_NAMED), **(_NAMED_RULES | {"defaults": {**_NAMED_RULES["defaults"], "color": "'#10B981'"}})),
    )
}


def with_missing_columns(df: DataFrame, table: Table) -> DataFrame:
    """df with the table's columns that it lacks, as nulls; columns that it has stay as they are."""
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in df.columns})
