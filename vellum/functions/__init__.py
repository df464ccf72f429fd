"""Scalar functions as Column expressions: text, arrays, dates, JSON. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that JavaScript counts as white space.
JS_SPACE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def js_trim(c: Column) -> Column:
    """Looks at the ends alone: a pattern is tried at each character, goes over a run of spaces again from each of them, and its $ also
    stands before a last \\u0085, which is no space here."""
    return F.btrim(c, F.lit(JS_SPACE))


def js_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def falsy_null(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cs: Column) -> Column:
    """The first text that is neither null nor empty, else empty."""
    return F.coalesce(*[falsy_null(c) for c in cs], F.lit(""))


def slugify(c: Column) -> Column:
    """Lower case, only a-z 0-9 space and hyphen, runs of either as one hyphen, trimmed last: edge spaces become hyphens."""
    kept = F.regexp_replace(F.lower(c), "[^a-z0-9 -]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"))


def slugify_simple(c: Column) -> Column:
    """Lower case, white space as hyphens, punctuation kept."""
    return F.regexp_replace(F.lower(c), f"[{JS_SPACE}]+", "-")


def slug_or(given: Column, title: Column) -> Column:
    return F.coalesce(falsy_null(given), slugify(title))


def initials(c: Column, limit: int | None = None) -> Column:
    """First characters of the space-separated parts in upper case; cut to limit after that."""
    made = F.upper(F.array_join(F.transform(F.split(c, " "), lambda t: F.substring(t, 1, 1)), ""))
    return F.substring(made, 1, limit) if limit else made


def word_count(c: Column) -> Column:
    """Parts between single spaces after trimming spaces: a run of spaces makes empty parts, and they count; null for empty."""
    return F.when(c != "", F.size(F.split(F.trim(c), " ", -1)))


def reading_time(c: Column) -> Column:
    """Minutes at 200 words, 1 at least; 1 for null and empty."""
    return F.greatest(F.ceil(word_count(c) / F.lit(200.0)), F.lit(1)).cast("int")


def split_list(c: Column) -> Column:
    return F.transform(F.split(c, ",", -1), js_trim)


def file_extension(c: Column) -> Column:
    """What follows the last point, or the whole name."""
    return F.substring_index(c, ".", -1)


def encode_uri_component(c: Column) -> Column:
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for escaped, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


#: The addresses by which the platforms take a page.
TWITTER = "https://twitter.com/intent/tweet?text="
LINKEDIN = "https://www.linkedin.com/sharing/share-offsite/?url="
FACEBOOK = "https://www.facebook.com/sharer/sharer.php?u="


def share_url(platform: Column, url: Column, title: Column) -> Column:
    """The address by which a page is shared; empty for other platforms."""
    u, t = encode_uri_component(url), encode_uri_component(title)
    tweet = F.concat(F.lit(TWITTER), t, F.lit("&url="), u)
    return F.when(platform == "twitter", tweet).when(platform == "linkedin", F.concat(F.lit(LINKEDIN), u)).when(platform == "facebook", F.concat(F.lit(FACEBOOK), u)).otherwise(F.lit(""))


def empty_null(a: Column) -> Column:
    """The list, or null where it is empty."""
    return F.when(F.size(a) > 0, a)


def first_items(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def overflow(a: Column, n: int) -> Column:
    """How many items the first n leave out; null for none."""
    return F.when(F.size(a) > n, F.size(a) - n)


def append_absent(a: Column, item: Column) -> Column:
    """a with the trimmed item at its end unless blank or there already."""
    t = js_trim(item)
    return F.when((t != "") & ~F.array_contains(a, t), F.array_append(a, t)).otherwise(a)


def without_item(a: Column, item: Column) -> Column:
    return F.filter(a, lambda x: ~x.eqNullSafe(item))


def without_index(a: Column, k: int) -> Column:
    return F.filter(a, lambda x, i: i != k)


def with_index(a: Column, k: int, value: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == k, value).otherwise(x))


def concat_lists(*arrays: Column) -> Column:
    """All items in order; a null list is empty."""
    return F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])


def stars(rating: Column, of: int = 5) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(of - 1)), lambda i: i < rating)


def date_short(ts: Column) -> Column:
    """M/D/YYYY; the epoch for null."""
    return F.date_format(F.coalesce(ts, F.timestamp_seconds(F.lit(0))), "M/d/yyyy")


def date_long(ts: Column) -> Column:
    return F.date_format(F.coalesce(ts, F.timestamp_seconds(F.lit(0))), "MMMM d, yyyy")


def date_time_long(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMMM d, yyyy 'at' hh:mm a"), F.lit("Invalid Date"))


def hours_since(ts: Column, as_of: Column) -> Column:
    return (F.unix_millis(as_of) - F.unix_millis(ts)) / F.lit(3600000.0)


def within_hours(ts: Column, as_of: Column, hours: int = 24) -> Column:
    """Less than so many hours old; null counts as expired."""
    return F.coalesce(F.unix_millis(as_of) - F.unix_millis(ts) < hours * 3600000, F.lit(False))


def bypass_state(stored_id: Column, stored_at: Column, user_id: Column, as_of: Column, hours: int = 24) -> Column:
    """What a remembered administrator pass means for a user: "admin" while it is theirs and young enough, "purge" once theirs has expired
    or its time is no number, null if there is none or it is another's. stored_at: milliseconds as text."""
    theirs = F.coalesce((stored_id == user_id) & (stored_at != ""), F.lit(False))
    young = F.coalesce(F.unix_millis(as_of) - parse_int(stored_at) < hours * 3600000, F.lit(False))
    return F.when(theirs & young, "admin").when(theirs, "purge")


def may_enter(user_id: Column, is_admin: Column) -> Column:
    """Whether the administrators' pages open: for a user who is signed in and is one."""
    return user_id.isNotNull() & F.coalesce(is_admin, F.lit(False))


def parsed(c: Column) -> Column:
    """A JSON text as a variant, null where it is no JSON. Put it in a column of its own, so that a text is parsed once."""
    return F.try_parse_json(c)


def tolerant(v: Column, fallback: str = "[]") -> Column:
    """What a variant column holds: a text is parsed, and an object, array or other value is itself. A text that is no JSON, and a null, an
    empty text, false and zero give the fallback, which is JSON."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    inner = F.when(kind == "STRING", F.try_parse_json(text)).otherwise(v)
    number = F.try_variant_get(v, "$", "double")
    falsy = v.isNull() | (kind == "VOID") | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false")) | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == 0))
    return F.when(F.coalesce(falsy, F.lit(False)), F.parse_json(F.lit(fallback))).otherwise(F.coalesce(inner, F.parse_json(F.lit(fallback))))


def json_list(v: Column, key: str) -> Column:
    """A list of texts under key of a parsed JSON object; empty for bad JSON, a missing key or another shape."""
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<string>"), F.array().cast("array<string>"))


def resume_skills(v: Column) -> Column:
    return F.concat(*[json_list(v, k) for k in ("technical", "frameworks", "tools", "soft_skills")])


_POSITION = "array<struct<title:string,company:string,duration:string,description:string,responsibilities:array<string>>>"
_DEGREE = "array<struct<degree:string,institution:string,graduation_year:string,year:string>>"


def resume_positions(v: Column) -> Column:
    """Positions of a JSON object with their responsibilities, else their description, as one text."""
    found = F.try_variant_get(v, "$.positions", _POSITION)
    blank = F.lit("")
    made = F.transform(
        found,
        lambda p: F.struct(
            F.coalesce(p.title, blank).alias("title"), F.coalesce(p.company, blank).alias("company"), F.coalesce(p.duration, blank).alias("duration"), first_truthy(F.array_join(p.responsibilities, ", "), p.description).alias("description")
        ),
    )
    return F.coalesce(made, F.array().cast("array<struct<title:string,company:string,duration:string,description:string>>"))


def resume_degrees(v: Column) -> Column:
    found = F.try_variant_get(v, "$.degrees", _DEGREE)
    made = F.transform(found, lambda d: F.struct(F.coalesce(d.degree, F.lit("")).alias("degree"), F.coalesce(d.institution, F.lit("")).alias("institution"), first_truthy(d.graduation_year, d.year).alias("year")))
    return F.coalesce(made, F.array().cast("array<struct<degree:string,institution:string,year:string>>"))


def resume_certifications(v: Column) -> Column:
    """Each certification's text, or its name where it is an object."""
    raw = F.try_variant_get(v, "$.certifications", "array<variant>")
    text = lambda x: F.try_variant_get(x, "$", "string")
    made = F.transform(raw, lambda x: F.when(text(x).startswith("{"), F.coalesce(F.try_variant_get(x, "$.name", "string"), F.lit(""))).otherwise(text(x)))
    return F.coalesce(made, F.array().cast("array<string>"))


def parse_int(c: Column) -> Column:
    """The leading whole number of a text, null without one."""
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def plural(n: Column) -> Column:
    return F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
