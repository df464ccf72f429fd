"""Secret scans with DataFrame functions only.

Base kinds are regular expressions. The method adds strings whose characters look drawn at random: over each candidate
string a window slides, the sum of c*log2(c) over its characters is kept up by the counts of the one that enters and the one
that leaves, and a window whose Shannon entropy reaches the threshold of its own characters' class is a find, unless an
allow-list rule covers it: the rules for whole strings, what stands before the string, or a placeholder word in the part
between two marks that the window touches.
Spans are in code points, end exclusive. Cases: an empty table gives one; a null or empty text has no spans; of matches that
start at one place the kind listed first comes first; a text of any length is scanned whole;
ids aren't looked at and may be null or repeated; repeated rows get one result each; extra columns are ignored by spans() and
pass unchanged, whatever their names, through redact().
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base kinds, their patterns and the least length of the part that counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of fewer than 24 are dropped, and a run is one match, so the bound may stand in the pattern.
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The same matches as ASSIGN and CANDIDATE, found in less time: most places are passed by one look.
SCANNED = {ASSIGN: "(?=[apstAPST])" + ASSIGN, CANDIDATE: r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"}
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
#: Characters in a window, and the least entropy in bits for each class.
WINDOW, HEX_BITS, BASE64_BITS = 20, 2.9, 3.7
#: Stands for a character that no window may hold.
MASK = "~"
#: Names joined from words seldom have a single small letter between capitals, and then no capitals side by side; a string with
#: two such places and such capitals isn't made of words.
WORDY = r"^(?!(?=.*[A-Z]{2})(?:.*?[A-Z][a-z](?=[A-Z])){2})"
#: Allow-list for whole strings: identifiers, strings without a letter, words, and words joined by marks.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[^A-Za-z]*$",
    WORDY + r"[^0-9]*$",
    WORDY + r"([A-Za-z]{0,2}[0-9]{1,8}|[A-Za-z]+)([-_/=+]([A-Za-z]{0,2}[0-9]{1,8}|[A-Za-z]+))+$",
]
#: A number at the end of a word, before a capital, a mark or nothing, belongs to the word.
NUMBERED = r"([a-z]{3})[0-9]{1,3}([^0-9a-z]|$)"
#: What stands right before bytes that a page or mail holds as text.
INLINE = ";base64,"
#: Allow-list for the parts of a string between marks: placeholders.
PLACEHOLDER = r"(?i)example|placeholder|changeme|dummy|sample|x{6,}|0{8,}|1234567890|abcdefgh"
PARTS = r"[=/_-]|[^=/_-]+"
#: Runs that the base kind hex reports, and what is between them.
HEX_PARTS = rf"{HEX}|(?:(?!{HEX}).)+"


def _found(kind: int, text: Column, pattern: str) -> Column:
    """Matches of a pattern in order, each with the number of code points between it and the match before."""
    pattern = SCANNED.get(pattern, pattern)
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.struct(F.length(x).alias("n"), F.endswith(x, F.lit(INLINE)).alias("inline")))
    rows = F.transform(m, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.get(gaps, i).n.alias("gap"), F.get(gaps, i).inline.alias("inline"), x.alias("value")))
    return F.when(F.size(m) > 0, rows)


def _allowed(value: Column) -> Column:
    words = F.regexp_replace(value, F.lit(NUMBERED), F.lit("$1$2"))
    return reduce(lambda a, b: a | b, [words.rlike(p) for p in ALLOWED])


def _masked(value: Column, parts: str, pattern: str) -> Column:
    """value with the parts that have the pattern masked."""
    each = F.transform(F.regexp_extract_all(value, F.lit(parts), F.lit(0)), lambda x: F.when(x.rlike(pattern), F.repeat(F.lit(MASK), F.length(x))).otherwise(x))
    return F.when(value.rlike(pattern), F.array_join(each, "")).otherwise(value)


def entropy_spans(value: Column) -> Column:
    """First and last+1 places of the stretches of value covered by windows that reach their class's entropy, in order."""
    sums = [c * log2(c) if c else 0.0 for c in range(WINDOW + 1)]
    # What the sum gains as a character comes to have c + 1 places in the window.
    gains = F.lit([y - x for x, y in zip(sums, sums[1:], strict=False)])
    none = F.array().cast("array<struct<a:int,b:int>>")
    # held: the window; open, lower, upper: characters so far without a masked one, and of one hex class; letter, digit: the last place of each.
    zero = F.struct(
        F.lit(0).alias("i"), F.lit("").alias("held"), F.lit(0.0).alias("s"), F.lit(0).alias("open"), F.lit(0).alias("lower"), F.lit(0).alias("upper"), F.lit(-WINDOW).alias("letter"), F.lit(-WINDOW).alias("digit"), none.alias("w")
    )

    def step(st: Column, c: Column) -> Column:
        i, full = st.i, F.length(st.held) >= WINDOW
        old, rest = F.when(full, F.left(st.held, F.lit(1))), F.when(full, F.substring(st.held, 2, WINDOW)).otherwise(st.held)
        among_rest = lambda x: F.length(rest) - F.length(F.replace(rest, x, F.lit("")))
        s = st.s - F.when(full, F.get(gains, among_rest(old))).otherwise(F.lit(0.0)) + F.get(gains, among_rest(c))
        grows = lambda n, good: F.when(good, n + 1).otherwise(F.lit(0))
        is_digit = c.between("0", "9")
        free, lower, upper = grows(st.open, c != MASK), grows(st.lower, is_digit | c.between("a", "f")), grows(st.upper, is_digit | c.between("A", "F"))
        letter, digit = F.when(is_digit, st.letter).otherwise(i), F.when(is_digit, i).otherwise(st.digit)
        is_hex = F.greatest(lower, upper) >= WINDOW
        bits = F.when(~is_hex, F.lit(BASE64_BITS)).when(F.least(letter, digit) > i - WINDOW, F.lit(HEX_BITS)).otherwise(F.lit(99.0))
        hit = (free >= WINDOW) & (log2(WINDOW) - s / WINDOW >= bits)
        last, first = F.get(st.w, F.size(st.w) - 1), i - WINDOW + 1
        joined = F.concat(F.slice(st.w, 1, F.size(st.w) - 1), F.array(F.struct(last.a.alias("a"), (i + 1).alias("b"))))
        w = F.when(~hit, st.w).when((F.size(st.w) > 0) & (last.b >= first), joined).otherwise(F.concat(st.w, F.array(F.struct(first.alias("a"), (i + 1).alias("b")))))
        return F.struct((i + 1).alias("i"), F.concat(rest, c).alias("held"), s.alias("s"), free.alias("open"), lower.alias("lower"), upper.alias("upper"), letter.alias("letter"), digit.alias("digit"), w.alias("w"))

    return F.aggregate(F.split(value, ""), zero, step, lambda st: st.w)


def spans(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """One row for each document: keep and spans, an array of (start, kind as its number in KINDS, end), sorted.

    An added span that overlaps a base span, or another added one before it, isn't reported again.
    """
    return _spans(docs, keep or ["doc_id"], text_col).select("kept.*", "spans")


def _spans(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """kept (a struct of keep) and spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [_found(k, text, p) for k, p in enumerate([ASSIGN, ACCESS, HEX, CANDIDATE])]
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,inline:boolean,value:string>>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), F.concat(*[F.coalesce(x, none) for x in every]).alias("found"))
    rows = rows.select("row", "kept", F.posexplode_outer("found").alias("at", "m"))
    rows = rows.select("row", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("kept")).alias("kept"), "m.*").repartition("row")  # what is kept travels once
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(run).cast("int")).withColumn("start", F.col("end") - F.length("value"))

    open_value = _masked(_masked(F.col("value"), HEX_PARTS, HEX), PARTS, PLACEHOLDER)
    random = F.when((F.col("kind") == 3) & ~F.col("inline") & ~_allowed(F.col("value")), entropy_spans(open_value))
    good = F.when(F.col("kind") == 0, F.length(F.regexp_extract("value", ASSIGN, 1)) >= 6).when(F.col("kind") == 1, F.length("value") >= 20).when(F.col("kind") == 2, F.lit(True)).otherwise(F.col("w.a").isNotNull())
    rows = rows.withColumn("ws", random)
    rows = rows.select("*", F.posexplode_outer("ws").alias("nth", "w")).withColumn("good", F.coalesce(good, F.lit(False)))
    is_hex = F.substring(F.col("value"), F.col("w.a") + 1, F.col("w.b") - F.col("w.a")).rlike(r"^[0-9a-f]+$|^[0-9A-F]+$")
    added = F.col("kind") == 3
    rows = rows.select(
        "row", "kept", "good",
        F.when(added & ~is_hex, 4).otherwise(F.col("kind")).alias("kind"),
        F.when(added, F.col("start") + F.col("w.a")).otherwise(F.col("start")).alias("start"),
        F.when(added, F.col("start") + F.col("w.b")).otherwise(F.col("end")).alias("end"),
    )
    base = F.col("good") & (F.col("kind") < 3)
    by = Window.partitionBy("row").orderBy("start", "kind")
    over = (F.coalesce(F.max(F.when(F.col("good"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > F.col("start")) | (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(2**31 - 1)) < F.col("end")
    )
    rows = rows.withColumn("over", over).withColumn("span", F.when(F.col("good") & ((F.col("kind") < 3) | ~F.col("over")), F.struct("start", "kind", "end")))
    return rows.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.array_sort(F.collect_list("span")).alias("spans")).select("kept", "spans")


def written_as(spans: Column | str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s.kind), s.start, s.end)), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All documents with every span replaced by mark; overlapping spans become one."""
    found = _spans(docs, docs.columns, text_col)
    text = F.col("kept")[text_col]
    done = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda st, s: F.struct(
            F.when(s.start < st.at, st.out).otherwise(F.concat(st.out, F.substring(text, st["at"] + 1, s.start - st["at"]), F.lit(mark))).alias("out"),
            F.greatest(st["at"], s.end).alias("at"),
        ),
        lambda st: F.concat(st.out, F.substring(text, st["at"] + 1, F.length(text))),
    )
    return found.select(*[F.when(F.size("spans") > 0, done).otherwise(text).alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns])
