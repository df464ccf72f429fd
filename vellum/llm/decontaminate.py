"""Benchmark decontamination with DataFrame functions only.

The distinct windows of normalised benchmark words form a hash table, broadcast while its measured size is under a bound.
Every document window is hashed and looked up; each hit is then verified word by word. Beyond the bound the same hashes
meet by shuffle: narrow rows of document, place and hash go out, and what they meet is verified where the document's words
are. A window has a number of its own; the items that hold it are joined to the hits afterwards, so that a passage of many
items is neither broadcast with them nor repeated for each hit.

Cases: a null or empty text has no words and no hits; an item without words matches nothing; items without an id count as
one item with an empty id, and items that share an id as one; a document without an id is treated as any other; repeated
rows get one result each; an empty benchmark leaves every document clean; extra columns are ignored or, in the functions
that return documents, pass unchanged, whatever their names. A very long text is one array of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import spread, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that keeps its capitals.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Largest window table to broadcast, in bytes of its words.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _places(n: int) -> Column:
    """The places (from 1) where a window of n words may start, with n in the upper half of each number."""
    size = F.size("words").cast("long")
    return F.when(size >= n, F.sequence(F.lit((n << 32) + 1), F.lit(n << 32) + size - (n - 1))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each item and each distinct window of it: item, len, win (its words), wid (its number: a 128-bit hash)."""
    words = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    at = words.withColumn("len", F.least(F.size("words"), F.lit(n))).select("item", "words", "len", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("pos"))
    win = at.select("item", "len", F.slice("words", F.col("pos"), F.col("len")).alias("win"))
    return win.withColumn("wid", F.md5(F.array_join("win", " "))).dropDuplicates(["item", "wid"])


def _spans_by_broadcast(rows: DataFrame, wins: DataFrame, lens: list[int]) -> DataFrame:
    """row, kept, n_words, spans (pos, len and wid of hits) with the window table in every task."""
    # A marker at place 0 keeps documents without hits through the inner join.
    marker = wins.sparkSession.range(1).select(F.lit(0).alias("len"), F.array().cast("array<string>").alias("win"), F.lit("").alias("wid"), F.lit(0).cast("long").alias("h"))
    table = F.broadcast(wins.unionByName(marker).select(F.col("len").alias("w_len"), "win", "wid", "h"))  # within BROADCAST_BYTES
    # No lambda here: explode, hash, lookup and check run as one generated stage, and words isn't copied for each place.
    rows = rows.withColumn("places", F.concat(F.array(F.lit(0).cast("long")), *[_places(k) for k in lens]))
    probes = rows.select("row", "kept", "words", F.explode("places").alias("place"))
    pos, size = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"), F.shiftright("place", 32).cast("int")
    own = F.slice("words", F.greatest(pos, F.lit(1)), size)
    first = F.when(F.col("place") == 0, F.col("kept"))  # what is kept travels once, with the marker
    hits = (
        probes.select("row", "kept", "words", "place", F.when(F.col("place") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(own)).alias("p"))
        .join(table, (F.col("p") == F.col("h")) & (size == F.col("w_len")))
        .where((F.col("place") == 0) | (own == F.col("win")))
        .select("row", first.alias("kept"), F.size("words").cast("long").alias("n_words"), F.when(F.col("place") > 0, F.struct(pos.alias("pos"), size.alias("len"), "wid")).alias("span"))
    )
    return hits.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.first("n_words").alias("n_words"), F.collect_list("span").alias("spans"))


def _spans_by_shuffle(rows: DataFrame, wins: DataFrame, lens: list[int]) -> DataFrame:
    """The same for a window table of any size. Only row, place and hash of each document window are shuffled."""
    rows = written(rows, "decontaminate-rows")
    places = F.concat(F.array().cast("array<bigint>"), *[_places(k) for k in lens])
    probes = rows.select("row", "words", F.explode(places).alias("place"))
    pos, size = F.col("place").bitwiseAND(0xFFFFFFFF).cast("int"), F.shiftright("place", 32).cast("int")
    probes = probes.select("row", pos.alias("pos"), size.alias("len"), F.xxhash64(F.slice("words", pos, size)).alias("h"))
    # A window that very many documents hold is one hash: its rows are dealt to several tasks.
    known = wins.select("len", "h").distinct()
    counts = probes.join(known, ["len", "h"], "left_semi").groupBy("len", "h").agg(F.count("*").alias("k"))
    met = spread(probes, wins, ["len", "h"], F.struct("row", "pos"), counts).groupBy("row").agg(F.collect_list(F.struct("pos", "len", "wid", "win")).alias("met"))
    same = lambda s: F.slice(F.col("words"), s.pos, s.len) == s.win
    spans = F.transform(F.filter(F.coalesce("met", F.array().cast("array<struct<pos:int,len:int,wid:string,win:array<string>>>")), same), lambda s: F.struct(s.pos.alias("pos"), s.len.alias("len"), s.wid.alias("wid")))
    return rows.join(met, "row", "left").select("row", "kept", F.size("words").cast("long").alias("n_words"), spans.alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, keep: list[str] | None = None, text_col: str = "text", id_col: str = "item_id", broadcast_bytes: int | None = None) -> DataFrame:
    """One row for each document: keep, n_words, n_hit, hit (places of hit words from 0), items (sorted ids as strings)."""
    found, held = _found(docs, benchmark, n, keep or ["doc_id"], text_col, id_col, broadcast_bytes)
    found = written(found, "decontaminate-found")
    hits = found.select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: s.wid))).alias("wid"))
    # At most the items of one benchmark stand in a row's list.
    items = hits.join(held, "wid").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = found.join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return named.select("kept.*", "n_words", F.size("hit").cast("long").alias("n_hit"), "hit", "items")


def _found(docs: DataFrame, benchmark: DataFrame, n: int, keep: list[str], text_col: str, id_col: str = "item_id", broadcast_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """row, kept, n_words, spans and hit of each document, and the items that hold each window."""
    held = written(benchmark_windows(benchmark, n, id_col), "decontaminate-windows")
    wins = held.dropDuplicates(["wid"]).select("len", "win", "wid", F.xxhash64("win").alias("h"))
    known = wins.agg(F.collect_set("len").alias("lens"), F.sum(F.length(F.concat_ws(" ", "win")) + 32).alias("bytes")).first()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), words_of(F.col(text_col)).alias("words"))
    small = (known.bytes or 0) <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    found = (_spans_by_broadcast if small else _spans_by_shuffle)(rows, wins, sorted(known.lens or []))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.pos - 1, s.pos + s.len - 2)))))
    return found.withColumn("hit", hit), held.select("wid", "item")


def contaminated(n_hit: Column | None = None, n_words: Column | None = None) -> Column:
    """At least 5 % of the words lie in benchmark windows."""
    n_hit, n_words = F.col("n_hit") if n_hit is None else n_hit, F.col("n_words") if n_words is None else n_words
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their columns unchanged."""
    found, _ = _found(docs, benchmark, n, docs.columns, "text")
    return found.where(~contaminated(F.size("hit"), F.col("n_words"))).select("kept.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, text_col: str = "text") -> DataFrame:
    """All documents, without the words that lie in benchmark windows and what stands right before each."""
    found, _ = _found(docs, benchmark, n, docs.columns, text_col)
    own = F.col("kept")[text_col]
    text = F.coalesce(own, F.lit(""))
    gaps, words = F.split(text, CASED_WORD, -1), F.regexp_extract_all(text, F.lit(CASED_WORD), F.lit(0))
    left = F.array_except(F.transform(words, lambda _, i: i), F.col("hit"))
    # A one-element array binds the three lists, so that they are made once and not for each word.
    bound = F.array(F.struct(gaps.alias("gaps"), words.alias("words"), left.alias("left")))
    joined = F.get(F.transform(bound, lambda s: F.concat(F.array_join(F.transform(s.left, lambda i: F.concat(F.get(s.gaps, i), F.get(s.words, i))), ""), F.element_at(s.gaps, -1))), 0)
    cut = F.when(F.size("hit") > 0, joined).otherwise(own)
    return found.select(*[cut.alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in docs.columns])
