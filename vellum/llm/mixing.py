"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: the total is shared by weight, a source's target stops at max_epochs times its size, and the excess is shared
again by weight among the others. Schedule: the mix has as many slots as blocks of equal word count fill its total. Slot k
lies at the point frac((k+1) * golden ratio) of the cumulative targets, which names its source; a source's slots are ranked,
and its r-th slot takes the r-th block of the source's shuffled documents, which go round again after the last. What a source
gives is therefore what its slots reach: near its target by the discrepancy of the points, a few blocks. The block size is
BLOCK_WORDS or less: a small mix has smaller blocks, so that its smallest source has about LEAST_BLOCKS of them.

The order of a source's documents is that of a hash of their ids, so reruns agree. Ranks and running sums are taken in
bins (of slots, of hash values) whose totals are summed first: no task holds a source. The driver holds one row for each
source, which is the size of the mix's own setting. Cases: a null or empty text has size 0 and takes 0; a null source is
a source of its own, last in order; a row without a doc_id is placed by its text; empty tables give no rows; repeated rows
are each a document; extra columns stay out of mix() and pass unchanged, whatever their names, through mixed_documents().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.shared import spread, written

BLOCK_WORDS, LEAST_BLOCKS = 1024, 200
#: Blocks are not made so small that a mix has more slots than this by it.
MANY_SLOTS = 1 << 22
SLOT_BIN = 1 << 16
#: Most sources whose rows (about a hundred bytes each) are broadcast; more are joined by shuffle.
FEW_SOURCES = 50_000
#: Documents in a bin of one source, about.
DOC_BIN = 2_000
#: 2**32 / golden ratio: the k-th point is k times this modulo 2**32, over 2**32. k goes round after 2**31, so that no product overflows.
GOLDEN = 2654435769
#: Documents are shuffled by 60 bits of a hash.
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t \\n \\v \\f \\r."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def cycling_weights(rank: int) -> int:
    return (3, 1, 2)[rank % 3]


def targets(sizes: list[int], weights: list[int], share: Fraction, max_epochs: int) -> list[Fraction]:
    """Shares of share * sum(sizes) by weight, none above max_epochs times its size, the excess shared again by weight."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if per * weights[i] > max_epochs * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(max_epochs * sizes[i]) if over else per * weights[i]
            left -= out[i]
        open_ -= over or set(open_)
    return out


def block_words(quota: list[int]) -> int:
    """Words in a block of the mix."""
    least = min((q for q in quota if q), default=0)
    return min(BLOCK_WORDS, max(1, least // LEAST_BLOCKS, sum(quota) // MANY_SLOTS))


def golden_point(k: Column) -> Column:
    """The k-th point (from 0) of the sequence, in [0, 1)."""
    return ((k + 1).bitwiseAND(0x7FFFFFFF) * F.lit(GOLDEN)).bitwiseAND(0xFFFFFFFF).cast("double") / float(1 << 32)


def schedule(spark: SparkSession, quota: list[int], block: int, point: Callable[[Column], Column] = golden_point) -> DataFrame:
    """Slots of the mix: slot, src (number of the source), rank (of the slot in its source, from 0)."""
    total = sum(quota)
    edges, run = [], 0
    for q in quota:
        run += q
        edges.append(run / total if total else 1.0)
    found = np.array(edges[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src = np.searchsorted(found, batch.column(1).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(src, pa.int32())], names=["id", "src"])

    rows = spark.range((total + block // 2) // block).select("id", point(F.col("id")).alias("point")).mapInArrow(run, "id long, src int")
    rows = rows.withColumn("bin", F.floor(F.col("id") / SLOT_BIN))
    counts = rows.groupBy("src", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("src", "bin", "start")
    within = F.row_number().over(Window.partitionBy("src", "bin").orderBy("id")) - 1
    return rows.withColumn("k", within).join(starts, ["src", "bin"]).select(F.col("id").alias("slot"), "src", (F.col("start") + F.col("k")).alias("rank"))


def shuffled(seed: int, doc_id: Column, text: Column) -> Column:
    """A hash of a document's id, or of its text where it has none, of HASH_BITS bits."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    keep: list[str] | None = None,
    share: Fraction = Fraction(3, 2),
    max_epochs: int = 2,
    weight_of: Callable[[int], int] = cycling_weights,
    block: int | None = None,
    seed: int = 17,
    text_col: str = "text",
    point: Callable[[Column], Column] = golden_point,
) -> DataFrame:
    """One row for each document: keep, src, size, source_size, target, taken, takes (words taken in each epoch) and slots
    (the slot in which each epoch's first word stands; null for an epoch that the mix doesn't reach)."""
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    rows = docs.select(F.struct(*keep).alias("kept"), F.col("source").alias("own_source"), word_count(F.col(text_col)).alias("size"), shuffled(seed, F.col("doc_id"), F.col(text_col)).alias("h"), F.col("doc_id").alias("own_id"))
    rows = written(rows, "mix-rows")
    found = sorted(((r.own_source, r["size"], r.n) for r in rows.groupBy("own_source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    goal = targets([r[1] for r in found], [weight_of(k) for k in range(len(found))], share, max_epochs)
    quota = [math.floor(g) for g in goal]
    block = block or block_words(quota)
    slots = schedule(spark, quota, block, point) if found else spark.range(0).selectExpr("id as slot", "0 as src", "id as rank")
    slots = written(slots, "mix-slots")
    reach = {r.src: r.n * block for r in slots.groupBy("src").agg(F.count("*").alias("n")).collect()}
    schema = "no_source boolean, own_source string, src int, source_size long, target double, reach long, bins long, k long"
    sources = spark.createDataFrame([(r[0] is None, r[0] or "", k, r[1], float(goal[k]), reach.get(k, 0), max(1, r[2] // DOC_BIN), r[2]) for k, r in enumerate(found)], schema)
    rows, key = rows.withColumns({"no_source": F.col("own_source").isNull(), "own_source": F.coalesce("own_source", F.lit(""))}), ["no_source", "own_source"]
    if len(found) <= FEW_SOURCES:
        rows = rows.join(F.broadcast(sources.drop("k")), key)
    else:
        rows = spread(rows, sources.drop("k"), key, F.col("h"), sources.select(*key, "k"))
    rows = rows.drop(*key)
    # Bins are equal ranges of hash values, so their order and the order within them is the order of the hash.
    rows = rows.withColumn("bin", F.floor(F.shiftright("h", HASH_BITS - 32) * F.col("bins") / float(1 << 32)).cast("long"))
    before = Window.partitionBy("src").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("src", "bin").agg(F.sum("size").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).select("src", "bin", "start")
    order = Window.partitionBy("src", "bin").orderBy("h", "own_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("size").over(order) - F.col("size")).withColumn("k", F.count("*").over(order))
    rows = rows.join(starts, ["src", "bin"]).withColumn("at", F.col("start") + F.col("run")).drop("start", "run", "bins", "h", "own_id")
    rows = written(rows, "mix-placed")

    # Epoch e of a document lies at e * source_size + at of its source's stream, whose r-th block is that of the r-th slot.
    # A source's slots reach blocks without a gap, so an epoch's share is what lies before the end of the last.
    epochs = rows.where(F.col("size") > 0).select("src", "bin", "k", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: F.struct(e.alias("epoch"), F.floor((F.col("at") + e * F.col("source_size")) / block).alias("rank")))).alias("e")).select("src", "bin", "k", "e.*")
    met = epochs.join(slots, ["src", "rank"]).groupBy("src", "bin", "k").agg(*[F.max(F.when(F.col("epoch") == e, F.col("slot"))).alias(f"s{e}") for e in range(max_epochs)])
    took = [F.greatest(F.least(F.col("size"), F.col("reach") - F.col("at") - e * F.col("source_size")), F.lit(0)).cast("long") for e in range(max_epochs)]
    placed = rows.join(met, ["src", "bin", "k"], "left")
    return placed.select("kept.*", "src", "size", "source_size", "target", sum(took[1:], took[0]).alias("taken"), F.array(*took).alias("takes"), F.array(*[F.col(f"s{e}") for e in range(max_epochs)]).alias("slots"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix in the order of its slots, with their columns: one copy for each epoch in which half of a
    document's words or more are taken.

    Only the document at the end of what a source gives can be taken in part. The mix is made of ids and sizes; texts are joined
    once. A row is known by its doc_id, source and text: rows that repeat all three are taken alike.
    """
    own = F.xxhash64("source", "text")
    made = mix(docs.select("doc_id", "source", "text", own.alias("_own")), keep=["doc_id", "_own"], **settings)
    copies = F.filter(F.arrays_zip(F.col("takes").alias("t"), F.col("slots").alias("s")), lambda e: 2 * e.t >= F.col("size"))
    made = made.where(F.col("size") > 0).select(F.col("doc_id").alias("_id"), "_own", F.transform(copies, lambda e: e.s).alias("_slots"))
    made = made.groupBy("_id", "_own").agg(F.max("_slots").alias("_slots")).where(F.size("_slots") > 0)
    given = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), own.alias("_mine"))
    kept = given.join(made, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_own")))
    return kept.select("_row", F.explode("_slots").alias("_slot")).orderBy("_slot", "_row.doc_id").select("_row.*")
