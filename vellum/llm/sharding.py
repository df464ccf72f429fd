"""Sharding by a minimax contiguous partition of atomic groups.

Documents with equal texts form one group. Groups stand in the order of their smallest document id, and the shards are
runs of that order with the smallest possible largest size. The capacity is found by binary search with a greedy check.
At that capacity the cuts are placed so that the sum of squared sizes is least, so a hot group's shard grows alone and the
other shards share what is left evenly.
The driver never holds the groups: it holds at most about BINS totals of ranges of ids, and it divides further only the
ranges in which a cut could fall, until each of those holds one group. So its memory is bounded at any input size.
The greedy capacity is exact; the even placing is exact where no more than about BINS groups stand in the order, and beyond
that to within a range of ids.

Cases: a row without an id stands in its text's group, and a group of such rows alone by a hash of its text; a null text counts as empty (size 1); empty tables give no rows; repeated rows are placed as rows of one group;
a group larger than a fair share makes its shard larger, as groups are atomic; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import spread, written

#: Ranges of ids whose totals the driver holds at a time.
BINS = 16_384
#: Rows that one task numbers within a shard.
SLOT_ROWS = 50_000
#: Runs with more than this part of a shard are divided further where one group may be most of them.
COARSE = 256


@dataclass
class Run:
    """Groups with ids in [a, b): their total size and the largest; atomic if they can't be parted further."""

    a: int
    b: int
    size: int
    top: int
    n: int

    @property
    def atomic(self) -> bool:
        return self.n == 1 or self.b - self.a == 1


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def greedy(runs: list[Run], capacity: float, shards: int, fluid: bool) -> list[int] | None:
    """Places in runs where each shard ends, filling each up to capacity; None if they don't suffice. fluid: runs that aren't atomic may be parted anywhere."""
    cuts, i, room = [], 0, 0.0
    rest = 0.0  # of a run that was parted
    for _ in range(shards):
        room = capacity
        while i < len(runs):
            need = rest or runs[i].size
            if need <= room:
                room, rest, i = room - need, 0.0, i + 1
            elif fluid and not runs[i].atomic and room > 0:
                rest = need - room
                break
            else:
                break
        cuts.append(i)
    return cuts if i == len(runs) else None


def least_capacity(runs: list[Run], shards: int, fluid: bool) -> int:
    """Binary search for the smallest capacity that the greedy check accepts."""
    low = max([math.ceil(sum(r.size for r in runs) / shards), *[r.top if fluid else r.size for r in runs]])
    high = max(low, sum(r.size for r in runs))
    while low < high:
        mid = (low + high) // 2
        if greedy(runs, mid, shards, fluid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(runs: list[Run], capacity: int, shards: int) -> list[int]:
    """Places in runs where each shard ends: the least sum of squared sizes of shards that hold capacity at most; of equal
    choices the one with the last cut, then the one before it and so on, as far left as can be.

    One shard more at a time; the best place of the cut before grows with the place of the cut, so halves are searched apart.
    """
    total = np.concatenate([[0], np.cumsum([r.size for r in runs])]).astype(float)
    n = len(total)
    low = np.searchsorted(total, total - capacity)
    best, came = np.where(np.arange(n) == 0, 0.0, np.inf), []
    for _ in range(shards):
        new, cut = np.full(n, np.inf), np.zeros(n, np.int64)
        todo = [(0, n, 0, n - 1)]
        while todo:
            a, b, left, right = todo.pop()
            mid = (a + b) // 2
            i, j = max(left, int(low[mid])), min(right, mid)
            k = j
            if i <= j:
                every = best[i : j + 1] + (total[mid] - total[i : j + 1]) ** 2
                k = i + int(np.argmin(every))
                new[mid], cut[mid] = every[k - i], k
            reached = new[mid] < np.inf
            if a < mid:
                todo.append((a, mid, left, k if reached else right))
            if mid + 1 < b and reached:  # what can't be reached can't be passed either
                todo.append((mid + 1, b, k, right))
        best = new
        came.append(cut)
    ends, k = [], n - 1
    for cut in reversed(came):
        ends.append(k)
        k = int(cut[k])
    return ends[::-1]


def cut_points(groups: DataFrame, shards: int, bins: int = BINS) -> list[int]:
    """Group ids at which shards 1, 2, ... begin. groups: first_id, size."""
    edge = groups.agg(F.min("first_id").alias("a"), F.max("first_id").alias("b")).first()
    if edge.a is None:
        return []
    ranges = [(edge.a, edge.b + 1)]
    known: list[Run] = []
    while ranges:
        known += _totals(groups, ranges, bins)
        known.sort(key=lambda r: r.a)
        high = least_capacity(known, shards, fluid=False)
        low = least_capacity(known, shards, fluid=True)
        # Cuts of any capacity between the two lie between those of the lower one, runs whole, and the higher one, runs parted.
        early, late = _cuts_at_most(known, low, shards), greedy(known, high, shards, fluid=True)
        open_ = {k for x, y in zip(early, late, strict=True) for k in range(x, min(y + 1, len(known)))}
        # A run that no shard can hold whole stops the first of the two; it is divided before the others, and there are few.
        open_ = {k for k, r in enumerate(known) if r.size > low and not r.atomic} or open_
        known, ranges = _without(known, open_)
    capacity = least_capacity(known, shards, fluid=False)
    while True:
        cuts = even_cuts(known, capacity, shards)
        # Runs beside a cut, and large ones, which may hold a large group and its neighbours, are divided further.
        large = sum(r.size for r in known) / (COARSE * shards)
        beside = {k for c in cuts for k in (c - 1, c) if 0 <= k < len(known)}
        known, ranges = _without(known, beside | {k for k, r in enumerate(known) if r.size > large and r.top > r.size // 2})
        if not ranges:
            break
        known += _totals(groups, ranges, bins)
        known.sort(key=lambda r: r.a)
    return [known[k].a if k < len(known) else edge.b + 1 for k in cuts[:-1]]


def _totals(groups: DataFrame, ranges: list[tuple[int, int]], bins: int) -> list[Run]:
    """The runs of about bins equal parts of the ranges of ids, which stand in order."""
    each = max(2, bins // len(ranges))
    begin, last = np.array([a for a, _ in ranges], np.int64), np.array([b - 1 for _, b in ranges], np.int64)
    width = np.array([max(1, -(-(b - a) // each)) for a, b in ranges], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, size = (batch.column(k).to_numpy() for k in (0, 1))
            k = np.searchsorted(begin, i, "right") - 1
            inside = (k >= 0) & (i <= last[k])
            i, size, k = i[inside], size[inside], k[inside]
            low, w = begin[k].astype(np.uint64), width[k]  # unsigned, as ids may be further apart than 2^63
            part = (low + (i.astype(np.uint64) - low) // w * w).astype(np.int64)
            order = np.argsort(part, kind="stable")
            i, size, part = i[order], size[order], part[order]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)])
            made = [part[at], *(f.reduceat(x, at) if len(at) else x for f, x in ((np.add, size), (np.maximum, size), (np.add, np.ones(len(i), np.int64)), (np.minimum, i), (np.maximum, i)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["bin", "size", "top", "n", "a", "b"])

    parts = groups.select("first_id", "size").mapInArrow(run, "bin long, size long, top long, n long, a long, b long")
    found = parts.groupBy("bin").agg(F.sum("size").alias("size"), F.max("top").alias("top"), F.sum("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    return [Run(r.a, r.b + 1, r["size"], r.top, r.n) for r in found.collect()]


def _without(runs: list[Run], places: set[int]) -> tuple[list[Run], list[tuple[int, int]]]:
    """The runs without those at places that can be parted, and the ranges of ids of these."""
    parted = {k for k in places if not runs[k].atomic}
    return [r for k, r in enumerate(runs) if k not in parted], [(runs[k].a, runs[k].b) for k in sorted(parted)]


def _cuts_at_most(runs: list[Run], capacity: int, shards: int) -> list[int]:
    """The greedy cuts with whole runs, also where capacity doesn't suffice for all."""
    cuts, i = [], 0
    for _ in range(shards):
        room = capacity
        while i < len(runs) and runs[i].size <= room:
            room, i = room - runs[i].size, i + 1
        cuts.append(i)
    return cuts


def shard(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, shard, slot. Equal texts share a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_size(F.col(text_col)).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    rows = written(rows, "shard-rows")
    by_text = F.conv(F.substring("key", 1, 15), 16, 10).cast("long")
    groups = rows.groupBy("key").agg(F.coalesce(F.min("doc_id").cast("long"), by_text).alias("first_id"), F.sum("size").alias("size"), F.count("*").alias("k"))
    groups = written(groups, "shard-groups")
    cuts = cut_points(groups.select("first_id", "size"), shards)
    of = F.lit(0)
    for c in (c for c in cuts if c < 1 << 63):  # no id is beyond
        of = of + F.when(F.col("first_id") >= F.lit(c), 1).otherwise(0)
    placed = spread(rows, groups.select("key", of.alias("shard")), ["key"], F.struct("doc_id"), groups.select("key", "k")).select("doc_id", "size", "text_crc32", "shard")
    # Slots: rows of a shard are dealt into bins by a hash of their id, numbered in each bin, and the bins stand one after the other.
    bins = max(1, rows.count() // SLOT_ROWS)
    placed = placed.withColumn("bin", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(bins)).cast("int"))
    placed = written(placed, "shard-placed")
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bin").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "bin", "start")
    number = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("k", number).join(starts, ["shard", "bin"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("k")).alias("slot"))
