"""The prefix trie of conversations: one row for each distinct sequence of first turns, with what sharing it saves.

Each conversation becomes its array of turns, a turn standing by 128 bits of the SHA-256 of its role and text. The arrays are
sorted by range over the whole table, so that the conversations that begin alike are neighbours and the common beginnings of
neighbours (longest common prefixes) are the nodes. A task sweeps its stretch of arrays with a stack of the nodes on the way to
the present one; a node is closed when the next array leaves it, and adds what it holds to its parent. Nodes that reach over the
end of a stretch stay open: each task leaves its part of them, and one more sweep over these parts alone, as many as two ways down
to where neighbouring stretches part, joins them. Their children, which wait for the smallest member, are joined to them last.

Cases: a null role or text is empty, so a row of nulls is a turn without words; rows without a conv_id take no part, as such a
conversation has no number to be rebuilt or listed by; rows of one turn (a null turn comes first) stand by their digests; a
repeated row is a turn again; an empty table gives no rows; texts of any length are read whole; extra columns are left out. A
conversation's array, 40 bytes a turn, must fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import shuffle_parts, spread, written

#: Characters of a turn's digest.
WIDTH = 32
WORD = r"[^\x20\x09-\x0D]+"
NO_IDS = hashlib.sha256(b"").hexdigest()
#: Rows of joined nodes up to which they are sent to all tasks; beyond it they meet their children by a shuffle that deals out hot nodes.
SENT = 100_000
#: Rows that a task gives at a time.
BATCH = 5_000


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (digest, words), in order, of each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, WIDTH)
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", turn.alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(arrays: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """arrays where the first crc32(conv_id) % shared turns of each conversation are those of the conversation conv_id - conv_id % family (SQL's
    remainder): all of them if it has fewer, none if it doesn't exist."""
    arrays = written(arrays, "turn-arrays")
    head = arrays.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, shared - 1).alias("_head"))
    n = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    rows = arrays.withColumn("_base", F.col("conv_id") - F.col("conv_id") % family).join(head, "_base", "left")
    first = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), n)
    return rows.select("conv_id", F.concat(first, F.slice("turns", n + 1, F.size("turns"))).alias("turns"))


@dataclass
class Node:
    depth: int
    words: int
    #: Whether it began in an earlier stretch, whether its row can't be finished in this one, and whether it goes on in the next.
    left: bool = False
    open: bool = False
    stays: bool = False
    least: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ids: list[int] = field(default_factory=list)
    waiting: list[dict] = field(default_factory=list)

    def take(self, child: Node) -> None:
        self.n += child.n
        self.least = child.least if self.least is None else min(self.least, child.least)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def close(self) -> dict:
        """What counts with all members known; a node without children is a leaf."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.words
        return self.row()

    def row(self) -> dict:
        return {"conv_id": self.least, "depth": self.depth, "n_convs": self.n, "n_children": self.children, "n_leaves": self.leaves, "saved_tokens": self.saved}

    def listed(self) -> str:
        return ",".join(map(str, self.ids))


def common(a: str, b: str) -> int:
    """Turns with which both begin."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n  # the first low agree, the first high don't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid)
    return low


def sweep(entries: Iterator[tuple[str, list[int], int]], left: int, right: int) -> Iterator[dict]:
    """Nodes of a sorted stretch of (path, words, conv_id). left, right: turns that its first and its last entry share with the
    neighbouring stretches, -1 where there is none. Kinds of rows: "node", finished; "child", whose parent is open; "open", this
    stretch's part of an open node."""
    stack = [Node(0, 0, left >= 0, left >= 0 or right >= 0)]

    def pop() -> Iterator[dict]:
        node = stack.pop()
        if node.open:
            yield from ({"kind": "child", **child, "was_left": node.left} for child in node.waiting)
            yield {"kind": "open", **node.row(), "words": node.words, "was_left": node.left, "stays": node.stays, "ids": node.listed() if node.ids else None}
            return
        row = node.close() | {"ends_sha256": hashlib.sha256(node.listed().encode()).hexdigest()}
        yield from ({"kind": "node", **child, "parent_conv_id": node.least} for child in node.waiting)
        if not stack:
            yield {"kind": "node", **row}
            return
        parent = stack[-1]
        parent.take(node)
        if parent.open:
            yield {"kind": "child", **row, "was_left": parent.left}
        else:
            parent.waiting.append(row)

    before, first = "", True
    for path, words, conv_id in entries:
        same = common(before, path)
        while len(stack) - 1 > same:
            yield from pop()
        for d in range(len(stack), len(path) // WIDTH + 1):
            stack.append(Node(d, words[d - 1], first and d <= left, first and d <= left))
        end = stack[-1]
        end.ids.append(conv_id)
        end.n += 1
        end.least = conv_id if end.least is None else min(end.least, conv_id)
        before, first = path, False
    for node in stack[: right + 1]:
        node.open = node.stays = True
    while stack:
        yield from pop()


def stitch(parts: Iterator[dict]) -> Iterator[dict]:
    """Join the parts of open nodes, in the order of their stretches: "place", which node a part belongs to, and finished "node"s.

    A node is named by the stretch and depth of its first part."""
    stack: list[tuple[tuple[int, int], Node]] = []

    def pop() -> Iterator[dict]:
        name, node = stack.pop()
        row = node.close()
        yield from ({"kind": "node", **child, "parent_conv_id": node.least} for child in node.waiting)
        own = {"node_part": name[0], "node_depth": name[1], **row}
        if stack:
            stack[-1][1].take(node)
            stack[-1][1].waiting.append(own)
        else:
            yield {"kind": "node", **own}

    for part, rows in groupby(parts, lambda r: r["part"]):
        rows = list(rows)
        for r in rows:  # those from earlier stretches first, from the root on
            if not r["was_left"]:
                while len(stack) > r["depth"]:
                    yield from pop()
                stack.append(((part, r["depth"]), Node(r["depth"], r["words"])))
            name, node = stack[r["depth"]]
            node.n += r["n_convs"]
            node.children += r["n_children"]
            node.leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
            if r["conv_id"] is not None:
                node.least = r["conv_id"] if node.least is None else min(node.least, r["conv_id"])
            yield {"kind": "place", "part": part, "depth": r["depth"], "was_left": r["was_left"], "node_part": name[0], "node_depth": name[1]}
        keep = sum(r["stays"] for r in rows)
        while len(stack) > keep:
            yield from pop()


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SWEPT = f"kind string, part int, {_NODE}, words long, was_left boolean, stays boolean, ids string"
_STITCHED = f"kind string, part int, was_left boolean, node_part int, node_depth int, {_NODE}"
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _as_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("ids") or "")
        if len(held) >= BATCH or size > 1 << 24:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _sorted(arrays: DataFrame) -> DataFrame:
    """Written: part, place in the part, path, words, conv_id, so that part after part gives all arrays in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            place = pa.array(range(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * b.num_rows, pa.int32()), place, *b.columns], names=["part", "place", "path", "words", "conv_id"])

    path = F.array_join(F.transform("turns", lambda t: t.digest), "").alias("path")
    rows = arrays.select(path, F.transform("turns", lambda t: t.words).alias("words"), F.col("conv_id").cast("long").alias("conv_id"))
    ranged = rows.repartitionByRange(shuffle_parts(arrays.sparkSession), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return written(ranged.mapInArrow(run, "part int, place long, path string, words array<long>, conv_id long"), "sorted-arrays")


def _bounds(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each part the turns that its ends share with its neighbours': two numbers for each task of the sort."""
    ends = rows.groupBy("part").agg(F.min_by("path", "place").alias("a"), F.max_by("path", "place").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        for part, first, last in _rows(batches):
            out.append((part, -1 if before is None else common(before, first)))
            before = last
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int32()) for k in (0, 1)], names=["part", "shared"])

    found = sorted(ends.repartition(1).sortWithinPartitions("part").mapInArrow(run, "part int, shared int").collect())
    return {r.part: (r.shared, after) for r, after in zip(found, [*(r.shared for r in found[1:]), -1], strict=False)}


def prefix_tree(arrays: DataFrame) -> DataFrame:
    """The nodes of the trie of arrays (conv_id, turns of digest and words): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = arrays.sparkSession
    rows = _sorted(arrays)
    bounds = _bounds(rows)
    swept_as, stitched_as, ends_as = _arrow(_SWEPT), _arrow(_STITCHED), _arrow("node_part int, node_depth int, ends_sha256 string")

    def sweeps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, entries in groupby(_rows(batches), lambda r: r[0]):
            found = sweep((r[1:] for r in entries), *bounds[part])
            yield from _as_batches(({"part": part, **row} for row in found), swept_as)

    parts = shuffle_parts(spark)
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("part", "place").select("part", "path", "words", "conv_id")
    swept = written(ordered.mapInArrow(sweeps, _SWEPT), "swept-nodes")
    done = swept.where("kind = 'node'").select(*_COLUMNS)
    if len(bounds) < 2:
        return done

    def stitches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _as_batches(stitch(row for b in batches for row in b.to_pylist()), stitched_as)

    # One task joins the open parts: of each stretch no more than the nodes on the ways down to where it parts from its neighbours.
    parts_of_open = swept.where("kind = 'open'").select("part", "was_left", "depth", "stays", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    stitched = written(parts_of_open.repartition(1).sortWithinPartitions("part", F.desc("was_left"), "depth").mapInArrow(stitches, _STITCHED), "stitched-nodes")
    name = ["node_part", "node_depth"]
    joined = stitched.where("kind = 'node'").select(*name, *_COLUMNS[:-1])
    place = stitched.where("kind = 'place'").select("part", "depth", "was_left", *name)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (a, b), listed in groupby(_rows(batches), lambda r: r[:2]):
            digest, comma = hashlib.sha256(), b""
            for *_, ids in listed:
                digest.update(comma + ids.encode())
                comma = b","
            yield pa.RecordBatch.from_pylist([{"node_part": a, "node_depth": b, "ends_sha256": digest.hexdigest()}], ends_as)

    ids = swept.where("kind = 'open' AND ids IS NOT NULL").select("part", "depth", "was_left", "ids").join(place, ["part", "depth", "was_left"])
    ends = ids.select(*name, "part", "ids").repartition(*name).sortWithinPartitions(*name, "part").mapInArrow(digests, "node_part int, node_depth int, ends_sha256 string")
    whole = joined.join(ends, name, "left").select(*_COLUMNS[:-1], F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))

    children = swept.where("kind = 'child'").select(*[c for c in _COLUMNS if c != "parent_conv_id"], "part", (F.col("depth") - 1).alias("parent_depth"), "was_left")
    on = ["part", "parent_depth", "was_left"]
    parents = place.join(joined.select(*name, F.col("conv_id").alias("parent_conv_id")), name).select("part", F.col("depth").alias("parent_depth"), "was_left", "parent_conv_id")
    if place.count() <= SENT:
        found = children.join(F.broadcast(parents), on)
    else:
        found = spread(children, parents, on, F.struct("conv_id", "depth"), children.groupBy(*on).agg(F.count("*").alias("k")))
    return done.unionByName(found.select(*_COLUMNS)).unionByName(whole)
