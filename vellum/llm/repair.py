"""Repair of conversations: the cheapest edits after which the roles alternate as a training format asks for.

Roles, by their initials, must read (s?(ua)+)?. A row is kept (K, free), given the role that is due, user or assistant (R), or
deleted (D); a turn without text may be inserted anywhere (I). A blank row, and one whose role and text stood earlier in the
conversation, must be deleted; a truncated row that stays costs more. Costs to go are found backwards over rows and grammar
states; the walk forwards then takes, of the edits that keep to the cheapest cost, the one of the least letter.

Rows are sorted by range, so a task holds a stretch of rows and no conversation has to fit in one task. What lies within a
stretch is finished there. The conversations at its two ends leave a piece each; the driver sees sixteen costs of each piece
(at most two pieces a task), carries costs to go back over the pieces and states forward, and tasks then walk each piece. Texts
of a conversation of several pieces meet only in its digest, which streams them in order.

Cases: a null role or text is one space, so such a text is blank; rows without a conv_id are one conversation; rows of one
turn stand by role, then text, rows without a turn first; a repeated row is a duplicate; an empty table gives no rows; texts of
any length pass through; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import shuffle_parts, written

REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States of the grammar: nothing yet, after system, after user, after assistant. It may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one state that a new user or assistant turn leads to, and its role.
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 50
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\v\f\r"

_COSTS = list[int]


def _inserted(costs: _COSTS) -> _COSTS:
    """Costs to go where turns may be inserted first; two bring every state that any number brings."""
    return [min(costs[s], INSERT + costs[DUE[s]], 2 * INSERT + costs[DUE[DUE[s]]]) for s in range(4)]


#: Costs to go after the last row.
END = _inserted([0, FAR, FAR, 0])


@dataclass
class Piece:
    """Consecutive rows of one conversation."""

    turns: list[int | None] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=list)

    def judge(self, seen: set[bytes]) -> None:
        """Find each row's first fault; seen: digests of the rows before this piece."""
        self.faults = []
        for role, text, digest in zip(self.roles, self.texts, self.digests(), strict=True):
            end = text.rstrip(WHITE)[-1:]
            self.faults.append(BLANK if not end else DUPLICATE if digest in seen else TRUNCATED if end not in ".!?" else 0)
            seen.add(digest)

    def digests(self) -> list[bytes]:
        return [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16] for r, t in zip(self.roles, self.texts, strict=True)]

    def edits(self, row: int, state: int) -> list[tuple[str, int, int]]:
        """What may be done with a row: letter, cost, state that follows."""
        out, fault = [("D", DELETE, state)], self.faults[row]
        if fault not in (BLANK, DUPLICATE):
            cut = CUT if fault == TRUNCATED else 0
            if (kept := KEEPS.get((state, self.roles[row][:1]))) is not None:
                out.append(("K", cut, kept))
            out.append(("R", REROLE + cut, DUE[state]))
        return out

    def costs(self, after: _COSTS) -> list[_COSTS]:
        """Costs to go before each row, and after, which is what follows the last one."""
        out = [after]
        for row in range(len(self.roles) - 1, -1, -1):
            out.append(_inserted([min(c + out[-1][to] for _, c, to in self.edits(row, s)) for s in range(4)]))
        return out[::-1]

    def passage(self) -> list[_COSTS]:
        """The least cost between each state before the piece and each state after its last row."""
        ends = [self.costs([0 if t == s else FAR for t in range(4)])[0] for s in range(4)]
        return [[ends[t][s] for t in range(4)] for s in range(4)]

    def walk(self, costs: list[_COSTS], state: int, last: bool) -> tuple[str, list[tuple[str, str]], int, int]:
        """From a state: edits, turns that result, cost, state after the last row. Only the last piece inserts behind its rows."""
        audit, made, spent, row, n = [], [], 0, 0, len(self.roles)
        while row < n or (last and costs[row][state]):
            togo, options = costs[row][state], [("I", INSERT, DUE[state], row)]
            if row < n:
                options = sorted(options + [(e, c, to, row + 1) for e, c, to in self.edits(row, state)])
            edit, cost, state, follows = next(o for o in options if o[1] + costs[o[3]][o[2]] == togo)
            if edit != "D":
                made.append((self.roles[row] if edit == "K" else ROLE[state], "" if edit == "I" else self.texts[row]))
            audit.append(edit)
            spent, row = spent + cost, follows
        return "".join(audit), made, spent, state

    def counts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {
            "turn_min": min(known, default=None), "turn_max": max(known, default=None), "n_turns": len(set(known)), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
        }


_COUNTS = "turn_min long, turn_max long, n_turns long, illegal long, blank long, duplicate long, truncated long, cost long, audit string, turns array<struct<role string, text string>>"
_ROW = "struct<turn long, role string, text string>"


def _arrow(spark_ddl: str) -> pa.Schema:
    """On the driver only: the DDL is parsed by Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spark_ddl))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _finished(piece: Piece, costs: list[_COSTS], state: int, last: bool) -> dict:
    audit, made, spent, _ = piece.walk(costs, state, last)
    return piece.counts() | {"cost": spent, "audit": audit, "turns": [{"role": r, "text": t} for r, t in made]}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _stretches(conversations: DataFrame, present: Column) -> DataFrame:
    """Written: a row for each conversation within a task's rows, and one with the rows themselves for each at their ends."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), present.alias("present"), F.monotonically_increasing_id().alias("at"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "at")]  # the last deals out equal rows
    rows = rows.repartitionByRange(shuffle_parts(conversations.sparkSession), *order).sortWithinPartitions(*order).drop("at")
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, key string, part int, open boolean, {_COUNTS}, rows array<{_ROW}>, digests array<binary>"

    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size = TaskContext.get().partitionId(), [], 0
        before, first = None, True

        def put(conv_id, key: str, piece: Piece, is_open: bool) -> None:
            row = {"conv_id": conv_id, "key": key, "part": part, "open": is_open}
            if is_open:
                listed = [{"turn": t, "role": r, "text": x} for t, r, x in zip(piece.turns, piece.roles, piece.texts, strict=True)]
                out.append(row | {"rows": listed, "digests": list(dict.fromkeys(piece.digests()))})
            else:
                piece.judge(set())
                out.append(row | _finished(piece, piece.costs(END), START, True))

        for key, group in groupby(_rows(batches), lambda r: r[1]):
            piece, conv_id = Piece(), None
            for conv_id, _, turn, role, text, here in group:
                if here:
                    piece.turns.append(turn)
                    piece.roles.append(role)
                    piece.texts.append(text)
                    size += len(text)
            if before:
                put(*before, first)
                first = False
            before = conv_id, key, piece
            if len(out) >= 1000 or size >= 4_000_000:
                yield _batch(out, schema)
                out, size = [], 0
        if before:
            put(*before, True)
        if out:
            yield _batch(out, schema)

    return written(rows.mapInArrow(run, ddl), "conversation-stretches")


def _with_earlier(pieces: DataFrame) -> DataFrame:
    """Open pieces with the digests of their rows that stood in earlier pieces of the conversation."""
    each = pieces.select("key", "part", F.explode("digests").alias("digest"))
    first = each.groupBy("key", "digest").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = each.join(first, ["key", "digest"]).where("part > first").groupBy("key", "part").agg(F.collect_list("digest").alias("earlier"))
    return written(pieces.select("conv_id", "key", "part", "rows").join(again, ["key", "part"], "left"), "conversation-pieces")


def _piece(row: tuple) -> Piece:
    """Of a row with rows and earlier."""
    listed, earlier = row
    piece = Piece([x["turn"] for x in listed], [x["role"] for x in listed], [x["text"] for x in listed])
    piece.judge(set(earlier or []))
    return piece


def _stitched(pieces: DataFrame) -> DataFrame:
    """Finish the open pieces, each from the state and to the costs that its neighbours give it."""
    spark = pieces.sparkSession
    seen_ddl = "key string, part int, passage array<long>, ends array<string>, turn_min long, turn_max long"
    state_ddl = "key string, part int, states array<int>"
    done_ddl = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, key string, part int, {_COUNTS}"
    seen_as, state_as, done_as = _arrow(seen_ddl), _arrow(state_ddl), _arrow(done_ddl)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, *row in _rows(batches):
            piece = _piece(row)
            ends = [piece.roles[0][:1], piece.roles[-1][:1]] if piece.roles else None
            c = piece.counts()
            made = {"key": key, "part": part, "passage": sum(piece.passage(), []), "ends": ends, "turn_min": c["turn_min"], "turn_max": c["turn_max"]}
            yield _batch([made], seen_as)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, togo, _, _, _, last, *row in _rows(batches):
            piece = _piece(row)
            costs = piece.costs(togo)
            yield _batch([{"key": key, "part": part, "states": [piece.walk(costs, s, last)[3] for s in range(4)]}], state_as)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, togo, state, illegal, shared, last, conv_id, *row in _rows(batches):
            piece = _piece(row)
            made = _finished(piece, piece.costs(togo), state, last)
            made |= {"conv_id": conv_id, "key": key, "part": part, "illegal": made["illegal"] + illegal, "n_turns": made["n_turns"] - shared}
            yield _batch([made], done_as)

    # At most two pieces a task of the sort: that many short rows reach the driver and are sent out.
    seen = sorted(pieces.select("key", "part", "rows", "earlier").mapInArrow(passages, seen_ddl).collect())
    plan: dict[tuple, dict] = {}
    for _, found in groupby(seen, lambda r: r.key):
        found = list(found)
        after, last = END, True
        for r in found[::-1]:
            plan[r.key, r.part] = {"togo": after, "state": START, "illegal": 0, "shared": 0, "last": last}
            after, last = [min(r.passage[4 * s + t] + after[t] for t in range(4)) for s in range(4)], False
        end = turn = None
        for r in found:
            own = plan[r.key, r.part]
            if r.ends:
                own["illegal"] = int(end is not None and end + r.ends[0] not in LEGAL)
                end = r.ends[1]
            if r.turn_min is not None:
                own["shared"] = int(turn == r.turn_min)
                turn = r.turn_max

    def planned() -> DataFrame:
        listed = [(k, p, x["togo"], x["state"], x["illegal"], x["shared"], x["last"]) for (k, p), x in plan.items()]
        made = spark.createDataFrame(listed, "key string, part int, togo array<long>, state int, illegal long, shared long, last boolean")
        return pieces.join(F.broadcast(made), ["key", "part"]).select("key", "part", "togo", "state", "illegal", "shared", "last", "conv_id", "rows", "earlier")

    at = None
    for r in sorted(planned().drop("conv_id").mapInArrow(states, state_ddl).collect()):
        own = plan[r.key, r.part]
        own["state"] = at[1] if at and at[0] == r.key else START
        at = r.key, r.states[own["state"]]
    return planned().mapInArrow(walks, done_ddl)


def repair(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """Pieces of the repaired conversations (conv_id, turn, role, text): conv_id, key, part (their order), counts of faults, cost, audit
    (the edits' letters) and turns (role and text). Most have one piece. A row for which present is false takes no part, but its
    conversation has a piece."""
    stretches = _stretches(conversations, F.lit(True) if present is None else present)
    done = stretches.where(~F.col("open")).drop("open", "rows", "digests").withColumn("pieces", F.lit(1))
    if (pieces := stretches.where("open")).isEmpty():
        return done
    ended = _stitched(_with_earlier(pieces))
    number = pieces.groupBy("key").agg(F.count("*").cast("int").alias("pieces"))
    return done.unionByName(ended.join(number, "key"))


def report(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    body = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    gaps = F.coalesce(F.col("turn_max") - F.col("turn_min") + 1 - F.col("n_turns"), F.lit(0)).cast("long").alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    one = pieces.where("pieces = 1").select("conv_id", gaps, *counts, "audit", F.sha2(body, 256).alias("repaired_sha256"))
    several = pieces.where("pieces > 1").select("key", "conv_id", "part", "turn_min", "turn_max", "n_turns", *counts, "audit", F.when(F.size("turns") > 0, body).alias("body"))
    ddl = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, turn_min long, turn_max long, n_turns long, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), lambda r: r[0]):
            total, low, high, audits, digest, begun, conv_id = [0] * 6, None, None, [], hashlib.sha256(), False, None
            for _, conv_id, _, turn_min, turn_max, *more, audit, text in group:
                low = turn_min if low is None else low
                high = high if turn_max is None else turn_max
                total = [a + b for a, b in zip(total, more, strict=True)]
                audits.append(audit)
                if text is not None:
                    digest.update(("\n" * begun + text).encode())
                    begun = True
            made = dict(zip(["n_turns", *counts], total, strict=True)) | {"conv_id": conv_id, "turn_min": low, "turn_max": high}
            yield _batch([made | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], schema)

    streamed = several.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, ddl)
    return one.unionByName(streamed.select("conv_id", gaps, *counts, "audit", "repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with planted faults, chosen by crc32 of conv_id:turn (a null is a space) modulo 20: 0 drops the row (present is false), 1 empties
    its text, 2 removes its closing marks, 3 repeats it, 4 gives it the role user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"))
