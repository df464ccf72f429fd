"""Conversation repair, SentencePiece ids and the prefix trie against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from compare import same, views
from pyspark.sql import functions as F

from vellum.llm import pieces, repair, trie
from vellum.llm.oracles import ORACLES
from vellum.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"


@pytest.fixture(params=["1", "4", "23"])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def awkward(seed, n=500):
    """One conversation of half of all rows; nulls everywhere, ties, repeated rows, blank and long texts."""
    rnd = random.Random(seed)
    text = lambda k: rnd.choice([None, "", " \n", "Hi.", "Hi", "Yes!\t ", "no no.", f"{k}", f"word {k} " * 40 + "?"])
    rows = [(rnd.choice([None, 1, 1, 1, *range(20, 25)]), rnd.choice([None, *range(60)]), rnd.choice([None, "", "user", "assistant", "system", "usher", "bot"]), text(k)) for k in range(n)]
    return rows + rows[:20]


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        kept = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            kept += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    by_turn = lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode())
    return {c: sorted(kept, key=by_turn) for c, kept in out.items()}


def cheapest(rows):
    """Faults of the rows; cost, letters and turns of the least edits, by Dijkstra over (rows used, roles' state), least letters first."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.strip(WHITE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, state, made = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return faults, cost, audit, made
        steps = [(3, "I", k, r[0], f"{r}:") for r in ("user", "assistant")]
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 4, audit + "D", k + 1, state, made))
            if faults[k] not in ("blank", "duplicate"):
                cut = 3 if faults[k] else 0
                steps += [(cut, "K", k + 1, role[:1], f"{role}:{text}")] + [(3 + cut, "R", k + 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        for more, letter, to, initial, turn in steps:
            if initial in follows[state]:
                heapq.heappush(heap, (cost + more, audit + letter, to, initial, (*made, turn)))
    raise AssertionError


def repaired(rows):
    out = {}
    for c, kept in damage(rows).items():
        faults, cost, audit, made = cheapest(kept)
        turns = [t for t, _, _ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def report(df):
    found = repair.report(repair.repair(repair.damaged(df), F.col("present"))).collect()
    got = {r[0]: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    return got


def test_repair_query(spark, result):
    columns, rows = result("op11_conversation_repair")
    assert columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = repaired([tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    assert {r[0]: tuple(r)[1:] for r in rows} == want


def test_repair_over_many_tasks(spark, parts):
    rows = awkward(int(parts))
    df = spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("x")).withColumn("key", F.lit(1)).repartition(3)
    assert report(df) == repaired(rows)


def test_repair_of_equal_rows(spark, parts):
    rows = [(None, None, None, None)] * 30 + [(7, 3, "user", "Hi.")] * 60
    assert report(spark.createDataFrame(rows, TURNS)) == repaired(rows)


def test_repair_of_dropped_and_no_rows(spark):
    gone = [(c, t, "user", "Hi.") for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:5]
    got = report(spark.createDataFrame(gone, TURNS))
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert report(spark.createDataFrame([], TURNS)) == {}


def test_repair_gives_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "And you?"), (1, 3, "assistant", "Well.")]
    pieces_of = sorted(repair.repair(spark.createDataFrame(rows, TURNS)).collect(), key=lambda r: r.part)
    assert ("".join(r.audit for r in pieces_of), sum(r.cost for r in pieces_of)) == ("KKIKK", 3)
    assert [tuple(t) for r in pieces_of for t in r.turns] == [("system", "Be kind."), ("user", "Hi."), ("assistant", ""), ("user", "And you?"), ("assistant", "Well.")]


def plain_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, children = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in below) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in below)
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p))
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()), key=repr
    )


def tree(df):
    return sorted((tuple(r) for r in trie.prefix_tree(trie.rebuilt(trie.turn_arrays(df))).collect()), key=repr)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_trie_over_many_tasks(spark, parts, monkeypatch, sent):
    monkeypatch.setattr(trie, "SENT", sent)
    rnd = random.Random(int(parts))
    rows = [(rnd.choice([None, *range(150)]), rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice([None, "", "user", "user"]), rnd.choice([None, "a b", "a b", "a b", "c", "d e f"])) for _ in range(500)]
    rows += [(200, t, "user", f"turn {t}" * 50) for t in range(300)] + [(c, t, "user", f"turn {t}" * 50) for c in (201, 202) for t in range(0, 290)]
    df = spark.createDataFrame(rows, TURNS).withColumn("path", F.lit("x")).repartition(3)
    assert tree(df) == plain_trie(rows)


def test_trie_of_copies(spark, parts):
    """Half of all conversations are the same; the ids that end at one node come from many tasks."""
    rows = [(c, t, "user", f"{t} and {c % 300 if c > 300 else 0}") for c in range(600) for t in range(3)]
    assert tree(spark.createDataFrame(rows, TURNS)) == plain_trie(rows)


def test_trie_odd(spark):
    assert tree(spark.createDataFrame([], TURNS)) == []
    assert tree(spark.createDataFrame([(None, 1, "user", "x")], TURNS)) == []
    lone = [(c, 0, "user", "x") for c in range(21, 40)]  # no first of the family: some are left without turns
    assert tree(spark.createDataFrame(lone, TURNS)) == plain_trie(lone)


def test_trie_matches_sql(spark):
    same(spark, views(), QUERIES["op13_prefix_trie"], ORACLES["op13_prefix_trie"])


def test_common_beginnings():
    rnd = random.Random(4)
    turns = [format(k, "032x") for k in range(3)]
    for _ in range(500):
        a, b = ([rnd.choice(turns) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert trie.common("".join(a), "".join(b)) == n


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def le(ids):
    return np.array(ids, "<u4").tobytes()


def test_pieces_query(spark, result, library):
    columns, rows = result("op12_piece_round_trip")
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(le(ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_pieces_of_any_text(model, library, monkeypatch):
    """The table of chunks gives what the library gives, however small it is kept and with the library alone."""
    rnd = random.Random(1)
    letters = list("  ▁ab1é日\t\n\x00\xa0　﻿<>0xA_'.😀́")
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(20_000)] + ["", " ", "  ", "▁", "a" * 5_000, "a " * 5_000 + " ", "<s> </s><unk>", "é" * 999 + "  x"]
    want = [le(i) for i in library.encode(texts, add_bos=True, add_eos=True)]
    encoder = pieces.ChunkEncoder(model)
    assert encoder.by_chunks and list(encoder.encode(texts)) == want
    assert max(map(len, encoder.table)) <= pieces.LONGEST
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 300)
    assert list(pieces.ChunkEncoder(model).encode(texts)) == want
    encoder.by_chunks = False
    assert list(encoder.encode(texts)) == want


def test_pieces_odd(spark, model, library):
    rows = [(None, None), (1, ""), (1, None), (2, " x\n" * 30_000), (2, "é  ▁ x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = pieces.decode(pieces.encode(df, model), model).collect()
    assert {(r[0], bytes(r[1]), r[2]) for r in pieces.round_trip(df, model).collect()} == {(r[0], bytes(r[1]), r[2]) for r in got}
    want = [(i, le(ids := library.encode(t or "", add_bos=True, add_eos=True)), library.decode(ids)) for i, t in rows]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, bytes(r.ids), r.text) for r in got), key=key) == sorted(want, key=key)
    assert pieces.decode(pieces.encode(df.limit(0), model), model).count() == 0
