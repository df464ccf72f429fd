"""N-gram Jaccard join: documents whose sets of word shingles have a similarity of 0.75 or more, and their components.

A set is the sorted 64-bit hashes of its distinct shingles; equal sets are one set from the start. Steps:

1. Index. Shingles go, packed, from blocks of documents to buckets of hash values, which return how many sets hold each; a
   shingle that several sets of a block hold is sent once with their number, so no bucket holds a posting for each document
   of a hot shingle.
2. Prefixes. Sets are ordered rarest shingle first. Two linked sets share one of their first n/4 + 1 shingles, so a set
   whose prefix holds only shingles of its own has no link and is out; the others post the shared shingles of their prefix
   with their positions. Both steps run twice: over all sets with the shingles below LOW of the hash range (a fixed share
   of any set; the others come last in the order), then over the sets still in with all of their shingles.
3. Index-level skipping. Posting lists are cut into blocks by size (steps of a third, as linked sets differ by no more), and a
   posting goes only to those blocks of its list that its position lets it be linked with: what follows the position must
   hold the overlap that the block's least size requires. So a set meets larger ones only from its first n/7 places. Of two
   postings that meet, what follows both positions must reach the overlap of their own sizes.
4. Answer-level skipping. Each block's head, the set with the fewest shingles rarer than the list's, which is the one most
   like the text that others were copied from, is compared with the others, and those found linked take its component as
   their answer. In each list that still has several components, the heads of the largest and of the others are then
   compared with the sets outside the largest. Afterwards only sets of one list with different components are compared,
   against all of the list: a set's answer so far is that of the sets like it, and only what differs from it is computed.
   So a group of copies costs comparisons in proportion to its size, and every link between two components is found.

Lists, heads, components and texts that very many rows share are dealt to several tasks (shared.spread()).
Exact but for collisions of 64-bit hashes. Cases: a null or empty text, or one without words, has an empty set and is its
own component; a text with fewer words than a shingle is one shingle; repeated rows and equal texts share a component; a row
without a doc_id links as any other, but gives a component no id: that of rows without an id alone is null; ties go to the
smallest doc_id, whatever its sign; a text of any length is read whole; empty tables give no rows; extra columns stay out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import kernel as K
from vellum.llm.shared import discard, made_so_far, spread, written

WORDS = 5
#: Similarity in per cent; the prefix and skip lengths below are those of 75.
LIMIT = 75
#: Shingles whose hash lies below are counted first: three eighths of a set, more than the quarter that a prefix needs.
LOW = np.uint64(3 << 61)
#: Shingles in a block of documents, about, and the most that a bucket of hash values should hold.
BLOCK, BUCKET = 1_000_000, 8_000_000
#: Least bytes of a word with the space after it, about, from which the number of shingles is estimated.
WORD_BYTES = 5

_LOCAL = ["l_doc", "l_own", "l_text", "l_ref", "l_sig", "l_n", "l_q", "l_mh", "l_mr", "l_xh", "l_xr"]
_SENT = "bucket int, block long, h binary, r binary, mh binary, mn binary, " + ", ".join(f"{c} binary" for c in _LOCAL)
_BACK = "block long, h binary, r binary, d binary, mh binary, md binary, " + ", ".join(f"{c} binary" for c in _LOCAL)
_FOUND = "doc_id long, text_hash long, n long, sig binary, h long, pos int"


def signature(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def prefix(n):
    """Linked sets share one of this many first shingles of each."""
    return n // 4 + 1


def _sent(docs: list[tuple[int | None, int | None]], sets: list[np.ndarray], block: int, buckets: int, limit: np.uint64 | None) -> pa.RecordBatch:
    """What a block of documents sends: for each bucket its shingles, and once what is known of its documents."""
    sigs = [signature(s) for s in sets]
    number: dict[bytes, int] = {}
    own: list[np.ndarray] = []
    for sig, s in zip(sigs, sets, strict=True):
        if sig is not None and sig not in number:
            number[sig] = len(own)
            own.append(s)
    low = [len(s) if limit is None else int(np.searchsorted(s, limit)) for s in own]
    n = np.array([len(s) for s in own], np.int64)
    h = np.concatenate([s[:q] for s, q in zip(own, low, strict=True)] or [np.zeros(0, np.uint64)])
    ref = np.repeat(np.arange(len(own), dtype=np.uint32), low)
    more = [s[q : prefix(len(s))] for s, q in zip(own, low, strict=True)]
    order = np.argsort(h, kind="stable")
    h, ref = h[order], ref[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    count = np.diff(np.append(np.flatnonzero(first), len(h)))
    single = np.repeat(count == 1, count)
    sh, sr, mh, mn = h[single], ref[single], h[first][count > 1], count[count > 1].astype(np.uint32)
    local = [
        np.array([d or 0 for d, _ in docs], np.int64), np.array([d is not None for d, _ in docs], bool), np.array([t or 0 for _, t in docs], np.int64), np.array([-1 if s is None else number[s] for s in sigs], np.int32),
        None, n, np.array(low, np.int64), h[~single], ref[~single],
        np.concatenate(more or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(own), dtype=np.uint32), [len(x) for x in more]),
    ]
    packed = [b"".join(number) if x is None else x.tobytes() for x in local]

    def cut(x: np.ndarray, *others: np.ndarray) -> list[list[bytes]]:
        b = (x & np.uint64(buckets - 1)).astype(np.int64)
        o = np.argsort(b, kind="stable")
        edge = np.searchsorted(b[o], np.arange(buckets + 1))
        return [[y[o[edge[k] : edge[k + 1]]].tobytes() for k in range(buckets)] for y in (x, *others)]

    s, m = cut(sh, sr), cut(mh, mn)
    keep = [k for k in range(buckets) if s[0][k] or m[0][k]]
    cols = [[*keep, block * 7919 % buckets], [block] * (len(keep) + 1)]
    cols += [[*(y[k] for k in keep), None] for y in (*s, *m)]
    cols += [[*[None] * len(keep), x] for x in packed]
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (4 + len(packed))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _SENT.split(", ")])


def _numbers(col, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in col.to_pylist()]


def _counted(bucket: pa.Table) -> pa.Table:
    """For each block of a bucket: its shingles that several sets hold, with the number of those sets; the rest passes through."""
    h, r, mh, mn = (_numbers(bucket.column(c), k) for c, k in (("h", "<u8"), ("r", "<u4"), ("mh", "<u8"), ("mn", "<u4")))
    all_h, all_m = np.concatenate(h), np.concatenate(mh)
    weight = np.concatenate([np.ones(len(all_h), np.int64), np.concatenate(mn).astype(np.int64)])
    key, of = np.unique(np.concatenate([all_h, all_m]), return_inverse=True)
    df = np.bincount(of, weight, minlength=len(key)).astype(np.uint32)[of] if len(key) else np.zeros(0, np.uint32)
    out: dict[str, list] = {x.split()[0]: [] for x in _BACK.split(", ")}
    a, b = 0, len(all_h)
    blocks = bucket.column("block").to_pylist()
    local = [bucket.column(c).to_pylist() for c in _LOCAL]
    for k, block in enumerate(blocks):
        d, md = df[a : a + len(h[k])], df[b : b + len(mh[k])]
        a, b = a + len(h[k]), b + len(mh[k])
        many = d > 1
        if many.any() or len(md) or local[0][k] is not None:
            made = [block, h[k][many].tobytes(), r[k][many].tobytes(), d[many].tobytes(), mh[k].tobytes(), md.tobytes(), *(x[k] for x in local)]
            for name, x in zip(out, made, strict=True):
                out[name].append(x)
    return pa.table({c: pa.array(v, pa.int64() if c == "block" else pa.binary()) for c, v in out.items()})


def _prefixes(block: pa.Table) -> pa.Table:
    """A block's documents (doc_id, text_hash, n, sig) and the shared shingles of its sets' prefixes (n, sig, h, pos)."""
    own = next(r for r in block.select(_LOCAL).to_pylist() if r["l_doc"] is not None)
    doc, has_id, text = np.frombuffer(own["l_doc"], "<i8"), np.frombuffer(own["l_own"], "?"), np.frombuffer(own["l_text"], "<i8")
    doc_ref = np.frombuffer(own["l_ref"], "<i4")
    sig = [own["l_sig"][k : k + 16] for k in range(0, len(own["l_sig"]), 16)]
    n, q = np.frombuffer(own["l_n"], "<i8"), np.frombuffer(own["l_q"], "<i8")
    h, r, d, mh, md = (np.concatenate(_numbers(block.column(c), k)) for c, k in (("h", "<u8"), ("r", "<u4"), ("d", "<u4"), ("mh", "<u8"), ("md", "<u4")))
    o = np.argsort(mh)
    in_h, in_r = np.frombuffer(own["l_mh"], "<u8"), np.frombuffer(own["l_mr"], "<u4")
    in_d = md[o][np.searchsorted(mh[o], in_h)] if len(in_h) else np.zeros(0, np.uint32)
    h, r, d = np.concatenate([h, in_h]), np.concatenate([r, in_r]).astype(np.int64), np.concatenate([d, in_d])
    shared = np.bincount(r, minlength=len(n))
    alone = q - shared
    o = np.lexsort((h, d, r))
    rank = np.arange(len(h)) - np.repeat(np.cumsum(shared) - shared, shared)
    h, r, pos = h[o], r[o], alone[r[o]] + rank
    keep = pos < prefix(n[r])
    x_h, x_r = np.frombuffer(own["l_xh"], "<u8"), np.frombuffer(own["l_xr"], "<u4").astype(np.int64)
    each = np.bincount(x_r, minlength=len(n))
    x_pos = q[x_r] + np.arange(len(x_h)) - np.repeat(np.cumsum(each) - each, each)
    h, r, pos = np.concatenate([h[keep], x_h]), np.concatenate([r[keep], x_r]), np.concatenate([pos[keep], x_pos])
    rows, posts = len(doc), len(h)
    return pa.table({
        "doc_id": pa.array([x if k else None for x, k in zip(doc.tolist(), has_id.tolist(), strict=True)] + [None] * posts, pa.int64()),
        "text_hash": pa.array(text.tolist() + [None] * posts, pa.int64()),
        "n": pa.array(np.concatenate([np.where(doc_ref >= 0, n[doc_ref] if len(n) else 0, 0), n[r]]), pa.int64()),
        "sig": pa.array([sig[k] if k >= 0 else None for k in doc_ref.tolist()] + [sig[k] for k in r.tolist()], pa.binary()),
        "h": pa.array([None] * rows + h.view(np.int64).tolist(), pa.int64()),
        "pos": pa.array([None] * rows + pos.tolist(), pa.int32()),
    })


def _buckets(shingles: int) -> int:
    """Number of buckets, a power of two, for so many shingles."""
    return max(1 << 7, 1 << max(0, shingles // BUCKET).bit_length())


def _indexed(rows: DataFrame, sets_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], limit: np.uint64 | None, shingles: int) -> DataFrame:
    """Steps 1 and 2 over rows (doc_id, text_hash and what sets_of reads) with the shingles below limit (None: with all); shingles: how many these are, about."""
    buckets = _buckets(shingles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, sets, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for i, t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch), strict=True):
                ids.append((i, t))
                sets.append(s)
                held += len(s)
                if held >= BLOCK or len(ids) >= 60_000:
                    yield _sent(ids, sets, (part << 24) + seq, buckets, limit)
                    seq, ids, sets, held = seq + 1, [], [], 0
        if ids:
            yield _sent(ids, sets, (part << 24) + seq, buckets, limit)

    sent = rows.mapInArrow(run, _SENT)
    back = sent.groupBy("bucket").applyInArrow(_counted, _BACK)
    return back.groupBy("block").applyInArrow(_prefixes, _FOUND)


def _from_set_column(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    col = batch.column(2)
    for k in range(len(col)):
        yield col[k].values.to_numpy().view(np.uint64)


def _listed(posts: DataFrame) -> DataFrame:
    """The postings (h, sig and more) of shingles that several sets post."""
    lists = posts.groupBy("h").agg(F.min("sig").alias("one"), F.max("sig").alias("other"), F.count("*").alias("k")).where(F.col("one") != F.col("other"))
    lists = written(lists.select("h", "k"), "jaccard-shared")
    return spread(posts, lists.select("h"), ["h"], F.col("sig"), lists)


def _overlap(n_a: Column, n_b: Column) -> Column:
    """Least number of common shingles of linked sets."""
    return F.ceil((n_a + n_b) * LIMIT / (100 + LIMIT))


def _size_block(n: Column) -> Column:
    """Blocks of sizes from one power of 4/3 to the next: linked sets are in the same one or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(4 / 3))).cast("int")


def _blocks_met(n: Column, pos: Column, block: Column) -> Column:
    """The blocks of a list that may hold sets with which one of n shingles and this position can be linked."""
    least = lambda k: F.greatest(F.lit(1.0), F.pow(F.lit(4 / 3), k) * (1 - 1e-9))
    return F.filter(F.array(block - 1, block, block + 1), lambda k: (n - pos >= _overlap(n, least(k))) & (100 * n >= LIMIT * least(k)))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The sets of the rows wanted (doc_id, text_hash, sig): sig, n, set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(K.shingle_sets(*K.buffers(batch.column(1)), words))
            keep = [k for k, (s, sig) in enumerate(zip(sets, batch.column(0).to_pylist(), strict=True)) if signature(s) == sig]
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(sets[k]) for k in keep])]), pa.int32()), pa.array(np.concatenate([sets[k] for k in keep] or [np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([len(sets[k]) for k in keep], pa.int64()), kept], names=["sig", "n", "set"])

    # One row of each doc_id and text, and where there is no doc_id one of each text, before texts are sent anywhere.
    named = docs.where(F.col("doc_id").isNotNull()).join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    others = docs.where(F.col("doc_id").isNull()).groupBy("text_hash").agg(F.first("text").alias("text"))
    others = others.join(wanted.where(F.col("doc_id").isNull()).select("text_hash", "sig"), "text_hash")
    return named.select("sig", "text").unionByName(others.select("sig", "text")).mapInArrow(run, "sig binary, n long, set array<bigint>")


def _counts(rows: DataFrame, on: list[str]) -> DataFrame:
    return rows.groupBy(*on).agg(F.count("*").alias("k"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, compared whole."""
    one = sets.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("set").alias("s_a"))
    two = sets.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("s_b"))
    same = F.size(F.array_intersect("s_a", "s_b"))
    met = spread(pairs, one, ["a"], F.col("b"), _counts(pairs, ["a"]))
    met = spread(met, two, ["b"], F.col("a"), _counts(pairs, ["b"]))
    return met.where(100 * same >= LIMIT * (F.col("n_a") + F.col("n_b") - same)).select("a", "b")


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """v, comp (the smallest vertex that v reaches) for each vertex of links (a, b): labels move along links, then jump to their own labels, until none changes.

    known: what this gave for a part of the links; labels begin with it."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    degrees = _counts(both, ["b"])
    labels = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp"))
    if known is not None:
        labels = labels.join(known.select("v", F.col("comp").alias("was")), "v", "left").select("v", F.least("comp", "was").alias("comp"))
    labels = written(labels, "labels")
    if labels.isEmpty():
        return labels
    while True:
        near = spread(both, labels.select(F.col("v").alias("b"), "comp"), ["b"], F.col("a"), degrees).groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        moved = written(labels.join(near, "v").select("v", F.col("comp").alias("was"), F.least("comp", "m").alias("to")), "labels-moved")
        jump = labels.select(F.col("v").alias("to"), F.col("comp").alias("next"))
        new = spread(moved, jump, ["to"], F.col("v"), _counts(moved, ["to"]))
        new = written(new.select("v", "was", F.least("to", "next").alias("comp")), "labels")
        labels = new.select("v", "comp")
        if new.where(F.col("was") != F.col("comp")).isEmpty():
            return labels


def _fits(n_a: Column, p_a: Column, n_b: Column, p_b: Column) -> Column:
    """Whether sets of these sizes can be linked when their first common shingle has these positions."""
    sizes = F.least(n_a, n_b) * 100 >= LIMIT * F.greatest(n_a, n_b)
    return sizes & (F.least(n_a - p_a, n_b - p_b) >= _overlap(n_a, n_b))


def _pairs(matched: DataFrame) -> DataFrame:
    return matched.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_head(posts: DataFrame, heads: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of each posting's set with the heads of its list or part of a list. heads: on, heads (an array), k (postings there)."""
    heads = written(heads, "jaccard-heads")
    met = spread(posts, heads.drop("k"), on, F.col("sig"), heads.drop("heads")).withColumn("head", F.explode("heads"))
    head = {c: F.col(f"head.{c}") for c in ("sig", "n", "pos")}
    matched = met.where((F.col("sig") != head["sig"]) & _fits(F.col("n"), F.col("pos"), head["n"], head["pos"]))
    return _pairs(matched.select(head["sig"].alias("a"), F.col("sig").alias("b")))


def _open(posts: DataFrame, comp: DataFrame) -> DataFrame:
    """The postings of lists with several components, with comp and whether it is the list's largest (in_main)."""
    known = posts.join(comp.select(F.col("v").alias("sig"), "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    known = written(known, "jaccard-known")
    sizes = known.groupBy("h", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("h").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("k").alias("k")).where(F.col("comps") > 1)
    main = written(main, "jaccard-main")
    return spread(known, main.select("h", "main"), ["h"], F.col("sig"), main).withColumn("in_main", F.col("comp") == F.col("main")).drop("main")


def _compared(posts: DataFrame, sets: DataFrame) -> DataFrame:
    """components() of the linked sets. posts: lists (h) with sig, n, pos, block. Steps that find nothing to do are left out."""
    # First answers: each block's head against the others of the block.
    least = lambda rows: F.min(F.when(rows, F.struct("pos", "sig", "n")))
    heads = posts.groupBy("h", "block").agg(F.array(least(F.lit(True))).alias("heads"), F.count("*").alias("k"))
    done = written(_with_head(posts, heads, ["h", "block"]), "jaccard-pairs")
    links = written(_links(done, sets), "jaccard-links")
    comp = components(links)

    # Then in lists with several components, the heads of the largest and of the others against the others.
    open_ = written(_open(posts, comp), "jaccard-open")
    if open_.isEmpty():
        return comp
    minor = ~F.col("in_main")
    heads = open_.groupBy("h").agg(F.array_compact(F.array(least(F.col("in_main")), least(minor))).alias("heads"), F.count_if(minor).alias("k"))
    pairs = written(_with_head(open_.where(minor), heads, ["h"]).join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = written(_links(pairs, sets), "jaccard-links")
    done = done.union(pairs)
    if not more.isEmpty():
        links = links.union(more)
        comp = components(links, comp)
        open_ = written(_open(posts, comp), "jaccard-open")
        if open_.isEmpty():
            return comp

    # Then what is left open: sets of one list with different components, those outside its largest component against all.
    met = open_.withColumn("side", F.explode(_blocks_met(F.col("n"), F.col("pos"), F.col("block"))))
    # Each of the two sets must be able to meet the other's block.
    x = met.where(minor).select("h", F.col("block").alias("one"), F.col("side").alias("two"), F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("p_a"), F.col("comp").alias("c_a"))
    y = met.select("h", F.col("side").alias("one"), F.col("block").alias("two"), F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("p_b"), F.col("comp").alias("c_b"), "in_main")
    meet = (F.col("c_a") != F.col("c_b")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & _fits(F.col("n_a"), F.col("p_a"), F.col("n_b"), F.col("p_b"))
    cell = ["h", "one", "two"]
    rest = written(_pairs(spread(y, x, cell, F.col("b"), _counts(y, cell)).where(meet)).join(done, ["a", "b"], "left_anti"), "jaccard-rest")
    more = written(_links(rest, sets), "jaccard-links")
    return comp if more.isEmpty() else components(links.union(more), comp)


def _answers(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """For docs (doc_id, text, text_hash): rows (doc_id, text_hash, n_shingles, sig), and for each sig the first row of its
    component: sig, least (doc_id and text_hash; rows without a doc_id come last)."""
    since = made_so_far()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = _indexed(docs.select("doc_id", "text_hash", "text"), lambda batch: K.shingle_sets(*K.buffers(batch.column(2)), words), LOW, size // WORD_BYTES * 3 // 8)
    found = written(found, "jaccard-index")
    rows = found.where(F.col("h").isNull()).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "sig")
    posts = written(found.where(F.col("h").isNotNull()).select("h", "sig").distinct(), "jaccard-posts")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    reps = written(rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(own).alias("rep"), F.count("*").alias("k")), "jaccard-reps")

    # The sets still in, ordered anew among themselves by all of their shingles.
    wanted = _listed(posts).select("sig").distinct().join(reps, "sig").select("rep.doc_id", "rep.text_hash", "sig")
    sets = written(_sets(docs, wanted, words), "jaccard-sets")
    none = F.lit(None).cast("long")
    again = _indexed(sets.select(none.alias("doc_id"), none.alias("text_hash"), "set"), _from_set_column, None, sets.agg(F.sum("n")).first()[0] or 0)
    posts = written(again.where(F.col("h").isNotNull()).select("h", "sig", "n", "pos"), "jaccard-posts")
    posts = written(_listed(posts).withColumn("block", _size_block(F.col("n"))), "jaccard-lists")

    comp = _compared(posts, sets)
    of = written(comp.select(F.col("v").alias("sig"), "comp").join(reps, "sig"), "jaccard-of")
    first = of.groupBy("comp").agg(F.min("rep").alias("least"))
    linked = spread(of.drop("k"), first, ["comp"], F.col("sig"), _counts(of, ["comp"])).select("sig", "least")
    answer = written(reps.join(linked, "sig", "left").select("sig", F.coalesce("least", "rep").alias("least"), "k"), "jaccard-answers")
    discard(docs.sparkSession, since, keep=(rows, answer))
    return rows, answer


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))


def jaccard_components(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest doc_id that links reach from it)."""
    rows, answer = _answers(_hashed(docs, id_col, text_col), words)
    found = spread(rows.where(F.col("sig").isNotNull()), answer.drop("k"), ["sig"], F.struct("doc_id", "text_hash"), answer.select("sig", "k"))
    alone = rows.where(F.col("sig").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id")).unionByName(alone)


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with its columns unchanged.

    Of components of rows without a doc_id one row stays too, of rows that repeat both doc_id and text one; texts without
    words are linked with nothing and all stay.
    """
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    _, answer = _answers(_hashed(docs.where(has_word), "doc_id", "text"), words)
    key = ["_none", "_id", "_hash"]
    named = lambda i, h: [i.isNull().alias("_none"), F.coalesce(i, F.lit(0)).cast("long").alias("_id"), h.alias("_hash")]
    chosen = answer.select(*named(F.col("least.doc_id"), F.col("least.text_hash"))).distinct()
    given = docs.where(has_word).select(F.struct(*docs.columns).alias("_row"), *named(F.col("doc_id"), F.xxhash64("text")))
    once = given.join(chosen, key, "left_semi").dropDuplicates(key)
    return once.select("_row.*").unionByName(docs.where(~has_word))
