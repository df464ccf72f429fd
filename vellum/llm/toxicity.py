"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained in numpy from confirmed toxic documents (positive)
and a sample of all training documents, whatever they are, as the unlabelled ones. Its risk is prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)): where the second part
turns negative, the step goes the other way. The class prior is the toxic share of the labelled training rows. The weights
see no negative label. Negative labels are used once: where the score 0.7 lies on the classifier's margin is chosen on
labelled training rows of both kinds that the weights haven't seen.

The model is fit on a bounded sample, MAX_POSITIVE and MAX_UNLABELLED documents of smallest hash of their id: a mean over so
many has a standard error of about a hundredth of the loss's spread, less than the prior's own. Every document's whole text
is scored. Cases: a null or empty text has no features and gets the score of the bias; without a positive example every
score is 0; a document without an id is never in training and belongs to no held-out fold; of texts that share a doc_id the
one with the least features stands for it in training; repeated rows get one result each; labels of rows outside the
training folds, lang, source and doc_id are no input of a score; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import kernel as K

MAX_POSITIVE, MAX_UNLABELLED = 1500, 6000
BITS = 18
BEGINNINGS = (7, 8)
MIN_Z = 4.0
CUT = 0.7

#: Bytes of words: digits, letters and all beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of a text column: edges into the features of each row, feature numbers, values."""
    edges, cols, vals = [0], [], []
    for _, _, part, own in K.pieces(data, offs, 1_000_000):
        h, row, at, lens = K.words(part, own, _WORD, K.LOWER)
        keys = [(row, h)]
        for n in BEGINNINGS:
            long = np.flatnonzero(lens > n)
            code = np.zeros(len(long), np.uint64)
            for k in range(n):
                code = code * K.PRIME + K.BYTE[K.LOWER[part[at[long] + k]]]
            keys.append((row[long], K.mixed(code + np.uint64(n))))
        rows = np.concatenate([r for r, _ in keys]).astype(np.uint64)
        number = np.concatenate([c for _, c in keys]) >> np.uint64(64 - BITS)
        found, count = np.unique((rows << np.uint64(BITS)) | number, return_counts=True)
        of = (found >> np.uint64(BITS)).astype(np.int64)
        cols.append((found & np.uint64((1 << BITS) - 1)).astype(np.int64))
        n = np.bincount(of, minlength=len(own) - 1)
        v = np.log1p(count)
        vals.append(v)
        edges.extend(edges[-1] + np.cumsum(n))
    return np.array(edges), np.concatenate(cols) if cols else np.zeros(0, np.int64), np.concatenate(vals) if vals else np.zeros(0)


def _sums(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    return total[edges[1:]] - total[edges[:-1]]


def _chosen(edges, cols, vals, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Only the features whose share of rows differs between positive and unlabelled by MIN_Z standard errors or more."""
    rows = np.repeat(np.arange(len(positive)), np.diff(edges))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    p = np.bincount(cols[positive[rows]], minlength=1 << BITS)
    u = np.bincount(cols[~positive[rows]], minlength=1 << BITS)
    share = (p + u + 0.5) / (n_p + n_u + 1)
    z = np.abs(p / n_p - u / n_u) / np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    keep = ((z >= MIN_Z) & (p + u >= 3))[cols]
    return cols[keep], vals[keep], np.concatenate([[0], np.cumsum(np.bincount(rows[keep], minlength=len(positive)))])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: score = sigmoid(slope * (margin - offset))
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, edges, cols, vals) -> np.ndarray:
        return _sums(edges, vals * self.weights[cols]) + self.bias

    def scores(self, edges, cols, vals) -> np.ndarray:
        z = np.clip(self.slope * (self.margins(edges, cols, vals) - self.offset), -50, 50)
        return 1 / (1 + np.exp(-z))


def nn_risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of margins z with the logistic loss, and the step's slope for each margin.

    Where the corrected part is negative, the slope is that of the part alone, turned round.
    """
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    s = 1 / (1 + np.exp(-z))  # d loss(-1) / dz; d loss(+1) / dz is s - 1
    minus = np.log1p(np.exp(z))
    rest = minus[~positive].mean() - prior * minus[positive].mean()
    g = np.zeros(len(z))
    if rest >= 0:
        g[positive] = prior * (s[positive] - 1) / n_p - prior * s[positive] / n_p
        g[~positive] = s[~positive] / n_u
    else:
        g[positive] = prior * s[positive] / n_p
        g[~positive] = -s[~positive] / n_u
    return prior * (minus[positive] - z[positive]).mean() + max(0.0, rest), g


def fit_nnpu(edges, cols, vals, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights by Adam on the non-negative risk with the logistic loss."""
    n = len(positive)
    cols, vals, edges = _chosen(edges, cols, vals, positive)
    used, own = np.unique(cols, return_inverse=True)
    rows = np.repeat(np.arange(n), np.diff(edges))
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.clip(_sums(edges, vals * w[own]) + b, -30, 30)
        _, g = nn_risk(z, positive, prior)
        grad = np.bincount(own, vals * g[rows], minlength=len(used)) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(1 << BITS)
    full[used] = w
    return Model(full, b)


def calibrate(model: Model, margins: np.ndarray, toxic: np.ndarray) -> None:
    """Put the score CUT at the margin with the best F1 on labelled rows, midway between neighbouring rows."""
    if toxic.sum() == 0 or toxic.all():
        return
    order = np.argsort(-margins, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    k = int(np.argmax(f1))
    at = (margins[order[k]] + margins[order[min(k + 1, len(order) - 1)]]) / 2
    spread = max(np.std(margins), 1e-6)
    model.slope = 3 / spread
    model.offset = at - np.log(CUT / (1 - CUT)) / model.slope


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(3))


def _gathered(docs: DataFrame, ids: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features of the sampled documents, made where the documents are."""
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))  # at most the bounds above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, cols, vals = features(*K.buffers(batch.column(1)))
            cols, vals = cols.astype("<u4"), vals.astype("<f4")
            cut = [(cols[a:b].tobytes(), vals[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in cut], pa.binary()), pa.array([v for _, v in cut], pa.binary())], names=["doc_id", "cols", "vals"])

    rows = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, cols binary, vals binary")
    found: dict[int, tuple[bytes, bytes]] = {}
    for r in rows.collect():
        found[r.doc_id] = min(found.get(r.doc_id, (r.cols, r.vals)), (r.cols, r.vals))
    return {i: (np.frombuffer(bytes(c), "<u4"), np.frombuffer(bytes(v), "<f4")) for i, (c, v) in found.items()}


def _stacked(rows: list[tuple[np.ndarray, np.ndarray]]):
    edges = np.concatenate([[0], np.cumsum([len(c) for c, _ in rows])]).astype(np.int64)
    none = [np.zeros(0)]
    return edges, np.concatenate([c for c, _ in rows] or none).astype(np.int64), np.concatenate([v for _, v in rows] or none)


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> Model | None:
    """A model from the rows outside the held-out fold; None without a toxic example.

    Fit: toxic rows against unlabelled ones. Calibration: a third of the labelled rows, kept from the fit.
    """
    by = F.xxhash64(F.lit(5), "doc_id")
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    kept_back = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    fit_p = [r.doc_id for r in rows.where((F.col("toxic") == 1) & ~kept_back).select("doc_id").orderBy(by, "doc_id").limit(MAX_POSITIVE).collect()]
    if not fit_p:
        return None
    checked = {r.doc_id: r.toxic for r in rows.where(kept_back).orderBy(by, "doc_id").limit(MAX_POSITIVE).collect()}
    pool = docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != held_out) & ~kept_back).select("doc_id")
    fit_u = [r.doc_id for r in pool.orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").limit(MAX_UNLABELLED).collect()]
    share = rows.agg(F.avg("toxic").alias("prior")).first()
    found = _gathered(docs, sorted({*fit_p, *fit_u, *checked}))
    # A toxic document that the sample holds is in both parts: the unlabelled risk is that of all documents.
    fit_p, fit_u = [i for i in fit_p if i in found], [i for i in fit_u if i in found]
    ids, positive = fit_p + fit_u, np.arange(len(fit_p) + len(fit_u)) < len(fit_p)
    if not positive.any() or positive.all():
        return None
    model = fit_nnpu(*_stacked([found[i] for i in ids]), positive, float(share.prior))
    seen = [i for i in checked if i in found]
    calibrate(model, model.margins(*_stacked([found[i] for i in seen])), np.array([checked[i] == 1 for i in seen], bool))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, held_out: int = 1) -> DataFrame:
    """One row for each document: keep, score (0 to 1) and predicted (1 from CUT on)."""
    keep = keep or ["doc_id"]
    model = train(docs, labels, held_out)
    used = np.flatnonzero(model.weights) if model else np.zeros(0, np.int64)
    few = (used, model.weights[used], model.bias, model.slope, model.offset) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        if few:
            own = Model(np.zeros(1 << BITS), *few[2:])
            own.weights[few[0]] = few[1]
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            s = own.scores(*features(*K.buffers(col))) if own else np.zeros(len(col))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=[*keep, "score", "predicted"])

    given = docs.select(*keep, *([] if "text" in keep else ["text"]))
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema)
    return given.mapInArrow(run, f"{made}, score double, predicted int")
