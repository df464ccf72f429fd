"""SentencePiece ids of whole texts by a table of distinct chunks, and the texts that the ids give back.

A piece of such a model holds a marker (the library's sign for a space) only at its start, or is made of markers alone. Then no
merge joins a text's letter to the marker behind it: the text falls into chunks, each a run of markers and the letters up to
the next marker, that are segmented apart. A worker segments each distinct chunk once and joins the ids back by position.
Where a model's pieces cross markers or its normaliser changes texts, the library encodes the texts whole.

Cases: a null or empty text has the begin and end ids alone; a text of any length is encoded whole; repeated rows, and rows
without a doc_id, are each a row of the result; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
#: Chunks that a worker's table may hold before it keeps only those of the texts at hand; longer ones are never kept.
REMEMBERED, LONGEST = 250_000, 64
#: Characters of text that are split before their distinct chunks are looked up together, and documents that a worker turns at a time.
GROUP_CHARS, ROWS = 1 << 20, 256

_RUN = re.compile(" +[^ ]*")


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first marker and with spaces for the others. The first marker is the one that the library puts before a text."""
    if MARKER in text:
        text = text.replace(MARKER, " ")
    if "  " not in text and not text.startswith(" "):
        return text.split(" ")
    return [c[1:] for c in _RUN.findall(" " + text)]


class ChunkEncoder:
    """Ids of texts, with begin and end ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        crossing = any(MARKER in p.lstrip(MARKER) for p in pieces)
        probe = "  It's \tﬁ 12  \xa0　Å é\n"
        self.by_chunks = not crossing and MARKER in pieces and sp.normalize(probe) == MARKER + probe.replace(" ", MARKER)
        self.alone = {"": np.array([sp.piece_to_id(MARKER)], "<u4").tobytes()}  # a marker with no letters behind it
        self.table = dict(self.alone)

    def _learn(self, new: list[str]) -> None:
        for chunk, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            self.table[chunk] = np.array(ids, "<u4").tobytes()

    def _group(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunks:
            return [self.begin + np.array(i, "<u4").tobytes() + self.end for i in self.library.encode(texts, num_threads=1)]
        split = [chunks(t) if t else [] for t in texts]
        distinct = set().union(*split)
        self._learn([c for c in distinct if c not in self.table])
        of = self.table.__getitem__
        out = [b"".join([self.begin, *map(of, words), self.end]) for words in split]
        if len(self.table) > REMEMBERED:
            self.table = {c: of(c) for c in distinct} | self.alone
        for c in [c for c in distinct if len(c) > LONGEST]:
            self.table.pop(c, None)
        return out

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= GROUP_CHARS:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder(model)
    for batch in _slices(batches):
        ids = pa.array(encoder.encode(batch.column(1).to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    for batch in _slices(batches):
        texts = [library.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])


def _with_id(rows: DataFrame, more: str) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {more}"


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of each document."""
    rows = docs.select("doc_id", F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _encoded(b, model), _with_id(rows, "ids binary"))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids) with the text that the library gives for the ids."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(lambda b: _decoded(b, model), _with_id(rows, "ids binary, text string"))


def round_trip(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """decode() of encode(), by one worker a task."""
    rows = docs.select("doc_id", F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _decoded(_encoded(b, model), model), _with_id(rows, "ids binary, text string"))
