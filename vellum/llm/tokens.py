"""Token ids in binary blocks, each document compressed by itself against one shared zstandard dictionary.

File format: a folder with a table of blocks and a table with the dictionary. A block is
  magic "VTOK", uint16 version, uint16 bytes an id, 32 bytes SHA-256 of the dictionary, uint32 documents n,
  n int64 document ids, n bytes (1 for a document that has an id), n uint32 id counts, n+1 uint64 offsets of the frames,
  the frames,
all little-endian. A document is one zstandard frame of its ids, so any one is read through the offsets without the rest.
Blocks are rows of a Parquet table: Spark commits them, so a lost executor's part is written again, and any store will do.

Cases: a null or empty text is a document of the end id alone; a text of any length is encoded whole; documents that share a
doc_id stand in the order of a hash of their texts, and those without one after all others in that order, so reruns agree;
repeated rows are each a document; an empty table writes no block and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.shared import shared_dir, shuffle_parts

HEAD = struct.Struct("<4sHH32sI")
MAGIC, VERSION = b"VTOK", 2
#: Documents in a block, and the size in bytes of its ids at which it is closed early.
BLOCK_DOCS, BLOCK_BYTES = 1024, 8 << 20
#: The dictionary is trained on at most so many documents (those of the smallest hash of their id), on so many characters of each.
DICT_DOCS, DICT_CHARS, DICT_BYTES = 512, 4000, 32 << 10
#: Words, and parts of words, whose ids a worker remembers in each of two generations.
REMEMBERED, REMEMBERED_PARTS = 500_000, 250_000

#: What the tokenizer's own splitting gives on lower-case Latin-1 text, where its normalisation only lowers and joins space.
#: tests/llm holds it against the library on every pair of Latin-1 characters.
_SPACE, _LETTER, _NUMBER = r"\x09-\x0d \x85\xa0", r"a-zªµºß-öø-ÿ", r"0-9²³¹¼-¾"
_PART = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memory(dict):
    """Remembers what find gave, in two generations: the older one goes when the newer one is full."""

    def __init__(self, find, most):
        super().__init__()
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Encodes whole texts to little-endian ids with the tokenizers library.

    A text in Latin-1 without special-token marks is encoded by its words, each part of a word by the tokenizer's model,
    and both are remembered; any other text goes to the library whole. Only where a probe shows that both ways agree.
    """

    def __init__(self, path: str, width: int, end_id: int):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind, self.end = f"<u{width}", end_id.to_bytes(width, "little")
        letters, model, code = _byte_letters(), self.tok.model, "H" if width == 2 else "I"

        def part(p: str) -> bytes:
            made = array(code, [t.id for t in model.tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(letters))])
            if sys.byteorder == "big":
                made.byteswap()
            return made.tobytes()

        parts = _Memory(part, REMEMBERED_PARTS)

        def word(w: bytes) -> bytes:
            if w.isalpha():  # ASCII letters only
                return parts[w.decode("latin-1").lower()]
            if w[-1:] in b".,;:!?" and w[:-1].isalpha():
                return parts[w[:-1].decode("latin-1").lower()] + parts[w[-1:].decode("latin-1")]
            return b"".join([parts[p] for p in _PART.findall(w.decode("latin-1").lower())])

        self.words = _Memory(word, REMEMBERED)
        probe = "It's 12½ naïve-No! ÀÉ«x» don't ¿Qué? [\x1c\x85a\xa0b] ß_µ"
        self.by_word = self._by_word(probe.encode("latin-1")) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _by_word(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if self.by_word and "<|" not in text:
            try:
                return self._by_word(text.encode("latin-1")) + self.end
            except UnicodeEncodeError:
                pass
        return self._whole(text) + self.end


@functools.lru_cache(1)
def _kept(path: str, changed: int, width: int, end_id: int) -> Encoder:
    return Encoder(path, width, end_id)


def worker_encoder(path: str, width: int, end_id: int) -> Encoder:
    """The encoder of this Python worker: Spark hands the worker task after task, and what it remembers serves them all."""
    return _kept(path, os.stat(path).st_mtime_ns, width, end_id)


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary, or where there is too little to train on, the samples' own end as raw content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[-size:]


def pack(rows: list[tuple[int | None, bytes]], width: int, dictionary: bytes, compressor) -> bytes:
    """A block of documents (id, ids as bytes)."""
    frames = [compressor.compress(x) for _, x in rows]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    head = HEAD.pack(MAGIC, VERSION, width, hashlib.sha256(dictionary).digest(), len(rows))
    counts = np.array([len(x) // width for _, x in rows], "<u4")
    ids, known = np.array([i or 0 for i, _ in rows], "<i8"), np.array([i is not None for i, _ in rows], bool)
    return b"".join([head, ids.tobytes(), known.tobytes(), counts.tobytes(), offsets.tobytes(), *frames])


class Block:
    """Reads a block; document(k) touches only the frame of document k."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, digest, n = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token block")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        at = HEAD.size
        self.ids = np.frombuffer(data, "<i8", n, at)
        self.known = np.frombuffer(data, "?", n, at + 8 * n)
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n)
        self.data, self.base = data, at + 13 * n + 8 * (n + 1)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def document(self, k: int) -> np.ndarray:
        a, b = self.base + int(self.offsets[k]), self.base + int(self.offsets[k + 1])
        raw = self.unpack.decompress(self.data[a:b], max_output_size=int(self.counts[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, text_col: str = "text") -> str:
    """Write docs' ids in ascending doc_id order; the folder written."""
    import zstandard
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select("doc_id", F.col(text_col).alias("text"))
    ids = [r.doc_id for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(DICT_DOCS).collect()]
    sample = rows.where(F.col("doc_id").isin(ids)).limit(DICT_DOCS).select(F.substring("text", 1, DICT_CHARS).alias("text")).collect() if ids else []
    own = Encoder(tokenizer, width, end_id)
    dictionary = train_dictionary([own.encode(r.text) for r in sample])
    spark.createDataFrame([(bytearray(dictionary), width, hashlib.sha256(dictionary).hexdigest())], "dictionary binary, width int, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, width, end_id)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        part, base, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed() -> pa.RecordBatch:
            n = sum(len(x) for _, x in held) // width
            block = pack(held, width, dictionary, compressor)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([n], pa.int64()), pa.array([block], pa.binary())], names=["part", "base", "n", "block"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, x := encoder.encode(text)))
                size += len(x)
                if len(held) == BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield closed()
                    base, held, size = base + size // width, [], 0
        if held:
            yield closed()

    order = [F.col("doc_id").asc_nulls_last(), F.col("own").asc()]
    ordered = rows.withColumn("own", F.xxhash64("text")).repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(run, "part int, base long, n long, block binary").write.parquet(f"{path}/blocks")
    return path


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    found = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(found.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != found.sha256:
        raise ValueError("the dictionary doesn't match its hash")
    return spark.read.schema("part int, base long, n long, block binary").parquet(f"{path}/blocks"), dictionary


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    blocks, dictionary = _opened(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                block = Block(data, dictionary)
                n = block.counts.astype(np.int64)
                texts = [block.document(k).astype("<u4") for k in range(len(n))]
                crc = [zlib.crc32(x.tobytes()) for x in texts]
                made = [pa.array(np.full(len(n), part), pa.int32()), pa.array(block.ids, mask=~block.known), pa.array(base + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(made + ([pa.array([x.tolist() for x in texts], pa.list_(pa.int64()))] if with_ids else []), names=["part", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    rows = blocks.select("part", "base", "block").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # One total for each partition of the write, in order; so few that one task adds them up.
    totals = blocks.groupBy("part").agg(F.max(F.col("base") + F.col("n")).alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
