"""Packing along a space-filling curve.

Each document is tokenised, its hashed token vector is projected to a few dimensions, and the point's place on a Hilbert
curve becomes its sort key. Documents are range-sorted by (key, hash of id and text); in that order their tokens form one long
stream that is cut at every multiple of the capacity, so neighbours on the curve share sequences and only the very last
sequence of the corpus can need padding.

Three passes, each restartable from a table in the shared folder: tokens and keys; the sorted documents with their place
inside their range; the pieces, which every row computes alone once the totals of the ranges are known. The ranges are
as many as the tokens ask for (bounded by `MAX_RANGES`), and their totals are all that reaches the driver. A group of
copies has one key but different hashes, so it is split over ranges like anything else.

Null and empty texts are the end token alone. Rows that repeat an id are packed one by one. An empty table has no
pieces. Texts are tokenised whole. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import kept_in_worker, row_key, stored

DIMS, BITS, HASHED = 4, 10, 1024
TOKENS_PER_RANGE, MAX_RANGES = 4_000_000, 50_000
#: words remembered by a task, some 60 MB
REMEMBERED = 150_000
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
PLAIN_BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")
BEYOND_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")
#: marks at the end of a word; the letter before them is looked up behind the first mark, which is what is searched for
MARKS = re.compile(r"[.,;:!?%$&*#|](?<=[^\W\d_].)[.,;:!?%$&*#|]*(?=\s|$)")


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) below 2**bits, by the Gray-code transform of the axes."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((HASHED, DIMS)).astype(np.float32)


def curve_keys(counts: list[np.ndarray], axes: np.ndarray) -> np.ndarray:
    """Hilbert keys of hashed token counts: logarithms, projection, unit length, then equal steps of a normal's quantile."""
    v = np.log1p(np.array(counts, dtype=np.float32))
    z = (v @ axes) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    cell = (1 << BITS) / (1 + np.exp(-1.702 * z))
    return hilbert(np.minimum(cell.astype(np.int64), (1 << BITS) - 1), BITS)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies, as a table for str.translate of Latin-1 text."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + n) for n, b in enumerate(rest)}}


class Words(dict):
    """Token ids of words, encoded when a word is first asked for.

    Two generations of at most `REMEMBERED` words: a full one becomes the old one, from which words in use move back, so
    frequent words stay and rare ones go.
    """

    def __init__(self, tokenizer, wide: str):
        super().__init__()
        self.tokenizer, self.merges, self.wide, self.letters = tokenizer, tokenizer.model.tokenize, wide, byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            if word.isalpha() and word.islower() and (word.isascii() or not BEYOND_LATIN.search(word)):
                ids = [t.id for t in self.merges(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}{self.wide}", *ids)
        self[word] = out
        return out

    def tidy(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class WordEncoder:
    """Token ids of whole texts. The pre-tokenizer never joins what blanks separate, nor a word and the marks behind it,
    so words are encoded once and remembered. Texts of Latin letters are lower-cased whole, as the tokenizer's normalizer
    would do letter by letter, and their words go straight to its merges; anything else goes through all of it."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end], dtype=self.kind).tobytes()
        self.words = kept_in_worker(("words", path), lambda: Words(tokenizer, "H" if self.kind.itemsize == 2 else "I"))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            out.append(b"".join(map(self.words.__getitem__, self.chunks(text or ""))) + self.end)
            self.words.tidy()
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        if any(c in text for c in ODD_BLANKS):  # split() takes these for blanks, the tokenizer does not
            return [c for c in PLAIN_BLANKS.split(text) if c]
        if "<|" not in text and (text.isascii() or not BEYOND_LATIN.search(text)):
            text = MARKS.sub(r" \g<0>", text.lower())
        return text.split()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenised(docs: DataFrame, id_col: str, text_col: str, path: str, end: int) -> DataFrame:
    """(_id, _rk, key, n, ids): every row's tokens with the end token, and its place on the curve."""
    rows = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("_text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, axes = WordEncoder(path, end), projection()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = encoder.encode(batch.column(2).to_pylist())
                tokens = [np.frombuffer(x, dtype=encoder.kind) for x in ids]
                keys = curve_keys([np.bincount(t & (HASHED - 1), minlength=HASHED) for t in tokens], axes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array([len(t) for t in tokens], pa.int64()), pa.array(ids, pa.binary())], names=["_id", "_rk", "key", "n", "ids"])

    return rows.mapInArrow(run, schema)


def along_curve(tokens: DataFrame) -> DataFrame:
    """(_id, n, ids, part, before): range-sorted rows with the tokens that stand before them in their range."""
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ranges = max(min(MAX_RANGES, -(-total // TOKENS_PER_RANGE)), tokens.sparkSession.sparkContext.defaultParallelism)
    ordered = tokens.withColumn("tie", F.xxhash64("_id", "_rk")).repartitionByRange(ranges, "key", "tie").sortWithinPartitions("key", "tie", "_id").select("_id", "n", "ids")
    schema = T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, passed = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = passed + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(ends - n)], names=["_id", "n", "ids", "part", "before"])
            passed = int(ends[-1]) if len(n) else passed

    return stored(ordered.mapInArrow(run, schema))


def pieces_of(start: int, n: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of a document whose tokens begin at `start` of the stream."""
    cuts = [start, *range((start // capacity + 1) * capacity, start + n, capacity), start + n]
    return [(a - start, b - a, a // capacity, a % capacity) for a, b in zip(cuts, cuts[1:], strict=False)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """Pieces: (_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset); ids are little-endian unsigned 32-bit."""
    path = tokenizer or default_tokenizer()
    ordered = along_curve(stored(tokenised(docs, id_col, text_col, path, end)))
    totals = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).toArrow().to_pylist())
    first, passed = {}, 0
    for part, n in totals:
        first[part], passed = passed, passed + n
    id_field = T.StructField("_id", ordered.schema["_id"].dataType)
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([id_field, *longs, T.StructField("ids", T.BinaryType())])
    width = _token_width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            take: list[int] = []
            n, parts, before = (batch.column(k).to_pylist() for k in (1, 3, 4))
            for k, raw in enumerate(batch.column(2).to_pylist()):
                wide = np.frombuffer(raw, dtype=width).astype("<u4").tobytes()
                for start, length, seq, offset in pieces_of(first[parts[k]] + before[k], n[k], capacity):
                    piece = wide[4 * start : 4 * (start + length)]
                    rows.append((start, length, zlib.crc32(piece), n[k], seq, offset, piece))
                    take.append(k)
            if rows:
                kinds = [pa.int64()] * 6 + [pa.binary()]
                values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *values], names=schema.names)

    return ordered.mapInArrow(run, schema)


def _token_width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack(docs).drop("ids").withColumnRenamed("_id", "doc_id")
