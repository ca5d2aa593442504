"""Document fingerprints: threshold-scaled sketches of word shingles, mergeable and comparable at any length.

A sketch retains every shingle hash below a fixed fraction of the hash range, so the share of one document's shingles
that another holds can be estimated however unequal the two are. A floor keeps the `LEAST` smallest hashes besides: texts
of few shingles are retained whole and compared exactly. Two sketches are compared below the lower of the bounds down to
which each is known to be complete. The likeness is the containment of the smaller in the larger: |A and B| / min(|A|, |B|).

A fingerprint is text: `w` (whole) or `s` (scaled), a colon, the retained hashes in ascending order as 16 hex digits each.
Equal texts have equal fingerprints. A shingle is five words, a text of fewer words one shingle; null and empty texts and
texts without words retain nothing and are like each other (1) and nothing else (0).

`beside` lets every document meet the next one in descending id. Ranges of ids come from a narrow sort of (id, text hash);
each range receives, in the one exchange that carries texts, the first document of the range after it as well, so all
neighbours meet inside a task. Rows that agree in id and text are interchangeable: they take one place in the order and
give one result each. Rows of one id follow each other by the hash of their text. A null id comes last. A lone document
is its own neighbour. An empty table gives an empty result. Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from barloom.llm.common import kept_in_worker, per_text, row_key, tasks_for, words_of

SHINGLE = 5
#: of the hash range
FRACTION = 1 / 8
#: hashes that are retained in any case
LEAST = 16

#: words whose hashes a worker keeps, and the longest of them
KEPT_WORDS, KEPT_LENGTH = 1 << 18, 32

SKETCH = pa.schema([("fingerprint", pa.string()), ("n_shingles", pa.int64())])


class WordHashes(dict):
    """64-bit hashes of words; the common ones are looked up."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


def shingle_hashes(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all runs of `size` words (of all words, where there are fewer), ascending."""
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    word = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    last = len(words) - size + 1
    h = np.full(last, size, np.uint64)
    for k in range(size):  # each step is a bijection of the state for a given word, mixed well
        h = (h ^ word[k : k + last]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def scaled(hashes: np.ndarray, whole: bool, fraction: float = FRACTION, least: int = LEAST) -> str:
    """The fingerprint of ascending hashes; whole: they are all of the document's."""
    keep = max(int(np.searchsorted(hashes, np.uint64(int(fraction * 2**64)))), min(least, len(hashes))) if fraction < 1 else len(hashes)
    return f"{'w' if whole and keep == len(hashes) else 's'}:{hashes[:keep].astype('>u8').tobytes().hex()}"


def parsed(fingerprint: str, fraction: float = FRACTION) -> tuple[np.ndarray, int]:
    """(hashes, bound below which they are complete)."""
    hashes = np.frombuffer(bytes.fromhex(fingerprint[2:]), ">u8").astype(np.uint64)
    return hashes, (1 << 64 if fingerprint[0] == "w" else max(int(fraction * 2**64), int(hashes[-1]) + 1 if len(hashes) else 0))


def likeness(a: str | None, b: str | None, fraction: float = FRACTION) -> float:
    """Estimated containment of the smaller document in the larger, 0 to 1."""
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    (x, low), (y, high) = parsed(a, fraction), parsed(b, fraction)
    bound = min(low, high)
    if bound < 1 << 64:
        x, y = (v[: np.searchsorted(v, np.uint64(bound))] for v in (x, y))
    least = min(len(x), len(y))
    return len(np.intersect1d(x, y, assume_unique=True)) / least if least else 0.0


def merged(fingerprints: list[str], fraction: float = FRACTION, least: int = LEAST) -> str:
    """The fingerprint of all the documents' shingles together."""
    hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *(parsed(f, fraction)[0] for f in fingerprints)]))
    return scaled(hashes, all(f[0] == "w" for f in fingerprints), fraction, least)


def sketcher(size: int = SHINGLE, fraction: float = FRACTION, least: int = LEAST) -> Callable[[str | None], tuple[str, int]]:
    hashes = kept_in_worker("fingerprint words", WordHashes)

    def sketch(text: str | None) -> tuple[str, int]:
        found = shingle_hashes(words_of(text), hashes, size)
        return scaled(found, True, fraction, least), len(found)

    return sketch


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, fraction: float = FRACTION, least: int = LEAST) -> DataFrame:
    """(row, scan): every row with its fingerprint and its number of distinct shingles."""

    def make() -> Callable[[list[str | None]], list[tuple]]:
        sketch = sketcher(size, fraction, least)
        return lambda texts: [sketch(t) for t in texts]

    return per_text(docs, text_col, SKETCH, make)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def place(doc_id, h: int) -> tuple:
    """A key that orders rows as Spark does: ascending id, null first, then the text's hash."""
    return (doc_id is not None, 0 if doc_id is None else doc_id, h)


def id_ranges(docs: DataFrame, id_col: str, text_col: str, tasks: int) -> list[tuple]:
    """The greatest key of each of at most `tasks` ranges, ascending."""
    keys = docs.select(*row_key(docs, id_col, text_col)).distinct()
    part = keys.repartitionByRange(tasks, "_id", "_rk").withColumn("part", F.spark_partition_id())
    tops = part.groupBy("part").agg(F.max(F.struct(F.col("_id").isNotNull().alias("has"), "_id", "_rk")).alias("top")).select("top.*").toArrow().to_pylist()
    return sorted(place(r["_id"], r["_rk"]) for r in tops)


def dealt(docs: DataFrame, id_col: str, text_col: str, tasks: int) -> DataFrame:
    """(range, ahead, _id, _rk, text, copies), sorted in each range as neighbours stand; ahead: the first row of the range after it."""
    tops = id_ranges(docs, id_col, text_col, tasks)
    n = max(1, len(tops))
    rows = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("_text"))
    kind = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("ahead", T.IntegerType()), *rows.schema.fields, T.StructField("copies", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(tops)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = shared.value
        for batch in batches:
            copies: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                copies.setdefault(key, [k, 0])[1] += 1
            take, ranges, ahead, count = [], [], [], []
            for key, (k, c) in copies.items():
                at = place(*key)
                r = bisect_left(tops, at)
                take.append(k)
                ranges.append(r)
                ahead.append(0)
                count.append(c)
                if tops[r] == at:  # the first of its range, in descending order, follows the last of the range above
                    take.append(k)
                    ranges.append((r + 1) % n)
                    ahead.append(1)
                    count.append(0)
            body = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(ahead, pa.int32()), *body.columns, pa.array(count, pa.int64())], names=kind.names)

    return rows.mapInArrow(run, kind).repartition(n, "range").sortWithinPartitions("range", "ahead", F.desc("_id"), F.desc("_rk"))


Meeting = Callable[[], tuple[Callable[[str], object], Callable[[str, object, str, object], tuple]]]


def beside(docs: DataFrame, make: Meeting, schema: pa.Schema, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, *schema) of every row: what make()'s second function says of a text and the next one in descending id.

    make()'s first function is called once a text; both texts' results go to the second.
    """
    sorted_rows = dealt(docs, id_col, text_col, tasks_for(docs))
    id_field = sorted_rows.schema["_id"]
    kind = T.StructType([id_field, *from_arrow_schema(schema).fields, T.StructField("copies", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, meet = make()
        open_row, current = None, None  # (range, ahead, id, hash), [text, copies, result]
        for batch in batches:
            ids, rows = [], []
            columns = [batch.column(c).to_pylist() for c in ("range", "ahead", "_id", "_rk", "copies")]
            texts = batch.column("_text")
            for k, (number, ahead, doc_id, h, copies) in enumerate(zip(*columns, strict=True)):
                key = (number, ahead, doc_id, h)
                if key == open_row:
                    current[1] += copies
                    continue
                text = texts[k].as_py() or ""
                mine = [text, copies, once(text)]
                if open_row and open_row[0] == number and not open_row[1]:
                    ids.append(open_row[2])
                    rows.append((*meet(current[0], current[2], text, mine[2]), current[1]))
                open_row, current = key, mine
            if rows:
                values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*schema.types, pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("_id").type), *values], names=kind.names)

    met = sorted_rows.mapInArrow(run, kind)
    return met.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies", "_copy")


DIGEST = pa.schema([("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _meeting():
    sketch = sketcher()

    def meet(text: str, mine: str, following: str, other: str) -> tuple:
        new = edited(text, following)
        changed = sketch(new)[0]
        return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, other)

    return lambda text: sketch(text)[0], meet


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return beside(docs, _meeting, DIGEST).withColumnRenamed("_id", "doc_id")
