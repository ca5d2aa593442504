"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a `size`-byte string that also starts anywhere else is removed. Strings are UTF-8 bytes of whole
texts, judged on the input; matches never cross texts.

Sorting all suffixes of a corpus moves every text many times over, so candidates are found first. The strings of a text
(one for each start) are cut into segments: runs of starts whose string has the same smallest `GRAM`-byte hash. Equal
strings have equal smallest hashes, so a string whose segment's hash occurs once, in one place, is unique and needs no
look at its bytes. What is left is decided exactly:

* segments that are equal as a whole and occur twice or more are repeated from end to end; they are told by 128 bits of
  blake2b of all their bytes, not by the polynomial hash, which texts can be made to collide under;
* the other segments of a hash are brought together with their bytes and their suffixes are sorted, `size` bytes deep.
  Prefix polynomial hashes compare two suffixes in a logarithmic number of steps: a binary search finds their common
  extension, the next byte decides. The merge sort runs level by level over all groups of a batch at once. Neighbours
  with a common extension of `size` are equal strings; their bytes are compared before that is believed, and a batch
  with a collision is sorted again by its bytes;
* a hash with more than `group` different segments (a passage with many different surroundings) is never brought into
  one task. Its segments are cut into pieces of `BLOCKS[0]` starts at most, at fixed distances from the smallest gram, so
  equal strings stand in the same place of pieces that share the bytes common to all strings of a piece. Pieces that are
  equal as a whole are repeated from end to end, pieces whose common bytes stand nowhere else are unique; one of each
  other kind is cut into shorter pieces, down to single strings. All are told by 128 bits of blake2b.

Null texts are empty; texts shorter than `size` lose nothing. Rows that repeat an id are texts of their own (equal rows
repeat each other). An empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import row_key, stored

GRAM = 32
BLOCK = 1 << 19
LONGEST_RUN = 4096
BLOCKS = (32, 8, 2, 1)  # starts of a piece
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
U = np.uint64


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Prefix polynomial hashes modulo 2**64 of a byte buffer; a range's hash does not depend on its place."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int):
        n = len(data) + 1
        have = self.tables.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, BLOCK + 1)
            have = self.tables[base] = powers(base, size), powers(pow(base, -1, 1 << 64), size)
        up, self.down = have
        self.prefix = np.zeros(n, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + U(1)) * up[: n - 1], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]

    def all(self, length: int) -> np.ndarray:
        n = len(self.prefix) - length
        return (self.prefix[length:] - self.prefix[:n]) * self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the weak low bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def smallest(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    have, out = 1, v
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def segments(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Segments of a buffer of texts that end at `ends`: (start, run, key, tied).

    A segment is `run` consecutive starts; key is their smallest gram hash, tied whether that gram stands in more than
    one place of the segment, as in periodic text.
    """
    hashes = Rolling(data, BASES[0])
    v = mixed(hashes.all(GRAM))
    width = size - GRAM + 1
    m = smallest(v, width)
    n = len(m)
    piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    valid = np.arange(n) + size <= ends[piece]
    begin = np.concatenate([[0], ends[:-1]])[piece]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    fresh[1:] = (m[1:] != m[:-1]) | (piece[1:] != piece[:-1])
    fresh |= (np.arange(n) - begin) % LONGEST_RUN == 0
    fresh &= valid
    start = np.flatnonzero(fresh)
    if not len(start):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    number = np.cumsum(fresh) - 1
    run = np.bincount(number[valid], minlength=len(start))
    # how often the smallest gram stands in each segment
    reach = run + width - 1
    first = np.cumsum(reach) - reach
    at = np.arange(reach.sum()) + np.repeat(start - first, reach)
    tied = np.add.reduceat(v[at] == np.repeat(m[start], reach), first, dtype=np.int64) > 1
    return start, run, m[start], tied


def buffers(texts: list[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """(bytes, ends, row of each piece, its place in the row's text); long texts in blocks that overlap by size - 1."""
    parts: list[bytes] = []
    rows: list[int] = []
    places: list[int] = []
    room = BLOCK

    def flush():
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum([len(p) for p in parts]), list(rows), list(places)

    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) < size:
            continue
        for a in range(0, len(raw) - size + 1, BLOCK // 2):
            piece = raw[a : a + BLOCK // 2 + size - 1]
            if parts and room < len(piece):
                yield flush()
                parts.clear(), rows.clear(), places.clear()
                room = BLOCK
            parts.append(piece), rows.append(k), places.append(a)
            room -= len(piece)
    if parts:
        yield flush()


def strong(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """128 bits of blake2b of data[start : start + length], as two integers each: byte strings that agree in it are equal."""
    raw = data.tobytes()
    marks = b"".join(hashlib.blake2b(raw[a : a + n], digest_size=16).digest() for a, n in zip(start.tolist(), length.tolist(), strict=True))
    return np.frombuffer(marks, dtype="<i8").reshape(-1, 2)


def all_segments(rows: DataFrame, size: int, marked: bool = True) -> DataFrame:
    """(_id, _rk, key, whole, more, start, run, tied) of every text of (_id, _rk, _text); whole and more, null unless marked, stand for all bytes."""
    schema = T.StructType([*rows.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in ("key", "whole", "more", "start")], T.StructField("run", T.IntegerType()), T.StructField("tied", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ends, owner, place in buffers(batch.column(2).to_pylist(), size):
                start, n, key, tied = segments(data, ends, size)
                if not len(start):
                    continue
                whole = [pa.array(c) for c in strong(data, start, n + size - 1).T] if marked else [pa.nulls(len(start), pa.int64())] * 2
                piece = np.searchsorted(ends, start, side="right")
                at = start - np.concatenate([[0], ends[:-1]])[piece] + np.array(place)[piece]
                rows_of = pa.array(np.array(owner)[piece])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows_of), batch.column(1).take(rows_of), pa.array(key.view(np.int64)), *whole, pa.array(at), pa.array(n.astype(np.int32)), pa.array(tied)],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


class Suffixes:
    """A hash-compared merge sort of equally deep suffixes of one buffer."""

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.depth = data, depth
        self.hash = Rolling(data, BASES[0])
        self.whole = self.hash.all(depth)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, at most depth: a binary search over prefix hashes."""
        out = np.full(len(a), self.depth)
        left = np.flatnonzero(self.whole[a] != self.whole[b])  # the first probe: equal to the full depth
        a, b = a[left], b[left]
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.depth - 1)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.hash.of(a, mid) == self.hash.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[left] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; equal ones as `ties` says."""
        n = self.extension(a, b)
        last = np.minimum(n, self.depth - 1)
        return np.where(n == self.depth, ties, self.data[a + last] < self.data[b + last])

    def sort(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Sort the suffixes of every group (groups are contiguous) by merging runs of doubling width."""
        order = suffixes.copy()
        head = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        length = np.diff(np.append(head, len(group)))
        begin, size = np.repeat(head, length), np.repeat(length, length)
        q = np.arange(len(group)) - begin
        width = 1
        while width < size.max(initial=0):
            work = np.flatnonzero(size > width)
            place, block = q[work], q[work] // (2 * width) * (2 * width)
            left = place - block < width
            other = np.where(left, block + width, block)
            low = np.minimum(other, size[work])
            high = np.minimum(other + width, size[work])
            start, element, base = low.copy(), order[work], begin[work]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                # of equal suffixes those of the left run come first
                less = self.before(order[base[open_] + mid], element[open_], ~left[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            rank = place - block - np.where(left, 0, width)
            merged = order.copy()
            merged[base + block + rank + (low - start)] = element
            order = merged
            width *= 2
        return order

    def equal_neighbours(self, order: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """Which suffixes equal the one before them in their group; None after a hash collision."""
        a, b = order[:-1], order[1:]
        pair = np.flatnonzero((group[1:] == group[:-1]) & (self.extension(a, b) == self.depth))
        for k in range(0, len(pair), 4096):
            some = pair[k : k + 4096]
            span = np.arange(self.depth)
            if not (self.data[a[some][:, None] + span] == self.data[b[some][:, None] + span]).all():
                return None
        out = np.zeros(len(order), dtype=bool)
        out[pair + 1] = True
        return out


def first_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of suffixes as two big-endian numbers."""
    wide = np.zeros((2, len(at)), dtype=np.uint64)
    for k in range(16):
        wide[k // 8] = (wide[k // 8] << U(8)) | data[at + k].astype(np.uint64)
    return wide[0], wide[1]


def repeated_starts(data: np.ndarray, starts: np.ndarray, runs: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """For segments at `starts` of a buffer: which of their suffixes equals another one of the same key, in order."""
    first = np.cumsum(runs) - runs
    at = np.arange(runs.sum()) + np.repeat(starts - first, runs)
    one, two = first_words(data, at)
    key = np.repeat(keys, runs)
    by = np.lexsort((two, one, key))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])
    group = np.cumsum(new)
    crowd = np.bincount(group)[group] > 1
    by, group = by[crowd], group[crowd]
    out = np.zeros(len(at), dtype=bool)
    if not len(by):
        return out
    back = np.full(len(data), -1, dtype=np.int64)
    back[at] = np.arange(len(at))
    sorter = Suffixes(data, size)
    order = sorter.sort(at[by], group)
    same = sorter.equal_neighbours(order, group)
    if same is None:  # a collision: order by the bytes themselves
        order = np.array(sorted(at[by].tolist(), key=lambda p: bytes(data[p : p + size])))
        texts = [bytes(data[p : p + size]) for p in order]
        same = np.array([False] + [x == y for x, y in zip(texts, texts[1:], strict=False)])
    hit = same.copy()
    hit[:-1] |= same[1:]
    out[back[order[hit]]] = True
    return out


def ranges(flags: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags that do not cross the segments that begin at `first`: (segment, place in it, length)."""
    edge = np.zeros(len(flags), dtype=bool)
    edge[first] = True
    before = np.concatenate([[False], flags[:-1]])
    begin = np.flatnonzero(flags & (edge | ~before))
    number = np.cumsum(flags & (edge | ~before)) - 1
    length = np.bincount(number[flags], minlength=len(begin)) if len(begin) else np.empty(0, dtype=np.int64)
    segment = np.searchsorted(first, begin, side="right") - 1
    return segment, begin - first[segment], length


def packed(rows: DataFrame) -> DataFrame:
    """(_id, _rk, z): texts compressed for a shuffle."""
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_bytes(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (_id, _rk, key, start, run, hot, done) with the bytes of each segment."""
    lists = wanted.groupBy("_id", "_rk").agg(F.collect_list(F.struct("key", "start", "run", "hot", "done")).alias("want"))
    both = texts.join(lists, texts["_id"].eqNullSafe(lists["_id"]) & (texts["_rk"] == lists["_rk"])).select(texts["_id"], texts["_rk"], "z", "want")
    schema = T.StructType([*both.schema.fields[:2], T.StructField("key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("run", T.IntegerType()), T.StructField("hot", T.BooleanType()), T.StructField("done", T.BooleanType()), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                take, out = [], []
                for k, (z, want) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                    raw = zlib.decompress(z)
                    for w in want:
                        take.append(k)
                        out.append((w["key"], w["start"], w["run"], w["hot"], w["done"], raw[w["start"] : w["start"] + w["run"] + size - 1]))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
                    rows = pa.array(take)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=schema.names)

    return both.mapInArrow(run, schema)


RANGE = [T.StructField("start", T.LongType()), T.StructField("n", T.LongType())]


def sorted_groups(content: DataFrame, size: int, batch_bytes: int = 1 << 20) -> DataFrame:
    """(_id, _rk, start, n): repeated starts of segments whose keys stand together, by the suffix sort."""
    rows = content.select("_id", "_rk", "key", "start", "run", "bytes").repartition("key").sortWithinPartitions("key")
    schema = T.StructType([*rows.schema.fields[:2], *RANGE])

    def solve(table: pa.Table) -> pa.RecordBatch | None:
        raw = table["bytes"].to_pylist()
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        lengths = np.array([len(b) for b in raw])
        runs = table["run"].to_numpy().astype(np.int64)
        flags = repeated_starts(data, np.cumsum(lengths) - lengths, runs, table["key"].to_numpy(), size)
        segment, place, n = ranges(flags, np.cumsum(runs) - runs)
        if not len(n):
            return None
        rows_of = pa.array(segment)
        start = table["start"].to_numpy()[segment] + place
        some = table.select(["_id", "_rk"]).combine_chunks().take(rows_of)
        return pa.RecordBatch.from_arrays([some["_id"].combine_chunks(), some["_rk"].combine_chunks(), pa.array(start), pa.array(n.astype(np.int64))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size_held = 0
        for whole in batches:
            keys = whole.column(2).to_numpy()
            sizes = np.cumsum(np.array([len(b) for b in whole.column(5).to_pylist()]))
            begin, passed = 0, 0
            for cut in np.flatnonzero(np.diff(keys)) + 1:
                if size_held + int(sizes[cut - 1]) - passed >= batch_bytes:
                    held.append(whole.slice(begin, int(cut) - begin))
                    if (out := solve(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, size_held, begin, passed = [], 0, int(cut), int(sizes[cut - 1])
            if begin < whole.num_rows:
                held.append(whole.slice(begin))
                size_held += int(sizes[-1]) - passed
                # the key may go on in the next batch; what stands before its first row can be solved once it is large
                if size_held >= batch_bytes:
                    table = pa.Table.from_batches(held)
                    k = table["key"].to_numpy()
                    edge = int(np.searchsorted(k, k[-1]))
                    if edge:
                        if (out := solve(table.slice(0, edge))) is not None:
                            yield out
                        held = table.slice(edge).to_batches()
                        size_held = sum(len(b) for b in table.slice(edge)["bytes"].to_pylist())
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return rows.mapInArrow(run, schema)


def pieces(content: DataFrame, size: int, block: int) -> DataFrame:
    """(_id, _rk, key, start, run, bytes, done, c1, c2, w1, w2): segments (_id, _rk, key, start, run, bytes, done) cut into pieces.

    A piece is consecutive starts whose strings have the same first smallest gram, at a distance of the same multiple of
    `block`. c1 and c2 stand for the bytes that all strings at these distances share, w1 and w2 for all bytes of the piece.
    """
    rows = content.select("_id", "_rk", "key", "start", "run", "bytes", "done")
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("c1", "c2", "w1", "w2")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                take, starts, runs, raws, marks = [], [], [], [], []
                for k, (key, start, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 5)), strict=True)):
                    data = np.frombuffer(raw, dtype=np.uint8)
                    grams = np.flatnonzero(mixed(Rolling(data, BASES[0]).all(GRAM)).view(np.int64) == key)
                    p = np.arange(len(data) - size + 1)
                    anchor = grams[np.searchsorted(grams, p)]
                    place = (anchor - p) // block
                    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
                    n = np.diff(np.append(first, len(p)))
                    core = strong(data, (anchor - block * place)[first], np.full(len(first), size - block + 1))
                    marks.append(np.hstack([core, strong(data, first, n + size - 1)]))
                    take += [k] * len(first)
                    starts.append(start + first)
                    runs.append(n)
                    raws += [raw[a : a + m + size - 1] for a, m in zip(first.tolist(), n.tolist(), strict=True)]
                owner = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(owner) for c in range(3)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(runs).astype(np.int32)), pa.array(raws, pa.binary()), batch.column(6).take(owner), *map(pa.array, np.vstack(marks).T)],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def refined_strings(content: DataFrame, size: int) -> list[DataFrame]:
    """Frames (_id, _rk, start, n) of the repeated strings of hot keys: pieces told by strong hashes, never brought together.

    Segments that are done have been found already; they are only compared with others.
    """
    out: list[DataFrame] = []
    for block in (min(b, size) for b in BLOCKS):
        if content.isEmpty():
            break
        cut_up = stored(pieces(content, size, block))
        marks = ["c1", "c2", "w1", "w2"]
        kinds = stored(cut_up.groupBy(marks).agg(F.count("*").alias("c"), F.max("done").alias("done"), F.min(F.struct("_id", "_rk", "key", "start", "run", "bytes")).alias("one")))
        out.append(cut_up.filter("not done").join(kinds.filter("c > 1").select(marks), marks).select("_id", "_rk", "start", F.col("run").cast("long").alias("n")))
        shared = kinds.groupBy("c1", "c2").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("c1", "c2")
        content = kinds.join(shared, ["c1", "c2"]).select("one.*", (F.col("done") | (F.col("c") > 1)).alias("done"))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, group: int = 512) -> tuple[DataFrame, DataFrame]:
    """Compressed texts (_id, _rk, z), and (_id, _rk, start, n): runs of starts of strings that also start elsewhere."""
    rows = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("_text"))
    segs = all_segments(rows, size)
    often = all_segments(rows, size, marked=False).groupBy("key").agg(F.count("*").alias("c"), F.max("tied").alias("t")).filter("c > 1 or t").select("key")
    found = stored(segs.join(often, "key"))
    kinds = found.groupBy("key", "whole", "more").agg(F.count("*").alias("c"), F.max("tied").alias("tied"), F.min(F.struct("_id", "_rk", "start", "run")).alias("one"))
    kinds = stored(kinds)
    per_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"))
    # equal segments: repeated from end to end
    twice = kinds.filter("c > 1").select("key", "whole", "more")
    plain = found.join(twice, ["key", "whole", "more"]).select("_id", "_rk", "start", F.col("run").cast("long").alias("n"))
    # different segments of one key, and periodic ones: one of each kind is compared by its bytes
    open_ = kinds.join(per_key, "key").filter("kinds > 1 or (tied and c = 1)").select("one.*", "key", (F.col("kinds") > group).alias("hot"), (F.col("c") > 1).alias("done"))
    texts = packed(rows)
    content = stored(with_bytes(texts, open_, size))
    found = plain.unionByName(sorted_groups(content.filter("not hot"), size))
    for part in refined_strings(content.filter("hot"), size):
        found = found.unionByName(part)
    return texts, found


def cover(starts: list[int], counts: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by runs of starts."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts, counts, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + size)
        else:
            out.append([s, s + n - 1 + size])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, group: int = 512) -> DataFrame:
    """(_id, _rk, n_bytes, n_removed, n_spans, kept): kept are the remaining bytes, which need not be valid UTF-8."""
    texts, found = repeats(docs, id_col, text_col, size, group)
    per_row = found.groupBy("_id", "_rk").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("counts"))
    both = texts.join(per_row, texts["_id"].eqNullSafe(per_row["_id"]) & (texts["_rk"] == per_row["_rk"]), "left").select(texts["_id"], texts["_rk"], "z", "starts", "counts")
    schema = T.StructType([*both.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for z, starts, counts in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    raw = zlib.decompress(z)
                    gone = cover(starts or [], counts or [], size)
                    edges = [0, *[x for r in gone for x in r], len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(gone), kept))
                kinds = [pa.int64()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=schema.names)

    return both.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = remove_repeats(docs)
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


