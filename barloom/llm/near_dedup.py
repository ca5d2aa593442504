"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Words are the lower-cased runs of letters and digits; k-mers are five consecutive words (a shorter text is one k-mer),
each labelled with its occurrence number. A sketch is the hash of the few labelled k-mers that are smallest under one of
many hash functions, kept in text order, so two texts share a sketch when they share those k-mers in the same order.
Long texts have `LONG` sketches, short ones `SHORT` sketches of fewer k-mers, those in between both.

Texts with equal words are one content. Contents that share a sketch stand in a bucket. A pair is linked if the k-mers
that a banded alignment matches in order make up at least `similarity` of all k-mers of the two. The band follows from
the similarity: no alignment that reaches it can leave the band, so the band loses nothing.

Buckets are never expanded whole. The first round aligns every member with the one text of its bucket that meets most
others. After it a k-mer that only one component has can match nothing outside of it: a text with too few others leaves
(`reaching`), and bitmaps of the others tell most pairs that cannot be linked. In the rounds that follow each bucket
picks pivots, every member is aligned with the pivots of another component that the bitmaps leave, and pivots retire.
Members whose bucket has become one component need no further comparison. Rounds end when no bucket has two components
left to compare, so every pair of a bucket, whatever the bucket's size, is compared, connected otherwise, or impossible
by length, by `reaching` or by `could_reach`. Pairs that are aligned are few; those told apart by bitmaps can be as many
as a bucket's texts that are almost linked times its members.
At similarity 0.8 two texts share no sketch with a probability of about 3e-6 (long) and 4e-7 (short).

Null and empty texts, and texts without words, are classes of their own unless the very same row is repeated. Rows that
repeat an id are documents of their own. The class id is the smallest id in the class (null if all are null). Exactly
one row of a class is kept, equal rows included. An empty table gives an empty result. Contents are told apart by 128
bits, and by 64 of them as nodes of the link graph. Other columns are kept by `near_dedup` and never read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import WORD_BYTES, cut, row_key, stored, words_of
from barloom.llm.suffix_dedup import packed

K = 5
#: (sketches, k-mers of a sketch, fewest and most k-mers of a text)
LONG, SHORT = (32, 5, 20, 1 << 62), (16, 2, 2, 32)
PIVOTS = 16  # of a bucket in the second round, so many times more in each that follows
BITS = 2048
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(33))


def kmers(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of occurrence-labelled k-mers, in text order; distinct within a text."""
    ids = np.array([zlib.crc32(w) for w in words], dtype=np.uint64)
    n = max(1, len(ids) - K + 1)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(min(K, len(ids))):
        h = mixed(h * U(0x9E3779B97F4A7C15) + ids[i : i + n] + U(1))
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(n, dtype=bool)
    new[1:] = s[1:] != s[:-1]
    if not new.all():
        at = np.arange(n)
        count = at - np.maximum.accumulate(np.where(new, at, 0))
        label = np.empty(n, dtype=np.uint64)
        label[order] = count.astype(np.uint64)
        h = mixed(h + label * U(0xC2B2AE3D27D4EB4F))
    return h


def sketches(h: np.ndarray, family: tuple[int, int, int, int], salt: int) -> np.ndarray:
    """The sketches of one family, empty if the text is outside its lengths; a matrix of at most some 32 MB at a time."""
    number, few, least, most = family
    if not least <= len(h) <= most:
        return np.empty(0, dtype=np.uint64)
    seeds = mixed(np.arange(salt + 1, salt + number + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    out = np.arange(salt, salt + number, dtype=np.uint64)
    step = max(1, (4 << 20) // len(h))
    for a in range(0, number, step):
        v = mixed(h[None, :] ^ seeds[a : a + step, None])
        chosen = np.argpartition(v, few - 1, axis=1)[:, :few] if few < len(h) else np.broadcast_to(np.arange(len(h)), v.shape)
        x = out[a : a + step]
        for k in np.sort(chosen, axis=1).T:  # in text order
            x = mixed(x * U(0xC4CEB9FE1A85EC53) + h[k])
        out[a : a + step] = x
    return out


def bitmap(h: np.ndarray) -> list[int]:
    """The places of all k-mers among `BITS` bits, as longs."""
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(h >> U(65 - BITS.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def could_reach(similarity: float, free: str = "n", pfree: str = "pn") -> Column:
    """Whether (n, bits) and (pn, pbits) can be linked, by bitmaps of `free` and `pfree` k-mers that others may share. Each
    bit that one text has alone stands for a k-mer the other lacks, and a linked text has no more of these than its free
    k-mers beyond the least number to match: no link is lost."""
    least = F.ceil(F.lit(similarity) * (F.col("n") + F.col("pn")) / F.lit(1 + similarity) - F.lit(1e-9))

    def alone(a: str, b: str) -> Column:
        return sum((F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(BITS // 64)), F.lit(0))

    return (alone("bits", "pbits") <= F.col(free) - least) & (alone("pbits", "bits") <= F.col(pfree) - least)


def described(rows: DataFrame) -> DataFrame:
    """(_id, _rk, node, rest, n, sketch): content hash, number of k-mers and sketches of every row of (_id, _rk, _text)."""
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("node", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def one(text: str | None, identity: tuple) -> tuple[int, int, int, list[int]]:
        w = words_of(text)
        if not w:  # without words only the very same row is equal
            d = hashlib.blake2b(repr(identity).encode(), digest_size=16, person=b"no words").digest()
            return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), 0, []
        d = hashlib.blake2b(b" ".join(w), digest_size=16).digest()
        h = kmers(w)
        keys = np.concatenate([sketches(h, LONG, 0), sketches(h, SHORT, 1000)]).view(np.int64).tolist()
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), len(h), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, rks, texts = (c.to_pylist() for c in batch.columns)
                with np.errstate(over="ignore"):
                    done = [one(t, (i, r)) for i, r, t in zip(ids, rks, texts, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> float:
    """Share of all labelled k-mers that a banded in-order alignment matches; 0 if it cannot reach the similarity."""
    n1, n2 = len(a), len(b)
    least = int(np.ceil(similarity * (n1 + n2) / (1 + similarity) - 1e-9))
    if min(n1, n2) < least:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # a matched pair is displaced by unmatched k-mers only, and of those there are at most max(n1, n2) - least
    near = np.abs(i - j) <= max(n1, n2) - least
    i, j = i[near], j[near]
    if len(i) < least:
        return 0.0
    j = j[np.argsort(i)]
    m = len(j)
    if not (np.diff(j) > 0).all():  # longest increasing run of places: the alignment of distinct symbols
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        m = len(tails)
    return m / (n1 + n2 - m)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The linked pairs (a, b) of candidate pairs; texts (node, z) may repeat a node."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        size = 0

        def of(node: int, z: bytes) -> np.ndarray:
            nonlocal size
            h = known.get(node)
            if h is None:
                if size > 4_000_000:
                    known.clear()
                    size = 0
                h = known[node] = kmers(zlib.decompress(z).translate(WORD_BYTES).split())
                size += len(h)
            return h

        with np.errstate(over="ignore"):
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    a, b, za, zb = (c.to_pylist() for c in batch.columns)
                    ok = [aligned(of(x, p), of(y, q), similarity) >= similarity for x, y, p, q in zip(a, b, za, zb, strict=True)]
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of the links (a, b): the smallest node connected to it.

    A step takes the smallest label of the neighbours and then the label's own label, so paths shrink by doubling. Two
    steps are stored at a time; labels only fall, so an equal sum means that nothing changed.
    """
    sides = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())

    def step(labels: DataFrame) -> DataFrame:
        heard = sides.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        told = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.least("comp", "m").alias("comp"))
        up = told.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        return told.join(up, "comp", "left").select("node", F.coalesce(F.least("comp", "top"), "comp").alias("comp"))

    labels = sides.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
    before = None
    while True:
        labels = cut(step(step(labels)))
        total = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total


def with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def unsettled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets that hold two components or more, with their component."""
    placed = with_component(members, labels)
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
    return placed.join(open_.filter("c1 < c2").select("bucket"), "bucket")


def ranked(members: DataFrame) -> DataFrame:
    """Members with their place in the bucket, stored. The text that meets most others comes first: the original of many
    copies shares more sketches with them than they share with each other, so one round connects its copies."""
    return cut(members.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("deg"), "node"))))


def shingled(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, comp, h): a row for every k-mer of the nodes (node, comp)."""
    both = nodes.join(texts.groupBy("node").agg(F.first("z").alias("z")), "node").select("node", "comp", "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    batch = whole.slice(at, 64)
                    hs = [kmers(zlib.decompress(z).translate(WORD_BYTES).split()) for z in batch.column(2).to_pylist()]
                    owner = pa.array(np.repeat(np.arange(len(hs)), [len(h) for h in hs]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(np.concatenate(hs).view(np.int64))], names=["node", "comp", "h"])

    return both.mapInArrow(run, "node long, comp long, h long")


def bitmaps(lists: DataFrame) -> DataFrame:
    """(node, free, bits) of (node, hs): number and bitmap of the k-mers hs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = [np.array(x, dtype=np.int64).view(np.uint64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in hs], pa.int32()), pa.array([bitmap(h) for h in hs], pa.list_(pa.int64()))], names=["node", "free", "bits"])

    return lists.mapInArrow(run, "node long, free int, bits array<long>")


def reaching(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The members (bucket, node, n, deg, comp) that may be linked with a text of another component, with free and bits.

    free is the number of a text's k-mers that some other component has too; only these can match outside, now and after
    components have joined. A text needs `least` matches with the shortest text that its length allows.
    """
    nodes = members.select("node", "comp").distinct()
    rows = stored(shingled(nodes, texts))
    common = rows.groupBy("h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("h")
    known = bitmaps(rows.join(common, "h").groupBy("node").agg(F.collect_list("h").alias("hs")))
    least = F.ceil(F.lit(similarity) * (F.col("n") + F.ceil(F.lit(similarity) * F.col("n") - F.lit(1e-9))) / F.lit(1 + similarity) - F.lit(1e-9))
    return members.join(known, "node").filter(F.col("free") >= least)


def round_of(members: DataFrame, similarity: float, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of one round over unsettled members (bucket, node, n, deg, comp, r, and free and bits after the
    first round), and the members but the pivots."""
    told = "bits" in members.columns
    heads = members.filter(F.col("r") <= pivots).select("bucket", *[F.col(c).alias(f"p{c}") for c in members.columns if c not in ("bucket", "deg")])
    met = members.join(heads, "bucket").filter("r > pr and comp <> pcomp")
    fits = F.least("n", "pn") >= F.lit(similarity) * F.greatest("n", "pn")
    close = met.filter(fits & could_reach(similarity, "free", "pfree") if told else fits)
    pairs = close.select(F.least("node", "pnode").alias("a"), F.greatest("node", "pnode").alias("b")).distinct()
    return pairs, members.filter(F.col("r") > pivots).drop("comp", "r")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(_id, _rk, class_id, class_size, first): one row per document row; first marks the rows of the class's first document."""
    rows = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("_text"))
    facts = stored(described(rows))
    contents = stored(facts.groupBy("node", "rest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("_id", "_rk")).alias("one"), F.min("_id").alias("low"), F.count("*").alias("copies")))
    spread = contents.select("node", "n", F.explode("sketch").alias("bucket"))
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket")
    members = stored(spread.join(crowded, "bucket").select("bucket", "node", "n"))
    need = members.select("node").distinct().join(contents, "node").select("one.*", "node")
    z = packed(rows)
    texts = stored(z.join(need, z["_id"].eqNullSafe(need["_id"]) & (z["_rk"] == need["_rk"])).select("node", "z"))
    links: DataFrame | None = None
    labels: DataFrame | None = None
    pivots = 1
    mates = members.join(members.groupBy("bucket").agg(F.count("*").alias("size")), "bucket").groupBy("node").agg(F.sum("size").alias("deg"))
    members = ranked(unsettled(members.join(mates, "node"), None))
    while True:
        pairs, rest = round_of(members, similarity, pivots)
        found = cut(verified(pairs, texts, similarity))
        links = found if links is None else links.unionByName(found)
        labels = components(links) if pivots == 1 or not found.isEmpty() else labels
        left = unsettled(rest, labels)
        if pivots == 1:
            left = unsettled(reaching(cut(left), texts, similarity).drop("comp"), labels)
        members = ranked(left)
        if members.isEmpty():
            break
        pivots *= PIVOTS
    comp = with_component(contents.select("node", "rest", "one", "low", "copies"), labels)
    per_class = comp.groupBy("comp").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"), F.min("one").alias("head"))
    named = comp.join(per_class, "comp").select("node", "rest", "class_id", "class_size", "head")
    out = facts.select("_id", "_rk", "node", "rest").join(named, ["node", "rest"])
    first = F.col("_id").eqNullSafe(F.col("head._id")) & (F.col("_rk") == F.col("head._rk"))
    return out.select("_id", "_rk", "class_id", "class_size", first.alias("first"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """One document of each class, with its own columns."""
    heads = classes(docs, id_col, text_col, similarity).filter("first").select("_id", "_rk").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(docs, id_col, text_col))
    kept = rows.alias("r").join(heads.alias("h"), F.col("r._id").eqNullSafe(F.col("h._id")) & (F.col("r._rk") == F.col("h._rk")), "left_semi")
    return kept.groupBy("_id", "_rk").agg(F.first("row").alias("row")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the class), class_size, kept (one row of each class)."""
    out = classes(docs)
    again = F.row_number().over(Window.partitionBy("_id", "_rk").orderBy("class_id"))
    return out.withColumn("again", again).select(F.col("_id").alias("doc_id"), "class_id", F.col("class_size").cast("long").alias("class_size"), (F.col("first") & (F.col("again") == 1)).alias("kept"))
