"""Near duplicates against all pairs of a small table, hot groups, and the banded alignment against a full one."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import near_dedup as nd  # noqa: E402
from barloom.llm.common import read, words_of  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    seen, out = Counter(), []
    for k in range(max(1, len(w) - 4)) if w else ():
        s = tuple(w[k : k + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def common_in_order(a, b):
    place = {x: k for k, x in enumerate(b)}
    row = [0] * (len(b) + 1)
    for x in a:
        j = place.get(x)
        if j is not None:
            new = max(row[: j + 1]) + 1
            row[j + 1] = max(row[j + 1], new)
    return max(row)


def brute_classes(rows, least=0.8):
    """Index of the class of each row."""
    data = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = data[i], data[j]
            if not a or not b:
                if rows[i] == rows[j]:
                    top[find(i)] = find(j)
                continue
            if a == b:
                top[find(i)] = find(j)
                continue
            both = len(set(a) & set(b))
            if both / (len(a) + len(b) - both) < least:
                continue
            m = common_in_order(a, b)
            if m / (len(a) + len(b) - m) >= least:
                top[find(i)] = find(j)
    return [find(k) for k in range(len(rows))]


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    root = brute_classes(rows)
    ids = {}
    for (i, _), c in zip(rows, root, strict=True):
        ids.setdefault(c, []).append(i)
    want = Counter((i, min((x for x in ids[c] if x is not None), default=None), len(ids[c])) for (i, _), c in zip(rows, root, strict=True))
    out = nd.digest(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(ids)
    kept = nd.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(ids)


def test_table(spark, sf):
    check(read(spark, sf, "documents"))


def test_edges(spark):
    rng = random.Random(3)
    vocab = ["w%d" % k for k in range(3000)]
    base = [rng.choice(vocab) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, "!!"), (3, "!!"), (4, "one"), (5, "one"), (6, "one two three four"), (7, "ONE two, three four"), (None, " ".join(base)), (8, " ".join(base)), (8, " ".join(base))]
    passage = [rng.choice(vocab) for _ in range(50)]
    for k in range(60):  # texts that share a long passage only
        rows.append((100 + k, " ".join([rng.choice(vocab) for _ in range(30)] + passage + [rng.choice(vocab) for _ in range(20)])))
    for k in range(150):  # a hot group of different near copies
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 + k, " ".join(w)))
    chain = list(base[:120])  # each copy is near the one before it only
    for k in range(12):
        chain = list(chain)
        for at in range(k * 9, k * 9 + 2):
            chain[at % 120] = rng.choice(vocab)
        rows.append((2000 + k, " ".join(chain)))
    short = [rng.choice(vocab) for _ in range(12)]
    rows += [(3000, " ".join(short)), (3001, " ".join(short + ["extra"])), (3002, " ".join(short[1:]))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, bucket int")
    check(docs)
    empty = docs.limit(0)
    assert nd.digest(empty).count() == 0 and nd.near_dedup(empty).count() == 0


def test_alignment():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 40)
        a = [rng.randrange(10_000) for _ in range(n)]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.randrange(10_000))
        if rng.random() < 0.3:
            rng.shuffle(b)
        a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
        if not b:
            continue
        m = common_in_order(a, b)
        true = m / (len(a) + len(b) - m)
        got = nd.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 0.8)
        assert (got >= 0.8) == (true >= 0.8 - 1e-12)
        if true >= 0.8:
            assert abs(got - true) < 1e-12


def test_sketches_of_repeated_words():
    h = nd.kmers(words_of("same " * 50))
    assert len(set(h.tolist())) == 46


def test_a_pair_of_one_sketch_is_linked_in_a_bucket_of_any_size(spark, monkeypatch):
    """Two texts share one sketch with hundreds of others that are unlike them, and no other sketch."""
    rng = random.Random(77)

    def one(sizes):
        pair = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows = [" ".join(pair), " ".join([*pair[:58], "x", "y"])] + [" ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) for _ in range(sizes)]
        return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")

    from pyspark.sql import functions as F

    found = nd.described

    def few(rows):
        # sketches of its own for every text, and one for all
        return found(rows).withColumn("sketch", F.array(F.lit(5).cast("long"), F.col("node")))

    monkeypatch.setattr(nd, "described", few)
    for size in (3, 300):
        got = {r.doc_id: r.class_id for r in nd.digest(one(size)).collect()}
        assert got == {i: max(0, i - (i == 1)) for i in range(size + 2)}


def test_could_reach_loses_no_link(spark):
    rng = np.random.default_rng(5)
    rows, linked = [], []
    for n in (3, 20, 60, 300, 900):
        for share in (0, 1, 2, 5, 9, 11, 13, 20, 50):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            k = n * share // 100
            b[rng.choice(n, k, replace=False)] = rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2)
            rows.append((len(rows), n, nd.bitmap(a * np.uint64(2)), n, nd.bitmap(b * np.uint64(2))))
            linked.append(nd.aligned(a, b, 0.8) >= 0.8)
    df = spark.createDataFrame(rows, "i int, n int, bits array<long>, pn int, pbits array<long>")
    could = [r.c for r in df.select("i", nd.could_reach(0.8).alias("c")).orderBy("i").collect()]
    assert all(c for c, l in zip(could, linked, strict=True) if l) and not all(could)


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    """Many near copies of one text, of which some are just beyond the similarity: the aligned pairs do not grow with the square."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(900):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [f"x{rng.randrange(10**9)}"]))
        rows.append((k, " ".join(w)))
    made, verified = [], nd.verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(nd, "verified", counted)
    got = {r.doc_id: r.class_id for r in nd.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    with np.errstate(over="ignore"):
        hs = [nd.kmers(words_of(t)) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if top[i] != top[j] and nd.aligned(hs[i], hs[j], 0.8) >= 0.8:
                low, high = sorted((top[i], top[j]))
                top = [low if t == high else t for t in top]
    assert got == dict(enumerate(top)) and len(set(top)) > 20
    assert sum(made[1:]) < len(rows) / 3, made
