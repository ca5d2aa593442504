"""The manifest against a tree built level by level from whole lists, on the table and on made-up groups."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

pytest.importorskip("barloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from barloom.llm import merkle  # noqa: E402
from barloom.llm.common import read  # noqa: E402

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """(root, proofs): a proof is a list of (left siblings, right siblings)."""
    proofs, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k in range(len(run)):
                for x in under[a + k]:
                    proofs[x].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(h(*run))
            above.append([x for u in under[a : a + 3] for x in u])
        nodes, under = up, above
    return nodes[0], proofs


def slow(rows):
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    out, roots, kept = [], [], []
    for name in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(((r, leaf([r[c] for c in merkle.COLUMNS])) for r in groups[name]), key=lambda x: (first(x[0]["doc_id"]), x[1]))
        root, proofs = climb([d for _, d in mine])
        roots.append(root)
        kept.append((mine, proofs))
    if not roots:
        return []
    root, upper = climb(roots)
    for (mine, proofs), sub, more in zip(kept, roots, upper, strict=True):
        for (r, d), proof in zip(mine, proofs, strict=True):
            i, held = r["doc_id"], d
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                held = leaf([i, r["source"], r["lang"], r["n_chars"], r["text"] and r["text"].replace("\n", "")])
            for left, right in proof + more:
                held = h(left, held, right)
            out.append((i, d, sub, root, h(*[a + b for a, b in proof + more]), held, held == root))
    return out


def same(got, want):
    a, b = Counter(tuple(r[c] for c in NAMES) for r in got.collect()), Counter(want)
    assert a == b, (list((a - b).items())[:2], list((b - a).items())[:2])


def made(spark, seed, n, groups):
    pick = random.Random(seed)
    names = [None, "", "ü", "z", *[f"g{k}" for k in range(groups)]]
    rows = []
    for k in range(n):
        i = pick.choice([None, 7, k, k, k, k, k, -k])
        text = pick.choice([None, "", "a\nb\n", "漢字\n" * pick.randint(0, 9), "x" * 3000, f"text {k}"])
        rows.append((i, names[min(int(pick.expovariate(0.4)), len(names) - 1)] if groups < 50 else pick.choice(names), pick.choice([None, "en"]), pick.choice([None, k]), text, k % 3, "left"))
    rows += rows[: n // 3]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, level int, proof string")


def test_table(spark, sf):
    docs = read(spark, sf, "documents")
    same(merkle.digest(docs), slow(docs.collect()))


@pytest.mark.parametrize("n, groups, height", [(1, 1, 9), (2, 1, 1), (40, 5, 1), (700, 3, 2), (700, 3, 9), (500, 200, 1), (30, 0, 2)])
def test_made_tables(spark, monkeypatch, n, groups, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "LEAVES", 25)
    docs = made(spark, n + height, n, groups)
    same(merkle.digest(docs), slow(docs.collect()))


def test_one_group_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEAVES", 10)
    docs = spark.createDataFrame([(5, "s", "en", 3, "a\nb")] * 400, "doc_id long, source string, lang string, n_chars long, text string")
    same(merkle.digest(docs), slow(docs.collect()))


def test_empty_table(spark, sf):
    assert merkle.digest(read(spark, sf, "documents").limit(0)).collect() == []


def test_cover_and_missing_are_minimal():
    for size in range(1, 60):
        for lo in range(0, size, 3 if size > 20 else 1):
            for hi in range(lo + 1, size + 1):
                nodes = [h(str(k)) for k in range(size)]
                levels = [nodes]
                while len(levels[-1]) > 1:
                    levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
                spans = lambda level, k: set(range(k * 3**level, min((k + 1) * 3**level, size)))
                parts = list(merkle.cover(nodes[lo:hi], lo, size))
                assert all(levels[level][k] == node for level, k, node in parts)
                assert sum(len(spans(level, k)) for level, k, _ in parts) == hi - lo
                inside = set(range(lo, hi))
                assert all(level + 1 == len(levels) or not spans(level + 1, k // 3) <= inside for level, k, _ in parts)
                need = set(merkle.missing(lo, hi, size))
                want = set()
                for x in range(lo, hi):
                    for level in range(len(levels) - 1):
                        k = x // 3**level
                        run = range(k // 3 * 3, min(k // 3 * 3 + 3, len(levels[level])))
                        want |= {(level, j) for j in run if not spans(level, j) & inside}
                assert need == want


def test_proofs_stand_alone(spark, sf):
    docs = read(spark, sf, "documents")
    out = merkle.prove(docs, claim=merkle.leaf_digest([docs[c] for c in merkle.COLUMNS]))
    assert out.filter(merkle.fold(F.col("claim"), F.col("proof")) != F.col("root")).count() == 0
    assert out.filter(merkle.fold(F.sha2(F.col("claim"), 256), F.col("proof")) == F.col("root")).count() == 0
    assert {f.name for f in out.schema} == {"_id", "_group", "leaf", "claim", "subroot", "root", "proof"}
    by_lang = merkle.prove(docs, group_col="lang", columns=("doc_id", "text"))
    assert by_lang.select("root").distinct().count() == 1 and by_lang.select("_group").distinct().count() == by_lang.select("subroot").distinct().count()
