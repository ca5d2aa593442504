"""Fingerprints against sets of shingles, neighbours against a sorted list, estimates against true containment."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

pytest.importorskip("barloom.llm")

from barloom.llm import fingerprint as fp  # noqa: E402
from barloom.llm.common import read  # noqa: E402

NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
M = (1 << 64) - 1


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def shingles(text):
    w = words(text)
    size = min(5, len(w))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()


def hashed(shingle):
    h = len(shingle)
    for w in shingle:
        h = ((h ^ xxhash.xxh64_intdigest(w.encode())) * 0x9E3779B97F4A7C15) & M
        h ^= h >> 32
        h = (h * 0xD6E8FEB86659FD93) & M
        h ^= h >> 29
    return h


def slow_print(text):
    all_ = sorted({hashed(s) for s in shingles(text)})
    kept = [h for k, h in enumerate(all_) if h < 1 << 61 or k < 16]
    return ("w" if kept == all_ else "s") + ":" + "".join(f"{h:016x}" for h in kept)


def slow_like(a, b):
    if a == b:
        return 1.0
    sets, bounds = [], []
    for f in (a, b):
        hs = [int(f[k : k + 16], 16) for k in range(2, len(f), 16)]
        sets.append(hs)
        bounds.append(1 << 64 if f[0] == "w" else max(1 << 61, hs[-1] + 1))
    x, y = ({h for h in s if h < min(bounds)} for s in sets)
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def slow(rows):
    """Distinct (id, text) in descending id, null last; texts of one id by their hash as the engine orders them."""
    distinct = sorted({(i is not None, i or 0, signed(t), t or "") for i, t in rows}, reverse=True)
    copies = Counter((i is not None, i or 0, t or "") for i, t in rows)
    out = []
    for k, (has, i, _, t) in enumerate(distinct):
        nxt = distinct[(k + 1) % len(distinct)][3]
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        a, b, c = slow_print(t), slow_print(new), slow_print(nxt)
        row = (i if has else None, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, slow_like(a, b), slow_like(a, c))
        out += [row] * copies[has, i, t]
    return out


def signed(text):
    h = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def same(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    a, b = Counter(tuple(r[c] for c in NAMES) for r in fp.digest(docs).collect()), Counter(slow(rows))
    assert a == b, (list((a - b).items())[:2], list((b - a).items())[:2])


def odd(spark, repeats=1):
    pick = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["Word", "é", "漢字", "x" * 50, "#", "it's", "\n"]
    rows = [(None, "no id here at all"), (None, "another one without"), (1, None), (2, ""), (3, "   "), (4, "a" * 9000), (5, "word " * 20_000), (-9, "İ ſ")]
    rows += [(pick.randint(0, 150), " ".join(pick.choice(vocabulary) for _ in range(pick.randint(0, 90)))) for _ in range(200)]
    return spark.createDataFrame([(i, t, "f", 2) for i, t in rows * repeats], "doc_id long, text string, fingerprint string, range int")


def test_table(spark, sf):
    same(read(spark, sf, "documents"))


def test_odd_texts(spark):
    same(odd(spark))


def test_repeated_rows(spark):
    same(odd(spark, 3).repartition(3))
    same(spark.createDataFrame([(7, "the same text again and again")] * 300, "doc_id long, text string"))


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "alone in the world")], "doc_id long, text string")
    same(one)
    assert fp.digest(one.limit(0)).collect() == []


def test_estimates(spark):
    """Against the true containment, with lengths up to a hundredfold apart."""
    pick, sketch = random.Random(8), fp.sketcher()
    errors = []
    for _ in range(200):
        large = [f"v{pick.randint(0, 5000)}" for _ in range(pick.randint(300, 4000))]
        n = pick.randint(40, 300)
        start = pick.randint(0, len(large) - n) if len(large) > n else 0
        small = large[start : start + n // 2] + [f"u{pick.randint(0, 5000)}" for _ in range(n - n // 2)]
        a, b = " ".join(large), " ".join(small)
        true = len(shingles(a) & shingles(b)) / min(len(shingles(a)), len(shingles(b)))
        errors.append(abs(fp.likeness(sketch(a)[0], sketch(b)[0]) - true))
    assert sum(errors) / len(errors) < 0.12


def test_merging():
    pick, sketch = random.Random(9), fp.sketcher()
    for _ in range(100):
        texts = [" ".join(f"w{pick.randint(0, 300)}" for _ in range(pick.randint(0, 60))) for _ in range(pick.randint(1, 5))]
        everything = sorted({hashed(s) for t in texts for s in shingles(t)})
        kept = [h for k, h in enumerate(everything) if h < 1 << 61 or k < 16]
        got = fp.merged([sketch(t)[0] for t in texts])
        assert got[2:] == "".join(f"{h:016x}" for h in kept)
        once = fp.merged([fp.merged([sketch(t)[0] for t in texts[:2]]), *[sketch(t)[0] for t in texts[2:]]])
        assert once == got


def test_every_row_of_the_general_operator(spark, sf):
    docs = read(spark, sf, "documents").selectExpr("*", "1 AS scan", "2 AS row")
    out = fp.fingerprints(docs, fraction=1 / 4, least=4).selectExpr("row.doc_id", "row.text", "scan.fingerprint", "scan.n_shingles").collect()
    assert len(out) == docs.count()
    for r in out[:50]:
        all_ = sorted({hashed(s) for s in shingles(r["text"])})
        assert r["n_shingles"] == len(all_)
        assert r["fingerprint"][2:] == "".join(f"{h:016x}" for k, h in enumerate(all_) if h < 1 << 62 or k < 4)


def test_texts_cross_one_exchange(spark, sf):
    plan = fp.digest(read(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
