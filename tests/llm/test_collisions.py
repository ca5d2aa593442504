"""Texts made to collide under the polynomial hash lose nothing."""

import random

import numpy as np
import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import suffix_dedup as sd  # noqa: E402


def colliding():
    """Two texts of one segment each: 32 blocks, a mark in every one, and changes whose sum vanishes modulo 2 ** 64."""
    base, pick = sd.BASES[0], random.Random(3)
    pool = np.frombuffer(bytes(pick.randint(97, 122) for _ in range(300_000)), dtype=np.uint8)
    at = int(np.argmin(sd.mixed(sd.Rolling(pool, base).all(sd.GRAM))))
    mark = pool[at : at + sd.GRAM].tobytes()
    dx, dy = next((x, y) for x in range(1, 60) for y in range(1, 60) if (x + y * base) % 512 == 0)
    one, two = b"", b""
    for i in range(32):
        body = bytearray(pick.randint(97, 122) for _ in range(96))
        high = body[:8] + bytes([122, 122]) + body[10:]
        low = body[:8] + bytes([122 - dx, 122 - dy]) + body[10:]
        even = bin(i).count("1") % 2 == 0
        one += mark + bytes(high if even else low)
        two += mark + bytes(low if even else high)
    return one, two


def test_colliding_texts_are_told_apart(spark):
    one, two = colliding()
    a, b = (np.frombuffer(x, dtype=np.uint8) for x in (one, two))
    assert one != two and sd.Rolling(a, sd.BASES[0]).all(len(one)) == sd.Rolling(b, sd.BASES[0]).all(len(two))
    assert len(sd.segments(a, np.array([len(one)]), 200)[0]) == 1
    shared = {one[k : k + 200] for k in range(len(one) - 199)} & {two[k : k + 200] for k in range(len(two) - 199)}
    assert not shared
    docs = spark.createDataFrame([(1, one.decode()), (2, two.decode())], "doc_id long, text string")
    assert {(r["n_removed"], r["n_spans"]) for r in sd.digest(docs).collect()} == {(0, 0)}
    assert {r["n_removed"] for r in sd.remove_repeats(docs, group=1).collect()} == {0}
    again = spark.createDataFrame([(1, one.decode()), (2, two.decode()), (3, two.decode())], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in sd.digest(again).collect()} == {1: 0, 2: len(two), 3: len(two)}


def test_a_passage_of_many_surroundings_makes_few_rows(spark):
    """Equal strings of a hot key are found by pieces, not by a row for every byte; what is found is the same."""
    pick = random.Random(9)

    def word(n):
        return "".join(chr(pick.randint(97, 122)) for _ in range(n))

    passage = word(260)
    rows = [(k, word(pick.randint(0, 90)) + passage + word(pick.randint(0, 90))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    for _, t in rows:
        for k in range(len(t) - 199):
            seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
    want = {}
    for i, t in rows:
        gone = set()
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        want[i] = len(gone)
    found = sd.repeats(docs, group=1)[1]
    assert found.count() < 60 * 61 / 3
    assert {r["doc_id"]: r["n_removed"] for r in sd.remove_repeats(docs, group=1).withColumnRenamed("_id", "doc_id").collect()} == want
