"""Fill-in-middle against whole strings: outputs, restoration, and the plan's single exchange."""

import hashlib
import random
import re
from collections import Counter

import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import fill_middle  # noqa: E402
from barloom.llm.common import read  # noqa: E402

NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow(i, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    h1, h2, h3, h4 = (int(sha(f"1:{'' if i is None else i}")[k : k + 8], 16) for k in range(0, 32, 8))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return i, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def check(docs, **sizes):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = [(*slow(i, t), sha(t or "")) for i, t in rows]
    out = fill_middle.fill_in_middle(docs, **sizes).collect()
    assert Counter((r["_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored_sha256"]) for r in out) == Counter(made)
    assert all(sha(r["output"]) == r["output_sha256"] for r in out)
    want = Counter((*m[:5], sha(m[5]), m[6]) for m in made)
    assert Counter(tuple(r[c] for c in NAMES) for r in fill_middle.digest(docs).collect()) == want


def odd(spark, repeats=1):
    pick = random.Random(4)
    rows = [(None, "a text without an id"), (1, None), (2, ""), (3, "<P>"), (4, "x <S"), (5, "<<P<S<M< >>P>"), (6, "İſK é ü 漢字 😀\x00\r\n"), (7, "a" * 50_000), (8, " " * 50_000), (9, "ab " * 30_000), (11, "nested <M> mark")]
    rows += [(100 + k, "".join(pick.choice(["a", "Zz", "<", "P", "S>", "M", ">", "é", "\n", " ", "1", "漢"]) for _ in range(pick.randint(1, 60)))) for k in range(300)]
    rows += [(100, "another text of one id"), (5, "<<P<S<M< >>P>")]
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows * repeats], "doc_id long, text string, n int, form string, pos string")


def test_table(spark, sf):
    check(read(spark, sf, "documents"))


def test_odd_texts(spark):
    check(odd(spark))
    check(odd(spark), units=2, chars=3)


def test_repeated_rows(spark):
    check(odd(spark, 3).repartition(2))
    check(spark.createDataFrame([(7, "the same text")] * 500, "doc_id long, text string"))


def test_empty_table(spark, sf):
    assert fill_middle.digest(read(spark, sf, "documents").limit(0)).collect() == []


def test_shares(spark, sf):
    docs = read(spark, sf, "documents")
    assert {r["form"] for r in fill_middle.fill_in_middle(docs, plain_share=0, spm_share=100, texts=False).filter("n > 0").select("form").distinct().collect()} == {"spm"}
    assert fill_middle.fill_in_middle(docs, plain_share=100).filter("form <> 'plain'").count() == 0


def test_units_and_chunks():
    pick = random.Random(1)
    for _ in range(300):
        text = "".join(pick.choice("abZ é<>P1\n漢😀") for _ in range(pick.randint(0, 40)))
        starts = fill_middle.unit_starts(text)
        assert list(starts) == [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
        n = len(starts)
        a, b = sorted((pick.randint(0, n), pick.randint(0, n)))
        got = fill_middle.chunks(text, starts, a, b, 3, 2)
        assert "".join(got) == "".join(re.findall("[A-Za-z]+|[^A-Za-z]", text)[a:b]) and all(0 < len(p) <= 2 for p in got)


def test_restorer_reads_any_chunks():
    pick = random.Random(2)
    for _ in range(500):
        pre, mid, suf = ("".join(pick.choice("<PSM>a") for _ in range(pick.randint(0, 6))) for _ in range(3))
        if any(m in pre + mid + suf or m in pre or m in mid or m in suf for m in fill_middle.RANK):
            continue
        for form, out in (("psm", f"<P>{pre}<S>{suf}<M>{mid}"), ("spm", f"<S>{suf}<P>{pre}<M>{mid}"), ("plain", pre + mid)):
            parts, reader, at = [], fill_middle.Restorer(form), 0
            while at < len(out):
                step = pick.randint(1, 4)
                parts += reader.read(out[at : at + step])
                at += step
            parts += reader.end()
            text = "".join(t for _, t in sorted(parts, key=lambda p: p[0]))
            assert text == (pre + mid if form == "plain" else pre + mid + suf), (form, out)


def test_one_exchange(spark, sf):
    plan = fill_middle.digest(read(spark, sf, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 3
