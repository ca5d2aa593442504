"""Every operator's query against a slow, independent version over whole tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import language_id, license_scan, packing, pii_crf, secret_scan, suffix_dedup  # noqa: E402
from barloom.llm.common import read  # noqa: E402
from barloom.llm.queries import QUERIES  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


EDGES = [
    (1, None, "en", 7, "x"),
    (2, "", "en", 7, "x"),
    (3, "   \n\t", None, 7, "x"),
    (4, "1234 5678 !!", "de", 7, "x"),
    (5, "a" * 5000, "en", 7, "x"),
    (6, "The same words again and again. " * 40, "en", 7, "x"),
    (6, "The same words again and again. " * 40, "en", 7, "x"),
    (7, "All rights reserved. cc by cc by\nGeneral Public License", None, 7, "x"),
    (8, "mail a@b.com@c.org a.b@c 1.2.3.4.5.6.7.8 4111-1111-1111-1111 +1 (017) 555-7713 +12", "en", 7, "x"),
    (9, 'Token = "abcdef123" api-key: zz PASSWORD:hunter22 ' + "AKIA" + "A" * 16 + " " + "0f" * 12, "en", 7, "x"),
    (10, "é ü 漢字 ſecret=abcdefgh \x1c x\x85y\xa0z ÀB it's <|endoftext|> İx", "fr", 7, "x"),
    (11, "word " * 60000, "en", 7, "x"),
    (None, "a text without an id that is long enough to be seen " * 6, "en", 7, "x"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string, lang string, n_words int, row string")


@pytest.fixture(scope="module", params=["table", "edges", "empty"])
def docs(request, spark, sf, edges):
    if request.param == "table":
        return read(spark, sf, "documents")
    return edges if request.param == "edges" else edges.limit(0)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def same(got, want, columns):
    a = Counter(tuple(r[c] for c in columns) for r in got.collect())
    b = Counter(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


def test_suffix_dedup(docs):
    size = 200
    data = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    seen = Counter(b[p : p + size] for _, b in data for p in range(len(b) - size + 1))
    want = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = b"\x01" * size
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), sha(kept)))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(suffix_dedup.digest(docs), want, names)
    hot = suffix_dedup.remove_repeats(docs, group=1)  # every group with two kinds takes the counted way
    same(hot.selectExpr("_id doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) kept_sha256"), want, names)


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.digest(docs).collect()
    want = Counter()
    for i, t in rows_of(docs):
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    for (i, ids), n in want.items():
        mine = [r for r in got if r["doc_id"] == i and r["doc_tokens"] == len(ids)]
        assert sum(r["length"] for r in mine) == n * len(ids), (i, len(ids))
        for r in mine:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == r["ids_crc32"]
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0) and r["length"] > 0
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 for n in filled.values()) and sum(n < 2048 for n in filled.values()) <= 1


def test_license_base(docs):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    want = []
    for i, t in rows_of(docs):
        w = WORD.findall(low(t))
        at = [(k, label) for k in range(len(w)) for p, label in phrases.items() if tuple(w[k : k + len(p)]) == p]
        want.append((i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan.digest(docs)
    same(got, want, ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def listed(found, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_personal_data_base(docs):
    kinds = ("email", "ip", "card", "phone")
    want = []
    for i, t in rows_of(docs):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t[:20000])]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        want.append((i, *[sum(k == x for _, x, _ in found) for k in range(4)], sha(listed(found, kinds))))
    same(pii_crf.digest(docs), want, ("doc_id", *[f"n_{k}" for k in kinds], "base_sha256"))


def test_secrets_base(docs):
    kinds = ("assign", "access", "hex")
    assign = re.compile("".join(["((?:", "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")), r"))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"]))
    want = []
    for i, t in rows_of(docs):
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.append((i, *[sum(k == x for _, x, _ in found) for k in range(3)], sha(listed(found, kinds))))
    same(secret_scan.digest(docs), want, ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256"))


def test_language(docs):
    got = language_id.digest(docs).collect()
    truth = {(r["doc_id"], r["text"]): r["lang"] for r in docs.collect()}
    learned = {la for (i, _), la in truth.items() if la and zlib.crc32(str(i).encode() if i is not None else b"") % 3 != 1}
    texts = {i: t for i, t in truth}
    for r in got:
        i = r["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i).encode() if i is not None else b"") % 3 == 1)
        letters = any(c.isalpha() for c in texts[i] or "")
        assert (r["lang_pred"] in learned) if letters else (r["lang_pred"] == "und" and r["score"] == 0)
        assert 0 <= r["score"] <= 1
    assert len(got) == docs.count()


def test_language_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in language_id.digest(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.01 * len(held)


def benchmark_rows(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, docs, sf):
    from barloom.llm import decontamination

    items = [(r["item_id"], r["text"]) for r in read(spark, sf, "benchmark").collect()]
    items += [(900, None), (901, "word"), (901, "same words again"), (902, "rights reserved"), (902, "!!"), (None, "word"), (903, EDGES[5][1][:150])]
    indexed = {}
    for item, text in items:
        w = WORD.findall(low(text))
        if w and item is not None:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                indexed.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(str(item))
    want = []
    for i, t in rows_of(docs):
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n, some in indexed.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in some:
                    hit.update(range(k, k + n))
                    found |= some[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = decontamination.digest(docs, benchmark_rows(spark, items))
    same(got, want, ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    clean = decontamination.decontaminate(docs, benchmark_rows(spark, items))
    assert clean.columns == docs.columns and clean.count() == sum(not x[-1] for x in want)
    none = decontamination.digest(docs, benchmark_rows(spark, items).limit(0))
    assert none.filter("contaminated or n_hit > 0").count() == 0 and none.count() == len(want)


def test_benchmark_rows_without_an_id_contaminate(spark):
    from barloom.llm import decontamination

    docs = spark.createDataFrame([(1, "what is the capital of France"), (2, "nothing to see")], "doc_id long, text string")
    items = benchmark_rows(spark, [(None, "the capital of France"), (5, "something else")])
    same(decontamination.digest(docs, items), [(1, 4, 0, sha(""), True), (2, 0, 0, sha(""), False)], ("doc_id", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert [r["doc_id"] for r in decontamination.decontaminate(docs, items).collect()] == [2]


def test_lines(docs):
    from barloom.llm import line_dedup

    blanks = " \t\n\x0b\x0c\r"
    data = rows_of(docs)
    held = {}
    for i, t in data:
        for line in (t or "").split("\n"):
            key = low(line.strip(blanks))
            if len(key) >= 40:
                held.setdefault(key, set()).add(i)
    hot = {k: max((x for x in ids if x is not None), default=None) for k, ids in held.items() if len(ids) >= 5}
    want = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (low(x.strip(blanks)) in hot and hot[low(x.strip(blanks))] != i)]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    same(line_dedup.digest(docs), want, ("doc_id", "n_lines", "n_dropped", "kept_sha256"))


def test_quality(docs):
    from barloom.llm import quality_rules

    want = []
    for i, t in rows_of(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + d for k in range(len(w) - 2) if seen[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    got = quality_rules.digest(docs)
    same(got, want, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got.filter("kept and base_failed").count() == 0


def test_quality_keeps_good_documents(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    from barloom.llm import quality_rules

    judged = quality_rules.digest(docs).join(labels, "doc_id").filter("not base_failed")
    good = judged.filter("quality = 1")
    assert good.filter("kept").count() >= 0.99 * good.count()
    bad = judged.filter("quality = 0")
    assert bad.filter("kept").count() <= 0.1 * bad.count()


def test_all_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
