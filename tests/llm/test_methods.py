"""The methods themselves: curves, models, sorts, decoders, on small inputs with known answers."""

import base64
import gzip
import os
import random
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pytest

pytest.importorskip("barloom.llm")

from barloom.llm import language_id, license_scan, packing, pii_crf, secret_scan, suffix_dedup  # noqa: E402
from barloom.llm.common import read, shared_folder  # noqa: E402


def test_hilbert_steps_are_neighbours():
    bits, dims = 3, 3
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(cells, bits)
    assert sorted(key.tolist()) == list(range(2 ** (bits * dims)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_pieces():
    assert packing.pieces_of(0, 5, 4) == [(0, 4, 0, 0), (4, 1, 1, 0)]
    assert packing.pieces_of(3, 1, 4) == [(0, 1, 0, 3)] and packing.pieces_of(4, 4, 4) == [(0, 4, 1, 0)]


def test_neighbours_share_sequences(spark):
    words = {k: [f"{c}{n}" for n in range(40)] for k, c in enumerate(("alpha", "bravo", "delta", "gamma"))}
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[i % 4]) for _ in range(60))) for i in range(200)], "doc_id long, text string")
    rows = packing.pack(docs, capacity=512).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], set()).add(r["_id"] % 4)
    assert np.mean([len(v) for v in by.values()]) < 2.0  # four topics would meet at random


def test_kneser_ney_probabilities_sum_to_one():
    letters = language_id.letter_table()
    counts = {}
    for lang, text in (("a", "abracadabra abba baobab " * 3), ("b", "cede deed cabbed faced " * 3)):
        k, n = np.unique(language_id.grams(language_id.symbols(text, letters)), return_counts=True)
        counts[lang] = (k, n)
    model = language_id.kneser_ney(counts, {la: (int((n == 1).sum()), int((n == 2).sum())) for la, (_, n) in counts.items()})
    alphabet = sorted({int(x) & 0xFFFF for k, _ in counts.values() for x in k})
    for context in ("abr", "zzz", "  c", "bba"):
        high = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        keys = np.array([high | s for s in alphabet], dtype=np.uint64)
        total = np.exp(model.log_rows(keys)).sum(0)
        assert (total <= 1.0 + 1e-5).all() and (total > 0.8).all()  # the rest is for symbols never seen


def test_every_gram_of_a_small_language_is_kept(spark):
    rng = random.Random(4)
    noise = ["".join(rng.choice("abcdefghijkl") for _ in range(9)) for _ in range(3000)]
    rows = [("big", " ".join(noise[k : k + 300])) for k in range(0, 3000, 100)] + [("small", "zwei vxyz qwuz")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    letters = language_id.letter_table()
    counts = {}
    for lang in ("big", "small"):
        k, n = np.unique(np.concatenate([language_id.grams(language_id.symbols(t, letters)) for la, t in rows if la == lang]), return_counts=True)
        counts[lang] = (k, n)
    want = language_id.kneser_ney(counts, {la: (int((n == 1).sum()), int((n == 2).sum())) for la, (_, n) in counts.items()})
    keys = np.unique(np.concatenate([k for k, _ in counts.values()]))
    for most in (1 << 20, 100):  # 100 is far below what there is: batches get smaller, the model does not
        got = language_id.train(frame, most)
        assert got.langs == ["big", "small"] and np.allclose(got.log_rows(keys), want.log_rows(keys))
        assert [len(t.full.hashes) for t in got.tables] == [len(counts[la][0]) for la in got.langs]
        assert language_id.predictions(got, ["zwei qwuz vxyz"], letters)[0][0] == "small"


def test_limits_come_from_all_training_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))), "aa") for i in range(9000)] + [(9001, "xyz wvu zzy", "bb"), (9002, "xyz yyw", "bb"), (9003, "xyz", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    learned = [r[0] for r in docs.filter(~language_id.held_out(docs.doc_id) & (docs.lang == "aa")).select("text").collect()]
    assert len(learned) > 4000
    got = language_id.predictions(model, learned, language_id.letter_table())
    want = np.quantile([g[2] for g in got if g[0] == "aa"], 0.999) * 1.25
    assert model.limits[model.langs.index("aa")] == pytest.approx(want, rel=1e-9)


def test_foreign_texts_are_rejected(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    strange = ["Жил был у бабушки серенький козлик и гулял он в лесу", "xqzj kvwq zzxj qqkw vxzq jjkq wxzv qkxj " * 5, "12 34", None]
    got = language_id.predictions(model, strange, language_id.letter_table())
    assert [g[3] for g in got] == [True] * 4 and [g[0] for g in got[2:]] == ["und"] * 2


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    depth = 24
    at = np.arange(len(data) - depth)
    order = suffix_dedup.Suffixes(data, depth).sort(at, np.zeros(len(at), dtype=np.int64))
    texts = [bytes(data[p : p + depth]) for p in order]
    assert texts == sorted(bytes(data[p : p + depth]) for p in at)
    assert (order[1:] > order[:-1])[[a == b for a, b in zip(texts, texts[1:], strict=False)]].all()  # stable


def test_a_hash_collision_is_noticed(monkeypatch):
    data = np.frombuffer(b"abcdefgh" * 60 + b"abcdefgX" * 60, dtype=np.uint8)
    starts, runs, keys = np.array([0, 480]), np.array([200, 200]), np.array([1, 1])
    want = suffix_dedup.repeated_starts(data, starts, runs, keys, 64)
    monkeypatch.setattr(suffix_dedup.Rolling, "of", lambda self, start, length: np.zeros(len(start), dtype=np.uint64))
    monkeypatch.setattr(suffix_dedup.Rolling, "all", lambda self, length: np.zeros(len(self.prefix) - length, dtype=np.uint64))
    assert (suffix_dedup.repeated_starts(data, starts, runs, keys, 64) == want).all()


def test_every_template_is_found():
    index = license_scan.Index({b"": 1000, b"license": 100, b"the": 900}, 8)
    for label, text, _ in license_scan.TEMPLATES:
        got = index.scan("some words before. " + text + " and some after", 64, 2)
        assert label in got[5].split(","), label
        assert got[6] > 0.9
    plain = index.scan("the license of the work and all the rest is granted under no version", 64, 2)
    assert plain[5] == "" and plain[6] == 0
    long = index.scan("word " * 30000 + license_scan.TEMPLATES[0][1] + " word" * 30000, 64, 2)
    assert "apache-2.0" in long[5] and long[7][0]["start"] > 29000


def test_field_learns_its_table_and_leaves_text_alone():
    field = pii_crf.train()
    sentences = ["ring (031) 555-8841 now", "write to peter@backoffice today", "host 10.0.0.7:22 is up", "the year 1984 and 25 others", "just words here"]
    spans = [r[5] for r in pii_crf.scan_batch(field, sentences)]
    assert "phone_crf:5:19" in spans[0]
    assert "email_crf:9:25" in spans[1]
    assert spans[3] == spans[4] == ""
    assert pii_crf.scan_batch(field, ["a@b.com"])[0][5] == "email:0:7"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    field = pii_crf.Field()
    field.emit = rng.normal(size=field.emit.shape)
    field.step = rng.normal(size=field.step.shape)
    runs = [[[int(x) for x in rng.integers(0, pii_crf.DIMS, 3)] for _ in range(n)] for n in (1, 2, 3, 3)]
    import itertools

    for feats, got in zip(runs, field.decode(runs), strict=True):
        e = [field.emit[f].sum(0) for f in feats]

        def score(path, e=e):
            if not pii_crf.STARTS[path[0]] or any(not pii_crf.ALLOWED[a, b] for a, b in zip(path, path[1:], strict=False)):
                return -1e18
            return sum(e[i][t] for i, t in enumerate(path)) + sum(field.step[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(itertools.product(range(pii_crf.N), repeat=len(feats)), key=score)
        assert tuple(got) == best


def spans_of(text):
    return secret_scan.scan_text(text, 1 << 20)


@pytest.mark.parametrize("layers", [["url"], ["base64"], ["unicode"], ["gzip"], ["base64", "url"], ["gzip", "base64", "url"], ["url", "url"], ["base64", "base64", "base64"]])
def test_nested_secrets(layers):
    inner = "password=hunter2hunter2 and more"
    text = inner
    for name in layers:
        if name == "url":
            text = quote(text, safe="") if "%" in text or name == layers[-1] else quote(text, safe=" ")
        elif name == "base64":
            text = base64.b64encode(text.encode()).decode()
        elif name == "gzip":
            text = base64.b64encode(gzip.compress(text.encode())).decode()
        else:
            text = "".join(f"\\u{ord(c):04x}" for c in text)
    outer = "first line\nbefore " + text + " after\nlast"
    got = spans_of(outer)
    found = [s for s in got[4].split(",") if s.split(":")[0].endswith("assign")]
    assert found, got
    a, b = map(int, found[-1].split(":")[1:])
    assert outer.index(text) <= a < b <= outer.index(text) + len(text)


def test_decoding_ends():
    assert spans_of("%25" * 200)[4] == "" and spans_of("QUFB" * 5000)[4] == ""
    bomb = base64.b64encode(zlib.compress(b"0" * (64 << 20), 9)).decode()
    got = secret_scan.scan_text(bomb, 1 << 20)
    assert got[6] and got[0] == 0
    assert secret_scan.scan_text(None, 1 << 20)[4] == ""


SECRET = "password=hunter2hunter2 and more"
NOISE = random.Random(6).randbytes(2000).hex("-")


def wrap(data, width, end="\n"):
    b = base64.b64encode(data).decode()
    return end.join(b[i : i + width] for i in range(0, len(b), width))


def decoded_kinds(text, most=1 << 20):
    return {s.split(":")[0] for s in secret_scan.scan_text(text, most)[4].split(",")}


@pytest.mark.parametrize("data", [b"\x00\xff\x01 " + SECRET.encode(), ("é " + SECRET).encode("latin-1"), SECRET.encode("utf-16"), SECRET.encode("utf-16-be")])
def test_layers_of_any_bytes(data):
    for packed in (data, gzip.compress(data)):
        assert any(k.endswith("-assign") for k in decoded_kinds(base64.b64encode(packed).decode()))


def test_wrapped_base64():
    for width in (22, 64, 76):
        for pad in range(80):  # the secret stands at every place of a line
            text = "-----BEGIN CERTIFICATE-----\n" + wrap(b"x" * pad + b" " + SECRET.encode() + b" " + b"y" * 90, width) + "\n-----END"
            found = [s.split(":") for s in spans_of(text)[4].split(",") if "base64-assign" in s]
            lines = {text[int(a) : int(b)] for _, a, b in found}
            assert any(b"hunter2hunter2" in base64.b64decode(("".join(x.split()) + "===")[: len("".join(x.split())) // 4 * 4 + 4]) for x in lines) or width == 22 and found, (width, pad, found)
    for packed in (gzip.compress((NOISE + SECRET).encode()), zlib.compress((NOISE + SECRET).encode())):
        got = spans_of("data:\n  " + wrap(packed, 76, "\r\n  ") + "\n\nend")
        assert "-assign" in got[4] and not got[6]


def test_members_and_streams_cut_short():
    two = gzip.compress(b"nothing here, really") + gzip.compress(SECRET.encode())
    assert "base64+gzip-assign" in decoded_kinds(base64.b64encode(two).decode())
    short = gzip.compress((SECRET + " , " + NOISE).encode())[:-400]
    got = spans_of(base64.b64encode(short).decode())
    assert "base64+gzip-assign" in got[4] and got[6]
    assert "url-assign" in decoded_kinds("%ff%70assword=hunter2hunter2")


def test_big_layers_are_scanned_whole(spark):
    big = b"".join(b"line %d, nothing\n" % i for i in range(200000)) + SECRET.encode()
    text = "\n\n".join(base64.b64encode(gzip.compress(d)).decode() for d in (big, b"small " + SECRET.encode()))
    got = secret_scan.scan_text(text, 1 << 20)  # the first unpacks to more than three windows
    found = [s for s in got[4].split(",") if s.startswith("base64+gzip-assign:")]
    assert len(found) == 2 and not got[6]
    rows = spark.createDataFrame([(1, text), (2, base64.b64encode(gzip.compress(NOISE.encode())[:-99]).decode())], "doc_id long, text string")
    assert {r["doc_id"]: r["truncated"] for r in secret_scan.digest(rows).collect()} == {1: False, 2: True}


def test_windows_end_where_no_finding_is_open():
    data = b"".join(b"(%d) " % i + SECRET.encode() + b"; " for i in range(60))
    for size in (7, 50, 131):
        facts = {}
        got = list(secret_scan.windows((data[i : i + size] for i in range(0, len(data), size)), 400, facts))
        assert b"".join(got) == data and len(got) > 5 and not facts
        assert sum(len(secret_scan.base_spans(w.decode())) for w in got) == 60


def test_all_indexed_words_vote(spark):
    text = " . ".join(t for _, t, _ in license_scan.TEMPLATES)  # more than 64 indexed words in one file
    common = next(t for label, t, _ in license_scan.TEMPLATES if label == "cc0")  # its words are the commonest
    docs = spark.createDataFrame([(1, text)] + [(2, common)] * 50, "doc_id long, text string")
    scan = license_scan.licenses(docs, rarest=16).filter("row.doc_id = 1").select("scan.*").first()
    assert set(scan["labels"].split(",")) == {label for label, _, _ in license_scan.TEMPLATES} | set(scan["base_labels"].split(","))
    assert len(scan[7]) == len(license_scan.TEMPLATES)


def test_counting_many_languages_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK", 500)  # counts are emitted again and again, for all languages together
    rng = random.Random(8)
    rows = [(f"l{k % 60:02d}", "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 120)))) for k in range(600)]
    rows += [("l00", ""), ("l01", None), ("l02", "12 34")]
    want = Counter()
    letters = language_id.letter_table()
    for lang, text in rows:
        s = language_id.symbols(text or "", letters)
        if len(s):
            want.update((lang, int(g)) for g in language_id.grams(s).view(np.int64))
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert {(r["lang"], r["gram"]): r["n"] for r in language_id.gram_counts(frame).collect()} == dict(want)


def test_tables_of_training_are_removed(spark):
    before = set(os.listdir(shared_folder(spark)))
    docs = spark.createDataFrame([(i, "abra kadabra" if i % 2 else "xyz wvu", "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, lang string")
    assert language_id.fit(docs).langs == ["a", "b"]
    assert set(os.listdir(shared_folder(spark))) == before


def test_slices_of_a_batch_give_the_same_predictions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "abra kadabra" if i % 2 else "xyz wvu", "a" if i % 2 else "b") for i in range(60)], "doc_id long, text string, lang string")
    model, letters = language_id.fit(docs), language_id.letter_table()
    texts = ["abra " * 50, None, "", "xyz", "77", "wvu xyz " * 30]
    whole = language_id.predictions(model, texts, letters)
    monkeypatch.setattr(language_id, "SLICE", 3)
    assert language_id.predictions(model, texts, letters) == whole
