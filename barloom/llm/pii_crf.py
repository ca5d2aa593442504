"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes.

The field labels blank-separated tokens (O, begin and inside of each kind). It is trained by stochastic gradient descent
on a small labelled table of sentences and decoded by Viterbi in numpy, all runs of one batch together. A token without
a digit or `@` can only be O, in training as in decoding, so a text falls apart into short runs of other tokens that are
decoded independently and exactly. Decoded spans that touch a base span are dropped: base spans stay as they are. The
field's kinds carry the suffix `_crf`.

Null and empty texts have no span. Rows that repeat an id are scanned one by one; other columns are not read. Whole
texts are scanned. An empty labelled table gives a field that labels nothing.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import per_text

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns, written so that no start is tried twice within one run
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# the labelled table: [kind words] are spans, everything else is outside
LABELLED = (
    "call me at [phone (017) 555-7713] tomorrow",
    "phone [phone (044) 555-9120] or write to us",
    "tel. [phone +1 (487) 555-7209] rest of the line",
    "the number is [phone +49 30 1234567] for the office",
    "reach her on [phone +44 20 7946 0958] after six",
    "fax [phone 555-201-3344] and wait",
    "mobile [phone 0171-555-8812] evenings only",
    "ring [phone (212) 555-0199] please",
    "kontakt [phone +33 1 70 18 99 00] bitte",
    "telefono [phone +34 912 345 678] gracias",
    "write to [email anna.weber@example.com] today",
    "mail [email info@mail7.example.org] or call",
    "send it to [email user34@localhost] now",
    "contact [email sales@intranet] for prices",
    "reply to [email jo_ann@server] soon",
    "from [email a.b@c.example.net] to the list",
    "the host [ip 192.168.10.4] did not answer",
    "ping [ip 10.0.0.1:8080] failed again",
    "client [ip 161.17.88.162] was blocked",
    "route via [ip 8.8.4.4/24] instead",
    "pay with [card 4111 1111 1111 1111] at once",
    "card [card 5500-0000-0000-0004] expired",
    "charged to [card 378282246310005] yesterday",
    "visa [card 4012 8888 8888 1881] was used",
    "in 1998 there were 1200 of them",
    "on page 12 of volume 3 and 4",
    "version 3.0.1 was released in 2021",
    "licensed under CC BY-NC 4.0.",
    "the Apache License, Version 2.0.",
    "see section 3.2.1 for 25 examples",
    "chapter 7 begins at 10:30 and ends at 12:45",
    "born 1975-03-12 in a small town",
    "sold for 1,250,000 in 2007",
    "a total of 4736962573099581 atoms",
    "order 2390409500648960 was shipped",
    "invoice 9807915762804490 raised",
    "ratio 3:2 and 45% of 300",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" here",
    "hash 3f2a9c10bb and build 20240312",
    "meet @ noon or @home later",
    "rev 1.2 of 2019-11-02 at 5pm",
    "items 1, 2, 3 and 17",
    "from 100 to 200 of 555 cases",
    "table 4-2 and figure 10-11",
    "(1998) and (2004) are cited [ok",
    "mp3 and h2o and b2b",
)

TAGS = ("O", *[f"{p}-{k}" for k in KINDS for p in "BI"])
N = len(TAGS)
DIMS = 1 << 12
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
ACTIVE = re.compile(r"[0-9@]")
MARK = re.compile(r"\[(\w+) ([^\]]+)\]")
#: a step from row tag to column tag; I follows only B or I of its kind
ALLOWED = np.array([[b[0] != "I" or a[2:] == b[2:] for b in TAGS] for a in TAGS])
STARTS = np.array([t[0] != "I" for t in TAGS])

SCHEMA = pa.schema([*[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("spans", pa.string())])


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and non-overlapping per kind; matches that fail their test are dropped."""
    out = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                end = m.end()
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Letters and digits become x, X and 9; runs of up to four stay, longer ones end in +."""
    mapped = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in token[:64])
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", mapped.rstrip(".,;:!?"))


def features(tokens: list[str], i: int) -> list[int]:
    """Hashed shape features of token i in its context."""
    s = shape(tokens[i])
    flat = re.sub(r"(.)\1+", r"\1", s)
    before = re.sub(r"(.)\1+", r"\1", shape(tokens[i - 1])) if i else "<"
    after = re.sub(r"(.)\1+", r"\1", shape(tokens[i + 1])) if i + 1 < len(tokens) else ">"
    digits = sum(c.isdigit() for c in tokens[i])
    names = ("b", f"s={s}", f"f={flat}", f"p={before}|{flat}", f"n={flat}|{after}", f"d={min(digits, 20)}", f"a={'@' in s}{s.count('.')}{s.count('-')}{s[:1] in '(+'}")
    return [zlib.crc32(x.encode("utf-8", "replace")) % DIMS for x in names]


def labelled_runs(table: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Features and tags of each run of active tokens of the labelled texts."""
    runs = []
    for text, spans in table:
        found = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
        words = [x[0] for x in found]
        tags, held = [], None
        for _, a, b in found:
            inside = next((s for s in spans if s[0] < b and a < s[1]), None)
            tags.append("O" if inside is None else f"{'I' if inside is held else 'B'}-{inside[2]}")
            held = inside
        for a, b in active_runs(words):
            runs.append(([features(words, i) for i in range(a, b)], [TAGS.index(t) for t in tags[a:b]]))
    return runs


def active_runs(words: list[str]) -> list[tuple[int, int]]:
    on = [bool(ACTIVE.search(w)) for w in words]
    edges = [i for i in range(len(on) + 1) if (on[i] if i < len(on) else False) != (on[i - 1] if i else False)]
    return list(zip(edges[::2], edges[1::2], strict=True))


def marked(lines: tuple[str, ...] = LABELLED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    out = []
    for line in lines:
        text, spans, last = "", [], 0
        for m in MARK.finditer(line):
            text += line[last : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, last = text + m[2], m.end()
        out.append((text + line[last:], spans))
    return out


class Field:
    """Weights of the conditional random field: emissions by hashed feature, and transitions."""

    def __init__(self):
        self.emit = np.zeros((DIMS, N))
        self.step = np.zeros((N, N))

    def fit(self, runs: list[tuple[list[list[int]], list[int]]], epochs: int = 40, rate: float = 0.2, decay: float = 1e-3) -> Field:
        rng = np.random.default_rng(7)
        ban = np.where(ALLOWED, 0.0, -1e9)
        for epoch in range(epochs):
            eta = rate / (1 + 0.05 * epoch)
            for r in rng.permutation(len(runs)):
                feats, tags = runs[r]
                e = np.array([self.emit[f].sum(0) for f in feats])
                e[0] = np.where(STARTS, e[0], -1e9)
                t = self.step + ban
                n = len(tags)
                alpha, beta = np.empty((n, N)), np.zeros((n, N))
                alpha[0] = e[0]
                for i in range(1, n):
                    alpha[i] = np.logaddexp.reduce(alpha[i - 1][:, None] + t, axis=0) + e[i]
                for i in range(n - 2, -1, -1):
                    beta[i] = np.logaddexp.reduce(t + (e[i + 1] + beta[i + 1])[None, :], axis=1)
                z = np.logaddexp.reduce(alpha[-1])
                for i in range(n):
                    g = -np.exp(alpha[i] + beta[i] - z)
                    g[tags[i]] += 1
                    self.emit[feats[i]] += eta * (g - decay * self.emit[feats[i]])
                    if i:
                        pair = -np.exp(alpha[i - 1][:, None] + t + (e[i] + beta[i])[None, :] - z)
                        pair[tags[i - 1], tags[i]] += 1
                        self.step += eta * (pair - decay * self.step)
        return self

    def decode(self, runs: list[list[list[int]]]) -> list[list[int]]:
        """Best tags of every run; runs of one length are decoded together."""
        out: list[list[int]] = [[] for _ in runs]
        by_length = defaultdict(list)
        for k, feats in enumerate(runs):
            by_length[len(feats)].append(k)
        t = np.where(ALLOWED, self.step, -1e9)
        for n, ks in by_length.items():
            e = self.emit[np.array([runs[k] for k in ks])].sum(2)
            score = np.where(STARTS, e[:, 0], -1e9)
            back = np.empty((n, len(ks), N), dtype=np.int8)
            for i in range(1, n):
                moves = score[:, :, None] + t[None]
                back[i] = moves.argmax(1)
                score = moves.max(1) + e[:, i]
            best = score.argmax(1)
            tags = np.empty((n, len(ks)), dtype=np.int64)
            for i in range(n - 1, -1, -1):
                tags[i] = best
                if i:
                    best = back[i][np.arange(len(ks)), best]
            for k, column in zip(ks, tags.T.tolist(), strict=True):
                out[k] = column
        return out


def train(labelled: DataFrame | None = None, most: int = 20_000) -> Field:
    """Fit on the labelled sentences, or on a table (text, spans array<struct<start,end,kind>>) of at most `most` rows."""
    if labelled is None:
        return Field().fit(labelled_runs(marked()))
    rows = labelled.select("text", "spans").limit(most).toArrow().to_pylist()
    return Field().fit(labelled_runs([(r["text"] or "", [(s["start"], s["end"], s["kind"]) for s in r["spans"] or []]) for r in rows]))


BLANK = re.compile(r"[\x20\x09-\x0D]")


def regions(text: str) -> list[tuple[list[str], list[tuple[int, int]], int, int]]:
    """Runs of active tokens with one neighbour at each side: (tokens, offsets, first, last) of the run inside them."""
    out: list[list[tuple[int, int]]] = []
    end = 0
    while m := ACTIVE.search(text, end):
        a = m.start()
        while a > end and text[a - 1] not in " \t\n\x0b\x0c\r":
            a -= 1
        stop = BLANK.search(text, m.end())
        b = stop.start() if stop else len(text)
        if out and not text[end:a].strip(" \t\n\x0b\x0c\r"):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
        end = b
    done = []
    for run in out:
        a, b = run[0][0], run[-1][1]
        left = text[max(0, a - 80) : a].split()
        right = text[b : b + 80].split()
        tokens = [*left[-1:], *[text[s:e] for s, e in run], *right[:1]]
        done.append((tokens, run, len(left[-1:]), len(left[-1:]) + len(run)))
    return done


def scan_batch(field: Field, texts: list[str | None]) -> list[tuple]:
    runs, owner = [], []
    bases = [base_spans(t or "") for t in texts]
    for k, text in enumerate(texts):
        for tokens, offsets, a, b in regions(text or ""):
            runs.append([features(tokens, i) for i in range(a, b)])
            owner.append((k, offsets))
    extra: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for tags, (k, offsets) in zip(field.decode(runs), owner, strict=True):
        i = 0
        while i < len(tags):
            if tags[i]:
                j = i + 1
                while j < len(tags) and TAGS[tags[j]][0] == "I":
                    j += 1
                text, kind = texts[k], KINDS.index(TAGS[tags[i]][2:])
                a, b = offsets[i][0], offsets[j - 1][1]
                while b > a and text[b - 1] in ".,;:!?":
                    b -= 1
                if b > a and not any(s < b and a < e for s, _, e in bases[k]):
                    extra[k].append((a, len(KINDS) + kind, b))
                i = j
            else:
                i += 1
    names = (*KINDS, *[f"{x}_crf" for x in KINDS])
    line = lambda spans: ",".join(f"{names[kind]}:{s}:{e}" for s, kind, e in sorted(spans))
    return [(*[sum(1 for x in base if x[1] == i) for i in range(len(KINDS))], line(base), line(base + more)) for base, more in zip(bases, extra, strict=True)]


def personal_data(docs: DataFrame, text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """(row, scan): counts of the base kinds, base and all spans as kind:start:end."""
    field = train(labelled)
    return per_text(docs, text_col, SCHEMA, lambda: lambda texts: scan_batch(field, texts))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = personal_data(docs.select("doc_id", "text"))
    return out.select("row.doc_id", *[f"scan.n_{k}" for k in KINDS], F.sha2("scan.base", 256).alias("base_sha256"), "scan.spans")
