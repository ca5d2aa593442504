"""Language identification with interpolated Kneser-Ney character models.

A text becomes lower-case letters with every run of other characters as one blank. For each language the 4-grams of all
labelled training texts are counted on the cluster; lower orders follow from all of them as continuation counts. The
driver turns the counts of one language after the other into interpolated probabilities and stores them in arrays sorted
by hash, one for each order. No gram is dropped: the model grows with the distinct 4-grams of the languages (12 bytes
each, and the shorter orders). A text is scored by one look-up for each of its distinct 4-grams and each language, by
shorter orders where the language never had the 4-gram. The language of the lowest cross-entropy per character wins. A
text is rejected when that cross-entropy lies `slack` above the `quantile` of what all training texts of that language
have themselves.

Null texts and texts without a letter are `und`, rejected, score 0; so is everything if there is no labelled text to
learn from. Rows without a language are predicted and not learned from. Rows that repeat an id are learned from and
predicted one by one; a null id counts as the empty text. Equal cross-entropies go to the language that sorts first.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import briefly_stored, per_text, text_of

BLANK = 32
ORDER = 4
MASK = np.uint64(0xFFFF)
BLOCK = 1 << 20
SLICE = 1 << 21  # values (symbols times languages) that are looked up at once
BINS = 4096  # of cross-entropy, per nat
SCHEMA = pa.schema([("lang", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def letter_table() -> np.ndarray:
    """Which code points are letters or combining marks; all beyond the supplementary planes listed count as letters."""
    import unicodedata

    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x20000)] + [True])


def symbols(text: str, letters: np.ndarray) -> np.ndarray:
    """16-bit letters, one blank for each run of other characters, none at the start, one at the end."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = letters[np.minimum(a, len(letters) - 1)]
    if not keep.any():
        return np.empty(0, dtype=np.uint64)
    a = np.where(keep, a & 0xFFFF, BLANK)
    first = keep.copy()
    first[1:] |= keep[:-1]
    a = a[first].astype(np.uint64)
    return a if a[-1] == BLANK else np.append(a, np.uint64(BLANK))


def grams(s: np.ndarray) -> np.ndarray:
    """One 64-bit 4-gram for each symbol, blanks before the first."""
    p = np.concatenate([np.full(ORDER - 1, BLANK, dtype=np.uint64), s])
    n = len(s)
    return (p[:n] << np.uint64(48)) | (p[1 : n + 1] << np.uint64(32)) | (p[2 : n + 2] << np.uint64(16)) | p[3 : n + 3]


def hashed(keys: np.ndarray) -> np.ndarray:
    """A bijective mix, so equal hashes are equal grams."""
    with np.errstate(over="ignore"):
        x = keys ^ (keys >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); counted in every task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting = summed = 0  # over all languages, so that memory does not grow with their number

        def fold() -> int:
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    old, m = sums[lang]
                    keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([m, n]).astype(float)).astype(np.int64)
                sums[lang] = keys, n
            held.clear()
            return sum(len(keys) for keys, _ in sums.values())

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                s = symbols(text.as_py() or "", letters)
                if len(s):
                    held[lang.as_py()].append(grams(s))
                    waiting += len(s)
                    if waiting >= BLOCK:
                        summed, waiting = fold(), 0
                        if summed >= BLOCK:
                            yield from emit()
        fold()
        yield from emit()

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class SortedHashes:
    """Grams sorted by hash with one value each; the last value is for grams that are not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        h = hashed(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], np.append(values[order], values.dtype.type(missing))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each gram, len(self.hashes) if it is not there."""
        h = hashed(keys)
        at = np.searchsorted(self.hashes, h)
        if len(self.hashes):
            at[self.hashes[np.minimum(at, len(self.hashes) - 1)] != h] = len(self.hashes)
        return at


def discount(n1: float, n2: float) -> float:
    """Kneser-Ney's n1 / (n1 + 2 n2), kept inside (0, 1)."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


@dataclass
class Tables:
    """One language: log-probabilities of its 4-grams and its back-off tables, no row for what it never had."""

    full: SortedHashes
    shorter: list[SortedHashes]  # probabilities of 3-, 2- and 1-grams
    weights: list[SortedHashes]  # back-off weights of 3-, 2- and 1-gram contexts

    def log_values(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each 4-gram's last symbol."""
        at = self.full.find(keys)
        out = self.full.values[at]
        unseen = np.flatnonzero(at == len(self.full.hashes))
        if len(unseen):
            out[unseen] = np.log(self.backed_off(keys[unseen])).astype(np.float32)
        return out

    def backed_off(self, keys: np.ndarray) -> np.ndarray:
        p = None
        for k in (2, 1, 0):  # 1-grams first, then 2- and 3-grams
            tail = keys & np.uint64((1 << 16 * (3 - k)) - 1)
            own = self.shorter[k]
            at = own.find(tail)
            here = own.values[at]
            if p is not None:
                w = self.weights[k + 1]
                here = np.where(at < len(own.hashes), here, w.values[w.find(tail >> np.uint64(16))] * p)
            p = here
        context = (keys >> np.uint64(16)) & np.uint64((1 << 48) - 1)
        return self.weights[0].values[self.weights[0].find(context)] * p


@dataclass
class Model:
    """The tables of every language and its rejection limit."""

    langs: list[str]
    tables: list[Tables]
    limits: np.ndarray
    sent: Broadcast | None = None  # langs and tables, without the limits

    def share(self, sc: SparkContext) -> Broadcast:
        """The tables, broadcast once for calibration and prediction; the limits travel with the tasks."""
        if self.sent is None:
            self.sent = sc.broadcast((self.langs, self.tables))
        return self.sent

    def log_rows(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each 4-gram's last symbol, in every language; each distinct gram is looked up once."""
        kinds, at = np.unique(keys, return_inverse=True)
        out = np.empty((len(kinds), len(self.langs)), dtype=np.float32)
        for c, t in enumerate(self.tables):
            out[:, c] = t.log_values(kinds)
        return out[at]

    def cross_entropies(self, texts: list[np.ndarray]) -> np.ndarray:
        """Mean negative log-probability of each (non-empty) symbol array, in every language."""
        out = np.empty((len(texts), len(self.langs)))
        room = max(1 << 14, SLICE // max(1, len(self.langs)))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= room):
                size += len(texts[j])
                j += 1
            if j == i + 1:
                g = grams(texts[i])
                out[i] = -sum(self.log_rows(g[a : a + room]).sum(0, dtype=float) for a in range(0, len(g), room)) / len(g)
            else:
                n = np.array([len(t) for t in texts[i:j]])
                rows = self.log_rows(np.concatenate([grams(t) for t in texts[i:j]]))
                out[i:j] = -np.add.reduceat(rows, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0, dtype=float) / n[:, None]
            i = j
        return out


def language_tables(grams4: np.ndarray, n: np.ndarray, ones_twos: tuple[int, int], alphabet: int) -> Tables:
    """Interpolated probabilities of one language from all its 4-grams (distinct) and their counts."""
    # by order 4, 3, 2, 1: grams and their counts; continuation counts below the top
    levels = [(grams4, n)]
    for width in (48, 32, 16):
        levels.append(np.unique(levels[-1][0] & np.uint64((1 << width) - 1), return_counts=True))
    below: SortedHashes | None = None
    shorter: list[SortedHashes] = []
    weights: list[SortedHashes] = []
    for depth in (3, 2, 1, 0):
        keys, count = levels[depth]
        order, count = ORDER - depth, count.astype(float)
        d = discount(*(ones_twos if depth == 0 else (float((count == 1).sum()), float((count == 2).sum()))))
        contexts, at = np.unique(keys >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(at, weights=count), np.bincount(at)
        share, back = np.maximum(count - d, 0) / total[at], d * kinds / total
        if order == 1:
            below = SortedHashes(keys, share + back[at] / alphabet, back[0] / alphabet)
            shorter.insert(0, below)
            continue
        p = share + back[at] * below.values[below.find(keys & np.uint64((1 << 16 * (order - 1)) - 1))]
        weights.insert(0, SortedHashes(contexts, back, 1.0))
        if order == ORDER:
            return Tables(SortedHashes(keys, np.log(p).astype(np.float32), 0.0), shorter, weights)
        below = SortedHashes(keys, p, np.nan)
        shorter.insert(0, below)
    raise AssertionError


def kneser_ney(counts: dict[str, tuple[np.ndarray, np.ndarray]], ones_twos: dict[str, tuple[int, int]]) -> Model:
    """The model from 4-gram counts: lang -> (grams, counts), and how many counts are 1 and 2."""
    langs = sorted(counts)
    alphabet = 1 + len(np.unique(np.concatenate([k & MASK for k, _ in counts.values()])))
    return Model(langs, [language_tables(*counts[la], ones_twos[la], alphabet) for la in langs], np.full(len(langs), np.inf))


def train(rows: DataFrame, at_once: int = 8 << 20) -> Model | None:
    """Count rows of (lang, text) on the cluster and build every language's tables from all its counts.

    at_once: counts that come to the driver in one job, which takes whole languages. It bounds what building needs
    besides the tables, not the tables.
    """
    with briefly_stored(gram_counts(rows.filter(F.col("lang").isNotNull()))) as counts:
        facts = counts.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2")).toArrow().to_pylist()
        if not facts:
            return None
        facts.sort(key=lambda r: r["lang"])
        langs = [r["lang"] for r in facts]
        alphabet = 1 + counts.select(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("s")).distinct().count()
        tables: list[Tables] = []
        while len(tables) < len(langs):
            a = b = len(tables)
            size = 0
            while b < len(langs) and (b == a or size + facts[b]["kinds"] <= at_once):
                size += facts[b]["kinds"]
                b += 1
            names = F.array(*[F.lit(la) for la in langs[a:b]])
            code = (F.array_position(names, F.col("lang")) - 1).cast("short")
            got = counts.select(code.alias("code"), "gram", "n").filter("code >= 0").toArrow()
            code, gram, n = (got[x].to_numpy() for x in ("code", "gram", "n"))
            for k, r in enumerate(facts[a:b]):
                pick = code == k
                tables.append(language_tables(gram[pick].view(np.uint64), n[pick], (r["n1"], r["n2"]), alphabet))
    return Model(langs, tables, np.full(len(langs), np.inf))


def predictions(model: Model | None, texts: list[str | None], letters: np.ndarray) -> list[tuple]:
    """(language, score, cross-entropy, rejected) of each text."""
    out: list[tuple] = [("und", 0.0, None, True)] * len(texts)
    if model is None:
        return out
    a = 0
    while a < len(texts):  # slices of bounded length, however large the batch is
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") <= SLICE):
            size += len(texts[b] or "")
            b += 1
        arrays = [symbols(t or "", letters) for t in texts[a:b]]
        known = [k for k, s in enumerate(arrays) if len(s) and any(c.isalpha() for c in texts[a + k])]
        if known:
            ce = model.cross_entropies([arrays[k] for k in known])
            best = ce.argmin(1)
            low = ce[np.arange(len(known)), best]
            certain = 1 / np.exp((low[:, None] - ce) * np.minimum(np.array([len(arrays[k]) for k in known]), 40)[:, None]).sum(1)
            for k, g, h, c in zip(known, best, low, certain, strict=True):
                out[a + k] = (model.langs[g], float(c), float(h), bool(h > model.limits[g]))
        a = b
    return out


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """(row, scan): scan has lang, score, cross_entropy and rejected. The model is broadcast."""
    shared, limits = (None, None) if model is None else (model.share(docs.sparkSession.sparkContext), model.limits.copy())

    def make():
        letters = letter_table()
        own = None if shared is None else Model(*shared.value, limits)
        return lambda texts: predictions(own, texts, letters)

    return per_text(docs, text_col, SCHEMA, make)


def calibrated(model: Model | None, labelled: DataFrame, text_col: str, lang_col: str, quantile: float, slack: float) -> Model | None:
    """The model with a rejection limit for each language, from all its own training texts.

    The quantile is exact (interpolated): a histogram finds the bins that hold its two ranks, then only their values
    are collected.
    """
    if model is None:
        return None
    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text"))
    own = identify(rows, model, "text").filter((F.col("scan.lang") == F.col("row.lang")) & F.col("scan.cross_entropy").isNotNull())
    ce = F.col("scan.cross_entropy")
    with briefly_stored(own.select(F.col("row.lang").alias("lang"), ce.alias("ce"), F.floor(ce * BINS).alias("bin"))) as own:
        sizes: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for r in own.groupBy("lang", "bin").count().toArrow().to_pylist():
            sizes[r["lang"]].append((r["bin"], r["count"]))
        ranks, wanted = {}, F.lit(False)
        for la, bins in sizes.items():
            bins.sort()
            ends = np.cumsum([n for _, n in bins])
            place = quantile * (ends[-1] - 1)
            first, last = (int(np.searchsorted(ends, int(k), "right")) for k in (np.floor(place), np.ceil(place)))
            ranks[la] = place - (ends[first] - bins[first][1])
            wanted |= (F.col("lang") == la) & F.col("bin").isin(bins[first][0], bins[last][0])
        values: dict[str, list[tuple[float, int]]] = defaultdict(list)
        for r in own.filter(wanted).groupBy("lang", "ce").count().toArrow().to_pylist():
            values[r["lang"]].append((r["ce"], r["count"]))
    for la, some in values.items():
        some.sort()
        ends, low = np.cumsum([n for _, n in some]), int(ranks[la])
        x, y = (some[int(np.searchsorted(ends, k, "right"))][0] for k in (low, min(low + 1, ends[-1] - 1)))
        model.limits[model.langs.index(la)] = (x + (ranks[la] - low) * (y - x)) * (1 + slack)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.999, slack: float = 0.25) -> Model | None:
    """Learn from the labelled rows that are not held out."""
    labelled = docs.filter(~held_out(docs[id_col]) & docs[lang_col].isNotNull())
    model = train(labelled.select(labelled[lang_col].alias("lang"), text_of(labelled[text_col]).alias("text")))
    return calibrated(model, labelled, text_col, lang_col, quantile, slack)


def known_language(docs: DataFrame, **names) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return identify(docs, fit(docs, **names), names.get("text_col", "text")).filter(~F.col("scan.rejected")).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and rejected."""
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), F.col("scan.lang").alias("lang_pred"), "scan.score", "scan.rejected")
