"""Benchmark decontamination: prefix-filtered containment join of item-sized word windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. A window is 13 consecutive item words (an item of
fewer words, but not none, is one window). A window occurs in a document where its words stand consecutively.

Method. Windows and documents are sets of shingles (4 consecutive words; shorter windows are one shingle). Shingles that
no benchmark item has are dropped first; what is left of the corpus gives every benchmark shingle its frequency. Under
exact containment one prefix token is necessary, so each window is indexed by its rarest shingle only, and joined with
the documents on it. A candidate's place follows from the shingle's position; it must lie inside the document (length
and positional bounds), and every word is then compared with the document's words.

Everything is DataFrame and SQL functions. Null and empty texts have no words: nothing hit, not contaminated. Items
without words have no window; rows that repeat an item id add their windows to that item. Windows of rows without an
item id count for n_hit and contaminated; a null is no item in n_items and items_sha256. Rows that repeat a document id
are judged row by row, equal rows alike. An empty benchmark leaves every document clean.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WORD, ascii_lower, bound, row_key, stored, text_of

SHINGLE = 4
#: a side is broadcast up to so many rows of at most a few hundred bytes; beyond it the join shuffles
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text_of(text)), F.lit(WORD), F.lit(0))


def _shingles(w: Column, q: int) -> Column:
    """[(pos, h)] of all q-word shingles of a word array that is already computed."""
    at = F.when(F.size(w) >= q, F.sequence(F.lit(0), F.size(w) - q)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(q), *[F.get(w, i + k) for k in range(q)]).alias("h")))


def _checked(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = 13) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (w1, w2, len, words) of all rows, and which items hold them (w1, w2, item), rows without an id left out."""
    rows = items.select(items[id_col].cast("string").alias("item"), words(items[text_col]).alias("w"))
    n = F.size("w")
    length = F.least(F.lit(size), n)
    cut = rows.filter(n > 0).select("item", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), n - length)).alias("start"))
    cut = cut.select("item", "len", F.slice("w", F.col("start") + 1, F.col("len")).alias("words"))
    cut = cut.select("item", "len", "words", F.xxhash64("words").alias("w1"), F.xxhash64(F.lit(7), "words").alias("w2"))
    held = cut.filter(F.col("item").isNotNull()).select("w1", "w2", "item").distinct()
    return cut.groupBy("w1", "w2").agg(F.first("len").alias("len"), F.first("words").alias("words")), held


def window_shingles(found: DataFrame, shingle: int, sizes: list[int]) -> DataFrame:
    """(w1, w2, off, h): the shingles of every window."""
    arrays = [F.when(F.least(F.col("len"), F.lit(shingle)) == q, _shingles(F.col("words"), q)) for q in sizes]
    return found.select("w1", "w2", F.inline(F.coalesce(*arrays))).withColumnRenamed("pos", "off")


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """One row per document row: (_id, _rk, n_words, occ), occ the verified (start, end, w1, w2); and the holders of windows."""
    found, held = windows(items, item_id, item_text, size)
    found = stored(found)
    lengths = found.agg(F.count("*"), *[F.max((F.col("len") == q).cast("int")) for q in range(1, shingle)]).first()
    sizes = [q for q in range(1, shingle) if lengths[q]] + [shingle]
    index = window_shingles(found, shingle, sizes)
    known = stored(index.select("h").distinct())
    # documents: only positions whose shingle some window has; the word array is not carried
    w = bound(words(docs[text_col]), lambda x: F.concat(*[_shingles(x, q) for q in sizes]))
    spots = docs.select(*row_key(docs, id_col, text_col), F.inline(w))
    matched = stored(spots.join(_checked(known, known.count()), "h", "left_semi"))
    # rarity of benchmark shingles in the corpus; one that never occurs leaves its windows without candidates
    rarity = matched.groupBy("h").agg(F.count("*").alias("n"))
    ranked = index.join(rarity, "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = ranked.groupBy("w1", "w2").agg(F.min(F.struct("n", "h", "off")).alias("p")).filter("p.n > 0")
    prefix = prefix.join(found, ["w1", "w2"]).select("w1", "w2", "len", "words", F.col("p.h").alias("h"), F.col("p.off").alias("off"))
    start = F.col("pos") - F.col("off")
    candidates = matched.join(_checked(prefix, lengths[0]), "h").filter(start >= 0)
    per_row = candidates.groupBy("_id", "_rk").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("len")).alias("end"), "w1", "w2", "words")).alias("c"))
    rows = docs.select(*row_key(docs, id_col, text_col), docs[text_col].alias("_text"))
    both = rows.alias("r").join(per_row.alias("c"), F.col("r._id").eqNullSafe(F.col("c._id")) & (F.col("r._rk") == F.col("c._rk")), "left")

    def verified(w: Column) -> Column:
        def stands(c: Column) -> Column:
            return (c["end"] <= F.size(w)) & F.forall(F.sequence(F.lit(0), c["end"] - c["start"] - 1), lambda k: F.get(w, c["start"] + k) == F.get(c["words"], k))

        occ = F.transform(F.filter(F.col("c.c"), stands), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["w1"].alias("w1"), c["w2"].alias("w2")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.sort_array(occ).alias("occ"))

    return both.select("r._id", "r._rk", bound(words(F.col("r._text")), verified).alias("s")).select("_id", "_rk", "s.n_words", "s.occ"), held


def _covered(occ: Column) -> Column:
    """Words inside the union of sorted (start, end) ranges."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, o: F.struct(F.greatest(a["end"], o["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), o["end"] - F.greatest(a["end"], o["start"]))).alias("n"))
    return F.coalesce(F.aggregate(occ, zero, step)["n"], F.lit(0).cast("long"))


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(_id, _rk, n_words, n_hit, n_items, items_sha256, contaminated), one row per document row."""
    found, held = occurrences(docs, items, **names)
    found = stored(found.select("_id", "_rk", "n_words", _covered(F.col("occ")).alias("n_hit"), F.transform("occ", lambda o: F.struct(o["w1"].alias("w1"), o["w2"].alias("w2"))).alias("ws")))
    seen = found.filter("n_hit > 0").select("_id", "_rk", F.inline(F.array_distinct("ws"))).join(held, ["w1", "w2"])
    per_row = seen.groupBy("_id", "_rk").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = found.alias("f").join(per_row.alias("p"), F.col("f._id").eqNullSafe(F.col("p._id")) & (F.col("f._rk") == F.col("p._rk")), "left")
    hit, n = F.col("n_hit"), F.col("n_words")
    return both.select(
        "f._id",
        "f._rk",
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= n)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **names).filter("contaminated").select("_id", "_rk")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(docs, id_col, text_col))
    clean = rows.alias("r").join(bad.alias("b"), F.col("r._id").eqNullSafe(F.col("b._id")) & (F.col("r._rk") == F.col("b._rk")), "left_anti")
    return clean.select("row.*")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    return contamination(docs, items).drop("_rk").withColumnRenamed("_id", "doc_id")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
occ AS (SELECT DISTINCT r, s, dw.n, item_id FROM dw JOIN iw ON iw.g = dw.g AND iw.n = dw.n),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
