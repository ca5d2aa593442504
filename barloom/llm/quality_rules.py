"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Ratios are sums over sums of counts that the projection computes once per row. A null or empty text has no words, fails
the base rule and is dropped. Rows that repeat an id are judged one by one; other columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BLANKS, bound, text_of


@dataclass(frozen=True)
class Rule:
    """Keep while low * den <= num <= high * den; num and den name counts of `COUNTS`."""

    name: str
    num: str
    den: str
    low: float | None = None
    high: float | None = None


# fixed values: function words of the languages that the corpus is known to hold
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "der die und in den von zu das mit sich des auf für nicht ist im dem ein eine als "
    "le la les de des et en un une du que est par pour dans qui au sur pas avec "
    "el los las y que del se por con no su para es al lo como más"
).split()

# fixed values: thresholds, as commonly published for web text
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.10),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04),
    Rule("duplicate_lines", "n_dup_lines", "n_word_lines", high=0.30),
    Rule("capitals", "n_capitals", "word_chars", high=0.40),
    Rule("shouting", "n_exclaims", "n_words", high=0.30),
)

SPLITTER = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLITTER, -1))


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more.

    Windows are sorted by hash and confirmed by their words, so equal ones are neighbours; the covered words are summed
    over the sorted starts.
    """

    def same(w: Column, p: Column, q: Column) -> Column:
        return (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

    def repeated(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

        def starts(s: Column) -> Column:
            def hit(i: Column, j: Column) -> Column:
                a, b = F.get(s, i), F.get(s, j)
                return F.coalesce((a["h"] == b["h"]) & same(w, a["p"], b["p"]), F.lit(False))

            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: hit(i, i - 1) | hit(i, i + 1))
            return F.sort_array(F.transform(at, lambda i: F.get(s, i)["p"]))

        return bound(F.sort_array(windows), starts)

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    total = lambda w: F.aggregate(repeated(w), start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")))["n"]
    return bound(words, lambda w: F.when(F.size(w) >= 4, total(w)).otherwise(F.lit(0).cast("long")))


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, stats): row is the input row, stats the counts that rules may name."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    text = F.col(f"row.`{text_col}`")
    split = docs.select(row).select("row", _words(text_of(text)).alias("words"), F.filter(F.split(text_of(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"))
    t = text_of(text)
    long = lambda c: c.cast("long")
    stats = F.struct(
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines")).alias("n_word_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        long(F.size(F.filter("words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS)))))).alias("n_stop_words"),
        long(F.regexp_count(t, F.lit(r"\p{Lu}"))).alias("n_capitals"),
        long(F.regexp_count(t, F.lit("!"))).alias("n_exclaims"),
    )
    return split.select("row", stats.alias("stats"))


def verdict(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules hold. Bounds multiply the denominator, so a zero denominator needs no special case."""
    ok = F.lit(True)
    for r in rules:
        num, den = stats[r.num].cast("double"), stats[r.den].cast("double")
        if r.low is not None:
            ok = ok & (num >= F.lit(float(r.low)) * den)
        if r.high is not None:
            ok = ok & (num <= F.lit(float(r.high)) * den)
    return ok


def failed_rules(stats: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a row breaks."""
    return F.filter(F.array(*[F.when(~verdict(stats, (r,)), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull())


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, stats, base_failed, kept, failed)."""
    s = F.col("stats")
    base = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return counts(docs, text_col).select("row", "stats", base.alias("base_failed"), (~base & verdict(s, rules)).alias("kept"), failed_rules(s, rules).alias("failed"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality(docs).select("row.doc_id", *[F.col(f"stats.{n}").alias(n) for n in names], "base_failed", "kept")


# written by hand: the rule table above must agree with these numbers
SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
win AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM parts)),
rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY r),
stats AS (
  SELECT p.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_word_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ('the','of','and','to','a','in','is','that','it','for','was','on','with','as',
           'by','be','this','are','at','from','der','die','und','den','von','zu','das','mit','sich','des','auf','für',
           'nicht','ist','im','dem','ein','eine','als','le','la','les','de','et','en','un','une','du','que','est','par',
           'pour','dans','qui','au','sur','pas','avec','el','los','las','y','del','se','por','con','no','su','para','es',
           'al','lo','como','más'))) AS n_stop,
         len(regexp_extract_all(t, '\p{Lu}')) AS n_cap, len(regexp_extract_all(t, '!')) AS n_excl
  FROM parts p LEFT JOIN cov ON cov.r = p.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1::DOUBLE * n_words
         AND n_stop >= 0.04::DOUBLE * n_words AND n_dup_lines <= 0.3::DOUBLE * n_word_lines
         AND n_cap <= 0.4::DOUBLE * word_chars AND n_excl <= 0.3::DOUBLE * n_words AS kept
FROM stats
"""
