"""Lexicon sentiment and word frequencies on whole texts.

The lexicon is a table (word, kind, weight) with kinds positive, negative, degree, negation
and transition. Neighbours of a token are taken inside its row's array, so scoring a document
needs no shuffle; only per-document sums are grouped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import lit
from barloom.functions.ranks import count_if

TOKEN = r"(\p{L}+)"


def tokens(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN), F.lit(1))


def sentiment(docs: DataFrame, lexicon: DataFrame, transitions: Sequence[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Score, label and counts per document.

    The first transition word splits the text and the rest counts 1.5 times. A polarity word
    flips after a negation and scales after a degree word; the modifier before a polarity word
    scores at its own position too.
    """
    d = docs.select(key, tokens(text).alias("_t"))
    found = [F.nullif(F.array_position("_t", w), F.lit(0).cast("long")) for w in transitions]
    first = F.least(*found) if len(found) > 1 else found[0]
    d = d.withColumn("_cut", F.coalesce(first, F.lit(0).cast("long")))
    cut = F.col("_cut")

    n = F.size("_t")
    none = F.array(F.lit(None).cast("string"))
    # neighbours as shifted copies of the array: built-in array functions, no per-token lambda
    d = d.filter(n > 0).select(
        key,
        "_cut",
        F.col("_t").alias("w"),
        F.concat(none, F.slice("_t", F.lit(1), n - 1)).alias("p"),
        F.concat(F.slice("_t", F.lit(2), n - 1), none).alias("n"),
    )
    one = d.select(key, "_cut", F.posexplode(F.arrays_zip("w", "p", "n")).alias("_i", "_r")).select(key, "_cut", (F.col("_i") + 1).alias("_i"), "_r.*")
    i, split = F.col("_i"), cut > 0
    one = one.filter(~(split & (i == cut))).select(
        key,
        "w",
        F.when(~(split & (i - 1 == cut)), F.col("p")).alias("p"),
        F.when(~(split & (i + 1 == cut)), F.col("n")).alias("n"),
        F.when(split & (i > cut), lit(1.5)).otherwise(lit(1)).alias("m"),
    )
    lex = lexicon.select("word", "kind", "weight")

    def side(col: str, tag: str) -> DataFrame:
        return lex.select(F.col("word").alias(col), F.col("kind").alias(f"{tag}_kind"), F.col("weight").alias(f"{tag}_weight"))

    # most tokens are not in the lexicon: the inner join on the token itself drops them first
    j = one.join(side("w", "w"), "w").join(side("p", "p"), "p", "left").join(side("n", "n"), "n", "left")
    c = F.col
    polar = c("w_kind").isin("positive", "negative")
    sign = F.when(c("w_kind") == "positive", lit(1)).otherwise(lit(-1))
    own = c("w_weight") * F.when(c("p_kind") == "negation", -sign).when(c("p_kind") == "degree", sign * c("p_weight")).otherwise(sign)
    ahead = c("n_kind").isin("positive", "negative")
    nsign = F.when(c("n_kind") == "positive", lit(1)).otherwise(lit(-1))
    lead = F.when(c("w_kind") == "degree", nsign * c("n_weight") * c("w_weight")).when(c("w_kind") == "negation", -nsign * c("n_weight"))
    value = F.when(polar, own).when(F.coalesce(ahead, F.lit(False)), lead)
    s = j.withColumn("_v", value).filter("_v IS NOT NULL")
    g = s.groupBy(key).agg(F.sum(c("_v") * c("m")).alias("score"), count_if(c("_v") > 0).alias("positive_count"), count_if(c("_v") < 0).alias("negative_count"))
    out = docs.select(key).join(g, key, "left").fillna(0)
    return out.withColumn("label", F.when(F.col("score") > 1, "positive").when(F.col("score") < -1, "negative").otherwise("neutral"))


def corpus_sentiment(scored: DataFrame) -> DataFrame:
    """Sum over documents of their own scores."""
    g = scored.agg(F.sum("score").alias("score"), F.sum("positive_count").alias("positive_count"), F.sum("negative_count").alias("negative_count"))
    return g.withColumn("label", F.when(F.col("score") > 1, "positive").when(F.col("score") < -1, "negative").otherwise("neutral"))


def word_frequencies(docs: DataFrame, weights: DataFrame, min_weight: float = 100.0, text: str = "text") -> DataFrame:
    """Counts of words whose dictionary weight reaches the minimum, with count x weight.

    Words are counted before the join, so it sees one row per distinct word.
    """
    w = docs.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    j = w.join(weights, "word").filter(F.col("weight") >= min_weight)
    return j.withColumn("score", F.col("weight") * F.col("n"))
