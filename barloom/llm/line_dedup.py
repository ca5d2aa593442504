"""Line de-duplication: explode normalised lines, hash them, count documents per hash, drop, reassemble.

A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at least `min_chars` code
points found in at least `min_docs` documents lose all their lines, except in the largest id that holds them.

Null and empty texts are one empty line and lose nothing. Rows that repeat an id count as one document when a key's
documents are counted, and all keep the lines that their id keeps. A null id is a document of its own kind: it is never
the largest unless it is the only one. An empty table gives an empty result. Further columns, whatever their names, are
kept by `line_dedup` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BLANKS, ascii_lower, row_key, text_of


def _lines(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_id, _rk, pos, h1, h2) of every line whose key is long enough to be judged."""
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    lines = docs.select(*row_key(docs, id_col, text_col), F.posexplode(_lines(docs[text_col])).alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars).withColumn("key", key).filter(F.length("key") >= min_chars)
    return lines.select("_id", "_rk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def frequent_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys in enough documents, with the id that keeps them. Documents are made distinct before they are counted."""
    once = lines.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("one"))
    held = once.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("_id").alias("keeper"))
    return held.filter(F.col("n") >= min_docs).select("h1", "h2", "keeper")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(row, n_lines, n_dropped, kept): row is the input row as a struct, kept its text without the dropped lines."""
    lines = line_keys(docs, id_col, text_col, min_chars)
    # the frequent keys are few next to the lines; Spark broadcasts them only below its own size threshold and
    # otherwise splits hot keys of the line side, which is never grouped here
    dropped = lines.join(frequent_keys(lines, min_docs), ["h1", "h2"]).filter(~F.col("_id").eqNullSafe(F.col("keeper")))
    per_row = dropped.groupBy("_id", "_rk").agg(F.collect_set("pos").alias("drop"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(docs, id_col, text_col))
    both = rows.alias("r").join(per_row.alias("d"), F.col("r._id").eqNullSafe(F.col("d._id")) & (F.col("r._rk") == F.col("d._rk")), "left")
    text = F.col(f"row.`{text_col}`")
    n_lines = F.size(_lines(text))
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("drop")))
    lines_kept = F.transform(F.array(_lines(text)), lambda ls: F.array_join(F.transform(keep, lambda i: F.get(ls, i)), "\n"))[0]
    kept = F.when(F.col("drop").isNull(), text_of(text)).otherwise(lines_kept)
    return both.select("row", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = line_dedup(docs)
    return out.select("row.doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT d.doc_id, d.pos, d.line, (h.k IS NOT NULL AND h.keeper <> d.doc_id) AS gone
  FROM keyed d LEFT JOIN hot h ON h.k = d.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
