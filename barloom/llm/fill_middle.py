"""Fill-in-middle: texts are cut into units and rearranged as prefix, suffix and middle by a secondary sort.

A unit is a run of A-Z, a-z or one other character. Every text is cut into chunks of units, each a row keyed by its
document and its position in the output. One exchange by document and a sort within partitions (the frame's form of
repartitionAndSortWithinPartitions) lets a task read each document's pieces in output order, whatever its length, and
feed them to a running digest. The same stream is searched for the marks, which tells where a piece of the output
belongs in the text; sorted again within its partition, by that place, it feeds the digest of the restored text. The
second sort needs no exchange, and no task holds a document.

Which form a document takes and where it is cut follows from its id alone, so any run gives the same output. A null text
is an empty one, and an empty text stays as it is, as does one that holds a mark. A null id is hashed as an empty string.
Rows that agree in id and text are interchangeable: each task counts them and sends their pieces once. Very long texts,
and very long runs of letters, are cut into pieces of bounded size. An empty table gives an empty result. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import row_key, tasks_for

# fixed values: the marks before prefix, suffix and middle, and the forms' order of parts
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: a part's rank in the text
RANK = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}

#: units, and code points, of a piece
UNITS, CHARS = 4096, 16384
FACTS = ("n", "form", "prefix_chars", "middle_chars")
ROWS = "n long, form string, prefix_chars long, middle_chars long"
#: texts cut at once
BATCH = 256


def draws(doc_id, salt: str = "1:") -> list[int]:
    """Four unsigned 32-bit numbers that follow from an id."""
    digest = hashlib.sha256(f"{salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def unit_starts(text: str) -> np.ndarray:
    """Code point positions at which units begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = points | 32
    letter = (low >= 97) & (low <= 122) & (points < 128)
    start = ~letter
    start[1:] |= ~letter[:-1]
    start[:1] = True
    return np.flatnonzero(start)


def chunks(text: str, starts: np.ndarray, first: int, last: int, units: int, chars: int) -> list[str]:
    """The units first .. last - 1 in pieces of at most `units` units and `chars` code points."""
    bounds = [*(int(starts[k]) for k in range(first, last, units)), int(starts[last]) if last < len(starts) else len(text)]
    return [text[a : min(a + chars, end)] for begin, end in zip(bounds, bounds[1:], strict=False) for a in range(begin, end, chars)]


def arranged(doc_id, text: str, plain_share: int, spm_share: int, units: int, chars: int) -> tuple[tuple, list[str]]:
    """(n, form, prefix_chars, middle_chars) and the output's pieces; shares are per cent."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= 100 - plain_share or any(m in text for m in RANK):
        return (n, "plain", None, None), chunks(text, starts, 0, n, units, chars)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    at = [int(starts[k]) if k < n else len(text) for k in (a, b)]
    form = "spm" if h4 % 100 < spm_share else "psm"
    part = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, n)}
    pieces = [p for mark in FORMS[form] for p in (mark, *chunks(text, starts, *part[mark], units, chars))]
    return (n, form, at[0], at[1] - at[0]), pieces


class Restorer:
    """Reads an output piece by piece and tells where its text belongs: (rank of the part, text)."""

    def __init__(self, form: str):
        self.marks = list(FORMS.get(form, ()))
        self.rank, self.held = 0, ""

    def read(self, piece: str) -> Iterator[tuple[int, str]]:
        self.held += piece
        while self.marks:
            before, mark, after = self.held.partition(self.marks[0])
            if not mark:  # all but what may be the beginning of a mark
                keep = len(self.marks[0]) - 1
                before, self.held = self.held[:-keep], self.held[-keep:]
                if before:
                    yield self.rank, before
                return
            if before:
                yield self.rank, before
            self.rank, self.held = RANK[self.marks.pop(0)], after
        if self.held:
            yield self.rank, self.held
            self.held = ""

    def end(self) -> Iterator[tuple[int, str]]:
        if self.held:
            yield self.rank, self.held


class Rows:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, text: int):
        self.schema, self.text = schema, text
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 64 + len(row[self.text] or "")
        if self.size > 1 << 22:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0


def pieces(docs: DataFrame, id_col: str, text_col: str, plain_share: int, spm_share: int, units: int, chars: int) -> DataFrame:
    """(_id, _rk, _task, copies, pos, piece, facts): every row's output in pieces from 1 on; a row of its facts stands at 0."""
    rows = docs.select(*row_key(docs, id_col, text_col), F.spark_partition_id().alias("_task"), docs[text_col].alias("_text"))
    kind = T.StructType([*rows.schema.fields[:3], T.StructField("copies", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("piece", T.StringType()), *T._parse_datatype_string(ROWS).fields])
    form = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(form, 5)
        for whole in batches:
            copies: dict[tuple, int] = {}
            keys = list(zip(*(whole.column(k).to_pylist() for k in range(3)), strict=True))
            for key in keys:
                copies[key] = copies.get(key, 0) + 1
            for at in range(0, whole.num_rows, BATCH):
                for key, text in zip(keys[at : at + BATCH], whole.column(3).slice(at, BATCH).to_pylist(), strict=True):
                    n = copies.pop(key, 0)
                    if n:
                        facts, cut = arranged(key[0], text or "", plain_share, spm_share, units, chars)
                        yield from out.add((*key, n, 0, None, *facts))
                        for pos, piece in enumerate(cut, 1):
                            yield from out.add((*key, n, pos, piece, None, None, None, None))
        yield from out.flush()

    return rows.mapInArrow(run, kind)


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def by_document(batches: Iterator[pa.RecordBatch], keys: int, pos: int) -> Iterator[tuple[tuple, bool, dict]]:
    """(key, first row of the key, row) for sorted batches, without the repeats that copies of a row leave at each position."""
    current, last = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            key = row[:keys]
            if key != current:
                current, last = key, row[pos]
                yield key, True, row
            elif row[pos] != last:
                last = row[pos]
                yield key, False, row
            else:
                yield key, False, (*row[:pos], None, *row[pos + 1 :])


def assembled(sent: DataFrame, texts: bool) -> DataFrame:
    """The output of every document in order, digested piece by piece; its text is handed on by its place in the document.

    (_id, _rk, _task, rank, seq, piece, copies, facts, output_sha256, output): the facts' row stands at rank -1.
    """
    fields = {f.name: f for f in sent.schema}
    kind = T.StructType([fields["_id"], fields["_rk"], fields["_task"], T.StructField("rank", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("piece", T.StringType()), fields["copies"], *(fields[c] for c in FACTS), T.StructField("output_sha256", T.StringType()), T.StructField("output", T.StringType())])
    form = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(form, 5)
        state: dict = {}

        def close() -> Iterator[pa.RecordBatch]:
            if state:
                for rank, text in state["parts"].end():
                    yield from put(rank, text)
                output = "".join(state["kept"]) if texts else None
                yield from out.add((*state["key"], -1, 0, None, state["copies"], *state["facts"], state["sum"].hexdigest(), output))

        def put(rank: int, text: str) -> Iterator[pa.RecordBatch]:
            state["seq"] += 1
            yield from out.add((*state["key"], rank, state["seq"], text, *[None] * 7))

        for key, first, row in by_document(batches, 3, 4):
            if first:
                yield from close()
                state = {"key": key, "copies": row[3], "facts": row[6:], "sum": hashlib.sha256(), "parts": Restorer(row[7]), "seq": 0, "kept": []}
            elif row[4] is None:  # the same piece of a copy
                state["copies"] += row[3] if row[5] is None else 0
            else:
                state["sum"].update(row[5].encode("utf-8", "surrogatepass"))
                if texts:
                    state["kept"].append(row[5])
                for rank, text in state["parts"].read(row[5]):
                    yield from put(rank, text)
        yield from close()
        yield from out.flush()

    return sent.mapInArrow(run, kind)


def restored(parts: DataFrame) -> DataFrame:
    """One row a document: its facts and digests, the text digested in its own order; `copies` says how many rows it stands for."""
    fields = {f.name: f for f in parts.schema}
    names = ("_id", "_rk", "copies", *FACTS, "output_sha256", "output")
    kind = T.StructType([*(fields[c] for c in names), T.StructField("restored_sha256", T.StringType())])
    form, place = _arrow(kind), {c: k for k, c in enumerate(parts.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(form, len(names) - 1)
        head, running = None, hashlib.sha256()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[place["rank"]] < 0:
                    if head:
                        yield from out.add((*head, running.hexdigest()))
                    head, running = tuple(row[place[c]] for c in names), hashlib.sha256()
                else:
                    running.update(row[place["piece"]].encode("utf-8", "surrogatepass"))
        if head:
            yield from out.add((*head, running.hexdigest()))
        yield from out.flush()

    return parts.mapInArrow(run, kind)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_share: int = 10, spm_share: int = 20, texts: bool = True, units: int = UNITS, chars: int = CHARS) -> DataFrame:
    """(_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) of every row.

    plain_share and spm_share are per cent: of all documents, and of those that are not plain. With texts=False the
    outputs are digested only, and no task holds one.
    """
    sent = pieces(docs, id_col, text_col, plain_share, spm_share, units, chars)
    parts = sent.select("_id", "_rk", "_task", "copies", "pos", "piece", *FACTS)
    key = ("_id", "_rk", "_task")
    tasks = tasks_for(docs)
    dealt = parts.repartition(*key) if tasks == int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else parts.repartition(tasks, *key)
    ordered = assembled(dealt.sortWithinPartitions(*key, "pos"), texts)
    # still partitioned by document: this sort needs no exchange
    done = restored(ordered.sortWithinPartitions(*key, "rank", "seq"))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return done.withColumn("_copy", copies).select("_id", *FACTS, "output", "output_sha256", "restored_sha256")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return fill_in_middle(docs, texts=False).drop("output").withColumnRenamed("_id", "doc_id")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
    ('0x' || hx[1:8])::BIGINT AS h1, ('0x' || hx[9:16])::BIGINT AS h2, ('0x' || hx[17:24])::BIGINT AS h3, ('0x' || hx[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:], ''), '') AS suf FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p),
w AS (
  SELECT *, strpos(out, '<P>') AS pp, strpos(out, '<S>') AS ps, strpos(out, '<M>') AS pm FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out
    WHEN 'psm' THEN substr(out, 4, ps - 4) || substr(out, pm + 3) || substr(out, ps + 3, pm - ps - 3)
    ELSE substr(out, pp + 3, pm - pp - 3) || substr(out, pm + 3) || substr(out, 4, pp - 4) END) AS restored_sha256
FROM w
"""
