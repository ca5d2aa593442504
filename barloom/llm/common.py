"""Helpers that the training-data operators share: row identity, words, shared storage, Arrow rows."""

from __future__ import annotations

import shutil
import sys
import tempfile
import types
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

#: the most tasks that a frame's size asks for
MAX_TASKS = 50_000
#: sizes above it are the planner's word for a size that it does not know
UNKNOWN = 1 << 55

# fixed values: the contract's character classes
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table for words: A-Z become a-z, other ASCII outside 0-9 a-z becomes a blank
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(_id, _rk): a row's identity without a shuffle. Rows that agree in id and text are interchangeable."""
    return [docs[id_col].alias("_id"), F.xxhash64(text_of(docs[text_col])).alias("_rk")]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str | None) -> list[bytes]:
    """The contract's lower-cased words of one text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local master gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_llm_folder", None)
    if own is None:
        own = spark._llm_folder = tempfile.mkdtemp(prefix="spark-")
        weakref.finalize(spark, shutil.rmtree, own, ignore_errors=True)
    return own


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back; later stages restart from it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def briefly_stored(df: DataFrame) -> Iterator[DataFrame]:
    """A frame as a table in the shared folder for the length of a block; its files are deleted at the end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint a narrow frame in the shared folder; its files go when the frame does."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks_for(df: DataFrame, size: int = 1 << 27) -> int:
    """Tasks for a shuffle of a whole frame: the session's number, more where the plan's size asks for it."""
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if known > UNKNOWN else max(least, min(-(-known // size), MAX_TASKS))


def per_text(docs: DataFrame, text_col: str, schema: pa.Schema, make: Callable[[], Callable[[list[str | None]], list[tuple]]]) -> DataFrame:
    """(row, scan): every input row as a struct with what make()'s function returns for its text.

    make runs once per task; its function gets the texts of one Arrow batch and returns one tuple per text.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = make()
        for batch in batches:
            row = batch.column("row")
            done = to_batch(scan(row.field(place).to_pylist()), schema)
            yield pa.RecordBatch.from_arrays([row, pa.StructArray.from_arrays(done.columns, fields=list(schema))], names=["row", "scan"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("scan", from_arrow_schema(schema))]))


def kept_in_worker(name, make: Callable):
    """What a Python worker made once, for all tasks that it runs; the package itself travels with every task anew."""
    shelf = sys.modules.setdefault("_barloom_llm_shelf", types.ModuleType("_barloom_llm_shelf")).__dict__
    if name not in shelf:
        shelf[name] = make()
    return shelf[name]


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
