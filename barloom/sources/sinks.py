"""Writes with key semantics over plain Parquet."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import lit


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert or replace on key: incoming rows win whole, other target rows stay."""
    return target.join(incoming.select(*keys), list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The incoming rows that a do-nothing-on-conflict insert would add."""
    return incoming.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def write_partitions(df: DataFrame, path: str, by: str = "day") -> None:
    """Rewrite only the partitions present in the frame. The path must be shared storage."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_partitions(incoming: DataFrame, path: str, keys: Sequence[str], by: str = "day") -> None:
    """Upsert into a partitioned table: reads and rewrites the touched partitions only.

    The list of touched partitions is one value per day of the batch. The merged rows are
    checkpointed before the overwrite, since they come from the files being replaced.
    """
    spark = incoming.sparkSession
    touched = [r[0] for r in incoming.select(by).distinct().collect()]
    try:
        current = spark.read.parquet(path).filter(F.col(by).isin(touched))
    except Exception as e:  # a first write has no table to merge with
        if "PATH_NOT_FOUND" not in str(e):
            raise
        current = None
    merged = incoming if current is None else checkpointed(upsert(current, incoming, keys))
    write_partitions(merged, path, by)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder; a session without one needs it set first."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def materialized(df: DataFrame) -> DataFrame:
    """Store a frame that several branches read, as a table in the shared checkpoint folder.

    A session without spark.checkpoint.dir gets the frame back unchanged, to be recomputed.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        return df
    path = f"{shared}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def retention(df: DataFrame, day: str, cutoff) -> DataFrame:
    """Rows on or after the cutoff; on a day-partitioned table this prunes whole partitions."""
    return df.filter(F.col(day) >= F.lit(cutoff))


# fixed values: columns each flow source owns
MAC_COLUMNS = ("mac_main_net1", "mac_main_net5", "mac_retail_net1")
KEPT_BY_PUBLIC = (*MAC_COLUMNS, "northbound", "sector_net", "concept_net")


def _joined_sources(*cols: Column) -> Column:
    items = F.transform(F.split(F.concat_ws("+", *cols), r"\+"), lambda s: F.trim(s))
    return F.array_join(F.array_distinct(F.filter(items, lambda s: s != "")), "+")


def merge_money_flow(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("code", "day")) -> DataFrame:
    """Source-aware merge of two flow tables with at most one row per key.

    `tdx_mac` rows replace rows of no or the same source and otherwise touch only their own
    three columns; `eastmoney` rows keep the columns they do not carry; others replace.
    """
    cols = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.struct(*cols).alias("a"))
    b = incoming.select(*keys, F.struct(*cols).alias("b"))
    j = a.join(b, list(keys), "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    src_a, src_b = F.coalesce(F.col("a.source"), F.lit("")), F.coalesce(F.col("b.source"), F.lit(""))
    mac_only = both & (src_b == "tdx_mac") & ~src_a.isin("", "tdx_mac")
    public = both & (src_b == "eastmoney")

    def pick(name: str) -> Column:
        old, new = F.col(f"a.{name}"), F.col(f"b.{name}")
        if name == "source":
            merged = F.when(mac_only, _joined_sources(src_a, src_b)).when(public, _joined_sources(src_b, src_a))
        elif name == "data_as_of":
            return F.greatest(old, new)
        else:
            keep_old = mac_only if name not in MAC_COLUMNS else F.lit(False)
            if name in KEPT_BY_PUBLIC:
                keep_old = keep_old | public
            merged = F.when(keep_old, old)
            return F.when(F.col("b").isNull(), old).when(keep_old, old).otherwise(new)
        return F.when(F.col("b").isNull(), old).otherwise(F.coalesce(merged, new))

    return j.select(*keys, *[pick(c).alias(c) for c in cols])


def compat_zero(df: DataFrame, columns: Sequence[str], defaults: dict[str, float] | None = None) -> DataFrame:
    """Missing values as the defaults of the desktop tables: 0, or the given value per column."""
    defaults = defaults or {}
    return df.withColumns({c: F.coalesce(F.col(c), lit(defaults.get(c, 0))) for c in columns})
