"""Rolling windows by instrument and exact distributed ranking helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import _c, lit


class Roll:
    """Window factory for one (keys, order) pair.

    Every frame made by one Roll shares its partitioning and order, so Catalyst plans
    a single exchange and a single sort for all of them. A rolling value is null until
    the frame holds `n` rows; `at` is the 1-based bar number.
    """

    def __init__(self, keys: Sequence[str] = ("code",), order: Sequence[str] = ("day",)):
        self.keys, self.order = tuple(keys), tuple(order)
        self._specs: dict = {}

    def _spec(self, lo: int | None = None, hi: int = 0):
        """Window specs are built once per session: each costs several calls into the JVM."""
        context = SparkContext._active_spark_context
        if self._specs.get("context") is not context:
            base = Window.partitionBy(*self.keys).orderBy(*self.order)
            self._specs = {"context": context, None: base}
        if lo is None:
            return self._specs[None]
        if (lo, hi) not in self._specs:
            self._specs[(lo, hi)] = self._specs[None].rowsBetween(lo, hi)
        return self._specs[(lo, hi)]

    @property
    def base(self):
        return self._spec()

    def frame(self, n: int):
        return self._spec(-(n - 1), 0)

    def at(self) -> Column:
        return F.row_number().over(self.base)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(_c(x), n).over(self.base)

    def lead(self, x, n: int = 1) -> Column:
        return F.lead(_c(x), n).over(self.base)

    def full(self, n: int) -> Column:
        return self.held(F.lit(1), n) == n

    def held(self, x, n: int) -> Column:
        """Values among the last n rows: two running counts, where a count over the frame would visit n rows each time."""
        first = Window.unboundedPreceding
        return F.count(_c(x)).over(self._spec(first, 0)) - F.count(_c(x)).over(self._spec(first, -n))

    def agg(self, fn, x, n: int) -> Column:
        """fn over the last n rows, null unless all n rows hold a value."""
        return F.when(self.held(x, n) == n, fn(_c(x)).over(self.frame(n)))

    def mean(self, x, n: int) -> Column:
        return self.agg(F.avg, x, n)

    def sum(self, x, n: int) -> Column:
        return self.agg(F.sum, x, n)

    def max(self, x, n: int) -> Column:
        return self.agg(F.max, x, n)

    def min(self, x, n: int) -> Column:
        return self.agg(F.min, x, n)

    def std(self, x, n: int) -> Column:
        return self.agg(F.stddev_pop, x, n)

    def cum(self, x) -> Column:
        return F.sum(_c(x)).over(self._spec(Window.unboundedPreceding, 0))

    def wma(self, x, n: int) -> Column:
        """Linear weights 1..n, newest heaviest; null while any term is missing."""
        terms = [self.lag(x, n - 1 - j) * lit(j + 1) if j < n - 1 else _c(x) * lit(n) for j in range(n)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total / lit(n * (n + 1) / 2)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key under a total order.

    Written as a min over a struct rather than row_number = 1: it combines map-side,
    so a key that holds a third of all rows never lands in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    sort_cols = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    packed = df.select(*keys, F.struct(*sort_cols, *[F.col(c) for c in rest]).alias("_r"))
    best = packed.groupBy(*keys).agg(F.min("_r").alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def value_bucket(x) -> Column:
    """A monotone, data-independent bucket of a double: sign and 4096 steps per octave.

    Used to split a global order into independent ranges without sampling. The infinities have end buckets of their
    own; NaN sorts after everything, as Spark's order has it.
    """
    v = _c(x)
    top = F.lit(1 << 40)
    inf = lit(float("inf"))
    mag = F.floor(F.log2(F.abs(v)) * lit(4096)).cast("long")
    shifted = mag + F.lit(4096 * 1100)
    ends = F.when(F.isnan(v), top + 1).when(v == inf, top).when(v == -inf, -top)
    return ends.when(v > 0, shifted).when(v < 0, -shifted).otherwise(F.lit(0).cast("long"))


def cumulative_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: its count and the number of rows strictly below it, per key.

    Three pre-aggregated levels: distinct values, their buckets, and the buckets' prefix
    sums. No task sees raw rows, so neither a hot key nor a hot value matters. Output:
    keys, value, n, below.
    """
    b = f"_{value}_b"
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).withColumn(b, value_bucket(value))
    per_bucket = counts.groupBy(*keys, b).agg(F.sum("n").alias("_bn"))
    wb = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(b)
    per_bucket = per_bucket.withColumn("_before", F.sum("_bn").over(wb) - F.col("_bn")).drop("_bn")
    wi = Window.partitionBy(*keys, b).orderBy(value)
    inner = counts.withColumn("_in", F.sum("n").over(wi) - F.col("n"))
    return inner.join(per_bucket, [*keys, b]).select(
        *keys, value, "n", (F.col("_before") + F.col("_in")).alias("below")
    )


def pick_at_rank(counted: DataFrame, value: str, ranks: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Values at given 0-based ranks from `cumulative_counts` output.

    `ranks` maps an output name to a rank Column over the total row count `total`.
    """
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = counted.join(totals, list(keys)) if keys else counted.crossJoin(F.broadcast(totals))
    picks = [
        F.max(F.when((F.col("below") <= r) & (r < F.col("below") + F.col("n")), F.col(value))).alias(name)
        for name, r in ranks.items()
    ]
    return joined.groupBy(*keys, "total").agg(*picks)


def quantiles(df: DataFrame, value: str, ranks: dict[str, Column], keys: Sequence[str] = (), few: bool = False) -> DataFrame:
    """(keys, total, one column a rank): exact values at 0-based ranks, all of them in two passes; nulls do not count.

    `ranks` maps an output name to a rank Column over `total`. The first pass counts rows by bucket, a state that merges
    before the exchange; its prefix sums name the bucket of every rank. The second pass reads only the rows of those
    buckets and counts their values. Keys without a value have no row. With `few` keys, a fixed list of names, the buckets
    of the ranks go to the rows; else rows and buckets meet by key.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).withColumn("_b", value_bucket("_v"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    per = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per = per.withColumns({"_before": F.sum("_n").over(whole.orderBy("_b")) - F.col("_n"), "total": F.sum("_n").over(whole)})
    asked = F.array(*[F.struct(F.lit(k).alias("ask"), r.cast("long").alias("rank")) for k, r in enumerate(ranks.values())])
    inside = F.filter(asked, lambda a: (a["rank"] >= F.col("_before")) & (a["rank"] < F.col("_before") + F.col("_n")))
    held = per.withColumn("_asks", inside).filter(F.size("_asks") > 0).select(*keys, "_b", "_before", "total", "_asks")
    on = [*keys, "_b"]
    left, right = rows.alias("l"), (F.broadcast(held) if few else held).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    near = left.join(right, same).select(*[F.col(f"l.{c}") for c in [*on, "_v"]], "_before", "total", "_asks")
    counts = near.groupBy(*on, "_v").agg(F.count(F.lit(1)).alias("_n"), F.any_value("_before").alias("_before"), F.any_value("total").alias("total"), F.any_value("_asks").alias("_asks"))
    below = F.col("_before") + F.sum("_n").over(Window.partitionBy(*on).orderBy("_v")) - F.col("_n")
    counts = counts.withColumn("_low", below)

    def at(k: int) -> Column:
        hit = F.exists("_asks", lambda a: (a["ask"] == k) & (a["rank"] >= F.col("_low")) & (a["rank"] < F.col("_low") + F.col("_n")))
        return F.max(F.when(hit, F.col("_v")))

    return counts.groupBy(*keys, "total").agg(*[at(k).alias(name) for k, name in enumerate(ranks)])


def level_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based place within the keys by (value descending, tie ascending); both are numbers.

    Five counted levels: octaves of the value, its buckets, values, buckets of the tie, and rows. Each level ranks inside
    one cell of the level above, so no task sees a whole key, and a value that a third of all rows share is split by its
    tie. The octaves of a key, some two thousand at most, are summed in one array.
    """
    rows = df.withColumns({"_b": value_bucket(value), "_t": value_bucket(F.col(tie).cast("double"))}).withColumn("_o", F.shiftright("_b", 12))
    by = [*keys, "_o", "_b", value, "_t"]
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    values = cells.groupBy(*by[:-1]).agg(F.sum("_n").alias("_n"))
    buckets = values.groupBy(*by[:-2]).agg(F.sum("_n").alias("_n"))
    octaves = buckets.groupBy(*keys, "_o").agg(F.sum("_n").alias("_n")).groupBy(*keys).agg(F.collect_list(F.struct("_o", "_n")).alias("_all"))

    def above(x: Column) -> Column:
        higher = F.filter("_all", lambda y: y["_o"] > x["_o"])
        return F.struct(x["_o"].alias("_o"), F.aggregate(higher, F.lit(0).cast("long"), lambda s, y: s + y["_n"]).alias("_above"))

    octaves = octaves.select(*keys, F.explode(F.transform("_all", above)).alias("_x")).select(*keys, "_x.*")

    def before(level: DataFrame, order: Column, inside: Sequence[str], out: str) -> DataFrame:
        return level.withColumn(out, F.sum("_n").over(Window.partitionBy(*inside).orderBy(order)) - F.col("_n")).drop("_n")

    j = before(cells, F.asc("_t"), by[:-1], "_p3").join(before(values, F.desc(value), by[:-2], "_p2"), by[:-1])
    j = j.join(before(buckets, F.desc("_b"), by[:-3], "_p1"), by[:-2]).join(octaves, [*keys, "_o"])
    offsets = j.select(*by, (F.col("_above") + F.col("_p1") + F.col("_p2") + F.col("_p3")).alias("_off"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(tie))
    out = rows.join(offsets, by)
    return out.withColumn(name, (F.col("_off") + place).cast("int")).drop("_o", "_b", "_t", "_off")


def lower_nearest(p: float) -> Column:
    """0-based rank of the lower-nearest quantile over `total` rows: int((n - 1) * p)."""
    return F.floor((F.col("total") - 1) * lit(p))


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """1-based rank with ties averaged, inside a bounded group."""
    w = Window.partitionBy(*keys).orderBy(x)
    ties = Window.partitionBy(*keys, x)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / lit(2)
