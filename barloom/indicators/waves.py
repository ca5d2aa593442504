"""Retracement levels and five-wave structures over confirmed pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import lit

# fixed values: retracement levels, wave nodes in units of the first wave, legs behind an anchor and its node
LEVELS = (0.0, 0.236, 0.382, 0.5, 0.618, 0.786, 1.0)
NODES = (0.0, 1.0, 0.382, 2.0, 1.382, 2.382)
MODES = {"impulse5": (5, 2.382), "predict3": (3, 2.0)}


def legs(pivots: DataFrame) -> DataFrame:
    """Confirmed pivots with the price of the pivots one, three and five legs before them, null where there is none."""
    w = Window.partitionBy("code").orderBy("n")
    return pivots.withColumns({f"back{k}": F.lag("pivot_price", k).over(w) for k in (1, 3, 5)})


def retracements(pivots: DataFrame) -> DataFrame:
    """(code, day, level, price): levels of the newest leg, known from the day that confirmed its end."""
    df = legs(pivots).filter("back1 IS NOT NULL")
    span = F.col("pivot_price") - F.col("back1")
    points = F.array(*[F.struct(lit(v).alias("level"), (F.col("back1") + span * lit(v)).alias("price")) for v in LEVELS])
    return df.select("code", "day", F.explode(points).alias("x")).select("code", "day", "x.*")


def waves(pivots: DataFrame) -> DataFrame:
    """(code, day, mode, node, price, predicted): ideal five-wave nodes anchored at a pivot and one before it.

    impulse5 spans the last five legs and predicts nothing; predict3 spans the last three, its fourth and fifth nodes
    lie ahead.
    """
    df = legs(pivots)
    modes = []
    for name, (back, coefficient) in MODES.items():
        start, unit = F.col(f"back{back}"), (F.col("pivot_price") - F.col(f"back{back}")) / lit(coefficient)
        nodes = [F.struct(F.lit(name).alias("mode"), F.lit(k).alias("node"), (start + unit * lit(v)).alias("price"), F.lit(k > back).alias("predicted")) for k, v in enumerate(NODES)]
        modes.append(F.when(start.isNotNull(), F.array(*nodes)).otherwise(F.array().cast("array<struct<mode:string,node:int,price:double,predicted:boolean>>")))
    return df.select("code", "day", F.explode(F.concat(*modes)).alias("x")).select("code", "day", "x.*")
