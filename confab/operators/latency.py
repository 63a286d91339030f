"""Quantiles of stage latencies from sketches that are stored by hour and merged.

A sketch is a histogram with bins of equal ratio: a duration of d falls into bin ceil(log d) to the base ``GAMMA``, and a bin stands for
one value that none of its durations is further from than ``error``, in proportion. Counts of bins add up, so sketches of hours,
batches or machines merge by a sum, in any order, and give the same quantiles as one of everything. A stage has a few hundred
bins however many messages there are: durations up to a day make some 940 at one percent.

Defined cases: a duration of 0 or less is bin -1, whose value is 0; traces without a duration are left out; a quantile is the duration
of rank ceil(q * n), the smallest one for q = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Error of a quantile in proportion, and what it makes the ratio of bins.
ERROR = 0.01
GAMMA = (1 + ERROR) / (1 - ERROR)
KEYS = ["hour", "stage"]


def bin_of(duration: Column) -> Column:
    return F.when(duration <= 0, F.lit(-1)).otherwise(F.ceil(F.ln(duration.cast("double")) / F.ln(F.lit(GAMMA)))).cast("int")


def bin_value(number: Column) -> Column:
    return F.when(number < 0, F.lit(0.0)).otherwise(2.0 * F.pow(F.lit(GAMMA), number.cast("double")) / (GAMMA + 1.0))


def sketches(traces: DataFrame) -> DataFrame:
    """hour, stage, bin and n of traces (stage, started_at, duration_ms)."""
    rows = traces.where(F.col("duration_ms").isNotNull()).select(F.date_trunc("hour", "started_at").alias("hour"), "stage", bin_of(F.col("duration_ms")).alias("bin"))
    return rows.groupBy(*KEYS, "bin").agg(F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """One sketch of several."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*KEYS, "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, shares: dict[str, float] | None = None, by: list[str] | None = None) -> DataFrame:
    """n and the named quantiles for each of ``by`` (stages); what is not in ``by`` is merged."""
    shares = {"p50": 0.5, "p95": 0.95} if shares is None else shares
    by = ["stage"] if by is None else by
    bins = sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*by).orderBy("bin")
    ranked = bins.withColumns({"upto": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)), "all": F.sum("n").over(W.partitionBy(*by))})
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * q)), F.col("bin")))
    found = ranked.groupBy(*by).agg(F.sum("n").alias("n"), *(at(q).alias(f"_{name}") for name, q in shares.items()))
    return found.select(*by, "n", *(bin_value(F.col(f"_{name}")).alias(name) for name in shares))
