"""Exact quantiles of very large groups.

``percentile`` holds a group's distinct values in one task. Here a sketch with a
bounded error first gives, for each wanted quantile, two values that it must lie
between, MARGIN of the ranks to either side. Rows below are only counted, rows
between are counted by value, and the running counts of these few values say
which ones have the wanted ranks. Outliers change nothing, as ranges are made of
ranks. Everything before the last step is combined by task; the last step orders
about 2 * MARGIN of a group's values in one task, and less where values repeat.

Groups of up to WHOLE rows have all their values between, so nothing depends on
the sketch where ranks are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from valora.sources import scratch

#: The sketch's error is a tenth of the margin, so that it is small where there are many groups.
ACCURACY, MARGIN, WHOLE = 2000, 0.005, 2000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, n and the interpolated quantiles of each group's values, as ``percentile`` gives them; nulls leave
    the sample, and a group without any value is not in the result. Without keys all rows are one group."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = [max(0.0, q - MARGIN) for q in quantiles.values()] + [min(1.0, q + MARGIN) for q in quantiles.values()]
    edges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.percentile_approx("__v", ends, ACCURACY).alias("__ends"))
    edges = edges.where("n > 0").withColumnsRenamed({k: f"__{k}" for k in keys})
    small = F.col("n") <= WHOLE
    asked = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            F.when(small | F.lit(q <= MARGIN), F.col("__least")).otherwise(F.col("__ends")[k]).alias("lo"),
            F.when(small | F.lit(q >= 1 - MARGIN), F.col("__most")).otherwise(F.col("__ends")[k + len(quantiles)]).alias("hi"),
        )
        for k, q in enumerate(quantiles.values())
    ])
    edges = edges.select(*[f"__{k}" for k in keys], "n", asked.alias("__asked"))
    if keys:
        # written, so that the planner knows their size and, where there are few, doesn't shuffle the rows to meet them
        edges = scratch.cut(edges, "edges")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        placed = rows.join(edges, same)
    else:
        placed = rows.crossJoin(F.broadcast(edges))  # one row on the right
    placed = placed.select(*keys, "n", "__v", F.explode("__asked").alias("__q")).where(F.col("__v") <= F.col("__q.hi"))
    # a null value stands for all values below the range
    counts = placed.groupBy(*keys, "n", F.col("__q.k").alias("__nth"), F.when(F.col("__v") >= F.col("__q.lo"), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__count"))
    upto = F.sum("__count").over(W.partitionBy(*keys, "__nth").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumn("__upto", upto)
    at = F.element_at(F.array(*[F.lit(float(q)) for q in quantiles.values()]), F.col("__nth") + 1) * (F.col("n") - 1)
    first = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))
    below = F.max(F.when(F.col("__v").isNull(), F.col("__upto")).otherwise(0))
    found = counts.withColumn("__at", at).groupBy(*keys, "n", "__nth", "__at").agg(first(F.floor("__at")).alias("__low"), first(F.ceil("__at")).alias("__high"), below.alias("__below"))
    part = F.col("__at") - F.floor("__at")
    missed = F.raise_error(F.lit("a wanted rank lies outside the range that the sketch gave")).cast("double")
    x = F.when(F.col("__high").isNull() | (F.col("__below") > F.floor("__at")), missed).otherwise(F.col("__low") + (F.col("__high") - F.col("__low")) * part)
    found = found.withColumn("__x", x)
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("__nth") == k, F.col("__x"))).alias(name) for k, name in enumerate(quantiles)])


def with_quantiles(counts: DataFrame, rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """counts (a row for each group of keys) with exact quantiles of columns of rows: name -> (column, share). Groups may
    be of any size."""
    out = counts
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        q = exact_quantiles(rows, keys, column, {name: share for name, (c, share) in wanted.items() if c == column}).drop("n")
        q = q.withColumnsRenamed({k: f"__{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
        out = out.join(q if keys else F.broadcast(q), same, "left").drop(*[f"__{k}" for k in keys])  # without keys one row on the right
    return out
