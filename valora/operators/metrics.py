"""Metrics, calibration, bootstrap and verdicts over predictions.

Predictions have prediction and actual; rows without a prediction stay in every
denominator as not covered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from valora.config import PARAMS, Params
from valora.functions import draws
from valora.operators.quantiles import exact_quantiles, with_quantiles
from valora.sources import scratch


def errors(df: DataFrame) -> DataFrame:
    signed = F.try_divide(F.col("prediction") - F.col("actual"), F.col("actual"))
    return df.withColumns({"signed": signed, "ape": F.abs(signed)})


def pack(predictions: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """The metrics over predictions and actuals, of all rows or by group; groups may be of any size."""
    e, groups = errors(predictions), groups or []
    known = lambda flag: F.avg(F.when(F.col("ape").isNotNull(), flag.cast("int")))
    counts = e.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        known(F.col("ape") <= 0.1).alias("hit10"),
        known(F.col("signed") > 0.2).alias("over20"),
        F.avg(F.col("prediction").isNotNull().cast("int")).alias("coverage"),
    )
    return with_quantiles(counts, e, groups, {"medape": ("ape", 0.5), "p90": ("ape", 0.9), "bias": ("signed", 0.5)})


def by_groups(df: DataFrame, groups: list[str], params: Params = PARAMS) -> DataFrame:
    """The metrics of every value of every group, each group by itself, with a flag for few rows."""
    one = df.select("prediction", "actual", F.explode(F.array(*[F.struct(F.lit(g).alias("by"), F.col(g).cast("string").alias("value")) for g in groups])).alias("g"))
    return pack(one.select("prediction", "actual", "g.by", "g.value"), ["by", "value"]).withColumn("low_power", F.col("n") < params.low_power_n)


def calibrated(residuals: DataFrame, least: int, quantiles: tuple[float, float]) -> DataFrame:
    """Empirical residual quantiles by layer, with the residuals' source and number. residuals: state, part, source,
    residual. Layers are <state>|<part>, <state>|global, which takes in the parts with fewer than ``least`` rows, and
    global; a state's row is left out only if it has too few rows itself."""
    layers = F.array(F.concat_ws("|", "state", "part"), F.concat(F.col("state"), F.lit("|global")), F.lit("global"))
    one = residuals.select(F.explode(layers).alias("layer"), "source", "residual")
    sources = one.groupBy("layer").agg(F.array_join(F.sort_array(F.collect_set("source")), "+").alias("residual_source"))  # a few names
    table = exact_quantiles(one, ["layer"], "residual", {"q_lo": quantiles[0], "q_hi": quantiles[1]})
    table = table.join(sources.withColumnRenamed("layer", "__l"), F.col("layer") == F.col("__l")).drop("__l")
    return table.where((F.col("n") >= least) | (F.col("layer") == "global"))


def with_interval(df: DataFrame, table: DataFrame, layer: str) -> DataFrame:
    """lo and hi from the row's own layer, else from the part of its layer before '|' with global, else global."""
    names = [F.col(layer), F.concat(F.element_at(F.split(layer, r"\|"), 1), F.lit("|global")), F.lit("global")]
    out = df
    for k, name in enumerate(names):
        t = table.select(F.col("layer").alias(f"__l{k}"), F.col("q_lo").alias(f"__a{k}"), F.col("q_hi").alias(f"__b{k}"))
        out = out.withColumn(f"__name{k}", name).join(t, F.col(f"__name{k}") == F.col(f"__l{k}"), "left")
    used = F.coalesce("__l0", "__l1", "__l2")
    out = out.withColumns({"used_layer": used, "lo": F.col("prediction") * F.exp(F.coalesce("__a0", "__a1", "__a2")), "hi": F.col("prediction") * F.exp(F.coalesce("__b0", "__b1", "__b2"))})
    return out.drop(*[f"__{c}{k}" for k in range(3) for c in ("name", "l", "a", "b")])


def interval_report(df: DataFrame, groups: list[str]) -> DataFrame:
    """Coverage (bounds belong to the interval, up to rounding) and median relative width, by group."""
    rows = df.withColumn("__width", (F.col("hi") - F.col("lo")) / F.col("prediction"))
    inside = F.col("actual").between(F.col("lo") * (1 - 1e-9), F.col("hi") * (1 + 1e-9)).cast("int")
    return with_quantiles(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("coverage")), rows, groups, {"width": ("__width", 0.5)})


def widened(table: DataFrame, rank: str) -> DataFrame:
    """Widths that never shrink from stronger to weaker evidence: a running maximum along the rank."""
    w = W.orderBy(rank).rowsBetween(W.unboundedPreceding, 0)  # one row per layer
    return table.withColumn("width", F.max("width").over(w))


def draw(key: Column, replicate: Column, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) for a unit and a replicate: the first 32 bits of the MD5 of both and the
    seed, so that draws of different units and replicates have nothing to do with each other."""
    text = F.concat_ws(":", key.cast("string"), replicate.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0


#: P(count <= k) of a Poisson count with mean one; beyond the last one there is no draw, as they are multiples of 2 ** -32.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def poisson_count(u: Column) -> Column:
    """How often a unit is drawn, Poisson with mean one, from a number in [0, 1)."""
    return sum(((u >= c).cast("int") for c in POISSON), F.lit(0))


#: Draws for a task of a bootstrap, at most and, where there are fewer tasks than cores, at least: some seconds' work.
TASK_DRAWS, LEAST_DRAWS = 1 << 27, 1 << 22


def bootstrap(df: DataFrame, unit: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Replicate means of a paired difference, units drawn with replacement. Units are added up first, so
    that the replicates multiply units and not rows, and a task adds up its units' draws, the numbers of draw(), by
    replicate, so that draws are never rows. Rows without a unit take no part."""
    by = df.groupBy(F.col(unit).cast("string").alias("unit")).agg(F.sum(value).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))
    by = scratch.cut(by.where(F.col("unit").isNotNull()), "units")
    n = by.count() * replicates
    tasks = max(1, -(-n // TASK_DRAWS), min(by.sparkSession.sparkContext.defaultParallelism, n // LEAST_DRAWS))

    def run(batches):
        out, known = 0.0, None
        for batch in _gathered(batches, draws.AT_ONCE):
            text = batch.column(0).cast(pa.large_binary())
            at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            some = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            known = bool(known) or bool(some.any())
            values = np.column_stack([np.where(some, batch.column(1).to_numpy(zero_copy_only=False), 0.0), batch.column(2).to_numpy()])
            out = out + draws.drawn_sums(raw, at, values, replicates, seed, POISSON)
        if known is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(out[:, 0], mask=np.full(replicates, not known)), pa.array(out[:, 1])], names=["replicate", "total", "n"])

    drawn = by.repartition(tasks).mapInArrow(run, "replicate int, total double, n double")
    return drawn.groupBy("replicate").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))


def _gathered(batches, least: int):
    """Batches joined into ones of ``least`` rows or more, but for the last one."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def envelope(parts: list[DataFrame]) -> DataFrame:
    """The outer bounds of several bootstraps' central 95 %."""
    out = None
    for k, p in enumerate(parts):
        b = p.agg(F.percentile("mean", 0.025).alias(f"lo{k}"), F.percentile("mean", 0.975).alias(f"hi{k}"))
        out = b if out is None else out.crossJoin(b)  # one row each
    return out.select(F.least(*[F.col(f"lo{k}") for k in range(len(parts))]).alias("lo"), F.greatest(*[F.col(f"hi{k}") for k in range(len(parts))]).alias("hi"))


def selected(scores: DataFrame, by: str) -> DataFrame:
    """The configuration with the best inner score in each fold; equal scores go to the first one."""
    return scores.groupBy(by).agg(F.min(F.struct("score", "config")).alias("best")).select(by, "best.config", "best.score")


#: Published limits of the layout value test: share of zero differences, no-ops and so on.
POWER_LIMITS = {"zero_share": 0.5, "noop_rate": 0.3, "coverage": 0.5, "effect": 0.02, "n": 30}


def power_gate(df: DataFrame) -> DataFrame:
    """df: difference, changed, covered. Whether the comparison can tell anything, against POWER_LIMITS."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("difference") == 0).cast("int")).alias("zero_share"), F.avg((~F.col("changed")).cast("int")).alias("noop_rate"), F.avg(F.col("covered").cast("int")).alias("coverage"), F.avg("difference").alias("effect"))
    p = POWER_LIMITS
    enough = (F.col("n") >= p["n"]) & (F.col("zero_share") <= p["zero_share"]) & (F.col("noop_rate") <= p["noop_rate"]) & (F.col("coverage") >= p["coverage"])
    return out.withColumn("conclusion", F.when(~enough, "EVIDENCE_INSUFFICIENT").when(F.abs("effect") >= p["effect"], "CANDIDATE_INTEGRATION").otherwise("NO_VALUE"))


def expanded_verdict(first: DataFrame, second: DataFrame) -> DataFrame:
    """The one pre-registered expansion: metrics whose first verdict is at the edge are judged once more over the
    enlarged sample, then with pass or return only; both verdicts stay. first, second: as verdict() gives them."""
    s = second.select(F.col("metric").alias("__m"), F.col("value").alias("expanded_value"), F.col("met").alias("__met"))
    edge = F.col("verdict") == "insufficient/edge"
    out = first.join(s, F.col("metric") == F.col("__m"), "left")
    final = F.when(~edge, F.col("verdict")).when(F.coalesce("__met", F.lit(False)), "pass").otherwise("return")
    return out.withColumns({"expanded_value": F.when(edge, F.col("expanded_value")), "final": final}).drop("__m", "__met")


def verdict(measured: DataFrame, thresholds: DataFrame, params: Params = PARAMS) -> DataFrame:
    """measured: metric, value, n; thresholds: metric, limit, at_most. Met or not, and hard or at the edge."""
    j = measured.join(thresholds.withColumnRenamed("metric", "__m"), F.col("metric") == F.col("__m")).drop("__m")
    met = F.when(F.col("at_most"), F.col("value") <= F.col("limit")).otherwise(F.col("value") >= F.col("limit"))
    edge = (F.abs(F.col("value") - F.col("limit")) < params.verdict_edge) | (F.col("n") < params.verdict_n)
    return j.withColumns({"met": met, "verdict": F.when(edge, "insufficient/edge").when(met, "pass").otherwise("return")})


def stratified_sample(df: DataFrame, stratum: str, key: str, seed: str, n: int) -> DataFrame:
    """The n rows of each stratum with the smallest digests of key and seed."""
    w = W.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def chronological_split(df: DataFrame, cluster: str, date: str, share: float = 0.7) -> DataFrame:
    """Clusters by their first date: the first ``share`` of them develop, the rest confirm. Numbers come from
    counts per day, so no task orders all clusters."""
    first = df.groupBy(cluster).agg(F.min(date).alias("first"))
    daily = first.groupBy(F.col("first").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    running = W.orderBy("d").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    daily = daily.withColumns({"earlier": F.coalesce(F.sum("n").over(running), F.lit(0)), "all": F.sum("n").over(W.partitionBy())}).drop("n")
    nth = F.row_number().over(W.partitionBy("first").orderBy(cluster))
    placed = first.withColumn("nth", nth).join(daily, F.col("first") == F.col("d"))
    return placed.select(cluster, "first", F.when(F.col("earlier") + F.col("nth") <= F.floor(F.col("all") * share), "develop").otherwise("confirm").alias("part"))
