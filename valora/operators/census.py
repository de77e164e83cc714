"""Census of communities and families, tiers, arrivals, drift, cost and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from valora.config import PARAMS, Params


def _within(as_of: Column, months: int) -> Column:
    return (F.col("sale_date") > F.add_months(as_of, -months)) & (F.col("sale_date") <= as_of)


def measures(as_of: Column) -> list[Column]:
    """Counts of 3, 6 and 12 months, last sale, 12-month median, first sale: counts are 0 and the others
    null where nothing was sold."""
    return [
        *[F.count_if(_within(as_of, m)).alias(f"cases_{m}m") for m in (3, 6, 12)], F.max(F.when(F.col("sale_date") <= as_of, F.col("sale_date"))).alias("last_sale"),
        F.percentile(F.when(_within(as_of, 12), F.col("unit_price")), 0.5).alias("median_12m"), F.min("sale_date").alias("sample_start"),
    ]


def census(frame: DataFrame, sales: DataFrame, key: str, as_of: Column) -> DataFrame:
    """One row for every entity of the frame, those without sales too."""
    by = sales.groupBy(F.col(key).alias("__k")).agg(*measures(as_of))
    out = frame.join(by, F.col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumns({f"cases_{m}m": F.coalesce(f"cases_{m}m", F.lit(0).cast("long")) for m in (3, 6, 12)})


def family_census(sales: DataFrame, family: str, member: str, as_of: Column) -> DataFrame:
    """Families and their members in one table; a sale counts once for its family, however often its
    member was merged, as it has one family."""
    one = sales.select("sale_date", "unit_price", F.col(family).alias("family"), F.explode(F.array(F.lit(None).cast(sales.schema[member].dataType), F.col(member))).alias("member"))
    return one.groupBy("family", "member").agg(*measures(as_of))


def tier(cases: Column, boundary: Column, in_scope: Column, params: Params = PARAMS) -> Column:
    """Mechanical: by the count alone; a pending boundary is reference at best, out of scope is rejected."""
    return (
        F.when(~in_scope, "reject").when((cases >= params.include_at) & (boundary == "confirmed"), "include").when(cases >= params.reference_at, "reference").otherwise("reject")
    )


def draft_tier(cases: Column, boundary: Column, incumbent: Column, params: Params = PARAMS) -> Column:
    """Draft: incumbents stay, others go through the boundary gate."""
    return F.when(incumbent, "include").when(boundary != "confirmed", "pending boundary").when(cases >= params.include_at, "include").when(cases >= params.reference_at, "reference").otherwise("reject")


def arrival(batch: DataFrame, previous: DataFrame, key: str, value: str, date: str) -> DataFrame:
    """What a batch brings against the one before: new and revised keys, repeats, the newest day."""
    b = batch.groupBy(F.col(key).alias("__b")).agg(F.count(F.lit(1)).alias("rows"), F.max(value).alias("now"), F.max(date).alias("newest"))
    p = previous.groupBy(F.col(key).alias("__p")).agg(F.max(value).alias("was"))
    j = b.join(p, F.col("__b") == F.col("__p"), "left")
    return j.agg(F.sum("rows").alias("rows"), F.count_if(F.col("__p").isNull()).alias("new_keys"), F.count_if(F.col("__p").isNotNull() & ~F.col("now").eqNullSafe(F.col("was"))).alias("revised"), F.sum(F.col("rows") - 1).alias("repeats"), F.max("newest").alias("newest"))


def freshness(batch: DataFrame, date: str, as_of: Column, recent_days: int = 90) -> DataFrame:
    """How recent a batch is: rows of the last days before a date, their share, and days since the newest row."""
    recent = F.col(date).between(F.date_sub(as_of, recent_days), as_of)
    return batch.agg(F.count_if(recent).alias("recent"), F.avg(recent.cast("int")).alias("recent_share"), F.datediff(as_of, F.max(date)).alias("stale_days"))


def registry_check(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """Experiment accounting: planned (kind, units) against the runs (kind, unit) that took place. Units that ran twice
    count once; runs of kinds that were not planned, such as quality checks, stand by themselves with no number wanted."""
    done = runs.groupBy("kind").agg(F.count_distinct("unit").alias("n"), F.count(F.lit(1)).alias("runs")).withColumnRenamed("kind", "__k")
    j = planned.groupBy("kind").agg(F.sum("units").alias("want")).join(done, F.col("kind") == F.col("__k"), "full_outer")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return j.select(F.coalesce("kind", "__k").alias("kind"), "want", n.alias("n"), F.coalesce("runs", F.lit(0).cast("long")).alias("runs"), F.coalesce(F.col("want") == n, F.col("want").isNull()).alias("ok"))


def drift(current: DataFrame, history: DataFrame) -> DataFrame:
    """current: community_id, current_block (null if missing); history: community_id, block. Rows by category,
    and whether more than half have drifted."""
    known = history.select(F.col("community_id").alias("__c"), F.col("block").alias("__b")).distinct()
    j = current.join(known, (F.col("community_id") == F.col("__c")) & (F.col("current_block") == F.col("__b")), "left")
    category = F.when(F.col("current_block").isNull(), "missing").when(F.col("__b").isNotNull(), "consistent").otherwise("drifted")
    by = j.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    whole = by.agg((F.sum(F.when(F.col("category") == "drifted", F.col("n")).otherwise(0)) / F.sum("n") > 0.5).alias("escalate"))
    return by.crossJoin(F.broadcast(whole))  # one row on the right


def feedback(rows: DataFrame, branch: str, at: str) -> DataFrame:
    """By branch and calendar month, with the months that are not over yet marked."""
    by = rows.groupBy(F.col(branch).alias("branch"), F.date_trunc("month", F.col(at)).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max(at).alias("__last"))
    last = by.agg(F.max("__last").alias("__newest"))
    return by.crossJoin(F.broadcast(last)).withColumn("mature", F.add_months("month", 1) <= F.to_date("__newest")).drop("__last", "__newest")  # one row on the right


def missing_by_month(rows: DataFrame, date: str, fields: list[str]) -> DataFrame:
    return rows.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).isNull().cast("int")).alias(f"{f}_missing") for f in fields])


def running_cost(attempts: DataFrame, day: str, cost: str, limit: float) -> DataFrame:
    """Cost by day and in total up to it, and whether work goes on after it. Days are few: one row each."""
    daily = attempts.groupBy(F.col(day).alias("day")).agg(F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("attempts"))
    total = F.sum("cost").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return daily.withColumn("running", total).withColumn("go_on", F.col("running") <= limit)


def attempt_times(log: DataFrame) -> DataFrame:
    """queued_at, started_at, ended_at by kind: waiting and working times."""
    wait = F.unix_micros("started_at") - F.unix_micros("queued_at")
    work = F.unix_micros("ended_at") - F.unix_micros("started_at")
    return log.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.percentile(wait / 1000, 0.5).alias("wait_p50"), F.percentile(work / 1000, 0.5).alias("work_p50"), F.percentile(work / 1000, 0.9).alias("work_p90"))
