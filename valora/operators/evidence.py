"""Evidence known before a date: windows, levels, pools, folds.

A window holds the ``days`` before a date and not the date itself, as the order
within a day is unknown; so a sale is never evidence for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from valora.config import PARAMS
from valora.operators.quantiles import exact_quantiles
from valora.operators.windows import pooled_medians, with_medians
from valora.sources import scratch
from valora.sources.tables import day

LEVELS = ("community", "block", "district")
KEYS = {"community": "community_id", "block": "block", "district": "district"}


def before(sales: DataFrame, cutoff: Column, days: int = PARAMS.evidence_days) -> DataFrame:
    return sales.where((F.col("sale_date") >= F.date_sub(cutoff, days)) & (F.col("sale_date") < cutoff))


def level_medians(sales: DataFrame, cutoff: Column, level: str, days: int = PARAMS.evidence_days) -> DataFrame:
    """key, median unit price and number of cases of one level, in the window before the cutoff. Blocks and districts
    are few, whatever the number of sales: their medians don't hold a group in one task."""
    named = before(sales, cutoff, days).select(F.col(KEYS[level]).alias(f"{level}_key"), "unit_price")
    if level == "community":
        return named.groupBy("community_key").agg(F.percentile("unit_price", 0.5).alias("community_median"), F.count(F.lit(1)).alias("community_n"))
    return exact_quantiles(named, [f"{level}_key"], "unit_price", {f"{level}_median": 0.5}).withColumnRenamed("n", f"{level}_n")


def with_fallback(targets: DataFrame, sales: DataFrame, cutoff: Column, days: int = PARAMS.evidence_days) -> DataFrame:
    """targets with the median of the narrowest level that has evidence, and that level's name.
    The three levels are aggregated from one read of the window; the joins' small sides are left to the planner."""
    out = targets
    for level in LEVELS:
        m = level_medians(sales, cutoff, level, days)
        out = out.join(m, out[KEYS[level]] == m[f"{level}_key"], "left").drop(f"{level}_key")
    level = F.when(F.col("community_median").isNotNull(), "community").when(F.col("block_median").isNotNull(), "block").when(F.col("district_median").isNotNull(), "district").otherwise("none")
    return out.withColumns({"baseline": F.coalesce(*[F.col(f"{x}_median") for x in LEVELS]), "level": level})


def rolling_median(sales: DataFrame, key: str, days: int = PARAMS.evidence_days) -> DataFrame:
    """Each sale with the median and number of its key's earlier sales, up to ``days`` back. A key is split by calendar
    years, each with the sales before it that its windows reach; sales of one day share their window, so the work is
    days times a window's sales."""
    year = F.year("sale_date")
    reach = sales.withColumn("__year", F.explode(F.sequence(year, year + -(-days // 365))))
    w = W.partitionBy(key, "__year").orderBy(F.unix_date("sale_date")).rangeBetween(-days, -1)
    out = reach.withColumns({"rolling_median": F.percentile("unit_price", 0.5).over(w), "rolling_n": F.count("unit_price").over(w)})
    return out.where(F.col("__year") == year).drop("__year")


def windowed(targets: DataFrame, sales: DataFrame, end: Column, days: int = PARAMS.evidence_days) -> DataFrame:
    """targets with baseline, the median of the sales in the ``days`` before end (an expression of theirs) of the narrowest
    level that has any, and level. Communities are answered where their sales are; blocks and districts only for the
    rows that no narrower level covers, once a day. No sale is written out by window."""
    first = scratch.cut(with_medians(targets, sales, KEYS["community"], end, "__community", days).drop("__community_n"), "windows")
    named = lambda df, level: df.withColumns({"baseline": level, "level": F.lit(None).cast("string")})
    pool = first if targets is sales else sales
    done = named(first.where(F.col("__community").isNotNull()), F.col("__community")).withColumn("level", F.lit("community"))
    rest, found = first.where(F.col("__community").isNull()), []
    for level in LEVELS[1:]:
        key, name = KEYS[level], f"__{level}"
        need = rest.where(F.coalesce(*found).isNull()) if found else rest
        m = pooled_medians(pool, need.select(F.col(key).alias("__k"), end.alias("__c")).distinct(), key, days, name)
        rest = rest.join(m, (F.col(key) == F.col("__k")) & (end == F.col("__c")), "left").drop("__k", "__c")
        found.append(F.col(name))
    level = F.when(F.col("__block").isNotNull(), "block").when(F.col("__district").isNotNull(), "district").otherwise("none")
    rest = named(rest, F.coalesce(*found)).withColumn("level", level).drop("__block", "__district")
    return done.unionByName(rest).drop("__community")


def rolling_fallback(targets: DataFrame, sales: DataFrame, days: int = PARAMS.evidence_days) -> DataFrame:
    """windowed() before each target's own date."""
    return windowed(targets, sales, F.col("sale_date"), days)


def monthly_reach(days: int = PARAMS.evidence_days) -> Column:
    """The first days of months for which a sale lies in the ``days`` before; at most thirteen for a year."""
    months = F.sequence(F.add_months(F.trunc("sale_date", "MM"), 1), F.trunc(F.date_add("sale_date", days), "MM"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: m.cast("date"))


def half_start(date: Column) -> Column:
    """First day of a date's half-year."""
    return F.make_date(F.year(date), F.when(F.month(date) > 6, 7).otherwise(1), F.lit(1))


def half_reach() -> Column:
    """The first days of half-years for which a sale lies in the year before."""
    starts = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.add_months(half_start(F.col("sale_date")), k * 6))
    return F.filter(starts, lambda d: d <= F.date_add(F.col("sale_date"), PARAMS.evidence_days))


def baseline_at(targets: DataFrame, sales: DataFrame, cutoff: Column, reach: Column | None = None) -> DataFrame:
    """targets with baseline and level as with_fallback gives them, each for a cutoff of its own. reach, the cutoffs that a
    sale is evidence for, is what the days before a cutoff say too: it is not read."""
    return windowed(targets, sales, cutoff)


def monthly_baseline(targets: DataFrame, sales: DataFrame) -> DataFrame:
    """baseline_at the first day of each target's own month."""
    return baseline_at(targets, sales, F.trunc("sale_date", "MM"), monthly_reach())


def earlier_sales(sales: DataFrame, key: str) -> DataFrame:
    """Each sale that has earlier ones of its key, with their number, last date and mean price: running totals over the
    key's days, so that no pairs are made."""
    daily = sales.groupBy(F.col(key).alias("__k"), F.col("sale_date").alias("__d")).agg(F.count(F.lit(1)).alias("__n"), F.sum("unit_price").alias("__s"))
    w = W.partitionBy("__k").orderBy("__d").rowsBetween(W.unboundedPreceding, -1)
    daily = daily.select("__k", "__d", F.sum("__n").over(w).alias("n"), F.max("__d").over(w).alias("nearest"), (F.sum("__s").over(w) / F.sum("__n").over(w)).alias("mean_price"))
    return sales.join(daily.where("n > 0"), (F.col(key) == F.col("__k")) & (F.col("sale_date") == F.col("__d"))).drop("__k", "__d")


def fold_cases(sales: DataFrame, folds: DataFrame, cap: int, days: int = PARAMS.evidence_days) -> DataFrame:
    """fold, target_id, sale_id, level: each validation row of a fold with the newest ``cap`` sales in the ``days`` before
    the fold's cutoff, of its community, or of its block where the community has none; a target without any has one row
    with a null case. As all targets of a key share their cases, cases are numbered by fold and key."""
    few = F.broadcast(folds)  # a handful of dates, from the calendar alone
    targets = sales.join(few, (F.col("sale_date") >= F.col("lo")) & (F.col("sale_date") < F.col("hi"))).select("fold", F.col("sale_id").alias("target_id"), *KEYS.values())
    known = sales.join(few.drop("hi"), (F.col("sale_date") < F.col("lo")) & (F.col("sale_date") >= F.date_sub("lo", days)))
    out, rest = None, targets
    for level in ("community", "block"):
        key = KEYS[level]
        newest = F.row_number().over(W.partitionBy("fold", key).orderBy(F.desc("sale_date"), "sale_id"))
        cases = known.select("fold", key, "sale_date", "sale_id").withColumn("__n", newest).where(F.col("__n") <= cap).select(F.col("fold").alias("__f"), F.col(key).alias("__k"), "sale_id")
        same = (F.col("fold") == F.col("__f")) & (F.col(key) == F.col("__k"))
        one = rest.join(cases, same).select("fold", "target_id", "sale_id", F.lit(level).alias("level"))
        out = one if out is None else out.unionByName(one)
        rest = rest.join(cases.select("__f", "__k").distinct(), same, "left_anti")
    return out.unionByName(rest.select("fold", "target_id", F.lit(None).cast("string").alias("sale_id"), F.lit("uncovered").alias("level")))


def outer_inputs(sales: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from, rolled to their own date, without those that have no evidence, and rows to judge by, which see
    the cutoff only: the sales' columns with baseline and level."""
    early = sales.where(F.col("sale_date") < cutoff)
    return rolling_fallback(early, early).where(F.col("baseline").isNotNull()), with_fallback(sales.where(F.col("sale_date") >= cutoff), sales, cutoff)


def market_inputs(sales: DataFrame, cutoff: Column, inner_months: int = 3) -> DataFrame:
    """sale_id, layer, kind, market, level: the four kinds of market input of a fold. Rows that a model learns from roll
    to their own date (outer train, inner fit), rows that it is judged on see their layer's cutoff only (outer validate,
    inner select: the last ``inner_months`` of the training slice). All go from community to block to district; rows to
    learn from that have no evidence leave."""
    inner = F.add_months(cutoff, -inner_months)
    sales = sales.select("sale_id", "sale_date", "unit_price", *KEYS.values())
    train, validate = outer_inputs(sales, cutoff)
    parts = [("outer", "train", train), ("inner", "fit", train.where(F.col("sale_date") < inner)), ("outer", "validate", validate)]
    parts += [("inner", "select", with_fallback(sales.where((F.col("sale_date") >= inner) & (F.col("sale_date") < cutoff)), sales, inner))]
    out = None
    for layer, kind, rows in parts:
        one = rows.select("sale_id", F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), F.col("baseline").alias("market"), "level")
        out = one if out is None else out.unionByName(one)
    return out


def monthly_index(sales: DataFrame, key: str, base: Column, least: int = 5) -> DataFrame:
    """Median of each month and key over that of the base month; 1 where either has under ``least`` cases."""
    m = exact_quantiles(sales.select(key, F.trunc("sale_date", "MM").alias("month"), "unit_price"), [key, "month"], "unit_price", {"median": 0.5})
    b = m.where(F.col("month") == F.trunc(base, "MM")).select(F.col(key).alias("__k"), F.col("median").alias("base_median"), F.col("n").alias("base_n"))
    enough = (F.col("n") >= least) & (F.col("base_n") >= least)
    return m.join(b, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("index", F.when(enough, F.col("median") / F.col("base_median")).otherwise(1.0)).drop("base_n")


def folds(spark, first: str, last: str, months: int = 6) -> DataFrame:
    """Rolling development folds: train before lo, validate in [lo, hi)."""
    starts = spark.range(1).select(F.explode(F.sequence(day(first), day(last), F.expr(f"interval {months} months"))).alias("lo"))
    return starts.select(F.date_format("lo", "yyyy-MM").alias("fold"), F.col("lo"), F.add_months("lo", months).cast("date").alias("hi"))


def half_year(date: Column) -> Column:
    return F.year(date) * 2 + F.when(F.month(date) > 6, 1).otherwise(0)


def forward_counts(sales: DataFrame, key: str) -> DataFrame:
    """Each half year and key with what lies in earlier half years only."""
    by = sales.groupBy(key, half_year(F.col("sale_date")).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.sum("unit_price").alias("total"))
    w = W.partitionBy(key).orderBy("half").rowsBetween(W.unboundedPreceding, -1)
    return by.withColumns({"earlier_n": F.coalesce(F.sum("n").over(w), F.lit(0)), "earlier_mean": F.sum("total").over(w) / F.sum("n").over(w)})


def first_block(sales: DataFrame) -> DataFrame:
    """A community's block by sort, and whether it has several."""
    return sales.groupBy("community_id").agg(F.min("block").alias("block"), (F.count_distinct("block") > 1).alias("ambiguous"))
