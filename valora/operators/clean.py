"""Standardising and cleaning an export: values with status, rules with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from valora.config import PARAMS, Params
from valora.functions import missing as M, parsing as P

ORDINARY, RESIDENTIAL = ("parking", "shop", "apartment"), ("residential", "apartment")
#: Inputs that would tell a model the answer, whole names or beginnings.
LEAKS = ("total_price", "unit_price", "list_price", "deal_", "post_sale_", "adjusted_price")


def standardised(raw: DataFrame) -> DataFrame:
    """Raw columns stay; each parsed value has its status beside it."""
    area, area_status = M.number(F.col("area_raw"))
    band, total, floor_status = P.floor(F.col("floor_raw"))
    decoration, decoration_status = P.decoration(F.col("decoration_raw"))
    orientation, orientation_status = P.orientation(F.col("orientation_raw"))
    year, year_status = P.year_built(F.col("year_raw"))
    date, precision = P.dated(F.col("date_raw"))
    elevator, basis = P.elevator(F.col("elevator_raw"), total)
    return raw.withColumns({
        "area_value": area, "area_status": area_status, "band": band, "floors": total, "floor_status": floor_status, "decoration": decoration, "decoration_status": decoration_status,
        "orientation": orientation, "orientation_status": orientation_status, "year_built": year, "year_status": year_status, "date_value": date, "date_precision": precision,
        "elevator": elevator, "elevator_basis": basis, "lift_ratio": P.lift_ratio(F.col("ladder_raw")), "unit_value": P.unit_price(F.col("total_price"), area),
    })


def backfilled(std: DataFrame) -> DataFrame:
    """Total floors from the remark where the floor text has none; ``agrees`` is false where both are
    there and lie in different buckets."""
    remark = P.floors_from_remark(F.col("description"))
    return std.withColumns({
        "floors_remark": remark, "floors_final": F.coalesce("floors", remark),
        "floors_source": F.when(F.col("floors").isNotNull(), "floor text").when(remark.isNotNull(), "remark").otherwise("none"),
        "agrees": F.coalesce(P.floor_bucket(F.col("floors")) == P.floor_bucket(remark), F.lit(True)),
    })


def assert_agreed(filled: DataFrame) -> DataFrame:
    """backfilled() rows as they are; raises if floor texts and remarks contradict each other anywhere: what disagrees is
    registered and judged first, never filled over."""
    n = filled.where(~F.col("agrees")).count()
    if n:
        raise ValueError(f"{n} rows whose floors disagree with their remark")
    return filled


def exclusion_reason(params: Params = PARAMS) -> Column:
    """First rule that a standardised row breaks, or null."""
    def outside(c, limits):
        return (F.col(c) < limits[0]) | (F.col(c) > limits[1])

    return (
        F.when(F.col("usage").isin(*ORDINARY), "not ordinary residential").when(F.col("area_value").isNull(), "area unknown").when(F.col("date_precision") != "day", "date not to the day")
        .when(outside("area_value", params.area_range), "area out of range").when(outside("total_price", params.price_range), "price out of range")
        .when(outside("unit_value", params.unit_range), "unit price out of range")
    )


def cleaned(std: DataFrame, params: Params = PARAMS) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and excluded ones with their reason."""
    marked = std.withColumn("reason", exclusion_reason(params))
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def waterfall(std: DataFrame, params: Params = PARAMS) -> DataFrame:
    """Rows by reason; kept rows count as 'kept', so the rows add up to the input."""
    marked = std.select(F.coalesce(exclusion_reason(params), F.lit("kept")).alias("reason"), "total_price")
    return marked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total_price"), 2).alias("total"))


def coverage(std: DataFrame, fields: list[str]) -> DataFrame:
    """Rows by field and status, as shares too."""
    packed = std.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_status").alias("status")) for f in fields])).alias("x"))
    n = packed.groupBy("x.field", "x.status").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy(F.col("field").alias("f")).agg(F.sum("n").alias("all"))
    return n.join(whole, F.col("field") == F.col("f")).select("field", "status", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def attribute_health(filled: DataFrame, fields: list[str]) -> DataFrame:
    """Over backfilled() rows, each measure with its rows and share: of each field the hit rate (readable texts among
    those that say anything), rows whose floors neither the floor text nor the remark gives, and rows in which both are
    there and contradict each other."""
    said = {f: F.col(f"{f}_status") != "MISSING" for f in fields}
    parts = [F.struct(F.lit(f"{f} hit").alias("measure"), (F.col(f"{f}_status") == "PARSED").alias("hit"), said[f].alias("counts")) for f in fields]
    neither = (F.col("floor_status") != "PARSED") & F.col("floors_remark").isNull()
    parts += [F.struct(F.lit(n).alias("measure"), c.alias("hit"), F.lit(True).alias("counts")) for n, c in (("no floors at all", neither), ("floors contradict", ~F.col("agrees")))]
    one = filled.select(F.explode(F.array(*parts)).alias("x")).where("x.counts")
    return one.groupBy("x.measure").agg(F.count(F.lit(1)).alias("rows"), F.count_if("x.hit").alias("n"), F.avg(F.col("x.hit").cast("int")).alias("share"))


def in_population(std: DataFrame, districts: list[str]) -> DataFrame:
    """Rows before and after each filter of the population."""
    flags = std.select(F.col("district").isin(*districts).alias("d"), F.col("usage").isin(*RESIDENTIAL).alias("u"))
    return flags.agg(F.count(F.lit(1)).alias("all_rows"), F.count_if("d").alias("in_district"), F.count_if(F.col("d") & F.col("u")).alias("residential"))


def leak_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.lower().startswith(LEAKS)]


def assert_no_leak(df: DataFrame) -> DataFrame:
    """df as it is; raises if it has a column that model inputs must not have."""
    if found := leak_columns(df.columns):
        raise ValueError(f"inputs would leak the price: {', '.join(found)}")
    return df


#: Model inputs by group; a group's features are a projection, nothing else.
FEATURES = {"base": ["community_id", "block", "area", "sale_month"], "full": ["community_id", "block", "area", "sale_month", "total_floors", "decoration", "orientation", "elevator"]}


def features(df: DataFrame, group: str) -> DataFrame:
    return assert_no_leak(df.select("sale_id", *[c for c in FEATURES[group] if c in df.columns]))


def sensitive(df: DataFrame, key: str, text: str) -> DataFrame:
    """Hits by row and kind; any hit blocks publication."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("long").alias("hits")) for k, p in P.SENSITIVE.items()]
    return df.select(key, F.explode(F.array(*kinds)).alias("x")).select(key, "x.kind", "x.hits").where("hits > 0")


def validated(requests: DataFrame, params: Params = PARAMS) -> DataFrame:
    """Requests with status and reason: first thing that is wrong."""
    reason = (
        F.when(F.col("area").isNull() | F.col("community_id").isNull() | F.col("valuation_date").isNull(), "missing field")
        .when((F.col("area") < params.area_range[0]) | (F.col("area") > params.area_range[1]), "area out of range")
        .when(~F.col("year_built").between(1950, 2026), "year out of range").when(~F.col("usage").isin(*RESIDENTIAL), "usage not covered")
    )
    return requests.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "normal").otherwise("rejected"))
