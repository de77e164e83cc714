"""Adapters from the driver's tables to the domain: sales, requests, names, annotations.

Schemas are read from the files; columns are picked here, so scans read no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale events: community is the part, block its brand, district its type. Floor band, building year and elevator
    are made from the order line by fixed rules, with gaps."""
    q = F.col("l_quantity")
    band = F.element_at(F.array(F.lit("low"), F.lit("middle"), F.lit("high")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    line = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("sale_id"),
        F.col("l_partkey").alias("community_id"),
        q.alias("area"),
        F.col("l_extendedprice").alias("total_price"),
        (F.col("l_extendedprice") / q).alias("unit_price"),
        F.to_date("l_shipdate").alias("sale_date"),
        (F.col("l_suppkey") % 4).alias("source_rank"),
        F.col("l_returnflag").alias("decoration"),
        F.col("l_linestatus").alias("orientation"),
        F.when(F.col("l_linenumber") != 7, band).alias("floor_band"),
        F.when(q % 7 != 0, (1960 + F.col("l_orderkey") % 60).cast("int")).alias("year_built"),
        F.when(q % 9 != 0, F.col("l_suppkey") % 2 == 0).alias("elevator"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_orderkey").alias("home_id"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("community_id"), F.col("p_brand").alias("block"), F.col("p_type").alias("district"), F.col("p_size").alias("total_floors")
    )
    return line.join(part, "community_id")


#: The same view for the SQL side.
SALE_SQL = """sale AS (
    SELECT concat_ws('-', l_orderkey, l_partkey, strftime(l_shipdate, '%Y%m%d')) AS sale_id, l_partkey AS community_id, l_quantity AS area,
        l_extendedprice AS total_price, l_extendedprice / l_quantity AS unit_price, CAST(l_shipdate AS DATE) AS sale_date, l_suppkey % 4 AS source_rank,
        l_returnflag AS decoration, l_linestatus AS orientation,
        CASE WHEN l_linenumber <> 7 THEN ['low', 'middle', 'high'][l_linenumber % 3 + 1] END AS floor_band,
        CASE WHEN l_quantity % 7 <> 0 THEN 1960 + l_orderkey % 60 END AS year_built,
        CASE WHEN l_quantity % 9 <> 0 THEN l_suppkey % 2 = 0 END AS elevator,
        l_discount AS discount, l_tax AS tax, l_orderkey AS home_id, p_brand AS block, p_type AS district, p_size AS total_floors
    FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def raw_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as an export would give them: texts, with gaps and unreadable entries by a fixed rule."""
    s = sales(spark, sf_dir)
    area = F.col("area").cast("int")
    return s.select(
        "sale_id", "community_id", "district", "total_price", "sale_date", "area",
        F.when(area % 7 == 0, "no data").when(area % 11 == 0, "n/a sqm").when(area % 13 == 0, F.lit(None)).otherwise(area.cast("string")).alias("area_raw"),
        F.when(area % 9 == 0, "--").when(area % 10 == 0, "unknown floor").otherwise(F.concat(F.element_at(F.array(F.lit("low"), F.lit("middle"), F.lit("high")), (F.col("total_floors") % 3 + 1).cast("int")), F.lit(" floor / total "), F.col("total_floors"), F.lit(" floors"))).alias("floor_raw"),
        F.when(area % 3 == 0, F.concat(F.lit("tower of "), F.col("total_floors"), F.lit(" floors in all"))).when(area % 3 == 1, F.concat(F.lit("level 2/"), F.col("total_floors"))).otherwise("no remark").alias("description"),
        F.when(area % 5 == 0, "yes").when(area % 5 == 1, "no").otherwise(F.lit(None)).alias("elevator_raw"),
        F.when(F.col("decoration") == "A", " Fine ").when(F.col("decoration") == "N", "rough").otherwise("no data").alias("decoration_raw"),
        F.when(F.col("orientation") == "F", "S").otherwise("north-south").alias("orientation_raw"),
        F.when(area % 4 == 0, "no data").when(area % 4 == 1, F.lit("built 19x")).otherwise((F.lit(1960) + F.col("total_floors")).cast("string")).alias("year_raw"),
        F.when(area % 6 == 0, F.date_format("sale_date", "yyyy-MM")).when(area % 6 == 1, F.lit("soon")).otherwise(F.date_format("sale_date", "yyyy-MM-dd")).alias("date_raw"),
        F.element_at(F.array(F.lit("residential"), F.lit("apartment"), F.lit("parking"), F.lit("residential"), F.lit("shop")), (area % 5 + 1).cast("int")).alias("usage"),
        F.concat((area % 3 + 1), F.lit(" lifts "), (area % 8 + 1), F.lit(" households")).alias("ladder_raw"), "total_floors",
    )


RAW_SQL = (
    SALE_SQL
    + """, raw AS (
    SELECT sale_id, community_id, district, total_price, sale_date, area, a,
        CASE WHEN a % 7 = 0 THEN 'no data' WHEN a % 11 = 0 THEN 'n/a sqm' WHEN a % 13 = 0 THEN NULL ELSE CAST(a AS VARCHAR) END AS area_raw,
        CASE WHEN a % 9 = 0 THEN '--' WHEN a % 10 = 0 THEN 'unknown floor' ELSE ['low', 'middle', 'high'][total_floors % 3 + 1] || ' floor / total ' || total_floors || ' floors' END AS floor_raw,
        CASE WHEN a % 3 = 0 THEN 'tower of ' || total_floors || ' floors in all' WHEN a % 3 = 1 THEN 'level 2/' || total_floors ELSE 'no remark' END AS description,
        CASE WHEN a % 5 = 0 THEN 'yes' WHEN a % 5 = 1 THEN 'no' END AS elevator_raw,
        CASE decoration WHEN 'A' THEN ' Fine ' WHEN 'N' THEN 'rough' ELSE 'no data' END AS decoration_raw,
        CASE WHEN orientation = 'F' THEN 'S' ELSE 'north-south' END AS orientation_raw,
        CASE WHEN a % 4 = 0 THEN 'no data' WHEN a % 4 = 1 THEN 'built 19x' ELSE CAST(1960 + total_floors AS VARCHAR) END AS year_raw,
        CASE WHEN a % 6 = 0 THEN strftime(sale_date, '%Y-%m') WHEN a % 6 = 1 THEN 'soon' ELSE strftime(sale_date, '%Y-%m-%d') END AS date_raw,
        ['residential', 'apartment', 'parking', 'residential', 'shop'][a % 5 + 1] AS usage,
        (a % 3 + 1) || ' lifts ' || (a % 8 + 1) || ' households' AS ladder_raw, total_floors
    FROM (SELECT *, CAST(area AS INTEGER) AS a FROM sale)
)"""
)
