"""Room annotations read from floor plans: what is admitted, how areas compare, what is isolated."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from valora.sources.tables import table


def annotations(spark, sf_dir: str) -> DataFrame:
    """A synthetic annotation table from lineitem, by fixed rules."""
    q = F.col("l_quantity").cast("int")
    status = F.when(q % 5 == 0, "ROOM_ONLY").when(q % 5 == 1, "NEEDS_REVIEW").when(q % 5 == 2, "CONFLICT").otherwise("ACCEPTED")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("image_id"), F.col("l_orderkey").alias("record_id"), (F.col("l_suppkey") % 5).alias("run"), (q % 6 + 1).alias("room_count"),
        F.when(q % 8 != 0, F.col("l_quantity")).alias("room_area"), (F.col("l_quantity") * (F.lit(0.8) + F.col("l_tax") * 5)).alias("gross"), status.alias("status"),
    )


def admitted(ann: DataFrame) -> DataFrame:
    """ACCEPTED gives rooms and area, ROOM_ONLY rooms alone; others are excluded with a reason."""
    full, rooms = F.col("status") == "ACCEPTED", F.col("status").isin("ACCEPTED", "ROOM_ONLY")
    return ann.withColumns({
        "admitted": F.when(full, "full").when(rooms, "rooms").otherwise("excluded"),
        "reason": F.when(~rooms, F.concat(F.lit("status "), F.col("status"))).when(full & F.col("room_area").isNull(), "area missing"),
        "rooms": F.when(rooms, F.col("room_count")), "area": F.when(full, F.col("room_area")),
    })


def area_gap(ann: DataFrame, extreme: float = 0.15) -> DataFrame:
    """Absolute and relative difference and ratio; 'extreme' is a remark, never a rejection."""
    gap = F.abs(F.col("room_area") - F.col("gross"))
    relative = F.try_divide(gap, F.col("gross"))
    return ann.withColumns({"gap": gap, "relative": relative, "ratio": F.try_divide("room_area", "gross"), "kind": F.when(F.col("room_area").isNull(), "missing").when(relative > extreme, "extreme").otherwise("close")})


def safety(ann: DataFrame, answers: int = 2) -> DataFrame:
    """Records whose runs disagree too much are set apart; repeated images are noted."""
    by = ann.groupBy("record_id").agg(F.count_distinct("room_count").alias("a"), F.count(F.lit(1)).alias("images"), F.count_distinct("image_id").alias("units"))
    return by.select("record_id", F.when(F.col("a") > answers, "isolated: runs disagree").when(F.col("images") > F.col("units"), "repeated image").otherwise("kept").alias("verdict"))


def download_verdict(log: DataFrame, domains: list[str], kinds: list[str], most: int) -> DataFrame:
    """Checks of a download log: host on the whitelist, declared kind, size within bounds."""
    reason = F.when(~F.col("host").isin(domains), "host not listed").when(~F.col("kind").isin(kinds), "kind not allowed").when(F.col("size") <= 0, "empty").when(F.col("size") > most, "too large")
    return log.withColumn("verdict", F.coalesce(reason, F.lit("accepted")))


def response_mismatches(log: DataFrame) -> DataFrame:
    """Captured responses whose stored file has another digest than the response had."""
    return log.where(~F.col("response_sha256").eqNullSafe(F.sha2(F.col("stored").cast("binary"), 256)))
