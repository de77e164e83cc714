"""Joins of the domain: name resolution, backfill, registers, diffs, pairing.

Dimension tables (aliases, maps) are left to the planner, which broadcasts what
it finds small; nothing here forces a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

UNRESOLVED, BLOCKED = "UNRESOLVED", "BLOCKED"


def unique_only(dim: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value for keys that have one value; an ambiguous key is never resolved by itself."""
    return dim.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("__n")).where("__n = 1").drop("__n")


def several_values(dim: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that unique_only leaves out, with their values: what a run logs."""
    by = dim.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))  # values of one key are few
    return by.where(F.size("values") > 1)


def resolved(rows: DataFrame, by_source: DataFrame, by_name: DataFrame, aliases: DataFrame, merged: DataFrame, subareas: DataFrame | None = None) -> DataFrame:
    """Community of each row: source id, then standard name, then sub-area or agreed alias; then merged entities forward
    to their successor. rows: source_id, name. by_source: source_id, community_id. by_name: name, community_id.
    aliases: name, community_id, conflict_status. merged: community_id, merged_to, sub_area. subareas: name, community_id.
    A key with several values resolves nothing, in any of them, so rows never multiply; where sub-area and alias name
    different communities the row stays unresolved."""
    s = unique_only(by_source, "source_id", "community_id").select(F.col("source_id").alias("__s"), F.col("community_id").alias("c_source"))
    n = unique_only(by_name, "name", "community_id").select(F.col("name").alias("__n"), F.col("community_id").alias("c_name"))
    agreed = unique_only(aliases.where("conflict_status = 'agreed'"), "name", "community_id").select(F.col("name").alias("__a"), F.col("community_id").alias("c_alias"))
    blocked = aliases.where("conflict_status <> 'agreed'").select(F.col("name").alias("__b")).distinct().withColumn("blocked", F.lit(True))
    if subareas is None:
        subareas = aliases.select("name", "community_id").limit(0)
    u = unique_only(subareas, "name", "community_id").select(F.col("name").alias("__u"), F.col("community_id").alias("c_sub"))
    out = rows.join(s, F.col("source_id") == F.col("__s"), "left").join(n, F.col("name") == F.col("__n"), "left").join(u, F.col("name") == F.col("__u"), "left")
    out = out.join(agreed, F.col("name") == F.col("__a"), "left").join(blocked, F.col("name") == F.col("__b"), "left")
    disagree = F.coalesce(F.col("c_sub") != F.col("c_alias"), F.lit(False))
    method = (
        F.when(F.col("c_source").isNotNull(), "source id")
        .when(F.col("c_name").isNotNull(), "standard name")
        .when(disagree, UNRESOLVED)
        .when(F.col("c_sub").isNotNull(), "sub-area")
        .when(F.col("c_alias").isNotNull(), "alias")
        .when(F.col("blocked"), BLOCKED)
        .otherwise(UNRESOLVED)
    )
    found = F.coalesce("c_source", "c_name", F.when(~disagree, F.coalesce("c_sub", "c_alias")))
    out = out.withColumns({"method": method, "found": found}).drop("__s", "__n", "__u", "__a", "__b", "c_source", "c_name", "c_sub", "c_alias", "blocked")
    one = unique_only(merged, "community_id", "merged_to").select(F.col("community_id").alias("__m"), "merged_to")
    m = one.join(merged.groupBy(F.col("community_id").alias("__area")).agg(F.min("sub_area").alias("sub_area")), F.col("__m") == F.col("__area")).drop("__area")
    return out.join(m, F.col("found") == F.col("__m"), "left").withColumn("community_id", F.coalesce("merged_to", "found")).drop("__m", "merged_to", "found")


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def richness(*columns: str) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def backfilled(rows: DataFrame, source: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """rows with missing fields taken from source, joined on keys; of several source rows the richest one.
    ``conflicts`` counts fields that both have and that differ."""
    pick = best(source, keys, F.desc(richness(*fields)), *[F.col(f).asc_nulls_last() for f in fields])
    pick = pick.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(f).alias(f"__f_{f}") for f in fields])
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    joined = rows.join(pick, on, "left")
    conflicts = sum((F.coalesce(F.col(f) != F.col(f"__f_{f}"), F.lit(False)).cast("int") for f in fields), F.lit(0))
    joined = joined.withColumn("conflicts", conflicts)
    return joined.withColumns({f: F.coalesce(f, f"__f_{f}") for f in fields}).drop(*[f"__k_{k}" for k in keys], *[f"__f_{f}" for f in fields])


def diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys that were added, removed or changed, with the fields' old and new values."""
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(1).alias("__o"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(1).alias("__n"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~same, "changed")
    out = o.join(n, on, "full_outer").withColumn("change", change).where(F.col("change").isNotNull())
    return out.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], "change", *[c for f in fields for c in (f"old_{f}", f"new_{f}")])


def identity_map(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every key of both sides with where it occurs; neither side is rewritten."""
    x, y = a.select(F.col(key).alias("__a")).distinct(), b.select(F.col(key).alias("__b")).distinct()
    joined = x.join(y, F.col("__a") == F.col("__b"), "full_outer")
    return joined.select(F.coalesce("__a", "__b").alias(key), F.when(F.col("__b").isNull(), "only left").when(F.col("__a").isNull(), "only right").otherwise("both").alias("match"))


def merge_candidates(names: DataFrame, std: DataFrame, block: str, most: int = 2) -> DataFrame:
    """Pairs of a name and a standard name in one block (an equi-join) that begin alike or are a few
    letters apart; names without any candidate stay, pending. names: name, block; std: std_name, block."""
    b = std.withColumnRenamed(block, "__b")
    near = F.col("std_name").startswith(F.col("name")) | F.col("name").startswith(F.col("std_name")) | (F.levenshtein("name", "std_name", most) >= 0)
    joined = names.join(b, (F.col(block) == F.col("__b")) & (F.col("name") != F.col("std_name")) & near, "left")
    listed = joined.groupBy("name", block).agg(F.sort_array(F.collect_set("std_name")).alias("candidates"))
    return listed.withColumn("pending", F.size("candidates") != 1)


def touched_excluded(units: DataFrame, touched: DataFrame, unit: str, cluster: str) -> DataFrame:
    """Units without those of a cluster that has any touched unit."""
    hit = units.join(touched.select(F.col(unit).alias("__t")).distinct(), F.col(unit) == F.col("__t"), "left_semi").select(F.col(cluster).alias("__c")).distinct()
    return units.join(hit, F.col(cluster) == F.col("__c"), "left_anti")


def paired(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the prediction of the same id and bundle that was made before them."""
    p = predictions.select(F.col("prediction_id").alias("__p"), F.col("bundle").alias("__b"), "prediction", "predicted_at")
    return labels.join(p, (F.col("prediction_id") == F.col("__p")) & (F.col("bundle") == F.col("__b")) & (F.col("predicted_at") < F.col("labelled_at"))).drop("__p", "__b")


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows either side has that the other one lacks; both 0 for equal multisets."""
    left, right = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right"))
    return left.crossJoin(right)  # one row each


def prediction_diff(old: DataFrame, new: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Predictions by target that differ by more than the tolerance, and why."""
    o, n = old.select(F.col("target_id").alias("__o"), F.col("prediction").alias("old"), F.col("level").alias("old_level")), new.select(F.col("target_id").alias("__n"), F.col("prediction").alias("new"), F.col("level").alias("new_level"))
    why = (
        F.when(F.col("__o").isNull(), "new target").when(F.col("__n").isNull(), "target gone").when(~F.col("old_level").eqNullSafe(F.col("new_level")), "level changed")
        .when(F.col("old").isNull() != F.col("new").isNull(), "one is missing").when(F.abs(F.col("old") - F.col("new")) > tolerance * F.greatest(F.abs(F.col("old")), F.lit(1.0)), "evidence changed")
    )
    return o.join(n, F.col("__o") == F.col("__n"), "full_outer").select(F.coalesce("__o", "__n").alias("target_id"), "old", "new", why.alias("why")).where(F.col("why").isNotNull())
