"""Queries on joins, registers and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.config import CUTOFF
from valora.operators import evidence as V, joins as J
from valora.plans.registry import query
from valora.sources.tables import SALE_SQL, day, sales, table

_WITH = "WITH " + SALE_SQL

_DIMS = """WITH rows AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS source_id, CASE WHEN c_custkey % 2 = 0 THEN 'n' || (c_custkey % 700) ELSE 'a' || (c_custkey % 90) END AS name FROM customer),
src AS (SELECT c_custkey AS source_id, c_custkey % 500 AS community_id FROM customer WHERE c_custkey % 6 = 0),
std AS (SELECT DISTINCT 'n' || (c_custkey % 600) AS name, CAST(c_custkey % 600 + CASE WHEN c_custkey % 600 < 5 AND c_custkey > 600 THEN 1 ELSE 0 END AS BIGINT) AS community_id FROM customer),
ali AS (SELECT DISTINCT 'a' || (c_custkey % 80) AS name, c_custkey % 80 AS community_id, CASE c_custkey % 80 % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'conflict' ELSE 'agreed' END AS conflict_status FROM customer),
mrg AS (SELECT DISTINCT c_custkey % 50 AS community_id, c_custkey % 50 + 1000 AS merged_to, 'east' AS sub_area FROM customer WHERE c_custkey % 50 % 7 = 0),
std1 AS (SELECT name, min(community_id) AS c FROM std GROUP BY 1 HAVING count(DISTINCT community_id) = 1), ali1 AS (SELECT name, min(community_id) AS c FROM ali WHERE conflict_status = 'agreed' GROUP BY 1 HAVING count(DISTINCT community_id) = 1),
blk AS (SELECT DISTINCT name FROM ali WHERE conflict_status <> 'agreed')"""


def name_tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    rows = c.select(k.alias("row_id"), F.when(k % 3 == 0, k).alias("source_id"), F.when(k % 2 == 0, F.concat(F.lit("n"), k % 700)).otherwise(F.concat(F.lit("a"), k % 90)).alias("name"))
    src = c.where(k % 6 == 0).select(k.alias("source_id"), (k % 500).alias("community_id"))
    std = c.select(F.concat(F.lit("n"), k % 600).alias("name"), (k % 600 + F.when((k % 600 < 5) & (k > 600), 1).otherwise(0)).alias("community_id")).distinct()
    s = k % 80 % 4
    ali = c.select(F.concat(F.lit("a"), k % 80).alias("name"), (k % 80).alias("community_id"), F.when(s == 0, "pending").when(s == 1, "conflict").otherwise("agreed").alias("conflict_status")).distinct()
    mrg = c.where(k % 50 % 7 == 0).select((k % 50).alias("community_id"), (k % 50 + 1000).alias("merged_to"), F.lit("east").alias("sub_area")).distinct()
    return rows, src, std, ali, mrg


@query("alias_cascade", _DIMS + """ SELECT row_id, CASE WHEN s.community_id IS NOT NULL THEN 'source id' WHEN n.c IS NOT NULL THEN 'standard name' WHEN a.c IS NOT NULL THEN 'alias' WHEN b.name IS NOT NULL THEN 'BLOCKED' ELSE 'UNRESOLVED' END AS method,
coalesce(m.merged_to, s.community_id, n.c, a.c) AS community_id, m.sub_area FROM rows r LEFT JOIN src s ON r.source_id = s.source_id LEFT JOIN std1 n ON r.name = n.name LEFT JOIN ali1 a ON r.name = a.name LEFT JOIN blk b ON r.name = b.name
LEFT JOIN mrg m ON m.community_id = coalesce(s.community_id, n.c, a.c)""")
def alias_cascade(spark, sf_dir):
    return J.resolved(*name_tables(spark, sf_dir)).select("row_id", "method", "community_id", "sub_area")


@query("unmatched_register", _DIMS + """ SELECT count(*) AS input, count(*) FILTER (WHERE coalesce(s.community_id, n.c, a.c) IS NOT NULL) AS pooled, count(*) FILTER (WHERE coalesce(s.community_id, n.c, a.c) IS NULL) AS unmatched
FROM rows r LEFT JOIN src s ON r.source_id = s.source_id LEFT JOIN std1 n ON r.name = n.name LEFT JOIN ali1 a ON r.name = a.name""")
def unmatched_register(spark, sf_dir):
    found = J.resolved(*name_tables(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("input"), F.count("community_id").alias("pooled"), F.count_if(F.col("community_id").isNull()).alias("unmatched"))


@query("attribute_backfill", _WITH + """, a AS (SELECT home_id, CASE WHEN area % 2 = 0 THEN decoration END AS decoration, CASE WHEN area % 3 = 0 THEN total_floors END AS floors FROM sale),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY (decoration IS NOT NULL)::INT + (floors IS NOT NULL)::INT DESC, decoration NULLS LAST, floors NULLS LAST) AS k FROM a) WHERE k = 1)
SELECT s.sale_id, coalesce(CASE WHEN s.area % 5 = 0 THEN s.decoration END, p.decoration) AS decoration, p.floors, coalesce(CASE WHEN s.area % 5 = 0 THEN s.decoration END <> p.decoration, false)::INT AS conflicts FROM sale s LEFT JOIN pick p ON s.home_id = p.home_id""")
def attribute_backfill(spark, sf_dir):
    s = sales(spark, sf_dir)
    source = s.select("home_id", F.when(F.col("area") % 2 == 0, F.col("decoration")).alias("decoration"), F.when(F.col("area") % 3 == 0, F.col("total_floors")).alias("floors"))
    rows = s.select("sale_id", "home_id", F.when(F.col("area") % 5 == 0, F.col("decoration")).alias("decoration"), F.lit(None).cast("int").alias("floors"))
    return J.backfilled(rows, source, ["home_id"], ["decoration", "floors"]).select("sale_id", "decoration", "floors", "conflicts")


@query("house_backfill", _WITH + """, h AS (SELECT home_id, max(total_floors) AS floors FROM sale WHERE area % 4 = 0 GROUP BY 1), b AS (SELECT *, CASE WHEN total_floors <= 6 THEN 'low-rise' WHEN total_floors <= 18 THEN 'mid-rise' ELSE 'high-rise' END AS own,
CASE WHEN floors <= 6 THEN 'low-rise' WHEN floors <= 18 THEN 'mid-rise' WHEN floors IS NOT NULL THEN 'high-rise' END AS other FROM sale LEFT JOIN h USING (home_id))
SELECT count(*) AS n, count(floors) AS matched, count(*) FILTER (WHERE other <> own) AS inconsistent FROM b""")
def house_backfill(spark, sf_dir):
    from valora.functions.parsing import floor_bucket

    s = sales(spark, sf_dir)
    h = s.where("area % 4 = 0").groupBy(F.col("home_id").alias("h")).agg(F.max("total_floors").alias("floors"))
    j = s.join(h, F.col("home_id") == F.col("h"), "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("floors").alias("matched"), F.count_if(floor_bucket(F.col("floors")) != floor_bucket(F.col("total_floors"))).alias("inconsistent"))


@query("merge_candidates", """WITH names AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 5 = 0 THEN ' ii' ELSE '' END AS name, p_brand AS block FROM part WHERE p_partkey % 3 = 0), std AS (SELECT DISTINCT p_name AS std_name, p_brand AS b FROM part WHERE p_partkey % 3 <> 0)
, j AS (SELECT n.name, n.block, s.std_name FROM names n LEFT JOIN std s ON n.block = s.b AND n.name <> s.std_name AND (starts_with(s.std_name, n.name) OR starts_with(n.name, s.std_name) OR levenshtein(n.name, s.std_name) <= 2))
SELECT name, block, coalesce(string_agg(DISTINCT std_name, '|' ORDER BY std_name), '') AS candidates, count(DISTINCT std_name) <> 1 AS pending FROM j GROUP BY 1, 2""")
def merge_candidates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.where("p_partkey % 3 = 0").select(F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " ii").otherwise("")).alias("name"), F.col("p_brand").alias("block")).distinct()
    std = p.where("p_partkey % 3 <> 0").select(F.col("p_name").alias("std_name"), F.col("p_brand").alias("block")).distinct()
    return J.merge_candidates(names, std, "block").select("name", "block", F.array_join("candidates", "|").alias("candidates"), "pending")


@query("identity_map", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only left' WHEN a.k IS NULL THEN 'only right' ELSE 'both' END AS match FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0) b ON a.k = b.k")
def identity_map(spark, sf_dir):
    return J.identity_map(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("novelty_check", _WITH + f", b AS (SELECT * FROM sale WHERE sale_date >= DATE '{CUTOFF}'), m AS (SELECT DISTINCT home_id, area FROM sale WHERE sale_date < DATE '{CUTOFF}') SELECT count(*) FILTER (WHERE m.home_id IS NULL) AS new_rows, count(*) FILTER (WHERE m.home_id IS NOT NULL) AS seen_rows FROM b LEFT JOIN m ON b.home_id = m.home_id AND b.area = m.area")
def novelty_check(spark, sf_dir):
    s = sales(spark, sf_dir).select("home_id", "area", "sale_date")
    batch, master = s.where(F.col("sale_date") >= day(CUTOFF)), s.where(F.col("sale_date") < day(CUTOFF)).select(F.col("home_id").alias("h"), F.col("area").alias("a"))
    on = (F.col("home_id") == F.col("h")) & (F.col("area") == F.col("a"))
    new, seen = batch.join(master, on, "left_anti").agg(F.count(F.lit(1)).alias("new_rows")), batch.join(master, on, "left_semi").agg(F.count(F.lit(1)).alias("seen_rows"))
    return new.crossJoin(seen)  # one row each


@query("touched_exclusion", "SELECT count(*) AS units, count(DISTINCT l_suppkey) AS clusters FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 997 = 0))")
def touched_exclusion(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("cluster"))
    touched = table(spark, sf_dir, "orders").where("o_custkey % 997 = 0").select(F.col("o_orderkey").alias("unit"))
    return J.touched_excluded(units, touched, "unit", "cluster").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("cluster").alias("clusters"))


@query("label_pairing", """WITH p AS (SELECT o_orderkey AS prediction_id, 'v' || o_orderkey % 3 AS bundle, o_totalprice AS prediction, o_orderdate AS predicted_at FROM orders), l AS (SELECT l_orderkey AS prediction_id, 'v' || l_partkey % 3 AS bundle, l_extendedprice AS price, l_shipdate AS labelled_at FROM lineitem)
SELECT bundle, count(*) AS n, round(sum(l.price), 2) AS price, round(sum(p.prediction), 2) AS prediction FROM l JOIN p USING (prediction_id, bundle) WHERE predicted_at < labelled_at GROUP BY 1""")
def label_pairing(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.concat(F.lit("v"), F.col("o_orderkey") % 3).alias("bundle"), F.col("o_totalprice").alias("prediction"), F.col("o_orderdate").alias("predicted_at"))
    lab = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prediction_id"), F.concat(F.lit("v"), F.col("l_partkey") % 3).alias("bundle"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("labelled_at"))
    return J.paired(p, lab).groupBy("bundle").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"), F.round(F.sum("prediction"), 2).alias("prediction"))


@query("block_alignment", """WITH l AS (SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS source_id, s_name AS name FROM supplier), pool AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 10 = 1 THEN 'same' ELSE s_name END AS name FROM supplier WHERE s_suppkey % 4 <> 1),
u AS (SELECT name, min(source_id) AS source_id FROM pool GROUP BY 1 HAVING count(DISTINCT source_id) = 1), j AS (SELECT l.row_id, coalesce(p.source_id, u.source_id) AS matched, CASE WHEN p.source_id IS NOT NULL THEN 'source id' WHEN u.source_id IS NOT NULL THEN 'unique name' ELSE 'missing' END AS method FROM l LEFT JOIN pool p ON l.source_id = p.source_id LEFT JOIN u ON l.name = u.name)
SELECT method, count(*) AS n, (SELECT count(matched) / count(*) >= 0.9 FROM j) AS enough FROM j GROUP BY 1""")
def block_alignment(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(k.alias("row_id"), F.when(k % 3 == 0, k).alias("source_id"), F.col("s_name").alias("name"))
    pool = s.where(k % 4 != 1).select(k.alias("p_id"), F.when(k % 10 == 1, "same").otherwise(F.col("s_name")).alias("p_name"))
    unique = J.unique_only(pool, "p_name", "p_id").select(F.col("p_name").alias("u_name"), F.col("p_id").alias("u_id"))
    j = rows.join(pool.select("p_id"), F.col("source_id") == F.col("p_id"), "left").join(unique, F.col("name") == F.col("u_name"), "left")
    method = F.when(F.col("p_id").isNotNull(), "source id").when(F.col("u_id").isNotNull(), "unique name").otherwise("missing")
    by = j.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"))
    whole = by.agg((F.sum(F.when(F.col("method") != "missing", F.col("n")).otherwise(0)) / F.sum("n") >= 0.9).alias("enough"))
    return by.crossJoin(F.broadcast(whole))  # one row on the right


@query("common_population", _WITH + f" SELECT count(*) AS n FROM (SELECT community_id FROM sale WHERE sale_date < DATE '{CUTOFF}' INTERSECT SELECT community_id FROM sale WHERE sale_date >= DATE '{CUTOFF}')")
def common_population(spark, sf_dir):
    s = sales(spark, sf_dir)
    a, b = s.where(F.col("sale_date") < day(CUTOFF)).select("community_id"), s.where(F.col("sale_date") >= day(CUTOFF)).select("community_id")
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n"))


@query("fk_check", "SELECT count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 11 <> 0)")
def fk_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select("o_orderkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def _two_versions(spark, sf_dir):
    s = sales(spark, sf_dir)
    t = s.where(F.col("sale_date") >= day("2001-01-01"))
    return [V.with_fallback(t, s, day(c)).select(F.col("sale_id").alias("target_id"), F.col("baseline").alias("prediction"), "level") for c in ("2000-07-01", "2001-01-01")]


def _version_sql(name: str, cutoff: str) -> str:
    w = f"sale_date >= DATE '{cutoff}' - INTERVAL 365 DAY AND sale_date < DATE '{cutoff}'"
    levels = ", ".join(f"{name}_{k} AS (SELECT {v} AS k, quantile_cont(unit_price, 0.5) AS m FROM sale WHERE {w} GROUP BY 1)" for k, v in V.KEYS.items())
    return levels + f""", {name} AS (SELECT sale_id AS target_id, coalesce(c.m, b.m, d.m) AS prediction, CASE WHEN c.m IS NOT NULL THEN 'community' WHEN b.m IS NOT NULL THEN 'block' WHEN d.m IS NOT NULL THEN 'district' ELSE 'none' END AS level
    FROM sale LEFT JOIN {name}_community c ON community_id = c.k LEFT JOIN {name}_block b ON block = b.k LEFT JOIN {name}_district d ON district = d.k WHERE sale_date >= DATE '2001-01-01')"""


@query("prediction_diff", f"{_WITH}, {_version_sql('o', '2000-07-01')}, {_version_sql('n', '2001-01-01')}" + """, d AS (SELECT target_id, o.prediction AS old, n.prediction AS new, CASE WHEN o.level IS DISTINCT FROM n.level THEN 'level changed' WHEN abs(o.prediction - n.prediction) > 1e-9 * greatest(abs(o.prediction), 1.0) THEN 'evidence changed' END AS why FROM o JOIN n USING (target_id))
SELECT target_id, round(old, 6) AS old, round(new, 6) AS new, why FROM d WHERE why IS NOT NULL""")
def prediction_diff(spark, sf_dir):
    old, new = _two_versions(spark, sf_dir)
    return J.prediction_diff(old, new).select("target_id", F.round("old", 6).alias("old"), F.round("new", 6).alias("new"), "why")


@query("richest_pick", _WITH + """, a AS (SELECT sale_id, home_id, CASE WHEN area % 2 = 0 THEN decoration END AS d, CASE WHEN area % 3 = 0 THEN total_floors END AS f FROM sale)
SELECT home_id, sale_id, d, f FROM (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY (d IS NOT NULL)::INT + (f IS NOT NULL)::INT DESC, sale_id, d NULLS LAST, f NULLS LAST) AS k FROM a) WHERE k = 1""")
def richest_pick(spark, sf_dir):
    a = sales(spark, sf_dir).select("sale_id", "home_id", F.when(F.col("area") % 2 == 0, F.col("decoration")).alias("d"), F.when(F.col("area") % 3 == 0, F.col("total_floors")).alias("f"))
    return J.best(a, ["home_id"], F.desc(J.richness("d", "f")), F.col("sale_id"), F.col("d").asc_nulls_last(), F.col("f").asc_nulls_last())


@query("xsource_dedup", _WITH + """ SELECT sale_id, CASE WHEN row_number() OVER (PARTITION BY community_id, area, sale_date ORDER BY source_rank, sale_id, total_price) = 1 THEN 'kept' ELSE 'suspected duplicate' END AS verdict, total_price FROM sale""")
def xsource_dedup(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("community_id", "area", "sale_date").orderBy("source_rank", "sale_id", "total_price")
    return sales(spark, sf_dir).select("sale_id", F.when(F.row_number().over(w) == 1, "kept").otherwise("suspected duplicate").alias("verdict"), "total_price")


@query("record_dedup", _WITH + " SELECT count(*) AS groups, sum(n) AS rows, sum(n - 1) AS repeated FROM (SELECT home_id, count(*) AS n FROM sale GROUP BY 1)")
def record_dedup(spark, sf_dir):
    n = sales(spark, sf_dir).groupBy("home_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("repeated"))


@query("sale_sequence", _WITH + """ SELECT sale_id, row_number() OVER w AS nth, CAST(lag(sale_date) OVER w AS VARCHAR) AS previous, total_price FROM sale WINDOW w AS (PARTITION BY home_id ORDER BY sale_date, sale_id, total_price)""")
def sale_sequence(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("home_id").orderBy("sale_date", "sale_id", "total_price")
    return sales(spark, sf_dir).select("sale_id", F.row_number().over(w).alias("nth"), F.lag("sale_date").over(w).cast("string").alias("previous"), "total_price")


@query("source_union", _WITH + """ SELECT source_rank, count(*) AS n FROM (SELECT * FROM sale WHERE source_rank = 0 UNION ALL SELECT * FROM sale WHERE source_rank = 1 UNION ALL SELECT * FROM sale WHERE source_rank = 2 UNION ALL SELECT * FROM sale WHERE source_rank = 3) GROUP BY 1""")
def source_union(spark, sf_dir):
    s = sales(spark, sf_dir).select("sale_id", "source_rank")
    pools = [s.where(F.col("source_rank") == k) for k in range(4)]
    u = pools[0]
    for p in pools[1:]:
        u = u.unionByName(p)
    return u.groupBy("source_rank").agg(F.count(F.lit(1)).alias("n"))


@query("exclusion_sets", "SELECT count(*) AS n FROM (SELECT c_custkey FROM customer EXCEPT (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def exclusion_sets(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    out = o.where("o_orderpriority = '1-URGENT'").select("o_custkey").union(c.where("c_mktsegment = 'BUILDING'").select("c_custkey")).distinct()
    return c.select("c_custkey").subtract(out).agg(F.count(F.lit(1)).alias("n"))


@query("rebuild_check", "SELECT 0 AS only_left, 0 AS only_right")
def rebuild_check(spark, sf_dir):
    a, b = ([V.level_medians(sales(spark, sf_dir), day(CUTOFF), "block").select("block_key", "block_median", "block_n")] * 2)
    return J.same_ids(a, b.orderBy("block_key"))
