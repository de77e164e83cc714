"""Queries on what is known before a date."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.config import CUTOFF
from valora.operators import evidence as V
from valora.operators.quantiles import exact_quantiles
from valora.plans.registry import query
from valora.sources.tables import SALE_SQL, day, sales

_WITH = "WITH " + SALE_SQL
_WINDOW = f"sale_date >= DATE '{CUTOFF}' - INTERVAL 365 DAY AND sale_date < DATE '{CUTOFF}'"
_LEVEL = "{0}m AS (SELECT {1} AS {0}_key, quantile_cont(unit_price, 0.5) AS {0}_median, count(*) AS {0}_n FROM sale WHERE " + _WINDOW + " GROUP BY 1)"
B0_SQL = (
    _WITH + ", " + ", ".join(_LEVEL.format(k, v) for k, v in V.KEYS.items()) + f""", b0 AS (
    SELECT sale_id, sale.community_id, sale.block, sale.district, unit_price, area, sale_date, orientation, community_n, coalesce(community_median, block_median, district_median) AS baseline,
        CASE WHEN community_median IS NOT NULL THEN 'community' WHEN block_median IS NOT NULL THEN 'block' WHEN district_median IS NOT NULL THEN 'district' ELSE 'none' END AS level
    FROM sale LEFT JOIN communitym ON community_id = community_key LEFT JOIN blockm ON block = block_key LEFT JOIN districtm ON district = district_key
    WHERE sale_date >= DATE '{CUTOFF}')"""
)


def b0(spark, sf_dir):
    s = sales(spark, sf_dir)
    return V.with_fallback(s.where(F.col("sale_date") >= day(CUTOFF)), s, day(CUTOFF))


@query("b0_fixed_cutoff", B0_SQL + " SELECT sale_id, round(baseline, 6) AS baseline, level, community_n FROM b0")
def b0_fixed_cutoff(spark, sf_dir):
    return b0(spark, sf_dir).select("sale_id", F.round("baseline", 6).alias("baseline"), "level", "community_n")


@query("b0_fallback_share", B0_SQL + " SELECT level, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM b0 GROUP BY level")
def b0_fallback_share(spark, sf_dir):
    n = b0(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(whole)).select("level", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row on the right


@query("rolling_median_row", _WITH + """ SELECT sale_id, round(quantile_cont(unit_price, 0.5) OVER w, 6) AS rolling_median, count(*) OVER w AS rolling_n FROM sale
WINDOW w AS (PARTITION BY community_id ORDER BY sale_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def rolling_median_row(spark, sf_dir):
    return V.rolling_median(sales(spark, sf_dir), "community_id").select("sale_id", F.round("rolling_median", 6).alias("rolling_median"), "rolling_n")


@query("comparable_pool", _WITH + """ SELECT t.sale_id AS target_id, count(*) AS n, CAST(max(s.sale_date) AS VARCHAR) AS nearest, round(avg(s.unit_price), 4) AS mean_price
FROM sale t JOIN sale s ON t.community_id = s.community_id AND s.sale_date < t.sale_date GROUP BY 1""")
def comparable_pool(spark, sf_dir):
    e = V.earlier_sales(sales(spark, sf_dir), "community_id")
    return e.select(F.col("sale_id").alias("target_id"), "n", F.col("nearest").cast("string").alias("nearest"), F.round("mean_price", 4).alias("mean_price"))


_FOLDS = """, fold AS (SELECT strftime(lo, '%Y-%m') AS fold, CAST(lo AS DATE) AS lo, CAST(lo + INTERVAL 6 MONTH AS DATE) AS hi
    FROM (SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '2000-07-01', INTERVAL 6 MONTH)) AS lo))"""
_NEWEST = """{0}_c AS (SELECT fold, {1} AS key, sale_id FROM sale JOIN fold ON sale_date < lo AND sale_date >= lo - INTERVAL 365 DAY
    QUALIFY row_number() OVER (PARTITION BY fold, {1} ORDER BY sale_date DESC, sale_id) <= 10)"""
FOLD_CASES_SQL = f"""{_FOLDS}, {_NEWEST.format("community", "community_id")}, {_NEWEST.format("block", "block")},
ft AS (SELECT fold, sale_id AS target_id, community_id, block FROM sale JOIN fold ON sale_date >= lo AND sale_date < hi),
own AS (SELECT fold, target_id, sale_id, 'community' AS level FROM ft JOIN community_c c USING (fold) WHERE c.key = community_id),
bare AS (SELECT * FROM ft WHERE (fold, community_id) NOT IN (SELECT (fold, key) FROM community_c)),
wide AS (SELECT fold, target_id, sale_id, 'block' AS level FROM bare JOIN block_c c USING (fold) WHERE c.key = block),
fc AS (FROM own UNION ALL FROM wide UNION ALL SELECT fold, target_id, NULL, 'uncovered' FROM bare WHERE target_id NOT IN (SELECT target_id FROM wide))"""


def development_folds(spark):
    return V.folds(spark, "1997-01-01", "2000-07-01")


@query("a1_cases", _WITH + FOLD_CASES_SQL + " SELECT fold, target_id, sale_id, level FROM fc")
def a1_cases(spark, sf_dir):
    """J19: cases before each fold's cutoff, of the community, of the block where it has none; targets without any stay."""
    return V.fold_cases(sales(spark, sf_dir), development_folds(spark), 10)


@query("time_index", _WITH + f""", m AS (SELECT district, date_trunc('month', sale_date) AS month, quantile_cont(unit_price, 0.5) AS median, count(*) AS n FROM sale GROUP BY 1, 2),
b AS (SELECT * FROM m WHERE month = DATE '{CUTOFF}')
SELECT m.district, strftime(m.month, '%Y-%m') AS month, m.n, round(m.median, 6) AS median, round(b.median, 6) AS base_median, round(CASE WHEN m.n >= 5 AND b.n >= 5 THEN m.median / b.median ELSE 1.0 END, 6) AS index
FROM m LEFT JOIN b ON m.district = b.district""")
def time_index(spark, sf_dir):
    i = V.monthly_index(sales(spark, sf_dir), "district", day(CUTOFF))
    return i.select("district", F.date_format("month", "yyyy-MM").alias("month"), "n", *[F.round(c, 6).alias(c) for c in ("median", "base_median", "index")])


@query("rolling_folds", """SELECT strftime(lo, '%Y-%m') AS fold, CAST(CAST(lo AS DATE) AS VARCHAR) AS lo, CAST(CAST(lo + INTERVAL 6 MONTH AS DATE) AS VARCHAR) AS hi
FROM (SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '2000-07-01', INTERVAL 6 MONTH)) AS lo)""")
def rolling_folds(spark, sf_dir):
    return development_folds(spark).select("fold", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


@query("fold_slices", _WITH + _FOLDS + " SELECT fold, count(*) FILTER (WHERE sale_date < lo) AS train, count(*) FILTER (WHERE sale_date >= lo AND sale_date < hi) AS validate FROM sale, fold GROUP BY fold")
def fold_slices(spark, sf_dir):
    f = F.broadcast(development_folds(spark))  # a handful of dates, from the calendar alone
    by_day = sales(spark, sf_dir).groupBy("sale_date").agg(F.count(F.lit(1)).alias("n"))
    joined = by_day.join(f, F.col("sale_date") < F.col("hi"))
    return joined.groupBy("fold").agg(F.sum(F.when(F.col("sale_date") < F.col("lo"), F.col("n")).otherwise(0)).alias("train"), F.sum(F.when(F.col("sale_date") >= F.col("lo"), F.col("n")).otherwise(0)).alias("validate"))


@query("slice_overlap", _WITH + _FOLDS + " SELECT count(*) AS events, count(*) FILTER (WHERE k > 1) AS in_several FROM (SELECT sale_id, count(DISTINCT fold) AS k FROM sale JOIN fold ON sale_date >= lo AND sale_date < hi GROUP BY 1)")
def slice_overlap(spark, sf_dir):
    f = F.broadcast(development_folds(spark))
    k = sales(spark, sf_dir).select("sale_id", "sale_date").join(f, (F.col("sale_date") >= F.col("lo")) & (F.col("sale_date") < F.col("hi"))).groupBy("sale_id").agg(F.count_distinct("fold").alias("k"))
    return k.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("k") > 1).alias("in_several"))


@query("oof_mapping", _WITH + _FOLDS + " SELECT fold, count(*) AS n, CAST(min(sale_date) AS VARCHAR) AS first, CAST(max(sale_date) AS VARCHAR) AS last FROM sale JOIN fold ON sale_date >= lo AND sale_date < hi GROUP BY fold")
def oof_mapping(spark, sf_dir):
    f = F.broadcast(development_folds(spark))
    j = sales(spark, sf_dir).join(f, (F.col("sale_date") >= F.col("lo")) & (F.col("sale_date") < F.col("hi")))
    return j.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("sale_date").cast("string").alias("first"), F.max("sale_date").cast("string").alias("last"))


@query("forward_blocks", _WITH + """, b AS (SELECT block, year(sale_date) * 2 + CASE WHEN month(sale_date) > 6 THEN 1 ELSE 0 END AS half, count(*) AS n, sum(unit_price) AS total FROM sale GROUP BY 1, 2)
SELECT block, half, n, coalesce(sum(n) OVER w, 0) AS earlier_n, round(sum(total) OVER w / sum(n) OVER w, 4) AS earlier_mean FROM b WINDOW w AS (PARTITION BY block ORDER BY half ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def forward_blocks(spark, sf_dir):
    return V.forward_counts(sales(spark, sf_dir), "block").select("block", "half", "n", "earlier_n", F.round("earlier_mean", 4).alias("earlier_mean"))


@query("derive_block", _WITH + " SELECT community_id, min(block) AS block, count(DISTINCT block) > 1 AS ambiguous FROM sale GROUP BY 1")
def derive_block(spark, sf_dir):
    return V.first_block(sales(spark, sf_dir))


_ROLLED = ", ".join(
    f"quantile_cont(unit_price, 0.5) OVER (PARTITION BY {key} ORDER BY sale_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS {level}_m" for level, key in V.KEYS.items()
)
_CHAIN = "CASE WHEN {0}community{1} IS NOT NULL THEN 'community' WHEN {0}block{1} IS NOT NULL THEN 'block' WHEN {0}district{1} IS NOT NULL THEN 'district' ELSE 'none' END AS level"


def _fixed_sql(name: str, cutoff: str) -> str:
    window = f"sale_date >= {cutoff} - INTERVAL 365 DAY AND sale_date < {cutoff}"
    return ", ".join(f"{name}_{level} AS (SELECT {key} AS key, quantile_cont(unit_price, 0.5) AS {level}_m FROM sale WHERE {window} GROUP BY 1)" for level, key in V.KEYS.items())


def _judged_sql(name: str, layer: str, kind: str, rows: str) -> str:
    joins = " ".join(f"LEFT JOIN {name}_{level} ON {name}_{level}.key = {key}" for level, key in V.KEYS.items())
    return f"SELECT sale_id, '{layer}' AS layer, '{kind}' AS kind, round(coalesce(community_m, block_m, district_m), 6) AS market, {_CHAIN.format('', '_m')} FROM sale {joins} WHERE {rows}"


_CUT, _INNER = f"DATE '{CUTOFF}'", f"(DATE '{CUTOFF}' - INTERVAL 3 MONTH)"


@query(
    "market_inputs",
    _WITH
    + f""", rolled AS (SELECT *, {_ROLLED} FROM sale), l AS (SELECT sale_id, sale_date, coalesce(community_m, block_m, district_m) AS market, {_CHAIN.format('', '_m')} FROM rolled WHERE sale_date < {_CUT}),
{_fixed_sql("o", _CUT)}, {_fixed_sql("i", _INNER)}
SELECT sale_id, 'outer' AS layer, 'train' AS kind, round(market, 6) AS market, level FROM l WHERE market IS NOT NULL
UNION ALL SELECT sale_id, 'inner', 'fit', round(market, 6), level FROM l WHERE market IS NOT NULL AND sale_date < {_INNER}
UNION ALL {_judged_sql("o", "outer", "validate", f"sale_date >= {_CUT}")}
UNION ALL {_judged_sql("i", "inner", "select", f"sale_date >= {_INNER} AND sale_date < {_CUT}")}""",
)
def market_inputs(spark, sf_dir):
    """M5: rows to learn from roll to their own date, rows to judge by see their layer's cutoff only."""
    m = V.market_inputs(sales(spark, sf_dir), day(CUTOFF))
    return m.select("sale_id", "layer", "kind", F.round("market", 6).alias("market"), "level")


@query("large_group_quantiles", _WITH + " SELECT district, count(*) AS n, round(quantile_cont(unit_price, 0.1), 6) AS p10, round(quantile_cont(unit_price, 0.5), 6) AS p50, round(quantile_cont(unit_price, 0.9), 6) AS p90 FROM sale GROUP BY 1")
def large_group_quantiles(spark, sf_dir):
    q = exact_quantiles(sales(spark, sf_dir), ["district"], "unit_price", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select("district", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])
