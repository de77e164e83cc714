"""Queries on metrics, calibration, bootstrap, splits and verdicts, over the baseline's predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.operators import evidence as V, metrics as M
from valora.plans.evidence import B0_SQL, b0
from valora.plans.registry import query
from valora.sources import scratch
from valora.sources.tables import SALE_SQL, day, sales, table

_P = B0_SQL + ", p AS (SELECT sale_id, community_id, block, district, level, area, sale_date, CASE WHEN level = 'community' THEN baseline END AS prediction, unit_price AS actual FROM b0), e AS (SELECT *, (prediction - actual) / actual AS signed, abs((prediction - actual) / actual) AS ape FROM p)"
_PACK = "count(*) AS n, round(quantile_cont(ape, 0.5), 6) AS medape, round(quantile_cont(ape, 0.9), 6) AS p90, round(avg(CASE WHEN ape IS NOT NULL THEN (ape <= 0.1)::INT END), 6) AS hit10, round(quantile_cont(signed, 0.5), 6) AS bias, round(avg(CASE WHEN ape IS NOT NULL THEN (signed > 0.2)::INT END), 6) AS over20, round(avg((prediction IS NOT NULL)::INT), 6) AS coverage"
_METRICS = ("medape", "p90", "hit10", "bias", "over20", "coverage")


def predictions(spark, sf_dir):
    """The community level alone predicts, so that some rows are not covered. Written once: metrics read it several times."""
    p = b0(spark, sf_dir).select("sale_id", "community_id", "block", "district", "level", "area", "sale_date", F.when(F.col("level") == "community", F.col("baseline")).alias("prediction"), F.col("unit_price").alias("actual"))
    return scratch.cut(p, "predictions")


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("metric_pack", _P + f" SELECT {_PACK} FROM e")
def metric_pack(spark, sf_dir):
    return rounded(M.pack(predictions(spark, sf_dir)), *_METRICS)


@query("metric_by_group", _P + f", g AS (SELECT *, unnest([{{'by': 'block', 'value': block}}, {{'by': 'district', 'value': district}}, {{'by': 'area_band', 'value': CAST(CAST(floor(area / 10) AS INTEGER) AS VARCHAR)}}]) AS g FROM e) SELECT g.by AS by, g.value AS value, {_PACK}, count(*) < 30 AS low_power FROM g GROUP BY g.by, g.value")
def metric_by_group(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("area_band", F.floor(F.col("area") / 10).cast("int"))
    return rounded(M.by_groups(p, ["block", "district", "area_band"]), *_METRICS)


@query("worst_cases", _P + " SELECT sale_id, block, round(prediction, 6) AS prediction, round(actual, 6) AS actual, round(ape, 6) AS ape FROM e WHERE ape IS NOT NULL ORDER BY e.ape DESC, sale_id LIMIT 50")
def worst_cases(spark, sf_dir):
    e = M.errors(predictions(spark, sf_dir)).where(F.col("ape").isNotNull()).orderBy(F.desc("ape"), "sale_id").limit(50)
    return rounded(e.select("sale_id", "block", "prediction", "actual", "ape"), "prediction", "actual", "ape")


#: Half-yearly predictions of the baseline: each sale's cutoff is the first day of its half-year.
_CUTOFFS = "SELECT make_date(y, m, 1) AS cutoff FROM (SELECT unnest(range(1996, 2002)) AS y), (SELECT unnest([1, 7]) AS m)"
HALF_SQL = f"""WITH {SALE_SQL}, cut AS ({_CUTOFFS}),
{", ".join(f"h_{k} AS (SELECT {key} AS key, cutoff, quantile_cont(unit_price, 0.5) AS m FROM sale JOIN cut ON sale_date < cutoff AND sale_date >= cutoff - INTERVAL 365 DAY GROUP BY ALL)" for k, key in V.KEYS.items())},
hp AS (SELECT sale_id, community_id, block, district, sale_date, cut.cutoff, unit_price AS actual, coalesce(c.m, b.m, d.m) AS prediction, CASE WHEN area % 9 = 0 THEN 'floors missing' ELSE 'complete' END AS state,
    CASE WHEN cut.cutoff < DATE '2001-01-01' THEN 'train_oof' WHEN cut.cutoff < DATE '2001-07-01' THEN 'reserved' ELSE 'holdout' END AS source
    FROM sale JOIN cut ON cut.cutoff = make_date(year(sale_date), CASE WHEN month(sale_date) > 6 THEN 7 ELSE 1 END, 1) LEFT JOIN h_community c ON c.key = community_id AND c.cutoff = cut.cutoff
    LEFT JOIN h_block b ON b.key = block AND b.cutoff = cut.cutoff LEFT JOIN h_district d ON d.key = district AND d.cutoff = cut.cutoff),
r AS (SELECT *, ln(actual / prediction) AS residual FROM hp WHERE prediction IS NOT NULL)"""
_CAL = f"""{HALF_SQL}, used AS (SELECT * FROM r WHERE (state = 'complete' AND source = 'train_oof') OR (state <> 'complete' AND source = 'reserved')),
t AS (SELECT layer, quantile_cont(residual, 0.1) AS q_lo, quantile_cont(residual, 0.9) AS q_hi, count(*) AS n, string_agg(DISTINCT source, '+' ORDER BY source) AS residual_source
    FROM (SELECT unnest([state || '|' || district, state || '|global', 'global']) AS layer, residual, source FROM used) GROUP BY 1 HAVING count(*) >= 40 OR layer = 'global')"""


def half_yearly(spark, sf_dir):
    """Out-of-fold predictions: every sale from 1996 on by the baseline at the start of its half-year. Those of the
    development folds, of the reserved slice and of the hold-out are told apart by source."""
    s = sales(spark, sf_dir)
    cutoff = V.half_start(F.col("sale_date"))
    p = V.baseline_at(s.where(F.col("sale_date") >= day("1996-01-01")), s, cutoff, V.half_reach())
    source = F.when(cutoff < day("2001-01-01"), "train_oof").when(cutoff < day("2001-07-01"), "reserved").otherwise("holdout")
    p = p.select("sale_id", "district", F.col("baseline").alias("prediction"), F.col("unit_price").alias("actual"), F.when(F.col("area") % 9 == 0, "floors missing").otherwise("complete").alias("state"), source.alias("source"))
    return scratch.cut(p.where(F.col("prediction").isNotNull()).withColumns({"residual": F.ln(F.col("actual") / F.col("prediction")), "part": F.col("district")}), "half-yearly")


def interval_table(p):
    """Rows whose floors are known by residuals of folds that did not train on them, the others by the reserved slice."""
    used = p.where(((F.col("state") == "complete") & (F.col("source") == "train_oof")) | ((F.col("state") != "complete") & (F.col("source") == "reserved")))
    return M.calibrated(used, 40, (0.1, 0.9))


@query("interval_calibration", _CAL + " SELECT layer, residual_source, round(q_lo, 6) AS q_lo, round(q_hi, 6) AS q_hi, n FROM t")
def interval_calibration(spark, sf_dir):
    return rounded(interval_table(half_yearly(spark, sf_dir)), "q_lo", "q_hi").select("layer", "residual_source", "q_lo", "q_hi", "n")


_LOOK = _CAL + """, i AS (SELECT r.*, coalesce(a.layer, s.layer, g.layer) AS used_layer, prediction * exp(coalesce(a.q_lo, s.q_lo, g.q_lo)) AS lo, prediction * exp(coalesce(a.q_hi, s.q_hi, g.q_hi)) AS hi,
    prediction * exp(g.q_lo) AS lo_before, prediction * exp(g.q_hi) AS hi_before FROM r LEFT JOIN t a ON a.layer = r.state || '|' || r.district LEFT JOIN t s ON s.layer = r.state || '|global' LEFT JOIN t g ON g.layer = 'global' WHERE source = 'holdout')"""


def _looked_up(spark, sf_dir):
    """The hold-out's intervals: rows that no calibration has seen."""
    p = half_yearly(spark, sf_dir)
    return M.with_interval(p.where("source = 'holdout'").withColumn("layer", F.concat_ws("|", "state", "part")), interval_table(p), "layer")


@query("interval_lookup", _LOOK + " SELECT sale_id, used_layer, round(lo, 4) AS lo, round(hi, 4) AS hi FROM i")
def interval_lookup(spark, sf_dir):
    return _looked_up(spark, sf_dir).select("sale_id", "used_layer", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


_WITHIN = "count(*) AS n, round(avg((actual BETWEEN {0} * (1 - 1e-9) AND {1} * (1 + 1e-9))::INT), 6) AS coverage, round(quantile_cont(({1} - {0}) / prediction, 0.5), 6) AS width FROM i GROUP BY 2"


@query("interval_eval", _LOOK + f" SELECT 'one layer' AS kind, state, {_WITHIN.format('lo_before', 'hi_before')} UNION ALL SELECT 'by layer', state, {_WITHIN.format('lo', 'hi')}")
def interval_eval(spark, sf_dir):
    """Coverage and width over the hold-out: one layer for all rows, and layers by state and district."""
    p = half_yearly(spark, sf_dir)
    table, hold = interval_table(p), p.where("source = 'holdout'").withColumn("layer", F.concat_ws("|", "state", "part"))
    both = [M.with_interval(hold, t, "layer").withColumn("kind", F.lit(kind)) for kind, t in (("one layer", table.where("layer = 'global'")), ("by layer", table))]
    return rounded(M.interval_report(scratch.cut(both[0].unionByName(both[1])), ["kind", "state"]), "coverage", "width")


@query("monotone_widths", _P + """, w AS (SELECT level, CASE level WHEN 'community' THEN 1 WHEN 'block' THEN 2 ELSE 3 END AS rank, quantile_cont(unit_price / baseline, 0.9) - quantile_cont(unit_price / baseline, 0.1) AS width FROM b0 GROUP BY 1)
SELECT level, rank, round(max(width) OVER (ORDER BY rank), 6) AS width FROM w""")
def monotone_widths(spark, sf_dir):
    b = b0(spark, sf_dir).withColumns({"rank": F.when(F.col("level") == "community", 1).when(F.col("level") == "block", 2).otherwise(3), "ratio": F.col("unit_price") / F.col("baseline")})
    w = b.groupBy("level", "rank").agg((F.percentile("ratio", 0.9) - F.percentile("ratio", 0.1)).alias("width"))
    return rounded(M.widened(w, "rank"), "width")


def _boot_sql(name: str, unit: str, seed: int, replicates: int) -> str:
    times = " + ".join(f"(u >= {c!r})::INT" for c in M.POISSON)
    u = f"('0x' || substr(md5(unit || ':' || replicate || ':{seed}'), 1, 8))::BIGINT / 4294967296.0"
    return f"""u_{name} AS (SELECT {unit} AS unit, sum(d) AS total, count(*) AS n FROM d GROUP BY 1), x_{name} AS (SELECT *, {u} AS u FROM u_{name}, (SELECT unnest(range({replicates})) AS replicate)),
{name} AS (SELECT replicate, sum(t * total) / sum(t * n) AS mean FROM (SELECT *, {times} AS t FROM x_{name}) GROUP BY 1)"""


_D = B0_SQL + ", d AS (SELECT sale_id, sale.community_id, year(sale_date) * 12 + month(sale_date) AS fold, home_id, abs(baseline - unit_price) / unit_price - abs(1.05 * baseline - unit_price) / unit_price AS d FROM b0 JOIN sale USING (sale_id, unit_price, sale_date))"


def _differences(spark, sf_dir):
    b = b0(spark, sf_dir)
    a = F.abs(F.col("baseline") - F.col("unit_price")) / F.col("unit_price") - F.abs(F.col("baseline") * 1.05 - F.col("unit_price")) / F.col("unit_price")
    return b.select("sale_id", "home_id", "community_id", (F.year("sale_date") * 12 + F.month("sale_date")).alias("fold"), a.alias("d"))


UNITS = (("home_id", "home"), ("fold", "fold"), ("community_id", "community"))


def _bounds(name):
    return f"round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM {name}"


@query("paired_bootstrap", f"{_D}, {_boot_sql('b', 'home_id', 7, 200)} SELECT replicate, round(mean, 6) AS mean FROM b")
def paired_bootstrap(spark, sf_dir):
    return rounded(M.bootstrap(_differences(spark, sf_dir), "home_id", "d", 200, 7), "mean")


@query("block_bootstrap", f"{_D}, {', '.join(_boot_sql(name[0], unit, 7, 500) for unit, name in UNITS)} " + " UNION ALL ".join(f"SELECT '{name}' AS unit, {_bounds(name[0])}" for _, name in UNITS))
def block_bootstrap(spark, sf_dir):
    """Three conventions side by side: homes, folds and communities as the units that are drawn."""
    d, out = scratch.cut(_differences(spark, sf_dir), "differences"), None
    for unit, name in UNITS:
        one = M.bootstrap(d, unit, "d", 500, 7).agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi")).select(F.lit(name).alias("unit"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
        out = one if out is None else out.unionByName(one)
    return out


@query("bootstrap_envelope", f"{_D}, {_boot_sql('h', 'home_id', 20260914, 2000)}, {_boot_sql('f', 'fold', 20260914, 2000)}, q AS (SELECT {_bounds('h')} UNION ALL SELECT {_bounds('f')}) SELECT min(lo) AS lo, max(hi) AS hi FROM q")
def bootstrap_envelope(spark, sf_dir):
    """D17 as published: 2000 replicates by each of two units, and the outer bounds."""
    d = scratch.cut(_differences(spark, sf_dir), "differences")
    return rounded(M.envelope([M.bootstrap(d, unit, "d", 2000, 20260914) for unit in ("home_id", "fold")]), "lo", "hi")


@query("config_selection", "WITH " + SALE_SQL + ", c AS (SELECT year(sale_date) AS fold, unnest([1.0, 3.0, 10.0]) AS config, unit_price, area FROM sale), s AS (SELECT fold, config, round(abs(avg(unit_price) - 2000 * config), 4) AS score FROM c GROUP BY 1, 2) SELECT fold, config, score FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score, config) AS k FROM s) WHERE k = 1")
def config_selection(spark, sf_dir):
    c = sales(spark, sf_dir).select(F.year("sale_date").alias("fold"), F.explode(F.array(F.lit(1.0), F.lit(3.0), F.lit(10.0))).alias("config"), "unit_price")
    return M.selected(c.groupBy("fold", "config").agg(F.round(F.abs(F.avg("unit_price") - F.col("config") * 2000), 4).alias("score")), "fold")


@query("power_gate", _P + """, q AS (SELECT CASE WHEN level = 'community' THEN 0.0 ELSE 0.05 END AS difference, level <> 'community' AS changed, prediction IS NOT NULL AS covered FROM p), a AS (SELECT count(*) AS n, avg((difference = 0)::INT) AS zero_share, avg((NOT changed)::INT) AS noop_rate, avg(covered::INT) AS coverage, avg(difference) AS effect FROM q)
SELECT n, round(zero_share, 6) AS zero_share, round(noop_rate, 6) AS noop_rate, round(coverage, 6) AS coverage, round(effect, 6) AS effect, CASE WHEN NOT (n >= 30 AND zero_share <= 0.5 AND noop_rate <= 0.3 AND coverage >= 0.5) THEN 'EVIDENCE_INSUFFICIENT' WHEN abs(effect) >= 0.02 THEN 'CANDIDATE_INTEGRATION' ELSE 'NO_VALUE' END AS conclusion FROM a""")
def power_gate(spark, sf_dir):
    own = F.col("level") == "community"
    q = predictions(spark, sf_dir).select(F.when(own, 0.0).otherwise(0.05).alias("difference"), (~own).alias("changed"), F.col("prediction").isNotNull().alias("covered"))
    return rounded(M.power_gate(q), "zero_share", "noop_rate", "coverage", "effect")


# Published acceptance thresholds.
THRESHOLDS = [("medape", 0.12, True), ("p90", 0.31, True), ("hit10", 0.51, False), ("bias", 0.05, True), ("over20", 0.18, True), ("coverage", 0.95, False)]


@query("independent_verdict", _P + f""", a AS (SELECT {_PACK} FROM e), m AS (SELECT unnest([{{'metric': 'medape', 'value': medape}}, {{'metric': 'p90', 'value': p90}}, {{'metric': 'hit10', 'value': hit10}}, {{'metric': 'bias', 'value': abs(bias)}}, {{'metric': 'over20', 'value': over20}}, {{'metric': 'coverage', 'value': coverage}}]) AS x, n FROM a),
t(metric, lim, at_most) AS (VALUES {", ".join(f"('{a}', {b}, {str(c).lower()})" for a, b, c in THRESHOLDS)})
SELECT t.metric, round(x.value, 6) AS value, CASE WHEN at_most THEN x.value <= lim ELSE x.value >= lim END AS met, CASE WHEN abs(x.value - lim) < 0.01 OR n < 200 THEN 'insufficient/edge' WHEN CASE WHEN at_most THEN x.value <= lim ELSE x.value >= lim END THEN 'pass' ELSE 'return' END AS verdict FROM m JOIN t ON t.metric = x.metric""")
def independent_verdict(spark, sf_dir):
    return measured_verdict(spark, predictions(spark, sf_dir)).select("metric", F.round("value", 6).alias("value"), "met", "verdict")


def measured_verdict(spark, p):
    a = rounded(M.pack(p), *_METRICS).withColumn("bias", F.abs("bias"))
    long = a.select("n", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in _METRICS])).alias("x")).select("n", "x.metric", "x.value")
    t = spark.createDataFrame(THRESHOLDS, "metric string, limit double, at_most boolean")
    return M.verdict(long, t)


_LONG = ", ".join(f"{{'metric': '{m}', 'value': {'abs(bias)' if m == 'bias' else m}}}" for m in _METRICS)
_MET = "CASE WHEN at_most THEN value <= lim ELSE value >= lim END"


def _verdict_sql(name: str, rows: str) -> str:
    return f"""{name}_a AS (SELECT {_PACK} FROM e WHERE {rows}), {name}_m AS (SELECT x.metric AS metric, x.value AS value, n FROM (SELECT unnest([{_LONG}]) AS x, n FROM {name}_a)),
{name} AS (SELECT t.metric, value, {_MET} AS met, CASE WHEN abs(value - lim) < 0.01 OR n < 200 THEN 'insufficient/edge' WHEN {_MET} THEN 'pass' ELSE 'return' END AS verdict FROM {name}_m m JOIN t ON t.metric = m.metric)"""


@query("verdict_expansion", _P + f""", t(metric, lim, at_most) AS (VALUES {", ".join(f"('{a}', {b}, {str(c).lower()})" for a, b, c in THRESHOLDS)}), {_verdict_sql("one", "sale_date < DATE '2001-01-01'")}, {_verdict_sql("two", "true")}
SELECT one.metric, round(one.value, 6) AS value, one.verdict, round(CASE WHEN one.verdict = 'insufficient/edge' THEN two.value END, 6) AS expanded_value,
    CASE WHEN one.verdict <> 'insufficient/edge' THEN one.verdict WHEN two.met THEN 'pass' ELSE 'return' END AS final FROM one JOIN two USING (metric)""")
def verdict_expansion(spark, sf_dir):
    """R8's one expansion: the sales up to 2001 first, then all of them for the metrics at the edge."""
    p = predictions(spark, sf_dir)
    first, second = measured_verdict(spark, p.where(F.col("sale_date") < day("2001-01-01"))), measured_verdict(spark, p)
    done = M.expanded_verdict(first, second)
    return done.select("metric", F.round("value", 6).alias("value"), "verdict", F.round("expanded_value", 6).alias("expanded_value"), "final")


@query("disclosure", _P + " SELECT CASE WHEN prediction IS NOT NULL THEN 'normal' WHEN level <> 'none' THEN 'fallback' ELSE 'missing' END AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM p GROUP BY 1")
def disclosure(spark, sf_dir):
    s = F.when(F.col("prediction").isNotNull(), "normal").when(F.col("level") != "none", "fallback").otherwise("missing")
    by = predictions(spark, sf_dir).groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("all")))).select("status", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row on the right


@query("stratified_sample", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || 's1'), c_custkey) AS k FROM customer) WHERE k <= 20")
def stratified_sample(spark, sf_dir):
    return M.stratified_sample(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", "s1", 20)


@query("chronological_split", "WITH " + SALE_SQL + ", f AS (SELECT community_id, min(sale_date) AS first FROM sale GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY first, community_id) AS k, count(*) OVER () AS n FROM f) SELECT community_id, CAST(first AS VARCHAR) AS first, CASE WHEN k <= floor(n * 0.7) THEN 'develop' ELSE 'confirm' END AS part FROM r")
def chronological_split(spark, sf_dir):
    return M.chronological_split(sales(spark, sf_dir), "community_id", "sale_date").select("community_id", F.col("first").cast("string").alias("first"), "part")
