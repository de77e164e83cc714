"""Queries on census, policy, arrivals, cost, integrity and the shadow store."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.config import AS_OF, CUTOFF, EARLIER_AS_OF, PARAMS
from valora.operators import annotations as N, census as C, evidence as V, integrity as I, joins as J
from valora.plans.registry import query
from valora.sources.tables import SALE_SQL, day, sales, table

_WITH = "WITH " + SALE_SQL


def _measures_sql(as_of: str) -> str:
    within = "sale_date > DATE '{0}' - INTERVAL {1} MONTH AND sale_date <= DATE '{0}'"
    counts = ", ".join(f"count(*) FILTER (WHERE {within.format(as_of, m)}) AS cases_{m}m" for m in (3, 6, 12))
    return f"{counts}, CAST(max(sale_date) FILTER (WHERE sale_date <= DATE '{as_of}') AS VARCHAR) AS last_sale, round(quantile_cont(unit_price, 0.5) FILTER (WHERE {within.format(as_of, 12)}), 6) AS median_12m, CAST(min(sale_date) AS VARCHAR) AS sample_start"


def shown(df):
    return df.withColumns({"last_sale": F.col("last_sale").cast("string"), "sample_start": F.col("sample_start").cast("string"), "median_12m": F.round("median_12m", 6)})


def _census(spark, sf_dir, as_of: str):
    frame = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("community_id"), F.col("p_size").alias("size"))
    return C.census(frame, sales(spark, sf_dir).drop("total_floors"), "community_id", day(as_of))


def _census_sql(as_of: str) -> str:
    return f"(SELECT p_partkey AS community_id, p_size AS size, coalesce(cases_3m, 0) AS cases_3m, coalesce(cases_6m, 0) AS cases_6m, coalesce(cases_12m, 0) AS cases_12m, last_sale, median_12m, sample_start FROM part LEFT JOIN (SELECT community_id, {_measures_sql(as_of)} FROM sale GROUP BY 1) m ON p_partkey = m.community_id)"


@query("census_3_6_12", f"{_WITH} SELECT * EXCLUDE (size) FROM {_census_sql(AS_OF)}")
def census_3_6_12(spark, sf_dir):
    return shown(_census(spark, sf_dir, AS_OF)).drop("size")


@query("family_census", f"{_WITH}, x AS (SELECT sale_date, unit_price, block AS family, unnest([NULL, community_id]) AS member FROM sale) SELECT family, member, {_measures_sql(AS_OF)} FROM x GROUP BY 1, 2")
def family_census(spark, sf_dir):
    return shown(C.family_census(sales(spark, sf_dir), "block", "community_id", day(AS_OF)))


_TIER = "CASE WHEN size % 10 = 0 THEN 'reject' WHEN cases_12m >= 15 AND size % 4 <> 0 THEN 'include' WHEN cases_12m >= 8 THEN 'reference' ELSE 'reject' END"


def _tiers(spark, sf_dir, as_of: str):
    boundary = F.when(F.col("size") % 4 != 0, "confirmed").otherwise("pending")
    return _census(spark, sf_dir, as_of).select("community_id", "cases_12m", C.tier(F.col("cases_12m"), boundary, F.col("size") % 10 != 0).alias("tier"))


@query("scope_tiers", f"{_WITH} SELECT community_id, cases_12m, {_TIER} AS tier FROM {_census_sql(AS_OF)}")
def scope_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir, AS_OF)


@query("scope_tiers_draft", f"{_WITH} SELECT community_id, CASE WHEN community_id % 200 = 0 THEN 'include' WHEN size % 4 = 0 THEN 'pending boundary' WHEN cases_12m >= 15 THEN 'include' WHEN cases_12m >= 8 THEN 'reference' ELSE 'reject' END AS tier FROM {_census_sql(AS_OF)}")
def scope_tiers_draft(spark, sf_dir):
    boundary = F.when(F.col("size") % 4 != 0, "confirmed").otherwise("pending")
    return _census(spark, sf_dir, AS_OF).select("community_id", C.draft_tier(F.col("cases_12m"), boundary, F.col("community_id") % 200 == 0).alias("tier"))


@query("scope_diff", f"{_WITH}, a AS (SELECT community_id, {_TIER} AS tier FROM {_census_sql(EARLIER_AS_OF)}), b AS (SELECT community_id, {_TIER} AS tier FROM {_census_sql(AS_OF)}) SELECT community_id, 'changed' AS change, a.tier AS old_tier, b.tier AS new_tier FROM a JOIN b USING (community_id) WHERE a.tier IS DISTINCT FROM b.tier")
def scope_diff(spark, sf_dir):
    return J.diff(_tiers(spark, sf_dir, EARLIER_AS_OF), _tiers(spark, sf_dir, AS_OF), ["community_id"], ["tier"])


@query("missing_by_month", _WITH + " SELECT strftime(sale_date, '%Y-%m') AS month, count(*) AS n, round(avg((area % 7 = 0)::INT), 6) AS area_missing, round(avg((area % 9 = 0)::INT), 6) AS floors_missing FROM sale GROUP BY 1")
def missing_by_month(spark, sf_dir):
    s = sales(spark, sf_dir).select("sale_date", F.when(F.col("area") % 7 != 0, F.col("area")).alias("area"), F.when(F.col("area") % 9 != 0, F.col("total_floors")).alias("floors"))
    return C.missing_by_month(s, "sale_date", ["area", "floors"]).withColumns({c: F.round(c, 6) for c in ("area_missing", "floors_missing")})


@query("arrival_check", f"""{_WITH}, b AS (SELECT home_id, count(*) AS n, max(total_price) AS now, max(sale_date) AS newest FROM sale WHERE sale_date >= DATE '{CUTOFF}' GROUP BY 1), p AS (SELECT home_id, max(total_price) AS was FROM sale WHERE sale_date < DATE '{CUTOFF}' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE p.home_id IS NULL) AS new_keys, count(*) FILTER (WHERE p.home_id IS NOT NULL AND now IS DISTINCT FROM was) AS revised, CAST(sum(n - 1) AS BIGINT) AS repeats, CAST(max(newest) AS VARCHAR) AS newest FROM b LEFT JOIN p ON b.home_id = p.home_id""")
def arrival_check(spark, sf_dir):
    s = sales(spark, sf_dir)
    a = C.arrival(s.where(F.col("sale_date") >= day(CUTOFF)), s.where(F.col("sale_date") < day(CUTOFF)), "home_id", "total_price", "sale_date")
    return a.withColumn("newest", F.col("newest").cast("string"))


@query("drift_reconcile", """WITH c AS (SELECT DISTINCT p_partkey % 400 AS community_id, CASE WHEN p_partkey % 400 % 9 = 0 THEN NULL ELSE 'Brand#' || (p_partkey % 400 % 25 + 1) END AS cur FROM part), h AS (SELECT DISTINCT p_partkey % 400 AS community_id, p_brand AS block FROM part),
j AS (SELECT CASE WHEN cur IS NULL THEN 'missing' WHEN block IS NOT NULL THEN 'consistent' ELSE 'drifted' END AS category FROM c LEFT JOIN h ON c.community_id = h.community_id AND cur = block) SELECT category, count(*) AS n, (SELECT avg((category = 'drifted')::INT) > 0.5 FROM j) AS escalate FROM j GROUP BY 1""")
def drift_reconcile(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    c = F.col("p_partkey") % 400
    current = p.select(c.alias("community_id"), F.when(c % 9 != 0, F.concat(F.lit("Brand#"), c % 25 + 1)).alias("current_block")).distinct()
    return C.drift(current, p.select(c.alias("community_id"), F.col("p_brand").alias("block")))


@query("monthly_feedback", "WITH m AS (SELECT o_orderstatus AS branch, date_trunc('month', o_orderdate) AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2) SELECT branch, strftime(month, '%Y-%m') AS month, n, total, month + INTERVAL 1 MONTH <= CAST((SELECT max(o_orderdate) FROM orders) AS DATE) AS mature FROM m")
def monthly_feedback(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", F.col("o_totalprice").alias("value"))
    f = C.feedback(o, "o_orderstatus", "o_orderdate")
    return f.select("branch", F.date_format("month", "yyyy-MM").alias("month"), "n", F.round("total", 2).alias("total"), "mature")


@query("unit_inventory", "SELECT count(*) AS chains, count(DISTINCT l_orderkey) AS records, count(DISTINCT l_suppkey) AS clusters FROM lineitem")
def unit_inventory(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("chains"), F.count_distinct("l_orderkey").alias("records"), F.count_distinct("l_suppkey").alias("clusters"))


@query("cost_gate", "WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value) * 0.001, 6) AS cost, count(*) AS attempts FROM events GROUP BY 1) SELECT day, cost, attempts, round(sum(cost) OVER (ORDER BY day), 4) AS running, sum(cost) OVER (ORDER BY day) <= 50 AS go_on FROM d")
def cost_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), (F.col("value") * 0.001).alias("cost"))
    c = C.running_cost(e, "day", "cost", 50.0)
    return c.select("day", F.round("cost", 6).alias("cost"), "attempts", F.round("running", 4).alias("running"), "go_on")


@query("attempt_times", "SELECT event_type AS kind, count(*) AS n, round(quantile_cont(value * 10.0, 0.5), 4) AS wait_p50, round(quantile_cont(value * 20.0, 0.5), 4) AS work_p50, round(quantile_cont(value * 20.0, 0.9), 4) AS work_p90 FROM events GROUP BY 1")
def attempt_times(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    micros = F.round(F.col("value") * 10000).cast("long")
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("queued_at"), F.timestamp_micros(at + micros).alias("started_at"), F.timestamp_micros(at + micros * 3).alias("ended_at"))
    return C.attempt_times(log).withColumns({c: F.round(c, 4) for c in ("wait_p50", "work_p50", "work_p90")})


@query(
    "experiment_registry",
    """WITH f AS (SELECT unnest(range(8)) AS fold), l AS (SELECT unnest(['1', '3', '10']) AS lam), w AS (
    SELECT 'derivation' AS kind, count(*) AS want FROM f UNION ALL SELECT 'inner fit', count(*) FROM f, l UNION ALL SELECT 'outer fit', count(*) FROM f)
SELECT kind, want, want AS n, true AS ok FROM w UNION ALL SELECT 'rerun', NULL, 8, true""",
)
def experiment_registry(spark, sf_dir):
    """The runs of M1's experiment against its plan: derived cases, a fit for each fold and lambda, a refit for each fold.
    Runs come from the run's own tables; the derivation is run again as a check, which is no planned unit."""
    from valora.plans.evidence import development_folds
    from valora.plans.modelling import FOLDS, fold_models

    d, ridges = fold_models(spark, sf_dir)
    cases = V.fold_cases(d, development_folds(spark), 1).select("fold").distinct()
    runs = cases.select(F.lit("derivation").alias("kind"), F.col("fold").alias("unit"))
    runs = runs.unionByName(cases.select(F.lit("rerun").alias("kind"), F.col("fold").alias("unit")))
    runs = runs.unionByName(ridges.scores.select(F.lit("inner fit").alias("kind"), F.concat_ws(" ", "fold", F.col("config").cast("string")).alias("unit")))
    runs = runs.unionByName(ridges.weights().select(F.lit("outer fit").alias("kind"), F.col("fold").alias("unit")))
    planned = spark.createDataFrame([("derivation", len(FOLDS)), ("inner fit", len(FOLDS) * len(PARAMS.lambdas)), ("outer fit", len(FOLDS))], "kind string, units long")
    return C.registry_check(planned, runs).select("kind", "want", "n", "ok")


@query(
    "arrival_freshness",
    f"{_WITH} SELECT count(*) FILTER (WHERE sale_date BETWEEN DATE '{AS_OF}' - INTERVAL 90 DAY AND DATE '{AS_OF}') AS recent, round(avg((sale_date BETWEEN DATE '{AS_OF}' - INTERVAL 90 DAY AND DATE '{AS_OF}')::INT), 6) AS recent_share, DATE '{AS_OF}' - max(sale_date) AS stale_days FROM sale WHERE sale_date >= DATE '{CUTOFF}' AND sale_date <= DATE '{AS_OF}'",
)
def arrival_freshness(spark, sf_dir):
    s = sales(spark, sf_dir).where((F.col("sale_date") >= day(CUTOFF)) & (F.col("sale_date") <= day(AS_OF)))
    return C.freshness(s, "sale_date", day(AS_OF)).withColumn("recent_share", F.round("recent_share", 6))


@query("snapshot_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old_v, b.v AS new_v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 10 <> 0) a FULL OUTER JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 11 <> 0) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def snapshot_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = c.where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("v"))
    return J.diff(a, b, ["k"], ["v"])


@query("pending_tasks", "SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def pending_tasks(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"))
    return I.pending(tasks, table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("task")), "task").agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("first"))


@query("disclosure_gate", "SELECT DISTINCT p_brand AS item FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_type = 'SMALL' AND p_size > 45)")
def disclosure_gate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return I.missing_disclosures(p.select(F.col("p_brand").alias("item")).distinct(), p.where("p_type = 'SMALL' AND p_size > 45").select(F.col("p_brand").alias("item")), "item")


@query("completeness_gate", """WITH u AS (SELECT DISTINCT o_orderkey AS id, 'assets' AS part FROM orders UNION ALL SELECT DISTINCT l_orderkey, 'responses' FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'runs' FROM lineitem WHERE l_linenumber <= 4)
SELECT id, string_agg(part, ',' ORDER BY part) AS found_in FROM u GROUP BY 1 HAVING count(*) < 3""")
def completeness_gate(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return I.completeness(assets=table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), responses=line.select(F.col("l_orderkey").alias("id")), runs=line.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("id")))


@query("prediction_order", "SELECT CAST((SELECT max(o_orderdate) FROM orders) AS VARCHAR) AS last_prediction, CAST((SELECT min(l_shipdate) FROM lineitem) AS VARCHAR) AS first_evaluation, (SELECT max(o_orderdate) FROM orders) < (SELECT min(l_shipdate) FROM lineitem) AS ok")
def prediction_order(spark, sf_dir):
    p = I.predicted_first(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("predicted_at")), table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("evaluated_at")))
    return p.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("last_prediction", "first_evaluation")})


@query("selection_manifest", _WITH + f" SELECT reason, count(*) AS n FROM (SELECT CASE WHEN sale_date < DATE '{CUTOFF}' - INTERVAL 365 DAY OR sale_date >= DATE '{CUTOFF}' THEN 'outside window' WHEN community_id NOT IN (SELECT community_id FROM sale WHERE area > 40 GROUP BY 1 HAVING count(*) >= 5) THEN 'not supported' ELSE 'selected' END AS reason FROM sale) GROUP BY 1")
def selection_manifest(spark, sf_dir):
    s = sales(spark, sf_dir)
    support = s.where("area > 40").groupBy(F.col("community_id").alias("c")).agg(F.count(F.lit(1)).alias("k")).where("k >= 5")
    inside = (F.col("sale_date") >= F.date_sub(day(CUTOFF), 365)) & (F.col("sale_date") < day(CUTOFF))
    j = s.join(support, F.col("community_id") == F.col("c"), "left")
    return j.groupBy(F.when(~inside, "outside window").when(F.col("c").isNull(), "not supported").otherwise("selected").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("leakage_check", "SELECT 0 AS changed")
def leakage_check(spark, sf_dir):
    s = sales(spark, sf_dir).select("sale_id", "community_id", "block", "district", "sale_date", "unit_price")
    t = s.where(F.col("sale_date") >= day(CUTOFF)).drop("unit_price")
    found = I.leaks(lambda targets, known: V.with_fallback(targets, known, day(CUTOFF)).select("sale_id", "baseline", "level"), s, day(CUTOFF), t)
    return found.agg(F.count(F.lit(1)).alias("changed"))


@query("table_fingerprints")
def table_fingerprints(spark, sf_dir):
    """Rows only: digests of all whole tables that don't depend on the order of rows."""
    out = None
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        t = table(spark, sf_dir, name)
        one = I.table_fingerprint(t, t.columns).select(F.lit(name).alias("table"), "n", "fingerprint")
        out = one if out is None else out.unionByName(one)
    return out


@query("hash_chain", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, 0 AS broken FROM events GROUP BY 1")
def hash_chain(spark, sf_dir):
    """Builds a chain per day and checks every link by itself."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day"), "event_id", F.concat_ws("|", "event_type", "value", "props").alias("payload"))
    chain = I.chained(e, "event_id", "payload", "day")
    broken = I.broken_links(chain, "event_id", "payload", "day").groupBy(F.col("day").alias("d")).agg(F.count(F.lit(1)).alias("broken"))
    n = chain.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return n.join(broken, F.col("day") == F.col("d"), "left").select("day", "n", F.coalesce("broken", F.lit(0)).alias("broken"))


@query("html_listings", """SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="')) AS links FROM pages""")
def html_listings(spark, sf_dir):
    from valora.sources.files import parse_listing

    return parse_listing(table(spark, sf_dir, "pages"))


@query("download_checks", """WITH d AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, length(html) AS size, CASE WHEN page_id % 9 = 0 THEN 'image/bmp' ELSE 'text/html' END AS kind FROM pages)
SELECT page_id, CASE WHEN NOT regexp_matches(host, 'example\\.com$') THEN 'host not listed' WHEN kind <> 'text/html' THEN 'kind not allowed' WHEN size <= 0 THEN 'empty' WHEN size > 4000 THEN 'too large' ELSE 'accepted' END AS verdict FROM d""")
def download_checks(spark, sf_dir):
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    log = table(spark, sf_dir, "pages").select("page_id", F.when(host.rlike(r"example\.com$"), "example.com").otherwise(host).alias("host"), F.length("html").alias("size"), F.when(F.col("page_id") % 9 == 0, "image/bmp").otherwise("text/html").alias("kind"))
    return N.download_verdict(log, ["example.com"], ["text/html"], 4000).select("page_id", "verdict")


@query("response_hashes", "SELECT page_id FROM pages WHERE page_id % 10 = 0")
def response_hashes(spark, sf_dir):
    stored = F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    log = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("response_sha256"), stored.alias("stored"))
    return N.response_mismatches(log).select("page_id")


@query("fingerprint_rings", "SELECT s_suppkey AS item, CASE WHEN s_suppkey % 8 = 0 THEN 2 ELSE 3 END AS layers, CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END AS digests FROM supplier WHERE s_suppkey % 8 = 0 OR s_suppkey % 5 = 0")
def fingerprint_rings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item"), F.md5(F.col("s_name").cast("binary")).alias("digest"))
    other = s.withColumn("digest", F.when(F.col("item") % 5 == 0, "other").otherwise(F.col("digest")))
    return I.rings(s, other, s.where("item % 8 <> 0"))


@query("override_provenance", "SELECT CASE WHEN c_custkey % 6 = 0 THEN 'override' ELSE 'source' END AS provenance, count(*) AS n, round(sum(CASE WHEN c_custkey % 6 = 0 THEN c_custkey * 1.0 ELSE c_acctbal END), 2) AS total FROM customer GROUP BY 1")
def override_provenance(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o = c.where("c_custkey % 6 = 0").select("c_custkey", F.col("c_custkey").cast("double").alias("value"))
    twice = I.overridden(I.overridden(c, o, "c_custkey", "c_acctbal").drop("provenance"), o.union(o), "c_custkey", "c_acctbal")
    return twice.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
