"""Queries on candidate requests, guards and formal release."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.config import CUTOFF
from valora.operators import evidence as V, release as R
from valora.plans.evidence import B0_SQL, b0
from valora.plans.registry import query
from valora.sources.tables import SALE_SQL, day, sales, table

_REQ = """WITH rq AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey AS request_id, l_partkey % 450 AS community_id, CASE WHEN l_quantity % 5 = 0 THEN NULL WHEN l_quantity % 7 = 0 THEN 'Brand#99' WHEN l_quantity % 3 = 0 THEN 'Brand#' || (l_suppkey % 25 + 1) ELSE p_brand END AS block_name FROM lineitem JOIN part ON l_partkey = p_partkey),
hs AS (SELECT p_partkey % 400 AS community_id, list_sort(list(DISTINCT p_brand)) AS blocks FROM part GROUP BY 1), mp AS (SELECT DISTINCT p_partkey % 400 AS community_id, 'Brand#99' AS cur FROM part WHERE p_partkey % 400 % 2 = 0),
k AS (SELECT rq.*, blocks, blocks IS NOT NULL AS known, block_name IS NOT NULL AND coalesce(list_contains(blocks, block_name), false) AS member, block_name IS NOT NULL AND NOT coalesce(list_contains(blocks, block_name), false) AND coalesce(block_name = cur, false) AS trans FROM rq LEFT JOIN hs USING (community_id) LEFT JOIN mp USING (community_id)),
b AS (SELECT request_id, CASE WHEN NOT known THEN 'none' WHEN member THEN 'request' WHEN trans THEN 'translated' ELSE 'derived' END AS block_source, CASE WHEN known AND member THEN block_name WHEN known THEN blocks[1] END AS block,
known AND len(blocks) > 1 AND NOT member AND NOT trans AS block_ambiguous, known AND block_name IS NOT NULL AND NOT member AND NOT trans AS block_mismatch, CASE WHEN known AND len(blocks) > 1 AND NOT member AND NOT trans THEN array_to_string(blocks, '|') END AS block_candidates FROM k)"""


def block_requests(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    q = F.col("l_quantity")
    name = F.when(q % 5 == 0, F.lit(None)).when(q % 7 == 0, "Brand#99").when(q % 3 == 0, F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1)).otherwise(F.col("p_brand"))
    rq = line.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").alias("request_id"), (F.col("l_partkey") % 450).alias("community_id"), name.alias("block_name"))
    community = (F.col("p_partkey") % 400).alias("community_id")
    history = part.select(community, F.col("p_brand").alias("block")).distinct()
    drift = part.where("p_partkey % 400 % 2 = 0").select(community, F.lit("Brand#99").alias("current_block"), F.lit("drifted").alias("category")).distinct()
    return R.resolved_blocks(rq, history, drift)


@query("block_resolution", _REQ + " SELECT request_id, block, block_source, block_ambiguous, block_mismatch, block_candidates FROM b")
def block_resolution(spark, sf_dir):
    return block_requests(spark, sf_dir).select("request_id", "block", "block_source", "block_ambiguous", "block_mismatch", "block_candidates")


@query("block_translation", _REQ + " SELECT block_source, count(*) AS n, count(*) FILTER (WHERE block_ambiguous) AS ambiguous, count(*) FILTER (WHERE block_mismatch) AS mismatch FROM b GROUP BY 1")
def block_translation(spark, sf_dir):
    return block_requests(spark, sf_dir).groupBy("block_source").agg(F.count(F.lit(1)).alias("n"), F.count_if("block_ambiguous").alias("ambiguous"), F.count_if("block_mismatch").alias("mismatch"))


_CAND = B0_SQL + """, cd AS (SELECT *, baseline * (1 + (area % 11 - 5) / 20) AS m1, CASE WHEN area % 3 = 0 THEN NULL ELSE baseline * (1 + (area % 13 - 6) / 25) END AS a1, CASE WHEN area % 9 = 0 THEN NULL ELSE area END AS floors FROM b0),
fl AS (SELECT *, coalesce(a1 IS NULL AND abs(m1 - baseline) / baseline > 0.15, false) AS diverges, coalesce(abs(a1 - m1) / m1 > 0.15, false) AS conflicts, CASE WHEN floors IS NULL THEN 'without floors' ELSE 'full' END AS branch FROM cd)"""


def candidates(spark, sf_dir):
    """The baseline with a model and an assisted price made from it by fixed rules."""
    a = F.col("area")
    c = b0(spark, sf_dir).withColumns({"m1": F.col("baseline") * (1 + (a % 11 - 5) / 20), "a1": F.when(a % 3 != 0, F.col("baseline") * (1 + (a % 13 - 6) / 25)), "floors": F.when(a % 9 != 0, a)})
    return c.withColumns({"diverges": R.divergence_flag(F.col("a1"), F.col("m1"), F.col("baseline")), "conflicts": R.conflict_flag(F.col("a1"), F.col("m1")), "branch": R.degraded(F.col("floors"))})


@query("candidate_guard", _CAND + " SELECT sale_id, round(m1, 6) AS m1, round(a1, 6) AS a1, diverges, conflicts, branch FROM fl")
def candidate_guard(spark, sf_dir):
    return candidates(spark, sf_dir).select("sale_id", F.round("m1", 6).alias("m1"), F.round("a1", 6).alias("a1"), "diverges", "conflicts", "branch")


_GATE = _CAND + f""", lc AS (SELECT community_id, max(sale_date) AS last_case FROM sale WHERE sale_date < DATE '{CUTOFF}' GROUP BY 1),
gt AS (SELECT fl.*, last_case, area BETWEEN 2.0 AND 48.0 AS in_range, list_sort(list_filter([CASE WHEN NOT (level = 'community' AND coalesce(community_n, 0) >= 5) THEN 'support' END, CASE WHEN area % 17 = 0 THEN 'block' END, CASE WHEN NOT coalesce(abs(m1 - baseline) / baseline <= 0.15, false) THEN 'divergence' END,
CASE WHEN floors IS NULL THEN 'interval' END, CASE WHEN NOT area BETWEEN 2.0 AND 48.0 THEN 'range' END, CASE WHEN NOT coalesce(sale_date - DATE '{CUTOFF}' <= 90 AND sale_date - last_case <= 180, false) THEN 'freshness' END], lambda x: x IS NOT NULL)) AS reasons FROM fl LEFT JOIN lc USING (community_id))"""


def gated(spark, sf_dir):
    c = candidates(spark, sf_dir)
    s = sales(spark, sf_dir).where(F.col("sale_date") < day(CUTOFF)).groupBy(F.col("community_id").alias("c")).agg(F.max("sale_date").alias("last_case"))
    j = c.join(s, F.col("community_id") == F.col("c"), "left").withColumns({
        "community_known": F.lit(True), "n_cases": F.col("community_n"), "block_source": F.lit("derived"), "block_mismatch": F.col("area") % 17 == 0, "block_ambiguous": F.lit(False), "b0": F.col("baseline"),
        "lo": F.when(F.col("floors").isNotNull(), F.col("m1") * 0.9), "hi": F.when(F.col("floors").isNotNull(), F.col("m1") * 1.1), "in_range": F.col("area").between(2.0, 48.0), "valuation_date": F.col("sale_date"), "cutoff": day(CUTOFF),
    })
    return j.withColumn("reasons", R.failed_checks())


@query("formal_gate", _GATE + " SELECT sale_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible FROM gt")
def formal_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("sale_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible"))


@query("servable_rate", _GATE + " SELECT count(*) AS n, round(avg((len(reasons) = 0)::INT), 6) AS servable, avg((len(reasons) = 0)::INT) >= 0.5 AS passes FROM gt")
def servable_rate(spark, sf_dir):
    ok = (F.size("reasons") == 0).cast("int")
    return gated(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok), 6).alias("servable"), (F.avg(ok) >= 0.5).alias("passes"))


@query("reject_reasons", _GATE + ", u AS (SELECT unnest(reasons) AS reason FROM gt) SELECT reason, count(*) AS n FROM u GROUP BY 1")
def reject_reasons(spark, sf_dir):
    return gated(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_SCENARIOS = [("normal", False, True, "full"), ("stopped", True, True, "full"), ("no record", False, False, "full"), ("branch suspended", False, True, "without floors"), ("unknown switch", None, True, "full")]


@query("formal_state", _GATE + f""", sc(scenario, stopped, record_ok, branch_on) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in _SCENARIOS)})
SELECT scenario, state, count(*) AS n, count(price) AS prices FROM (SELECT scenario, state, CASE WHEN state = 'priced' THEN m1 END AS price FROM (SELECT scenario, m1, CASE WHEN coalesce(stopped, true) THEN 'version_disabled' WHEN NOT record_ok THEN 'version_disabled' WHEN NOT in_range THEN 'input_rejected' WHEN branch <> branch_on THEN 'ineligible' WHEN len(reasons) > 0 THEN 'ineligible' ELSE 'priced' END AS state FROM gt, sc)) GROUP BY 1, 2""")
def formal_state(spark, sf_dir):
    sc = spark.createDataFrame(_SCENARIOS, "scenario string, stopped boolean, record_ok boolean, branch_on string")
    j = gated(spark, sf_dir).crossJoin(F.broadcast(sc))  # five fixed rows on the right
    j = j.withColumns({"state": R.formal_state(F.col("stopped"), F.col("record_ok"), F.col("in_range"), F.col("branch") == F.col("branch_on"), F.col("reasons")), "price": F.col("m1")})
    return R.only_priced(j, ["price"]).groupBy("scenario", "state").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"))


@query("bundle_match", """WITH i(name, n) AS (VALUES ('m1', 1), ('b0', 2), ('a1', 3), ('intervals', 4), ('block_prices', 5), ('inference_code', 6), ('eligibility_rules', 7), ('contract_hash', 8), ('block_map', 9)), f AS (SELECT s_suppkey AS bundle_id, name, n FROM supplier, i)
SELECT bundle_id, coalesce(string_agg(name, ',' ORDER BY n) FILTER (WHERE (bundle_id + n) % 13 = 0), '') AS mismatches, count(*) FILTER (WHERE (bundle_id + n) % 13 = 0) = 0 AS ok FROM f GROUP BY 1""")
def bundle_match(spark, sf_dir):
    wanted = F.create_map(*[x for k, n in enumerate(R.BUNDLE, 1) for x in (F.lit(n), F.lit(f"h{k}"))])
    found = F.create_map(*[x for k, n in enumerate(R.BUNDLE, 1) for x in (F.lit(n), F.when((F.col("s_suppkey") + k) % 13 != 0, F.lit(f"h{k}")))])
    bad = R.bundle_mismatches(found, wanted)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("bundle_id"), F.array_join(bad, ",").alias("mismatches"), (F.size(bad) == 0).alias("ok"))


@query("release_double_gate", "WITH " + SALE_SQL + ", t AS (SELECT *, CASE WHEN area % 9 = 0 THEN 'without floors' ELSE 'full' END AS branch, community_id IN (SELECT community_id FROM sale WHERE sale_date >= DATE '2001-01-01' GROUP BY 1 HAVING count(*) >= 4) AS listed FROM sale) SELECT branch, branch = 'full' AND listed AS formal, count(*) AS n FROM t GROUP BY 1, 2")
def release_double_gate(spark, sf_dir):
    s = sales(spark, sf_dir)
    rows = s.select("community_id", R.degraded(F.when(F.col("area") % 9 != 0, F.col("area"))).alias("branch"))
    listed = s.where(F.col("sale_date") >= day("2001-01-01")).groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    decisions = spark.createDataFrame([("full", True), ("without floors", False)], "branch string, confirmed boolean")
    return R.double_gate(rows, decisions, listed).groupBy("branch", "formal").agg(F.count(F.lit(1)).alias("n"))


@query("branch_suspension", "WITH " + SALE_SQL + " SELECT block AS branch, count(*) AS n FROM sale WHERE block NOT IN (SELECT block FROM sale GROUP BY 1 HAVING max(unit_price) > 100000) GROUP BY 1")
def branch_suspension(spark, sf_dir):
    s = sales(spark, sf_dir).withColumnRenamed("block", "branch")
    risks = s.groupBy("branch").agg((F.max("unit_price") <= 100000).alias("passed")).withColumn("hard", F.lit(True))
    return R.suspended(s.select("branch"), risks).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))


@query("review_records", _CAND + " SELECT sale_id AS result_id, round(m1, 6) AS before, round(m1 * 0.98, 6) AS after, 'site visit' AS reason, 'r1' AS rule_version FROM fl WHERE conflicts AND area % 4 = 0")
def review_records(spark, sf_dir):
    c = candidates(spark, sf_dir)
    results = c.select(F.col("sale_id").alias("result_id"), F.col("m1").alias("value"))
    edits = c.where(F.col("conflicts") & (F.col("area") % 4 == 0)).select(F.col("sale_id").alias("result_id"), (F.col("m1") * 0.98).alias("after"), F.lit("site visit").alias("reason"), F.lit("2001-07-01").alias("reviewed_at"), F.lit("r1").alias("rule_version"))
    return R.reviewed(results, edits).select("result_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "reason", "rule_version")


@query("cold_start", B0_SQL + " SELECT CASE WHEN level = 'community' THEN 'own evidence' WHEN baseline IS NOT NULL THEN 'reference from ' || level ELSE 'rejected' END AS outcome, count(*) AS n FROM b0 GROUP BY 1")
def cold_start(spark, sf_dir):
    return b0(spark, sf_dir).groupBy(R.cold_start(F.col("level"), F.col("baseline")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("candidate_result", _GATE + " SELECT sale_id, round(m1, 6) AS price, round(CASE WHEN floors IS NOT NULL THEN m1 * 0.9 END, 6) AS lo, CASE WHEN len(reasons) > 0 THEN 'ineligible' ELSE 'priced' END AS status, community_n AS n_cases, len(reasons) AS n_limits, 9 AS n_fingerprints FROM gt WHERE in_range")
def candidate_result(spark, sf_dir):
    g = gated(spark, sf_dir).where("in_range").withColumn("state", R.formal_state(F.lit(False), F.lit(True), F.col("in_range"), F.lit(True), F.col("reasons")))
    r = R.result(g, bundle(spark, sf_dir))
    prints = F.col("result.fingerprints")
    return r.select(
        "sale_id", F.round("result.price", 6).alias("price"), F.round("result.interval.lo", 6).alias("lo"), "result.status", "result.support.n_cases", F.size("result.limits").alias("n_limits"),
        F.size(F.array_distinct(F.map_values(prints))).alias("n_fingerprints"),
    )


def bundle(spark, sf_dir):
    """Fingerprints of what the candidates of this run are made from."""
    from valora import config
    from valora.operators import comparables, evidence, metrics, models, release

    s = sales(spark, sf_dir)
    tables = {f"b0_{level}": V.level_medians(s, day(CUTOFF), level) for level in V.LEVELS}
    part = table(spark, sf_dir, "part")
    found = R.fingerprints(
        {"b0": tables["b0_community"], "block_prices": tables["b0_block"], "block_map": part.select("p_partkey", "p_brand"), "a1": s.select("sale_id", "unit_price"), "intervals": tables["b0_district"]},
        {"m1": [models], "inference_code": [comparables, evidence, metrics], "eligibility_rules": [release], "contract_hash": [config]},
    )
    return found
