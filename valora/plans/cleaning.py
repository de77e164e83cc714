"""Queries on parsing, missing values, cleaning and the population."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.functions import missing as V, parsing as P
from valora.operators import annotations as N, clean as C
from valora.plans.registry import query
from valora.sources.tables import RAW_SQL, SALE_SQL, raw_export, sales, table

STD_SQL = (
    "WITH "
    + RAW_SQL
    + """, std0 AS (
    SELECT *,
        CASE WHEN lower(trim(area_raw)) IN ('', 'no data', 'none', '--', '-', 'null') THEN NULL ELSE trim(area_raw) END AS area_text,
        CASE WHEN lower(trim(floor_raw)) IN ('', 'no data', 'none', '--', '-', 'null') THEN NULL ELSE trim(floor_raw) END AS floor_text,
        CASE WHEN lower(trim(decoration_raw)) = 'no data' THEN NULL ELSE lower(trim(decoration_raw)) END AS deco_text,
        CASE WHEN lower(trim(year_raw)) = 'no data' THEN NULL ELSE trim(year_raw) END AS year_text
    FROM raw
), std AS (
    SELECT *,
        TRY_CAST(area_text AS DOUBLE) AS area_value,
        CASE WHEN area_text IS NULL THEN 'MISSING' WHEN TRY_CAST(area_text AS DOUBLE) IS NULL THEN 'PARSE_FAILURE' ELSE 'PARSED' END AS area_status,
        CASE WHEN floor_text IS NULL THEN 'MISSING' WHEN regexp_matches(floor_text, '^(low|middle|high) floor') AND regexp_matches(floor_text, 'total (\\d+) floors') THEN 'PARSED' ELSE 'PARSE_FAILURE' END AS floor_status,
        nullif(regexp_extract(floor_text, '^(low|middle|high) floor', 1), '') AS band0,
        CAST(nullif(regexp_extract(floor_text, 'total (\\d+) floors', 1), '') AS INTEGER) AS floors0,
        CASE WHEN deco_text IS NULL THEN 'MISSING' WHEN deco_text IN ('fine', 'simple', 'rough') THEN 'PARSED' ELSE 'PARSE_FAILURE' END AS decoration_status,
        CASE WHEN lower(trim(orientation_raw)) IN ('s', 'south') THEN 'south' ELSE 'north-south' END AS orientation,
        CASE WHEN year_text IS NULL THEN 'MISSING' WHEN regexp_matches(year_text, '^\\d{4}$') THEN 'PARSED' ELSE 'PARSE_FAILURE' END AS year_status,
        CASE WHEN regexp_matches(date_raw, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'day' WHEN regexp_matches(date_raw, '^\\d{4}-\\d{2}$') THEN 'month' ELSE 'unknown' END AS date_precision
    FROM std0
), fin AS (
    SELECT *, CASE WHEN floor_status = 'PARSED' THEN band0 END AS band, CASE WHEN floor_status = 'PARSED' THEN floors0 END AS floors,
        CASE WHEN area_value <> 0 THEN total_price / area_value END AS unit_value,
        CAST(coalesce(nullif(regexp_extract(description, 'of (\\d+) floors', 1), ''), nullif(regexp_extract(description, 'level \\d+/(\\d+)', 1), '')) AS INTEGER) AS remark0
    FROM std
)"""
)


@query("missing_tags", STD_SQL + " SELECT area_status, count(*) AS n, count(area_value) AS n_values, coalesce(round(sum(area_value), 2), 0.0) AS total FROM fin GROUP BY 1")
def missing_tags(spark, sf_dir):
    s = C.standardised(raw_export(spark, sf_dir))
    return s.groupBy("area_status").agg(F.count(F.lit(1)).alias("n"), F.count("area_value").alias("n_values"), F.coalesce(F.round(F.sum("area_value"), 2), F.lit(0.0)).alias("total"))


@query(
    "missing_classes",
    f"""WITH {RAW_SQL}, j AS (SELECT CASE WHEN usage = 'parking' THEN 'NOT_APPLICABLE' WHEN area_raw IS NULL OR area_raw = 'no data' THEN 'MISSING' WHEN TRY_CAST(area_raw AS DOUBLE) IS NULL THEN 'PARSE_FAILURE'
    WHEN abs(CAST(area_raw AS DOUBLE) - CASE WHEN a % 6 = 0 THEN area + 9 ELSE area END) > 5 THEN 'CONFLICT' ELSE 'PARSED' END AS status, area_raw FROM raw)
SELECT status, count(*) AS n, coalesce(round(sum(CASE WHEN status = 'PARSED' THEN CAST(area_raw AS DOUBLE) END), 2), 0.0) AS total FROM j GROUP BY 1""",
)
def missing_classes(spark, sf_dir):
    """All five statuses of a field: parking lots have no living area, and a second source contradicts some areas."""
    r = raw_export(spark, sf_dir)
    said = V.without_placeholder(F.col("area_raw")).try_cast("double")
    other = F.when(F.col("area") % 6 == 0, F.col("area") + 9).otherwise(F.col("area"))
    value, status = V.judged(F.col("area_raw"), said, F.col("usage") != "parking", F.abs(said - other) <= 5)
    return r.select(value.alias("value"), status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.sum("value"), 2), F.lit(0.0)).alias("total"))


@query("floor_parse", STD_SQL + " SELECT band, floors, floor_status, count(*) AS n FROM fin GROUP BY ALL")
def floor_parse(spark, sf_dir):
    return C.standardised(raw_export(spark, sf_dir)).groupBy("band", "floors", "floor_status").agg(F.count(F.lit(1)).alias("n"))


_BUCKET = "CASE WHEN {0} <= 6 THEN 'low-rise' WHEN {0} <= 18 THEN 'mid-rise' WHEN {0} IS NOT NULL THEN 'high-rise' END"


@query(
    "floor_backfill",
    STD_SQL + f""", b AS (SELECT *, CASE WHEN remark0 BETWEEN 1 AND 60 THEN remark0 END AS floors_remark FROM fin)
SELECT CASE WHEN floors IS NOT NULL THEN 'floor text' WHEN floors_remark IS NOT NULL THEN 'remark' ELSE 'none' END AS floors_source,
    coalesce({_BUCKET.format("floors")} = {_BUCKET.format("floors_remark")}, true) AS agrees, count(*) AS n, sum(coalesce(floors, floors_remark)) AS floors_sum
FROM b GROUP BY ALL""",
)
def floor_backfill(spark, sf_dir):
    b = C.backfilled(C.standardised(raw_export(spark, sf_dir)))
    return b.groupBy("floors_source", "agrees").agg(F.count(F.lit(1)).alias("n"), F.sum("floors_final").alias("floors_sum"))


@query(
    "elevator_tristate",
    STD_SQL + """ SELECT CASE WHEN elevator_raw = 'yes' THEN true WHEN elevator_raw = 'no' THEN false WHEN floors > 7 THEN true END AS elevator,
    CASE WHEN elevator_raw IN ('yes', 'no') THEN 'disclosed' WHEN floors > 7 THEN 'inferred' ELSE 'unknown' END AS elevator_basis, count(*) AS n FROM fin GROUP BY ALL""",
)
def elevator_tristate(spark, sf_dir):
    return C.standardised(raw_export(spark, sf_dir)).groupBy("elevator", "elevator_basis").agg(F.count(F.lit(1)).alias("n"))


@query(
    "standard_attributes",
    STD_SQL + " SELECT CASE WHEN decoration_status = 'PARSED' THEN deco_text END AS decoration, orientation, CASE WHEN year_status = 'PARSED' THEN CAST(year_text AS INTEGER) END AS year_built, decoration_status, year_status, count(*) AS n FROM fin GROUP BY ALL",
)
def standard_attributes(spark, sf_dir):
    s = C.standardised(raw_export(spark, sf_dir))
    return s.groupBy("decoration", "orientation", "year_built", "decoration_status", "year_status").agg(F.count(F.lit(1)).alias("n"))


@query("unit_price", STD_SQL + " SELECT sale_id, round(unit_value, 6) AS unit_value FROM fin")
def unit_price(spark, sf_dir):
    return C.standardised(raw_export(spark, sf_dir)).select("sale_id", F.round("unit_value", 6).alias("unit_value"))


@query(
    "date_precision",
    STD_SQL + " SELECT date_precision, CASE date_precision WHEN 'day' THEN date_raw WHEN 'month' THEN date_raw || '-01' END AS date_value, count(*) AS n FROM fin GROUP BY ALL",
)
def date_precision(spark, sf_dir):
    return C.standardised(raw_export(spark, sf_dir)).groupBy("date_precision", F.col("date_value").cast("string").alias("date_value")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = """WITH n AS (
    SELECT p_partkey, p_type, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (' || lower(p_type) || ')' WHEN 1 THEN ' ( PROMO )' WHEN 2 THEN ' · 2' ELSE '' END AS name FROM part
), f AS (SELECT *, regexp_replace(lower(trim(name)), '[\\s·.]+', '', 'g') AS folded FROM n
), g AS (SELECT *, nullif(regexp_extract(folded, '\\(([^()]*)\\)$', 1), '') AS named FROM f)"""


@query(
    "name_normalise",
    _NAMES + " SELECT p_partkey, CASE WHEN named IS NULL OR named = lower(p_type) THEN regexp_replace(folded, '\\([^()]*\\)$', '') ELSE folded END AS normal, NOT (named IS NULL OR named = lower(p_type)) AS excluded FROM g",
)
def name_normalise(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(k == 0, F.concat(F.lit(" ("), F.lower("p_type"), F.lit(")"))).when(k == 1, " ( PROMO )").when(k == 2, " · 2").otherwise(""))
    normal, other = P.normal_name(name, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", normal.alias("normal"), other.alias("excluded"))


_REASON = """CASE WHEN usage IN ('parking', 'shop', 'apartment') THEN 'not ordinary residential' WHEN area_value IS NULL THEN 'area unknown' WHEN date_precision <> 'day' THEN 'date not to the day'
    WHEN area_value < 2.0 OR area_value > 48.0 THEN 'area out of range' WHEN total_price < 1000.0 OR total_price > 100000.0 THEN 'price out of range' WHEN unit_value < 100.0 OR unit_value > 20000.0 THEN 'unit price out of range' END"""


@query("clean_waterfall", STD_SQL + f" SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n, round(sum(total_price), 2) AS total FROM fin GROUP BY 1")
def clean_waterfall(spark, sf_dir):
    return C.waterfall(C.standardised(raw_export(spark, sf_dir)))


@query("clean_exclusions", STD_SQL + f" SELECT sale_id, {_REASON} AS reason, area_raw, date_raw, usage FROM fin WHERE {_REASON} IS NOT NULL")
def clean_exclusions(spark, sf_dir):
    return C.cleaned(C.standardised(raw_export(spark, sf_dir)))[1].select("sale_id", "reason", "area_raw", "date_raw", "usage")


@query("population_filter", STD_SQL + " SELECT count(*) AS all_rows, count(*) FILTER (WHERE district IN ('SMALL', 'LARGE')) AS in_district, count(*) FILTER (WHERE district IN ('SMALL', 'LARGE') AND usage IN ('residential', 'apartment')) AS residential FROM fin")
def population_filter(spark, sf_dir):
    return C.in_population(raw_export(spark, sf_dir), ["SMALL", "LARGE"])


@query(
    "attribute_coverage",
    STD_SQL + """, u AS (SELECT unnest([{'field': 'area', 'status': area_status}, {'field': 'floor', 'status': floor_status}, {'field': 'decoration', 'status': decoration_status}, {'field': 'year', 'status': year_status}]) AS x FROM fin)
SELECT x.field AS field, x.status AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY x.field), 6) AS share FROM u GROUP BY x.field, x.status""",
)
def attribute_coverage(spark, sf_dir):
    return C.coverage(C.standardised(raw_export(spark, sf_dir)), ["area", "floor", "decoration", "year"])


_HITS = " UNION ALL ".join(f"SELECT '{f} hit' AS measure, {f}_status = 'PARSED' AS hit FROM h WHERE {f}_status <> 'MISSING'" for f in ("area", "floor", "decoration", "year"))


@query(
    "attribute_health",
    STD_SQL
    + f""", h AS (SELECT *, CASE WHEN remark0 BETWEEN 1 AND 60 THEN remark0 END AS floors_remark FROM fin), x AS ({_HITS}
UNION ALL SELECT 'no floors at all', floor_status <> 'PARSED' AND floors_remark IS NULL FROM h
UNION ALL SELECT 'floors contradict', NOT coalesce({_BUCKET.format("floors")} = {_BUCKET.format("floors_remark")}, true) FROM h)
SELECT measure, count(*) AS rows, count(*) FILTER (WHERE hit) AS n, round(avg(hit::INT), 6) AS share FROM x GROUP BY 1""",
)
def attribute_health(spark, sf_dir):
    """D10's hit rates, joint floor failure and conflicts."""
    h = C.attribute_health(C.backfilled(C.standardised(raw_export(spark, sf_dir))), ["area", "floor", "decoration", "year"])
    return h.withColumn("share", F.round("share", 6))


@query("attached_fields", STD_SQL + " SELECT ladder_raw, round(CAST(regexp_extract(ladder_raw, '(\\d+) lifts (\\d+) households', 1) AS DOUBLE) / CAST(regexp_extract(ladder_raw, '(\\d+) lifts (\\d+) households', 2) AS DOUBLE), 6) AS lift_ratio, count(*) AS n FROM fin GROUP BY ALL")
def attached_fields(spark, sf_dir):
    s = C.standardised(raw_export(spark, sf_dir))
    return s.groupBy("ladder_raw", F.round("lift_ratio", 6).alias("lift_ratio")).agg(F.count(F.lit(1)).alias("n"))


_SAID = (("area_block", "area", None), ("ownership", "ownership", P.OWNERSHIPS), ("tax_class", "tax", P.TAX_CLASSES), ("tenure", "tenure", P.TENURES))
_FIELD_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS field, CASE WHEN said IS NULL OR said IN ('', 'no data', 'none', '--', '-', 'null') THEN 'MISSING' WHEN {'true' if known is None else f'said IN {known}'} THEN 'PARSED' ELSE 'PARSE_FAILURE' END AS status, "
    f"CASE WHEN said NOT IN ('', 'no data', 'none', '--', '-', 'null') AND {'true' if known is None else f'said IN {known}'} THEN said END AS value FROM (SELECT nullif(trim(regexp_extract({'lower(raw)' if known else 'raw'}, '(?:^|; ?){label}: ([^;]*)', 1)), '') AS said FROM att)"
    for name, label, known in _SAID
)


@query(
    "ownership_fields",
    f"""WITH {SALE_SQL}, att AS (SELECT CASE WHEN area % 8 = 0 THEN NULL ELSE 'area: ' || block || CASE WHEN area % 3 = 0 THEN '; ownership: Sole' WHEN area % 3 = 1 THEN '; ownership: joint?' ELSE '' END
    || CASE WHEN area % 5 = 0 THEN '; tax: no data' WHEN area % 5 < 3 THEN '; tax: over two years' ELSE '; tax: over five years' END || '; tenure: ' || CASE WHEN area % 4 = 0 THEN 'public' ELSE 'commodity' END END AS raw FROM sale)
SELECT field, status, value, count(*) AS n FROM ({_FIELD_SQL}) GROUP BY 1, 2, 3""",
)
def ownership_fields(spark, sf_dir):
    """B13's block, ownership, tax class and tenure out of an attached text, with status and coverage."""
    q = F.col("area")
    owner = F.when(q % 3 == 0, "; ownership: Sole").when(q % 3 == 1, "; ownership: joint?").otherwise("")
    tax = F.when(q % 5 == 0, "; tax: no data").when(q % 5 < 3, "; tax: over two years").otherwise("; tax: over five years")
    raw = F.when(q % 8 != 0, F.concat(F.lit("area: "), F.col("block"), owner, tax, F.lit("; tenure: "), F.when(q % 4 == 0, "public").otherwise("commodity")))
    said = P.attached(F.col("raw"))
    one = sales(spark, sf_dir).select(raw.alias("raw")).select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), s.alias("status"), v.alias("value")) for n, (v, s) in said.items()])).alias("x"))
    return one.groupBy("x.field", "x.status", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "building_fields",
    f"""WITH {SALE_SQL}, b AS (SELECT CASE WHEN total_floors % 5 = 0 THEN 'no data' WHEN total_floors % 5 = 1 THEN 'Tower' WHEN total_floors % 5 = 2 THEN 'slab' WHEN total_floors % 5 = 3 THEN 'slab and tower' ELSE 'castle' END AS raw,
    area AS net, CASE WHEN home_id % 9 < 4 THEN area + home_id % 5 - 1 END AS gross FROM sale)
SELECT CASE WHEN lower(raw) IN ('tower', 'slab', 'slab and tower', 'bungalow') THEN lower(raw) END AS building, CASE WHEN raw = 'no data' THEN 'MISSING' WHEN lower(raw) IN ('tower', 'slab', 'slab and tower', 'bungalow') THEN 'PARSED' ELSE 'PARSE_FAILURE' END AS status,
    count(*) AS n, count(gross) AS with_gross, round(avg(CASE WHEN gross >= net THEN net / gross END), 6) AS efficiency FROM b GROUP BY 1, 2""",
)
def building_fields(spark, sf_dir):
    """B14: building type, gross area and its coverage, and the efficiency ratio, which no default feature list has."""
    floors = F.col("total_floors") % 5
    raw = F.when(floors == 0, "no data").when(floors == 1, "Tower").when(floors == 2, "slab").when(floors == 3, "slab and tower").otherwise("castle")
    b = sales(spark, sf_dir).select(raw.alias("raw"), F.col("area").alias("net"), F.when(F.col("home_id") % 9 < 4, F.col("area") + F.col("home_id") % 5 - 1).alias("gross"))
    kind, status = P.building_type(F.col("raw"))
    return b.groupBy(kind.alias("building"), status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count("gross").alias("with_gross"), F.round(F.avg(P.efficiency(F.col("net"), F.col("gross"))), 6).alias("efficiency"))


@query("leak_guard", "SELECT * FROM (VALUES ('area', true), ('block', true), ('deal_date', false), ('list_price', false), ('total_price', false), ('unit_price', false)) t(column_name, allowed)")
def leak_guard(spark, sf_dir):
    names = ["area", "block", "deal_date", "list_price", "total_price", "unit_price"]
    bad = C.leak_columns(names)
    return spark.createDataFrame([(n, n not in bad) for n in names], "column_name string, allowed boolean")


@query("feature_groups", "WITH " + RAW_SQL + " SELECT community_id, strftime(sale_date, '%Y-%m') AS sale_month, count(*) AS n, round(avg(area), 6) AS area FROM raw GROUP BY 1, 2")
def feature_groups(spark, sf_dir):
    s = sales(spark, sf_dir).withColumn("sale_month", F.date_format("sale_date", "yyyy-MM"))
    return C.features(s, "base").groupBy("community_id", "sale_month").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("area"), 6).alias("area"))


def _regex_counts(text: str) -> str:
    return ", ".join(f"{{'kind': '{k}', 'hits': len(regexp_extract_all({text}, '{p}'))}}" for k, p in P.SENSITIVE.items())


@query("sensitive_scan", f"SELECT doc_id, x.kind AS kind, CAST(x.hits AS BIGINT) AS hits FROM (SELECT doc_id, unnest([{_regex_counts('text')}]) AS x FROM documents) WHERE x.hits > 0")
def sensitive_scan(spark, sf_dir):
    return C.sensitive(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


_MASKED = "text"
for _k, _p in P.SENSITIVE.items():
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '<{_k}>', 'g')"


@query("sensitive_mask", f"SELECT doc_id, length(m) AS n, md5(m) AS masked FROM (SELECT doc_id, {_MASKED} AS m FROM documents)")
def sensitive_mask(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select("doc_id", P.masked(F.col("text")).alias("m"))
    return m.select("doc_id", F.length("m").cast("long").alias("n"), F.md5("m").alias("masked"))


_REQUESTS = """WITH r AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, user_id, event_type, ts, value FROM events), q AS (
    SELECT event_id, CASE WHEN k % 10 = 0 THEN NULL ELSE user_id END AS community_id, CASE WHEN k % 17 = 0 THEN 500.0 ELSE value END AS area, CASE WHEN k % 13 = 0 THEN 1900 ELSE 1990 + k % 30 END AS year_built,
        CASE WHEN event_type = 'error' THEN 'shop' ELSE 'residential' END AS usage, CAST(ts AS DATE) AS valuation_date FROM r)"""


def requests(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(k % 10 != 0, F.col("user_id")).alias("community_id"), F.when(k % 17 == 0, 500.0).otherwise(F.col("value")).alias("area"), F.when(k % 13 == 0, 1900).otherwise(F.lit(1990) + k % 30).alias("year_built"),
        F.when(F.col("event_type") == "error", "shop").otherwise("residential").alias("usage"), F.to_date("ts").alias("valuation_date"),
    )


@query(
    "request_validation",
    _REQUESTS + """, v AS (SELECT event_id, CASE WHEN area IS NULL OR community_id IS NULL OR valuation_date IS NULL THEN 'missing field' WHEN area < 2.0 OR area > 48.0 THEN 'area out of range'
    WHEN year_built NOT BETWEEN 1950 AND 2026 THEN 'year out of range' WHEN usage NOT IN ('residential', 'apartment') THEN 'usage not covered' END AS reason FROM q)
SELECT event_id, reason, CASE WHEN reason IS NULL THEN 'normal' ELSE 'rejected' END AS status FROM v""",
)
def request_validation(spark, sf_dir):
    return C.validated(requests(spark, sf_dir)).select("event_id", "reason", "status")


_ANN = """WITH ann AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS image_id, l_orderkey AS record_id, l_suppkey % 5 AS run, CAST(l_quantity AS INTEGER) % 6 + 1 AS room_count,
    CASE WHEN CAST(l_quantity AS INTEGER) % 8 = 0 THEN NULL ELSE l_quantity END AS room_area, l_quantity * (0.8 + l_tax * 5) AS gross,
    CASE CAST(l_quantity AS INTEGER) % 5 WHEN 0 THEN 'ROOM_ONLY' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'CONFLICT' ELSE 'ACCEPTED' END AS status FROM lineitem)"""


@query(
    "annotation_admission",
    _ANN + """ SELECT CASE status WHEN 'ACCEPTED' THEN 'full' WHEN 'ROOM_ONLY' THEN 'rooms' ELSE 'excluded' END AS admitted,
    CASE WHEN status NOT IN ('ACCEPTED', 'ROOM_ONLY') THEN 'status ' || status WHEN status = 'ACCEPTED' AND room_area IS NULL THEN 'area missing' END AS reason,
    count(*) AS n, sum(CASE WHEN status IN ('ACCEPTED', 'ROOM_ONLY') THEN room_count END) AS rooms, round(sum(CASE WHEN status = 'ACCEPTED' THEN room_area END), 2) AS area FROM ann GROUP BY ALL""",
)
def annotation_admission(spark, sf_dir):
    a = N.admitted(N.annotations(spark, sf_dir))
    return a.groupBy("admitted", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("rooms").alias("rooms"), F.round(F.sum("area"), 2).alias("area"))


@query(
    "area_gap",
    _ANN + """ SELECT image_id, round(abs(room_area - gross), 6) AS gap, round(abs(room_area - gross) / gross, 6) AS relative, round(room_area / gross, 6) AS ratio,
    CASE WHEN room_area IS NULL THEN 'missing' WHEN abs(room_area - gross) / gross > 0.15 THEN 'extreme' ELSE 'close' END AS kind FROM ann""",
)
def area_gap(spark, sf_dir):
    return N.area_gap(N.annotations(spark, sf_dir)).select("image_id", *[F.round(c, 6).alias(c) for c in ("gap", "relative", "ratio")], "kind")


@query(
    "field_safety",
    _ANN + """, d AS (SELECT record_id, count(DISTINCT room_count) AS answers, count(*) AS images, count(DISTINCT image_id) AS units FROM ann GROUP BY 1)
SELECT record_id, CASE WHEN answers > 2 THEN 'isolated: runs disagree' WHEN images > units THEN 'repeated image' ELSE 'kept' END AS verdict FROM d""",
)
def field_safety(spark, sf_dir):
    return N.safety(N.annotations(spark, sf_dir))
