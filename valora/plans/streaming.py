"""Queries that run as streams to the end of their input; their results are those of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.plans.registry import query
from valora.sources.tables import table
from valora.streaming import shadow as S


@query("stream_append", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_append(spark, sf_dir):
    store = S.appended(S.arrivals(spark, f"{sf_dir}/events.parquet"), S.place(spark, "append"))
    return store.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("stream_monthly", "WITH m AS (SELECT o_orderstatus AS branch, date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2) SELECT branch, strftime(month, '%Y-%m') AS month, n, month + INTERVAL 1 MONTH <= CAST((SELECT max(o_orderdate) FROM orders) AS DATE) AS mature FROM m")
def stream_monthly(spark, sf_dir):
    m = S.monthly(S.arrivals(spark, f"{sf_dir}/orders.parquet"), S.place(spark, "monthly"), "o_orderdate", "o_orderstatus")
    return m.select("branch", F.date_format("month", "yyyy-MM").alias("month"), "n", "mature")


@query(
    "stream_label_pairing",
    """SELECT o_orderstatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders
    ON l_orderkey = o_orderkey AND (l_orderkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 3 = o_orderkey % 3 AND o_orderdate < l_shipdate GROUP BY 1""",
)
def stream_label_pairing(spark, sf_dir):
    """Labels come before half of the predictions; those wait until the rest of the predictions is there. Some labels bear
    another bundle than their prediction and are never paired."""
    bundle = (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 1).otherwise(0)) % 3
    labels = S.arrivals(spark, f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("prediction_id"), bundle.alias("bundle"), F.col("l_shipdate").alias("labelled_at"), "l_extendedprice")
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("prediction_id"), (F.col("o_orderkey") % 3).alias("bundle"), F.col("o_orderdate").alias("predicted_at"), "o_orderstatus")
    how = (["prediction_id", "bundle"], "predicted_at", "labelled_at")
    folder = S.place(spark, "pairs")
    S.pair_labels(labels, lambda: p.where("prediction_id % 2 = 0"), folder, *how)
    pairs = S.settle(spark, labels.schema, p, folder, *how)
    return pairs.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("stream_arrivals", "SELECT count(*) AS rows, count(*) AS new_keys, 0 AS revised, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS newest FROM events")
def stream_arrivals(spark, sf_dir):
    """Every arriving file checked against what came before it."""
    e = S.arrivals(spark, f"{sf_dir}/events.parquet").select("event_id", "value", F.to_date("ts").alias("day"))
    checks = S.arrival_checks(e, S.place(spark, "arrivals"), "event_id", "value", "day")
    return checks.agg(F.sum("rows").alias("rows"), F.sum("new_keys").alias("new_keys"), F.sum("revised").cast("int").alias("revised"), F.max("newest").cast("string").alias("newest"))


@query("stream_suspension", "SELECT event_type, event_type IN ('error') AS suspended, count(*) AS n FROM events GROUP BY 1, 2")
def stream_suspension(spark, sf_dir):
    off = spark.createDataFrame([("error",)], "event_type string")
    marked = S.with_suspensions(S.arrivals(spark, f"{sf_dir}/events.parquet").select("event_type"), off, "event_type")
    return S.appended(marked, S.place(spark, "suspension")).groupBy("event_type", "suspended").agg(F.count(F.lit(1)).alias("n"))


@query("stream_cost_gate", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS running, sum(value) <= 50000 AS go_on FROM events GROUP BY 1")
def stream_cost_gate(spark, sf_dir):
    gate = S.cost_gate(S.arrivals(spark, f"{sf_dir}/events.parquet").select("event_type", "value"), "event_type", "value", 50000.0)
    out = S.appended(gate, S.place(spark, "cost"))
    last = out.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("running").alias("running"), F.bool_and("go_on").alias("go_on"))
    return last.select("event_type", "n", F.round("running", 2).alias("running"), "go_on")
