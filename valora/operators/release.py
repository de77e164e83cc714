"""Candidate requests and formal release: block resolution, guards, gates, states.

Gates are fail-closed: what is absent or can't be compared counts as not passed,
and a price is given in one state only.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import Column, DataFrame, functions as F

from valora.config import PARAMS, Params
from valora.operators.integrity import table_fingerprint

# The nine fingerprints of a bundle.
BUNDLE = ("m1", "b0", "a1", "intervals", "block_prices", "inference_code", "eligibility_rules", "contract_hash", "block_map")


def resolved_blocks(requests: DataFrame, history: DataFrame, block_map: DataFrame) -> DataFrame:
    """requests: community_id, block_name. history: community_id, block, one row per pair. block_map: community_id,
    current_block, category. Adds block, block_source, block_ambiguous, block_mismatch, block_candidates."""
    h = history.groupBy(F.col("community_id").alias("__h")).agg(F.array_sort(F.collect_set("block")).alias("__blocks"))  # blocks of one community are few
    m = block_map.where("category = 'drifted'").select(F.col("community_id").alias("__m"), F.col("current_block").alias("__current"))
    j = requests.join(h, F.col("community_id") == F.col("__h"), "left").join(m, F.col("community_id") == F.col("__m"), "left")
    known, given = F.col("__blocks").isNotNull(), F.col("block_name").isNotNull()
    member = given & F.array_contains("__blocks", F.col("block_name"))
    translated = given & ~member & F.coalesce(F.col("block_name") == F.col("__current"), F.lit(False))
    several = F.size("__blocks") > 1
    source = F.when(~known, "none").when(member, "request").when(translated, "translated").otherwise("derived")
    first = F.element_at("__blocks", 1)
    out = j.withColumns({
        "block": F.when(source == "request", F.col("block_name")).when(source != "none", first), "block_source": source, "block_ambiguous": known & several & ~member & ~translated,
        "block_mismatch": known & given & ~member & ~translated, "block_candidates": F.when(known & several & ~member & ~translated, F.array_join("__blocks", "|")),
    })
    return out.drop("__h", "__blocks", "__m", "__current")


def degraded(total_floors: Column) -> Column:
    """Which coefficients a request uses: the reduced set where total floors are missing."""
    return F.when(total_floors.isNull(), "without floors").otherwise("full")


def divergence_flag(a1: Column, m1: Column, b0: Column, params: Params = PARAMS) -> Column:
    """True where nothing assists, the baseline is there and the model is far from it; never changes a price."""
    return F.coalesce(a1.isNull() & (F.abs(m1 - b0) / b0 > params.divergence), F.lit(False))


def conflict_flag(a1: Column, m1: Column, params: Params = PARAMS) -> Column:
    return F.coalesce(F.abs(a1 - m1) / m1 > params.divergence, F.lit(False))


def failed_checks(params: Params = PARAMS) -> Column:
    """All reasons why a row is not eligible, sorted; none for an eligible row. Reads community_known, level,
    n_cases, block_source, block_mismatch, block_ambiguous, m1, b0, lo, hi, in_range, valuation_date, cutoff, last_case."""
    def fails(ok: Column, reason: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason))

    c = F.col
    return F.array_sort(F.array_compact(F.array(
        fails(c("community_known") & (c("level") == "community") & (c("n_cases") >= params.min_cases), "support"),
        fails(c("block_source").isin("request", "derived", "translated") & ~c("block_mismatch") & ~c("block_ambiguous"), "block"),
        fails(F.abs(c("m1") - c("b0")) / c("b0") <= params.divergence, "divergence"), fails(c("lo").isNotNull() & c("hi").isNotNull(), "interval"), fails(c("in_range"), "range"),
        fails((F.datediff("valuation_date", "cutoff") <= params.fresh_cutoff_days) & (F.datediff("valuation_date", "last_case") <= params.fresh_case_days), "freshness"),
    )))


def bundle_mismatches(found: Column, wanted: Column) -> Column:
    """Names of the bundle's items that are absent or differ."""
    names = F.array(*[F.lit(n) for n in BUNDLE])
    return F.filter(names, lambda n: ~F.coalesce(found[n] == wanted[n], F.lit(False)))


def formal_state(stopped: Column, record_ok: Column, in_range: Column, branch_ok: Column, reasons: Column) -> Column:
    """In this order: version_disabled, input_rejected, ineligible, priced."""
    return (
        F.when(F.coalesce(stopped, F.lit(True)), "version_disabled").when(~F.coalesce(record_ok, F.lit(False)), "version_disabled").when(~F.coalesce(in_range, F.lit(False)), "input_rejected")
        .when(~F.coalesce(branch_ok, F.lit(False)), "ineligible").when(F.size(reasons) > 0, "ineligible").otherwise("priced")
    )


def only_priced(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col("state") == "priced", F.col(c)) for c in columns})


def double_gate(rows: DataFrame, decisions: DataFrame, included: DataFrame) -> DataFrame:
    """Formal output needs both a confirmed release decision and the community on the inclusion list."""
    d = decisions.where("confirmed").select(F.col("branch").alias("__d")).distinct()
    i = included.select(F.col("community_id").alias("__i")).distinct()
    j = rows.join(d, F.col("branch") == F.col("__d"), "left").join(i, F.col("community_id") == F.col("__i"), "left")
    return j.withColumn("formal", F.col("__d").isNotNull() & F.col("__i").isNotNull()).drop("__d", "__i")


def suspended(branches: DataFrame, risks: DataFrame) -> DataFrame:
    """Branches without those that failed a hard risk; the suspension itself is an appended row."""
    hard = risks.where("hard and not passed").select(F.col("branch").alias("__b")).distinct()
    return branches.join(hard, F.col("branch") == F.col("__b"), "left_anti")


def reviewed(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Append-only review records: the result as it was beside each edit; results are never rewritten."""
    e = edits.select(F.col("result_id").alias("__e"), "after", "reason", "reviewed_at", "rule_version")
    return results.join(e, F.col("result_id") == F.col("__e")).select("result_id", F.col("value").alias("before"), "after", "reason", "reviewed_at", "rule_version")


def cold_start(level: Column, baseline: Column) -> Column:
    """What a request without evidence in its own community gets: a flagged reference, or a rejection."""
    return F.when(level == "community", "own evidence").when(baseline.isNotNull(), F.concat(F.lit("reference from "), level)).otherwise("rejected")


def fingerprints(tables: dict[str, DataFrame], modules: dict[str, list]) -> dict[str, str]:
    """Digests of a bundle's items: of tables by their rows, of code and contracts by the sources of their modules. Worked
    out once for a run, before its rows."""
    out = {name: table_fingerprint(t, t.columns).first()["fingerprint"] for name, t in tables.items()}
    for name, used in modules.items():
        source = "".join(inspect.getsource(m) for m in used)
        out[name] = hashlib.sha256(source.encode()).hexdigest()
    return out


def result(df: DataFrame, bundle: dict[str, str]) -> DataFrame:
    """The complete result of each row as one struct: price, interval, status, support, limits, and the fingerprints of
    all items of the bundle; an item that the bundle lacks raises."""
    missing = [n for n in BUNDLE if not bundle.get(n)]
    if missing:
        raise ValueError(f"no fingerprint of {', '.join(missing)}")
    prints = F.create_map(*[F.lit(x) for n in BUNDLE for x in (n, bundle[n])])
    parts = [F.col("m1").alias("price"), F.struct("lo", "hi").alias("interval"), F.col("state").alias("status"), F.struct("n_cases", "level").alias("support"), F.col("reasons").alias("limits")]
    return df.select("sale_id", F.struct(*parts, prints.alias("fingerprints")).alias("result"))
