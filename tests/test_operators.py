"""Semantics that the tables don't show: missing values, ties, gates, folds, files, chains."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from valora.functions import missing, parsing
from valora.operators import census, clean, comparables, evidence, integrity, joins, metrics, models, quantiles, release
from valora.sources import files

D = dt.date


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def sale(spark, rows):
    cols = "sale_id string, community_id long, block string, district string, sale_date date, unit_price double, area double, total_price double, orientation string, decoration string, total_floors int, floor_band string, year_built int, elevator boolean"
    return spark.createDataFrame([(*r, None, None, None) if len(r) == 11 else r for r in rows], cols)


def make(i, community, date, price, area=50.0, block="b", orientation="F", decoration="A", band="low", year=1990, elevator=True):
    return (f"s{i}", community, block, "d", date, float(price), area, float(price) * area, orientation, decoration, 10, band, year, elevator)


def days(n):
    return D(2000, 1, 1) + dt.timedelta(n)


class TestMissing:
    def test_classes(self, spark):
        df = spark.createDataFrame([("12",), ("0",), ("no data",), (" -- ",), (None,), ("x1",)], "raw string")
        value, status = missing.number(F.col("raw"))
        got = [(r["v"], r["s"]) for r in df.select(value.alias("v"), status.alias("s")).collect()]
        assert got == [(12.0, "PARSED"), (0.0, "PARSED"), (None, "MISSING"), (None, "MISSING"), (None, "MISSING"), (None, "PARSE_FAILURE")]

    def test_not_applicable_and_conflict(self, spark):
        df = spark.createDataFrame([("12", True, True), ("12", False, True), ("12", True, False), ("12", None, None), ("--", True, False), ("x", True, True)], "raw string, applies boolean, agrees boolean")
        value, status = missing.judged(F.col("raw"), F.col("raw").try_cast("double"), F.col("applies"), F.col("agrees"))
        assert [tuple(r) for r in df.select(value, status).collect()] == [(12.0, "PARSED"), (None, "NOT_APPLICABLE"), (None, "CONFLICT"), (12.0, "PARSED"), (None, "MISSING"), (None, "PARSE_FAILURE")]

    def test_floors_that_disagree_stop_a_run(self, spark):
        df = spark.createDataFrame([(6, "of 5 floors"), (None, "of 9 floors")], "floors int, description string")
        filled = clean.backfilled(df)
        assert clean.assert_agreed(filled).count() == 2
        with pytest.raises(ValueError, match="1 rows"):
            clean.assert_agreed(clean.backfilled(spark.createDataFrame([(6, "of 25 floors")], "floors int, description string")))

    def test_floor_and_remark(self, spark):
        df = spark.createDataFrame([("low floor / total 6 floors", "of 61 floors"), ("high up", "level 3/18"), (None, None)], "raw string, remark string")
        band, total, status = parsing.floor(F.col("raw"))
        got = df.select(band.alias("b"), total.alias("t"), status.alias("s"), parsing.floors_from_remark(F.col("remark")).alias("r")).collect()
        assert [tuple(r) for r in got] == [("low", 6, "PARSED", None), (None, None, "PARSE_FAILURE", 18), (None, None, "MISSING", None)]

    def test_disclosed_elevator_wins(self, spark):
        df = spark.createDataFrame([("no", 30), (None, 30), (None, 7), (None, None)], "raw string, total int")
        value, basis = parsing.elevator(F.col("raw"), F.col("total"))
        assert [tuple(r) for r in df.select(value, basis).collect()] == [(False, "disclosed"), (True, "inferred"), (None, "unknown"), (None, "unknown")]

    def test_month_is_no_day(self, spark):
        df = spark.createDataFrame([("2020-02",), ("2020-02-30",), ("2020-02-03",), (None,)], "raw string")
        date, precision = parsing.dated(F.col("raw"))
        assert [tuple(r) for r in df.select(date, precision).collect()] == [(D(2020, 2, 1), "month"), (None, "unknown"), (D(2020, 2, 3), "day"), (None, "unknown")]

    def test_attached_fields_and_buildings(self, spark):
        df = spark.createDataFrame([("area: Park; ownership: Sole; tax: over two years; tenure: public",), ("ownership: ours; tax: no data",), (None,)], "raw string")
        said = parsing.attached(F.col("raw"))
        got = [tuple(r) for r in df.select(*[x for v, s in said.values() for x in (v, s)]).collect()]
        assert got == [
            ("Park", "PARSED", "sole", "PARSED", "over two years", "PARSED", "public", "PARSED"),
            (None, "MISSING", None, "PARSE_FAILURE", None, "MISSING", None, "MISSING"),
            (None, "MISSING") * 4,
        ]
        kind, status = parsing.building_type(F.col("raw"))
        assert [tuple(r) for r in spark.createDataFrame([(" Slab ",), ("ship",), ("--",)], "raw string").select(kind, status).collect()] == [("slab", "PARSED"), (None, "PARSE_FAILURE"), (None, "MISSING")]
        e = spark.createDataFrame([(8.0, 10.0), (10.0, 8.0), (8.0, None)], "n double, g double").select(parsing.efficiency(F.col("n"), F.col("g")))
        assert [r[0] for r in e.collect()] == [0.8, None, None]

    def test_sensitive_shapes(self, spark):
        text = "id 44010119900101123X, card 1234567812345678, LJ20260101, USER-ab12, sk-abcdefgh12, not LJ12 or sk-abc or 12345678901234567"
        df = spark.createDataFrame([(1, text), (2, "plain USERNAME and task-force")], "k int, t string")
        assert {r["kind"]: r["hits"] for r in clean.sensitive(df, "k", "t").collect()} == {"national id": 1, "card": 1, "listing": 1, "user": 1, "token": 1}

    def test_own_and_other_district(self, spark):
        df = spark.createDataFrame([("Sun Court (East)", "east"), ("Sun Court（west）", "east"), ("Sun·Court", "east")], "name string, district string")
        name, other = parsing.normal_name(F.col("name"), F.col("district"))
        assert [tuple(r) for r in df.select(name, other).collect()] == [("suncourt", False), ("suncourt(west)", True), ("suncourt", False)]

    def test_leak_guard(self, spark):
        with pytest.raises(ValueError, match="unit_price"):
            clean.assert_no_leak(spark.createDataFrame([(1, 2)], "area int, unit_price int"))

    @settings(max_examples=30, deadline=None)
    @given(st.text(alphabet="abc09@.-+() ", max_size=40))
    def test_masked_text_has_no_hit(self, text):
        import re

        for kind, pattern in parsing.SENSITIVE.items():
            text = re.sub(pattern, f"<{kind}>", text)
        assert not any(re.search(p, text) for p in parsing.SENSITIVE.values())


class TestEvidence:
    def test_same_day_and_own_sale_are_no_evidence(self, spark):
        s = sale(spark, [make(1, 1, D(2000, 1, 1), 100), make(2, 1, D(2000, 1, 1), 300), make(3, 1, D(2000, 1, 2), 500), make(4, 1, D(2001, 1, 1), 700)])
        got = {r["sale_id"]: (r["rolling_median"], r["rolling_n"]) for r in evidence.rolling_median(s, "community_id").collect()}
        assert got == {"s1": (None, 0), "s2": (None, 0), "s3": (200.0, 2), "s4": (500.0, 1)}  # 366 days after the first two

    def test_rolling_fallback_takes_the_narrowest_level(self, spark):
        cols = "sale_id string, community_id long, block string, district string, sale_date date, unit_price double"
        s = spark.createDataFrame([("a", 1, "x", "d", days(0), 10.0), ("b", 1, "x", "d", days(9), 20.0), ("c", 2, "x", "d", days(9), 99.0), ("d", 2, "x", "d", days(900), 5.0), ("e", 3, "y", "d", days(9), 7.0)], cols)
        got = {r["sale_id"]: (r["baseline"], r["level"]) for r in evidence.rolling_fallback(s, s).collect()}
        assert got == {"a": (None, "none"), "b": (10.0, "community"), "c": (10.0, "block"), "d": (None, "none"), "e": (10.0, "district")}

    def random_sales(self, spark, n=300):
        rng = np.random.default_rng(7)
        rows = [make(i, int(rng.integers(0, 9)), days(int(rng.integers(0, 1100))), int(rng.integers(1, 500)), block="xyz"[int(rng.integers(0, 3))]) for i in range(n)]
        return rows, sale(spark, rows)

    def test_rolling_medians_over_year_ends(self, spark):
        rows, s = self.random_sales(spark)
        got = {r["sale_id"]: (r["rolling_median"], r["rolling_n"]) for r in evidence.rolling_median(s, "community_id").collect()}
        for r in rows:
            known = [x[5] for x in rows if x[1] == r[1] and 0 < (r[4] - x[4]).days <= 365]
            assert got[r[0]] == (float(np.median(known)) if known else None, len(known))

    def test_baseline_by_month_is_that_of_each_cutoff(self, spark):
        _, s = self.random_sales(spark, 150)
        got = {r["sale_id"]: (r["baseline"], r["level"]) for r in evidence.baseline_at(s, s, F.trunc("sale_date", "MM"), evidence.monthly_reach()).collect()}
        half = {r["sale_id"]: (r["baseline"], r["level"]) for r in evidence.baseline_at(s, s, evidence.half_start(F.col("sale_date")), evidence.half_reach()).collect()}
        for cutoff, found in ((D(2001, 3, 1), got), (D(2002, 7, 1), got), (D(2000, 1, 1), got), (D(2001, 7, 1), half), (D(2002, 1, 1), half)):
            last = (cutoff + dt.timedelta(days=200)).replace(day=1) if found is half else (cutoff + dt.timedelta(days=31)).replace(day=1)
            last = D(cutoff.year + (cutoff.month > 6), 1 if cutoff.month > 6 else 7, 1) if found is half else last
            t = s.where((F.col("sale_date") >= F.lit(cutoff)) & (F.col("sale_date") < F.lit(last)))
            for r in evidence.with_fallback(t, s, F.lit(cutoff)).collect():
                assert found[r["sale_id"]] == (r["baseline"], r["level"])

    def test_rows_are_not_shuffled_to_meet_few_quantile_edges(self, spark):
        from valora.operators.quantiles import exact_quantiles

        df = spark.range(300_000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
        try:
            q = exact_quantiles(df, ["k"], "v", {"m": 0.5})
            plan = q._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["k"]: (r["n"], r["m"]) for r in q.collect()} == {k: (100_000, 149_998.5 + k) for k in range(3)}

    @pytest.mark.parametrize("same", [True, False])
    def test_window_medians_are_those_of_every_window(self, spark, monkeypatch, same):
        from valora.operators import windows

        monkeypatch.setattr(windows, "BIN_ROWS", 16)  # several bins, with a price that fills some
        monkeypatch.setattr(windows, "AT_ONCE", 8)
        rng = np.random.default_rng(3)
        cols = "sale_id int, community_id long, sale_date date, unit_price double"
        some = [(i, int(rng.integers(0, 6)), days(int(rng.integers(0, 700))), float(rng.choice([7.0, 7.0, rng.normal(0, 90)]))) for i in range(240)]
        s = [*some, (240, 1, days(3), None), (241, None, days(3), 5.0), (242, 2, None, 5.0)]
        t = s if same else [(i, k, d, None) for i, k, d, _ in s[::3]] + [(900, 77, days(9), None)]
        sales = spark.createDataFrame(s, cols).repartition(5)
        targets = sales if same else spark.createDataFrame(t, cols)
        end = F.date_sub("sale_date", 10)

        def want(key, day):
            known = [p for _, k, d, p in s if None not in (k, d, p, key, day) and k == key and 10 < (day - d).days <= 375]
            return (pytest.approx(float(np.median(known))) if known else None), len(known)

        got = {r["sale_id"]: (r["m"], r["m_n"]) for r in windows.with_medians(targets, sales, "community_id", end, "m", 365).collect()}
        assert len(got) == len(t) and all(got[i] == want(k, d) for i, k, d, _ in t)
        asked = targets.select(F.col("community_id").alias("__k"), end.alias("__c")).distinct()
        pooled = {(r["__k"], r["__c"]): r["m"] for r in windows.pooled_medians(sales, asked, "community_id", 365, "m").collect()}
        every = {(k, d - dt.timedelta(days=10)): want(k, d)[0] for _, k, d, _ in t if k is not None and d is not None}
        assert pooled == {k: v for k, v in every.items() if v is not None}

    def test_earlier_sales(self, spark):
        s = sale(spark, [make(1, 1, days(0), 10), make(2, 1, days(0), 20), make(3, 1, days(3), 60), make(4, 2, days(9), 1)])
        got = {r["sale_id"]: (r["n"], r["nearest"], r["mean_price"]) for r in evidence.earlier_sales(s, "community_id").collect()}
        assert got == {"s3": (2, days(0), 15.0)}

    def test_fold_cases_lie_before_the_cutoff(self, spark):
        f = spark.createDataFrame([("f", D(2000, 7, 1), D(2001, 1, 1))], "fold string, lo date, hi date")
        s = sale(spark, [make(1, 1, D(2000, 6, 30), 1), make(2, 1, D(1999, 7, 2), 1), make(3, 1, D(1999, 7, 1), 1), make(4, 1, D(2000, 8, 1), 1), make(5, 2, D(2000, 9, 1), 1), make(6, 3, D(2000, 9, 1), 1, block="other"), make(7, 4, D(2001, 1, 1), 1)])
        got = sorted((r["target_id"], r["sale_id"] or "", r["level"]) for r in evidence.fold_cases(s, f, 2).collect())
        assert got == [("s4", "s1", "community"), ("s4", "s2", "community"), ("s5", "s1", "block"), ("s5", "s2", "block"), ("s6", "", "uncovered")]

    def test_market_inputs_have_four_kinds(self, spark):
        s = sale(spark, [make(1, 1, D(1999, 2, 1), 10), make(2, 1, D(1999, 9, 1), 20), make(3, 1, D(1999, 11, 1), 40), make(4, 1, D(2000, 1, 1), 80), make(5, 2, D(1999, 10, 5), 7, block="c"), make(6, 9, D(2000, 2, 1), 7, block="z")])
        got = sorted(tuple(r) for r in evidence.market_inputs(s, F.lit(D(2000, 1, 1))).collect())
        assert got == sorted([
            ("s2", "outer", "train", 10.0, "community"), ("s5", "outer", "train", 15.0, "district"), ("s3", "outer", "train", 15.0, "community"), ("s2", "inner", "fit", 10.0, "community"),
            ("s4", "outer", "validate", 20.0, "community"), ("s6", "outer", "validate", 15.0, "district"), ("s3", "inner", "select", 15.0, "community"), ("s5", "inner", "select", 15.0, "district"),
        ])

    def test_fallback_levels(self, spark):
        s = sale(spark, [make(1, 1, D(2000, 1, 1), 100, block="x"), make(2, 2, D(2000, 1, 5), 300, block="x"), make(3, 3, D(2000, 1, 5), 900, block="y")])
        t = sale(spark, [make(7, 1, D(2000, 2, 1), 1, block="x"), make(8, 9, D(2000, 2, 1), 1, block="x"), make(9, 9, D(2000, 2, 1), 1, block="z"), ("s10", 9, "z", "other", D(2000, 2, 1), 1.0, 1.0, 1.0, "F", "A", 1)])
        got = {r["sale_id"]: (r["level"], r["baseline"]) for r in evidence.with_fallback(t, s, F.lit("2000-02-01").cast("date")).collect()}
        assert got == {"s7": ("community", 100.0), "s8": ("block", 200.0), "s9": ("district", 300.0), "s10": ("none", None)}

    def test_no_leak_from_later_prices(self, spark):
        cutoff = F.lit("2000-02-01").cast("date")
        s = sale(spark, [make(i, i % 3, D(2000, 1, 1) + dt.timedelta(days=7 * i), 100 + i) for i in range(12)])
        t = s.where(F.col("sale_date") >= cutoff).drop("unit_price")
        assert integrity.leaks(lambda a, b: evidence.with_fallback(a, b, cutoff).select("sale_id", "baseline"), s, cutoff, t).count() == 0

    def test_batch_does_not_change_single(self, spark):
        cutoff = F.lit("2000-02-01").cast("date")
        s = sale(spark, [make(i, i % 3, D(2000, 1, 1), 100 + 7 * i) for i in range(12)])
        t = sale(spark, [make(50 + i, i, D(2000, 3, 1), 1) for i in range(3)])
        every = {r["sale_id"]: r["baseline"] for r in evidence.with_fallback(t, s, cutoff).collect()}
        single = one(evidence.with_fallback(t.where("sale_id = 's51'"), s, cutoff))
        assert single["baseline"] == every["s51"]


class TestQuantiles:
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(5.0))), min_size=1, max_size=30))
    def test_as_percentile(self, spark, rows):
        df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
        got = {r["k"]: (r["n"], r["lo"], r["mid"]) for r in quantiles.exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5}).collect()}
        want = {r["k"]: (r["n"], r["lo"], r["mid"]) for r in df.where("v is not null").groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", 0.1).alias("lo"), F.percentile("v", 0.5).alias("mid")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


    def test_large_groups_outliers_and_ties(self, spark, monkeypatch):
        monkeypatch.setattr(quantiles, "WHOLE", 50)
        rng = np.random.default_rng(4)
        values = np.concatenate([rng.normal(size=6000), [1e15, -1e15], np.full(3000, 0.25)])
        df = spark.createDataFrame([("a" if k % 3 else "b", float(v)) for k, v in enumerate(values)] + [("c", 1.0), ("c", None)], "k string, v double").repartition(5)
        want = {"lo": 0.01, "q": 0.1, "mid": 0.5, "hi": 0.999}
        got = {r["k"]: tuple(r)[2:] for r in quantiles.exact_quantiles(df, ["k"], "v", want).collect()}
        for k in "abc":
            x = [r["v"] for r in df.where((F.col("k") == k) & F.col("v").isNotNull()).collect()]
            assert got[k] == pytest.approx(tuple(np.quantile(x, list(want.values()))))
        whole = one(quantiles.exact_quantiles(df, [], "v", {"mid": 0.5}))
        assert whole["n"] == 9003 and whole["mid"] == pytest.approx(float(np.median(np.append(values, 1.0))))
        counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
        assert {r["k"]: r["rows"] for r in quantiles.with_quantiles(counts, df.where("k <> 'c'"), ["k"], {"mid": ("v", 0.5)}).collect() if r["mid"] is None} == {"c": 2}


class TestComparables:
    def rows(self, spark):
        return sale(spark, [make(i, 1, D(2000, 1, 1) + dt.timedelta(days=i), 100 + i, orientation="F" if i < 4 else "O") for i in range(9)] + [make(100, 2, D(2000, 1, 3), 10)])

    def test_ladder_relaxes_one_step_at_a_time(self, spark):
        t = sale(spark, [make(900, 1, D(2000, 2, 1), 1), make(901, 2, D(2000, 2, 1), 1), make(902, 3, D(2000, 2, 1), 1, block="none")])
        got = {r["sale_id"]: (r["rung"], r["enough"], len(r["trail"] or [])) for r in comparables.with_rungs(t, self.rows(spark)).collect()}
        assert got == {"s900": (2, True, 3), "s901": (3, True, 4), "s902": (None, False, 0)}

    def test_cases_are_the_last_ones(self, spark):
        t = sale(spark, [make(900, 1, D(2000, 2, 1), 1)])
        s = self.rows(spark)
        got = sorted(r["sale_id"] for r in comparables.cases(comparables.with_rungs(t, s), s, cap=3).collect())
        assert got == ["s6", "s7", "s8"]

    PAIR = {"area": 50.0, "floor_band": "low", "year_built": 1990, "elevator": True, "orientation": "F"}

    def scores(self, spark, *changes, days_between=73):
        cols = "area double, floor_band string, year_built int, elevator boolean, orientation string"
        both = ", ".join([cols, *(f"target_{c}" for c in cols.split(", ")), "sale_date date", "target_date date"])
        rows = [(*(self.PAIR | c).values(), *self.PAIR.values(), days(0), days(days_between)) for c in changes]
        score, known = comparables.similarity()
        return [(r["s"], r["k"]) for r in spark.createDataFrame(rows, both).select(score.alias("s"), known.alias("k")).collect()]

    def test_each_component_has_its_weight(self, spark):
        recent = 0.25 * 0.8
        changes = [{}, {"area": 100.0}, {"floor_band": "high"}, {"year_built": 1980}, {"year_built": 1900}, {"elevator": False}, {"orientation": "O"}]
        want = [0.75, 0.75 - 0.3 * np.log(2), 0.60, 0.75 - 0.15 * 0.5, 0.60, 0.65, 0.70]
        assert [s for s, _ in self.scores(spark, *changes)] == pytest.approx([w + recent for w in want])
        assert {k for _, k in self.scores(spark, *changes)} == {6}

    def test_unknown_components_leave_the_denominator(self, spark):
        weights = {"area": 0.30, "floor_band": 0.15, "year_built": 0.15, "elevator": 0.10, "orientation": 0.05}
        got = self.scores(spark, *[{c: None} for c in weights], dict.fromkeys(weights), days_between=73)
        assert got == [(pytest.approx((1 - w - 0.05) / (1 - w)), 5) for w in weights.values()] + [(pytest.approx(0.8), 1)]

    def moved(self, spark, later_price=100.0):
        """Cases in January and February 2000, five each, and targets in March and February of it."""
        rows = [make(i, 1, D(2000, 1, 5 + i), 100 + i) for i in range(5)] + [make(10 + i, 1, D(2000, 2, 5 + i), 200 + i) for i in range(5)]
        rows += [make(20 + i, 1, D(2000, 2, 20 + i), later_price) for i in range(5)] + [make(30 + i, 1, D(2000, 3, 20 + i), later_price) for i in range(5)]
        t = sale(spark, [make(900, 1, D(2000, 3, 10), 1), make(901, 1, D(2000, 2, 12), 1)])
        return t, sale(spark, rows)

    def test_only_ended_months_move_a_price(self, spark):
        t, s = self.moved(spark, 150.0)
        got = {(r["target_id"], r["sale_id"]): r["adjusted"] for r in comparables.scored_pairs(t, s)[1].collect()}
        assert got["s900", "s0"] == pytest.approx(100 * 175 / 102)  # February's level over January's, all of both months
        assert got["s900", "s10"] == pytest.approx(200.0)
        assert got["s901", "s0"] == pytest.approx(100.0)  # January's over January's: the last month that ended
        assert got["s901", "s10"] == pytest.approx(200.0)  # its own month has not ended

    def test_too_few_sales_give_no_level(self, spark):
        t, s = self.moved(spark)
        few = s.where("sale_id not in ('s0', 's1')")
        got = {(r["target_id"], r["sale_id"]): r["adjusted"] for r in comparables.scored_pairs(t, few)[1].collect()}
        assert got["s900", "s2"] == pytest.approx(102.0)

    def test_valuations_do_not_see_later_prices(self, spark):
        t, s = self.moved(spark)
        at = F.lit(D(2000, 2, 13))
        before = t.where(F.col("sale_date") < at)
        assert integrity.leaks(lambda a, b: comparables.valued(a, b).select("sale_id", "low", "centre", "high", "confidence"), s, at, before).count() == 0
        peek = lambda a, b: a.join(comparables.month_levels(b), F.col("level_block") == F.col("block")).select("sale_id", "level_month", "level")
        assert integrity.leaks(peek, s, at, before).count() > 0  # the check itself sees what a month's whole median would

    def test_attributes_move_no_money(self, spark):
        t, s = self.moved(spark)
        other = s.withColumns({"floor_band": F.lit("high"), "year_built": F.lit(1950), "elevator": F.lit(False), "decoration": F.lit("N"), "area": F.col("area") * 1.3})
        a, b = ({(r["target_id"], r["sale_id"]): r["adjusted"] for r in comparables.scored_pairs(t, x)[1].collect()} for x in (s, other))
        assert a == b and len(a) > 10

    def replayed(self, spark, rows):
        return spark.createDataFrame(rows, "sale_id string, sale_date date, unit_price double, centre double, low double, high double, confidence string, unknown int")

    def test_widths_come_from_earlier_half_years_and_never_shrink(self, spark):
        rng = np.random.default_rng(3)
        rows, spread = [], {("high", 0): 0.3, ("high", 2): 0.2, ("medium", 0): 0.1, ("medium", 2): 0.4, ("low", 0): 0.2, ("low", 2): 0.1}
        for half, scale in ((D(2000, 3, 1), 1.0), (D(2000, 9, 1), 1.0), (D(2001, 3, 1), 50.0)):
            for (c, u), w in spread.items():
                rows += [(f"{half}{c}{u}{k}", half, float(np.exp(scale * w * rng.uniform(-1, 1))), 1.0, 0.9, 1.1, c, u) for k in range(60)]
        r = self.replayed(spark, rows)
        f = comparables.width_factors(r)
        got = {(x["half"], x["confidence"], x["band"]): x["width"] for x in f.collect()}
        order = [("high", "complete"), ("high", "partial"), ("medium", "partial"), ("low", "partial")]
        for half in (4001, 4002, 4003, 4004):
            w = [got[half, c, b] for c, b in order]
            assert w == sorted(w) and got[half, "high", "complete"] <= got[half, "medium", "complete"] <= got[half, "low", "complete"] <= got[half, "low", "partial"]
        early = [abs(np.log(x[2])) for x in rows if x[6] == "high" and x[7] == 0 and x[1] < D(2001, 1, 1)]
        assert got[4002, "high", "complete"] == pytest.approx(np.quantile(early, 0.85))  # the two half-years before 2001, not its own
        done = comparables.with_widths(r, f).where("sale_date = date'2001-03-01' and confidence = 'high' and unknown = 0").first()
        assert done["centre"] == 1.0 and done["high"] == pytest.approx(np.exp(got[4002, "high", "complete"])) and done["range_source"] == "calibrated"
        first = comparables.with_widths(r, f).where("sale_date = date'2000-03-01'").first()
        assert (first["low"], first["high"], first["range_source"]) == (0.9, 1.1, "weighted")

    def test_sparse_layers_take_the_wider_one(self, spark):
        rows = [(f"a{k}", D(2000, 3, 1), 1.1, 1.0, None, None, "medium", 0) for k in range(40)] + [(f"b{k}", D(2000, 3, 1), 1.5, 1.0, None, None, "medium", 2) for k in range(10)] + [("c", D(2000, 3, 1), 3.0, 1.0, None, None, "low", 0)]
        got = {(x["confidence"], x["band"]): x["width"] for x in comparables.width_factors(self.replayed(spark, rows)).where("half = 4001").collect()}
        both = float(np.quantile([np.log(1.1)] * 40 + [np.log(1.5)] * 10, 0.85))
        every = float(np.quantile([np.log(1.1)] * 40 + [np.log(1.5)] * 10 + [np.log(3.0)], 0.85))
        assert got["medium", "complete"] == pytest.approx(max(every, np.log(1.1))) and got["medium", "partial"] == pytest.approx(max(both, every)) and got["low", "partial"] == pytest.approx(max(both, every))

    def test_weighted_median_takes_the_lower_at_half(self, spark):
        df = spark.createDataFrame([("t", "a", 1.0, 1.0), ("t", "b", 2.0, 1.0), ("u", "c", 5.0, 0.2), ("u", "d", 9.0, 0.8)], "target_id string, sale_id string, v double, w double")
        got = {r["target_id"]: (r["m"], r["n_cases"], round(r["ess"], 6)) for r in comparables.weighted(df, "target_id", "v", "w", {"m": 0.5}).collect()}
        assert got == {"t": (1.0, 2, 2.0), "u": (9.0, 2, 1.470588)}

    def test_too_few_cases_give_no_centre(self, spark):
        s = sale(spark, [make(i, 1, D(2000, 1, 1 + i), 100) for i in range(3)])
        got = one(comparables.valued(sale(spark, [make(900, 1, D(2000, 2, 1), 1)]), s))
        assert got["centre"] is None and got["confidence"] == "insufficient" and got["state"] == "insufficient-data" and "too few cases" in got["reasons"]

    def crowded(self, spark):
        """Targets and other sales: a hot day, ties, unknown attributes, no price, no date, no orientation, several blocks of a community."""
        rng = np.random.default_rng(8)
        rows = []
        for i in range(400):
            date = D(2000, 1, 1) + dt.timedelta(days=int(rng.choice([40, rng.integers(0, 500)])))
            a = make(i, int(rng.integers(0, 9)) ** 2 // 9, date, float(rng.integers(90, 110)), orientation=[None, "F", "O", "O"][i % 4])
            rows.append(a)
        s = sale(spark, rows)
        return s.withColumns({"block": F.concat(F.lit("b"), (F.abs(F.hash("sale_id")) % 2).cast("string")), "floor_band": F.when(F.hash("sale_id") % 3 != 0, "low"), "unit_price": F.when(F.hash("sale_id") % 11 != 0, F.col("unit_price")), "sale_date": F.when(F.hash("sale_id") % 29 != 0, F.col("sale_date"))})

    @pytest.mark.parametrize("same", [True, False])
    def test_lists_of_cases_give_what_their_pairs_give(self, spark, same):
        s = self.crowded(spark).localCheckpoint()
        t = s if same else s.where("sale_id like '%1'")
        known = s if same else s.where("sale_id not like '%7'")
        pairs = comparables.scored_pairs(t, known)[1].where("score > 0").localCheckpoint()
        dates = {r["sale_id"]: (r["sale_date"], r["community_id"], r["block"]) for r in s.collect()}
        by: dict = {}
        for r in pairs.collect():
            by.setdefault(r["target_id"], []).append(r["sale_id"])
        rungs = {r["sale_id"]: r["rung"] for r in comparables.with_rungs(t.where("orientation is not null and sale_date is not null"), known.where("sale_date is not null")).collect()}
        got = {r["sale_id"]: r for r in comparables.with_quantiles_of_cases(comparables.with_cases(t, known), comparables.RANGE).collect()}
        assert len(got) == t.count() and rungs and all(got[k]["rung"] == v for k, v in rungs.items())
        for k, found in by.items():
            assert len(found) == len(set(found)) <= 20
            date, community, block = dates[k]
            rule = [x for x, (d, c, b) in dates.items() if d and date and 0 < (date - d).days <= 365 and (b == block if got[k]["rung"] == 3 else c == community) and x in found]
            assert sorted(rule) == sorted(found)
        want = comparables.weighted(pairs.where("adjusted is not null"), "target_id", "adjusted", "score", comparables.RANGE).collect()
        whole = {r["target_id"] for r in pairs.groupBy("target_id").agg(F.max(F.col("adjusted").isNull()).alias("gap")).where("not gap").collect()}
        assert len(whole) > 5
        for r in want:
            if r["target_id"] in whole:
                assert [got[r["target_id"]][c] for c in ("n_cases", "ess", "low", "centre", "high")] == pytest.approx([r[c] for c in ("n_cases", "ess", "low", "centre", "high")])

    def test_pairs_are_not_shuffled(self, spark):
        s = self.rows(spark)
        for df in (comparables.scored_pairs(s, s)[1], comparables.valued(s, s)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(target_id" not in plan and "hashpartitioning(__asked" not in plan
            assert "Exchange" not in plan[: plan.index("MapInArrow")] if "MapInArrow" in plan else True

    def test_a_written_table_leaves_no_shuffle_files(self, spark):
        from valora.sources import scratch

        held = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")
        before, setting = held(), spark.conf.get(scratch.CLEANUP, None)
        assert scratch.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
        for _ in range(50):
            if held() <= before:
                break
            time.sleep(0.1)
        assert held() <= before and spark.conf.get(scratch.CLEANUP, None) == setting

    def test_widths_never_shrink(self, spark):
        t = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.3)], "rank int, width double")
        assert [r["width"] for r in metrics.widened(t, "rank").orderBy("rank").collect()] == [0.2, 0.5, 0.5]


class TestJoins:
    def test_ambiguous_and_blocked_names_stay(self, spark):
        rows = spark.createDataFrame([(1, 7, "x"), (2, None, "two"), (3, None, "ali"), (4, None, "hold"), (5, None, "old")], "row_id int, source_id int, name string")
        src = spark.createDataFrame([(7, 70)], "source_id int, community_id int")
        std = spark.createDataFrame([("two", 1), ("two", 2), ("old", 30)], "name string, community_id int")
        ali = spark.createDataFrame([("ali", 5, "agreed"), ("hold", 6, "pending")], "name string, community_id int, conflict_status string")
        mrg = spark.createDataFrame([(30, 31, "south")], "community_id int, merged_to int, sub_area string")
        got = {r["row_id"]: (r["method"], r["community_id"], r["sub_area"]) for r in joins.resolved(rows, src, std, ali, mrg).collect()}
        assert got == {1: ("source id", 70, None), 2: ("UNRESOLVED", None, None), 3: ("alias", 5, None), 4: ("BLOCKED", None, None), 5: ("standard name", 31, "south")}

    def test_repeated_keys_do_not_multiply_rows(self, spark):
        rows = spark.createDataFrame([(1, 7, "x"), (2, 8, "old"), (3, None, "sub"), (4, None, "both")], "row_id int, source_id int, name string")
        src = spark.createDataFrame([(7, 70), (7, 71), (8, 30), (8, 30)], "source_id int, community_id int")
        std = spark.createDataFrame([("other", 1)], "name string, community_id int")
        ali = spark.createDataFrame([("both", 5, "agreed")], "name string, community_id int, conflict_status string")
        mrg = spark.createDataFrame([(30, 31, "south"), (30, 31, "north")], "community_id int, merged_to int, sub_area string")
        subs = spark.createDataFrame([("sub", 9), ("both", 6)], "name string, community_id int")
        got = sorted((r["row_id"], r["method"], r["community_id"], r["sub_area"]) for r in joins.resolved(rows, src, std, ali, mrg, subs).collect())
        assert got == [(1, "UNRESOLVED", None, None), (2, "source id", 31, "north"), (3, "sub-area", 9, None), (4, "UNRESOLVED", None, None)]
        assert [(r["source_id"], r["values"]) for r in joins.several_values(src, "source_id", "community_id").collect()] == [(7, [70, 71])]

    def test_diff(self, spark):
        a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
        b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
        assert sorted((r["k"], r["change"]) for r in joins.diff(a, b, ["k"], ["v"]).collect()) == [(2, "changed"), (3, "removed"), (4, "added")]

    def test_block_resolution_flags(self, spark):
        rq = spark.createDataFrame([("a", 1, None), ("b", 1, "p"), ("c", 1, "zz"), ("d", 2, "new"), ("e", 9, "p"), ("f", 3, None)], "request_id string, community_id int, block_name string")
        history = spark.createDataFrame([(1, "p"), (1, "o"), (2, "old"), (3, "k")], "community_id int, block string")
        drift = spark.createDataFrame([(2, "new", "drifted"), (1, "zz", "consistent")], "community_id int, current_block string, category string")
        got = {r["request_id"]: (r["block"], r["block_source"], r["block_ambiguous"], r["block_mismatch"]) for r in release.resolved_blocks(rq, history, drift).collect()}
        assert got == {
            "a": ("o", "derived", True, False), "b": ("p", "request", False, False), "c": ("o", "derived", True, True), "d": ("old", "translated", False, False), "e": (None, "none", False, False), "f": ("k", "derived", False, False),
        }


class TestRelease:
    @pytest.mark.parametrize(
        "stopped, record, in_range, branch, reasons, want",
        [(False, True, True, True, [], "priced"), (None, True, True, True, [], "version_disabled"), (False, None, True, True, [], "version_disabled"), (True, True, True, True, [], "version_disabled"),
         (False, True, False, True, [], "input_rejected"), (False, True, None, True, [], "input_rejected"), (False, True, True, False, [], "ineligible"), (False, True, True, True, ["support"], "ineligible")],
    )
    def test_states_fail_closed(self, spark, stopped, record, in_range, branch, reasons, want):
        df = spark.createDataFrame([(stopped, record, in_range, branch, reasons, 5.0)], "s boolean, r boolean, i boolean, b boolean, w array<string>, price double")
        df = df.withColumn("state", release.formal_state(*[F.col(c) for c in "sribw"]))
        got = one(release.only_priced(df, ["price"]))
        assert got["state"] == want and (got["price"] is None) == (want != "priced")

    def test_freshness_is_inclusive(self, spark):
        row = (True, "community", 5, "request", False, False, 100.0, 100.0, 90.0, 110.0, True, D(2026, 10, 18), D(2026, 7, 20), D(2026, 4, 21))
        cols = "community_known boolean, level string, n_cases int, block_source string, block_mismatch boolean, block_ambiguous boolean, m1 double, b0 double, lo double, hi double, in_range boolean, valuation_date date, cutoff date, last_case date"
        df = spark.createDataFrame([row, (*row[:-3], D(2026, 10, 19), *row[-2:]), (*row[:2], 3, *row[3:6], 118.0, *row[7:])], cols)
        assert [r[0] for r in df.select(release.failed_checks()).collect()] == [[], ["freshness"], ["divergence", "support"]]

    def test_bundle_names_what_differs(self, spark):
        df = spark.createDataFrame([({n: "1" for n in release.BUNDLE}, {n: "1" for n in release.BUNDLE if n != "a1"} | {"b0": "2"})], "w map<string,string>, f map<string,string>")
        assert one(df.select(release.bundle_mismatches(F.col("f"), F.col("w"))))[0] == ["b0", "a1"]

    def test_tiers(self, spark):
        df = spark.createDataFrame([(15, "confirmed", True), (15, "pending", True), (14, "confirmed", True), (8, "confirmed", True), (7, "confirmed", True), (99, "confirmed", False)], "n int, b string, s boolean")
        got = [r[0] for r in df.select(census.tier(F.col("n"), F.col("b"), F.col("s"))).collect()]
        assert got == ["include", "reference", "reference", "reference", "reject", "reject"]


    #: The six boundary cases of a request: what is asked, and what must come of it.
    CASES = [
        ("normal", {}, "priced", ""),
        ("missing field", {"area": None}, "input_rejected", "missing field"),
        ("unknown community", {"community_id": 99}, "ineligible", "support"),
        ("out of range", {"area": 900.0}, "input_rejected", "area out of range"),
        ("conflict", {"m1": 130.0}, "ineligible", "divergence"),
        ("version mismatch", {"bundle_ok": False}, "version_disabled", ""),
    ]

    def test_six_boundary_cases(self, spark):
        base = {"community_id": 1, "area": 20.0, "year_built": 1990, "usage": "residential", "valuation_date": D(2026, 8, 1), "m1": 100.0, "bundle_ok": True}
        cols = "case string, community_id long, area double, year_built int, usage string, valuation_date date, m1 double, bundle_ok boolean"
        df = clean.validated(spark.createDataFrame([(name, *(base | change).values()) for name, change, _, _ in self.CASES], cols))
        known = F.col("community_id") == 1
        df = df.withColumns({
            "community_known": known, "level": F.when(known, "community").otherwise("block"), "n_cases": F.when(known, 6).otherwise(0), "block_source": F.lit("request"), "block_mismatch": F.lit(False),
            "block_ambiguous": F.lit(False), "b0": F.lit(100.0), "lo": F.lit(90.0), "hi": F.lit(110.0), "in_range": F.col("reason").isNull(), "cutoff": F.lit(D(2026, 7, 20)), "last_case": F.lit(D(2026, 7, 1)),
        })
        df = df.withColumn("reasons", release.failed_checks())
        df = df.withColumn("state", release.formal_state(F.lit(False), F.col("bundle_ok"), F.col("in_range"), F.lit(True), F.col("reasons")))
        got = {r["case"]: (r["state"], r["reason"], r["reasons"], r["m1"]) for r in release.only_priced(df, ["m1"]).collect()}
        for name, _, state, why in self.CASES:
            assert got[name][0] == state and (got[name][3] is not None) == (state == "priced")
            assert not why or why == got[name][1] or why in got[name][2]

    def test_results_bear_real_fingerprints(self, spark):
        a, b = spark.createDataFrame([(1, 2.0)], "k int, v double"), spark.createDataFrame([(1, 2.5)], "k int, v double")
        x, y = (release.fingerprints({"b0": t}, {"inference_code": [release]}) for t in (a, b))
        assert x["b0"] != y["b0"] and x["inference_code"] == y["inference_code"] and len(x["inference_code"]) == 64
        df = spark.createDataFrame([("s", 1.0, 0.9, 1.1, "priced", 5, "community", ["x"])], "sale_id string, m1 double, lo double, hi double, state string, n_cases int, level string, reasons array<string>")
        with pytest.raises(ValueError, match="m1"):
            release.result(df, x)
        full = dict.fromkeys(release.BUNDLE, "d") | x
        assert one(release.result(df, full))["result"]["fingerprints"] == full


class TestMetrics:
    def test_draws_are_independent_across_units(self, spark):
        u = spark.range(50).crossJoin(spark.range(40).withColumnRenamed("id", "r")).select("id", "r", metrics.draw(F.col("id"), F.col("r"), 7).alias("u")).toPandas().pivot(index="r", columns="id", values="u").to_numpy()
        assert len(np.unique(u)) == 2000 and abs(u.mean() - 0.5) < 0.02
        step = np.diff(u, axis=0) % 1.0
        assert np.ptp(step, axis=1).min() > 0.5  # no replicate shifts all units alike
        c = np.corrcoef(u.T) - np.eye(50)
        assert np.abs(c).max() < 0.75 and abs(c.sum() / 2450) < 0.02

    def test_counts_are_poisson(self, spark):
        u = spark.createDataFrame([(0.5,), (0.995,), (0.9999,), (1 - 2**-32,)], "u double")
        assert [r[0] for r in u.select(metrics.poisson_count(F.col("u"))).collect()] == [1, 4, 6, 12]
        n = spark.range(20_000).select(metrics.poisson_count(metrics.draw(F.col("id"), F.lit(3), 1)).alias("n")).toPandas()["n"]
        assert abs(n.mean() - 1) < 0.03 and abs(n.var() - 1) < 0.06

    def test_draws_are_the_md5_of_unit_replicate_and_seed(self, spark):
        import hashlib

        units = [(u, float(k), k % 3 + 1) for k, u in enumerate(["7", "12", "1234567", "é-x", "d" * 40, "x" * 70, None])]
        rows = [(u, d) for u, d, n in units for _ in range(n)]
        got = {r["replicate"]: r["mean"] for r in metrics.bootstrap(spark.createDataFrame(rows, "u string, d double"), "u", "d", 1003, 5).collect()}
        for r in range(1003):
            drawn = [int(hashlib.md5(f"{u}:{r}:5".encode()).hexdigest()[:8], 16) / 2**32 for u, *_ in units[:-1]]
            times = [sum(x >= c for c in metrics.POISSON) for x in drawn]
            n = sum(t * n for t, (_, _, n) in zip(times, units, strict=False))
            want = sum(t * n * d for t, (_, d, n) in zip(times, units, strict=False)) / n if n else None
            assert got[r] == (pytest.approx(want) if n else None), r

    def test_spread_is_the_standard_error(self, spark):
        rng = np.random.default_rng(1)
        x = rng.normal(3, 2, 400)
        df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "home long, d double")
        got = metrics.bootstrap(df, "home", "d", 600, 20260914).toPandas()["mean"]
        assert len(got) == 600 and got.std() == pytest.approx(x.std() / 20, rel=0.12) and got.mean() == pytest.approx(x.mean(), abs=0.02)

    def test_intervals_cover(self, spark):
        rng = np.random.default_rng(2)
        hit = 0
        rows = [(t, k, float(v)) for t in range(40) for k, v in enumerate(rng.normal(1, 1, 60))]
        d = spark.createDataFrame(rows, "trial int, home long, d double")
        drawn = d.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(199)))).withColumn("t", metrics.poisson_count(metrics.draw(F.concat_ws("-", "trial", "home"), F.col("replicate"), 5)))
        means = drawn.groupBy("trial", "replicate").agg((F.sum(F.col("t") * F.col("d")) / F.sum("t")).alias("mean")).toPandas()
        for _, m in means.groupby("trial"):
            hit += m["mean"].quantile(0.025) <= 1 <= m["mean"].quantile(0.975)
        assert hit >= 33

    def test_clusters_are_drawn_whole(self, spark):
        df = spark.createDataFrame([(k // 20, float(k // 20)) for k in range(200)], "unit long, d double")
        a, b = (metrics.bootstrap(df.withColumn("row", F.monotonically_increasing_id()), u, "d", 300, 7).toPandas()["mean"].std() for u in ("unit", "row"))
        assert a > 3 * b

    def test_sparse_parts_fall_back_to_their_state(self, spark):
        rows = [("complete", "p", "train_oof", 0.01 * k) for k in range(50)] + [("complete", "q", "train_oof", 5.0)] + [("missing", "p", "reserved", 1.0)] * 45
        t = metrics.calibrated(spark.createDataFrame(rows, "state string, part string, source string, residual double"), 40, (0.1, 0.9))
        got = {r["layer"]: (r["n"], r["residual_source"]) for r in t.collect()}
        assert got == {"complete|p": (50, "train_oof"), "complete|global": (51, "train_oof"), "missing|p": (45, "reserved"), "missing|global": (45, "reserved"), "global": (96, "reserved+train_oof")}
        p = spark.createDataFrame([("complete|q", 10.0), ("missing|z", 10.0), ("new|q", 10.0)], "layer string, prediction double")
        assert [r["used_layer"] for r in metrics.with_interval(p, t, "layer").orderBy("layer").collect()] == ["complete|global", "missing|global", "global"]

    def test_one_expansion_judges_the_edge_only(self, spark):
        cols = "metric string, value double, met boolean, verdict string"
        first = spark.createDataFrame([("a", 1.0, True, "pass"), ("b", 2.0, True, "insufficient/edge"), ("c", 3.0, True, "insufficient/edge")], cols)
        second = spark.createDataFrame([("a", 9.0, False, "return"), ("b", 2.1, True, "insufficient/edge"), ("c", 3.1, False, "return")], cols)
        assert sorted((r["metric"], r["expanded_value"], r["final"]) for r in metrics.expanded_verdict(first, second).collect()) == [("a", None, "pass"), ("b", 2.1, "pass"), ("c", 3.1, "return")]


class TestModels:
    def test_ridge_is_the_closed_form(self, spark):
        rng = np.random.default_rng(1)
        n, communities, lam = 200, 7, 2.0
        x, c = rng.normal(size=(n, 2)), rng.integers(0, communities, n)
        y = 3 + x @ [0.5, -1] + 0.1 * c + rng.normal(size=n) * 0.05
        df = spark.createDataFrame([(1.0, float(a), float(b), int(k), float(v)) for (a, b), k, v in zip(x, c, y, strict=True)], "x_one double, a double, b double, community_id int, y double")
        m = models.fit_ridge(df, ["x_one", "a", "b"], "community_id", lam)
        full = np.hstack([np.ones((n, 1)), x, np.eye(communities)[c]])
        shrink = np.diag([1e-9, lam, lam] + [lam] * communities)
        want = np.linalg.solve(full.T @ full + shrink, full.T @ y)
        effects = [r["effect"] for r in m.effects.orderBy("community_id").collect()]
        assert np.allclose(np.r_[m.beta, effects], want, atol=1e-9)

    def fold_data(self, spark):
        rng = np.random.default_rng(9)
        rows = []
        for k in range(500):
            c = int(rng.integers(0, 8))
            date = D(1999, 1, 1) + dt.timedelta(int(rng.integers(0, 730)))
            x = float(rng.normal())
            rows.append((f"s{k}", c, "ab"[c % 2], date, 1.0, x, float(np.exp(1 + 0.5 * x + 0.2 * c + 0.3 * rng.normal()))))
        rows += [(f"t{k}", 50, "a", D(2000, 7, 10 + k), 1.0, 0.5, 9.0) for k in range(3)] + [("u", 51, "zz", D(2000, 8, 1), 1.0, 0.5, 9.0)]
        df = spark.createDataFrame(rows, "sale_id string, community_id int, block string, sale_date date, x_one double, x double, unit_price double")
        return rows, df.withColumn("y", F.ln("unit_price"))

    def closed(self, rows, lam):
        """Ridge with community effects as one dense system."""
        ids = sorted({r[1] for r in rows})
        x = np.array([[r[4], r[5], *[float(r[1] == c) for c in ids]] for r in rows])
        y = np.log([r[6] for r in rows])
        w = np.linalg.solve(x.T @ x + np.diag([1e-9, lam] + [lam] * len(ids)), x.T @ y)
        effect = dict(zip(ids, w[2:], strict=True))
        for b in {r[2] for r in rows}:
            mine = [(r, v) for r, v in zip(rows, y, strict=True) if r[2] == b]
            effect[b] = sum(v - w[0] - w[1] * r[5] for r, v in mine) / (len(mine) + lam)
        return lambda r: w[0] + w[1] * r[5] + effect.get(r[1], effect.get(r[2], 0.0))

    def test_fold_models_are_the_closed_form(self, spark):
        rows, d = self.fold_data(spark)
        lo, q = D(2000, 7, 1), 2000 * 4 + 3
        ridges = models.fit_folds(d, ["x_one", "x"], {"f": q}, (1.0, 10.0))
        train, inner, select = [r for r in rows if r[3] < lo], [r for r in rows if r[3] < D(2000, 4, 1)], [r for r in rows if D(2000, 4, 1) <= r[3] < lo]
        errors = {lam: np.mean([abs(self.closed(inner, lam)(r) - np.log(r[6])) for r in select]) for lam in (1.0, 10.0)}
        assert {r["config"]: r["score"] for r in ridges.scores.collect()} == pytest.approx(errors)
        best = min(errors, key=lambda k: (errors[k], k))
        assert ridges.chosen == {"f": (q, best)}
        model = self.closed(train, best)
        got = {r["sale_id"]: r for r in models.fold_predictions(d, ridges).collect()}
        want = [r for r in rows if lo <= r[3] < D(2001, 1, 1)]
        assert sorted(got) == sorted(r[0] for r in want)
        for r in want:
            assert np.log(got[r[0]]["m1"]) == pytest.approx(model(r), abs=1e-8)
        assert {got[k]["level"] for k in ("t0", "t1", "t2")} == {"block"} and got["u"]["level"] == "global"

    def test_assisted_by_the_folds_own_weights(self, spark):
        rows, d = self.fold_data(spark)
        q = 2000 * 4 + 3
        ridges = models.fit_folds(d, ["x_one", "x"], {"f": q}, (1.0,))
        d = d.withColumns({"district": F.lit("d"), "key": F.when(F.col("sale_id") != "s1", 1)})
        folds = spark.createDataFrame([("f", D(2000, 7, 1), D(2001, 1, 1))], "fold string, lo date, hi date")
        cases = evidence.fold_cases(d, folds, 4)
        got = {r["target_id"]: r for r in models.fold_assisted(d, cases, ridges, ["x"], ["key"]).collect()}
        w = one(ridges.weights())["b_x"]
        by = {r[0]: r for r in rows}
        pairs = {}
        for r in cases.collect():
            pairs.setdefault(r["target_id"], []).append(r["sale_id"])
        assert got.keys() == pairs.keys()
        for t, ids in pairs.items():
            known = [by[i] for i in ids if i]
            if not known:
                assert got[t]["before"] is None and got[t]["after"] is None and got[t]["n_cases"] == 0 and got[t]["level"] == "uncovered"
                continue
            refused = [t == "s1" or c[0] == "s1" for c in known]
            after = [c[6] if no else c[6] * np.exp((by[t][5] - c[5]) * w) for c, no in zip(known, refused, strict=True)]
            assert got[t]["before"] == pytest.approx(np.median([c[6] for c in known])) and got[t]["after"] == pytest.approx(np.median(after)) and got[t]["n_refused"] == sum(refused)

    def test_rows_without_floors_use_their_own_coefficients(self, spark):
        s = sale(spark, [make(i, i % 4, days(i), 100 + 13 * (i % 7) + i, area=20.0 + i % 9, band=["low", "middle", "high", None][i % 4], elevator=[True, False, None][i % 3]) for i in range(730)])
        d, features = models.design(s)
        assert set(models.FLOORS) < set(models.ATTRIBUTES) < set(features)
        folds = {"f": 2001 * 4 + 3}
        full, reduced = (models.fit_folds(d, f, folds, (1.0,)) for f in (features, [f for f in features if f not in models.FLOORS]))
        gaps = d.withColumns({f: F.lit(0.0) for f in models.FLOORS})
        a, b = ({r["sale_id"]: r["m1"] for r in models.fold_predictions(x, reduced).collect()} for x in (d, gaps))
        assert a == b and len(a) > 100  # floors play no part
        c = {r["sale_id"]: r["m1"] for r in models.fold_predictions(gaps, full).collect()}
        assert sum(abs(a[k] - c[k]) > 1e-6 for k in a) > 0.5 * len(a)  # filling gaps would be something else

    def test_unknown_community_is_flagged(self, spark):
        df = spark.createDataFrame([(1.0, 1, 2.0), (1.0, 1, 2.2), (1.0, 2, 1.0)], "x_one double, community_id int, y double")
        m = models.fit_ridge(df, ["x_one"], "community_id", 1.0)
        got = m.predict(spark.createDataFrame([(1.0, 1), (1.0, 77)], "x_one double, community_id int")).orderBy("community_id").collect()
        assert [r["community_known"] for r in got] == [True, False] and got[1]["m1"] == pytest.approx(float(np.exp(m.beta[0])))

    def test_equal_attributes_give_no_delta(self, spark):
        pairs = spark.createDataFrame([("t", 50.0, 50.0, 100.0), ("t", 50.0, None, 300.0), ("u", None, 50.0, 80.0)], "target_id string, t_area double, area double, unit_price double")
        got = {r["target_id"]: (r["before"], r["after"], r["n_refused"]) for r in models.assisted(pairs, {"area": 0.3}, ["area"]).collect()}
        assert got == {"t": (200.0, 200.0, 1), "u": (80.0, 80.0, 1)}

    def test_forward_models_see_earlier_periods_only(self, spark):
        df = spark.createDataFrame([(1.0, 1, 2.0), (1.0, 1, 2.0), (1.0, 2, 5.0), (1.0, 2, 5.0)], "x_one double, half int, y double")
        ms = models.forward_ridges(df, ["x_one"], "half", 1.0, 2)
        got = {r["half"]: (r["warm_up"], r["benchmark"]) for r in models.forward_benchmark(df, ms, "half").collect()}
        assert got[1] == (True, None) and got[2][1] == pytest.approx(np.exp(2.0))


class TestIntegrity:
    def test_snapshot_is_written_once_and_checked(self, spark, tmp_path):
        df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
        path = f"file://{tmp_path}/run1"
        assert files.write_snapshot(df, path, source="test")["rows"] == 2
        with pytest.raises(FileExistsError):
            files.write_snapshot(df, path)
        assert files.checked(spark, path).count() == 2
        files.write_json(spark, f"{path}/manifest.json", {"fingerprint": "other"}, replace=True)
        with pytest.raises(ValueError):
            files.checked(spark, path)

    def test_pointer(self, spark, tmp_path):
        p = f"file://{tmp_path}/current.json"
        files.switch_pointer(spark, p, "run1")
        first = files.resolve_pointer(spark, p)
        files.switch_pointer(spark, p, "run2")
        assert first[0] == "run1" and files.resolve_pointer(spark, p)[0] == "run2" and files.resolve_pointer(spark, p)[1] != first[1]

    def test_scans_stay_with_their_run_and_contract(self, spark, tmp_path):
        base = f"file://{tmp_path}"
        for run, n in (("run1", 2), ("run2", 5)):
            spark.range(n).withColumn("name", F.lit(run)).write.parquet(f"{base}/{run}/mart")
        files.switch_pointer(spark, f"{base}/current.json", "run1")
        df, run = files.scan(spark, base, f"{base}/current.json", "mart", "id long, name string")
        files.switch_pointer(spark, f"{base}/current.json", "run2")
        assert run == "run1" and df.count() == 2 and {r["name"] for r in df.collect()} == {"run1"}
        assert files.scan(spark, base, f"{base}/current.json", "mart", "id long")[0].columns == ["id"]
        for bad in ("id int", "id long, price double"):
            with pytest.raises(ValueError, match="contract"):
                files.scan(spark, base, f"{base}/current.json", "mart", bad)

    def test_frozen_files(self, spark, tmp_path):
        (tmp_path / "in").mkdir()
        (tmp_path / "in/a").write_text("1")
        frozen = spark.createDataFrame(files.file_digests(spark, f"file://{tmp_path}/in").collect())
        assert files.changed_files(spark, f"file://{tmp_path}/in", frozen).count() == 0
        (tmp_path / "in/a").write_text("2")
        assert [r["change"] for r in files.changed_files(spark, f"file://{tmp_path}/in", frozen).collect()] == ["changed"]

    def test_export_keeps_bad_rows_beside(self, spark, tmp_path):
        (tmp_path / "x.csv").write_text("id,price\n1,2.5\n2,abc\n")
        got = files.load_export(spark, f"file://{tmp_path}/x.csv", "id int, price double").orderBy("id").collect()
        assert [(r["price"], r["__bad"]) for r in got] == [(2.5, None), (None, "2,abc")]

    def test_sources_register_once(self, spark):
        r = spark.createDataFrame([], "source_id string, url string, basis string, method string, repeatable boolean")
        r = files.register_source(r, "a", "http://x", "public", "download", True)
        with pytest.raises(ValueError):
            files.register_source(r, "a", "http://y", "public", "download", True)

    def test_fingerprint_ignores_order(self, spark):
        a = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
        b = spark.createDataFrame([(2, None), (1, "a")], "k int, v string")
        c = spark.createDataFrame([(2, ""), (1, "a")], "k int, v string")
        fp = lambda d: one(integrity.table_fingerprint(d, ["k", "v"]))["fingerprint"]
        assert fp(a) == fp(b) != fp(c)

    def test_chain_shows_a_changed_record(self, spark):
        df = spark.createDataFrame([(1, "a", "d"), (2, "b", "d"), (3, None, "d")], "n int, p string, day string")
        chain = spark.createDataFrame(integrity.chained(df, "n", "p", "day").collect(), "day string, n int, p string, previous_hash string, hash string")
        assert integrity.broken_links(chain, "n", "p", "day").count() == 0
        forged = chain.withColumn("p", F.when(F.col("n") == 2, "x").otherwise(F.col("p")))
        assert [r["n"] for r in integrity.broken_links(forged, "n", "p", "day").collect()] == [2]

    def test_empty_tables(self, spark):
        s = sale(spark, [])
        assert evidence.with_fallback(s, s, F.lit("2000-01-01").cast("date")).count() == 0
        assert comparables.valued(s, s).count() == 0
        assert models.fit_ridge(models.design(s)[0], ["x_one"], "community_id").fitted == 0

    def test_labels_wait_for_their_predictions(self, spark, tmp_path):
        from valora.streaming import shadow

        t = lambda h: dt.datetime(2026, 1, 1, h)
        lcols, pcols = "id long, bundle string, labelled_at timestamp, price double", "id long, bundle string, predicted_at timestamp, quote double"
        labels = lambda rows: spark.createDataFrame(rows, lcols)
        labels([(1, "a", t(5), 10.0), (2, "a", t(5), 20.0)]).coalesce(1).write.parquet(f"{tmp_path}/in")
        store = {"p": spark.createDataFrame([(2, "a", t(4), 2.0)], pcols)}
        how = (["id", "bundle"], "predicted_at", "labelled_at")
        run = lambda: shadow.pair_labels(shadow.arrivals(spark, f"{tmp_path}/in"), lambda: store["p"], f"{tmp_path}/out", *how)
        ids = lambda df: sorted((r["id"], r["quote"]) for r in df.collect())
        assert ids(run()) == [(2, 2.0)]  # the first label came before its prediction
        late = [(1, "a", t(4), 1.0), (1, "b", t(4), 9.0), (3, "a", t(9), 3.0), (2, "a", t(4), 2.0)]
        store["p"] = spark.createDataFrame(late, pcols)
        settle = lambda: shadow.settle(spark, labels([]).schema, store["p"], f"{tmp_path}/out", *how)
        assert ids(settle()) == ids(settle()) == [(1, 1.0), (2, 2.0)]
        labels([(3, "a", t(5), 30.0), (4, "a", t(5), 40.0), (1, "b", t(3), 5.0)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert ids(run()) == [(1, 1.0), (2, 2.0)]  # predicted after its label, not predicted, of another time
        store["p"] = spark.createDataFrame([*late, (4, "a", t(1), 4.0)], pcols)
        assert ids(settle()) == [(1, 1.0), (2, 2.0), (4, 4.0)]
        shadow._pair(labels([(9, "a", t(5), 1.0)]), spark.createDataFrame([(9, "a", t(1), 9.0)], pcols), f"{tmp_path}/out", "000000000007", *how)
        shadow._pair(labels([(9, "a", t(5), 1.0)]), spark.createDataFrame([(9, "a", t(1), 9.0)], pcols), f"{tmp_path}/out", "000000000007", *how)
        assert ids(settle()) == [(1, 1.0), (2, 2.0), (4, 4.0), (9, 9.0)]  # a step that runs twice leaves one result

    def test_each_batch_is_checked_against_those_before_it(self, spark, tmp_path):
        from valora.streaming import shadow

        frame = lambda rows: spark.createDataFrame(rows, "k long, v double, d date").coalesce(1)
        frame([(1, 1.0, days(0)), (2, 2.0, days(1)), (2, 2.0, days(1))]).write.parquet(f"{tmp_path}/in")
        run = lambda: shadow.arrival_checks(shadow.arrivals(spark, f"{tmp_path}/in"), f"{tmp_path}/out", "k", "v", "d")
        run()
        frame([(1, 5.0, days(4)), (3, 3.0, days(3))]).write.mode("append").parquet(f"{tmp_path}/in")
        got = [(r["rows"], r["new_keys"], r["revised"], r["repeats"], r["newest"]) for r in run().orderBy("batch").collect()]
        assert got == [(3, 2, 0, 1, days(1)), (2, 1, 1, 0, days(4))]

    def test_registry_and_freshness(self, spark):
        planned = spark.createDataFrame([("fit", 3), ("derive", 1)], "kind string, units long")
        runs = spark.createDataFrame([("fit", "a"), ("fit", "b"), ("fit", "b"), ("derive", "x"), ("rerun", "a")], "kind string, unit string")
        assert sorted((r["kind"], r["want"], r["n"], r["runs"], r["ok"]) for r in census.registry_check(planned, runs).collect()) == [("derive", 1, 1, 1, True), ("fit", 3, 2, 3, False), ("rerun", None, 1, 1, True)]
        f = one(census.freshness(spark.createDataFrame([(days(0),), (days(100),)], "d date"), "d", F.lit(days(120))))
        assert (f["recent"], f["recent_share"], f["stale_days"]) == (1, 0.5, 20)

    def test_streams_run_twice_without_doubling(self, spark, tmp_path):
        from valora.streaming import shadow

        spark.range(10).write.parquet(f"{tmp_path}/in")
        for _ in range(2):
            store = shadow.appended(shadow.arrivals(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
        assert store.count() == 10

    def test_shards_ledger_requests_and_reports(self, spark, tmp_path):
        base = f"file://{tmp_path}"
        files.write_shard(spark.range(3), f"{base}/run", "a")
        done = files.finished_shards(spark, f"{base}/run")
        assert [r["shard"] for r in integrity.pending(spark.createDataFrame([("a",), ("b",)], "shard string"), done, "shard").collect()] == ["b"]
        files.append_records(spark.range(2), f"{base}/store")
        files.append_records(spark.range(3), f"{base}/store")
        assert spark.read.parquet(f"{base}/store").count() == 5
        (tmp_path / "r.json").write_text('{"id": 1, "area": 2.5}\n{"id": 2}\n')
        assert [r["area"] for r in files.read_requests(spark, f"{base}/r.json", "id int, area double").orderBy("id").collect()] == [2.5, None]
        assert "| UNKNOWN |" in files.report("t", {"x": spark.sql("select cast(null as int) as a")})
        with pytest.raises(ValueError):
            files.report("t", {"x": spark.range(500)})

    def test_frozen_judgements_and_boundary(self, spark, tmp_path):
        import hashlib

        (tmp_path / "j.csv").write_text("id,v\n1,a\n")
        sha = hashlib.sha256((tmp_path / "j.csv").read_bytes()).hexdigest()
        assert files.load_frozen(spark, f"file://{tmp_path}/j.csv", "id int, v string", sha).count() == 1
        with pytest.raises(ValueError):
            files.load_frozen(spark, f"file://{tmp_path}/j.csv", "id int, v string", "0")
        spark.range(1).write.parquet(f"{tmp_path}/ok")
        df = spark.read.parquet(f"{tmp_path}/ok")
        assert integrity.assert_allowed_sources(df, [f"{tmp_path}/ok"]) is df
        with pytest.raises(ValueError):
            integrity.assert_allowed_sources(df, ["/elsewhere"])
        (tmp_path / "other").mkdir()
        nested = f"{tmp_path}/other{tmp_path}/ok"  # the allowed path occurs within it
        spark.range(1).write.parquet(nested)
        with pytest.raises(ValueError):
            integrity.assert_allowed_sources(spark.read.parquet(nested), [f"{tmp_path}/ok"])
        spark.range(1).write.parquet(f"{tmp_path}/ok2")
        with pytest.raises(ValueError):
            integrity.assert_allowed_sources(spark.read.parquet(f"{tmp_path}/ok2"), [f"{tmp_path}/ok"])
        assert integrity.assert_allowed_sources(df, [f"file://{tmp_path}/other/../ok/"]) is df

    def test_cli(self, capsys):
        from valora.__main__ import main

        assert main(["version"]) == 0 and "valora" in capsys.readouterr().out
        assert main(["queries"]) == 0 and "valuation" in capsys.readouterr().out
        assert main(["nonsense"]) == 2
