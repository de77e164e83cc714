"""Boosted trees: the plain search, whatever the blocks, and grids that leave the models their rounds."""

from __future__ import annotations

import datetime as dt
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.operators import boosting, models
from valora.plans import registry


def rows(n, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 20, n), rng.random(n).round(2), rng.choice(list("pqrst"), n)
    y = np.sin(a / 3.0) + np.where(b > 0.4, 1.0, 0.0) * (a > 10) + np.where(np.isin(c, ["q", "t"]), 0.7, 0.0) + 0.01 * rng.normal(size=n)
    return [(float(u), float(v), str(w), float(z)) for u, v, w, z in zip(a, b, c, y, strict=True)]


def frame(spark, data):
    return spark.createDataFrame(data, "a double, b double, c string, y double")


def plain(data, depth, rounds, rate, l2, least):
    """Quotes of the training rows: each node's best split over all thresholds and all sets of categories."""
    cols, y = list(zip(*data, strict=True)), np.array([r[3] for r in data])
    sides = [np.array(cols[k]) <= t for k in (0, 1) for t in sorted(set(cols[k]))]
    kinds = sorted(set(cols[2]))
    sides += [np.isin(cols[2], s) for n in range(1, len(kinds)) for s in combinations(kinds, n)]

    def leaves(at, rest, level):
        part = lambda m: rest[m].sum() ** 2 / (m.sum() + l2)
        best = max(((part(at & s) + part(at & ~s) - part(at), k) for k, s in enumerate(sides) if min((at & s).sum(), (at & ~s).sum()) >= least), default=(0, None)) if level < depth else (0, None)
        if best[0] <= 0:
            return np.where(at, rate * rest[at].sum() / (at.sum() + l2), 0.0)
        s = sides[best[1]]
        return leaves(at & s, rest, level + 1) + leaves(at & ~s, rest, level + 1)

    quote = np.full(len(y), y.mean())
    for _ in range(rounds):
        quote = quote + leaves(np.ones(len(y), bool), y - quote, 0)
    return quote


class TestBoosting:
    def test_trees_are_those_of_a_plain_search(self, spark):
        data = rows(150)
        trees = boosting.grow(frame(spark, data), ["a", "b"], ["c"], [s := boosting.Setting("y", 3, 4, 0.3, 2.0, 5)])[s.path]
        got = [r["quote"] for r in trees.transform(frame(spark, data).coalesce(1)).collect()]
        assert np.allclose(got, plain(data, 3, 4, 0.3, 2.0, 5), atol=1e-5)

    def test_blocks_change_nothing(self, spark, monkeypatch):
        data = rows(400)
        settings = [boosting.Setting("y", d, r, 0.2, 1.0, 4) for d, r in ((2, 5), (4, 3), (4, 5))]
        held = boosting.grow(frame(spark, data), ["a", "b"], ["c"], settings)
        monkeypatch.setattr(boosting, "BLOCK", 60)
        monkeypatch.setattr(boosting, "WRITTEN", 2)
        written = lambda: {p for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*")}
        before = written()
        dealt = boosting.grow(frame(spark, data[::-1]).repartition(3), ["a", "b"], ["c"], settings)
        assert written() == before
        assert list(held) == list(dealt) == [settings[0].path, settings[1].path]
        for p in held:
            assert len(held[p].leaf) == 5 and held[p].base == dealt[p].base
            for x in ("feature", "right", "leaf"):
                assert np.array_equal(getattr(held[p], x), getattr(dealt[p], x))

    def test_errors_by_rounds_are_those_of_the_first_trees(self, spark):
        train, later = frame(spark, rows(200)), frame(spark, rows(90, 8))
        settings = [boosting.Setting("y", 2, r, 0.3, 1.0, 5) for r in (1, 6)]
        grown = boosting.grow(train, ["a", "b"], ["c"], settings)
        want = [grown[s.path].first(s.rounds).transform(later).agg(F.avg(F.abs(F.col("quote") - F.col("y")))).first()[0] for s in settings]
        assert boosting.errors(later, grown, settings) == pytest.approx(want) and want[1] < want[0]

    def test_gaps(self, spark):
        """A row without a number has no quote and teaches nothing; unseen and missing categories have one."""
        data = rows(100)
        trees = models.fit_trees(frame(spark, [*data, (None, 0.5, "p", 900.0), (1.0, 0.5, "p", None), (1.0, float("nan"), "p", 900.0)]), ["a", "b"], ["c"], depth=2, rounds=3)
        assert trees.base == pytest.approx(np.mean([r[3] for r in data]), abs=1e-5)
        got = [r["quote"] for r in trees.transform(frame(spark, [(3.0, 0.1, "zz", None), (3.0, 0.1, None, None), (None, 0.1, "p", None)]).coalesce(1)).collect()]
        assert got[0] == got[1] and got[0] is not None and got[2] is None
        assert models.fit_trees(frame(spark, []), ["a", "b"], ["c"]).transform(frame(spark, data)).where("quote IS NOT NULL").count() == 0

    def test_many_categories_and_cells(self, spark):
        df = spark.range(3000).select((F.col("id") % 600).cast("string").alias("c"), F.col("id").cast("double").alias("a"), (F.col("id") % 600 % 7 == 0).cast("double").alias("y"))
        trees = models.fit_trees(df, ["a"], ["c"], depth=1, rounds=1, rate=1.0, l2=0.0)
        assert max(trees.bins.sizes) == 601 and trees.bins.sizes[0] == boosting.BINS
        assert trees.transform(df).agg(F.max(F.abs(F.col("quote") - F.col("y")))).first()[0] < 1e-5


class TestGrids:
    def test_every_configuration_has_its_rounds(self, spark):
        """What a few rounds leave of a label that the columns explain is not left by any configuration of the query."""
        df = frame(spark, rows(2000))
        spread = df.agg(F.avg(F.abs(F.col("y") - 0.8))).first()[0]
        for grid in registry.modelling.GRIDS.values():
            for config in (grid[0], grid[-1]):
                error = models.fit_trees(df, ["a", "b"], ["c"], "y", **config).transform(df).agg(F.avg(F.abs(F.col("quote") - F.col("y")))).first()[0]
                assert error < 0.15 * spread, (config, error)

    def test_selection_by_the_inner_slice_and_refit_to_the_whole(self, spark):
        date = F.expr("date_add(DATE '1999-01-01', cast(a AS int) * 30)")
        df = frame(spark, rows(600)).withColumn("sale_date", date).withColumn("z", F.col("y") + 1)
        grid = [{"depth": 2, "rounds": r, "rate": 0.2, "l2": 1.0} for r in (1, 8)]
        cutoff = F.lit(dt.date(2000, 1, 1))
        got = models.select_trees(df, cutoff, ["a", "b"], ["c"], {"one": ("y", grid), "two": ("z", grid)})
        fit, judge = df.where(F.col("sale_date") < cutoff), df.where(F.col("sale_date") >= cutoff)
        for name, label in (("one", "y"), ("two", "z")):
            model, config, errors = got[name]
            want = [models.fit_trees(fit, ["a", "b"], ["c"], label, **c).transform(judge).agg(F.avg(F.abs(F.col("quote") - F.col(label)))).first()[0] for c in grid]
            assert errors == pytest.approx(want) and config == grid[int(np.argmin(want))]
            whole = models.fit_trees(df, ["a", "b"], ["c"], label, **config)
            assert np.array_equal(model.leaf, whole.leaf) and len(model.leaf) == config["rounds"]
