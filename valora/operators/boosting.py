"""Boosted regression trees with categories, several settings at once, over rows that stay where they are.

Columns are cut into bins once, by the rows that are learned from. The rows then lie in blocks on the executors, each with
what every setting's trees leave of its label. A pass over the blocks grows one level of one tree of every setting: it adds
up counts and remainders by node and bin, and only these sums reach the driver, which picks the splits. Of two siblings
the smaller one is added up, the other is the difference. Remainders and leaves are whole multiples of a power of two, so
sums are exact and neither partitions nor the order of rows change a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from valora.sources import scratch

#: A column's bins, the cells of equal width that bins of numbers are put together from, and the most rows of a block.
BINS, CELLS, BLOCK = 254, 4096, 2**18
#: Columns with few bins are counted together while their combinations are at most so many.
JOINT = 1024
#: Rounds after which the blocks are written, so that a block's history stays short.
WRITTEN = 50


@dataclass(frozen=True)
class Setting:
    """A column to learn, depth and number of trees, learning rate, what shrinks leaves, and the least rows of a leaf."""

    label: str
    depth: int
    rounds: int
    rate: float = 0.1
    l2: float = 1.0
    least: int = 20

    @property
    def path(self) -> Setting:
        """Settings that differ in rounds only share their first trees."""
        return Setting(self.label, self.depth, 0, self.rate, self.l2, self.least)


@dataclass
class Bins:
    numeric: list[str]
    categorical: list[str]
    low: np.ndarray
    high: np.ndarray
    cells: list[np.ndarray]  # bin of each cell
    values: list[list[str]]  # of a category; all others, and none, have the bin after them

    @property
    def sizes(self) -> list[int]:
        return [*(int(c[-1]) + 1 for c in self.cells), *(len(v) + 1 for v in self.values)]

    def columns(self) -> list[Column]:
        return [*(F.col(c).cast("double").alias(f"__n{k}") for k, c in enumerate(self.numeric)), *(F.col(c).cast("string").alias(f"__c{k}") for k, c in enumerate(self.categorical))]

    def code(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bins by column and row, and the rows that have all numbers; the others' bins mean nothing."""
        x = _numbers(batch, [f"__n{k}" for k in range(len(self.numeric))])
        out = np.empty((len(self.sizes), batch.num_rows), np.min_scalar_type(max(self.sizes)))
        for k, cells in enumerate(self.cells):
            out[k] = cells[_cells(x[k], self.low[k], self.high[k])]
        for k, values in enumerate(self.values):
            found = pc.index_in(batch.column(f"__c{k}"), pa.array(values, pa.string()))
            out[len(self.cells) + k] = found.fill_null(len(values)).to_numpy(zero_copy_only=False)
        return out, np.isfinite(x).all(0)


def _numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in names], float).reshape(len(names), batch.num_rows)


def _cells(x: np.ndarray, low: float, high: float) -> np.ndarray:
    share = np.nan_to_num((x - low) / ((high - low) or 1.0), nan=0.0, posinf=1.0, neginf=0.0)
    return np.clip(share * CELLS, 0, CELLS - 1).astype(np.intp)


def cut_bins(df: DataFrame, numeric: list[str], categorical: list[str]) -> Bins:
    """Each number's cells are put together to bins of about equal counts; up to BINS cells in use are bins as they are.
    All rows are counted."""
    ends = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}{end}") for k, c in enumerate(numeric) for end, f in (("low", F.min), ("high", F.max))], F.count(F.lit(1)).alias("n")).first()
    low, high = (np.array([ends[f"{k}{end}"] or 0.0 for k in range(len(numeric))], float) for end in ("low", "high"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(numeric), CELLS), np.int64)
        for b in batches:
            for k, x in enumerate(_numbers(b, b.schema.names)):
                n[k] += np.bincount(_cells(x, low[k], high[k]), minlength=CELLS)
        k, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(cell), pa.array(n[k, cell])], ["k", "cell", "n"])

    counts = np.zeros((len(numeric), CELLS), np.int64)
    for r in df.select(*[F.col(c).cast("double").alias(f"__n{k}") for k, c in enumerate(numeric)]).mapInArrow(count, "k long, cell long, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"], r["cell"]] = r["n"]
    cells = []
    for n in counts:
        used = np.cumsum(n > 0)
        bins = np.maximum(used - 1, 0) if used[-1] <= BINS else (np.cumsum(n) - n) * BINS // n.sum()
        cells.append(np.unique(bins, return_inverse=True)[1])
    values = [sorted(r[0] for r in df.select(F.col(c).cast("string")).distinct().collect() if r[0] is not None) for c in categorical]
    return Bins(list(numeric), list(categorical), low, high, cells, values)


@dataclass
class Trees:
    """quote = base + sum of leaves; trees are complete, their nodes in level order."""

    bins: Bins
    depth: int
    base: float
    step: float
    feature: np.ndarray  # tree, node
    right: np.ndarray  # tree, node, bin: whether rows of the bin go right
    leaf: np.ndarray  # tree, leaf: multiples of step

    def first(self, rounds: int) -> Trees:
        return Trees(self.bins, self.depth, self.base, self.step, self.feature[:rounds], self.right[:rounds], self.leaf[:rounds])

    def quotes(self, bins: np.ndarray, rounds: list[int]) -> Iterator[np.ndarray]:
        """The quotes after so many trees, in rising order."""
        total, done = np.zeros(bins.shape[1], np.int64), 0
        for upto in rounds:
            for k in range(done, upto):
                total += self.leaf[k][walk(bins, self.feature[k], self.right[k], self.depth)]
            done = max(done, upto)
            yield self.base + total * self.step

    def transform(self, df: DataFrame, to: str = "quote") -> DataFrame:
        """df and its quotes; null where a number is missing."""
        kept, schema = df.columns, StructType([*df.schema.fields, StructField(to, DoubleType())])
        sent = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = sent.value
            for b in batches:
                bins, whole = trees.bins.code(b)
                quote = next(trees.quotes(bins, [len(trees.leaf)]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(quote, mask=~(whole & np.isfinite(quote)))], [*kept, to])

        return df.select("*", *self.bins.columns()).mapInArrow(run, schema)


def walk(bins: np.ndarray, feature: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Each row's node at that depth, counted from the left."""
    right, low = right.view(np.uint8), np.zeros(bins.shape[1], np.uint8)
    for level in range(min(depth, 3)):  # few nodes: all rows through each of them takes less than to look up each row's own
        side = np.zeros(bins.shape[1], np.uint8)
        for k, at in enumerate(range(2**level - 1, 2 ** (level + 1) - 1)):
            side |= right[at].take(bins[feature[at]]) & (low == k)
        low = 2 * low + side
    node, rows, flat, table = low.astype(np.intp), np.arange(bins.shape[1]), bins.ravel(), right.ravel()
    for level in range(3, depth):
        at = node + (2**level - 1)
        node = 2 * node + table.take(at * right.shape[1] + flat.take(feature.take(at) * len(rows) + rows))
    return node


def _groups(sizes: list[int]) -> list[list[int]]:
    """Columns that are counted together, those with the fewest bins first."""
    out, product = [], JOINT + 1
    for f in sorted(range(len(sizes)), key=lambda f: (sizes[f], f)):
        if product * sizes[f] > JOINT:
            out.append([])
            product = 1
        out[-1].append(f)
        product *= sizes[f]
    return out


def _members(sizes: list[int], group: list[int]) -> np.ndarray:
    """By combination of a group's bins 1 for each bin that it has."""
    at = np.indices([sizes[f] for f in group]).reshape(len(group), -1)
    return np.concatenate([np.eye(sizes[f])[k] for f, k in zip(group, at, strict=True)], 1)


def _sums(sizes: list[int], groups: list[list[int]], bins: np.ndarray, rest: list[np.ndarray], nodes: list[np.ndarray | None], slots: list[int]) -> list[np.ndarray]:
    """For each path counts and remainders by slot and bin; nodes has each row's slot, under 0 for rows that are not added up."""
    start, joint = np.concatenate([[0], np.cumsum(sizes)]), []
    for group in groups:
        key = np.zeros(bins.shape[1], np.intp)
        for f in group:
            key = key * sizes[f] + bins[f]
        joint.append(key)
    columns = [np.concatenate([np.arange(start[f], start[f + 1]) for f in group]) for group in groups]
    members = [_members(sizes, group) if len(group) > 1 else None for group in groups]
    out = []
    for g, slot, n in zip(rest, nodes, slots, strict=True):
        one = np.zeros((2, n, start[-1]))
        rows = None if slot is None else np.flatnonzero(slot >= 0)
        weight, at = (g if rows is None else g[rows]).astype(float), None if rows is None else slot[rows]
        for group, key, column, member in zip(groups, joint, columns, members, strict=True):
            size = math.prod(sizes[f] for f in group)
            k = key if rows is None else at * size + key[rows]
            for part, w in enumerate((None, weight)):
                full = np.bincount(k, w, n * size).reshape(n, size)
                one[part][:, column] = full if member is None else full.astype(float) @ member
        out.append(one)
    return out


def _splits(sums: np.ndarray, sizes: list[int], categorical: int, l2: float, least: int) -> list[tuple | None]:
    """For each node the column, the bins that go right, and the counts and remainders left and right, by the largest fall
    of the squared error; none where no split leaves both sides enough rows. Categories are put in order of their means."""
    n, g = sums
    start = np.concatenate([[0], np.cumsum(sizes)])
    order = np.broadcast_to(np.arange(start[-1]), n.shape).copy()
    for f in range(len(sizes) - categorical, len(sizes)):
        a, b = start[f], start[f + 1]
        mean = np.where(n[:, a:b] > 0, g[:, a:b] / np.maximum(n[:, a:b], 1), np.inf)
        order[:, a:b] = a + np.argsort(mean, 1, kind="stable")
    sides = []
    for x in (np.take_along_axis(n, order, 1), np.take_along_axis(g, order, 1)):
        total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, 1)], 1)
        left = total[:, 1:] - np.repeat(total[:, start[:-1]], sizes, 1)
        every = left[:, [sizes[0] - 1]]
        sides.append((left, every - left, every))
    (ln, rn, tn), (lg, rg, tg) = sides
    with np.errstate(invalid="ignore"):  # of no rows without shrinkage
        gain = lg**2 / (ln + l2) + rg**2 / (rn + l2) - tg**2 / (tn + l2)
    gain[(ln < least) | (rn < least)] = -np.inf
    out = []
    for node, at in enumerate(gain.argmax(1)):
        if not gain[node, at] > 0:
            out.append(None)
            continue
        f = int(np.searchsorted(start, at, "right") - 1)
        right = np.zeros(max(sizes), bool)
        right[order[node, at + 1 : start[f + 1]] - start[f]] = True
        out.append((f, right, (ln[node, at], rn[node, at]), (lg[node, at], rg[node, at])))
    return out


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def grow(df: DataFrame, numeric: list[str], categorical: list[str], settings: list[Setting]) -> dict[Setting, Trees]:
    """The trees of each setting's path, as many as its largest number of rounds. Rows without a label or a number that is
    there are left out."""
    spark, labels = df.sparkSession, list(dict.fromkeys(s.label for s in settings))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    for c in [*numeric, *labels]:
        df = df.where(finite(c))
    paths = {p: max(s.rounds for s in settings if s.path == p) for p in dict.fromkeys(s.path for s in settings)}
    bins = cut_bins(df, numeric, categorical)
    sizes, every = bins.sizes, list(paths)
    groups = _groups(sizes)
    ends = df.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in labels]).first()
    if not ends["n"]:
        return {p: Trees(bins, p.depth, math.nan, 1.0, np.zeros((0, 1), int), np.zeros((0, 1, 1), bool), np.zeros((0, 1), int)) for p in every}
    step = {c: 2.0 ** (math.ceil(math.log2(ends[c] or 1.0)) - 24) for c in labels}
    unit = lambda c: F.rint(F.col(c).cast("double") / F.lit(step[c])).cast("int")
    total = df.agg(*[F.sum(unit(c).cast("long")).alias(c) for c in labels]).first()
    base = {c: round(total[c] / ends["n"]) for c in labels}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _numbers(b, [f"__y{k}" for k in range(len(labels))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([bins.code(b)[0].tobytes()]), pa.array([y.tobytes()])], ["n", "bins", "y"])

    kind, known = np.min_scalar_type(max(sizes)), [labels.index(p.label) for p in every]
    first = np.array([base[p.label] for p in every], np.int32)

    def block(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, y = [np.zeros((len(sizes), 0), kind)], [np.zeros((len(labels), 0), np.int32)]
        for r in rows:
            x.append(np.frombuffer(r["bins"], kind).reshape(len(sizes), r["n"]))
            y.append(np.frombuffer(r["y"], np.int32).reshape(len(labels), r["n"]))
        yield np.concatenate(x, 1), np.concatenate(y, 1)[known] - first[:, None]

    parts = max(spark.sparkContext.defaultParallelism, -(-ends["n"] // BLOCK))
    coded = df.select(*bins.columns(), *[unit(c).alias(f"__y{k}") for k, c in enumerate(labels)])
    held = ends["n"] <= BLOCK  # then the driver goes over the one block itself: a pass takes longer to send out than to do
    packed = (coded if held else coded.repartition(parts)).mapInArrow(pack, "n long, bins binary, y binary")
    blocks = list(block(packed.toLocalIterator())) if held else packed.rdd.mapPartitions(block).persist(StorageLevel.DISK_ONLY)
    if not held and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch.place(spark, "trees"))
    grown, sent, written, before = {p: [] for p in every}, [], [], None
    for done in range(max(paths.values())):
        at = [k for k, p in enumerate(every) if paths[p] > done]
        tree = {k: (np.zeros(2 ** every[k].depth - 1, np.intp), np.zeros((2 ** every[k].depth - 1, max(sizes)), bool)) for k in at}
        slots, sums, ends_of = {k: np.zeros(1, np.intp) for k in at}, {}, {}
        for level in range(max(every[k].depth for k in at)):
            now = [k for k in at if every[k].depth > level]
            found = _pass(blocks, sizes, groups, level, {k: (slots[k], *(a[: 2**level - 1] for a in tree[k])) for k in now}) if any((slots[k] >= 0).any() for k in now) else []
            if before is not None:  # the pass has worked out its successor
                before.unpersist()
                before = None
            for k, got in zip(now, found or [np.zeros((2, 0, sum(sizes)))] * len(now), strict=True):
                slot, p = slots[k], every[k]
                if level == 0:
                    sums[k], ends_of[k] = got, np.array([[got[0, 0, : sizes[0]].sum()], [got[1, 0, : sizes[0]].sum()]])
                else:
                    both = np.zeros((2, 2**level, sum(sizes)))
                    for node in np.flatnonzero(slot >= 0):
                        both[:, node] = got[:, slot[node]]
                        both[:, node ^ 1] = sums[k][:, node // 2] - got[:, slot[node]]
                    sums[k] = both
                next_ends, next_slots, n = np.zeros((2, 2 ** (level + 1))), np.full(2 ** (level + 1), -1, np.intp), 0
                for node, split in enumerate(_splits(sums[k], sizes, len(categorical), p.l2, p.least)):
                    if split is None:  # all rows go left
                        next_ends[:, 2 * node] = ends_of[k][:, node]
                        continue
                    f, right, counts, rest = split
                    tree[k][0][2**level - 1 + node], tree[k][1][2**level - 1 + node] = f, right
                    next_ends[:, 2 * node : 2 * node + 2] = counts, rest
                    if max(counts) >= 2 * p.least:
                        next_slots[2 * node + int(counts[1] < counts[0])] = n
                        n += 1
                slots[k], ends_of[k] = next_slots, next_ends
        leaves = {k: np.rint(every[k].rate * ends_of[k][1] / (ends_of[k][0] + every[k].l2)).astype(np.int32) for k in at}
        for k in at:
            grown[every[k]].append((*tree[k], leaves[k]))
        if done + 1 < max(paths.values()):
            last = {k: (*tree[k], leaves[k], every[k].depth) for k in at}
            if held:
                blocks = [_left(b, last) for b in blocks]
                continue
            sent.append(spark.sparkContext.broadcast(last))
            before, blocks = blocks, blocks.map(lambda b, s=sent[-1]: _left(b, s.value)).persist(StorageLevel.DISK_ONLY)
            if (done + 1) % WRITTEN == 0:
                blocks.checkpoint()
                written.append(blocks)
    if not held:
        blocks.unpersist()
    for b in sent:
        b.unpersist()
    for w in filter(None, (w.getCheckpointFile() for w in written)):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(w)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return {p: Trees(bins, p.depth, base[p.label] * step[p.label], step[p.label], *(np.array(x) for x in zip(*grown[p], strict=True))) for p in every}


def _pass(blocks, sizes: list[int], groups: list[list[int]], level: int, trees: dict[int, tuple]) -> list[np.ndarray]:
    def run(rows: Iterator) -> Iterator[list[np.ndarray]]:
        for x, rest in rows:
            nodes = [None if not level else slot[walk(x, feature, right, level)] for slot, feature, right in trees.values()]
            yield _sums(sizes, groups, x, [rest[k] for k in trees], nodes, [int(slot.max()) + 1 for slot, _, _ in trees.values()])

    if isinstance(blocks, list):
        return reduce(_added, run(blocks))
    return blocks.mapPartitions(run).treeReduce(_added, 1 if blocks.getNumPartitions() <= 32 else 2)


def _left(block: tuple[np.ndarray, np.ndarray], trees: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The block with what a round's trees leave of its remainders."""
    x, rest = block[0], block[1].copy()
    for k, (feature, right, leaf, depth) in trees.items():
        rest[k] -= leaf[walk(x, feature, right, depth)]
    return x, rest


def errors(df: DataFrame, grown: dict[Setting, Trees], settings: list[Setting]) -> list[float | None]:
    """The mean absolute error of each setting over the rows of df that get a quote."""
    sent, bins = df.sparkSession.sparkContext.broadcast(grown), next(iter(grown.values())).bins
    labels = list(dict.fromkeys(s.label for s in settings))
    stages = {p: sorted({s.rounds for s in settings if s.path == p}) for p in grown}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = dict.fromkeys(settings, 0), dict.fromkeys(settings, 0)
        for b in batches:
            x, whole = bins.code(b)
            y = dict(zip(labels, _numbers(b, [f"__y{k}" for k in range(len(labels))]), strict=True))
            for p, trees in sent.value.items():
                for rounds, quote in zip(stages[p], trees.quotes(x, stages[p]), strict=True):
                    gap = np.abs(quote - y[p.label])[whole]
                    gap = gap[np.isfinite(gap)]
                    for s in settings:
                        if s.path == p and s.rounds == rounds:
                            total[s] += int(np.rint(gap * 2**30).sum())
                            n[s] += len(gap)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(settings)), pa.int64()), pa.array([n[s] for s in settings], pa.int64()), pa.array([total[s] for s in settings], pa.int64())], ["k", "n", "gap"])

    out = [None] * len(settings)
    rows = df.select(*bins.columns(), *[F.col(c).cast("double").alias(f"__y{k}") for k, c in enumerate(labels)]).mapInArrow(run, "k long, n long, gap long")
    for r in rows.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("gap").cast("decimal(38,0)")).alias("gap")).collect():
        out[r["k"]] = int(r["gap"]) / r["n"] / 2**30 if r["n"] else None
    return out
