"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text gives NAMES statistics, computed on its bytes and words. Their
values are binned at quantiles of the training rows; trees of fixed depth are
grown level by level from histograms of gradients of the logistic loss, and kept
as flat arrays (feature, threshold, leaf), through which all rows of a block and
all trees are walked at once.

Training takes at most MAX_ROWS labelled documents, those with the smallest
hashes of their id; of equal hashes those with the smaller label and statistics.
Of splits that gain alike the first statistic in the order of NAMES, and of its
thresholds the smallest, is taken, so reruns grow the same trees. A document with
several labels weighs with their mean. If the labels
have one kind only, every score is their mean; with no labels it is 1, as nothing
speaks against a text. Null texts are empty; empty texts have a score like all
others. Repeated rows get the same score. Labels without quality are left out.
Columns of the input may have any names, those of the operators included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from valora.llm import _kernel as K, _spark as S

MAX_ROWS, BINS, TREES, DEPTH, RATE, SMOOTH, LEAST = 20_000, 48, 80, 4, 0.15, 1.0, 8.0
ACCEPT = 0.7
NAMES = (
    "bytes", "words", "word_length", "upper", "lower", "digits", "blanks", "ends", "symbols", "marks", "high", "distinct", "top_word",
    "stutter", "distinct_pairs", "lines", "line_length", "distinct_lines", "closed_words", "closed_lines", "bars", "digit_words",
    "symbol_words", "loud_words", "entropy", "alone_words",
)

_UPPER, _LOWERCASE, _DIGIT, _BLANK, _LINE, _END, _SYMBOL, _MARK, _HIGH, _OTHER = range(10)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = _UPPER, _LOWERCASE, _DIGIT, _HIGH
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = _BLANK, _LINE
_KIND[[ord(c) for c in ".!?"]], _KIND[[ord(c) for c in ",;:'\"()-"]] = _END, _MARK
_KIND[[ord(c) for c in "#$%&*+/<=>@[]\\^_`{|}~"]] = _SYMBOL
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _runs(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By text how many distinct keys it has, and how often the most frequent one occurs."""
    order = np.argsort(key)
    order = order[np.argsort(doc[order], kind="stable")]
    k, d = key[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, int)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(k))))
    return np.bincount(d[at], minlength=n), most


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text of a block."""
    n = len(offs) - 1
    size = np.diff(offs)
    byte_doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(byte_doc * 10 + _KIND[data], minlength=n * 10).reshape(n, 10)
    w = K.words(data, offs)
    count, doc = w.counts, w.doc()
    h = K.word_hashes(data, w, K.LOWER)
    length = w.end - w.start
    total = np.maximum(count, 1)
    by_doc = lambda flags: np.bincount(doc, weights=flags, minlength=n)
    distinct, top = _runs(h, doc, n)
    follows = doc[1:] == doc[:-1]
    stutter = np.bincount(doc[1:][follows], weights=(h[1:] == h[:-1])[follows], minlength=n)
    pairs, _ = _runs(K.windows(h, 2)[follows] if len(h) > 1 else h[:0], doc[1:][follows], n)
    lines = K.words(data, offs, _NEWLINE)
    line_doc, line_count = lines.doc(), np.maximum(lines.counts, 1)
    distinct_lines, _ = _runs(K.word_hashes(data, lines), line_doc, n)
    last, first = _KIND[data[w.end - 1]], _KIND[data[w.start]]
    before = lambda kind: np.concatenate([[0], np.cumsum(_KIND[data] == kind)])
    inside = lambda total: total[w.end] - total[w.start]
    uppers, digits, symbols = inside(before(_UPPER)), inside(before(_DIGIT)), inside(before(_SYMBOL))
    shares = np.zeros((n, 256))
    for lo in range(0, n, 2048):  # bounded by texts as well as by bytes
        hi = min(n, lo + 2048)
        part = slice(offs[lo], offs[hi])
        shares[lo:hi] = np.bincount((byte_doc[part] - lo) * 256 + data[part], minlength=(hi - lo) * 256).reshape(hi - lo, 256)
    shares /= np.maximum(size, 1)[:, None]
    entropy = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(1)
    whole = np.maximum(size, 1)
    out = [
        np.log1p(size), np.log1p(count), by_doc(length) / total, *[kinds[:, k] / whole for k in (_UPPER, _LOWERCASE, _DIGIT, _BLANK, _END, _SYMBOL, _MARK, _HIGH)],
        distinct / total, top / total, stutter / total, pairs / np.maximum(count - 1, 1), np.log1p(lines.counts),
        np.bincount(line_doc, weights=lines.end - lines.start, minlength=n) / line_count, distinct_lines / line_count, by_doc((last == _END) | (last == _MARK)) / total,
        np.bincount(line_doc, weights=_KIND[data[lines.end - 1]] == _END, minlength=n) / line_count, by_doc((length == 1) & (first == _SYMBOL)) / total,
        by_doc(digits > 0) / total, by_doc(symbols > 0) / total, by_doc((uppers > 1) & (uppers * 2 > length)) / total, entropy, by_doc(length == 1) / total,
    ]
    return np.stack(out, 1)


@dataclass
class Trees:
    """score = sigmoid(base + sum of leaves); trees are complete, their nodes in level order."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature):
            trees, rows = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
            at = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total = total + self.leaf[trees, at - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """y: shares of label 1, from 0 to 1."""
    none = Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    if not len(x):
        return Trees(40.0, none.feature, none.threshold, none.leaf)
    mean = float(np.average(y, weights=weight))
    base = float(np.clip(np.log(max(mean, 1e-12) / max(1 - mean, 1e-12)), -40, 40))
    if not 0 < mean < 1:
        return Trees(base, none.feature, none.threshold, none.leaf)
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    flat = binned + np.arange(m) * BINS
    score = np.full(n, base)
    feature, threshold, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, s = weight * (y - p), weight * p * (1 - p)
        f, t = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(DEPTH):
            lo, width = 2**level - 1, 2**level
            cell = ((at - lo) * (m * BINS))[:, None] + flat
            hist = [np.bincount(cell.ravel(), weights=np.repeat(v, m), minlength=width * m * BINS).reshape(width, m, BINS) for v in (g, s)]
            left_g, left_s = (np.cumsum(v, 2) for v in hist)
            sum_g, sum_s = left_g[:, :, -1:], left_s[:, :, -1:]
            gain = left_g**2 / (left_s + SMOOTH) + (sum_g - left_g) ** 2 / (sum_s - left_s + SMOOTH) - sum_g**2 / (sum_s + SMOOTH)
            gain[(left_s < LEAST / 16) | (sum_s - left_s < LEAST / 16)] = -1
            best = gain.reshape(width, -1).argmax(1)
            cut_bin = np.full(width, BINS)
            for node in range(width):
                k, b = divmod(int(best[node]), BINS)
                if gain[node, k, b] > 1e-9 and b < len(edges[k]):
                    f[lo + node], t[lo + node], cut_bin[node] = k, edges[k][b], b
            at = 2 * at + 1 + (binned[np.arange(n), f[at]] > cut_bin[at - lo])
        where = at - (2**DEPTH - 1)
        value = RATE * np.bincount(where, weights=g, minlength=2**DEPTH) / (np.bincount(where, weights=s, minlength=2**DEPTH) + SMOOTH)
        score += value[where]
        feature.append(f), threshold.append(t), leaf.append(value)
    return Trees(base, np.array(feature), np.array(threshold), np.array(leaf))


def _measured(batches):
    for rows, data, offs in K.blocks(batches, "__text"):
        x = statistics(data, offs)
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))], names=[*rows.schema.names[:-1], "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """docs: doc_id, text; labels: doc_id, quality."""
    kept = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    n = kept.count()
    most = int(min(1.0, 1.3 * max_rows / max(n, 1)) * (1 << 30))
    kept = kept.select(F.col("doc_id").alias("__id"), "y", F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 30)).alias("__h")).where(F.col("__h") <= most)
    kept = F.broadcast(kept) if min(n, 1.4 * max_rows) * 32 <= S.BROADCAST_BYTES else kept
    rows = docs.select("doc_id", "text").join(kept, F.col("doc_id") == F.col("__id")).select("y", "__h", F.coalesce("text", F.lit("")).alias("__text"))
    found = rows.mapInArrow(_measured, "y double, __h long, x array<double>").orderBy("__h", "y", "x").limit(max_rows).collect()
    x = np.array([r["x"] for r in found], float).reshape(len(found), len(NAMES))
    y = np.array([r["y"] for r in found], float)
    return grow(x, np.clip(y, 0, 1), np.ones(len(y)))


def _scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs' rows under plain names (c0, c1 and so on) with their score; text is read."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    columns, text = S.plain(docs)

    def run(batches):
        for rows, data, offs in K.blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sent.value.predict(statistics(data, offs)))], names=[*rows.schema.names, "score"])

    S.small_batches(docs.sparkSession)
    slim = docs.select(*columns)
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, trees: Trees, keep: list[str]) -> DataFrame:
    """The kept columns of docs with __score; one of that name can't be kept and raises ValueError. text is read."""
    if "__score" in keep:
        raise ValueError("the result has a column __score of its own")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    slim = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    place = {c: f"c{k}" for k, c in enumerate(slim.columns)}
    return _scored(slim, trees).select(*[F.col(place[c]).alias(c) for c in kept.columns], F.col("score").alias("__score"))


def held_out(column="doc_id"):
    return S.crc_mod(F.col(column), 4) == 2


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs with a score of ACCEPT or more, by trees that learn from the labelled rows
    that are not held out."""
    trees = train(docs.select("doc_id", "text").where(~held_out()), labels.where(~held_out()))
    return _scored(docs, trees).where(F.col("score") >= ACCEPT).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    trees = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, trees, ["doc_id"]).select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= ACCEPT).cast("int").alias("predicted"))
