"""Language identification by error-correcting output codes.

Every language has a codeword of bits; a binary classifier over hashed byte
n-grams predicts each bit, and a text gets the language whose codeword costs
least, each bit's logistic loss weighed by how reliable that bit was in training.
Up to five languages have the exhaustive code, more have the best of some random
codes. A text is ambiguous where the second language costs hardly more.

Texts are read as UTF-8 with A-Z lowered and other ASCII but letters as one
blank; a text's features are the square roots of its shares of 2- and 3-grams in
2**FEATURE_BITS buckets, over the whole text.

Training takes about MAX_ROWS labelled rows, equally many for each language and
EACH_LEAST at least, those with the smallest hashes of their id and text. Every
language that a labelled row has can be predicted; a model holds one codeword for
each. The rest of the work covers every row.

Null texts and texts without a letter give ``und`` with score 0. With no
labelled text at all every text gives ``und``; with one language every text with
a letter gives that one, with score 1. Equal costs go to the first language in
code point order. Repeated rows give the same result each. Only doc_id, text and
lang are read, whatever other columns are called.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from valora.llm import _kernel as K, _spark as S

MAX_ROWS, EACH_LEAST, FEATURE_BITS = 2000, 4, 12
#: Training steps, their size, and the cost below which two languages are too close.
STEPS, RATE, DECAY, MARGIN = 150, 0.001, 1e-3, 0.7
_DOCS = 128
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def codewords(n: int) -> np.ndarray:
    """n rows of bits, -1 or 1."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:  # each way to split the languages in two, once
        bits = [b for b in itertools.product((-1, 1), repeat=n) if b[0] == 1 and min(b) < 0]
        return np.array(bits, float).T
    rng, best = np.random.default_rng(17), None
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, width))
        same = code @ code.T - 2 * width * np.eye(n)
        if (np.abs(code.sum(0)) < n).all() and (best is None or same.max() < best[0]):
            best = same.max(), code
    return best[1]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of 2**FEATURE_BITS features for each text of a block."""
    n, size = len(offs) - 1, 1 << FEATURE_BITS
    b = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offs))
    counts = np.zeros(n * size)
    for width in (2, 3):
        if len(b) >= width:
            code = b[: len(b) - width + 1].copy()
            for k in range(1, width):
                code = code * np.uint32(0x01000193) + b[k : len(b) - width + 1 + k]
            bucket = (code * np.uint32(0x9E3779B1) + np.uint32(width * 0x1234567)) >> np.uint32(32 - FEATURE_BITS)
            inside = doc[: len(code)] == doc[width - 1 :]
            counts += np.bincount((doc[: len(code)] * size + bucket)[inside], minlength=n * size)
    counts = counts.reshape(n, size)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def _parts(rows: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
    """A block in pieces of _DOCS texts."""
    for lo in range(0, len(offs) - 1, _DOCS):
        hi = min(lo + _DOCS, len(offs) - 1)
        yield rows.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def _sampled(batches):
    for block in K.blocks(batches, "__text"):
        for rows, data, offs in _parts(*block):
            x = features(data, offs).astype(np.float16)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "__h", "x"])


class Model:
    """languages, their codewords, and for each bit its weights and reliability."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        self.w = np.zeros((x.shape[1] if len(x) else 1, self.code.shape[1]), np.float32)
        self.b = np.zeros(self.code.shape[1], np.float32)
        self.weight = np.ones(self.code.shape[1])
        if len(languages) < 2:
            return
        want = self.code[y].astype(np.float32)
        share = 1.0 / np.bincount(y, minlength=len(languages))[y].astype(np.float32)[:, None]  # languages weigh alike
        share /= share.sum()
        scale = np.float32(1 / np.sqrt((x * x).mean()))
        speed_w, speed_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(STEPS):
            margin = want * (x @ self.w + self.b)
            pull = want * share / (1 + np.exp(np.clip(margin, -30, 30)))
            speed_w = 0.9 * speed_w + scale * (x.T @ pull) - DECAY * self.w
            speed_b = 0.9 * speed_b + pull.sum(0)
            self.w += RATE * scale * speed_w
            self.b += RATE * speed_b
        right = (np.sign(x @ self.w + self.b) == want).mean(0).clip(0.51, 0.999)
        self.weight = np.log(right / (1 - right))
        self.weight /= self.weight.mean()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and cost to the second one."""
        if len(self.languages) < 2:
            return np.zeros(len(x), int), np.ones(len(x)), np.full(len(x), np.inf)
        margin = np.clip(x @ self.w + self.b, -30, 30).astype(float)
        cost = np.log1p(np.exp(-margin)) * self.weight @ (self.code.T > 0) + np.log1p(np.exp(margin)) * self.weight @ (self.code.T < 0)
        best = cost.argmin(1)
        order = np.sort(cost, 1)
        odds = np.exp(order[:, :1] - cost)
        return best, 1 / odds.sum(1), order[:, 1] - order[:, 0]


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """labelled: doc_id, text, lang; lang is not null. max_rows: rows to learn from, over all languages."""
    by = labelled.groupBy("lang").count().collect()  # a row for each language
    languages = sorted(r["lang"] for r in by)
    if not languages:
        return Model([], np.zeros((0, 1), np.float32), np.zeros(0, int))
    each = max(EACH_LEAST, max_rows // len(languages))
    # hashes up to a share that leaves a language short once in e ** 20 times, then the smallest ones of each
    shares = labelled.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (2 * each + 40) / r["count"]) * (1 << 30))) for r in by], "__l string, __share long")
    hashed = labelled.select("lang", F.xxhash64(F.lit(3), "doc_id", "text").alias("__h"), F.coalesce("text", F.lit("")).alias("__text"))
    picked = hashed.join(F.broadcast(shares), (F.col("lang") == F.col("__l")) & (F.pmod("__h", F.lit(1 << 30)) <= F.col("__share"))).select("lang", "__h", "__text")
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("__h", F.lit(1 << 30)), "__h"))
    rows = picked.mapInArrow(_sampled, "lang string, __h long, x binary").withColumn("nth", nth).where(F.col("nth") <= each).orderBy("lang", "nth").collect()
    index = {name: k for k, name in enumerate(languages)}
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(len(rows), -1)
    return Model(languages, x, np.array([index[r["lang"]] for r in rows], int))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each of docs' rows (doc_id and text are read): doc_id, lang_pred, score, second cost, ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m: Model = sent.value
        names = np.array([*m.languages, "und"], object)
        for block in K.blocks(batches, "__text"):
            for rows, data, offs in _parts(*block):
                letters = pc.match_substring_regex(rows.column(1), r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) if m.languages else np.zeros(rows.num_rows, bool)
                best, score, gap = m.decode(features(data, offs)) if m.languages else (np.zeros(rows.num_rows, int), np.zeros(rows.num_rows), np.zeros(rows.num_rows))
                best = np.where(letters, best, len(m.languages))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, gap < MARGIN, True))],
                    names=["doc_id", "lang_pred", "score", "ambiguous"],
                )

    S.small_batches(docs.sparkSession)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = S.crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.select("doc_id", "text", "lang").where(~held_out & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
