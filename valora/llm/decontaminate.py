"""Benchmark decontamination by spaced seeds.

Words are runs of letters, digits and bytes over 127, lower-cased (A-Z). Fixed
MASKS select six of eleven consecutive words and ignore the others; together
they hit every stretch of WINDOW words that differs in up to two places. Hashes
of the selected words of all benchmark texts are joined with those of all
documents, and around each hit the two texts are compared word by word: an
overlap is a stretch of WINDOW words (or the whole item, if shorter) of which
at least SAME are equal at the same place.

A bitmap of fixed size that holds all benchmark hashes goes to every task, so
that only document hashes that may be among them leave Python; the join decides.

Items under WINDOW words have masks of their own length: the item is cut in one
part more than it may have differences (two more for two of them, so that seeds
keep half of the words), and every choice of parts that all differences can miss
is a mask. Items under LEAST_WORDS words are too common to count; short_items()
lists them. Items with equal words are one, named by the smallest id.

The result has a row for each contaminated document: the item of which it holds
the largest share (of equal shares the longer item, then the smaller id), and
n_items, the number of benchmark rows that overlap with it. So a passage that
many items and many documents share gives as many rows as documents. A seed that
they share is joined by a broadcast of the benchmark's seeds where these are
measured to be small, and the items of one document are compared ITEMS_AT_ONCE
at a time.

Null texts are empty; clean documents have no row. Ids are integers (see id_of);
null ids are kept as null. Documents that are repeated row by row are reported
once. Other columns of the input may have any names; clean() keeps them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from valora.llm import _kernel as K, _spark as S

# Positions that count, found by a search for masks that cover all pairs of differences.
MASKS = ((0, 1, 2, 4, 7, 10), (0, 3, 7, 8, 9, 10), (0, 4, 5, 6, 8, 10))
SPAN, WINDOW, SAME, LEAST_WORDS = 11, 13, 0.8, 5
#: Bits of the bitmap of benchmark hashes, as a power of two.
BITMAP_BITS = 24
#: Items that one row carries to a document's text.
ITEMS_AT_ONCE = 32

OTHER = np.ones(256, bool)
OTHER[0x30:0x3A] = OTHER[0x41:0x5B] = OTHER[0x61:0x7B] = OTHER[0x80:] = False


def _words(data, offs):
    w = K.words(data, offs, OTHER)
    return w, K.word_hashes(data, w, K.LOWER)


def seeds(h: np.ndarray, mask: int) -> np.ndarray:
    """Hashes of the masked words of every h[i:i + SPAN], also across texts."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, mask + 1, np.uint64)
    for k, place in enumerate(MASKS[mask]):
        total += h[place : place + n] * np.uint64(K._WORD_MULT ** (k + 1) & K._M64)
    return K.mix(total)


def needed(size: int) -> int:
    """Words of an overlap of ``size`` words that must be equal."""
    return int(np.ceil(SAME * size - 1e-9))


def short_masks(n: int) -> list[list[int]]:
    """Places that count in seeds of items of n words, under WINDOW: every allowed set of differences misses one mask."""
    off = n - needed(n)
    parts = np.array_split(np.arange(n), {0: 1, 1: 3, 2: 4}[off])
    return [np.concatenate(kept).tolist() for kept in itertools.combinations(parts, len(parts) - off)]


def short_seeds(h: np.ndarray, n: int) -> list[np.ndarray]:
    """For each mask of length n the hashes of the masked words of every h[i:i + n], also across texts."""
    size, out = len(h) - n + 1, []
    for mask, places in enumerate(short_masks(n)):
        total = np.full(max(size, 0), 0xABCD00 + 16 * n + mask, np.uint64)
        for k, place in enumerate(places if size > 0 else ()):
            total += h[place : place + size] * np.uint64(K._WORD_MULT ** (k + 1) & K._M64)
        out.append(K.mix(total))
    return out


def _item_words(batches):
    for rows, data, offs in K.blocks(batches, "__text"):
        w, h = _words(data, offs)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([h[a:b].tobytes() for a, b in zip(w.at[:-1], w.at[1:], strict=True)], pa.binary())], names=["item_id", "words"])


def _item_seeds(batches):
    for batch in batches:
        for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist(), strict=True):
            h = np.frombuffer(raw, np.uint64)
            parts = [seeds(h, m) for m in range(len(MASKS))] if len(h) >= WINDOW else short_seeds(h, len(h))
            hashes, pos = np.concatenate(parts), np.concatenate([np.arange(len(p)) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), item)), pa.array(pos, pa.int32())], names=["hash", "item", "at"])


def _bitmap(batches):
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def _hits(bitmap, short: list[int]):
    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8)
        for rows, data, offs in K.blocks(batches, "__text"):
            w, h = _words(data, offs)
            ids, ths = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            for size, found in [*[(SPAN, seeds(h, m)) for m in range(len(MASKS))], *[(n, found) for n in short for found in short_seeds(h, n)]]:
                at = found >> np.uint64(64 - BITMAP_BITS)
                at = np.flatnonzero(bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                doc = np.searchsorted(w.at, at, "right") - 1
                inside = at + size <= w.at[doc + 1]
                at, doc = at[inside], doc[inside]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(ids[doc]), pa.array(ths[doc]), pa.array(at - w.at[doc], pa.int32())], names=["hash", "id", "th", "pos"])

    return run


def aligned(doc: np.ndarray, item: np.ndarray, shift: int) -> np.ndarray:
    """Places of the item that belong to an overlap when item[0] stands at doc[shift]."""
    size = min(WINDOW, len(item))
    need = needed(size)
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    covered = np.zeros(len(item), bool)
    if hi - lo >= size:
        same = doc[lo + shift : hi + shift] == item[lo:hi]
        total = np.concatenate([[0], np.cumsum(same)])
        for i in np.flatnonzero(total[size:] - total[:-size] >= need):
            covered[lo + i : lo + i + size] |= same[i : i + size]
    return covered


def _overlaps(batches):
    for rows, data, offs in K.blocks(batches, "__text"):
        w, h = _words(data, offs)
        out: list[list] = [[], [], [], [], [], [], []]
        ids, ths, near = (rows.column(c) for c in ("id", "th", "near"))
        for k in range(rows.num_rows):
            text = h[w.at[k] : w.at[k + 1]]
            for item in near[k].as_py():
                words = np.frombuffer(item["words"], np.uint64)
                covered, first = np.zeros(len(words), bool), None
                for shift in sorted({*item["shifts"]}):
                    got = aligned(text, words, shift)
                    if got.any():
                        place = shift + int(np.flatnonzero(got)[0])
                        first = place if first is None else min(first, place)
                        covered |= got
                if first is not None:
                    for col, x in zip(out, (ids[k].as_py(), ths[k].as_py(), item["item"], len(words), int(covered.sum()), first, float(covered.mean())), strict=True):
                        col.append(x)
        kinds = [pa.int64()] * 6 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["id", "th", "item", "item_words", "same_words", "first_word", "overlap"])


def _marked(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(S.id_of(docs).alias("id"), F.xxhash64(F.lit(31), text).alias("th"), text.alias("__text"), S.packed(docs).alias("row"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each document of docs (doc_id, text) and different text of benchmark (item_id, text) that overlap: id,
    th (a hash of the document's text), item, item_words, same_words, first_word, overlap; and the items' names."""
    spark = docs.sparkSession
    S.small_batches(spark)
    words = benchmark.select(S.id_of(benchmark, "item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(_item_words, "item_id long, words binary")
    items = words.where(F.octet_length("words") >= 8 * LEAST_WORDS).groupBy("words").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))
    items = S.cut(items.withColumn("item", F.monotonically_increasing_id()))
    hashes = S.cut(items.mapInArrow(_item_seeds, "hash long, item long, at int"))
    n_hashes, _ = S.measured(hashes, F.lit(0))
    total = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for row in hashes.select("hash").coalesce(2).mapInArrow(_bitmap, "bits binary").toLocalIterator():
        total |= np.frombuffer(row["bits"], np.uint8)
    bitmap = spark.sparkContext.broadcast(total.tobytes())
    lengths = items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(F.col("n") < WINDOW).distinct()
    short = sorted(row["n"] for row in lengths.collect())
    marked = _marked(docs.select("doc_id", "text")).drop("row")
    hits = marked.mapInArrow(_hits(bitmap, short), "hash long, id long, th long, pos int")
    near = S.attach(hits, hashes, ["hash"], 40 * n_hashes, "inner").select("id", "th", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    near = near.groupBy("id", "th", "item").agg(F.collect_list("shift").alias("shifts"))  # as many as the text has words
    near = near.join(items.select(F.col("item").alias("i"), "words"), F.col("item") == F.col("i"))
    nth = F.row_number().over(W.partitionBy("id", "th").orderBy("item")) - 1
    near = near.withColumn("part", F.floor(nth / ITEMS_AT_ONCE)).groupBy("id", "th", "part").agg(F.collect_list(F.struct("item", "shifts", "words")).alias("near"))
    near = S.cut(near.drop("part"))
    _, nbytes = S.measured(near, F.lit(32) + F.aggregate("near", F.lit(0), lambda a, x: a + F.octet_length(x["words"]) + 4 * F.size(x["shifts"]) + 32))
    found = S.attach(marked, near, ["id", "th"], nbytes, "inner").select("id", "th", "near", "__text")
    found = found.mapInArrow(_overlaps, "id long, th long, item long, item_words long, same_words long, first_word long, overlap double").distinct()
    return found, items.select("item", "item_id", "n_items")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document of docs (doc_id, text) that overlaps with a text of benchmark (item_id, text): doc_id,
    item_id, n_items, item_words, same_words, first_word, overlap."""
    return _summed(*overlaps(docs, benchmark)).drop("th")


def _summed(found: DataFrame, items: DataFrame) -> DataFrame:
    named = found.join(items.withColumnRenamed("item", "i"), F.col("item") == F.col("i"))
    best = F.max_by(F.struct("item_id", "item_words", "same_words", "first_word", "overlap"), F.struct("overlap", "item_words", -F.col("item_id")))
    by = named.groupBy("id", "th").agg(best.alias("best"), F.sum("n_items").alias("n_items"))
    item = F.col("best.item_id")
    return by.select(
        F.when(F.col("id") != S.NULL_ID, F.col("id")).alias("doc_id"), F.when(item != S.NULL_ID, item).alias("item_id"), "n_items", "best.item_words", "best.same_words", "best.first_word", "best.overlap", "th",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no item of benchmark, with all their columns."""
    found = S.cut(overlaps(docs, benchmark)[0].select("id", "th").distinct())
    n, _ = S.measured(found, F.lit(0))
    return S.attach(_marked(docs), found, ["id", "th"], 32 * n, "left_anti").select(*S.unpacked(F.col("row"), docs))


def short_items(benchmark: DataFrame) -> DataFrame:
    """item_id and item_words of the items that are too short to be looked for."""
    S.small_batches(benchmark.sparkSession)
    words = benchmark.select(S.id_of(benchmark, "item_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(_item_words, "item_id long, words binary")
    return words.select(F.when(F.col("item_id") != S.NULL_ID, F.col("item_id")).alias("item_id"), (F.octet_length("words") / 8).cast("long").alias("item_words")).where(F.col("item_words") < LEAST_WORDS)


def op6_short_items(spark, sf_dir: str) -> DataFrame:
    return short_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
