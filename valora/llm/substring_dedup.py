"""Removal of passages that a document with a smaller id has already.

Fixed-block anchors. Every text is cut into non-overlapping reference blocks of
BLOCK_WORDS words, and every rolling window of as many words probes them. A
passage of WINDOW words holds a whole reference block wherever it lies, as
WINDOW >= 2 * BLOCK_WORDS - 1, so the anchors lose nothing. Around the anchors
that match, the hashes of all windows of WINDOW words are compared, and runs of
repeated windows are the maximal exact repeats. Of equal windows, those in the
document with the smallest id stay.

Copies of a whole text are found first, by two hashes of it, so that a text that
a third of the rows share has its anchors in the bins once. Windows that many
documents of a bounded sample share (COMMON of its documents at least) do not go
to bins either, where each would be one task's: as anchors they are taken as
matching without being probed, and of whole windows the smallest id is found by
one minimum per task. Which windows these are changes no result.

Windows are told apart by 64-bit hashes of their words. Of n different windows
about n * n / 2 ** 65 pairs are expected to share one: 0.3 pairs for 3.4e9 windows.
Ids are integers (see id_of); columns of the input may have any names but those of
the result. Null texts are empty and have no words. Texts under WINDOW words lose nothing. A
null id counts as larger than any other; rows of one id do not remove each
other's words; a row that is repeated gives the same result each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from valora.llm import _bins as B, _kernel as K, _spark as S

WINDOW, BLOCK_WORDS = 50, 25
#: Documents of the sample, the share and number of them that make a window common, and windows kept so.
SAMPLE, COMMON, COMMON_LEAST, COMMON_MOST = 6000, 0.005, 20, 65_536
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """All of docs' columns as one struct, row, with doc_id and text as __id, __fp, __fp1, __fp2 and __text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(S.packed(docs).alias("row"), S.id_of(docs).alias("__id"), F.hash(F.lit(11), text).alias("__fp"), F.xxhash64(F.lit(11), text).alias("__fp1"), F.xxhash64(F.lit(12), text).alias("__fp2"), text.alias("__text"))


def _rows(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _common(batches):
    """Anchors and whole windows that occur twice or more in a task's part of the sample."""
    found: dict[int, list[np.ndarray]] = {BLOCK_WORDS: [], WINDOW: []}
    for _, data, offs in K.blocks(batches, "__text"):
        w = K.words(data, offs)
        h = K.word_hashes(data, w)
        for size, parts in found.items():
            parts.append(K.windows(h, size)[K.starts(w.at, size)[0]])
    for size, parts in found.items():
        h, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(keep.sum(), size)), pa.array(h[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["size", "window", "n"])


def common_windows(first: DataFrame, n_rows: int) -> dict[int, np.ndarray]:
    """Sorted hashes of common anchors and whole windows, COMMON_MOST of each at most."""
    few = int(min(1.0, SAMPLE / max(n_rows, 1)) * (1 << 30))
    sample = first.where(F.pmod(F.xxhash64(F.lit(13), "__id", "__fp"), F.lit(1 << 30)) <= few).select("__text")
    counts = sample.mapInArrow(_common, "size long, window long, n long").groupBy("size", "window").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= max(COMMON_LEAST, int(COMMON * min(SAMPLE, n_rows))))
    out = {}
    for size in (BLOCK_WORDS, WINDOW):
        rows = counts.where(F.col("size") == size).orderBy(F.desc("n"), "window").limit(COMMON_MOST).collect()
        out[size] = np.sort(np.array([r["window"] for r in rows], np.int64).view(np.uint64))
    return out


def _anchors(n_bins: int, common):
    def run(batches):
        packer, sure = B.Packer(n_bins, np.uint32), B.Packer(n_bins, np.uint32, sure=True)
        for rows, data, offs in K.blocks(batches, "__text"):
            w = K.words(data, offs)
            counts = w.counts
            h = K.windows(K.word_hashes(data, w), BLOCK_WORDS)
            idx, where = K.starts(w.at, BLOCK_WORDS)
            doc = np.repeat(np.arange(len(counts)), np.diff(where))
            long = counts[doc] >= WINDOW
            idx, doc = idx[long], doc[long]
            is_common = K.place_in(h[idx], common.value) >= 0
            for to, part in ((packer, ~is_common), (sure, is_common)):
                yield from to.add(_rows(rows, "__id"), _rows(rows, "__fp"), doc[part], (idx - w.at[doc])[part], h[idx[part]])
        yield from packer.flush()
        yield from sure.flush()

    return run


def _anchored(e: B.Entries) -> np.ndarray:
    """Entries whose hash is that of a reference block in one document and of a window in another one,
    in the order of ids that lets the latter lose words."""
    order = np.argsort(e.hash)
    h, doc, block = e.hash[order], e.doc[order], e.pos[order] % BLOCK_WORDS == 0
    ids = e.ids[doc]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    group = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
    least = np.minimum.reduceat(np.where(block, ids, _LAST), at)[group]
    most = np.maximum.reduceat(ids, at)[group]
    return order[(ids > least) | (block & (ids < most))]


def _placed(batches):
    """Rows of a block with the hash, text and position of each whole window around their anchors."""
    for rows, data, offs in K.blocks(batches, "__text"):
        w = K.words(data, offs)
        h = K.windows(K.word_hashes(data, w), WINDOW)
        doc, pos = _inside(rows, w.counts - WINDOW + 1)
        yield rows, doc, pos, h[w.at[doc] + pos]


def _smallest(common):
    """The smallest id that each common window has in a task."""

    def run(batches):
        least = np.full(len(common.value), _LAST)
        seen = np.zeros(len(least), bool)
        for rows, doc, _, h in _placed(batches):
            place = K.place_in(h, common.value)
            np.minimum.at(least, place[place >= 0], _rows(rows, "__id")[doc[place >= 0]])
            seen[place[place >= 0]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen)), pa.array(least[seen])], names=["place", "id"])

    return run


def _windows(n_bins: int, common, smallest):
    def run(batches):
        packer, sure = B.Packer(n_bins, np.uint64), B.Packer(n_bins, np.uint64, sure=True)
        for rows, doc, pos, h in _placed(batches):
            ids, fps = _rows(rows, "__id"), _rows(rows, "__fp")
            place = K.place_in(h, common.value)
            rare = place < 0
            later = np.zeros(len(h), bool)
            later[~rare] = ids[doc[~rare]] > smallest.value[place[~rare]]
            for to, part in ((packer, rare), (sure, later)):
                yield from to.add(ids, fps, doc[part], pos[part], h[part])
        yield from packer.flush()
        yield from sure.flush()

    return run


def _inside(rows: pa.RecordBatch, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and position of all places in the rows' spans lo..hi, below n."""
    docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (lo, hi) in enumerate(zip(rows.column("__lo").to_pylist(), rows.column("__hi").to_pylist(), strict=True)):
        if lo is not None:
            for a, b in zip(np.frombuffer(lo, np.int32), np.minimum(np.frombuffer(hi, np.int32), n[k]), strict=True):
                if a < b:
                    places.append(np.arange(a, b))
                    docs.append(np.full(b - a, k))
    return np.concatenate(docs), np.concatenate(places)


def _repeated(e: B.Entries) -> np.ndarray:
    """Entries whose window also starts in a document with a smaller id."""
    order = np.argsort(e.hash)
    h, ids = e.hash[order], e.ids[e.doc[order]]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    least = np.minimum.reduceat(ids, at)[np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))]
    return order[ids > least]


def _kept(text: str, n: int):
    """For each row its n columns, its words, the removed ones, and the others joined by a blank."""

    def run(batches):
        for rows, data, offs in K.blocks(batches, text):
            w = K.words(data, offs)
            counts = w.counts
            edge = np.zeros(len(w.start) + 1, np.int32)
            whole = _rows(rows, "__whole")
            for k, (lo, hi) in enumerate(zip(rows.column("__lo").to_pylist(), rows.column("__hi").to_pylist(), strict=True)):
                if whole[k] and counts[k] >= WINDOW:
                    a, b = np.array([0]), np.array([counts[k]])
                elif lo is not None:
                    a, b = np.frombuffer(lo, np.int32), np.frombuffer(hi, np.int32)
                else:
                    continue
                np.add.at(edge, w.at[k] + np.minimum(a, counts[k]), 1)
                np.add.at(edge, w.at[k] + np.minimum(b, counts[k]), -1)
            stay = np.cumsum(edge)[:-1] <= 0
            n_kept = K.segment_sums(stay, w.at)
            start, end, doc = w.start[stay], w.end[stay], w.doc()[stay]
            more = np.zeros(len(start), np.int64)  # a blank after each kept word but the last of a text
            more[:-1] = doc[1:] == doc[:-1]
            mark = np.zeros(len(data) + 1, np.int8)
            mark[start] += 1
            np.subtract.at(mark, end + more, 1)
            out = data.copy()
            out[end[more > 0]] = 0x20
            out = out[np.cumsum(mark[:-1]) > 0]
            sizes = np.zeros(len(counts) + 1, np.int64)
            np.add.at(sizes, doc + 1, end - start + more)
            kept = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(np.cumsum(sizes)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:n], pa.array(counts), pa.array(counts - n_kept), kept.cast(pa.string())],
                names=[*rows.schema.names[:n], "n_words", "n_removed", "kept"],
            )

    return run


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """All columns of docs (doc_id and text at least) with __n_words, __n_removed and __kept, the kept words joined by
    one blank. Columns of these three names raise ValueError."""
    taken = {"__n_words", "__n_removed", "__kept"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"the result has columns of its own called {', '.join(sorted(taken))}")
    return _deduped(docs).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], *[F.col(c).alias(f"__{c}") for c in ("n_words", "n_removed", "kept")])


def _deduped(docs: DataFrame) -> DataFrame:
    """docs' rows under plain names (c0, c1 and so on) with n_words, n_removed and kept."""
    S.small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    slim = ["__id", "__fp", "__text"]
    texts = S.cut(
        keyed.groupBy("__fp1", "__fp2").agg(F.min("__id").alias("least"), F.count(F.lit(1)).alias("n"), F.max(F.octet_length("__text")).cast("long").alias("size"))
    )
    n_texts, nbytes = S.measured(texts, "size")
    several = texts.where("n > 1").select(F.col("__fp1").alias("fp"), F.col("__fp2").alias("fp2"), "least")
    copies = keyed.select("__id", "__fp", "__fp1", "__fp2").join(several, (F.col("__fp1") == F.col("fp")) & (F.col("__fp2") == F.col("fp2")) & (F.col("__id") > F.col("least")))
    copies = S.cut(copies.select("__id", "__fp").distinct())
    n_copies, _ = S.measured(copies, F.lit(0))
    first = S.attach(keyed.select(*slim), copies, ["__id", "__fp"], 40 * n_copies, "left_anti")

    send = docs.sparkSession.sparkContext.broadcast
    common = {size: send(hashes) for size, hashes in common_windows(first, n_texts).items()}
    found = B.matched(first.mapInArrow(_anchors(B.bins_for(nbytes), common[BLOCK_WORDS]), B.PACKED), np.uint32, _anchored)
    near = S.cut(B.spans(found, BLOCK_WORDS, 1).withColumnsRenamed({"id": "__id", "fp": "__fp"}))
    n_near, near_bytes = S.measured(near, F.octet_length("lo") * 2 + 60)
    around = S.attach(first, near.withColumnsRenamed({"lo": "__lo", "hi": "__hi"}), ["__id", "__fp"], near_bytes, "inner")
    smallest = np.full(len(common[WINDOW].value), _LAST)
    if len(smallest):
        for row in around.mapInArrow(_smallest(common[WINDOW]), "place long, id long").groupBy("place").agg(F.min("id").alias("id")).collect():
            smallest[row["place"]] = row["id"]
    repeats = B.matched(around.mapInArrow(_windows(B.bins_for(nbytes // 2), common[WINDOW], send(smallest)), B.PACKED), np.uint64, _repeated)
    removed = S.cut(
        B.spans(repeats, 0, WINDOW).select(F.col("id").alias("__id"), F.col("fp").alias("__fp"), "lo", "hi", F.lit(False).alias("whole"))
        .unionByName(copies.select("__id", "__fp", F.lit(None).cast("binary").alias("lo"), F.lit(None).cast("binary").alias("hi"), F.lit(True).alias("whole")))
    )
    _, removed_bytes = S.measured(removed, F.coalesce(F.octet_length("lo") * 2, F.lit(0)) + 60)
    full = S.attach(keyed, removed.withColumnsRenamed({"lo": "__lo", "hi": "__hi", "whole": "__whole"}), ["__id", "__fp"], removed_bytes)
    names = [f"c{k}" for k in range(len(docs.columns))]
    full = full.select(*[F.col("row")[c].alias(c) for c in names], "__lo", "__hi", F.coalesce("__whole", F.lit(False)).alias("__whole"))
    out = T.StructType([*full.schema.fields[: len(names)], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return full.mapInArrow(_kept(S.plain(docs)[1], len(names)), out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the words that dedup_substrings removes taken out of text; texts that lose none stay
    as they are, documents that lose all their words go. n_chars, if there, follows the text."""
    changed = F.col("n_removed") > 0
    out = []
    for k, c in enumerate(docs.columns):
        was = F.col(f"c{k}")
        if c == "text":
            was = F.when(changed, F.col("kept")).otherwise(was)
        elif c == "n_chars":
            was = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(was)
        out.append(was.alias(c))
    return _deduped(docs).where("n_removed = 0 or n_removed < n_words").select(*out)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


#: Windows by text in DuckDB: the same rows by comparing every window with every other.
OP8_SQL = """
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
    SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 49), ' ') AS t
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS s FROM w WHERE len(ws) >= 50)
), least AS (
    SELECT md5(t) AS h, min(doc_id) AS d FROM win GROUP BY 1
), gone AS (
    SELECT doc_id, list_distinct(flatten(list(range(s, s + 50)))) AS ks
    FROM win JOIN least ON md5(t) = h AND doc_id > d GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ks, i)), lambda i: ws[i]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
