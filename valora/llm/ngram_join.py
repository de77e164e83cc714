"""N-gram Jaccard join: all documents whose sets of word n-grams are alike.

MinHash banding. Texts are lower-cased (A-Z) and split at blanks; the set of a
text has the hashes of its N consecutive words, or of all its words if it has
fewer. Rows and bands of the signature are chosen for the target recall at the
threshold. Documents with equal sets count as copies of one node. Nodes shuffle
on their band hashes, and pairs of nodes that share a band are verified on their
full sets; pairs that share none are not candidates, however they are dealt.

Where the buckets of a node's component (the nodes that shared bands lead to)
hold few nodes, which is the rule, the component is verified in one piece and
each set is sent once. A larger component, such as templated texts grow to, is
verified bucket by bucket: a set is sent once for each band in which it has
company, so what is sent grows with the nodes and not with the square of the
component, and a pair counts in the first band it shares only. A bucket of more
nodes than a block holds is dealt out as pairs of blocks, so a group that holds a
third of the rows is no single task. Both ways find the same links. A unit returns
only a node's number of links and its class so far, so rows grow with the nodes.

The result has one row per document: its class (the smallest doc_id that links
lead to) and how many other documents are linked to it directly, copies counted.

Null or empty texts have no n-gram: they form a class of their own, with no
links. Ids are integers (see id_of); null ids come after all others; a class of
null ids only has a null id. Repeated rows are copies. Sets are compared by 64-bit
hashes. Other columns of the input may have any names; first_of_each keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valora.llm import _kernel as K, _spark as S
from valora.llm._components import components

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 128
#: Nodes and n-grams of a block; n-grams of a bundle of small groups.
BLOCK_NODES, BLOCK_GRAMS = 2048, 1_500_000
_LAST = (1 << 63) - 1


def banding(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest wrong candidates) for which enough bands to find a pair
    at the threshold with the wanted probability fit into ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def grams(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of a block's texts, and where each text's begin."""
    w = K.words(data, offs)
    h = K.word_hashes(data, w, K.LOWER)
    counts = w.counts
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint64)
    idx, where = K.starts(w.at, n)
    doc = np.repeat(np.arange(len(counts)), np.diff(where))
    out[at[doc] + idx - w.at[doc]] = K.windows(h, n)[idx]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            out[at[short]] = K.mix(K.windows(h, m)[w.at[short]] + np.uint64(m))
    return out, at


def distinct(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's n-grams sorted, once each."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(g)
    order = order[np.argsort(doc[order].astype(np.uint32 if len(at) > 1 << 16 else np.uint16), kind="stable")]
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(at)))


def _signatures(bands: int, rows: int):
    rng = np.random.default_rng(5)
    xors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    mults = rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for block, data, offs in K.blocks(batches, "__text"):
            g, at = distinct(*grams(data, offs))
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            n = len(sizes)
            fp = K.mix(K.segment_sums(K.mix(g ^ np.uint64(0x1234567)), at))
            sig = np.empty((bands, len(full)), np.uint64)
            if len(full):
                for b in range(bands):
                    total = np.full(len(full), b + 1, np.uint64)
                    for r in range(b * rows, b * rows + rows):
                        total = K.mix(total + np.minimum.reduceat((g ^ xors[r]) * mults[r], at[full]))
                    sig[b] = total
            offsets = np.zeros(n + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig.T.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(fp.view(np.int64)), pa.array(sizes), lists],
                names=["id", "th", "fp", "n_grams", "bands"],
            )

    return run


def _sets(batches):
    for block, data, offs in K.blocks(batches, "__text"):
        g, at = distinct(*grams(data, offs))
        raw = [g[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*block.columns[:-1], pa.array(raw, pa.binary())], names=[*block.schema.names[:-1], "grams"])


def candidates(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Which rows of a and b (nodes by bands) share a band; with ``band`` >= 0, which share it and none before it."""
    shared = np.zeros((len(a), len(b)), bool)
    for k in range(a.shape[1] if band < 0 else band):
        shared |= a[:, k][:, None] == b[:, k][None, :]
    return shared if band < 0 else ~shared & (a[:, band][:, None] == b[:, band][None, :])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted arrays, len(a) by len(b)."""
    out = np.zeros((len(a), len(b)), np.float32)
    owner_a, owner_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    _, ids = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ids_a, ids_b = ids[: len(owner_a)], ids[len(owner_a) :]
    n = int(ids.max()) + 1
    freq_a, freq_b = np.bincount(ids_a, minlength=n), np.bincount(ids_b, minlength=n)
    both = freq_a * freq_b
    dense = np.flatnonzero(both > 64)
    rank = np.full(n, -1)
    rank[dense] = np.arange(len(dense))
    for lo in range(0, len(dense), 4096):  # n-grams that many share: products of 0/1 matrices
        hi = min(len(dense), lo + 4096)
        left, right = np.zeros((len(a), hi - lo), np.float32), np.zeros((len(b), hi - lo), np.float32)
        for ids_x, owner, m in ((ids_a, owner_a, left), (ids_b, owner_b, right)):
            r = rank[ids_x]
            at = (r >= lo) & (r < hi)
            m[owner[at], r[at] - lo] = 1
        out += left @ right.T
    rare = (both > 0) & (both <= 64)
    at, bt = np.flatnonzero(rare[ids_a]), np.flatnonzero(rare[ids_b])
    bt = bt[np.argsort(ids_b[bt], kind="stable")]
    begin, end = (np.searchsorted(ids_b[bt], ids_a[at], side) for side in ("left", "right"))
    times = end - begin
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    cell = np.repeat(owner_a[at], times) * len(b) + owner_b[bt][np.repeat(begin, times) + nth]
    out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    return out


def _verify(threshold: float):
    def links(sets_a, sets_b):
        sizes_a, sizes_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
        inter = overlaps(sets_a, sets_b)
        union = sizes_a[:, None] + sizes_b[None, :] - inter
        return inter >= threshold * union - 1e-6

    def unit(nodes, copies, sets, bands, left, band, out):
        """left: which of the nodes are on the left side; all where the unit is a block with itself."""
        if left.all():
            a = b = np.arange(len(nodes))
        else:
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(a) or not len(b):
            return
        linked = candidates(bands[a], bands[b], band)
        if a is b:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))  # sets that are in a candidate pair
        linked[np.ix_(rows, cols)] &= links([sets[i] for i in a[rows]], [sets[i] for i in b[cols]])
        count = np.zeros(len(nodes), np.int64)
        count[a] += linked @ copies[b]
        if a is not b:
            count[b] += copies[a] @ linked
        label = nodes.copy()
        while True:  # smallest node within reach
            low_b = np.where(linked, label[a][:, None], _LAST).min(0)
            new = label.copy()
            new[b] = np.minimum(new[b], low_b)
            new[a] = np.minimum(new[a], np.where(linked, new[b][None, :], _LAST).min(1))
            if (new == label).all():
                break
            label = new
        at = count > 0
        out.append((nodes[at], label[at], count[at]))

    def run(key, table):
        first, out = key[1].as_py(), []
        group, node, copies, block, band = (table.column(c).to_numpy() for c in ("group", "node", "copies", "block", "band"))
        raw, shared = table.column("grams"), table.column("bands").combine_chunks()
        bands = shared.flatten().to_numpy().reshape(len(node), -1)
        order = np.lexsort((node, group, band))
        one = np.ones(len(order), bool)
        one[1:] = (np.diff(group[order]) != 0) | (np.diff(node[order]) != 0) | (np.diff(band[order]) != 0)
        order = order[one]  # repeated rows of one document
        at = np.flatnonzero(np.concatenate([[True], (np.diff(group[order]) != 0) | (np.diff(band[order]) != 0)]))
        for lo, hi in zip(at, np.append(at[1:], len(order)), strict=True):
            part = order[lo:hi]
            if len(part) > 1:
                unit(node[part], copies[part], [np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in part], bands[part], block[part] == first, int(band[part[0]]), out)
        cols = [np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.table(cols, names=["node", "label", "links"])

    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each of docs' rows (doc_id and text are read): doc_id, class_id, n_links, and
    n_grams, the size of the set; __id and __th name the row (the id with null last, a hash of the text), __stays is true
    for the first (__id, __th) of each class."""
    S.small_batches(docs.sparkSession)
    bands, rows = banding(threshold, recall)
    keyed = docs.select(S.id_of(docs).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("__text"))
    sig = S.cut(keyed.mapInArrow(_signatures(bands, rows), "id long, th long, fp long, n_grams long, bands array<long>"))
    nodes = S.cut(
        sig.where("n_grams > 0").groupBy(F.col("fp").alias("node"))
        .agg(F.min(F.struct("id", "th")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_grams").alias("n_grams"), F.any_value("bands").alias("bands"))
    )
    member = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = member.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select(F.col("bucket").alias("at"), "hub")
    ties = member.join(hubs, F.col("bucket") == F.col("at")).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(ties).withColumnRenamed("label", "comp")
    groups = S.cut(nodes.join(groups, "node").select("node", "rep", "copies", "n_grams", "bands", "comp"))
    # where a component fits into one block it is one group; elsewhere each bucket of two nodes or more is one
    blocks = lambda g, n: F.greatest(F.ceil(g / BLOCK_NODES), F.ceil(n / BLOCK_GRAMS))
    size = [F.count(F.lit(1)).alias("g"), F.sum("n_grams").alias("grams")]
    # written first: a component that a third of the nodes share does not deal the join
    comps = S.cut(groups.groupBy("comp").agg(*size).select("comp", blocks(F.col("g"), F.col("grams")).alias("n_blocks")))
    n_comps, _ = S.measured(comps, F.lit(0))
    placed = S.cut(S.attach(groups, comps, ["comp"], 32 * n_comps, "inner"))
    whole = placed.where("n_blocks = 1").select("node", "copies", "rep", "n_grams", "bands", F.col("comp").alias("group"), F.lit(-1).alias("band"), "n_blocks")
    split = placed.where("n_blocks > 1").select("node", "copies", "rep", "n_grams", "bands", F.posexplode("bands").alias("band", "group"))
    buckets = split.groupBy("band", "group").agg(*size).where("g > 1").select(F.col("band").alias("b"), F.col("group").alias("k"), blocks(F.col("g"), F.col("grams")).alias("n_blocks"))
    split = split.join(buckets, (F.col("band") == F.col("b")) & (F.col("group") == F.col("k"))).select("node", "copies", "rep", "n_grams", "bands", "group", "band", "n_blocks")
    dealt = whole.unionByName(split).select("node", "copies", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), "n_grams", "bands", F.struct("group", "band", "n_blocks", F.pmod(F.xxhash64("node"), "n_blocks").alias("block")).alias("unit"))
    # the documents that stand for the nodes, each once, with their units and sets
    dealt = S.cut(dealt.groupBy("node", "copies", "id", "th", "n_grams", "bands").agg(F.collect_list("unit").alias("units")))  # as many as bands
    _, n_grams = S.measured(dealt, F.col("n_grams") * F.size("units"))
    _, nbytes = S.measured(dealt, F.lit(72 + 8 * bands) + 40 * F.size("units"))
    full = S.attach(keyed, dealt, ["id", "th"], nbytes, "inner").select("node", "copies", "bands", "units", "__text")
    sets = full.mapInArrow(_sets, "node long, copies long, bands array<long>, units array<struct<group: long, band: int, n_blocks: long, block: long>>, grams binary")
    bundles = max(12, -(-n_grams // BLOCK_GRAMS))
    sets = sets.withColumn("unit", F.explode("units")).select("node", "copies", "bands", "grams", "unit.group", "unit.band", "unit.n_blocks", "unit.block")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    single = F.lit(0).cast("long")
    sets = sets.select(
        "node", "copies", "bands", "grams", "group", "band", "block",
        F.when(F.col("n_blocks") > 1, F.xxhash64("group", "band")).otherwise(F.pmod(F.xxhash64("group", "band"), F.lit(bundles))).alias("place"),
        F.when(F.col("n_blocks") > 1, F.least("block", "other")).otherwise(single).alias("first"),
        F.when(F.col("n_blocks") > 1, F.greatest("block", "other")).otherwise(single).alias("second"),
        F.when(F.col("n_blocks") > 1, F.col("n_blocks")).otherwise(single).alias("many"),
    )
    found = S.cut(sets.groupBy("place", "first", "second", "many").applyInArrow(_verify(threshold), "node long, label long, links long"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    known = linked.join(classes, "node").join(nodes.select("node", "rep"), "node")
    least = known.groupBy("label").agg(F.min("rep").alias("first"))
    known = S.cut(known.join(least, "label").select("node", "links", "first"))
    # nodes that are alone, most of them, need no row: their documents are a class each
    several = nodes.join(known, "node", "left").where((F.col("copies") > 1) | F.col("first").isNotNull())
    every = S.cut(several.select(F.col("node").alias("fp"), F.coalesce("first", "rep").alias("__first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    n_every, _ = S.measured(every, F.lit(0))
    rows_out = S.attach(sig.select("id", "th", "fp", "n_grams"), every, ["fp"], 120 * n_every)
    first = F.coalesce("__first.id", "id")
    null_last = lambda c: F.when(c != _LAST, c)
    return rows_out.select(
        null_last(F.col("id")).alias("doc_id"), null_last(first).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_grams",
        F.col("id").alias("__id"), F.col("th").alias("__th"), F.coalesce((F.col("id") == F.col("__first.id")) & (F.col("th") == F.col("__first.th")), F.lit(True)).alias("__stays"),
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without those that are near copies of another one: of each class of jaccard_join
    the document with the smallest id stays, once; documents without an n-gram all stay."""
    joined = S.cut(jaccard_join(docs.select("doc_id", "text")).select("__id", "__th", "__stays", "n_grams"))
    keyed = docs.select(S.id_of(docs).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), S.packed(docs).alias("row"))
    named = [F.col("__id").alias("id"), F.col("__th").alias("th")]
    gone = S.cut(joined.where("not __stays").select(*named).distinct())
    again = S.cut(joined.where("__stays and n_grams > 0").groupBy("__id", "__th").count().where("count > 1").select(*named))
    (n_gone, _), (n_again, _) = S.measured(gone, F.lit(0)), S.measured(again, F.lit(0))
    kept = S.attach(keyed, gone, ["id", "th"], 32 * n_gone, "left_anti")
    if n_again:  # rows repeated as they are
        once = S.attach(kept, again, ["id", "th"], 32 * n_again, "left_semi").dropDuplicates(["id", "th"])
        kept = S.attach(kept, again, ["id", "th"], 32 * n_again, "left_anti").unionByName(once)
    return kept.select(*S.unpacked(F.col("row"), docs))


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).select("doc_id", "class_id", "n_links", "n_grams")
