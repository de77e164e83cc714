"""Media columns kept as content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has BITS leading
zeros, between LEAST and MOST bytes. Chunk digests are grouped and joined by
Spark: a chunk that several payloads have is stored once, by the smallest
(doc_id, position), and a payload that is wholly a copy stores nothing. The
store keeps, for each payload, the ordered chunk list and the bytes it owns.
Reading back joins the bytes owned elsewhere, puts chunks in order, compares
every chunk with its digest, and only then computes features.

``documents`` are stored as 8-bit samples: UTF-8, filled with bytes 255 to a
positive multiple of FRAME. Null texts are empty and give one frame. Ids are
integers (see id_of); a null id comes last. Other columns are not read. Repeated rows are copies. Payloads are told apart by two 64-bit
hashes and their length.

The stored form of a payload, which media_bytes and media_sha256 describe, is
its chunk list (length and SHA-256 of each, in order) followed by its chunks; it
depends on the payload only, not on who owns the bytes.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valora.llm import _kernel as K, _spark as S

FRAME, FILL = 576, 255
BITS, LEAST, MOST = 9, 128, 4096
#: Bytes of a digest by which equal chunks are looked for; what is read back is compared with the whole digest.
NAME = 16
#: Bytes to assemble in one group.
GROUP_BYTES = 16 << 20
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_MEDIA = "id long, fp long, fp2 long, n_bytes long, copy boolean, lens binary, digests binary, foreign array<int>, given array<int>, own binary"


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hashes of the 32 bytes that end at each byte, by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        new = h.copy()
        new[step:] += h[:-step] << np.uint32(step)
        h = new
    return h


def cuts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Chunk ends of each payload, relative to its start. A window never leaves its chunk, as LEAST > 32."""
    places = np.flatnonzero(gear(data) >> np.uint32(32 - BITS) == 0) + 1
    at = np.searchsorted(places, offs)
    out = []
    for k in range(len(offs) - 1):
        begin, end = int(offs[k]), int(offs[k + 1])
        ends, last = [], begin
        for p in places[at[k] : at[k + 1]].tolist():
            while p - last > MOST:
                last += MOST
                ends.append(last)
            if p - last >= LEAST:
                ends.append(p)
                last = p
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if last < end or not ends:
            ends.append(end)
        out.append(np.array(ends) - begin)
    return out


def payloads(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's texts, each filled up to whole frames."""
    sizes = np.diff(offs)
    full = np.maximum(FRAME, -(-sizes // FRAME) * FRAME)
    at = np.concatenate([[0], np.cumsum(full)])
    out = np.full(at[-1], FILL, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] - offs[:-1], sizes)] = data
    return out, at


def _chunked(data: np.ndarray, offs: np.ndarray):
    """For each payload of a block its bytes, chunk lengths and digests."""
    data, offs = payloads(data, offs)
    for ends, a, b in zip(cuts(data, offs), offs[:-1], offs[1:], strict=True):
        raw = memoryview(data[a:b])
        edges = [0, *ends.tolist()]
        yield raw, edges, [hashlib.sha256(raw[x:y]).digest() for x, y in zip(edges[:-1], edges[1:], strict=True)]


def _digests(batches):
    for rows, data, offs in K.blocks(batches, "__text"):
        ids, fps, fp2s = (rows.column(k).to_numpy() for k in range(3))
        of, ords, digests = [], [], []
        for k, (_, _, found) in enumerate(_chunked(data, offs)):
            of += [k] * len(found)
            ords += range(len(found))
            digests += [d[:NAME] for d in found]
        of = np.array(of, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids[of]), pa.array(fps[of]), pa.array(fp2s[of]), pa.array(ords, pa.int32())], names=["digest", "id", "fp", "fp2", "ord"])


def _stored(batches):
    for rows, data, offs in K.blocks(batches, "__text"):
        copy, foreign = rows.column("copy").to_pylist(), rows.column("foreign").to_pylist()
        lens, digests, own = [], [], []
        for k, (raw, edges, found) in enumerate(_chunked(data, offs)):
            if copy[k]:
                lens.append(None), digests.append(None), own.append(None)
                continue
            away = {*(foreign[k] or ())}
            lens.append(np.diff(edges).astype(np.int32).tobytes())
            digests.append(b"".join(found))
            own.append(b"".join(raw[x:y] for j, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j not in away))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns[:3], pa.array(np.diff(offs)), rows.column("copy"), *[pa.array(x, pa.binary()) for x in (lens, digests)], rows.column("foreign"), rows.column("given"), pa.array(own, pa.binary())],
            names=["id", "fp", "fp2", "n_bytes", "copy", "lens", "digests", "foreign", "given", "own"],
        )


def store_media(docs: DataFrame) -> DataFrame:
    """The media store of docs' texts (doc_id and text are read): a row for each input row."""
    S.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        S.id_of(docs).alias("id"), F.xxhash64(F.lit(21), text).alias("fp"), F.xxhash64(F.lit(22), text).alias("fp2"), text.alias("__text")
    )
    chunks = S.cut(keyed.mapInArrow(_digests, "digest binary, id long, fp long, fp2 long, ord int"))
    heads = chunks.where("ord = 0")
    several = S.cut(heads.groupBy("fp", "fp2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    n_several, _ = S.measured(several, F.lit(0))
    copies = S.cut(S.attach(heads.select("id", "fp", "fp2"), several, ["fp", "fp2"], 72 * n_several, "inner").where("id > least").select("id", "fp", "fp2").distinct())
    n_copies, _ = S.measured(copies, F.lit(0))
    whole = S.attach(chunks, copies.select("id", "fp", "fp2"), ["id", "fp", "fp2"], 48 * n_copies, "left_anti")
    shared = S.cut(whole.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "fp", "fp2", "ord")).alias("owner")).where("n > 1").drop("n"))
    n_shared, _ = S.measured(shared, F.lit(0))
    parts = S.attach(whole, shared, ["digest"], 160 * n_shared, "inner")
    owns = (F.col("id") == F.col("owner.id")) & (F.col("fp") == F.col("owner.fp")) & (F.col("fp2") == F.col("owner.fp2")) & (F.col("ord") == F.col("owner.ord"))
    lists = parts.withColumn("owns", owns).groupBy("id", "fp", "fp2").agg(F.collect_set(F.when(~F.col("owns"), F.col("ord"))).alias("foreign"), F.collect_set(F.when(F.col("owns"), F.col("ord"))).alias("given"))
    lists = lists.select("id", "fp", "fp2", F.lit(False).alias("copy"), "foreign", "given")
    none = F.lit(None).cast("array<int>")
    facts = S.cut(lists.unionByName(copies.select("id", "fp", "fp2", F.lit(True).alias("copy"), none.alias("foreign"), none.alias("given"))))
    _, nbytes = S.measured(facts, F.lit(64) + 4 * (F.greatest(F.size("foreign"), F.lit(0)) + F.greatest(F.size("given"), F.lit(0))))
    full = S.attach(keyed, facts, ["id", "fp", "fp2"], nbytes).select("id", "fp", "fp2", F.coalesce("copy", F.lit(False)).alias("copy"), "foreign", "given", "__text")
    return S.cut(full.mapInArrow(_stored, _MEDIA))


def _split(lens: bytes, digests: bytes) -> tuple[list[int], list[bytes]]:
    sizes = np.frombuffer(lens, np.int32).tolist()
    return sizes, [digests[32 * k : 32 * k + 32] for k in range(len(sizes))]


def _own(sizes: list[int], foreign, own: bytes) -> dict[int, bytes]:
    away, at, out = {*(foreign or ())}, 0, {}
    for k, size in enumerate(sizes):
        if k not in away:
            out[k] = own[at : at + size]
            at += size
    return out


def described(payload: bytes, sizes: list[int], digests: list[bytes]) -> tuple:
    """What a payload read back is known by; raises where a chunk isn't what its digest says."""
    at = 0
    for size, digest in zip(sizes, digests, strict=True):
        if hashlib.sha256(memoryview(payload)[at : at + size]).digest() != digest:
            raise ValueError("a stored chunk does not match its digest")
        at += size
    form = b"".join(size.to_bytes(4, "big") + digest for size, digest in zip(sizes, digests, strict=True))
    media = hashlib.sha256(form)
    media.update(payload)
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    mean = float(counts @ np.arange(256)) / len(samples)
    p = counts[counts > 0] / len(samples)
    feature = json.dumps({"chunks": len(sizes), "mean": round(mean, 4), "std": round(float(np.sqrt(max(0.0, counts @ np.arange(256) ** 2 / len(samples) - mean * mean))), 4), "entropy": round(float(-(p * np.log2(p)).sum()), 4), "bands": counts.reshape(8, 32).sum(1).tolist()})
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form) + len(payload), media.hexdigest(), feature


_FEATURES = "fp long, fp2 long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _featured(fps: list, found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([f for f, _ in fps], pa.int64()), pa.array([f for _, f in fps], pa.int64()), *[pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]],
        names=["fp", "fp2", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    )


def _complete(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            fps = list(zip(part.column("fp").to_pylist(), part.column("fp2").to_pylist(), strict=True))
            found = []
            for lens, digests, own in zip(*[part.column(c) for c in ("lens", "digests", "own")], strict=True):
                found.append(described(own.as_py(), *_split(lens.as_py(), digests.as_py())))
            yield _featured(fps, found)


def _given(batches):
    """Chunks that other payloads need: digest and bytes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part, digests, raw = batch.slice(lo, 512), [], []
            for row in part.to_pylist():
                sizes, names = _split(row["lens"], row["digests"])
                own = _own(sizes, row["foreign"], row["own"])
                for k in row["given"]:
                    digests.append(names[k])
                    raw.append(own[k])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["digest", "raw"])


def _needed(batches):
    """The chunk lists' entries that are stored elsewhere."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row in batch.to_pylist():
            _, names = _split(row["lens"], row["digests"])
            for k in row["foreign"]:
                for col, x in zip(out, (names[k], row["id"], row["fp"], row["fp2"], k), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["digest", "id", "fp", "fp2", "ord"])


def _assembled(table: pa.Table) -> pa.Table:
    lists, parts = {}, {}
    for row in table.to_pylist():
        key = row["id"], row["fp"], row["fp2"]
        if row["ord"] < 0:
            lists[key] = row
        else:
            parts.setdefault(key, {})[row["ord"]] = row["raw"]
    found = []
    for key, row in lists.items():
        sizes, digests = _split(row["lens"], row["digests"])
        chunks = _own(sizes, row["foreign"], row["raw"]) | parts[key]
        found.append(described(b"".join(chunks[k] for k in range(len(sizes))), sizes, digests))
    return pa.Table.from_batches([_featured([k[1:] for k in lists], found)])


def read_media(media: DataFrame) -> DataFrame:
    """id, n_bytes and what each payload of a store is known by once read back."""
    kept = media.where("not copy")
    partial = F.size(F.coalesce("foreign", F.array().cast("array<int>"))) > 0
    whole = kept.where(~partial).select("fp", "fp2", "lens", "digests", "own").mapInArrow(_complete, _FEATURES)
    lists = kept.where(partial).select("id", "fp", "fp2", "lens", "digests", "foreign", "own")
    given = kept.where(F.size("given") > 0).select("lens", "digests", "foreign", "given", "own").mapInArrow(_given, "digest binary, raw binary")
    given = S.cut(given.groupBy(F.col("digest").alias("d")).agg(F.first("raw").alias("raw")))  # repeated rows own the same
    needed = lists.select("id", "fp", "fp2", "lens", "digests", "foreign").distinct().mapInArrow(_needed, "digest binary, id long, fp long, fp2 long, ord int")
    parts = needed.join(given, F.col("digest") == F.col("d")).select("id", "fp", "fp2", "ord", "raw")
    nothing, none = F.lit(None).cast("binary"), F.lit(None).cast("array<int>")
    parts = parts.select("*", nothing.alias("lens"), nothing.alias("digests"), none.alias("foreign"))
    lists = lists.select("id", "fp", "fp2", F.lit(-1).alias("ord"), F.col("own").alias("raw"), "lens", "digests", "foreign")
    size = kept.where(partial).agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    groups = max(12, -(-size // GROUP_BYTES))
    joined = lists.unionByName(parts).withColumn("part", F.pmod(F.xxhash64("id", "fp", "fp2"), F.lit(groups))).groupBy("part").applyInArrow(_assembled, _FEATURES)
    # as many features as texts: both sides are dealt by text, and written first so that a hot text can be split
    found = whole.unionByName(joined)
    again = kept.groupBy("id", "fp", "fp2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    features = S.cut(found.dropDuplicates(["fp", "fp2"]) if again else found).withColumnsRenamed({"fp": "f", "fp2": "f2"})  # rows repeated as they are
    rows = media.select("id", "fp", "fp2", "n_bytes").join(features, (F.col("fp") == F.col("f")) & (F.col("fp2") == F.col("f2")))
    return rows.drop("fp", "fp2", "f", "f2")


def op10_media_chunks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = read_media(store_media(docs))
    return done.select(F.when(F.col("id") != S.NULL_ID, F.col("id")).alias("doc_id"), *[c for c in done.columns if c != "id"])
