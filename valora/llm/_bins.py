"""Packed hash bins: many (hash, document, position) entries in few rows.

A mapper packs the entries of some documents (a flush) into one row per bin; a
reducer gets all rows of a bin and answers with one row for each of them, so
answers are put together by flush, which holds its documents whole. Entries cost
their hash and two or four bytes of position; a document costs sixteen bytes in
each bin it has entries in, of which the ids, kept as differences, shrink in the
shuffle. A flush grows with the number of bins, so that rows
stay far fewer than entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valora.llm import _kernel as K

PACKED = "bin long, flush long, ids binary, fps binary, runs binary, pos binary, hash binary"
FOUND = "flush long, ids binary, fps binary, runs binary, pos binary"
#: Bytes of entries that a bin should have; entries of a flush, at least and at most, and for each bin.
BIN_BYTES = 12 << 20
FLUSH, FLUSH_MOST, FLUSH_PER_BIN = 600_000, 3_000_000, 2000


def bins_for(nbytes: int, least: int = 12) -> int:
    return int(min(60_000, max(least, -(-nbytes // BIN_BYTES))))


class Packer:
    """Collects entries and packs them into rows by bin once there are enough. With ``sure``, its entries are
    known to match: each flush is a bin by itself, with a negative number, whose entries all match."""

    def __init__(self, n_bins: int, hash_dtype, sure: bool = False):
        self.n_bins, self.dtype, self.sure = 1 if sure else n_bins, hash_dtype, sure
        self.enough = min(FLUSH_MOST, max(FLUSH, FLUSH_PER_BIN * self.n_bins))
        self.clear()

    def clear(self) -> None:
        self.ids, self.fps, self.docs, self.pos, self.hashes, self.n_docs, self.n = [], [], [], [], [], 0, 0

    def add(self, ids, fps, doc, pos, hashes) -> Iterator[pa.RecordBatch]:
        """doc: index into ids and fps, ascending; hashes: 64 bits, well mixed."""
        self.ids.append(ids)
        self.fps.append(fps)
        self.docs.append(doc + self.n_docs)
        self.pos.append(pos)
        self.hashes.append(hashes)
        self.n_docs += len(ids)
        self.n += len(hashes)
        if self.n >= self.enough:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            ids, fps = np.concatenate(self.ids), np.concatenate(self.fps).astype(np.int32)
            doc, pos, h = np.concatenate(self.docs), np.concatenate(self.pos), np.concatenate(self.hashes)
            where = ((h >> np.uint64(40)) % np.uint64(self.n_bins)).astype(np.uint16)
            order = np.argsort(where, kind="stable")
            bounds = np.searchsorted(where[order], np.arange(self.n_bins + 1))
            doc, pos, h = doc[order].astype(np.int64), pos[order], h[order].astype(self.dtype)
            kind = np.uint16 if int(pos.max()) < 1 << 16 else np.uint32
            # flushes that share a name share documents' answers too, which does no harm
            name = int(K.mix((ids.astype(np.uint64) * np.uint64(3) + fps.astype(np.uint64)).sum(keepdims=True))[0].astype(np.int64))
            rows: list[list] = [[], [], [], [], [], []]
            for b in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[b], bounds[b + 1])
                d = doc[part]
                at = np.flatnonzero(np.diff(d, prepend=-1))
                of = d[at]
                runs = np.diff(np.append(at, len(d))).astype(np.uint32)
                for col, x in zip(rows, (-1 - (name & (1 << 62) - 1) if self.sure else int(b), np.diff(ids[of], prepend=0).tobytes(), fps[of].tobytes(), runs.tobytes(), pos[part].astype(kind).tobytes(), h[part].tobytes()), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(np.full(len(rows[0]), name)), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["bin", "flush", "ids", "fps", "runs", "pos", "hash"]
            )
        self.clear()


@dataclass
class Entries:
    """The entries of a bin; those of document k (ids, and 32 bits of a hash that tell rows of one id
    apart) have doc == k. Row r of the bin came from
    the flush ``flush[r]`` and has the documents first[r]:first[r + 1]."""

    flush: np.ndarray
    first: np.ndarray

    ids: np.ndarray
    fps: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    hash: np.ndarray


def unpack(table: pa.Table, hash_dtype) -> Entries:
    cols = [table.column(c).to_pylist() for c in ("ids", "fps", "runs", "pos", "hash")]
    runs = [np.frombuffer(x, np.uint32) for x in cols[2]]
    pos = []
    for r, x in zip(runs, cols[3], strict=True):
        pos.append(np.frombuffer(x, np.uint16 if len(x) == 2 * int(r.sum()) else np.uint32).astype(np.uint32))
    every = np.concatenate(runs)
    join = lambda parts, kind: np.concatenate([np.frombuffer(x, kind) for x in parts])
    ids = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in cols[0]])
    first = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    return Entries(table.column("flush").to_numpy(), first, ids, join(cols[1], np.int32), np.repeat(np.arange(len(every), dtype=np.int32), every), np.concatenate(pos), join(cols[4], hash_dtype))


def named(e: Entries, keep: np.ndarray) -> pa.Table:
    """The kept entries' positions by document: a row of FOUND for each flush that has any."""
    doc, pos = e.doc[keep], e.pos[keep]
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order]
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    of, runs = doc[at], np.diff(np.append(at, len(doc))).astype(np.uint32)
    docs, places = np.searchsorted(of, e.first), np.searchsorted(doc, e.first)
    rows = np.flatnonzero(np.diff(docs))
    cut = lambda values, edges: pa.array([values[edges[r] : edges[r + 1]].tobytes() for r in rows], pa.binary())
    return pa.table({"flush": pa.array(e.flush[rows]), "ids": cut(e.ids[of], docs), "fps": cut(e.fps[of], docs), "runs": cut(runs, docs), "pos": cut(pos, places)})


def matched(packed: DataFrame, hash_dtype, decide: Callable[[Entries], np.ndarray]) -> DataFrame:
    """decide: which entries of a bin match."""

    def run(table: pa.Table) -> pa.Table:
        e = unpack(table, hash_dtype)
        return named(e, np.arange(len(e.doc)) if table.column("bin")[0].as_py() < 0 else decide(e))

    return packed.groupBy("bin").applyInArrow(run, FOUND)


def spans(found: DataFrame, before: int, after: int) -> DataFrame:
    """By document the union of [pos - before, pos + after): id, fp, lo and hi as packed int32."""

    def run(table: pa.Table) -> pa.Table:
        ids, fps, runs, pos = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("fps", np.int32), ("runs", np.uint32), ("pos", np.uint32)))
        order = np.lexsort((fps, ids))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(ids[order]) != 0) | (np.diff(fps[order]) != 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        key = np.sort((np.repeat(group, runs) << 32) | pos.astype(np.int64))
        cut = np.ones(len(key), bool)
        cut[1:] = key[1:] - before > key[:-1] + after  # another document is always far away
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(key)) - 1
        a = np.maximum((key[first] & 0xFFFFFFFF) - before, 0).astype(np.int32)
        z = ((key[last] & 0xFFFFFFFF) + after).astype(np.int32)
        at = np.searchsorted(key[first] >> 32, np.arange(group.max() + 2))
        one = order[new]
        packed = lambda values: pa.array([values[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())
        return pa.table({"id": pa.array(ids[one]), "fp": pa.array(fps[one]), "lo": packed(a), "hi": packed(z)})

    by_flush = found.groupBy("flush").applyInArrow(run, "id long, fp int, lo binary, hi binary")
    # a document has several rows here only if its row is repeated, or if a lost task was run again over rows
    # in another order; their spans add up
    parts = by_flush.groupBy("id", "fp").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    nothing = F.lit(b"")
    lo, hi = F.aggregate("parts", nothing, lambda a, x: F.concat(a, x["lo"])), F.aggregate("parts", nothing, lambda a, x: F.concat(a, x["hi"]))
    return parts.select("id", "fp", lo.alias("lo"), hi.alias("hi"))
