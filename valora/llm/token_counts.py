"""Token counts of whole texts, as the tokenizer's own library gives them.

Texts are cut at safe boundaries, pieces met before are looked up, and the
others are encoded in batches balanced by bytes. Only lengths leave Python.

A boundary is safe where no token can lie across it. For a sentencepiece model
with the identity normaliser that is before a run of blanks: the blank mark
never follows another character inside a piece, which is tested on the model's
own vocabulary. Each unit starts with its blanks, of which the first one is the
prefix that the library adds by itself. Models for which this doesn't hold, and
tokenizers files, are encoded text by text. A worker keeps short units only, and
a bounded number of characters of them: a text without blanks is one unit, which
is encoded and forgotten.

Null and empty texts have no tokens. Rows come out as they went in, repeated
ones too; other columns of the input are kept by ``count_tokens`` only if named.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valora.llm import _kernel as K, _spark as S

#: Characters of units that a worker keeps before its table starts anew; longest unit kept; bytes of one batch to encode.
CACHE_CHARS, CACHE_UNIT, BATCH_BYTES = 4 << 20, 48, 1 << 18
_UNIT = re.compile(" +[^ ]*")
_MARK = "▁"


class Counter:
    """Token counts of texts by one tokenizer file, .model or .json."""

    def __init__(self, path: str):
        self.by_unit = False
        if path.endswith(".model"):
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            spec = sentencepiece_model_pb2.ModelProto()
            spec.ParseFromString(self.model.serialized_model_proto())
            n, pieces = spec.normalizer_spec, [p.piece for p in spec.pieces]
            self.by_unit = (
                n.name == "identity" and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces
                and not spec.trainer_spec.treat_whitespace_as_suffix and not any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
                and not any(p.type == p.USER_DEFINED for p in spec.pieces)
            )
            self.encode: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in self.model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            self.encode = lambda texts: [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]
        self.seen: dict[str, int] = {}
        self.kept = 0

    def batches(self, texts: list[str]) -> Iterator[list[str]]:
        """Texts sorted by length, in batches of about BATCH_BYTES bytes of UTF-8."""
        batch, total = [], 0
        for size, text in sorted((len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")), t) for t in texts):
            if batch and total + size > BATCH_BYTES:
                yield batch
                batch, total = [], 0
            batch.append(text)
            total += size + 16
        if batch:
            yield batch

    def units(self, text: str) -> list[str]:
        return _UNIT.findall(" " + text.replace(_MARK, " ")) if text else []

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            found = {t: n for batch in self.batches([*{*texts} - {""}]) for t, n in zip(batch, self.encode(batch), strict=True)}
            return [found.get(t, 0) for t in texts]
        split = [self.units(t) for t in texts]
        if self.kept > CACHE_CHARS:
            self.seen.clear()
            self.kept = 0
        once: dict[str, int] = {}  # long units are not worth keeping
        new = {u for units in split for u in units if u not in self.seen}
        for batch in self.batches([*new]):
            for unit, n in zip(batch, self.encode([u[1:] for u in batch]), strict=True):
                if unit == " ":  # a blank alone is the prefix of an empty rest, which the library doesn't see
                    n = 1
                if len(unit) <= CACHE_UNIT:
                    self.seen[unit] = n
                    self.kept += len(unit) + 16
                else:
                    once[unit] = n
        seen = self.seen
        return [sum([seen[u] if u in seen else once[u] for u in units]) for units in split]


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """The worker's counter for a file: its units outlive a task, as the worker does."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_bytes (UTF-8) and n_tokens of every row. ``path`` is readable on every executor. Names of kept
    columns may have dots; one that is called n_bytes or n_tokens raises ValueError, as the result has these."""
    taken = {"n_bytes", "n_tokens"} & {k.lower() for k in keep}
    if taken:
        raise ValueError(f"the result's own columns can't be kept: {', '.join(sorted(taken))}")
    S.small_batches(docs.sparkSession)
    plain = [f"c{k}" for k in range(len(keep))]  # Arrow functions don't take names with dots
    kept = docs.select(*[F.col(f"`{k}`").alias(c) for k, c in zip(keep, plain, strict=True)], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        counter = counter_of(path)
        for rows, data, offs in K.blocks(batches, "__text"):
            texts = [K.as_text(data[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(i) for i in range(len(keep))], pa.array(np.diff(offs)), pa.array(counter.counts(texts), pa.int64())],
                names=[*plain, "n_bytes", "n_tokens"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, n_bytes long, n_tokens long").toDF(*keep, "n_bytes", "n_tokens")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > 4096)
