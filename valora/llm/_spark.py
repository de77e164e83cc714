"""Session helpers: shared checkpoints, unique names, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes up to which the small side of a join may be broadcast.
BROADCAST_BYTES = 48 << 20
#: Bytes of an Arrow batch to a Python worker.
ARROW_BYTES = 8 << 20


def shared(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; one of its own only in local mode without any."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="valora-checkpoint-")
        sc.setCheckpointDir(named)
    return named


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few megabytes: a worker holds one of them, whatever the rows' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared checkpoint folder, without lineage.
    The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared(spark).rstrip('/')}/valora-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def every(df: DataFrame) -> list:
    """df's columns, also those with dots in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


#: Types of ids that the operators on pairs, passages and payloads take.
_INTEGERS = {"tinyint", "smallint", "int", "bigint"}
#: What a null id is called inside; it comes after all others.
NULL_ID = (1 << 63) - 1


def id_of(df: DataFrame, name: str = "doc_id"):
    """The id as long, null as NULL_ID. Ids are compared as numbers, so a column of another type raises TypeError; the
    one id that is NULL_ID itself can't be told from null and raises when it is met."""
    kind = df.schema[name].dataType.simpleString()
    if kind not in _INTEGERS:
        raise TypeError(f"{name} must be an integer column, not {kind}")
    met = F.raise_error(F.lit(f"{name} {NULL_ID} stands for null"))
    found = F.col(name).cast("long")
    return F.when(found.isNull(), F.lit(NULL_ID)).when(found == NULL_ID, met.cast("long")).otherwise(found)


def packed(docs: DataFrame):
    """All of docs' columns as one struct with plain names, so that no name of theirs can clash with an operator's."""
    return F.struct(*[c.alias(f"c{k}") for k, c in enumerate(every(docs))])


def plain(docs: DataFrame) -> tuple[list, str]:
    """docs' columns under the names that packed() gives them, and that of text among them: what an Arrow function takes,
    so that the text is sent once."""
    return [c.alias(f"c{k}") for k, c in enumerate(every(docs))], f"c{docs.columns.index('text')}"


def unpacked(row, docs: DataFrame) -> list:
    """The columns of a struct that packed() made, under their own names."""
    return [row[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)]


def crc_mod(column, n: int) -> F.Column:
    """crc32 of the value as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def measured(df: DataFrame, size) -> tuple[int, int]:
    """Rows and bytes (by the given column) of a checkpointed table."""
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows, int(total)


def attach(docs: DataFrame, info: DataFrame, keys: list[str], nbytes: int, how: str = "left") -> DataFrame:
    """docs joined with facts about some of them. nbytes is the measured size of info: below the
    bound it is broadcast, so that the texts stay where they are; beyond it both sides are shuffled."""
    small = F.broadcast(info) if nbytes <= BROADCAST_BYTES else info
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in info.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return docs.join(right, on, how).drop(*[f"__{k}" for k in keys])
