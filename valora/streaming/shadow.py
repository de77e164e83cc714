"""The shadow store as streams: append, late labels, monthly windows, suspension, cost gate.

Sources are folders of Parquet files. Every stream has its checkpoint; batches
are written under their number, so a batch that runs twice leaves one result.
Labels are never dropped for being late: they wait in a table, not in a
watermark's state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from valora.sources import scratch


def place(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and sinks."""
    return scratch.place(spark, f"stream-{name}")


def arrivals(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a Parquet file or folder, ``files`` files a batch; its schema is the files' own."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def appended(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream to the end of what is there into an append-only Parquet store; returns the store."""
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/data").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")


def batches_once(stream: DataFrame, folder: str, step) -> DataFrame:
    """Each micro-batch through ``step`` into a folder of its own number: running one again replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/data").drop("batch")


def monthly(stream: DataFrame, folder: str, at: str, by: str) -> DataFrame:
    """Counts by branch and calendar month as partial sums of each batch, added up when read; a month is
    mature once an event of a later one has been seen."""
    parts = batches_once(stream, folder, lambda b: b.groupBy(F.col(by).alias("branch"), F.trunc(F.to_date(at), "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last")))
    total = parts.groupBy("branch", "month").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    newest = total.agg(F.max("last").alias("newest"))
    return total.crossJoin(F.broadcast(newest)).select("branch", "month", "n", (F.add_months("month", 1) <= F.to_date("newest")).alias("mature"))  # one row on the right


def pair_labels(labels: DataFrame, predictions: Callable[[], DataFrame], folder: str, keys: list[str], predicted_at: str, labelled_at: str) -> DataFrame:
    """Each arriving label with its prediction, as appended pairs: same keys (id and bundle), predicted before it was
    labelled. ``predictions`` gives the store as it is when a batch runs. A label whose prediction is not there yet waits
    in a table and is tried again with every later batch, and by settle()."""
    schema, at = labels.schema, f"{folder}/checkpoint"

    def step(batch: DataFrame, number: int) -> None:
        _pair(batch, predictions(), folder, f"{number:012}", keys, predicted_at, labelled_at)

    labels.writeStream.foreachBatch(step).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return pairs_of(labels.sparkSession, folder, schema, predictions().schema, keys)


def settle(spark: SparkSession, labels: StructType, predictions: DataFrame, folder: str, keys: list[str], predicted_at: str, labelled_at: str) -> DataFrame:
    """Tries the waiting labels again, for predictions that came without new labels; returns all pairs."""
    last = _steps(spark, folder)
    if last:
        number, _, again = last[-1].partition("-")
        _pair(spark.createDataFrame([], labels), predictions, folder, f"{number}-{int(again or 0) + 1:06}", keys, predicted_at, labelled_at)
    return pairs_of(spark, folder, labels, predictions.schema, keys)


def _steps(spark: SparkSession, folder: str) -> list[str]:
    """Steps that have been finished, in their order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/waiting")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    done = [f.getName() for f in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(name.removeprefix("step=") for name in done)


def _pair(batch: DataFrame, predictions: DataFrame, folder: str, step: str, keys: list[str], predicted_at: str, labelled_at: str) -> None:
    """One step: pairs of the labels waiting so far and the batch's, then the labels that still wait. Its folders bear its
    name, so a step that runs twice leaves one result; it reads the step before it only, not all labels again."""
    spark = batch.sparkSession
    earlier = [s for s in _steps(spark, folder) if s < step]
    every = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/waiting/step={earlier[-1]}")) if earlier else batch
    p = predictions.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.col(predicted_at) < F.col(labelled_at)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    every.join(p, on).drop(*[f"__{k}" for k in keys]).write.mode("overwrite").parquet(f"{folder}/pairs/step={step}")
    every.join(p, on, "left_anti").write.mode("overwrite").parquet(f"{folder}/waiting/step={step}")


def pairs_of(spark: SparkSession, folder: str, labels: StructType, predictions: StructType, keys: list[str]) -> DataFrame:
    """All pairs so far; none before the first step."""
    schema = StructType([*labels.fields, *[f for f in predictions.fields if f.name not in keys]])
    steps = [f"{folder}/pairs/step={s}" for s in _steps(spark, folder)]
    return spark.read.schema(schema).parquet(*steps) if steps else spark.createDataFrame([], schema)


def arrival_checks(stream: DataFrame, folder: str, key: str, value: str, date: str) -> DataFrame:
    """Each arriving batch against all that came before it: census.arrival() by batch. Batches are kept under their
    number, so a batch that runs twice is compared with the same ones and leaves one row."""
    from valora.operators.census import arrival

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = batch.select(key, value, date)
        kept.write.mode("overwrite").parquet(f"{folder}/arrived/batch={number}")
        before = spark.read.schema(kept.schema).parquet(*[f"{folder}/arrived/batch={k}" for k in range(number)]) if number else kept.limit(0)
        checked = arrival(spark.read.schema(kept.schema).parquet(f"{folder}/arrived/batch={number}"), before, key, value, date)
        checked.write.mode("overwrite").parquet(f"{folder}/data/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/data")


def with_suspensions(stream: DataFrame, suspended: DataFrame, branch: str) -> DataFrame:
    """Rows marked by a static table that is read anew for each micro-batch."""
    s = suspended.select(F.col(branch).alias("__s")).distinct().withColumn("suspended", F.lit(True))
    return stream.join(s, F.col(branch) == F.col("__s"), "left").withColumn("suspended", F.coalesce("suspended", F.lit(False))).drop("__s")


def cost_gate(stream: DataFrame, key: str, cost: str, limit: float) -> DataFrame:
    """Running cost of each key as state: by batch and key the total, and whether work may go on."""
    kind = dict(stream.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        n = 0
        for f in frames:
            total += float(f[cost].sum())
            n += len(f)
        state.update((total,))
        yield pd.DataFrame({key: [k[0]], "n": [n], "running": [total], "go_on": [total <= limit]})

    return stream.select(key, cost).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, running double, go_on boolean", "total double", "append", GroupStateTimeout.NoTimeout)
