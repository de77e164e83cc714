"""Files: write-once snapshots, manifests, pointers, freezes, exports and ledgers.

All paths go through Spark or Hadoop's file systems, so they may be on any store
that the cluster reads. Nothing is overwritten: a new run is a new folder, and a
pointer names the one in use.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from valora.operators.integrity import table_fingerprint


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def write_json(spark: SparkSession, path: str, value: dict, replace: bool = False) -> None:
    fs, place = _fs(spark, path)
    out = fs.create(place, replace)
    out.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_snapshot(df: DataFrame, path: str, **meta: str) -> dict:
    """Writes df once, beside the final place and then moved there, with a manifest. Fails if the place is taken."""
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.part"
    df.write.mode("overwrite").parquet(f"{part}/data")
    manifest = manifest_of(spark.read.parquet(f"{part}/data"), **meta)
    write_json(spark, f"{part}/manifest.json", manifest)
    fs, place = _fs(spark, path)
    fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part), place)
    return manifest


def manifest_of(df: DataFrame, **meta: str) -> dict:
    row = table_fingerprint(df, df.columns).first()
    return {"rows": row["n"], "fingerprint": row["fingerprint"], "columns": df.columns, **meta}


def checked(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot's table; raises if it is not what its manifest says."""
    df, said = spark.read.parquet(f"{path}/data"), read_json(spark, f"{path}/manifest.json")
    if manifest_of(df)["fingerprint"] != said["fingerprint"]:
        raise ValueError(f"{path} is not what its manifest says")
    return df


def switch_pointer(spark: SparkSession, pointer: str, run: str) -> None:
    write_json(spark, pointer, {"run": run}, replace=True)


def resolve_pointer(spark: SparkSession, pointer: str) -> tuple[str, str]:
    """The run in use and a digest of the pointer, read once at the start of a job."""
    text = spark.read.text(pointer, wholetext=True).first()[0]
    return json.loads(text)["run"], hashlib.sha256(text.encode()).hexdigest()


def scan(spark: SparkSession, root: str, pointer: str, table: str, schema: str) -> tuple[DataFrame, str]:
    """A table of the run that the pointer names, and that run: read once, so that a job stays with its run when the
    pointer moves. The files must have the schema's columns and types; what else they have is not read."""
    run, _ = resolve_pointer(spark, pointer)
    path = f"{root.rstrip('/')}/{run}/{table}"
    want = spark.createDataFrame([], schema).schema
    have = {f.name: f.dataType for f in spark.read.parquet(path).schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{path} breaks its contract in {', '.join(wrong)}")
    return spark.read.schema(want).parquet(path), run


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, path: str, frozen: DataFrame) -> DataFrame:
    """Files that are new, gone or different against a freeze; a run must not start if there are any."""
    from valora.operators.joins import diff

    return diff(frozen, file_digests(spark, path), ["path"], ["sha256"])


def load_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV export with an explicit schema; rows that don't fit are kept beside, in __bad."""
    return spark.read.schema(f"{schema}, __bad string").option("header", True).option("columnNameOfCorruptRecord", "__bad").csv(path)


def parse_listing(pages: DataFrame) -> DataFrame:
    """Host, title and number of links of raw pages."""
    return pages.select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit('<a href="')).alias("links"),
    )


def register_source(registry: DataFrame, source_id: str, url: str, basis: str, method: str, repeatable: bool) -> DataFrame:
    """The registry with one more source; an id that is there already is refused."""
    spark = registry.sparkSession
    if registry.where(F.col("source_id") == source_id).limit(1).count():
        raise ValueError(f"source {source_id} is registered")
    return registry.unionByName(spark.createDataFrame([(source_id, url, basis, method, repeatable)], "source_id string, url string, basis string, method string, repeatable boolean"))


def append_records(df: DataFrame, path: str) -> None:
    """Adds rows to an append-only store; what is there stays as it is."""
    df.write.mode("append").parquet(path)


def read_requests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Requests from JSON lines with an explicit schema: one, a batch, or a saved file replayed."""
    return spark.read.schema(schema).json(path)


def load_frozen(spark: SparkSession, path: str, schema: str, sha256: str) -> DataFrame:
    """A frozen CSV of judgements as a build input; raises if the file is not the one that was frozen."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if digest != sha256:
        raise ValueError(f"{path} has the digest {digest}")
    return spark.read.schema(schema).option("header", True).csv(path)


def write_shard(df: DataFrame, folder: str, shard: str) -> None:
    """One shard's rows, and after them its entry in the ledger: a shard without an entry counts as not done."""
    df.write.mode("overwrite").parquet(f"{folder}/shards/{shard}")
    write_json(df.sparkSession, f"{folder}/ledger/{shard}.json", {"shard": shard}, replace=True)


def finished_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("shard string").json(f"{folder}/ledger")


def report(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    """A Markdown report of small result tables, from the tables alone; a longer table is an error, not cut."""
    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} has more than {limit} rows: aggregate it first")
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("UNKNOWN" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(out) + "\n"
