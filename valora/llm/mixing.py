"""Mixing sources to target token counts by entropy balancing, with DataFrame functions only.

Sizes are words. Sources in the order of their code points (null last) weigh 3,
1, 2 and so on; together they are to give SHARE of all words. A source's target
stops at CAP times its words; what it can't give goes to the others by weight:
target = min(CAP * words, level * weight), with the one level at which the
targets add up.

Rates. Among all document rates r that meet the targets, those closest to one
copy each in relative entropy, with r <= CAP, are r = min(CAP, exp(a * x)), where
x is the document's size over its source's mean size, and a is the source's
multiplier. The multipliers maximise the concave dual; its Newton steps need two
sums per source, which Spark aggregates over the table of distinct (source,
size) pairs; a step that leaves the bracket found so far is halved into it.

Copies. Rates add up along the sizes of a source from large to small, and a
document gets as many copies as whole numbers lie between its neighbours' sums.
So the words taken miss the target by half of the largest document at most.
Equal sizes are dealt by salted cells whose number follows the row count, so no
task holds a whole source or all documents of one size; only rows that repeat
each other in id and text share a cell, in which they are sorted on disk.

Null texts have size 0, are given one copy's rate and take no words. A source
without words has target 0. Repeated rows are documents of their own; equal rows
may get different copies, which ones makes no difference to the result's rows.
Reruns agree: the order is that of doc_id. Empty tables give empty results. A
source whose multiplier isn't found in ROUNDS rounds raises ArithmeticError.
Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from valora.llm import _spark as S

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
#: Newton rounds; the wanted closeness to the target; rows of a cell.
ROUNDS, CLOSE, CELL_ROWS = 40, 1e-6, 50_000
#: Multipliers beyond these give every document the cap, or nothing.
LOW, HIGH, FULL = -200.0, 200.0, 1e12


def ranked(sources: DataFrame) -> DataFrame:
    """sources with nth, their number from 0 by code point, null last. Dealt by ranges, so no task has all sources:
    a source's number is that within its range and the count of the ranges before."""
    order = [F.col("__source").isNull(), F.col("__source")]
    dealt = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = S.cut(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))  # a row for each range
    counts = counts.withColumn("__earlier", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(F.col("__part").alias("__p"), "__first", "__earlier")
    return dealt.join(counts, F.col("__part") == F.col("__p")).withColumn("nth", F.col("__earlier") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__p", "__first", "__earlier")


def targets(sources: DataFrame) -> DataFrame:
    """sources: __source, size. Adds weight and target.

    The level is found from below: if all sources stay below their caps it is what is wanted by weight; sources above
    their caps at that level give up the excess, which raises it for the others, until none is above. Each round is two
    sums over all sources."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))
    weighed = S.cut(ranked(sources).select("__source", "size", weight.alias("weight"), (F.col("size") * CAP).alias("most")))
    want = (weighed.agg(F.sum("size")).first()[0] or 0) * SHARE
    level, n_capped = 0.0, -1
    while True:
        capped = F.col("most") < F.lit(level) * F.col("weight")
        full, weights, n = weighed.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if n == n_capped or not weights:
            break
        level, n_capped = max(level, (want - (full or 0.0)) / weights), n
    reached = F.col("most") if not weights else F.least("most", F.lit(level) * F.col("weight"))
    return weighed.select("__source", "size", "weight", reached.alias("target"))


def _rate(a, x):
    return F.least(F.lit(CAP), F.exp(F.least(a * x, F.lit(math.log(CAP) + 1))))


def balanced(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the multiplier a of each source. sizes: __source, size, n (documents of that size)."""
    mean = sizes.groupBy("__source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = wanted.join(mean.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    full = F.col("target") >= F.col("size") * CAP  # every document at the cap: any multiplier that is large enough
    state = S.cut(state.select("__source", "size", "target", "mean", F.when(full, F.lit(FULL)).otherwise(0.0).alias("a"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"), full.alias("done")))
    table = S.cut(sizes.where("size > 0").select(F.col("__source").alias("__s"), F.col("size").alias("words"), "n"))
    x = F.col("words") / F.col("mean")
    for _ in range(ROUNDS):
        rate = _rate(F.col("a"), x)
        sums = (
            table.join(state.where("not done and size > 0"), F.col("__s").eqNullSafe(F.col("__source"))).groupBy("__s")
            .agg(F.sum(F.col("n") * F.col("words") * rate).alias("got"), F.sum(F.when(rate < CAP, F.col("n") * F.col("words") * x * rate).otherwise(0.0)).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("a")).otherwise(F.col("lo")), F.when(off > 0, F.col("a")).otherwise(F.col("hi"))
        newton = F.col("a") - off / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        wide = (hi - lo) > 20
        half = F.when(wide & (off < 0), F.least((lo + hi) / 2, F.col("a") + 1 + F.abs(F.col("a")))).when(wide, F.greatest((lo + hi) / 2, F.col("a") - 1 - F.abs(F.col("a")))).otherwise((lo + hi) / 2)
        stay = F.col("got").isNull() | (F.abs(off) <= CLOSE * F.greatest(F.col("target"), F.lit(1.0))) | ((hi - lo) < 1e-12)
        state = S.cut(
            state.join(sums, F.col("__source").eqNullSafe(F.col("__s")), "left").select(
                "__source", "size", "target", "mean", F.when(stay, F.col("a")).when(inside, newton).otherwise(half).alias("a"),
                F.when(stay, F.col("lo")).otherwise(lo).alias("lo"), F.when(stay, F.col("hi")).otherwise(hi).alias("hi"), (F.col("done") | stay).alias("done"),
            )
        )
        left = state.where("not done").limit(1).collect()
        if not left:
            return state.select("__source", "size", "target", "mean", "a")
    raise ArithmeticError(f"no multiplier found for source {left[0]['__source']!r} in {ROUNDS} rounds")


def mix(docs: DataFrame) -> DataFrame:
    """One row for each of docs' rows (doc_id, text, source): doc_id, source, size, source_size,
    target, rate, copies, taken."""
    text = F.coalesce("text", F.lit(""))
    slim = S.cut(docs.select("doc_id", F.col("source").alias("__source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("__tie")))
    n_rows, _ = S.measured(slim, F.lit(0))
    n_salts = max(1, -(-n_rows // CELL_ROWS))
    salted = slim.withColumn("__salt", F.pmod(F.xxhash64(F.lit(7), "doc_id", "__tie"), F.lit(n_salts)))
    cells = S.cut(salted.groupBy("__source", "size", "__salt").agg(F.count(F.lit(1)).alias("n")))
    sizes = cells.groupBy("__source", "size").agg(F.sum("n").alias("n"))
    wanted = targets(sizes.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("size")))
    solved = balanced(sizes, wanted).withColumnsRenamed({"__source": "__s", "size": "source_size"})
    rated = sizes.join(solved, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("a"), F.col("size") / F.col("mean"))))
    down = W.partitionBy("__source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    rated = rated.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(down), F.lit(0.0)))
    dealt = cells.select(F.col("__source").alias("__s"), F.col("size").alias("__z"), F.col("__salt").alias("__t"), F.coalesce(F.sum("n").over(W.partitionBy("__source", "size").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    rated = rated.drop("n").join(dealt, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z"))).drop("__s", "__z")
    rated = S.cut(rated.select(F.col("__source").alias("__s"), F.col("size").alias("__z"), "__t", "source_size", "target", "rate", "before", "earlier"))
    nth = F.row_number().over(W.partitionBy("__source", "size", "__salt").orderBy("doc_id", "__tie"))
    ranked = salted.withColumn("nth", nth)
    full = ranked.join(rated, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("__salt") == F.col("__t")))
    place = F.col("before") + F.col("rate") * (F.col("earlier") + F.col("nth"))
    copies = (F.floor(place + 0.5) - F.floor(place - F.col("rate") + 0.5)).cast("long")
    copies = F.least(F.greatest(copies, F.lit(0).cast("long")), F.lit(int(CAP)).cast("long"))
    return full.select("doc_id", F.col("__source").alias("source"), "size", "source_size", "target", "rate", copies.alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """The targets alone, by source, rounded; SQL has them too."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("__source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))
    found = targets(docs.groupBy("__source").agg(F.sum("n").alias("size")))
    return found.select(F.col("__source").alias("source"), "size", "weight", F.round("target", 4).alias("target"))


#: The level of each source if the sources before it, by how soon they reach their caps, are at theirs.
TARGETS_SQL = """
WITH s AS (
    SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY 1
), w AS (
    SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0 * size AS most FROM s
), l AS (
    SELECT *, (1.5 * sum(size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM w WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (
    SELECT max(level) AS level FROM l WHERE level <= most / weight
)
SELECT source, size, CAST(weight AS DOUBLE) AS weight, round(CAST(least(most, coalesce(found.level * weight, most)) AS DOUBLE), 4) AS target FROM l, found
"""


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
