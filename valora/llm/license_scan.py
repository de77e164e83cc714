"""License scan by diagonal voting, with DataFrame functions only.

Words are runs of letters, digits and characters over U+007F, lower-cased (A-Z).
All rolling pairs of words (k-grams of the length of the shortest phrase) of all
texts are joined by hash with the pairs of the templates. A hit votes for the
diagonal (word in the text minus word in the template) on which a whole copy of
the template would lie. Votes are sets of template positions, kept as bits, so
copies of a text vote once and repeated rows change nothing. Diagonals of one
template that lie within GAP words of each other are merged into a span: words
left out or put in move a copy to a neighbouring diagonal. A span may be long, as
a text may repeat some of the template's words for pages; so within it every
stretch of diagonals is verified that a copy of STRETCH times the template's
length, and GAP words more, can lie on, and the best one counts: by the share of
the template's words that lie in pairs found there.

PHRASES must occur whole, on one diagonal; their places are counted. NOTICES give
labels of their own where the share is at least COVERED. score is the largest
share of any template in the text, 1 for a phrase, 0 below NOISE: single pairs of
common words are no sign of a licence.

Null texts are empty: no words, no labels (empty strings), score 0. Every input
row gives one row. Results depend on the text alone; texts are told apart by two
64-bit hashes. Templates have 2 to 64 words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window as W, functions as F

from valora.llm import _spark as S

# Phrases and labels asked for, and the opening words of public license notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
}
GAP, COVERED, NOISE, STRETCH = 3, 0.8, 0.5, 1.5
_SCALE = 1 << 24

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(c):
    return F.translate(c, _UPPER, _LOWER)


def _pairs(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """The templates' word pairs: a table whose size the templates bound."""
    rows = []
    for nth, (text, label) in enumerate([*phrases.items(), *notices.items()]):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        if not 2 <= len(words) <= 64:
            raise ValueError("a template has 2 to 64 words")
        rows += [(nth, label, nth < len(phrases), len(words), at, a, b) for at, (a, b) in enumerate(zip(words[:-1], words[1:], strict=True))]
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, size int, at int, t1 string, t2 string")


def found_spans(texts: DataFrame, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """texts: __f1, __f2 (hashes), __text. Each span's best stretch: template, label, phrase, place (word at which
    the template would begin on the stretch's first diagonal), share, and whether all of its pairs are there."""
    pairs = _pairs(texts.sparkSession, phrases, notices).withColumn("hash", F.xxhash64("t1", "t2"))
    words = texts.select("__f1", "__f2", F.split("__text", _SEPARATORS, -1).alias("w"))
    zipped = words.select("__f1", "__f2", (F.element_at("w", 1) == "").cast("int").alias("skip"), F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))).alias("pos", "pair"))
    rolling = zipped.select("__f1", "__f2", (F.col("pos") - F.col("skip")).alias("pos"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))
    hits = rolling.join(F.broadcast(pairs), F.xxhash64(F.lower("a"), F.lower("b")) == F.col("hash"))
    hits = hits.where((_lowered(F.col("a")) == F.col("t1")) & (_lowered(F.col("b")) == F.col("t2")))
    votes = hits.groupBy("__f1", "__f2", "template", "label", "phrase", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("bits")
    )
    along = W.partitionBy("__f1", "__f2", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > GAP) | F.col("phrase"), F.lit(True))
    merged = votes.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    # a stretch holds the diagonals up to drift after its first one; frames have a fixed length, so diagonals are
    # scaled: those of a template lie _SCALE / drift apart
    drift = F.floor(F.col("size") * (STRETCH - 1)) + GAP
    scaled = F.col("diagonal") * F.floor(F.lit(_SCALE) / drift)
    stretch = W.partitionBy("__f1", "__f2", "template", "span").orderBy("scaled").rangeBetween(0, _SCALE)
    spans = merged.withColumn("scaled", scaled).withColumn("bits", F.when(F.col("phrase"), F.col("bits")).otherwise(F.bit_or("bits").over(stretch)))
    covered = F.bit_count(F.col("bits").bitwiseOR(F.call_function("shiftleft", F.col("bits"), F.lit(1)))) / F.col("size")
    spans = spans.withColumns({"share": F.least(covered, F.lit(1.0)), "whole": F.bit_count("bits") == F.col("size") - 1})
    best = spans.groupBy("__f1", "__f2", "template", "label", "phrase", "size", "span").agg(F.max(F.struct(F.col("share"), (-F.col("diagonal")).alias("before"), F.col("whole"))).alias("best"))
    return best.select("__f1", "__f2", "template", "label", "phrase", (-F.col("best.before")).alias("place"), F.col("best.share").alias("share"), F.col("best.whole").alias("whole"))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row for each of docs' rows (doc_id and text are read): doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", F.xxhash64(F.lit(41), text).alias("__f1"), F.xxhash64(F.lit(42), text).alias("__f2"), text.alias("__text"))
    spans = found_spans(hashed.select("__f1", "__f2", "__text"), phrases, notices)
    base = F.col("phrase") & F.col("whole")
    spans = spans.where(base | (~F.col("phrase") & (F.col("share") >= NOISE)))
    listed = lambda when: F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")
    by_text = spans.groupBy("__f1", "__f2").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("place").cast("long"))).alias("first_word"), F.max(F.when(base, F.col("place").cast("long"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(base | (~F.col("phrase") & (F.col("share") >= COVERED))).alias("labels"),
        F.max(F.when(base, 1.0).when(F.col("phrase"), 0.0).otherwise(F.col("share"))).alias("score"),
    )
    # texts that have hits, written down: so that a text which a third of the rows share doesn't deal the join
    by_text = S.cut(by_text)
    _, nbytes = S.measured(by_text, F.octet_length("labels") + F.octet_length("base_labels") + 80)
    rows = hashed.select("doc_id", "__f1", "__f2", F.regexp_count("__text", F.lit(_WORD)).cast("long").alias("n_words"))
    joined = S.attach(rows, by_text, ["__f1", "__f2"], nbytes)
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def license_base(spark, sf_dir: str) -> DataFrame:
    """What the contract fixes of the scan: words, places and labels of the phrases; SQL has them too."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


BASE_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), p AS (
    SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
        list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl FROM d
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base, least(list_min(mit), list_min(apache), list_min(gpl)) - 1 AS first_word,
    greatest(list_max(mit), list_max(apache), list_max(gpl)) - 1 AS last_word,
    array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p
"""


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
