"""Licences of files: TF-IDF cosine of their lines to templates, then inheritance from directories. DataFrame functions only.

* Terms are lower-cased letter-and-digit words. Document frequencies of the templates' words are counted over all texts; every
  template word has the smoothed weight ln((N + 1) / (df + 1)) + 1, words outside the templates weigh as the heaviest of them.
  Products and norms use the same weights, so a verbatim notice has cosine 1 whatever else the corpus holds.
* Every line of every text is a candidate header. Lines whose template words cannot reach the threshold, by a bound of the
  cosine, are passed over inside the scan. Templates are a small table given by the caller; its size is checked.
* A file whose matched line covers at least ``FILE_SHARE`` of its words, or whose name says so, is a licence file and
  speaks for its directory. Files without a licence of their own take that of the nearest directory above
  them. The distinct directories, far fewer than the files, are joined with their ancestors first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelore.llm.common import stored

COSINE, FILE_SHARE = 0.6, 0.5
MAX_TEMPLATE_WORDS = 20_000
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"

#: Usual notices of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def _weights(files: DataFrame, notices: DataFrame) -> dict[str, float]:
    """Positive weight of each template word by its document frequency over all texts."""
    vocabulary = sorted({w for r in notices.select(F.explode(_words(F.col("text")))).collect() for w in r})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError("too many template words")
    if not vocabulary:
        return {}
    known = F.array(*map(F.lit, vocabulary))
    counts = files.select(F.explode(F.array_intersect(_words(F.col("text")), known)).alias("w")).groupBy("w").count().collect()
    total = files.count()
    found = {r["w"]: r["count"] for r in counts}
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}


def own_licenses(files: DataFrame, notices: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Columns of ``files`` but text, with license, cosine, line (0-based) and share (words of that line of all words) of the best line.

    Of equal cosines the earliest line, then the alphabetically first licence is taken; below ``cosine`` all four are NULL.
    """
    weights = _weights(files, notices)
    none = {
        "license": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double"),
        "line": F.lit(None).cast("int"), "share": F.lit(None).cast("double"),
    }
    if not weights:
        return files.drop("text").withColumns(none)
    top = max(weights.values())
    names = F.array(*map(F.lit, weights))
    weigh = F.map_from_arrays(names, F.array(*[F.lit(v) for v in weights.values()]))

    vectors: dict[str, list[dict[str, float]]] = {}
    for row in notices.select("license", _words(F.col("text")).alias("w")).collect():
        vector = {w: weights[w] * row["w"].count(w) for w in set(row["w"]) if w in weights}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        if norm:
            vectors.setdefault(row["license"], []).append({w: v / norm for w, v in sorted(vector.items())})
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("license"),
                F.map_from_arrays(F.array(*map(F.lit, v)), F.array(*[F.lit(x) for x in v.values()])).alias("v"),
            )
            for name in sorted(vectors)
            for v in vectors[name]
        ]
    )

    def weighed(known: Column, words: Column) -> Column:
        """The template words of a line with their weights times their numbers."""
        times = F.filter(words, lambda y: F.array_contains(known, y))
        return F.transform(
            known, lambda t: F.struct(t.alias("t"), (F.size(F.filter(times, lambda y: y == t)) * F.try_element_at(weigh, t)).alias("x"))
        )

    def square(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda s, k: s + k["x"] * k["x"])

    def others(x: Column) -> Column:
        return F.filter(x["w"], lambda y: ~F.array_contains(x["known"], y))

    def reaches(x: Column) -> Column:
        """No line at or above the threshold fails: its other words have the least length when all are equally frequent."""
        least = F.pow(F.size(others(x)) * F.lit(top), F.lit(2.0)) / F.greatest(F.size(F.array_distinct(others(x))), F.lit(1))
        return square(x["k"]) * F.lit(1 - cosine * cosine + 1e-9) >= F.lit(cosine * cosine * (1 - 1e-9)) * least

    def rest(words: Column) -> Column:
        """Sum of the squared numbers of the words, from one pass over them in order: a run of n adds 1 + 3 + ... + (2n - 1)."""
        start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("odd"), F.lit(0.0).alias("sum"))

        def step(s: Column, w: Column) -> Column:
            odd = F.when(s["word"] == w, s["odd"] + 2.0).otherwise(F.lit(1.0))
            return F.struct(w.alias("word"), odd.alias("odd"), (s["sum"] + odd).alias("sum"))

        return F.aggregate(F.array_sort(words), start, step, lambda s: s["sum"])

    def product(k: Column, v: Column) -> Column:
        return F.aggregate(k, F.lit(0.0), lambda s, y: s + y["x"] * F.coalesce(F.try_element_at(v, y["t"]), F.lit(0.0)))

    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), _words(x).alias("w")))
    known = F.transform(
        F.filter(lines, lambda x: F.arrays_overlap(x["w"], names)),
        lambda x: F.struct(x["line"].alias("line"), x["w"].alias("w"), F.array_intersect(x["w"], names).alias("known")),
    )
    telling = F.filter(
        F.transform(
            known, lambda x: F.struct(x["line"].alias("line"), x["w"].alias("w"), x["known"].alias("known"), weighed(x["known"], x["w"]).alias("k"))
        ),
        reaches,
    )
    # texts whose lines stay below the threshold never leave this scan; the words of a text are counted only where one is found
    total = F.greatest(F.size(_words(F.col("text"))), F.lit(1))
    candidates = files.select("path", "text", telling.alias("x")).filter(F.size("x") > 0).select("path", total.alias("total"), "x")

    def nearest(x: Column) -> Column:
        norm = F.sqrt(square(x["k"]) + F.lit(top * top) * rest(others(x)))
        each = F.transform(
            table, lambda t: F.struct((-F.round(product(x["k"], t["v"]) / norm, 9)).alias("c"), t["license"].alias("license"))
        )
        near = F.array_min(each)
        return F.struct(
            near["c"].alias("c"), x["line"].alias("line"), near["license"].alias("license"), (F.size(x["w"]) / F.col("total")).alias("share")
        )

    best = (
        candidates.select("path", F.array_min(F.transform("x", nearest)).alias("b"))
        .filter(F.col("b.c") <= -cosine)
        .groupBy("path")
        .agg(F.min("b").alias("b"))
        .select("path", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"), "b.line", "b.share")
    )
    return files.drop("text", *none).join(stored(best), "path", "left")


def scan(files: DataFrame, notices: DataFrame, cosine: float = COSINE) -> DataFrame:
    """path, license, cosine, origin ('own', 'inherited' or 'none') and origin_path for every path of ``files``.

    ``files`` has path and text. NULL texts are empty, NULL paths are left out, and rows that repeat a path count as one
    file with all their lines. Of several licence files in a directory the one with the highest cosine, then
    the smallest path, speaks for it. Empty tables of files or templates give no licence. Other columns are not
    read.
    """
    parent = F.regexp_replace("path", "/[^/]*$", "")
    plain = files.filter("path is not null").select("path", F.coalesce("text", F.lit("")).alias("text"))
    own = stored(own_licenses(plain, notices, cosine).select("path", "license", "cosine", "share").dropDuplicates(["path"]))
    own = own.withColumn("dir", F.when(F.contains("path", F.lit("/")), parent).otherwise(""))
    name = F.substring_index("path", "/", -1)
    speaking = own.filter(F.col("license").isNotNull() & ((F.col("share") >= FILE_SHARE) | name.rlike(FILE_NAME)))
    speakers = speaking.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "license")).alias("s")).select(
        F.col("dir").alias("above"), F.col("s.path").alias("s_path"), F.col("s.license").alias("s_license"), (-F.col("s.c")).alias("s_cosine")
    )
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    nearest = (
        own.select("dir").distinct()
        .select("dir", F.explode(F.array_distinct(above)).alias("above"))
        .join(speakers, "above")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "s_path", "s_license", "s_cosine")).alias("n"))
        .select("dir", "n.*")
    )
    joined = own.join(nearest, "dir", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "path",
        F.coalesce("license", "s_license").alias("license"),
        F.coalesce("cosine", "s_cosine").alias("cosine"),
        F.when(has, "own").when(F.col("s_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("s_path")).alias("origin_path"),
    )
