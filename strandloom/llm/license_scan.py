"""License scan: MinHash bands retrieve templates, shingle containment verifies them; DataFrame functions only.

Texts and templates are cut into words (lower case, letters and digits) and shingles of ``SHINGLE`` words. Windows of
``WINDOW`` shingles, which overlap by half, get one minimum per hash function; each function is a band of one row. A run
of three shingles, the least that a template has, lies wholly in some window, so the window's similarity with the
template's window is 3/4 or more and one of ``BANDS`` bands collides with probability ``1 - (1/4) ** BANDS`` or more
(99.98 %). Templates have windows at every offset, so an unbroken run of four template shingles at an even place always
collides. A template that shares a band value is verified by exact containment: the share of its shingles that the text
has must reach ``CONTAINED``.

All work on a text happens in its own row, without shuffle, so no source or group of copies is hot; templates and their
band values are literals of the plan, bounded by ``MAX_TEMPLATE_WORDS`` words in all.

Defined cases: null and empty texts have no license; texts shorter than a shingle have none; equal rows give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

SHINGLE = 3
WINDOW = 4
STRIDE = 2
BANDS = 6
CONTAINED = 0.8
MAX_TEMPLATE_WORDS = 20_000

# Notices of public licenses by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{Nd}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hashes of the runs of SHINGLE words; empty for shorter texts."""
    n = F.size(words) - SHINGLE + 1
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def permuted(hashes: Column, band: int) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))


def minima(values: str, starts: str) -> Column:
    """The least value of each window. Both are columns, not expressions, or each window would evaluate them again.

    get() is null beyond the end, and least() skips nulls.
    """
    return F.transform(F.col(starts), lambda i: F.least(*[F.get(F.col(values), i + j) for j in range(WINDOW)]))


def windows(hashes: Column, stride: int) -> Column:
    """Starts of windows that together cover all shingles."""
    n = F.size(hashes)
    last = F.greatest(n - WINDOW, F.lit(0)) + (stride - 1)
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _template_table(spark: SparkSession, templates) -> list[tuple[str, str, list[int], list[int]]]:
    """(name, text, shingles, band values) per template."""
    if sum(len(t.split()) for _, t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates are too many for one plan")
    df = spark.createDataFrame(list(templates), "name string, text string")
    sh = df.withColumn("w", tokens(F.col("text"))).withColumn("s", F.array_distinct(shingles(F.col("w"))))
    rows = sh.select("name", "text", "s", windows(F.col("s"), 1).alias("at"), *[permuted(F.col("s"), b).alias(f"p{b}") for b in range(BANDS)])
    bands = F.concat(*[minima(f"p{b}", "at") for b in range(BANDS)])
    return [tuple(r) for r in rows.select("name", "text", "s", bands.alias("v")).collect()]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, license, template, n_shared, n_shingles`` for every template that a text contains."""
    table = _template_table(docs.sparkSession, templates)
    longs = "array<bigint>"
    values = F.array_distinct(F.flatten(F.array(*[F.array(*map(F.lit, v)).cast(longs) for _, _, _, v in table])))
    listed = F.array(
        *[
            F.struct(
                F.lit(n).alias("license"), F.lit(t).alias("template"),
                F.array(*map(F.lit, s)).cast(longs).alias("s"), F.array(*map(F.lit, v)).cast(longs).alias("v"),
            )
            for n, t, s, v in table
        ]
    )
    hashed = docs.select("doc_id", tokens(text_or_empty()).alias("_w")).select("doc_id", shingles(F.col("_w")).alias("_s"))
    found = hashed.select(
        "doc_id", "_s", windows(F.col("_s"), STRIDE).alias("_at"), *[permuted(F.col("_s"), b).alias(f"_p{b}") for b in range(BANDS)]
    )
    bands = F.concat(*[F.array_intersect(minima(f"_p{b}", "_at"), values) for b in range(BANDS)])
    met = found.select("doc_id", "_s", bands.alias("_m"))
    # explode() and filters on _m would be pushed to the scan with all that they are made of; those on its output are not.
    candidates = F.explode_outer(F.filter(listed, lambda t: F.arrays_overlap(t["v"], F.col("_m"))))
    retrieved = met.select("doc_id", "_s", candidates.alias("t")).where("t is not null")
    shared = F.size(F.array_intersect("t.s", "_s"))
    checked = retrieved.select("doc_id", "t.license", "t.template", shared.cast("bigint").alias("n_shared"), F.size("t.s").cast("bigint").alias("n_shingles"))
    return checked.where(F.col("n_shared") >= F.col("n_shingles") * CONTAINED)
