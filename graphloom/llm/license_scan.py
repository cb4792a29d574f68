"""License scans by MinHash bands over overlapping text windows, with built-in functions only.

Texts and templates become hashes of five-word shingles. Templates are put into classes by their number of shingles; a
class of size C is looked for in windows of 2C shingles that start every C, so whatever a template of the class covers
lies whole inside one window. Every window and template has one minimum per hash function, each of which is a band of one
row; a template is retrieved where any band agrees, and exact shingle containment verifies it, for each row of texts by
itself. As many bands are used as bring the chance to retrieve a template, of which 0.8 lies in a window, to 0.999 at
least. A window that holds fewer shingles of templates than 0.8 of the smallest one of its class cannot contain any; only
the others have minima made.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import maybe_among, stored

SHINGLE, CONTAINMENT, CERTAINTY = 5, 0.8, 0.999
#: Shingles of all templates up to which their tables are broadcast; beyond, they are joined like any others.
BROADCAST_SHINGLES = 1_000_000
#: Where a system keeps the full texts of common licences, if it does.
FULL_TEXTS = "/usr/share/common-licenses"

# Notices as licences themselves prescribe or commonly have them.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT/notice": "Released under the MIT License",
    "MIT/short": "Licensed under the MIT License",
    "MIT/grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0/notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0",
    "CC/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


@dataclass(frozen=True)
class SizeClass:
    """Templates of `least` shingles or more, over half of `size` and up to `size`; windows of twice `size` start every `size`."""

    size: int
    least: int
    bands: int


def bands_for(share: float, certainty: float = CERTAINTY) -> int:
    """One-row bands that make a collision at a Jaccard similarity of `share` as likely as `certainty`."""
    return 1 if share >= 1 else math.ceil(math.log(1 - certainty) / math.log(1 - share))


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of `width` words, in order; fewer words give one hash of all of them, none gives none.

    `words` should be a column and no expression, which would be worked out again for each run.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda k: F.xxhash64(*(F.get(words, k - 1 + j) for j in range(width))))
    short = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(F.size(words) >= width, runs).when(F.size(words) > 0, short).otherwise(F.expr("cast(array() as array<bigint>)"))


def full_texts(folder: str = FULL_TEXTS) -> dict[str, str]:
    """The texts of the files in a folder by their names; none where there is no such folder."""
    path = Path(folder)
    return {f"{x.name}/full": x.read_text(errors="replace") for x in sorted(path.iterdir()) if x.is_file() and not x.is_symlink()} if path.is_dir() else {}


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(template, wanted): names and distinct shingles of templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string").select("template", words_of(F.col("body")).alias("w"))
    return rows.select("template", F.array_distinct(shingles(F.col("w"))).alias("wanted"))


def classes_of(sizes: list[int], containment: float = CONTAINMENT) -> list[SizeClass]:
    """The classes of templates of these numbers of shingles, with bands enough for the smallest one of each."""
    least: dict[int, int] = {}
    for n in sizes:
        size = 1 << (n - 1).bit_length()
        least[size] = min(n, least.get(size, n))
    return [SizeClass(size, n, bands_for(containment * n / (2 * size + (1 - containment) * n))) for size, n in sorted(least.items())]


def _band(hashes: Column, band: Column) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, band))


def _by_class(classes: list[SizeClass], size: Column, value: str) -> Column:
    out = F.lit(None).cast("int")
    for c in classes:
        out = F.when(size == c.size, getattr(c, value)).otherwise(out)
    return out


def windows_with_hits(rows: DataFrame, hashes: DataFrame, classes: list[SizeClass], containment: float) -> DataFrame:
    """(th, size, k): windows of texts (th, w), by their number, that hold enough template shingles for a class's smallest template.

    hashes: the distinct shingles (h) of all templates.
    """
    every = rows.select("th", shingles(F.col("w")).alias("hs")).select("th", F.size("hs").alias("n"), F.posexplode_outer("hs").alias("pos", "h"))
    hits = every.join(hashes, "h")
    both = F.array(*(F.struct(F.lit(c.size).alias("size"), (F.floor(F.col("pos") / c.size) - back).cast("int").alias("k")) for c in classes for back in (0, 1)))
    windows = hits.select("th", "n", "h", F.explode(both).alias("w")).select("th", "h", "w.size", "w.k", "n")
    windows = windows.where("k >= 0 and k < greatest(ceil(n / size) - 1, 1)").select("th", "size", "k", "h").distinct()
    return windows.groupBy("th", "size", "k").agg(F.count("*").alias("c")).where(F.col("c") >= containment * _by_class(classes, F.col("size"), "least") - 1e-9).select("th", "size", "k")


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id_col, template, n_windows, containment, first_word): the templates found in each text.

    `templates` are texts by name, or a table (template, wanted) of distinct shingle hashes; the notices above if None.
    Every row is verified by itself. containment is the largest share of a template's shingles in one window, n_windows the
    number of windows that reach the limit, first_word the place of the first such window. Rows that share an id, or have
    none, are then counted together: the sum of their windows, the largest share, the first place; so the order of rows
    does not matter. Null and empty texts hold no template; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    known = templates if isinstance(templates, DataFrame) else template_table(spark, TEMPLATES if templates is None else templates)
    # a filter before the table is stored would be worked out with all that is below it, anew for each shingle
    known = stored(known.select("template", "wanted", F.size("wanted").alias("n")), "license-templates").where("n > 0")
    sizes = known.groupBy("n").count().collect()  # at most one row for each length of a template
    classes = classes_of([r.n for r in sizes], containment)
    if not classes:
        return docs.where("false").select(F.col(id_col), F.lit("").alias("template"), F.lit(0).cast("long").alias("n_windows"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"))
    few = sum(r.n * r["count"] for r in sizes) <= BROADCAST_SHINGLES
    small = F.broadcast if few else lambda x: x

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    hashes = small(known.select(F.explode("wanted").alias("h")).distinct())
    windows = stored(windows_with_hits(rows.select("th", words_of(F.col("text")).alias("w")), hashes, classes, containment), "license-windows")
    some = maybe_among(rows, "th", windows.select(F.col("th").alias("id")).distinct()).where("_maybe").select("id", "th", words_of(F.col("text")).alias("w"))
    some = stored(some.select(F.monotonically_increasing_id().alias("row"), "id", "th", shingles(F.col("w")).alias("h")), "license-candidates")

    part = F.slice(F.col("h"), F.col("k") * F.col("size") + 1, 2 * F.col("size"))
    parts = some.join(windows, "th").select("row", "id", "size", "k", part.alias("part"))
    lows = F.transform(F.sequence(F.lit(0), _by_class(classes, F.col("size"), "bands") - 1), lambda b: F.array_min(_band(F.col("part"), b)))
    # outer: else Spark asks first, with all expressions worked out twice, whether there is anything to explode
    spread = parts.select("row", "size", "k", F.posexplode_outer(lows).alias("band", "low"))
    size = F.lit(None).cast("int")
    for c in reversed(classes):
        size = F.when(F.col("n") <= c.size, c.size).otherwise(size)
    wanted = known.select("template", "wanted", size.alias("size")).select("template", "size", "wanted", F.explode(F.sequence(F.lit(0), _by_class(classes, F.col("size"), "bands") - 1)).alias("band"))
    wanted = wanted.select("template", "size", "band", F.array_min(_band(F.col("wanted"), F.col("band"))).alias("low"))
    found = spread.join(small(wanted), ["size", "band", "low"]).select("row", "size", "k", "template").distinct()

    share = F.size(F.array_intersect("part", "wanted")) / F.size("wanted")
    sure = parts.join(found, ["row", "size", "k"]).join(small(known.select("template", "wanted")), "template").select("id", (F.col("k") * F.col("size")).alias("at"), "template", share.alias("share"))
    sure = sure.where(F.col("share") >= containment)
    return sure.groupBy("id", "template").agg(F.count("*").alias("n_windows"), F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word")).withColumnRenamed("id", id_col)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """(doc_id, template, n_windows, containment, first_word) over every whole document, by notices and full texts."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), TEMPLATES | full_texts())
