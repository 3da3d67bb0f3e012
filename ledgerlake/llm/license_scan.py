"""License scan: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

Texts and templates are lower-cased, cut into words of letters and digits, and hashed as shingles of five words.
Templates fall into classes by their number of shingles, each up to half as large again as the one below.  For a class whose largest template has m words
a text is cut into windows of 2 m words that start every m words, so every stretch as long as a template of the class lies whole
in one window.  Shingles that no template of the class has are left out first: they add nothing to
the containment of its templates, so nothing is lost, and few windows remain.

What a window holds of its class is signed by MinHash values, one row a band, and so are the templates; an equal value in one band makes a
template a candidate.  A window has at most 2 m - 4 shingles, so one that holds the share c of a template of n shingles has a Jaccard
similarity of at least J = c n / (2 m - 4 + (1 - c) n) with it: 1/6 for templates of one shingle, about 1/4 for others, whatever else is in the text.
Each class has as many bands as its least J needs for (1 - J)^bands <= `miss`, which is 10^-9 for each window.
Candidates are verified by exact counts: the share of the template's distinct shingles that the window has must reach `containment`.

Everything is DataFrame functions.  The template tables have a size that is fixed by the templates, so they are broadcast.
A text with a license that fills the corpus is one row of its own; nothing is grouped by license before counting.

Defined results: null and empty texts, and texts of fewer than five words, hold no license; a document has a row for each
license that it holds and none otherwise; repeated rows of a doc_id are one document; rows without doc_id are left out; an
empty table gives an empty result; very long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-9
GROWTH = 1.5

# Public license notices and passages of public license texts.
TEMPLATES = {
    ("MIT", "notice"): "Released under the MIT License.",
    ("MIT", "licensed"): "This project is licensed under the MIT License.",
    ("MIT", "grant"): "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ("MIT", "warranty"): "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ("Apache-2.0", "notice"): "Licensed under the Apache License, Version 2.0.",
    ("Apache-2.0", "header"): "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ("Apache-2.0", "warranty"): "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ("GPL-3.0", "notice"): "This work is licensed under the GNU General Public License, version 3.",
    ("GPL-3.0", "header"): "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ("GPL-2.0", "header"): "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ("LGPL", "header"): "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ("BSD", "grant"): "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ("BSD-3-Clause", "endorsement"): "may be used to endorse or promote products derived from this software without specific prior written permission",
    ("ISC", "grant"): "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ("MPL-2.0", "header"): "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ("CC-BY-NC-4.0", "notice"): "Licensed under CC BY-NC 4.0.",
    ("CC-BY-4.0", "notice"): "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ("CC-BY-SA-4.0", "notice"): "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ("CC0-1.0", "dedication"): "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ("Unlicense", "dedication"): "This is free and unencumbered software released into the public domain.",
}


def _shingled(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """key columns, at (place of the first word) and shingle (64-bit hash) for each run of WORDS words."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    hashed = df.select(*key, F.transform(words, lambda w: F.xxhash64(w)).alias("w")).filter(F.size("w") >= WORDS)
    places = F.sequence(F.lit(0), F.size("w") - WORDS)
    runs = F.transform(places, lambda k: F.xxhash64(*[F.get(F.col("w"), k + j) for j in range(WORDS)]))
    return hashed.select(*key, F.posexplode(runs).alias("at", "shingle"))


def _signature(shingles, bands):
    """The least hash of a set of shingles in each band."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))))


def templates(spark: SparkSession, texts: dict[tuple[str, str], str] | None = None, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """license, part, n (shingles), class, m (words of the class's largest template), bands, shingles."""
    texts = TEMPLATES if texts is None else texts
    table = spark.createDataFrame([(lic, part, t) for (lic, part), t in sorted(texts.items())], "license string, part string, text string")
    own = _shingled(table, "text", ["license", "part"]).groupBy("license", "part").agg(F.collect_set("shingle").alias("shingles")).withColumn("n", F.size("shingles"))
    size = F.ceil(F.log(F.col("n").cast("double")) / F.log(F.lit(GROWTH)) - 1e-9).cast("int")
    own = own.withColumn("class", size).withColumn("m", (F.ceil(F.pow(F.lit(GROWTH), "class") - 1e-9) + WORDS - 1).cast("int"))
    least = F.when(F.col("class") == 0, 1).otherwise(F.floor(F.pow(F.lit(GROWTH), F.col("class") - 1) + 1e-9) + 1)
    alike = containment * least / (2 * F.col("m") - WORDS + 1 + (1 - containment) * least)
    return own.withColumn("bands", F.greatest(F.lit(1), F.ceil(F.log(F.lit(miss)) / F.log(1 - alike))).cast("int"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, texts: dict[tuple[str, str], str] | None = None, miss: float = MISS) -> DataFrame:
    """doc_id, license, part, windows (that hold it), containment (the greatest), first_word (the template's first in those windows)."""
    known = templates(docs.sparkSession, texts, containment, miss)
    of_class = known.select("class", "m", "bands", F.explode("shingles").alias("shingle")).distinct()
    signed = known.select("class", "license", "part", "n", "shingles", F.posexplode(_signature(F.col("shingles"), F.col("bands"))).alias("band", "least"))
    thin = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    near = _shingled(thin, "text", ["doc_id"]).join(F.broadcast(of_class), "shingle")
    # a shingle at word k lies in the windows that start at m * (k div m) and one before
    first = F.floor(F.col("at") / F.col("m"))
    placed = near.select("doc_id", "class", "bands", "at", "shingle", F.explode(F.array_distinct(F.array(first, F.greatest(first - 1, F.lit(0))))).alias("window"))
    held = placed.groupBy("doc_id", "class", "bands", "window", "shingle").agg(F.min("at").alias("at"))
    held = held.groupBy("doc_id", "class", "bands", "window").agg(F.collect_list(F.struct("shingle", "at")).alias("held"))  # at most the shingles of one window
    bands = held.select("doc_id", "class", "window", "held", F.posexplode(_signature(F.col("held.shingle"), F.col("bands"))).alias("band", "least"))
    found = bands.join(F.broadcast(signed), ["class", "band", "least"])
    found = found.groupBy("doc_id", "class", "window", "license", "part").agg(F.first("held").alias("held"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    both = F.filter("held", lambda x: F.array_contains("shingles", x["shingle"]))
    verified = found.withColumn("both", both).withColumn("share", F.size("both") / F.col("n")).filter(F.col("share") >= containment)
    verified = verified.select("doc_id", "license", "part", "share", F.array_min(F.transform("both", lambda x: x["at"])).alias("first_word"))
    return verified.groupBy("doc_id", "license", "part").agg(F.count(F.lit(1)).alias("windows"), F.max("share").alias("containment"), F.min("first_word").cast("long").alias("first_word"))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """doc_id, license, parts (how many templates of it were found), containment (the greatest)."""
    return scan(docs, id_col, text_col, **kw).groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("parts"), F.max("containment").alias("containment"))
