"""License scans, in DataFrame functions only: MinHash bands over text windows, then exact shingle containment.

Words are lower-cased runs of letters and digits (dots and hyphens inside stay); shingles are three words. Templates
of c / 2 to c shingles, c a power of two, are looked for in windows of 2 c shingles that start every c, so that any
stretch of c shingles lies whole in some window. A template whose share ``least`` is in a window then has a Jaccard
similarity of a fifth or more with it, and each of the ``bands`` one-row bands collides with that probability: with 32
bands the chance to miss it is about 0.1 % for templates of just over c / 2 shingles, and up to 1.4 % for a template of
a single shingle in a window of eight. Candidates are confirmed by the exact number of shared shingles.

A band can collide only if the window holds a shingle that is some template's minimum. Texts, and then windows,
without one are put aside before bands are computed; this loses no collision.

The templates are broadcast; there may be ``MOST`` at most. Null and empty texts match nothing. Rows that share an id
are reported as one. A very long text has as many windows as it needs. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifline.llm.common import Scratch

MOST = 1000
WORD = r"([a-z0-9]+(?:[.-][a-z0-9]+)*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Notices by which works name their licences.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("mit", "Released under the MIT License."),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def shingle_texts(text: Column) -> Column:
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(1))
    rest = lambda k: F.slice(words, k, F.greatest(F.size(words), F.lit(1)))
    three = F.slice(F.arrays_zip(words.alias("a"), rest(2).alias("b"), rest(3).alias("c")), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.coalesce(F.transform(three, lambda x: F.xxhash64(x["a"], x["b"], x["c"])), F.array().cast("array<bigint>"))


def _minima(shingles: Column, bands: int) -> Column:
    def least(k: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k))))

    return F.array(*map(least, range(bands)))


def templates(spark: SparkSession, texts=TEMPLATES, bands: int = 32) -> DataFrame:
    """(license, own: distinct shingles, half: the class's c, band, value)."""
    if len(texts) > MOST:
        raise ValueError(f"at most {MOST} templates")
    out = spark.createDataFrame([(n, t) for n, t in texts], "license string, text string")
    out = out.select("license", F.array_distinct(shingle_texts(F.col("text"))).alias("own")).where(F.size("own") > 0)
    half = F.greatest(F.lit(4), F.pow(F.lit(2), F.ceil(F.log2(F.size("own")))).cast("int"))
    return out.withColumn("half", half).select("license", "own", "half", F.posexplode(_minima(F.col("own"), bands)).alias("band", "value"))


def scan(spark: SparkSession, docs: DataFrame, texts=TEMPLATES, least: float = 0.8, bands: int = 32) -> DataFrame:
    """docs (doc_id, text) to (doc_id, license, n_shared, n_template, n_windows): the best window's shared shingles and how many windows match."""
    known = templates(spark, texts, bands)
    rows = known.select("license", "own", "half").distinct().collect()  # MOST at most
    halves = sorted({r["half"] for r in rows})
    every = sorted({h for r in rows for h in r["own"]})
    marks = F.array(*[F.lit(h) for h in every])  # holds every template's minima
    found = docs.select(F.col("doc_id").alias("doc_id"), shingle_texts(F.col("text").cast("string")).alias("_h")).where(F.arrays_overlap("_h", marks))
    found = Scratch(spark, "licenses").put(found, "found")  # else the optimizer would compute the shingles anew inside the lambdas
    size = F.size("_h")

    def starts(c: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(size - 1 - c, F.lit(0)), F.lit(c)), lambda at: F.struct(F.lit(c).alias("half"), at.alias("at"), F.slice("_h", at + 1, 2 * c).alias("_s")))

    windows = found.select("doc_id", F.explode(F.concat(*map(starts, halves))).alias("_w")).select("doc_id", "_w.*").where(F.arrays_overlap("_s", marks))
    banded = windows.select("doc_id", "half", "at", "_s", F.posexplode(_minima(F.col("_s"), bands)).alias("band", "value"))
    hits = banded.join(F.broadcast(known), ["half", "band", "value"])  # MOST * bands rows at most
    shared = F.size(F.array_intersect("_s", "own"))
    good = hits.select("doc_id", "license", "half", "at", shared.alias("n_shared"), F.size("own").alias("n_template")).where(F.col("n_shared") >= F.ceil(F.lit(least) * F.col("n_template")))
    each = good.groupBy("doc_id", "license", "n_template", "at").agg(F.max("n_shared").alias("n_shared"))
    return each.groupBy("doc_id", "license").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_template").cast("long").alias("n_template"), F.count("*").alias("n_windows"))


def sql(texts=TEMPLATES, least: float = 0.8) -> str:
    """Every window against every template, for DuckDB."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}', 1)"
    shingle = "CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END"
    rows = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in texts)
    return f"""WITH t AS (SELECT license, list_distinct({shingle}) AS own FROM (SELECT license, {words} AS w FROM (VALUES {rows}) v(license, text))),
templates AS MATERIALIZED (SELECT license, own, greatest(4, pow(2, ceil(log2(len(own))))::INT) AS half FROM t WHERE len(own) > 0),
docs AS MATERIALIZED (SELECT doc_id, {shingle} AS h FROM (SELECT doc_id, {words} AS w FROM documents)),
windows AS MATERIALIZED (SELECT doc_id, half, unnest(p) AS pos, unnest(list_transform(p, lambda x: h[x + 1:x + 2 * half])) AS s
  FROM (SELECT doc_id, h, half, range(0, greatest(len(h) - 1 - half, 0) + 1, half) AS p FROM docs, (SELECT DISTINCT half FROM templates) WHERE len(h) > 0)),
shared AS (SELECT doc_id, license, pos, len(list_intersect(own, s)) AS n_shared, len(own) AS n_template FROM windows JOIN templates USING (half))
SELECT doc_id, license, max(n_shared)::BIGINT AS n_shared, max(n_template)::BIGINT AS n_template, count(*) AS n_windows
FROM shared WHERE n_shared >= ceil({least} * n_template) GROUP BY doc_id, license"""
