"""License notices in texts: MinHash bands over overlapping word windows, verified by exact shingle containment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Notices of well-known licenses, as they are usually printed.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

WIDTH = 5
CONTAINMENT = 0.8
#: Chance that a window holding a notice with just CONTAINMENT shares no band with it, at most.
MISS = 1e-5
BREAKS = r"[\s\x0B!-/:-@\[-`{-~]+"


def plain_words(text: str) -> list[str]:
    """A notice's words: lower case, split at white space and ASCII punctuation."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def stride_of(words: int) -> int:
    return max(1, words // 8)


def window_of(words: int) -> int:
    """A window holds the notice wherever it begins: its words and the steps between two windows."""
    return words + stride_of(words) - 1


def least_similarity(words: int) -> float:
    """Jaccard similarity of a notice's shingles and those of a window that contains just enough of them."""
    notice, window = words - WIDTH + 1, window_of(words) - WIDTH + 1
    common = math.ceil(CONTAINMENT * notice)
    return common / (notice + window - common)


def band_count(words: int) -> int:
    """Bands of one minwise value each, so that all miss with a chance of at most MISS."""
    s = least_similarity(words)
    return 1 if s >= 1 else math.ceil(math.log(MISS) / math.log(1 - s))


def key_words(words: list[str]) -> set[str]:
    """Words of which a text must hold one to contain the notice: their shingles are more than it may lack."""
    shingles = len(words) - WIDTH + 1
    spare = shingles - math.ceil(CONTAINMENT * shingles)
    chosen: set[str] = set()
    covered: set[int] = set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(covered) > spare:
            break
        chosen.add(word)
        covered |= {i for i in range(shingles) if word in words[i : i + WIDTH]}
    return chosen


def shingles_of(words: Column) -> Column:
    """Distinct 5-word shingles of an array of words, none for fewer words."""
    places = F.when(F.size(words) >= WIDTH, F.sequence(F.lit(1), F.size(words) - (WIDTH - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, WIDTH), " ")))


def bands_of(shingles: Column, bands: int) -> Column:
    """(band, value) structs: in each band the least hash of a shingle."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band))))

    return F.array(*[F.struct(F.lit(b).alias("band"), least(b).alias("value")) for b in range(bands)])


def scan_licenses(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, notice, containment, first_word) for each document row and each notice it contains.

    Words are lower-cased and split at white space and ASCII punctuation. Windows of a notice's length, overlapping
    by seven eighths, meet the notices that share a minwise value in some band; a window counts if at least
    CONTAINMENT of the notice's distinct 5-word shingles are in it. ``containment`` is the largest share over the
    windows and ``first_word`` (from 0) the first window that has it. Windows without any word that the notice cannot
    lack are left out beforehand. Notices need 5 words. Null and empty texts contain nothing; repeated rows and null
    ids give rows of their own; an empty table gives no rows; extra columns are ignored. All work is in DataFrame
    functions, and windows stay inside their row until they are filtered.
    """
    spark = docs.sparkSession
    known = [(k, name, plain_words(text)) for k, (name, text) in enumerate(notices)]
    keys = sorted(set().union(*(key_words(w) for _, _, w in known)))
    sizes = sorted({len(w) for _, _, w in known})
    text = F.lower(text_of(text_col))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.where(F.col("text").rlike("|".join(keys)))
    rows = rows.select("uid", "doc_id", F.split(F.trim(F.regexp_replace("text", BREAKS, " ")), " ").alias("words"))
    wanted = F.array(*[F.lit(k) for k in keys])
    bands = {n: band_count(n) for n in sizes}

    def windows(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(stride_of(n)))
        cut = F.transform(starts, lambda i: F.struct(F.lit(n).alias("size"), i.alias("at"), F.slice(F.col("words"), i + 1, window_of(n)).alias("part")))
        return F.filter(cut, lambda w: F.arrays_overlap(w["part"], wanted))

    found = rows.select("uid", "doc_id", F.explode(F.concat(*[windows(n) for n in sizes])).alias("w"))
    found = found.select("uid", "doc_id", F.col("w.size").alias("size"), F.col("w.at").alias("at"), shingles_of(F.col("w.part")).alias("shingles"))
    found = found.where(F.size("shingles") > 0)
    most = max(bands.values())
    of_size = F.element_at(F.create_map(*[F.lit(x) for pair in bands.items() for x in pair]), F.col("size"))
    listed = [
        F.struct(F.lit(k).alias("notice"), F.lit(name).alias("license"), F.lit(len(w)).alias("size"), F.array(*[F.lit(x) for x in w]).alias("words"))
        for k, name, w in known
    ]
    templates = spark.range(1).select(F.explode(F.array(*listed)).alias("t")).select("t.*")
    templates = templates.select("notice", "license", "size", shingles_of(F.col("words")).alias("whole"))

    def banded(df: DataFrame) -> DataFrame:
        values = F.slice(bands_of(F.col("whole" if "whole" in df.columns else "shingles"), most), F.lit(1), of_size)
        return df.withColumn("b", F.explode(values)).withColumn("band", F.col("b.band")).withColumn("value", F.col("b.value")).drop("b")

    met = banded(found).join(banded(templates), ["size", "band", "value"]).dropDuplicates(["uid", "at", "notice"])
    share = F.size(F.array_intersect("shingles", "whole")) / F.size("whole")
    met = met.withColumn("containment", share).where(F.col("containment") >= CONTAINMENT)
    best = met.groupBy("uid", "doc_id", "notice", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("_at"))).alias("m"))
    return best.select("doc_id", "license", "notice", F.col("m.containment").alias("containment"), (-F.col("m._at")).cast("int").alias("first_word"))


def oracle(notices: tuple[tuple[str, str], ...] = NOTICES) -> str:
    """The same in DuckDB: every window against every notice of its size, without bands."""
    known = [(k, name, plain_words(text)) for k, (name, text) in enumerate(notices)]
    keys = "|".join(sorted(set().union(*(key_words(w) for _, _, w in known))))
    values = ", ".join(f"({k}, '{name}', {len(w)}, {stride_of(len(w))}, {window_of(len(w))}, {w!r})" for k, name, w in known)
    return f"""
WITH t(notice, license, size, stride, win, words) AS (VALUES {values}),
tt AS (SELECT *, list_distinct(list_transform(range(1, size - {WIDTH - 2}), lambda i: array_to_string(words[i:i+{WIDTH - 1}], ' '))) AS whole FROM t),
d AS (SELECT row_number() OVER () AS uid, doc_id,
             string_split(trim(regexp_replace(lower(text), '[\\s\\x0B!-/:-@\\[-`{{-~]+', ' ', 'g')), ' ') AS words
      FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '{keys}')),
w AS (SELECT d.uid, d.doc_id, tt.notice, tt.license, tt.whole, u.i AS place, d.words[u.i + 1 : u.i + tt.win] AS part
      FROM d, tt, LATERAL (SELECT unnest(range(0, len(d.words), tt.stride)) AS i) u),
s AS (SELECT uid, doc_id, notice, license, place,
             len(list_intersect(whole, list_distinct(list_transform(range(1, len(part) - {WIDTH - 2}), lambda i: array_to_string(part[i:i+{WIDTH - 1}], ' '))))) / CAST(len(whole) AS DOUBLE) AS c
      FROM w WHERE len(part) >= {WIDTH})
SELECT doc_id, license, CAST(notice AS INTEGER) AS notice, max(c) AS containment, CAST(arg_max(place, c * 1000000000 - place) AS INTEGER) AS first_word
FROM s WHERE c >= {CONTAINMENT} GROUP BY uid, doc_id, notice, license
"""
