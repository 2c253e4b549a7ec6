"""Licence scans by sparse TF-IDF cosine and nearest-ancestor inheritance.

Licence notices are templates. A file's headers are its lines, runs of up to four lines, and
the sentences of a line; a licence file is one whose whole text resembles a template. All are
term vectors over the templates' collection: term count times idf, where a term in no template
has the largest idf. A file without a header of its own takes the licence of the nearest
directory above it that holds a licence file, found by joining its ancestor paths with the
directories. All of it is DataFrame operations; a unit's vector stays within its row, and only
matches leave it.

Whole texts are first tested for key terms. Key terms are chosen so that what a template has
besides them has a norm below the threshold, so nothing without one can reach it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

HEADER_COSINE = 0.6
FILE_COSINE = 0.6
RUN = 4
SENTENCE = "[.!?]+[ \\t]+"

# Notices as the licences' publishers word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]
# Identifiers of the SPDX list that may stand in a tag line.
TAGS = ("MIT", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense")
TEMPLATES += [(tag, f"SPDX-License-Identifier: {tag}") for tag in TAGS]
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
# Function words, which are no terms.
STOP = ("a", "all", "and", "any", "are", "as", "at", "be", "by", "either", "except", "for", "has", "in", "is", "it", "may", "not", "of", "on", "or", "that", "the", "this", "to", "under", "with", "without", "you", "your")


class Space:
    """Template vectors of unit length, idf of their terms, and the key terms."""

    def __init__(self, templates=TEMPLATES, threshold: float = min(HEADER_COSINE, FILE_COSINE)):
        bags = [Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP) for _, text in templates]
        df = Counter(t for bag in bags for t in bag)
        n = len(templates)
        self.idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
        self.absent = math.log(1 + n) + 1
        self.names = [name for name, _ in templates]
        self.vectors = []
        for bag in bags:
            raw = {t: c * self.idf[t] for t, c in bag.items()}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            self.vectors.append({t: x / norm for t, x in raw.items()})
        self.keys: set[str] = set()
        piece = lambda t: max(re.split("[.-]", t), key=lambda p: (p not in STOP, len(p)))  # noqa: E731  the part of a term that is looked for
        for v in self.vectors:
            left = sum(x * x for t, x in v.items() if piece(t) not in self.keys)
            # long pieces first: fewer texts have them by chance
            for t in sorted(v, key=lambda t: (-len(piece(t)), t)):
                if left < threshold * threshold * 0.99:
                    break
                if piece(t) not in self.keys:
                    self.keys.add(piece(t))
                    left -= sum(v[u] ** 2 for u in v if piece(u) == piece(t))


def units(text: Column, keys: list[str], run: int = RUN) -> Column:
    """What is compared of a lower-case text: itself, and its headers, of which those without a
    key term are left out."""
    wanted = F.array(*(F.lit(k) for k in keys))
    holds_key = lambda t: F.arrays_overlap(F.split(t, "[^a-z0-9]+"), wanted)
    unit = lambda header, part: F.struct(F.lit(header).alias("header"), part.alias("part"))

    def headers(lines: Column, marks: Column) -> Column:
        runs = []
        for k in range(1, run + 1):
            begins = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i <= F.size(lines) - k + 1) & F.exists(F.slice(marks, i, k), lambda m: m))  # noqa: B023
            runs.append(F.transform(begins, lambda i: unit(True, F.array_join(F.slice(lines, i, k), " "))))  # noqa: B023
        told = F.transform(F.zip_with(lines, marks, lambda x, m: F.when(m, x)), lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), SENTENCE), holds_key))
        return F.concat(F.array(unit(False, text)), *runs, F.transform(F.flatten(told), lambda x: unit(True, x)))

    return let(F.split(text, "\n", -1), lambda lines: let(F.transform(lines, holds_key), lambda marks: headers(lines, marks)))


def best_match(part: Column, space: Space) -> Column:
    """``struct(less, name)``: the best template, of equals the alphabetically first, and its
    cosine times -1, to six digits. Null if no term is in a template."""
    terms = sorted(space.idf)
    vocabulary = F.array(*(F.lit(t) for t in terms))
    idf = F.array(*(F.lit(space.idf[t]) for t in terms))
    weights = [(name, F.array(*(F.lit(v.get(t, 0.0)) for t in terms))) for name, v in zip(space.names, space.vectors)]
    templates = F.array(*(F.struct(F.lit(name).alias("name"), w.alias("w")) for name, w in weights))
    found = F.filter(F.regexp_extract_all(part, F.lit(f"({TERM})")), lambda t: ~t.isin(*STOP))
    whole = F.lit(0).cast("long")

    def squares(words: Column) -> Column:
        """Sum of the squared counts of sorted words: the k-th of a word adds 2 k - 1."""
        step = lambda a, x: let(F.when(x == a["last"], a["run"] + 1).otherwise(F.lit(1).cast("long")), lambda k: F.struct(x.alias("last"), k.alias("run"), (a["sum"] + 2 * k - 1).alias("sum")))
        return F.aggregate(words, F.struct(F.lit("").alias("last"), whole.alias("run"), whole.alias("sum")), step, lambda a: a["sum"])

    def match(own: Column, norm: Column) -> Column:
        dot = lambda w: F.aggregate(own, F.lit(0.0), lambda a, o: a + o["x"] * F.get(w, o["at"]))
        return F.array_min(F.transform(templates, lambda t: F.struct((-F.round(dot(t["w"]) / F.sqrt(norm), 6)).alias("less"), t["name"].alias("name"))))

    def vector(words: Column) -> Column:
        count = lambda t: F.size(F.filter(words, lambda x: x == t))
        cell = lambda t: let((F.array_position(vocabulary, t) - 1).cast("int"), lambda at: let(count(t), lambda c: F.struct(at.alias("at"), c.alias("c"), (c * F.get(idf, at)).alias("x"))))
        own = F.transform(F.array_intersect(words, vocabulary), cell)
        rest = lambda a, o: a + o["x"] * o["x"] - space.absent**2 * o["c"] * o["c"]
        return let(own, lambda o: F.when(F.size(o) > 0, let(F.aggregate(o, space.absent**2 * squares(words), rest), lambda norm: match(o, norm))))

    return let(F.array_sort(found), vector)


def scan(
    files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE
) -> DataFrame:
    """``path, license, method, similarity`` for every distinct path.

    method is ``header`` (best header), ``file`` (whole text, where no header is enough),
    ``inherited`` (nearest ancestor directory with a licence file; its similarity) or ``none``.
    Equal similarities, to six digits, go to the alphabetically first licence, and of a
    directory's licence files to the first path. Rows with one path count as one file, of which
    the best row decides; a null path is the empty path; null and empty texts have no terms;
    other columns are dropped; an empty table gives an empty result.
    """
    space = Space(templates, min(header_cosine, file_cosine))
    src = files.select(F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = sorted(space.keys)
    with_key = src.where(F.arrays_overlap(F.split(F.lower("text"), "[^a-z0-9]+"), F.array(*(F.lit(k) for k in keys))))
    part = with_key.select("path", F.inline(units(F.lower("text"), keys)))
    match = best_match(F.col("part"), space)
    enough = lambda m: m["less"] <= F.when(F.col("header"), -header_cosine).otherwise(-file_cosine)
    own = part.select("path", "header", F.explode(F.filter(F.array(match), enough)).alias("b"))
    best = own.groupBy("path", "header").agg(F.min("b").alias("b"))
    best = cut(best.select("path", "header", F.col("b.name").alias("license"), (-F.col("b.less")).alias("similarity")))
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    directories = best.where("not header").select(parent.alias("dir"), F.struct((-F.col("similarity")).alias("less"), "path", "license").alias("f"))
    directories = directories.groupBy("dir").agg(F.min("f").alias("f"))
    declared = best.groupBy("path").agg(F.max(F.struct("header", "license", "similarity")).alias("own"))
    every = src.select("path").distinct().join(declared, "path", "left")
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))
    above = every.where("own is null").select("path", F.inline(ancestors))
    nearest = above.join(directories, "dir").groupBy("path").agg(F.max(F.struct("depth", "f")).alias("n"))
    return every.join(nearest, "path", "left").select(
        "path",
        F.coalesce("own.license", "n.f.license").alias("license"),
        F.when(F.col("own.header"), "header").when(F.col("own").isNotNull(), "file").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("method"),
        F.coalesce(F.col("own.similarity"), -F.col("n.f.less"), F.lit(0.0)).alias("similarity"),
    )


def oracle(files_sql: str, templates=TEMPLATES, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE) -> str:
    """The scan as DuckDB SQL over ``files_sql`` (path, text), every text scanned."""
    stop = ", ".join(f"'{t}'" for t in STOP)
    runs = "".join(
        f"UNION ALL SELECT path, r, true, array_to_string(l[i:i + {k - 1}], ' ') FROM (SELECT path, r, l, unnest(range(1, len(l) - {k - 2})) AS i FROM split) " for k in range(1, RUN + 1)
    )
    quoted = ", ".join(f"({k}, '{name}', '{text.lower()}')" for k, (name, text) in enumerate(templates))
    return f"""
    WITH files AS ({files_sql}), templates(k, name, body) AS (VALUES {quoted}),
    tt AS (SELECT k, name, t, count(*) AS c FROM (SELECT k, name, unnest(regexp_extract_all(body, '{TERM}')) AS t FROM templates) WHERE t NOT IN ({stop}) GROUP BY ALL),
    idf AS (SELECT t, ln((1 + {len(templates)}) / (1.0 + count(*))) + 1 AS idf FROM tt GROUP BY t),
    tn AS (SELECT k, sqrt(sum((c * idf) ** 2)) AS n FROM tt JOIN idf USING (t) GROUP BY k),
    tw AS (SELECT t, k, name, c * idf / n AS w FROM tt JOIN idf USING (t) JOIN tn USING (k)),
    split AS (SELECT path, row_number() OVER () AS r, lower(text) AS whole, string_split(lower(text), chr(10)) AS l FROM files),
    parts AS (
        SELECT path, r, false AS header, whole AS part FROM split
        {runs}
        UNION ALL SELECT path, r, true, unnest(string_split_regex(x, '{SENTENCE}')) FROM (SELECT path, r, unnest(l) AS x FROM split)),
    units AS (SELECT *, row_number() OVER () AS unit FROM parts),
    tf AS (SELECT path, header, unit, t, count(*) AS c FROM (SELECT path, header, unit, unnest(regexp_extract_all(part, '{TERM}')) AS t FROM units) WHERE t NOT IN ({stop}) GROUP BY ALL),
    x AS (SELECT path, header, unit, t, c * coalesce(idf, ln(1.0 + {len(templates)}) + 1) AS x FROM tf LEFT JOIN idf USING (t)),
    norms AS (SELECT unit, sum(x * x) AS n FROM x GROUP BY ALL),
    dots AS (SELECT path, header, unit, k, name, sum(x * w) AS d FROM x JOIN tw USING (t) GROUP BY ALL),
    cos AS (SELECT path, header, name, round(d / sqrt(n), 6) AS c FROM dots JOIN norms USING (unit)),
    best AS (
        SELECT path, header, name AS license, c AS similarity FROM cos WHERE c >= CASE WHEN header THEN {header_cosine} ELSE {file_cosine} END
        QUALIFY row_number() OVER (PARTITION BY path, header ORDER BY c DESC, name) = 1),
    own AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY path ORDER BY header DESC) = 1),
    dirs AS (
        SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, similarity FROM best WHERE NOT header
        QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY similarity DESC, path) = 1),
    near AS (
        SELECT f.path, d.license, d.similarity FROM (SELECT DISTINCT path FROM files) f JOIN dirs d ON d.dir = '' OR starts_with(f.path, d.dir || '/')
        QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY length(d.dir) DESC) = 1)
    SELECT f.path, coalesce(o.license, n.license) AS license,
        CASE WHEN o.header THEN 'header' WHEN o.path IS NOT NULL THEN 'file' WHEN n.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS method,
        coalesce(o.similarity, n.similarity, 0.0) AS similarity
    FROM (SELECT DISTINCT path FROM files) f LEFT JOIN own o USING (path) LEFT JOIN near n USING (path)"""
