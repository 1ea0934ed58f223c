"""License scan: TF-IDF cosine of lines and files to templates, then inheritance by directory (native)."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, table

#: Notices by which texts and files name their license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("ISC", "Licensed under the ISC License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]
#: Words that say nothing about a license.
STOP_WORDS = (
    "a an and any are as at be by can for from in into is it its may no not of on or other that the this to under up use was with without you your"
).split()
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([._-][^/]*)?$"


class Templates:
    """Unit TF-IDF vectors of the templates; terms they don't have get the highest weight."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        counts = [Counter(w for w in re.findall(TERM, t.lower()) if w not in STOP_WORDS) for _, t in templates]
        seen = Counter(w for c in counts for w in c)
        self.unknown = math.log(1 + len(counts)) + 1
        self.idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in seen.items()}
        self.vectors = []
        for (name, _), c in zip(templates, counts, strict=True):
            size = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in c.items()))
            self.vectors.append((name, {w: n * self.idf[w] / size for w, n in c.items()}))

    def needed(self, least: float) -> list[str]:
        """Terms of which a text must have one to reach the cosine: what a template's other terms can
        give together stays below ``least``."""
        found = set()
        for _, v in self.vectors:
            left = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if left < (least - 1e-9) ** 2:
                    break
                found.add(w)
                left -= v[w] ** 2
        return sorted(found)

    def pattern(self, least: float) -> str:
        """A regular expression for a needed term as a word, dealt by first letter for speed."""
        by: dict[str, list[str]] = {}
        for w in self.needed(least):
            by.setdefault(w[0], []).append(re.escape(w[1:]))
        return f"(?<![a-z0-9])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in by.items())})(?![a-z0-9])"

    def rows(self) -> str:
        """The vectors as SQL rows: template, license, term, idf, weight."""
        return ", ".join(
            f"({k}, '{name}', '{w}', {self.idf[w]!r}e0, {x!r}e0)" for k, (name, v) in enumerate(self.vectors) for w, x in sorted(v.items())
        )


def _cosines(units: DataFrame, keys: list[str], t: Templates, least: float) -> DataFrame:
    """Best template of each unit whose cosine reaches ``least``: ``keys, licence, score``.

    A unit of k known terms and u others has a cosine of sqrt(s / (s + u i**2)) at most, where i is the
    weight of an unknown term and s, the sum of squares of the known ones, (k m)**2 at most for the largest weight m.
    Units below ``least`` by that leave before any shuffle.
    """
    spark = units.sparkSession
    known, largest, below = sorted(t.idf), max(t.idf.values()), least - 1e-6
    factor = (1 / below**2 - 1) * (largest / t.unknown) ** 2

    def reachable(terms: Column) -> Column:
        k = F.size(F.filter(terms, lambda x: x.isin(known)))
        return F.when((k > 0) & (F.size(terms) - k <= k * k * factor), terms)

    every = F.filter(F.expr(f"regexp_extract_all(lower(_text), '{TERM}', 0)"), lambda x: ~x.isin(STOP_WORDS))
    # an outer explode, as the other would filter on the array first, and so compute it twice
    terms = units.select(*keys, F.explode_outer(let(every, reachable)).alias("term")).where("term is not null")
    counts = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    weights = [(w, t.idf[w], [v.get(w, 0.0) for _, v in t.vectors]) for w in known]
    rows = ", ".join(f"('{w}', {i!r}e0, array({', '.join(f'{x!r}e0' for x in v)}))" for w, i, v in weights)
    weights = spark.sql(f"SELECT * FROM VALUES {rows} AS v(term, idf, weights)")
    sized = counts.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(t.unknown)))
    dots = [F.sum(F.col("w") * F.get("weights", F.lit(i))).alias(f"d{i}") for i in range(len(t.vectors))]
    got = sized.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    score = lambda i: F.round(F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / F.col("norm"), 6)
    some = F.array(*[F.struct((-score(i)).alias("s"), F.lit(name).alias("licence")) for i, (name, _) in enumerate(t.vectors)])
    best = got.select(*keys, F.array_min(some).alias("b")).where(F.col("b.s") <= -least)
    return best.select(*keys, F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, least: float = 0.6, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``file, path, licence, score, found`` for every row of ``files(file, path, text)``.

    ``found`` is ``line`` if a line of the text reaches cosine ``least`` with a template (the best, then the
    first by name), else ``directory`` if a directory above has a license, the nearest one, else null, and the
    license and score too. A directory's license is that of its licence files: files named as
    such, or whose whole text reaches the cosine; the best score, then first path, counts. Null texts and empty
    texts have no license of their own; a null path has no directory, a null file is a file like others. ``file`` must tell
    rows apart: rows that share it are read as one file with all their lines. Texts of any length count whole; other
    columns are ignored; no files give no rows. Ties go to the first license by name.

    Texts without any of the terms that a match needs (``Templates.needed``) are passed over at once: they
    can't reach the cosine.
    """
    t = Templates(templates)
    any_term = t.pattern(least)
    files = files.select("file", "path", "text")
    likely = files.where(F.lower("text").rlike(any_term))
    lines = likely.select("file", F.posexplode(F.split("text", "\n")).alias("line_no", "_text")).where(F.lower("_text").rlike(any_term))
    by_line = _cosines(lines, ["file", "line_no"], t, least)
    own = by_line.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    own = own.select("file", F.col("b.licence").alias("own"), (-F.col("b.s")).alias("own_score"))
    whole = likely.select("file", F.col("text").alias("_text"))
    whole = _cosines(whole, ["file"], t, least).select("file", F.col("licence").alias("whole"), F.col("score").alias("whole_score"))
    known = files.drop("text")
    for found in (own, whole):  # a null file is a file
        found = found.withColumnRenamed("file", "of")
        known = known.join(found, F.col("file").eqNullSafe(F.col("of")), "left").drop("of")
    named = F.col("path").rlike(LICENCE_FILE) & F.col("own").isNotNull()
    holders = known.where(named | F.col("whole").isNotNull()).withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))
    holders = holders.where("directory is not null")
    score = F.greatest(F.coalesce("whole_score", F.lit(0.0)), F.coalesce("own_score", F.lit(0.0)))
    licence = F.when(F.coalesce("whole_score", F.lit(0.0)) >= F.coalesce("own_score", F.lit(0.0)), F.col("whole")).otherwise(F.col("own"))
    holders = holders.groupBy("directory").agg(F.min(F.struct((-score).alias("s"), "path", licence.alias("licence"))).alias("h"))
    holders = holders.select("directory", F.col("h.licence").alias("dir_licence"), (-F.col("h.s")).alias("dir_score"))
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("directory")))
    places = known.where("own is null and path is not null").select("path").distinct()
    places = places.select("path", F.explode(above).alias("a")).select("path", "a.depth", "a.directory")
    near = places.join(holders, "directory").groupBy("path").agg(F.max(F.struct("depth", "dir_licence", "dir_score")).alias("n"))
    near = near.select(F.col("path").alias("_path"), "n.dir_licence", "n.dir_score")
    out = known.join(near, F.col("own").isNull() & (F.col("path") == F.col("_path")), "left")
    return out.select(
        "file",
        "path",
        F.coalesce("own", "dir_licence").alias("licence"),
        F.coalesce("own_score", "dir_score").alias("score"),
        F.when(F.col("own").isNotNull(), "line").when(F.col("dir_licence").isNotNull(), "directory").alias("found"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document is the file source/lang/doc_id; a document that is nothing but a notice is a licence file."""
    docs = table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    path = F.concat_ws("/", part("source"), part("lang"), part("doc_id"))
    return scan(docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")).withColumnRenamed("file", "doc_id")


def oracle(least: float = 0.6) -> str:
    t = Templates()
    cosines = lambda units, key: f"""
      SELECT {key}, min_by(licence, (-score, licence)) AS licence, max(score) AS score FROM (
        SELECT {key}, template, licence, round(sum(n * idf * weight) / any_value(norm), 6) AS score FROM (
          SELECT {key}, term, n, sqrt(sum(n * n * x * x) OVER (PARTITION BY {key})) AS norm FROM (
            SELECT {key}, term, count(*) AS n, coalesce(any_value(idf), {t.unknown!r}e0) AS x
            FROM (SELECT {key}, unnest(regexp_extract_all(lower(txt), '{TERM}')) AS term FROM {units})
            LEFT JOIN (SELECT DISTINCT term, idf FROM v) USING (term)
            WHERE term NOT IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}) GROUP BY {key}, term))
        JOIN v USING (term) GROUP BY {key}, template, licence) WHERE score >= {least} GROUP BY {key}"""
    return f"""
    WITH v(template, licence, term, idf, weight) AS (VALUES {t.rows()}),
    f AS (SELECT doc_id, text, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), coalesce(CAST(doc_id AS VARCHAR), '_')) AS path FROM documents),
    l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS txt FROM f),
    a AS ({cosines("l", "doc_id, line_no")}),
    o AS (SELECT doc_id, min_by(licence, (-score, licence)) AS own, max(score) AS own_score FROM a GROUP BY doc_id),
    w AS ({cosines("(SELECT doc_id, text AS txt FROM f)", "doc_id")}),
    k AS (SELECT f.doc_id, f.path, own, own_score, w.licence AS whole, w.score AS whole_score FROM f LEFT JOIN o USING (doc_id) LEFT JOIN w USING (doc_id)),
    h AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS directory,
                 min_by(CASE WHEN whole_score >= coalesce(own_score, 0) THEN whole ELSE own END, (-greatest(whole_score, coalesce(own_score, 0)), path)) AS dl,
                 max(greatest(whole_score, coalesce(own_score, 0))) AS ds FROM k WHERE whole IS NOT NULL GROUP BY 1),
    n AS (SELECT doc_id, arg_max(dl, length(directory)) AS dl, arg_max(ds, length(directory)) AS ds
          FROM k JOIN h ON starts_with(k.path, h.directory || '/') WHERE own IS NULL GROUP BY doc_id)
    SELECT doc_id, path, coalesce(own, dl) AS licence, coalesce(own_score, ds) AS score,
           CASE WHEN own IS NOT NULL THEN 'line' WHEN dl IS NOT NULL THEN 'directory' END AS found
    FROM k LEFT JOIN n USING (doc_id)"""
