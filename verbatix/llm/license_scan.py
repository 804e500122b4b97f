"""Licence scans: sparse TF-IDF cosine against templates, then inheritance from the nearest directory.

Vectors have one dimension for each term of the templates; a term's inverse document frequency comes from
all files of the corpus. Every line of a file is a possible header, and so is every run of lines that can hold
a wrapped one: up to ``RUN_LINES`` lines with a term of a template (blank lines and bare comment marks between
them do not count) and up to twice as many such terms as the longest template has. Of a licence file the whole
text is a unit too. A unit matches the template of largest cosine if that reaches a threshold. Only units that
hold one of the ``gate`` terms are scored: by the Cauchy-Schwarz inequality the other terms of a template cannot
reach the threshold together, so the gate loses no match.

Every file is compared as a whole with full licence texts, wherever in it these begin. These
cosines damp counts to 1 + ln(count), so that function words do not decide, and give the file a dimension for
each of its other terms as well, weighed as if one file held it: prose around a licence is not that licence.
Files are left out by the same inequality alone: those without a heavy term of a text, and those with fewer of its
terms than its heaviest ones that reach the threshold.
A full text that matches decides before any header, as licences quote each other's headers.

Files that speak for their directory (by name: LICENSE, COPYING, NOTICE) hand their licence down: a file
without a licence of its own takes that of the nearest directory above it, itself included. Directories,
not files, are expanded into their ancestors, so the joins carry one row for each directory and level.

Defined results: a null or empty text has no units and no licence; a null path belongs to no directory;
among equal cosines the first template in order wins, then the unit of fewest lines, then the first; of several files that speak for
one directory the largest cosine wins, then the smallest path; repeated rows are scanned each; an empty
table gives an empty table; added columns replace columns of the same name.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce
from importlib import resources
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Licences and short notices by which they are granted.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
#: Full texts, from the files beside this module. That of AGPL-3.0 is the text of GPL-3.0 under the other name.
TEXTS = tuple((f.name.removesuffix(".txt"), f.read_text()) for f in sorted(resources.files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt"))
THRESHOLD = 0.75
RUN_LINES = 12
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([.-][^/]*)?$"
COLUMNS = ("licence", "licence_score", "licence_line", "licence_via", "licence_from")

#: So many grants (a path and its directory each) are sent to all executors.
FEW_GRANTS = 100_000

_BREAK = "[^a-z0-9]+"


def terms_of(text: str) -> list[str]:
    """Terms as the plan makes them: A-Z in lower case, runs of a-z and 0-9."""
    ascii_lower = text.translate({c: c + 32 for c in range(65, 91)})
    return [t for t in re.split(_BREAK, ascii_lower) if t]


def _terms(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.split(F.translate(text, upper, lower), _BREAK)


def needed(vector: dict[str, float], least: float) -> list[str]:
    """The heaviest terms of a vector without which the squares of the others do not sum up to ``least``."""
    left, out = 1.0, []
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if left < least:
            break
        out.append(t)
        left -= w * w
    return out


class Weights:
    """Template vectors of length one under given document frequencies."""

    def __init__(self, templates: Sequence[tuple[str, str]], df: dict[str, int], n_files: int, threshold: float):
        self.templates, self.threshold = templates, threshold
        counts = [Counter(terms_of(text)) for _, text in templates]
        self.idf = {t: math.log((1 + n_files) / (1 + df.get(t, 0))) + 1 for c in counts for t in c}
        self.vectors = []
        for c in counts:
            raw = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            self.vectors.append({t: w / norm for t, w in raw.items()})
        self.gate = sorted({t for v in self.vectors for t in needed(v, threshold**2 - 1e-8)})
        self.run_terms = 2 * max((c.total() for c in counts), default=0)
        #: Weights of the full texts, if files are compared with those as well.
        self.texts: TextWeights | None = None

    def known(self, unit: Column) -> Column:
        """The terms of a unit that templates have, repeats included."""
        return F.filter(_terms(unit), lambda t: t.isin(*self.idf))

    def best(self, known: Column) -> Column:
        """struct<score, template> of the best template of a unit's known terms: negative score if there is none."""
        table = _table({t: [w, *(w * v.get(t, 0.0) for v in self.vectors)] for t, w in self.idf.items()})
        none = F.array(*[F.lit(0.0)] * (1 + len(self.vectors)))

        def add(sums: Column, n: Column, weights: Column) -> Column:
            """The square of the length, then the products with the templates."""
            return F.zip_with(sums, F.transform(weights, lambda w, k: F.when(k == 0, F.pow(n * w, 2)).otherwise(n * w)), lambda a, b: a + b)

        def scored(known: Column, table: Column) -> Column:
            sums = F.aggregate(F.array_distinct(known), none, lambda s, t: _let(F.size(F.filter(known, lambda x: x == t)), lambda n: add(s, n, table[t])))
            score = lambda dot, s: F.coalesce(F.try_divide(dot, F.sqrt(s[0])), F.lit(-1.0)).alias("score")
            return _let(sums, lambda s: F.array_max(F.transform(F.slice(s, 2, len(self.vectors)), lambda dot, k: F.struct(score(dot, s), (-k).alias("template")))))

        return _let(known, lambda known: _let(table, lambda m: scored(known, m)))


class TextWeights:
    """Vectors of length one of full texts, with damped counts, under given document frequencies."""

    def __init__(self, texts: Sequence[tuple[str, str]], df: dict[str, int], n_files: int, threshold: float):
        self.names = [name for name, _ in texts]
        counts = [Counter(terms_of(text)) for _, text in texts]
        idf = {t: math.log((1 + n_files) / (1 + df.get(t, 0))) + 1 for c in counts for t in c}
        self.other = math.log((1 + n_files) / 2) + 1 if n_files else 1.0
        vectors = []
        for c in counts:
            raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            vectors.append({t: w / norm for t, w in raw.items()})
        #: term -> its weight in a file, then its part of the cosine with each text
        self.weights = {t: [w, *(w * v.get(t, 0.0) for v in vectors)] for t, w in idf.items()}
        least = threshold**2 - 1e-8
        self.gate = sorted({t for v in vectors for t in needed(v, least)})
        #: the terms of each text, and how many of them a file that matches has at least
        self.shared = [(sorted(v), next((n for n, sum_ in enumerate(accumulate(sorted((w * w for w in v.values()), reverse=True)), 1) if sum_ >= least), len(v))) for v in vectors]

    def within_reach(self, text: Column) -> Column:
        """Whether a file has so many terms of a full text that their cosine can reach the threshold."""
        enough = lambda terms: [F.size(F.array_intersect(terms, _words(known))) >= least for known, least in self.shared]
        return _let(F.array_distinct(_terms(text)), lambda terms: reduce(Column.__or__, enough(terms)))

    def best(self, text: Column) -> Column:
        """struct<score, template> of the best full text of a file."""
        table = _table(self.weights)
        none = F.array(*[F.lit(0.0)] * (1 + len(self.names)))

        def scored(counts: Column, found: Column, table: Column) -> Column:
            everything = F.aggregate(counts, F.lit(0.0), lambda s, x: s + F.pow(x["damped"] * self.other, 2))
            less = F.aggregate(found, F.lit(0.0), lambda s, x: s + F.pow(x["damped"] * self.other, 2) - F.pow(x["damped"] * table[x["term"]][0], 2))
            dots = F.aggregate(found, none, lambda s, x: F.zip_with(s, table[x["term"]], lambda a, w: a + x["damped"] * w))
            cosine = lambda dot: F.coalesce(F.try_divide(dot, F.sqrt(everything - less)), F.lit(-1.0))
            return _let(dots, lambda d: F.array_max(F.transform(F.slice(d, 2, len(self.names)), lambda dot, k: F.struct(cosine(dot).alias("score"), (-k).alias("template")))))

        known = lambda counts: F.filter(counts, lambda x: x["term"].isin(*self.weights))
        return _let(_damped(F.filter(_terms(text), lambda t: t != "")), lambda c: _let(known(c), lambda found: _let(table, lambda m: scored(c, found, m))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _damped(terms: Column) -> Column:
    """array<struct<term, damped>>: the distinct terms with 1 + ln(count)."""

    def counted(s: Column, first: Column) -> Column:
        n = lambda i, k: F.coalesce(F.get(first, k + 1), F.size(s) + 1) - i
        return F.transform(first, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (1 + F.log(n(i, k))).alias("damped")))

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>"))
        return _let(F.filter(places, lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2))), lambda first: counted(s, first))

    return _let(F.array_sort(terms), runs)


def _words(terms: Sequence[str]) -> Column:
    return F.split(F.lit(" ".join(terms)), " ")


def _table(weights: dict[str, list[float]]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "map<string, array<double>>")


def corpus_weights(files: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, texts: Sequence[tuple[str, str]] = TEXTS) -> Weights:
    """Counts, over all files, how many hold each term of the templates and texts: as many rows reach the driver."""
    vocabulary = sorted({t for _, text in (*templates, *texts) for t in terms_of(text)})
    here = F.array_intersect(_terms(F.coalesce("text", F.lit(""))), _words(vocabulary))
    rows = files.select(F.explode(F.array_append(here, F.lit(""))).alias("term")).groupBy("term").count().collect()
    df = {r["term"]: r["count"] for r in rows}
    weights = Weights(templates, df, df.get("", 0), threshold)
    weights.texts = TextWeights(texts, df, df.get("", 0), threshold) if texts else None
    return weights


def _headers(text: Column, is_licence: Column, weights: Weights) -> Column:
    """struct<best, length, order, line> of the best unit among the lines, the runs of lines and, of a licence
    file, the whole text."""
    gate = F.array(*map(F.lit, weights.gate))

    def unit(known: Column, length: Column, line: Column) -> Column:
        return F.struct(weights.best(known).alias("best"), (-length).alias("length"), (-line).alias("order"), line.alias("line"))

    def runs_from(lines: Column) -> Column:
        """Units of the runs that start with the first of ``lines``."""
        terms = lambda n: F.aggregate(F.slice(lines, 1, n), F.lit(0), lambda s, x: s + F.size(x["known"]))
        fits = lambda n: F.exists(F.slice(lines, 1, n), lambda x: x["gate"]) & ((n == 1) | (terms(n) <= weights.run_terms))
        known = lambda n: F.flatten(F.transform(F.slice(lines, 1, n), lambda x: x["known"]))
        return F.transform(F.filter(F.sequence(F.lit(1), F.size(lines)), fits), lambda n: unit(known(n), n, lines[0]["line"]))

    def units(lines: Column) -> Column:
        starts = F.when(F.size(lines) > 0, F.sequence(F.lit(1), F.size(lines))).otherwise(F.array().cast("array<int>"))
        near = F.filter(F.transform(starts, lambda j: F.slice(lines, j, RUN_LINES)), lambda s: F.exists(s, lambda x: x["gate"]))
        runs = F.flatten(F.transform(near, runs_from))
        whole = F.array(unit(F.flatten(F.transform(lines, lambda x: x["known"])), F.lit(0), F.lit(0)))
        return F.array_max(F.when(is_licence, F.concat(runs, whole)).otherwise(runs))

    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(weights.known(line).alias("known"), (i + 1).alias("line")))
    held = F.transform(F.filter(lines, lambda x: F.size(x["known"]) > 0), lambda x: F.struct(x["known"], x["line"], F.arrays_overlap(x["known"], gate).alias("gate")))
    return _let(held, units)


def scan(files: DataFrame, weights: Weights) -> DataFrame:
    """``files`` (path, text, ...) with licence, licence_score (cosine) and licence_line (from 1, of a run its
    first line; 0 for a whole text). No shuffle."""
    text, is_licence = F.coalesce("text", F.lit("")), F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    gates = [weights.gate, *([] if weights.texts is None else [weights.texts.gate])]
    full, out = F.lit(False), files.drop(*COLUMNS).withColumn("_held", F.array_intersect(_terms(text), _words(sorted({t for gate in gates for t in gate}))))
    if weights.texts is not None:
        near = F.arrays_overlap("_held", _words(weights.texts.gate))
        out = out.withColumn("_text", F.when(near, F.when(weights.texts.within_reach(text), weights.texts.best(text))))
        full = F.coalesce(F.col("_text.score") >= weights.threshold - 1e-9, F.lit(False))
    # texts without a gate term are not cut into lines
    out = out.withColumn("_found", F.when(~full & F.arrays_overlap("_held", _words(weights.gate)), _headers(text, is_licence, weights)))
    names = F.array(*(F.lit(name) for name, _ in weights.templates))
    hit = F.col("_found.best.score") >= weights.threshold - 1e-9
    licence, score, line = F.when(hit, F.element_at(names, 1 - F.col("_found.best.template"))), F.when(hit, F.col("_found.best.score")), F.when(hit, F.col("_found.line"))
    if weights.texts is not None:
        texts = F.array(*map(F.lit, weights.texts.names))
        licence, score, line = F.when(full, F.element_at(texts, 1 - F.col("_text.template"))).otherwise(licence), F.when(full, F.col("_text.score")).otherwise(score), F.when(full, F.lit(0)).otherwise(line)
    return out.withColumns({"licence": licence, "licence_score": score, "licence_line": line}).drop("_found", "_text", "_held")


def directory_of(path: Column) -> Column:
    """The path without its last part; empty for the top."""
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """array<struct<depth, above>> of a directory, itself and the top included."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("above")))


def inherit(scanned: DataFrame, speaks: Column | None = None) -> DataFrame:
    """``scanned`` with licence_via ('file', 'directory' or null) and licence_from (the path that grants).
    ``speaks`` tells which files speak for their directory; by default those with a licence file's name."""
    speaks = F.col("path").rlike(LICENCE_FILE) if speaks is None else speaks
    placed = scanned.drop("licence_via", "licence_from", "_dir").withColumn("_dir", directory_of(F.col("path")))
    best = F.min(F.struct((-F.col("licence_score")).alias("order"), "path", "licence")).alias("b")
    granted = placed.filter(F.col("licence").isNotNull() & F.col("_dir").isNotNull() & speaks).select("path", "licence", "licence_score", F.array_join(F.filter(F.split("_dir", "/"), lambda p: p != ""), "/").alias("above")).groupBy("above").agg(best)
    directories = placed.filter(F.col("_dir").isNotNull() & F.col("licence").isNull()).select("_dir").distinct()
    above = directories.select("_dir", F.explode(ancestors(F.col("_dir"))).alias("a")).select("_dir", "a.*")
    # all directories have the upper ones in common: few grants are sent to them, more meet them by a skew join
    granted = materialise(granted, "grants")
    few = granted.count() <= FEW_GRANTS
    nearest = above.join(F.broadcast(granted) if few else granted, "above").groupBy("_dir").agg(F.max(F.struct("depth", "b")).alias("n"))
    handed = nearest.select("_dir", F.col("n.b.licence").alias("_licence"), F.col("n.b.path").alias("_from"), (-F.col("n.b.order")).alias("_score"))
    own = F.col("licence").isNotNull()
    return placed.join(handed, "_dir", "left").withColumns(
        {
            "licence_via": F.when(own, "file").when(F.col("_licence").isNotNull(), "directory"),
            "licence_from": F.when(own, F.col("path")).otherwise(F.col("_from")),
            "licence_score": F.when(own, F.col("licence_score")).otherwise(F.col("_score")),
            "licence": F.coalesce("licence", "_licence"),
        }
    ).drop("_dir", "_licence", "_from", "_score")
