"""Licences of files: sparse TF-IDF cosines of their passages to templates, and inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmill.functions.columns import with_computed
from shopmill.llm.common import saved, whole_text

# The customary sentences by which files state their licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
)
#: Names of files that give their licence to the directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying)([.-].*)?$"
WORD = "[a-z0-9]+"
#: Words that stand in many texts, of some language: the last ones to recognise a passage by.
COMMON = frozenset("a all and any are as by following for in is mit of only or that the this to under use with without 0 1 2 3".split())


@dataclass(frozen=True)
class Templates:
    """Unit TF-IDF vectors of template sentences. A word's idf comes from the templates; other words have the largest."""

    texts: tuple[tuple[str, str], ...] = TEMPLATES
    threshold: float = 0.8

    @cached_property
    def words(self) -> list[Counter]:
        return [Counter(re.findall(WORD, text.lower())) for _, text in self.texts]

    @cached_property
    def other_idf(self) -> float:
        return math.log(1 + len(self.texts)) + 1

    @cached_property
    def idf(self) -> dict[str, float]:
        seen = Counter(word for words in self.words for word in words)
        return {word: math.log((1 + len(self.texts)) / (1 + n)) + 1 for word, n in sorted(seen.items())}

    @cached_property
    def vectors(self) -> list[dict[str, float]]:
        out = []
        for words in self.words:
            raw = {word: n * self.idf[word] for word, n in sorted(words.items())}
            norm = math.sqrt(sum(w * w for w in raw.values()))
            out.append({word: w / norm for word, w in raw.items()})
        return out

    @cached_property
    def anchors(self) -> list[str]:
        """Words of which a passage must have one to reach the threshold with any template.

        Without them, what is left of a template's vector is shorter than the threshold, and so is the cosine. Which
        words are taken changes no result; rare ones let fewer passages through.
        """
        found: set[str] = set()
        for vector in self.vectors:
            left = 1.0
            order = sorted(vector.items(), key=lambda item: (item[0] in COMMON, item[0] not in found, -item[1], item[0]))
            for word, weight in order:
                if left < self.threshold**2 * 0.999:
                    break
                found.add(word)
                left -= weight * weight
        return sorted(found)


def _table(values: dict[str, float]) -> Column:
    """A constant map."""
    return F.create_map(*(F.lit(part) for item in values.items() for part in item))


def _folder(path: Column) -> Column:
    """The directory of a path, empty for the root."""
    return F.regexp_replace(F.regexp_replace(path, "/?[^/]*$", ""), "^/+", "")


def own_licences(files: DataFrame, templates: Templates = Templates(), path: str = "path", text: str = "text") -> DataFrame:
    """``path, license, score``: the most similar template of the files with a passage that reaches the threshold.

    Passages are the lines and the blank-line paragraphs of the whole text. Only passages with an anchor word, which
    is a proven condition, are taken apart into words. All that happens to a passage happens in its row: a dot product
    adds up word by word, and the norm counts runs of equal words in their sorted list, so the work is that of sorting
    a passage's words and texts are not shuffled. Equal scores (to six digits) give the first licence in the alphabet.
    """
    pattern = f"(?<![a-z0-9])(?:{'|'.join(templates.anchors)})(?![a-z0-9])"
    lowered = F.lower("text")
    parts = F.array_distinct(F.concat(F.split("lowered", "\n"), F.split("lowered", r"\n[ \t\r]*\n")))
    some = files.select(F.col(f"`{path}`").alias("path"), whole_text(text).alias("text")).filter(lowered.rlike(pattern))
    passages = some.select("path", lowered.alias("lowered")).select(
        "path", F.explode(F.filter(parts, lambda p: p.rlike(pattern))).alias("passage")
    )
    # costly columns that many others use: each is computed once
    words = with_computed(passages, "words", F.regexp_extract_all("passage", F.lit(f"({WORD})"))).drop("passage")
    idf = _table(templates.idf)

    def square(run: Column) -> Column:
        weight = run["n"] * F.coalesce(idf[run["word"]], F.lit(templates.other_idf))
        return run["sum"] + weight * weight

    def count(run: Column, word: Column) -> Column:
        same = run["word"] == word
        n, total = F.when(same, run["n"] + 1).otherwise(1), F.when(same, run["sum"]).otherwise(square(run))
        return F.struct(word.alias("word"), n.alias("n"), total.alias("sum"))

    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))
    norm = F.sqrt(F.aggregate(F.array_sort("words"), start, count, square))
    known = with_computed(words, "known", F.struct(norm.alias("norm"), F.filter("words", lambda w: w.isin(list(templates.idf))).alias("shared")))
    known = known.select("path", "known.*")

    def dot(vector: dict[str, float]) -> Column:
        weights = _table({word: weight * templates.idf[word] for word, weight in vector.items()})
        return F.aggregate("shared", F.lit(0.0), lambda sum, word: sum + F.coalesce(weights[word], F.lit(0.0)))

    found = []
    for (license, _), vector in zip(templates.texts, templates.vectors):
        score = F.round(dot(vector) / F.col("norm"), 6)
        found.append(F.struct((-score).alias("order"), F.lit(license).alias("license"), score.alias("score")))
    best = with_computed(known, "best", F.array_min(F.array(*found))).select("path", "best")
    best = best.filter(F.col("best.score") >= templates.threshold)
    return best.groupBy("path").agg(F.min("best").alias("best")).select("path", "best.license", "best.score")


def scan(
    files: DataFrame,
    templates: Templates = Templates(),
    key: str = "doc_id",
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """``key, path, license, score, origin, licence_dir`` for every row of ``files``.

    ``origin`` is ``own`` where the file itself states a licence, ``inherited`` where a licence file in the nearest
    directory above (its own included) does, else ``none``. Of several licence files in a directory the best score
    counts, then the first licence in the alphabet.

    Ancestors are looked up once per directory, not per file, by a join of the directories' ancestors with those that
    have a licence; files then meet their directory in a join that adaptive execution splits where one directory has
    a third of all files. Null texts are empty; null paths are files of the root without a name. Rows with the same
    path share what is found in any of them. Other columns are ignored; an empty table gives an empty result.
    """
    named = F.coalesce(F.col(f"`{path}`").cast("string"), F.lit(""))
    rows = files.select(F.col(f"`{key}`").alias("key"), named.alias("path"), F.col(f"`{text}`").alias("text"))
    own = saved(own_licences(rows, templates))
    name = F.regexp_extract("path", "[^/]*$", 0)
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license")))
    given = own.filter(name.rlike(LICENCE_FILE)).withColumn("licence_dir", _folder(F.col("path")))
    given = given.groupBy("licence_dir").agg(best.alias("given"))
    places = rows.select("key", "path").withColumn("dir", _folder(F.col("path")))
    parts = F.split("dir", "/")
    depths = F.sequence(F.lit(0), F.size(parts))
    above = F.transform(depths, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("licence_dir")))
    ladders = places.select("dir").distinct().select("dir", F.inline(F.array_distinct(above)))
    nearest = (
        ladders.join(given, "licence_dir")
        .groupBy("dir")
        .agg(F.max_by(F.struct("licence_dir", "given"), "depth").alias("near"))
    )
    joined = places.join(own, "path", "left").join(nearest, "dir", "left")
    return joined.select(
        F.col("key").alias(key),
        "path",
        F.coalesce("license", "near.given.license").alias("license"),
        F.coalesce("score", "near.given.score").alias("score"),
        F.when(F.col("license").isNotNull(), "own")
        .when(F.col("near").isNotNull(), "inherited")
        .otherwise("none")
        .alias("origin"),
        F.when(F.col("license").isNull(), F.col("near.licence_dir")).alias("licence_dir"),
    )
