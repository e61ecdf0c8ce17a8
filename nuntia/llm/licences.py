"""Licence scan with DataFrame functions alone.

Paragraphs (lines; long ones in overlapping windows of words) that hold a word of licence notices are classified by a
multinomial logistic regression over the words and word pairs that occur in them. It is trained here on notices of the
licence families and on ordinary sentences about licences, permissions and copyright, which form the class `unknown`;
a temperature fitted on held-out variants of the notices calibrates the probabilities. A prediction is confirmed by
comparison with the family's templates: of the words of one of them, at least CONFIRM must occur. What isn't
confirmed, or isn't likely enough, is reported as `unknown`.

Notices that are wrapped are read on: the last REACH words of a line are joined with up to REACH words of the non-blank
lines below it (a line of comment marks only is blank), and classified together. The notice is reported at the line where
it begins, as one window more than the line has, if the joined words confirm a family that the line doesn't, by more
of a template's words than either part has. A line that continues such a notice is not reported for the part that it
holds: a line `General Public License` after `GNU Lesser` is no `gpl`.

The few hundred weights are constants of the query plan, so paragraphs are scored where they are read: no join, no
shuffle, no grouping of paragraphs that many documents share.

Defined results: null and empty texts, and texts without licence words, give no rows; a repeated paragraph is reported
at each place, repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nuntia.llm.common import table

UNKNOWN, CONFIRM, LIKELY = "unknown", 0.7, 0.5
WINDOW, STRIDE, REACH = 120, 60, 60
GATE = r"(?i:licen[cs]|copyright|copyleft|public\W+domain|creative\W+commons|spdx|warrant|redistribut|permission)|\b(?:(?i:[AL]?GPL|MPL|E?UPL|EPL|OFL|BSL|WTFPL)|MIT|BSD|Apache|Mozilla|Zlib|CC0|CC[\W_]+BY|ISC)(?:[vV]?\d[\d.]*)?(?!\w)"
#: Where a version is glued to a name, or a v to its number; CC0 is one word.
GLUED = r"(?<=[a-z])(?<!\bcc)(v?)(?=[0-9])"
SOME = r"[\p{L}\p{N}]"
#: How notices of each family read.
NOTICES = {
    "agpl": ("GNU Affero General Public License", "licensed under the GNU Affero General Public License, version 3", "AGPL-3.0", "AGPL v3", "licensed under the AGPL v3", "GNU Affero General Public License as published by the Free Software Foundation"),
    "apache": ("Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Apache-2.0", "distributed under the Apache 2.0 license", "Apache Software License", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    "artistic": ("Artistic License 2.0", "Artistic-2.0", "under the terms of the Artistic License", "released under the Perl Artistic License"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSD 3-Clause License", "released under the BSD license", "licensed under the BSD 2-Clause License", "BSD-3-Clause"),
    "bsl": ("Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0", "BSL-1.0", "licensed under the Boost Software License"),
    "cc-by": ("Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0", "available under the CC BY 4.0 license", "CC-BY-4.0"),
    "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0", "available under the CC BY-NC-SA 4.0 license", "CC-BY-NC-4.0"),
    "cc-by-nc-nd": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Licensed under CC BY-NC-ND 4.0", "available under the CC BY-NC-ND 4.0 license", "CC-BY-NC-ND-4.0"),
    "cc-by-nd": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0", "available under the CC BY-ND 4.0 license", "CC-BY-ND-4.0"),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0", "available under the CC BY-SA 3.0 license", "CC-BY-SA-4.0"),
    "cc0": ("CC0 1.0 Universal public domain dedication", "dedicated to the public domain under CC0", "CC0-1.0"),
    "epl": ("Eclipse Public License v. 2.0", "made available under the terms of the Eclipse Public License", "EPL-2.0", "licensed under the EPL v1.0", "Eclipse Public License - v 1.0"),
    "eupl": ("Licensed under the EUPL, Version 1.2", "European Union Public Licence", "EUPL-1.2", "licensed under the EUPL v1.1", "released under the European Union Public License"),
    "gpl": ("licensed under the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation", "released under the GPL v3", "GPL-3.0-or-later", "GPL v3", "GPL v2", "distributed under the GNU GPL version 2", "GPL-2.0-only", "released under the GPL v2 or later", "licensed under the GPL"),
    "isc": ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "ISC License", "released under the ISC license"),
    "lgpl": ("licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1-or-later", "LGPL v3", "LGPL v2.1", "distributed under the LGPL v3", "GNU Library General Public License", "GNU Lesser General Public License as published by the Free Software Foundation"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT License", "licensed under the terms of the MIT license"),
    "mpl": ("subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL-2.0", "licensed under the MPL 2.0", "MPL v2", "MPL v1.1", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    "ofl": ("licensed under the SIL Open Font License, Version 1.1", "SIL Open Font License", "OFL-1.1", "released under the Open Font License"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "released under the Unlicense", "The Unlicense"),
    "wtfpl": ("licensed under the WTFPL", "Do What The Fuck You Want To Public License", "released under the WTFPL license"),
    "zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "zlib License", "released under the zlib/libpng license", "SPDX Zlib"),
}
#: Sentences with the same words that name no family.
ORDINARY = (
    "All rights reserved", "Copyright the authors", "used with permission", "without any warranty", "a driving licence is required",
    "see the license for details", "licensed under the terms below", "this software is released under a commercial license",
    "no permission is granted to copy or redistribute", "the permission to use the file was denied", "a professor at MIT", "the Apache helicopter",
    "the warranty covers parts", "software may be distributed with the product", "the license expires next year", "in the public interest and the public domain",
    "redistribution of income", "released in version 2.0 of the software", "Version 3 was released", "general public", "foundation of the free library", "mozilla browser", "creative commons in the city",
)
#: What stands around a notice in the variants that are learned from.
BEFORE = ("", "this work is", "this file is", "the project and its documentation are", "SPDX-License-Identifier:", "code is")
AFTER = ("", "see the license for details", "all rights reserved", "copyright the authors", "you may not use this file except in compliance")
COMMON = frozenset("a an and any are as at be by for from in is it its may not of on or that the this to under was with you".split())


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]
    features: tuple[str, ...]
    weights: np.ndarray  # features x classes
    bias: np.ndarray


def words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub(GLUED, r" \1 ", text.lower()))


def features(text: str) -> set[str]:
    w = words(text)
    return {x for x in w if x not in COMMON} | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


@lru_cache(maxsize=1)
def fitted(epochs: int = 300, rate: float = 0.5, decay: float = 1e-3) -> LicenceModel:
    """Full-batch training by gradient descent on the variants above; every fifth variant calibrates."""
    classes = (*sorted(NOTICES), UNKNOWN)
    rows = [(f"{b} {n} {a}", k) for k, notices in NOTICES.items() for n in notices for b in BEFORE for a in AFTER]
    rows += [(f"{b} {n} {a}", UNKNOWN) for n in (*ORDINARY, "") for b in BEFORE for a in AFTER for _ in range(2)]
    known = sorted({f for t, _ in rows for f in features(t)})
    place = {f: i for i, f in enumerate(known)}
    x = np.zeros((len(rows), len(known)), np.float32)
    for i, (t, _) in enumerate(rows):
        x[i, [place[f] for f in features(t)]] = 1
    y = np.array([classes.index(k) for _, k in rows])
    share = np.bincount(y, minlength=len(classes))
    hold = np.arange(len(rows)) % 5 == 4
    w, b = np.zeros((len(known), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    a, target, weight = x[~hold], np.eye(len(classes), dtype=np.float32)[y[~hold]], (1 / share[y[~hold]])[:, None]
    weight = weight / weight.sum()

    def softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    g2w, g2b = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(epochs):
        d = (softmax(a @ w + b) - target) * weight
        gw, gb = a.T @ d + decay * w / len(known), d.sum(0)
        g2w, g2b = g2w + gw**2, g2b + gb**2
        w, b = w - rate * gw / np.sqrt(g2w), b - rate * gb / np.sqrt(g2b)
    z, own = x[hold] @ w + b, y[hold]
    heat = min(np.geomspace(0.3, 6, 40), key=lambda t: -np.log(softmax(z / t)[np.arange(len(own)), own] + 1e-12).mean())
    return LicenceModel(classes, tuple(known), (w / heat).astype(np.float64), (b / heat).astype(np.float64))


def literals(values: list[str]) -> Column:
    """An array of words, as one literal: the planner is handed one text, not thousands of values."""
    return F.split(F.lit("\n".join(values)), "\n")


def numbers(values: np.ndarray) -> Column:
    return literals([repr(float(v)) for v in values]).cast("array<double>")


def spoken(text: Column) -> Column:
    """Words a-z0-9 of a text, in lower case, with versions apart from names."""
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(text), GLUED, " $1 "), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def alike(said: Column, family: Column) -> Column:
    """The largest share of a template's words that occur, over the templates of a family."""
    likeness = F.lit(0.0)
    for k, notices in NOTICES.items():
        each = [F.size(F.array_intersect(said, literals(sorted(set(words(n)))))) / len(set(words(n))) for n in notices]
        likeness = F.when(family == k, F.greatest(*each)).otherwise(likeness)
    return likeness


def sure(c: Column) -> Column:
    """The family if it is likely and confirmed, or else unknown."""
    return F.when((c["probability"] >= LIKELY) & (c["likeness"] >= CONFIRM), c["family"]).otherwise(UNKNOWN)


def template_words(family: Column) -> Column:
    out = F.array().cast("array<string>")
    for k, notices in NOTICES.items():
        out = F.when(family == k, literals(sorted({w for n in notices for w in words(n)}))).otherwise(out)
    return out


def classified(said: Column, model: LicenceModel) -> Column:
    """(family, probability, likeness) of an array of words."""
    place = F.map_from_arrays(literals(list(model.features)), F.sequence(F.lit(1), F.lit(len(model.features))))
    pairs = F.zip_with(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    known = F.filter(F.transform(F.array_distinct(F.concat(said, pairs)), lambda g: F.try_element_at(place, g)), lambda i: i.isNotNull())

    def summed(ids: Column, bias: float, column: Column) -> Column:
        return F.aggregate(ids, F.lit(float(bias)), lambda acc, i: acc + F.element_at(column, i))

    def scored(ids: Column) -> Column:
        columns = [numbers(model.weights[:, k]) for k in range(len(model.classes))]
        return F.array(*[summed(ids, b, c) for b, c in zip(model.bias, columns, strict=True)])

    def chosen(logits: Column) -> Column:
        top = F.array_max(logits)
        total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
        family = F.element_at(literals(list(model.classes)), F.array_position(logits, top).cast("int"))
        return F.struct(family.alias("family"), (1 / total).alias("probability"))

    def compared(c: Column) -> Column:
        return F.struct(c["family"].alias("family"), c["probability"].alias("probability"), alike(said, c["family"]).alias("likeness"))

    step = F.array(known)
    for f in (scored, chosen, compared):  # one-element arrays bind each step's value once
        step = F.transform(step, f)
    return F.element_at(step, 1)


def licence_paragraphs(documents: DataFrame, model: LicenceModel | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows for all paragraphs with licence words: id, paragraph and window (from 0), family, probability, likeness, content."""
    model = model or fitted()
    text = F.col(text_column)
    lines = documents.where(text.rlike(GATE)).select(id_column, F.split(text, "\n").alias("lines"))

    def at(i: Column) -> Column:
        """The line i (from 0), or an empty one outside the text."""
        return F.when(i >= 0, F.coalesce(F.get("lines", i), F.lit(""))).otherwise("")

    def place(i: Column) -> Column:
        """Only lines that may hold or begin a notice, or that continue the line above."""
        near = F.when(F.concat_ws("\n", at(i), at(i + 1)).rlike(GATE), F.struct(i.alias("paragraph"), at(i).alias("content"), at(i - 1).alias("above")))
        return F.when(at(i).rlike(SOME), near)

    def read_on(below: Column) -> Column:
        """The first words of lines, up to a blank one."""
        end = F.array_position(F.transform(below, lambda v: v.rlike(SOME)), False)
        upto = F.when(end > 0, F.slice(below, 1, F.greatest(end.cast("int") - 1, F.lit(0)))).otherwise(below)
        return F.slice(F.aggregate(upto, F.array().cast("array<string>"), lambda acc, v: F.when(F.size(acc) >= REACH, acc).otherwise(F.concat(acc, spoken(v)))), 1, REACH)

    places = F.filter(F.transform(F.sequence(F.lit(0), F.size("lines") - 1), place), lambda v: v.isNotNull())
    hit = lines.select(id_column, "lines", F.explode(places).alias("p")).select(id_column, "p.*", F.slice("lines", F.col("p.paragraph") + 2, REACH).alias("below"))
    said = hit.select(id_column, "paragraph", "content", spoken(F.col("content")).alias("said"), spoken(F.col("above")).alias("above"), read_on(F.col("below")).alias("below"))
    starts = F.when(F.col("content").rlike(GATE), F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("said") - (WINDOW - STRIDE) - 1), F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    parts = said.select("*", F.posexplode(F.concat(starts, F.array(F.lit(-1)))).alias("window", "start"))
    tail = lambda c: F.slice(c, F.greatest(F.size(c) - REACH + 1, F.lit(1)), REACH)
    alone, nothing = F.col("start") >= 0, F.array().cast("array<string>")
    here = F.when(alone, F.slice("said", F.greatest(F.col("start") + 1, F.lit(1)), WINDOW)).otherwise(nothing)
    one = F.when(~alone, tail(F.col("said"))).when(F.col("start") == 0, tail(F.col("above"))).otherwise(nothing)
    two = F.when(~alone, F.col("below")).when(F.col("start") == 0, F.slice("said", 1, REACH)).otherwise(nothing)
    joined = F.when((F.size(one) > 0) & (F.size(two) > 0), F.array(here, F.concat(one, two), one, two)).otherwise(F.array(here))

    def result(v: Column) -> Column:
        """What a row reports: its window, unless that continues the line above, or what begins in it and goes on below."""
        said_, c = v["said"], v["c"]
        own, over = F.get(c, 0), F.get(c, 1)
        family = over["family"]
        more = [alike(F.get(said_, k), family) < over["likeness"] for k in (2, 3)]
        crosses = F.coalesce((sure(over) != UNKNOWN) & (sure(F.get(c, 2)) != family) & more[0] & more[1], F.lit(False))
        rest = F.array_except(F.array_intersect(F.get(said_, 0), template_words(own["family"])), template_words(family))
        continued = crosses & (sure(own) != UNKNOWN) & (family != own["family"]) & (F.size(rest) == 0)
        return F.when(v["alone"], F.when(~continued, own)).otherwise(F.when(crosses, over))

    step = F.array(F.struct(alone.alias("alone"), joined.alias("said")))
    step = F.transform(step, lambda v: F.struct(v["alone"].alias("alone"), v["said"].alias("said"), F.transform(v["said"], lambda w: classified(w, model)).alias("c")))
    found = F.filter(F.transform(step, result), lambda c: c.isNotNull())
    judged = parts.select(id_column, "paragraph", "window", "content", F.explode(found).alias("c"))
    return judged.select(id_column, "paragraph", "window", sure(F.col("c")).alias("family"), F.col("c.probability").alias("probability"), F.col("c.likeness").alias("likeness"), "content")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in documents with licence words: doc_id, paragraph, window, family (or unknown), probability, likeness."""
    return licence_paragraphs(table(spark, sf_dir, "documents")).drop("content")
