"""Licence scans: a trained paragraph classifier with template confirmation. The scan is native DataFrame code only.

A paragraph is a line of a document, or a statement that wraps over several: neighbouring lines, without
a line between that has no words (comment marks aren't words), are scored joined, from every line on and
over as many lines as the longest template may need. Lines that are confirmed alone are in no such window;
of confirmed windows that overlap, the first stays, and of those from the same line the one that agrees
best, then the shortest. A window that stays stands for its lines. A sparse multinomial logistic regression over its distinct word
uni- and bigrams gives the probability of each licence family and of `unknown`. It is fitted on the
driver from the small labelled table below; a temperature, fitted on the part of the table that
training didn't see, calibrates it. A family is predicted if its calibrated probability is at least
`least`, and confirmed if the paragraph's words agree with one of the family's templates.

A paragraph without any n-gram of the model has the score of the biases alone, which is unknown by
construction (checked in fit), so only n-grams of the model are joined: the weight table grows with the
labelled table, never with the documents, and is broadcast.

Cases: null text has no paragraphs; blank lines aren't counted; equal scores go to the first family by
name; repeated paragraphs count each time; rows that repeat an id are told apart by their text's hash,
and equal rows get equal results; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm.common import ascii_lower, stage

UNKNOWN = "unknown"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: A line without words, and the end of the line before.
NO_WORDS = r"\n[^a-zA-Z0-9\n]*+(?=\n)"
#: Words that carry no meaning alone.
STOP = frozenset("a an and any are as at be by for from if in is it its no not of on or such that the this to under was were which will with you your 1 2 3 4 0 s c".split())

#: The labelled table. Statements as they are commonly written, in each family.
LABELLED: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0",
        "This project is distributed under the terms of the Apache License, Version 2.0",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the 2-clause BSD license",
        "This file is distributed under the terms of the new BSD License",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Content available under CC BY 3.0 unless otherwise noted", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC BY-NC-SA 4.0 for noncommercial use", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "This work is licensed under CC BY-SA 3.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0", "Released under CC0 into the public domain"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL v2 or later",
        "Released under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the LGPL v3",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT license",
        "This project is available under the terms of the MIT License.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0", "Released under the MPL 2.0"],
    UNKNOWN: [
        "She renewed her driving licence last week and the clerk was kind.",
        "The electrician is licensed in this state and works under a permit.",
        "Published under the name of a friend, version three of the story.",
        "All rights reserved by the publisher.",
        "The public library was released from its contract in general terms.",
        "Apache helicopters flew over the valley.",
        "He studied at MIT and later moved to Berkeley.",
        "The software was free of charge for students of the university.",
        "Permission to enter the building is granted by the owner.",
        "Version 2.0 of the report is available on request.",
        "A person obtaining help under the new law may ask for a copy.",
        "The creative work of the commons committee was shared with others.",
        "This work was done by the general manager and the public office.",
        "The source of the river and the form of the binary star are subjects of study.",
        "The international conference on foundation repair starts at 4.0 pm.",
        "Attribution of the painting to the master is under dispute.",
        "The license plate was found under the car.",
        "Free beer and free speech are different things to the foundation.",
        "The terms of the agreement were published by the ministry.",
        "Mozilla and other browsers show the page.",
        "The project is available to any person with a copy of the program.",
        "Distributed systems fail in general.",
    ],
}
RATE, ROUNDS, DECAY = 1.0, 1500, 5e-4
#: Calibrated probability from which a family is predicted, and agreement from which it is confirmed.
LEAST, AGREE = 0.5, 0.7


def tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def ngrams(words: list[str]) -> set[str]:
    """Unigrams that aren't stop words, and bigrams that aren't two of them."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP}
    return {w for w in words if w not in STOP} | pairs


class LicenceModel:
    def __init__(self, families: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float) -> None:
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature

    def probabilities(self, text: str) -> np.ndarray:
        z = (self.bias + sum((self.weights[g] for g in ngrams(tokens(text)) if g in self.weights), np.zeros(len(self.bias)))) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _ascent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(ROUNDS):
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        rest = (y - e / e.sum(axis=1, keepdims=True)) / len(x)
        w += RATE * (x.T @ rest - DECAY * w)
        b += RATE * rest.sum(axis=0)
    return w, b


def fit(labelled: dict[str, list[str]] | None = None) -> LicenceModel:
    labelled = labelled or LABELLED
    families = sorted(labelled)
    rows = [(families.index(f), ngrams(tokens(t)), k) for f in families for k, t in enumerate(labelled[f])]
    known = sorted({g for f, grams, _ in rows if families[f] != UNKNOWN for g in grams})
    at = {g: i for i, g in enumerate(known)}
    # A row without any n-gram stands for every paragraph that the model knows nothing of.
    x, y = np.zeros((len(rows) + 8, len(known))), np.zeros((len(rows) + 8, len(families)))
    for i, (f, grams, _) in enumerate(rows):
        y[i, f] = 1
        x[i, [at[g] for g in grams if g in at]] = 1
    y[len(rows) :, families.index(UNKNOWN)] = 1
    unseen = np.array([k % 3 == 2 for _, _, k in rows] + [False] * 8)
    w, b = _ascent(x[~unseen], y[~unseen])
    z, gold = x[unseen] @ w + b, y[unseen].argmax(axis=1)

    def loss(t: float) -> float:
        s = z / t
        top = s.max(axis=1)
        return float((np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(s)), gold]).mean())

    temperature = min(np.geomspace(0.25, 4, 33), key=loss)
    w, b = _ascent(x, y)
    model = LicenceModel(families, {g: w[i] for g, i in at.items()}, b, float(temperature))
    assert families[int(np.argmax(b))] == UNKNOWN, "an empty paragraph must be unknown"
    return model


def _inline(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _grams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def _scored(words: DataFrame, keys: list[str], model: LicenceModel, weights: DataFrame, unique: bool = False) -> DataFrame:
    """words: keys (unique: in one row each), _w. keys, _w, family, score, agreement of each that has an n-gram of the model."""
    families = model.families
    hits = words.select(*keys, "_w", F.explode(_grams(F.col("_w"))).alias("gram")).join(F.broadcast(weights), "gram")
    # Equal rows of a document would be summed together; copies is how many there are.
    counts = [] if unique else [F.count("*").alias("_c"), F.count_distinct("gram").alias("_g")]
    scored = hits.groupBy(*keys).agg(F.first("_w").alias("_w"), *counts, *[F.sum(F.col("w")[k]).alias(f"_z{k}") for k in range(len(families))])
    copies = F.lit(1) if unique else F.col("_c") / F.col("_g")
    logits = F.array(*[(F.col(f"_z{k}") / copies + float(model.bias[k])) / model.temperature for k in range(len(families))])
    best = scored.withColumn("_zs", logits).withColumn("_top", F.array_max("_zs"))
    best = best.withColumn("score", 1 / F.aggregate("_zs", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("_top"))))
    best = best.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in families]), F.array_position("_zs", F.col("_top")).cast("int")))
    templates = _inline(words.sparkSession, [{"family": f, "templates": [sorted(set(tokens(t))) for t in LABELLED.get(f, [])]} for f in families if f != UNKNOWN], "family:string,templates:array<array<string>>")
    own = F.array_distinct("_w")
    shared = F.transform("templates", lambda t: 2 * F.size(F.array_intersect(t, own)) / (F.size(t) + F.least(F.size(own), F.size(t))))
    out = best.join(F.broadcast(templates), "family", "left").withColumn("agreement", F.coalesce(F.array_max(shared), F.lit(0.0)))
    return out.select(*keys, "_w", "family", "score", "agreement")


def _windows(lines: DataFrame) -> DataFrame:
    """lines: _id, _h, _run, _line, _w, confirmed. _id, _h, _run, _first, _last, _w of neighbouring lines of a run.

    What lies between the first and the last line has fewer words than the longest template; lines without an n-gram of the model aren't in lines and count as one."""
    most = max(len(tokens(t)) for texts in LABELLED.values() for t in texts)
    runs = lines.groupBy("_id", "_h", "_run").agg(F.array_sort(F.collect_list(F.struct(F.col("_line").alias("line"), F.col("_w").alias("w"), F.col("confirmed").alias("ok")))).alias("a"))
    made = F.expr(f"""flatten(transform(sequence(0, size(a) - 2), i -> transform(
        aggregate(slice(a, i + 2, {most}), named_struct('inner', 0, 'at', a[i].line, 'open', NOT a[i].ok, 'w', a[i].w, 'out', CAST(array() AS array<struct<last:int,w:array<string>>>)),
            (s, x) -> IF(s.open AND NOT x.ok AND s.inner + x.line - s.at - 1 < {most},
                named_struct('inner', s.inner + x.line - s.at - 1 + size(x.w), 'at', x.line, 'open', true, 'w', concat(s.w, x.w), 'out', concat(s.out, array(named_struct('last', x.line, 'w', concat(s.w, x.w))))),
                named_struct('inner', s.inner, 'at', s.at, 'open', false, 'w', s.w, 'out', s.out))).out,
        o -> named_struct('first', a[i].line, 'last', o.last, 'w', o.w))))""")
    rows = runs.filter(F.size("a") > 1).select("_id", "_h", "_run", F.explode(made).alias("o"))
    return rows.select("_id", "_h", "_run", F.col("o.first").alias("_first"), F.col("o.last").alias("_last"), F.col("o.w").alias("_w"))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None, least: float = LEAST, agree: float = AGREE) -> DataFrame:
    """One row for each paragraph that is predicted a licence: id_col, _h (hash of the text), run (of lines with words, from 0), first and last (its lines in the run), family, score, agreement, confirmed."""
    model = model or fit()
    weights = _inline(docs.sparkSession, [{"gram": g, "w": [round(float(v), 6) for v in w]} for g, w in model.weights.items()], "gram:string,w:array<double>")
    runs = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.posexplode(F.split(F.col(text_col), NO_WORDS)).alias("_run", "_r"))
    lines = runs.select("_id", "_h", "_run", F.posexplode(F.split(F.col("_r"), "\n")).alias("_line", "_p"))
    words = lines.select("_id", "_h", "_run", "_line", F.regexp_extract_all(ascii_lower(F.col("_p")), F.lit(WORD), F.lit(0)).alias("_w"))
    predicted = (F.col("family") != UNKNOWN) & (F.col("score") >= least)
    alone = _scored(words, ["_id", "_h", "_run", "_line"], model, weights)
    alone = stage(alone.withColumn("predicted", predicted).withColumn("confirmed", predicted & (F.col("agreement") >= agree)), "licences-lines")
    joined = _scored(_windows(alone), ["_id", "_h", "_run", "_first", "_last"], model, weights, unique=True).filter(predicted & (F.col("agreement") >= agree))
    rest = ["family", "score", "agreement"]
    found = alone.filter("predicted").select("_id", "_h", "_run", F.col("_line").alias("_first"), F.col("_line").alias("_last"), *rest, "confirmed")
    found = found.unionByName(joined.select("_id", "_h", "_run", "_first", "_last", *rest, F.lit(True).alias("confirmed")))
    order = F.struct(F.col("_first").alias("first"), (~F.col("confirmed")).alias("open"), (-F.col("agreement")).alias("gap"), F.col("_last").alias("last"), F.col("family").alias("family"), F.col("score").alias("score"))
    kept = F.expr("""aggregate(f, named_struct('end', -1, 'out', slice(f, 1, 0)), (s, x) -> IF(x.first > s.end, named_struct('end', x.last, 'out', concat(s.out, array(x))), s)).out""")
    out = found.groupBy("_id", "_h", "_run").agg(F.array_sort(F.collect_list(order)).alias("f")).select("_id", "_h", "_run", F.explode(kept).alias("x"))
    x = F.col("x")
    return out.select(F.col("_id").alias(id_col), "_h", F.col("_run").alias("run"), x["first"].alias("first"), x["last"].alias("last"), x["family"].alias("family"), x["score"].alias("score"), (-x["gap"]).alias("agreement"), (~x["open"]).alias("confirmed"))


def licence_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """One row for each of docs: id_col, n_paragraphs (lines that aren't blank), n_predicted, n_confirmed, families (confirmed, sorted, comma-joined), best_score."""
    found = scan_licences(docs, id_col, text_col, model).groupBy(F.col(id_col).alias("_id"), "_h").agg(
        F.count("*").alias("_n"), F.count_if("confirmed").alias("_ok"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("_f"), F.max("score").alias("_s")
    )
    lines = F.coalesce(F.size(F.filter(F.split(F.col(text_col), "\n"), lambda p: F.trim(p) != "")), F.lit(0))
    rows = docs.select(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_k"), F.when(F.col(text_col).isNull(), 0).otherwise(lines).cast("long").alias("n_paragraphs"))
    out = rows.join(found, [rows["_i"].eqNullSafe(found["_id"]), rows["_k"] == found["_h"]], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_i").alias(id_col), "n_paragraphs", F.coalesce("_n", zero).alias("n_predicted"), F.coalesce("_ok", zero).alias("n_confirmed"), F.coalesce("_f", F.lit("")).alias("families"), F.round(F.coalesce("_s", F.lit(0.0)), 6).alias("best_score")
    )
