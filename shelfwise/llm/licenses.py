"""Licence scans: a paragraph classifier in DataFrame operations.

A paragraph is a line with the lines that go on in it: a line that does not end a sentence is joined with a next one that
begins in lower case, so wrapped licence texts are judged whole. Features are all its word n-grams (one to three words,
lower case, versions split from short names: "LGPLv3" is "lgpl 3"), hashed into BUCKETS. No word decides beforehand what
may be a licence. For each licence family there is a logistic regression over these sparse features, and one more for
"any licence at all", which every paragraph goes through. A paragraph that this one passes, but whose best family stays
under its calibrated bound or isn't confirmed by comparison with the family's templates (by the n-grams' 64-bit hashes,
not by buckets), is of the class `unknown`. Paragraphs that pass are scored again with the weights of n-grams seen in
training alone, by their 64-bit hashes, so that n-grams which share a bucket with one of them don't count.

The regressions are trained on the templates below and on paragraphs of at most SAMPLE_DOCS documents, at most SAMPLE of
them and together SAMPLE_BYTES long, as counter-examples; that is a small loop on the driver. Bounds are calibrated on
examples held out from it: the bound of "any" lets none of the held-out counter-examples pass where it can.

Scoring is native: split, array functions with the weights as a constant array, and for the few paragraphs found a join
with the templates, whose number is fixed.

Defined results: null or empty texts have no paragraph with a word; very long texts and paragraphs are read whole; rows
with a null doc_id take no part; rows that repeat a doc_id give their paragraphs each; of families with one probability
the last in the alphabet counts; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common

SAMPLE, SAMPLE_DOCS, SAMPLE_BYTES, SEED = 2000, 400, 4 << 20, 3
#: Buckets of n-grams, and the smallest weight that is kept.
BUCKETS, LEAST = 1 << 17, 0.02
#: Shares of held-out examples that a family's bound and that of "any" let through, and of n-grams that a paragraph shares with a template.
PASSES, ANY_PASSES, CONFIRMS = 0.95, 0.99, 0.5
UNKNOWN, START = "unknown", "^"

# Short names that versions are written to, and typical sentences of each family.
VERSIONED = "(?<![a-z0-9])([al]?gpl|[me]pl|eupl|cc|bsd|apache)v?(?=[0-9])"
TEMPLATES = {
    "mit": """Released under the MIT License.
Released under MIT terms.
Licensed under the MIT License.
This project is licensed under the terms of the MIT license.
SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Apache License
Apache-2.0
Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Released under the Apache License 2.0.
SPDX-License-Identifier: Apache-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """Distributed under LGPLv3 or later.
Distributed under AGPLv3 or later.
Distributed under GPLv3
GPLv2
LGPL-2.1
AGPLv3
This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This library is licensed under the GNU Lesser General Public License, version 2.1.
SPDX-License-Identifier: GPL-3.0-or-later
Released under the GNU General Public License, version 2.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Released under the BSD License.
Licensed under the 3-Clause BSD License.
SPDX-License-Identifier: BSD-3-Clause
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "cc": """CC0 1.0 Universal
Dedicated to the public domain under CC0.
CC BY-SA 4.0
Licensed under CC BY-NC 4.0.
Licensed under CC BY 4.0.
Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.
SPDX-License-Identifier: CC-BY-4.0
Content is available under the Creative Commons Attribution-ShareAlike License.""",
    "mpl": """MPL-2.0
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
Licensed under the Mozilla Public License 2.0.
SPDX-License-Identifier: MPL-2.0
If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.""",
    "reserved": """All rights reserved.
Copyright 2020 the author. All rights reserved.
No part of this publication may be reproduced without the prior written permission of the copyright holder.
This material is proprietary and confidential; all rights are reserved by the copyright owner.""",
}
#: Licences of no family: they train "any licence" alone, so that `unknown` has examples.
OTHERS = """Licensed under the Eclipse Public License, version 2.0.
Released under the zlib License.
This is free and unencumbered software released into the public domain.
Licensed under the Artistic License.
Distributed under the Boost Software License, Version 1.0.
This work is licensed under the Open Data Commons Open Database License.
EPL-2.0
Released under EPL-1.0.
ISC License
Dedicated to the public domain.
SPDX-License-Identifier: ISC
Released under the WTFPL, version 2.
Available under the ISC license or the zlib license."""
#: Sentences with licence words that license nothing.
NEITHER = """He asked for permission to leave the room.
The public domain of the city is open to all.
Her driving licence was renewed in the spring.
The warranty of the machine ends next year.
A table had been reserved for four people.
The Apache helicopters flew over the base.
Students at MIT met their professor.
The creative team met in the commons.
Copyright law is taught in the second year.
The general public was not admitted.
He scored twice in the EPL last season.
Please cc me when you reply.
He studied under the MIT professor for two years."""

NO_WORD = "[^a-z0-9\\u00e0-\\u024f]+"
#: Where a paragraph ends: at a line feed whose line ends a sentence or is blank, or whose next line doesn't go on in lower case.
BREAK = '\\n(?:(?![ \\t]*[a-z0-9("])|(?<=[.!?:;\\n]\\n))'
_NO_WORD, _VERSIONED = re.compile(NO_WORD), re.compile(VERSIONED)


def words_of(text: str) -> list[str]:
    return [w for w in _NO_WORD.split(_VERSIONED.sub(r"\1 ", text.lower())) if w]


def _hash(*words: str) -> int:
    """As Spark's xxhash64: each hash is the next one's seed."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def hashes_of(words: list[str]) -> list[int]:
    """For each word the hashes of it, of it with the one before, and with the two before; a mark stands before the first."""
    out, a, b = [], START, START
    for w in words:
        out += [_hash(w), _hash(b, w), _hash(a, b, w)]
        a, b = b, w
    return out


class Row:
    """A training example: its buckets with their counts, and one over the root of its number of words."""

    def __init__(self, text: str, family: str):
        words = words_of(text)
        every = hashes_of(words)
        self.hashes, self.family, self.scale = set(every), family, max(1, len(words)) ** -0.5
        self.at, self.counts = np.unique(np.array([h & BUCKETS - 1 for h in every], np.int64), return_counts=True)


def _varied(text: str, filler: list[str], rng: random.Random) -> str:
    """A template with a different number or name in it, cut at an end, or among other words."""
    words = text.split()
    if len(words) > 8 and rng.random() < 0.4:
        keep = rng.randint(6, len(words))
        words = words[:keep] if rng.random() < 0.5 else words[-keep:]
    if rng.random() < 0.3:
        words = [rng.choice(filler) for _ in range(rng.randint(1, 6))] + words
    if rng.random() < 0.3:
        words = words + [rng.choice(filler) for _ in range(rng.randint(1, 6))]
    return " ".join(str(rng.randint(1, 9)) + w[1:] if w[:1].isdigit() and rng.random() < 0.5 else w for w in words)


def _probabilities(w: np.ndarray, bias: np.ndarray, row: Row) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(bias + (w[:, row.at] @ row.counts) * row.scale, -30, 30)))


def _descend(rows: list[Row], targets: np.ndarray, turns: int = 20, rate: float = 0.5, hold: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of all regressions by stochastic gradients; targets: (rows, regressions)."""
    w, bias, rng = np.zeros((targets.shape[1], BUCKETS)), np.full(targets.shape[1], -2.0), np.random.default_rng(SEED)
    for turn in range(turns):
        step = rate / (1 + 0.1 * turn)
        for k in rng.permutation(len(rows)):
            r = rows[k]
            off = _probabilities(w, bias, r) - targets[k]
            if np.abs(off).max() < 0.02:
                continue
            bias -= 0.1 * step * off
            w[:, r.at] = w[:, r.at] * (1 - step * hold) - step * off[:, None] * (r.counts * r.scale)
    w[np.abs(w) < LEAST] = 0
    return np.round(w, 3), np.round(bias, 6)


def likeness(own: set[int], template: set[int]) -> float:
    return len(own & template) / max(1, min(len(own), len(template)))


def train(counter: list[str], copies: int = 12) -> dict:
    """names (families, then "any"), weights, bias, bounds, and how the held-out variations of each family fare."""
    rng = random.Random(SEED)
    filler = [w for c in counter for w in c.split()] or ["text"]
    rows: list[Row] = []
    held: list[Row] = []
    for family, text in [*TEMPLATES.items(), (UNKNOWN, OTHERS), ("", NEITHER)]:
        for sentence in text.split("\n"):
            rows.append(Row(sentence, family))
            if len(words_of(sentence)) > 4:  # how such a sentence begins is no licence yet
                rows.append(Row(words_of(sentence)[0], ""))
            for n in range(copies):
                (held if n % 4 == 3 else rows).append(Row(_varied(sentence, filler, rng), family))
    templates = {f: [set(hashes_of(words_of(s))) for s in text.split("\n")] for f, text in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]}
    for k, c in enumerate(counter):
        own = Row(c, "")
        if not any(likeness(own.hashes, t) >= CONFIRMS for ts in templates.values() for t in ts):  # the corpus has licences too
            (held if k % 4 == 3 else rows).append(own)
    names = [*TEMPLATES, "any"]
    targets = np.array([[float(r.family == f) for f in TEMPLATES] + [float(r.family != "")] for r in rows])
    w, bias = _descend(rows, targets)
    p = [_probabilities(w, bias, r) for r in held]
    of = lambda k, keep: sorted(x[k] for x, r in zip(p, held, strict=True) if keep(r.family) and len(r.at)) or [0.5]
    low = lambda xs, passes=PASSES: xs[int(len(xs) * (1 - passes))]
    bounds = [min(0.5, low(of(k, lambda f, own=f: f == own))) for k, f in enumerate(TEMPLATES)]
    bounds.append(max(0.5, min(1.01 * of(-1, lambda f: f == "")[-1], low(of(-1, lambda f: f != ""), ANY_PASSES))))
    report = {}
    for x, r in zip(p, held, strict=True):
        best = max(range(len(TEMPLATES)), key=lambda k: (x[k], names[k]))
        sure = x[best] >= bounds[best] and max(likeness(r.hashes, t) for t in templates[names[best]]) >= CONFIRMS
        said = "missed" if x[-1] < bounds[-1] else names[best] if sure else UNKNOWN
        found = report.setdefault(r.family or "no licence", {})
        found[said] = found.get(said, 0) + 1
    seen = np.array(sorted({h for r in rows for h in r.hashes}), np.uint64)
    seen = seen[w[:, (seen & np.uint64(BUCKETS - 1)).astype(np.int64)].any(0)]
    return {"names": names, "weights": w, "bias": bias, "bounds": np.round(bounds, 6), "seen": seen, "held_out": report}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), VERSIONED, "$1 "), NO_WORD), "")


def _score(words: Column, weights: np.ndarray, bias: float) -> Column:
    """A regression's probability, in one pass over the words that keeps the two before."""
    table = F.split(F.lit(",".join(f"{x:g}" for x in weights)), ",").cast("array<double>")
    weight = lambda *w: F.get(table, F.xxhash64(*w).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    mark = F.lit(START)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), mark.alias("a"), mark.alias("b"))
    step = lambda x, w: F.struct((x["s"] + weight(w) + weight(x["b"], w) + weight(x["a"], x["b"], w)).alias("s"), (x["n"] + 1).alias("n"), x["b"].alias("a"), w.alias("b"))
    return F.aggregate(words, start, step, lambda x: 1 / (1 + F.exp(-(F.lit(float(bias)) + x["s"] / F.sqrt(F.greatest(x["n"], F.lit(1)))))))


def _hashes(words: Column, distinct: bool = True) -> Column:
    """The hashes of a short list of words; words is bound once."""

    def of(ws: Column) -> Column:
        at = lambda i: F.coalesce(F.get(ws, i), F.lit(START))
        found = F.flatten(F.transform(ws, lambda w, i: F.array(F.xxhash64(w), F.xxhash64(at(i - 1), w), F.xxhash64(at(i - 2), at(i - 1), w))))
        return F.array_distinct(found) if distinct else found

    return F.element_at(F.transform(F.array(words), of), 1)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, text); row tells repeated doc_ids apart."""
    own = common.own_ids(docs).where("text <> ''").withColumn("row", F.monotonically_increasing_id())
    return own.select("doc_id", "row", F.posexplode(F.split("text", BREAK)).alias("paragraph", "text"))


def counter_examples(docs: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> list[str]:
    some = common.written(common.smallest(common.own_ids(docs).where("text <> ''"), SAMPLE_DOCS, "doc_id"), "licence-sample")
    lines = common.smallest(paragraphs(some).where("trim(text) <> ''"), sample, "doc_id", "paragraph", "text")
    return [r.text for r in common.within(lines, F.octet_length("text"), most, "doc_id", "paragraph", "text").orderBy("doc_id", "paragraph", "text").collect()]


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, paragraph (from 0), family, probability, similarity, confirmed: a row for each paragraph that looks like a licence."""
    spark, model = docs.sparkSession, train(counter_examples(docs, sample))
    names, bounds, keys = model["names"], [float(x) for x in model["bounds"]], ["doc_id", "row", "paragraph"]
    score = _score(_words(F.col("text")), model["weights"][-1], model["bias"][-1])
    found = paragraphs(docs).where(score >= bounds[-1]).select(*keys, _hashes(_words(F.col("text")), False).alias("all"))
    found = common.written(found, "licence-paragraphs")
    table = lambda rows, kind: spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))
    own = model["weights"][:, (model["seen"] & np.uint64(BUCKETS - 1)).astype(np.int64)].T
    weights = table([{"hash": int(h), "w": w.tolist()} for h, w in zip(model["seen"].view(np.int64), own, strict=True)], "hash:long,w:array<double>")  # of the training sample, so bounded
    each = found.select(*keys, F.size("all").alias("n"), F.explode("all").alias("hash"))
    each = each.join(F.broadcast(weights), "hash", "left").groupBy(*keys).agg(F.first("n").alias("n"), *(F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in range(len(names))))
    p = lambda k: 1 / (1 + F.exp(-(F.lit(float(model["bias"][k])) + F.col(f"s{k}") / F.sqrt(F.col("n") / 3))))
    best = F.array_max(F.array(*(F.struct(p(k).alias("p"), F.lit(f).alias("family"), F.lit(bounds[k]).alias("bound")) for k, f in enumerate(names[:-1]))))
    best = each.select(*(F.col(k).alias("_" + k) for k in keys), best.alias("best"), p(-1 % len(names)).alias("any")).where(F.col("any") >= bounds[-1])
    judged = found.withColumn("hashes", F.array_distinct("all")).join(best.hint("merge"), [F.col(k) == F.col("_" + k) for k in keys]).drop("all", *("_" + k for k in keys))
    templates = table([{"of": f, "template": s} for f, text in TEMPLATES.items() for s in text.split("\n")], "of:string,template:string")
    templates = templates.select("of", _hashes(_words(F.col("template"))).alias("template"))
    near = judged.join(F.broadcast(templates), F.col("best.family") == F.col("of"))  # the templates' number is fixed
    shared = F.size(F.array_intersect("hashes", "template")) / F.greatest(F.lit(1), F.least(F.size("hashes"), F.size("template")))
    scored = near.groupBy(*keys).agg(F.first("any").alias("any"), F.first("best").alias("best"), F.max(shared).alias("similarity"))
    sure = (F.col("best.p") >= F.col("best.bound")) & (F.col("similarity") >= CONFIRMS)
    return scored.select("doc_id", "paragraph", F.when(sure, F.col("best.family")).otherwise(UNKNOWN).alias("family"), F.when(sure, F.col("best.p")).otherwise(F.col("any")).alias("probability"), "similarity", sure.alias("confirmed"))
