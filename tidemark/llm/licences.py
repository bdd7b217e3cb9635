"""License scans in DataFrame functions: TF-IDF cosine to templates, then inheritance by directory.

The passages of a file are its lines, its paragraphs (runs of lines between lines without a
letter or digit, so that a header in comment marks is one), and, of licence files, the whole
text. Each distinct passage is a sparse vector of TF-IDF weights, as is each template: notices,
full texts, and SPDX lines. Weights come from the templates alone, a term that is in none has the
largest, so a file's licence does not depend on what else is scanned. A file's own licence is the
best match of its passages at or above ``LEAST``.

A cosine can't tell a licence from its sister that differs in a word. So a match counts only if the
passage has the template's telling words (``MARKS``, such as "lesser" or "non-commercial") and no other,
isn't a denial ("not licensed under"), and names the template's versions where it has any.

By the Cauchy-Schwarz inequality, a passage without any of a template's ``anchors`` has a cosine
below ``LEAST``: what is left of the template without them is too short. Passages without an
anchor of any template are left out before they are weighed, and no match is lost.

A file without a licence inherits from the licence file of its nearest ancestor directory:
distinct directories, not files, are expanded into their ancestors and joined with the
directories that have a licence file.

Defined results: a null or empty text has no licence of its own. Ties go to the licence that
sorts first, and of several licence files in a directory to the one whose path sorts first.
Every row has the licence of its own text, whatever its path; rows that repeat a path count
each. A null path has no directory and inherits nothing. Extra columns pass through untouched,
unless they have the name of a result. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.plans.lineage import cut, parts_for

LEAST = 0.7
#: Passages whose rows of an intermediate table lie in one file.
PASSAGES = 25_000
#: SPDX ids, notices as licences ask for them or as they are commonly worded, and short licence texts.
SPDX = (
    "AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only "
    "GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0"
).split()
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_REST = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
    "SUCH DAMAGE."
)
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation, either version "
    "{version} of the License, or (at your option) any later version."
)
_GNU_REST = (
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU {name}General Public License for more details. You should have received a copy of the GNU {name}General Public License along with this {what}."
)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Redistribution and use are permitted under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_TWO),
    ("BSD-2-Clause", f"{_BSD_TWO} {_BSD_REST}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD_TWO} {_BSD_THIRD}"),
    ("BSD-3-Clause", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_REST}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License, CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright is waived: CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "Licensed under the GPL, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "Licensed under the GPL, version 3."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
    ),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
]
for _id, _fill in (
    ("GPL-2.0", {"what": "program", "name": "", "version": "2"}),
    ("GPL-3.0", {"what": "program", "name": "", "version": "3"}),
    ("LGPL-2.1", {"what": "library", "name": "Lesser ", "version": "2.1"}),
    ("LGPL-3.0", {"what": "library", "name": "Lesser ", "version": "3"}),
    ("AGPL-3.0", {"what": "program", "name": "Affero ", "version": "3"}),
):
    TEMPLATES += [(_id, _GNU.format(**_fill)), (_id, f"{_GNU} {_GNU_REST}".format(**_fill))]
#: The titles that licence texts begin with.
TEMPLATES += [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License"),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License, CC BY-NC-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License, CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License, CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
TEMPLATES += [(re.sub("-(only|or-later)$", "", _id), f"SPDX-License-Identifier: {_id}") for _id in SPDX]

#: Words so common that as anchors they would let through most lines of any text.
COMMON = frozenset(
    "all and any are but can damage deal even file files for from have however into its law list loss may met more must name names nor not one other out over see sell shall should such that "
    "the their there these they this those use used was way were what which will with work would you your".split()
)
#: Words that tell a licence from its sisters, a denial, and versions.
MARKS = r"lesser|affero|noderiv[a-z]*|non-?commercial|share-?alike|by-n[cd](?:-[a-z]+)?|by-sa"
DENIAL = r"\bnot\b"
VERSION = r"[0-9]+\.[0-9]+"
_LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"
_TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_GAP = r"\n[^\pL\pN\n]*\n"


def _template_weights() -> tuple[dict[str, float], list[dict[str, float]]]:
    """The inverse document frequency of each template term, and each template's weights."""
    counts = [Counter(re.findall(_TERM, text.lower())) for _, text in TEMPLATES]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    return idf, [{t: (1 + math.log(n)) * idf[t] for t, n in c.items()} for c in counts]


IDF, WEIGHTS = _template_weights()
#: The weight of a term that is in no template.
RAREST = math.log(1 + len(TEMPLATES)) + 1


def anchors(least: float) -> list[str]:
    """Terms of which a passage has one at least if its cosine to any template is ``least`` or more."""
    found: set[str] = set()
    for weights in WEIGHTS:
        rest = norm = sum(w * w for w in weights.values())
        for t in sorted(weights, key=lambda t: (t in COMMON or len(t) < 3, -IDF[t], -len(t), t)):
            if rest < 0.999 * least * least * norm:
                break
            rest -= weights[t] ** 2
            found.add(t)
    return sorted(found)


def _terms(passage: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(passage), F.lit(_TERM), F.lit(0))


def _found(passage: Column | str, pattern: str) -> Column:
    """The different matches of a pattern in a passage, hyphens left out, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(passage), F.lit(pattern), F.lit(0)), lambda x: F.replace(x, F.lit("-"), F.lit("")))))


def telling(text: str) -> tuple[list[str], list[str], bool]:
    """The telling words of a template, its versions, and whether it has a denial."""
    every = lambda pattern: sorted({x.replace("-", "") for x in re.findall(pattern, text.lower())})
    return every(MARKS), every(VERSION), bool(re.search(DENIAL, text.lower()))


def match_passages(passages: DataFrame) -> DataFrame:
    """``p1, p2, licence, similarity``: the best template of each passage of ``passages(p1, p2, passage)`` that says nothing else."""
    spark = passages.sparkSession
    known = spark.createDataFrame(list(IDF.items()), "term string, idf double")
    rows = [(k, TEMPLATES[k][0], t, w / math.sqrt(sum(x * x for x in ws.values()))) for k, ws in enumerate(WEIGHTS) for t, w in ws.items()]
    templates = spark.createDataFrame(rows, "template int, licence string, term string, tw double")
    told = spark.createDataFrame([(k, *telling(text)) for k, (_, text) in enumerate(TEMPLATES)], "template int, t_marks array<string>, t_versions array<string>, t_denies boolean")
    # All that follows is grouped by the passage first, so that the passages' own distribution serves every step.
    terms = passages.select("p1", "p2", F.explode(_terms("passage")).alias("term")).groupBy("p1", "p2", "term").agg(F.count("*").alias("tf"))
    weight = ((1 + F.log("tf")) * F.coalesce("idf", F.lit(RAREST))).alias("w")
    weights = terms.join(F.broadcast(known), "term", "left").select("p1", "p2", "term", "idf", weight)
    met = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w")))  # as many as the templates have terms
    each = weights.groupBy("p1", "p2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), met.alias("met"))
    dot = each.select("p1", "p2", "norm", F.inline("met")).join(F.broadcast(templates), "term").groupBy("p1", "p2", "licence", "template", "norm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    said = passages.select("p1", "p2", _found("passage", MARKS).alias("marks"), _found("passage", VERSION).alias("versions"), F.lower("passage").rlike(DENIAL).alias("denies"))
    cosine = dot.join(said, ["p1", "p2"]).join(F.broadcast(told), "template")
    cosine = cosine.where("marks = t_marks AND (size(t_versions) = 0 OR versions = t_versions) AND (t_denies OR NOT denies)")
    cosine = cosine.select("p1", "p2", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity"))
    best = F.min_by(F.struct("licence", "similarity"), F.struct(-F.col("similarity"), F.col("licence")))
    return cosine.groupBy("p1", "p2").agg(best.alias("b")).select("p1", "p2", "b.licence", "b.similarity")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, with their depths; '' is the root."""
    parts = F.split(directory, "/")
    n = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("ancestor"), k.alias("depth")))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``files(path, text)`` with ``licence, similarity, licence_origin``.

    ``licence_origin`` is ``own``, or the directory that the licence is inherited from (``/`` for the root), or null.
    """
    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    named = F.coalesce(F.regexp_extract("path", "([^/]*)$", 1).rlike(_LICENCE_FILE), F.lit(False))
    keep = [c for c in files.columns if c not in ("licence", "similarity", "licence_origin", "__dir", "__file", "__t1", "__t2")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = F.array(*map(F.lit, anchors(least)))

    def anchored(passage: Column) -> Column:
        return F.arrays_overlap(_terms(passage), some)

    keys = (directory.alias("__dir"), named.alias("__file"), F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit("licence"), text).alias("__t2"))
    rows = files.select(*keep, *keys)
    whole = F.when(F.col("__file"), F.array("t")).otherwise(F.array().cast("array<string>"))
    passages = F.filter(F.array_distinct(F.concat(F.split("t", "\n"), F.split("t", _GAP), whole)), anchored)
    parts = files.select(text.alias("t"), *keys).where(anchored(F.col("t"))).select("__t1", "__t2", "__file", F.explode(passages).alias("passage"))
    parts = parts.select("*", F.xxhash64("passage").alias("p1"), F.xxhash64(F.lit("passage"), "passage").alias("p2"))
    parts = cut(parts.dropDuplicates(["__t1", "__t2", "__file", "p1", "p2"]))
    many = parts_for(parts.count(), PASSAGES)
    matched = match_passages(parts.select("p1", "p2", "passage").dropDuplicates(["p1", "p2"])).where(F.col("similarity") >= least)
    pick = F.min_by(F.struct("licence", "similarity"), F.struct(-F.col("similarity"), F.col("licence")))
    own = parts.select("__t1", "__t2", "__file", "p1", "p2").join(matched, ["p1", "p2"]).groupBy("__t1", "__t2", "__file").agg(pick.alias("own"))
    own = cut(own, many)
    known = rows.join(own, ["__t1", "__t2", "__file"], "left")

    licensed = files.select("path", *keys).where(F.col("__file")).join(own, ["__t1", "__t2", "__file"])
    licensed = licensed.groupBy("__dir").agg(F.min_by("own", F.struct("path", F.col("own.licence"), -F.col("own.similarity"))).alias("from")).withColumnRenamed("__dir", "ancestor")
    dirs = files.select(directory.alias("__dir")).where(F.col("__dir").isNotNull()).distinct().select("__dir", F.inline(ancestors(F.col("__dir"))))
    nearest = dirs.join(licensed, "ancestor").groupBy("__dir").agg(F.max_by(F.struct("ancestor", "from"), "depth").alias("up")).withColumnRenamed("__dir", "__d")
    out = known.join(nearest, F.col("__dir") == F.col("__d"), "left")
    root = F.when(F.col("up.ancestor") == "", F.lit("/")).otherwise(F.col("up.ancestor"))
    return out.select(
        *(F.col(c) for c in keep),
        F.coalesce("own.licence", "up.from.licence").alias("licence"),
        F.coalesce("own.similarity", "up.from.similarity").alias("similarity"),
        F.when(F.col("own").isNotNull(), F.lit("own")).otherwise(root).alias("licence_origin"),
    )
