import math
import re
from collections import Counter

from tidemark.llm import licences

FILES = [
    ("a/LICENSE", "Released under the MIT License."),
    ("a/b/LICENSE.txt", "x\nLicensed under the Apache License, Version 2.0.\n"),
    ("a/b/c/d.py", "print()"),
    ("a/e.py", None),
    ("a/b/own.py", "# This work is licensed under the GNU General Public License, version 3.\n" + "text " * 5000),
    ("f/g.py", "Copyright notices and licences in general are another matter entirely, as one might well say."),
    ("COPYING", "Licensed under CC BY-NC 4.0."),
    ("top.py", ""),
    (None, "Released under the MIT License."),
    (None, ""),
    ("a/e.py", None),
]


def test_inheritance(spark):
    df = spark.createDataFrame([(*f, "mine", 1) for f in FILES], "path string, text string, licence string, n long")
    rows = licences.scan(df).collect()
    assert len(rows) == len(FILES)
    got = {r.path: (r.licence, r.licence_origin) for r in rows if r.path}
    assert sorted((r.licence or "", r.licence_origin or "") for r in rows if r.path is None) == [("", ""), ("MIT", "own")]
    assert got == {
        "a/LICENSE": ("MIT", "own"),
        "a/b/LICENSE.txt": ("Apache-2.0", "own"),
        "a/b/c/d.py": ("Apache-2.0", "a/b"),
        "a/e.py": ("MIT", "a"),
        "a/b/own.py": ("GPL-3.0", "own"),
        "f/g.py": ("CC-BY-NC-4.0", "/"),
        "COPYING": ("CC-BY-NC-4.0", "own"),
        "top.py": ("CC-BY-NC-4.0", "/"),
    }
    assert all(r.n == 1 for r in rows)
    assert licences.scan(df.limit(0)).collect() == []


def similarities(passage):
    """The cosine of a passage to each template, term by term."""
    terms = lambda t: Counter(re.findall(licences._TERM, t.lower()))
    all_terms = [terms(t) for _, t in licences.TEMPLATES]
    df = Counter(w for t in all_terms for w in t)
    weigh = lambda t: {w: (1 + math.log(n)) * (math.log((1 + len(all_terms)) / (1 + df[w])) + 1) for w, n in t.items()}
    v = weigh(terms(passage))
    marks, versions, denies = licences.telling(passage)
    for (name, text), t in zip(licences.TEMPLATES, all_terms):
        own = licences.telling(text)
        if marks != own[0] or own[1] and versions != own[1] or denies and not own[2]:
            continue
        u = weigh(t)
        dot = sum(x * u.get(w, 0) for w, x in v.items())
        yield dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in u.values()) or 1), name


def test_cosine(spark):
    passages = ["Released under the MIT License.", "released under some other license", "Licensed under the Apache License", "x y z of the", licences._MIT_GRANT[:200]]
    df = spark.createDataFrame([(k, 0, x) for k, x in enumerate(passages)], "p1 long, p2 long, passage string")
    got = {r.p1: r for r in licences.match_passages(df).collect()}
    for k, passage in enumerate(passages):
        best = max(s for s, _ in similarities(passage))
        assert abs(got[k].similarity - best) < 2e-6
        assert got[k].licence == min(n for s, n in similarities(passage) if abs(s - best) < 1e-9)


def test_anchors_lose_no_match():
    """Without any anchor no passage reaches the least similarity, however it is made up of template terms."""
    found = set(licences.anchors(licences.LEAST))
    for _, text in licences.TEMPLATES:
        rest = " ".join(w for w in re.findall(licences._TERM, text.lower()) if w not in found)
        assert not rest or max((s for s, _ in similarities(rest)), default=0) < licences.LEAST


def test_headers_and_licence_files(spark):
    mit = "Copyright (c) 2021 Jo Doe\n\n" + licences._MIT_GRANT.replace(", ", ",\n") + "\n\n" + licences._MIT_REST.replace(". ", ".\n")
    bsd = "# Copyright 2020\n#\n# " + licences._BSD_TWO.replace(". ", ".\n# ") + "\n#\nimport os\n"
    gpl = "/*\n * " + licences._GNU.format(what="program", name="", version="3").replace(", ", ",\n * ") + "\n */\nint main;\n"
    files = [
        ("a/LICENSE", mit, "MIT"),
        ("a/x.py", bsd, "BSD-2-Clause"),
        ("a/y.c", gpl, "GPL-3.0"),
        ("a/z.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}", "Apache-2.0"),
        ("a/w.rs", "/* SPDX-License-Identifier: MIT */", "MIT"),
        (None, "// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
        ("b/q.txt", "We were granted a licence to use, copy and sell the wine of this house.", None),
        ("b/r.txt", "Licensed under the Fair Harvest Agreement, edition four.", None),
    ]
    rows = licences.scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()
    got = {r.text: r.licence for r in rows}
    assert [got[t] for _, t, _ in files] == [want for *_, want in files]


def test_sister_licences(spark):
    """Titles and notices that differ in a word, denials, and other versions: none goes under a wrong name."""
    said = {
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999": "LGPL-2.1",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007": "AGPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "GPL-3.0",
        "Mozilla Public License Version 2.0": "MPL-2.0",
        "Eclipse Public License - v 2.0": "EPL-2.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License, CC BY-ND 4.0.": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License, CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.": "CC-BY-4.0",
        "Not licensed under the Apache License, Version 2.0.": None,
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "This is not released under the MIT License.": None,
        "Creative Commons Attribution-ShareAlike 2.0 Generic Public License": None,
    }
    rows = licences.scan(spark.createDataFrame([(f"d{k}/LICENSE", text) for k, text in enumerate(said)], "path string, text string")).collect()
    assert {r.text: r.licence for r in rows} == said


def test_query(spark, tiny):
    from tests.compare import assert_same
    from tidemark.llm.queries import ORACLES, QUERIES

    assert_same(QUERIES["op2_license_scan"](spark, tiny), ORACLES["op2_license_scan"], tiny)
