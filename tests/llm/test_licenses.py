import collections
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from tabshift.llm import licenses as L

FILES = "doc_id long, path string, text string"


def scan(spark, rows):
    return {(r.doc_id, r.path): r for r in L.scan(spark.createDataFrame(rows, FILES), leading=True).collect()}


def test_scan_and_inheritance(spark):
    prose = "some words that mean nothing much at all"
    rows = [
        (1, "a/LICENSE", L.TEMPLATES["MIT"][3] + "\nto deal in the Software without restriction"), (2, "a/b/c/x.py", prose), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), (4, "a/b/c/d/y.py", prose),
        (5, "a/z.py", f"{prose}\nReleased under the MIT License.\n{prose}"), (6, "other/x", prose), (7, "ab/x", prose), (8, None, "All rights reserved."), (9, "q/n", None), (10, "q/m", ""), (11, "a/b/f.py", f"{prose} licensed under a tree " * 9),
        (12, "q/r/s.py", "Licensed under CC BY-NC 4.0.\n" + prose), (13, "q/r/t/u.py", prose), (14, "q/r/two.py", "This work is licensed under the GNU General Public License, version 3."), (2, "a/b/c/x.py", prose),
    ]
    df = spark.createDataFrame(rows, FILES).withColumn("license", F.lit("clash")).withColumn("term", F.lit("clash"))
    assert L.scan(df).count() == len(rows)
    got = scan(spark, rows)
    own = {k[0]: r.own_license for k, r in got.items()}
    assert own == {1: "MIT", 2: None, 3: "Apache-2.0", 4: None, 5: "MIT", 6: None, 7: None, 8: "Proprietary", 9: None, 10: None, 11: None, 12: "CC-BY-NC-4.0", 13: None, 14: "GPL-3.0"}
    given = {k[0]: (r.license, r.inherited_from, r.distance) for k, r in got.items()}
    assert given[2] == ("Apache-2.0", 3, 1) and given[4] == ("Apache-2.0", 3, 2) and given[11] == ("Apache-2.0", 3, 0)
    assert given[6] == (None, None, None) and given[7] == (None, None, None) and given[9] == (None, None, None)
    assert given[13] == ("CC-BY-NC-4.0", 12, 1)  # both speak with similarity 1: the least id


def test_templates_match_themselves(spark):
    rows = [(i, f"p{i}/x", text) for i, (name, texts) in enumerate(L.TEMPLATES.items()) for text in texts[-1:]]
    got = scan(spark, rows)
    assert [got[i, f"p{i}/x"].own_license for i in range(len(rows))] == list(L.TEMPLATES)


def test_empty_table_and_root(spark):
    assert scan(spark, []) == {}
    got = scan(spark, [(1, "LICENSE", "Released under the MIT License."), (2, "x", "y"), (3, "d/e/x", "y")])
    assert (got[2, "x"].license, got[2, "x"].distance, got[3, "d/e/x"].license, got[3, "d/e/x"].distance) == ("MIT", 0, "MIT", 2)


def test_no_python_in_the_plan(spark):
    plan = L.scan(spark.createDataFrame([(1, "a/b", "x")], FILES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licence_files_and_wrapped_headers(spark):
    mit = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
    bsd = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    apache = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
"""
    gpl = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
"""
    header = """#!/usr/bin/python
#
# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version {} of the License, or
# (at your option) any later version.
#
import os
"""
    texts = [("m/LICENSE", mit, "MIT"), ("b/COPYING", bsd, "BSD-3-Clause"), ("a/LICENSE.txt", apache, "Apache-2.0"), ("g/COPYING", gpl, "GPL-3.0"), ("x/h3.py", header.format(3), "GPL-3.0"), ("x/h2.py", header.format(2), "GPL-2.0")]
    rows = [(i, path, text) for i, (path, text, _) in enumerate(texts)] + [(10 + i, path[:1] + "/src/code.py", "import os") for i, (path, _, _) in enumerate(texts[:4])]
    rows += [(100 + i, f"z/{i}", "the software of a and to use it in copies is free for any person") for i in range(50)]
    got = {k[0]: r for k, r in scan(spark, rows).items()}
    assert [got[i].own_license for i in range(len(texts))] == [want for _, _, want in texts]
    assert [got[10 + i].license for i in range(4)] == [want for _, _, want in texts[:4]]


def test_a_copyright_line_in_a_licence_file_is_no_licence(spark):
    bsd = "Copyright (c) The Regents of the University of California.\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer.\n3. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products.\n"
    assert scan(spark, [(1, "b/COPYING", bsd), (2, "b/x", "y")])[1, "b/COPYING"].own_license == "BSD-3-Clause"


def brute(files, leading, threshold=L.THRESHOLD):
    """own licence, similarity, licence, source and distance of (id, path, text) rows, worked out one by one."""
    terms = lambda t: [x for x in re.split("[^0-9A-Za-z]+", t.lower()) if x]
    said = [(name, collections.Counter(terms(t))) for name, texts in L.TEMPLATES.items() for t in texts]
    vocabulary = {t for _, c in said for t in c}
    n = len(files)
    df = collections.Counter(t for _, _, text in files for t in set(terms(text or "")) & vocabulary)
    idf = {t: math.log((n + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    most = math.log(n + 1) + 1

    def similarity(counts, template):
        length = math.sqrt(sum((k * idf.get(t, most)) ** 2 for t, k in counts.items()))
        own = math.sqrt(sum((k * idf[t]) ** 2 for t, k in template.items()))
        return sum(counts[t] * idf[t] * k * idf[t] for t, k in template.items()) / length / own

    own, speaks = {}, {}
    for at, (i, path, text) in enumerate(files):
        text = text or ""
        if not re.search(L.SIGNAL, text):
            continue
        whole = path is not None and bool(re.search(L.LICENSE_FILE, path))
        lines = [x for x in text.split("\n") if x.strip(" ")]
        paragraphs = [x for x in re.split(r"\n(?:[^\w\n]*\n)+", text) if re.search(r"\w", x)]
        pieces = [(k, k in (0, len(lines) - 1), x) for k, x in enumerate(lines)]
        pieces += [(-1 - k, k in (0, len(paragraphs) - 1), x) for k, x in enumerate(paragraphs) if "\n" in x.strip(" ")]
        pieces += [(L.WHOLE, True, text)] if whole else []
        scored = []
        for line, edge, piece in pieces:
            counts = collections.Counter(terms(piece))
            if not re.search(L.SIGNAL, piece):
                continue
            if tag := re.search(L.SPDX, piece):
                scored.append((1.0, tag[1].rstrip("-"), line, edge, 0))
            plain = re.sub("[^0-9a-z.]+", " ", piece.lower()).strip() + " #3" * bool(re.search(L.THIRD_CLAUSE, text))
            fit = {name for name, (needs, bars) in L.DECIDES.items() if all(re.search(x, plain) for x in needs) and not re.search(bars, plain)}
            likeness = collections.defaultdict(float)
            for name, t in said:
                if name in fit and counts and (name != "Proprietary" or line == L.WHOLE or not whole):
                    likeness[name] = max(likeness[name], round(similarity(counts, t), 6))
            ranked = sorted(((-v, name) for name, v in likeness.items() if v >= threshold))
            if ranked and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= L.MARGIN):
                scored.append((-ranked[0][0], ranked[0][1], line, edge, 1 + (ranked[0][1] == "Proprietary")))
        if scored:
            best = min(scored, key=lambda s: (s[4], -s[0], s[1], s[2]))
            own[at] = best[1], best[0]
            if path is not None and (whole or leading and any(s[3] for s in scored)):
                folder = path.rpartition("/")[0]
                speaks[folder] = min(speaks.get(folder, (9, 9, "")), (-best[0], i, best[1]))
    out = []
    for at, (i, path, _) in enumerate(files):
        name, likeness = own.get(at, (None, None))
        row = (i, path, name, likeness, name, None, None)
        if name is None and path is not None:
            folder = path.rpartition("/")[0]
            up = folder
            while up not in speaks and up:
                up = up.rpartition("/")[0]
            if up in speaks:
                depth = lambda f: len(f.split("/")) if f else 0
                row = (i, path, None, None, speaks[up][2], speaks[up][1], depth(folder) - depth(up))
        out.append(row)
    return out


@pytest.mark.parametrize("leading", [False, True])
def test_against_brute_force(spark, leading):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, f"{r.source}/{r.lang}/{r.doc_id // 40}/{r.doc_id}.txt", r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] if os.path.isdir(sf) else []
    docs += [
        (9001, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 Jo\n\n" + L.MIT_GRANT), (9002, "a/b/c.py", "x = 1"), (9003, "a/b/d.py", "# SPDX-License-Identifier: Apache-2.0\ny = 2"),
        (9004, "a/b/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), (9005, "a/b/e/f.c", None), (9006, None, "All rights reserved."), (9007, "top.txt", ""),
        (9008, "z/p.js", "/* Licensed under the\n * MIT\n * License. */\n\ncode()"), (9009, "a/b/c.py", "x = 1"),
    ]
    got = L.scan(spark.createDataFrame(docs, "doc_id long, path string, text string"), leading=leading).collect()
    shown = sorted((tuple(r[c] for c in ("doc_id", "path", "own_license", "similarity", "license", "inherited_from", "distance")) for r in got), key=lambda r: r[0])
    want = sorted(brute(docs, leading), key=lambda r: r[0])
    assert len(shown) == len(want)
    for a, b in zip(shown, want, strict=True):
        assert a[:3] == b[:3] and a[4:] == b[4:] and (a[3] == b[3] or abs(a[3] - b[3]) < 2e-6)
    by_id = {r[0]: r for r in shown}
    assert by_id[9001][2] == "MIT" and by_id[9003][2] == "Apache-2.0" and by_id[9002][4:] == (("Apache-2.0", 9003, 0) if leading else ("GPL-3.0", 9004, 0)) and by_id[9005][4:] == (("Apache-2.0", 9003, 1) if leading else ("GPL-3.0", 9004, 1)) and by_id[9008][2] == "MIT"


@pytest.mark.parametrize(
    "tag",
    ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSL-1.0", "MIT OR Apache-2.0", "(MIT AND Zlib) OR GPL-2.0-only WITH Classpath-exception-2.0", "LicenseRef-Own-1", "LGPL-2.1+"],
)
def test_tags_are_taken_as_they_stand(spark, tag):
    docs = [(1, "a.c", f"// SPDX-License-Identifier: {tag}\nint x;"), (2, "b.css", f"/* SPDX-License-Identifier: {tag}*/\nAll rights reserved."), (3, "c.html", f"<!-- SPDX-License-Identifier: {tag}-->\nLicensed under the ISC License."), *[(10 + i, f"d/{i}", "plain words of a text that has no notice") for i in range(20)]]
    got = {r.doc_id: (r.own_license, r.similarity) for r in L.scan(spark.createDataFrame(docs, FILES)).collect()}
    assert got[1] == got[2] == got[3] == (tag, 1.0) and set(got.values()) == {(tag, 1.0), (None, None)}


BSD = "Copyright (c) 2024, Jo Doe\nAll rights reserved.\n\n" + L.BSD_GRANT.replace(" with or", "\nwith or") + """:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ZLIB = """zlib License

(C) 2024 Jo Doe

This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software.
"""
GNU = "                   GNU {} GENERAL PUBLIC LICENSE\n                       Version {}\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
HEADER = "/* {0}\n *\n * This library is free software; you can redistribute it and/or modify it\n * under the terms of the GNU {1}General Public License as published\n * by the Free Software Foundation; either version {2} of the License, or\n * (at your option) any later version.\n */\nint x;\n"
KNOWN = [
    ("LICENSE", BSD.format(""), "BSD-2-Clause"), ("LICENSE", BSD.format(THIRD), "BSD-3-Clause"), ("x.c", "/*\n * " + BSD.format("").replace("\n", "\n * ") + "/\n", "BSD-2-Clause"), ("x.c", "/*\n * " + BSD.format(THIRD).replace("\n", "\n * ") + "/\n", "BSD-3-Clause"),
    ("LICENSE", ZLIB, "Zlib"), ("COPYING", BOOST, "BSL-1.0"), ("x.hpp", "// Distributed under the Boost Software License, Version 1.0.\n// (See the file LICENSE)\n", "BSL-1.0"), ("COPYING", GNU.format("LESSER", "3, 29 June 2007"), "LGPL-3.0"), ("COPYING", GNU.format("LESSER", "2.1, February 1999"), "LGPL-2.1"),
    ("COPYING", GNU.format("", "2, June 1991"), "GPL-2.0"), ("COPYING", GNU.format("", "3, 29 June 2007"), "GPL-3.0"), ("COPYING", GNU.format("AFFERO", "3, 19 November 2007"), "AGPL-3.0"), ("x.c", HEADER.format("x", "Lesser ", "3"), "LGPL-3.0"), ("x.c", HEADER.format("x", "Lesser ", "2.1"), "LGPL-2.1"),
    ("x.c", HEADER.format("x", "", "2"), "GPL-2.0"), ("x.c", HEADER.format("x", "", "3"), "GPL-3.0"), ("LICENSE", "MIT License\n\nCopyright (c) 2024 Jo\n\n" + L.MIT_GRANT, "MIT"), ("LICENSE", "ISC License\n\nCopyright 2024 Jo\n\n" + L.TEMPLATES["ISC"][0], "ISC"),
    ("x.py", "# This work is licensed under a Creative Commons\n# Attribution-ShareAlike 4.0 International License.\n", "CC-BY-SA-4.0"), ("x.py", "# Licensed under CC BY 4.0.\n", "CC-BY-4.0"), ("x.py", "# Licensed under the Foo License.\n", None), ("x.js", "// This file is licensed under version 2 of a licence of ours\n", None),
]


def test_known_files(spark):
    docs = [(i, f"p{i}/{name}", text) for i, (name, text, _) in enumerate(KNOWN)] + [(100 + i, f"d/{i}", "plain words of a text that has no notice and is free software for any person to use") for i in range(40)]
    got = {r.doc_id: r.own_license for r in L.scan(spark.createDataFrame(docs, FILES)).collect()}
    assert [got[i] for i in range(len(KNOWN))] == [want for _, _, want in KNOWN]


def test_notices_are_dealt_once_without_their_paths(spark):
    notices = spark.createDataFrame([(0, "a/" * 50, "Licensed under the MIT License."), (1, None, "Released under the MIT license, MIT")], "notice_id long, path string, notice string")
    idf = spark.createDataFrame([("mit", 2.0), ("license", 1.0)], "term string, idf double")
    weighted = spark.createDataFrame([("MIT", 0, "mit", 0.8), ("MIT", 0, "license", 0.6)], "license string, variant int, term string, w double")
    scored = L.similarities(notices, idf, weighted, 3.0)
    got = {r.notice_id: r.similarity for r in scored.collect()}
    assert got == {0: pytest.approx(2.2 / (4 + 1 + 27) ** 0.5, abs=1e-6), 1: pytest.approx(3.8 / (16 + 1 + 27) ** 0.5, abs=1e-6)}
    dealt = scored._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]
    assert dealt and all(x.startswith("notice_id#") and x.split(")")[0].count("#") == 1 for x in dealt)
