"""Licence scans in DataFrame functions alone: sparse TF-IDF cosine to templates, then inheritance by path joins.

The terms are those of the templates. A notice is a line or a paragraph of a file (all are scanned, not the first few), or all of
a file that is a licence file by its name. Its weights are tf * idf over the templates' terms, with idf from the document counts of
the whole corpus; every other word weighs as much as a term that no document has, so a licence's words in passing, amid prose,
score low. Notices without a telling word (``SIGNAL``) are passed over. Likeness alone doesn't tell licences of one family apart, so a
licence also needs its deciding words in the notice (``DECIDES``: its name, version or clauses) and a margin to the next licence's
likeness. A file's own licence is the best template above the threshold, if any. An SPDX tag is no matter of likeness: its expression
is taken as it stands, whole and with ids that have no template, and goes before all notices; a notice that only reserves all rights
comes last. A licence file (by its name; in corpora without file names any file that begins or ends with a notice, if
asked for) speaks for its directory; files without a notice of their own inherit from the nearest ancestor directory that has one: ancestors are exploded, joined to the
directories' licences by path, and the longest wins.

Defined results: null or empty texts have no notice; null paths have no directory and inherit nothing; of several licence files
in one directory the most similar speaks, then the least id; equal similarities go by template name; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.llm.common import discard, staged

MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
GPL_HEADER = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
#: Notices of common licences, in the words in which files carry them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", MIT_GRANT),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        GPL_HEADER.format("program", "General Public License", "3"),
    ),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", GPL_HEADER.format("program", "General Public License", "2")),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", GPL_HEADER.format("library", "Lesser General Public License", "2.1")),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", GPL_HEADER.format("library", "Lesser General Public License", "3")),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", GPL_HEADER.format("program", "Affero General Public License", "3")),
    "BSD-3-Clause": (BSD_GRANT, "Licensed under the BSD 3-Clause License."),
    "BSD-2-Clause": (BSD_GRANT, "Licensed under the BSD 2-Clause License."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "zlib License",
    ),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "Creative Commons CC0 1.0 Universal public domain dedication"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved."),
}
#: What a notice must and must not say, in lower case with single spaces; `` #3`` ends it if its file has a clause against endorsement.
DECIDES = {
    "Apache-2.0": ((r"apache",), r"version 1"),
    "MIT": ((r"\bmit\b|permission is hereby granted free of charge",), r"\bwith or without fee\b"),
    "GPL-3.0": ((r"general public|\bgpl", r"version 3|\bv ?3"), r"lesser|affero|library general"),
    "GPL-2.0": ((r"general public|\bgpl", r"version 2(?!\.1)|\bv ?2(?!\.1)"), r"lesser|affero|library general"),
    "LGPL-2.1": ((r"(?:lesser|library) general", r"2\.1"), r"affero"),
    "LGPL-3.0": ((r"lesser general", r"version 3|\bv ?3"), r"affero|2\.1"),
    "AGPL-3.0": ((r"affero",), r"$^"),
    "BSD-3-Clause": ((r"\bbsd\b|redistribution and use", r"3 clause| #3$"), r"2 clause"),
    "BSD-2-Clause": ((r"\bbsd 2 clause|redistribution and use",), r"3 clause| #3$"),
    "Zlib": ((r"zlib|held liable|permission is granted to anyone to use",), r"$^"),
    "BSL-1.0": ((r"boost software",), r"$^"),
    "MPL-2.0": ((r"mozilla public",), r"version 1"),
    "CC-BY-4.0": ((r"cc by|attribution",), r"cc by (?:sa|nc|nd)|share ?alike|non ?commercial|no ?deriv|[123]\.0"),
    "CC-BY-SA-4.0": ((r"cc by sa|share ?alike",), r"cc by nc|non ?commercial|[123]\.0"),
    "CC-BY-NC-4.0": ((r"cc by nc|non ?commercial",), r"cc by nc (?:sa|nd)|share ?alike|no ?deriv|[123]\.0"),
    "CC0-1.0": ((r"cc0",), r"$^"),
    "ISC": ((r"\bisc\b|with or without fee",), r"$^"),
    "EPL-2.0": ((r"eclipse public",), r"v ?1|version 1"),
    "Unlicense": ((r"unencumbered|unlicense",), r"$^"),
    "Proprietary": ((r"rights reserved",), r"redistribut|permission"),
}
#: What shows the clause that the two BSD licences differ by.
THIRD_CLAUSE = r"(?i)neither\s+\W*the\s+\W*names?\b|\bendorse\s+\W*or\s+\W*promote\b"
#: An SPDX expression after its tag.
SPDX = r"SPDX-License-Identifier:[ \t]*(\(*[\w.+-]+\)*(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+\(*[\w.+-]+\)*)*)"
MARGIN = 0.01
#: Words that tell a notice, in any case.
SIGNAL = r"(?i)licen[sc]|copyright|rights reserved|public domain|permission is hereby|is hereby granted|redistribut|\bCC0\b|SPDX"
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)(\.[a-z]+)?$"
THRESHOLD = 0.6
WHOLE = -(1 << 31) + 1  # the line number of a whole text
#: Between paragraphs: lines without letters and digits, as in comments.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
BREAK = r"[^0-9A-Za-z]+"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(name, i, text) for name, texts in sorted(TEMPLATES.items()) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "license string, variant int, words string")


def _plain(notice: Column, third: Column) -> Column:
    return F.concat(F.trim(F.regexp_replace(F.lower(notice), r"[^0-9a-z.]+", " ")), F.when(third, F.lit(" #3")).otherwise(F.lit("")))


def _decided(license: Column, plain: Column) -> Column:
    """Whether a notice has the deciding words of a licence."""
    out = F.lit(False)
    for name, (needs, bars) in DECIDES.items():
        has = functools.reduce(lambda a, b: a & b, [plain.rlike(n) for n in needs])
        out = F.when(license == name, has & ~plain.rlike(bars)).otherwise(out)
    return out


def similarities(notices: DataFrame, idf: DataFrame, weighted: DataFrame, most: float) -> DataFrame:
    """(notice_id, license, similarity) of each notice and template that share a term.

    The notices are dealt by their ids once, as texts; their words are taken apart, counted and summed where they lie. ``idf`` and
    ``weighted`` have the templates' terms alone.
    """
    words = notices.select("notice_id", "notice").repartition("notice_id").select("notice_id", F.explode(terms_of(F.col("notice"))).alias("term"))
    counted = words.groupBy("notice_id", "term").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "term", "left")
    square = F.when(F.col("idf").isNotNull(), F.pow(F.col("tf") * F.col("idf"), F.lit(2))).otherwise(F.col("tf") * F.lit(most * most))
    length = counted.groupBy("notice_id").agg(F.sqrt(F.sum(square)).alias("length"))
    dot = counted.filter("idf is not null").join(F.broadcast(weighted), "term").groupBy("notice_id", "license", "variant").agg(F.sum(F.col("tf") * F.col("idf") * F.col("w")).alias("dot"))
    return dot.join(length, "notice_id").select("notice_id", "license", F.round(F.col("dot") / F.col("length"), 6).alias("similarity"))


def own_licenses(files: DataFrame, *, id_col: str, path_col: str, text_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, h, own, similarity, leads): the best notice of each file that has one; leads: it is the file's first or last line or paragraph."""
    spark = files.sparkSession
    templates = _templates(spark)
    said = templates.select("license", "variant", F.explode(terms_of(F.col("words"))).alias("term")).groupBy("license", "variant", "term").agg(F.count("*").alias("tf"))
    vocabulary = sorted({r.term for r in said.select("term").distinct().collect()})
    # documents with each template term, over the whole corpus; the terms are a fixed list
    text = F.coalesce(F.col(text_col), F.lit(""))
    has = files.select(F.explode(F.array_intersect(terms_of(text), F.array(*[F.lit(t) for t in vocabulary]))).alias("term"))
    df = staged(has.groupBy("term").agg(F.count("*").alias("df")), "license-df")
    n = files.agg(F.count("*")).first()[0]
    idf = spark.createDataFrame([(t,) for t in vocabulary], "term string").join(df, "term", "left")
    idf = staged(idf.select("term", (F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")), "license-idf")
    most = float(spark.range(1).select(F.log(F.lit(float(n + 1))) + 1).first()[0])

    weighted = said.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weighted.groupBy("license", "variant").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    weighted = weighted.join(lengths, ["license", "variant"]).select("license", "variant", "term", (F.col("w") / F.col("length")).alias("w"))

    keyed = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.xxhash64(F.col(text_col)).alias("h"), text.alias("text"))
    keyed = keyed.filter(F.col("text").rlike(SIGNAL))
    whole = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    paragraphs = F.filter(F.split("text", BLANK), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    piece = lambda line, edge, notice: F.struct(line.cast("int").alias("line"), edge.alias("edge"), notice.alias("notice"))
    keyed = keyed.select("id", "path", "h", "text", whole.alias("whole"), F.col("text").rlike(THIRD_CLAUSE).alias("third"), lines.alias("lines"), paragraphs.alias("paragraphs"))
    pieces = F.concat(
        F.transform("lines", lambda x, i: piece(i, (i == 0) | (i == F.size("lines") - 1), x)),
        # notices wrapped over lines are read as one; a paragraph of one line is that line
        F.filter(F.transform("paragraphs", lambda x, i: piece(-1 - i, (i == 0) | (i == F.size("paragraphs") - 1), x)), lambda x: F.trim(x["notice"]).contains("\n")),
        F.when(F.col("whole"), F.array(piece(F.lit(WHOLE), F.lit(True), F.col("text")))).otherwise(F.array().cast("array<struct<line:int,edge:boolean,notice:string>>")),
    )
    notices = keyed.select("id", "path", "h", "third", F.inline(pieces)).filter(F.col("notice").rlike(SIGNAL)).distinct()
    notices = staged(notices.withColumn("notice_id", F.monotonically_increasing_id()), "license-notices")

    keys = ["id", "path", "h", "line", "edge"]
    # only what is alike is looked at for its deciding words
    alike = similarities(notices, idf, weighted, most).filter(F.col("similarity") >= threshold)
    scored = alike.join(notices, "notice_id").withColumn("plain", _plain(F.col("notice"), F.col("third"))).filter(_decided(F.col("license"), F.col("plain")))
    # a licence file's copyright line is no licence
    scored = scored.filter((F.col("license") != "Proprietary") | (F.col("line") == WHOLE) | ~F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)))
    ranked = scored.groupBy(*keys, "license").agg(F.max("similarity").alias("similarity"))
    ranked = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "license"))).alias("r"))  # as many as licences at most
    clear = (F.size("r") == 1) | (F.try_element_at("r", F.lit(2))["s"] - F.col("r")[0]["s"] >= MARGIN)
    plain = ranked.filter(clear).select(*keys, F.when(F.col("r")[0]["license"] == "Proprietary", 2).otherwise(1).alias("place"), F.col("r")[0]["license"].alias("license"), (-F.col("r")[0]["s"]).alias("similarity"))
    tags = notices.filter(F.col("notice").contains("SPDX-License-Identifier")).withColumn("spdx", F.regexp_replace(F.regexp_extract("notice", SPDX, 1), r"-+$", ""))
    tagged = tags.filter("spdx <> ''").select(*keys, F.lit(0).alias("place"), F.col("spdx").alias("license"), F.lit(1.0).alias("similarity"))
    best = plain.unionByName(tagged).groupBy("id", "path", "h").agg(
        F.min(F.struct("place", (-F.col("similarity")).alias("s"), F.col("license"), F.col("line"))).alias("b"), F.max("edge").alias("leads"))
    out = staged(best.select("id", "path", "h", F.col("b.license").alias("own"), (-F.col("b.s")).alias("similarity"), "leads"), "license-own")
    discard(df, idf, notices)
    return out


def ancestors(path: Column) -> Column:
    """All directories above a path, the root as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, leading: bool = False) -> DataFrame:
    """(id, path, own_license, similarity, license, inherited_from, distance) of every file.

    license is the file's own or the inherited one, null if neither; inherited_from is the id of the licence file, distance the
    number of directories between. ``leading`` makes every file that begins or ends with a notice a licence file, for corpora
    without file names.
    """
    own = own_licenses(files, id_col=id_col, path_col=path_col, text_col=text_col, threshold=threshold)
    speaks = own.filter(F.col("path").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("leads") if leading else F.lit(False))))
    folders = speaks.groupBy(F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("folder")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("id").alias("id"), F.col("own").alias("license"))).alias("f"))
    folders = staged(folders.select("folder", F.col("f.id").alias("from_id"), F.col("f.license").alias("folder_license")), "license-folders")

    # directories, not files, meet the licences: one row for each directory and ancestor
    named = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.xxhash64(F.col(text_col)).alias("h")).withColumn("folder", F.regexp_replace("path", r"(^|/)[^/]*$", ""))
    above = named.filter("path is not null").select("folder").distinct().select("folder", F.explode(F.array_distinct(F.concat(ancestors(F.col("folder")), F.array("folder")))).alias("up"))
    met = above.join(folders.withColumnRenamed("folder", "up"), "up")
    depth = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(F.col(c), "/")))
    nearest = met.groupBy("folder").agg(F.max(F.struct(depth("up").alias("deep"), "from_id", "folder_license")).alias("n"))
    nearest = nearest.select(F.col("folder").alias("n_folder"), F.col("n.from_id").alias("from_id"), F.col("n.folder_license").alias("folder_license"), (depth("folder") - F.col("n.deep")).alias("distance"))
    rows = named.join(own.select(F.col("id").alias("o_id"), F.col("path").alias("o_path"), F.col("h").alias("o_h"), "own", "similarity"), named["id"].eqNullSafe(F.col("o_id")) & named["path"].eqNullSafe(F.col("o_path")) & (named["h"] == F.col("o_h")), "left")
    rows = rows.join(nearest, rows["folder"] == nearest["n_folder"], "left")
    inherits = F.col("own").isNull()
    return rows.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), F.col("own").alias("own_license"), "similarity", F.coalesce("own", "folder_license").alias("license"),
        F.when(inherits, F.col("from_id")).alias("inherited_from"), F.when(inherits, F.col("distance")).cast("long").alias("distance"),
    )
