"""Licence scan by sentence-rule recognition.

A text is cut into sentences, each is normalised (lower case, letters and digits,
single blanks; a copyright line becomes one fixed sentence) and looked up among
known licence sentences. The identifiers of a text, in their order, are then
matched against ordered rules: the first rule that fits takes its run of
identifiers out and names a licence, until no rule fits.

A sentence ends at . ! ? : ; before white space, or at an empty line. A sentence
that goes over several lines is looked up as a whole and, failing that, line by line,
so wrapped licence texts and notices without a full stop are both found.

The known sentences are a table of bounded size, broadcast to the sentences. Only
texts and sentences that hold one of ``CUES`` are cut up; every known sentence holds
one, and its blanks stand for whatever a normalised blank does (line ends, comment
marks), so nothing is missed.

A line with an SPDX tag gives the identifiers of its expression, cut at AND, OR and
WITH; the old GNU forms (GPL-2.0, GPL-2.0+) are read as the present ones.

Defined cases: a null or empty text has no licence. Repeated sentences are matched
each time, the licence is listed once, in rule order of first match. Equal rows give
one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names by which notices call a licence, by its SPDX identifier.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License version 2", "GPLv2"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License version 3", "GPLv3"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
    "Unlicense": ["Unlicense"],
}
#: GNU licences, whose SPDX identifiers have an or-later form and were written without "-only" before.
GNU = [x.removesuffix("-only") for x in NAMES if x.endswith("-only")]
#: SPDX identifiers in tags (beside those of NAMES), and the licences that they name.
TAGS = {f"{x}-or-later": f"{x}-or-later" for x in GNU} | {x: f"{x}-only" for x in GNU}
#: Ways to begin such a notice.
OPENINGS = [f"{subject}{verb} under {article}" for subject in (
    "", "This work is ", "This software is ", "This program is ", "This file is ", "This project is ", "This code is ")
    for verb in ("licensed", "released", "distributed", "available", "made available") for article in ("", "the ")]
#: Sentences of licence texts and headers.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
                 "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
                 "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
                 "furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
             "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions "
                  "and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                  "and the following disclaimer in the documentation and/or other materials provided with the "
                  "distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                   "or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                 "is hereby granted, provided that the above copyright notice and this permission notice appear in "
                 "all copies.",
    "apache-under": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl-free": "This program is free software:",
    "gpl-2-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                   "published by the Free Software Foundation, either version 2 of the License, or (at your option) "
                   "any later version.",
    "gpl-3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                   "published by the Free Software Foundation, either version 3 of the License, or (at your option) "
                   "any later version.",
    "mpl-2-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
COPYRIGHT = "copyright notice line"
CUES = ("licens", "licenc", "permi", "copyright", "redistribut", "warranty", "spdx", "reserved", "public domain",
        "under", "free software", "obtain a copy")
#: Ordered rules: a run of identifiers (a regular expression over them, each ended by a comma) and its licence.
RULES = [
    ("mit-grant,mit-notice,(as-is,)?", "MIT"), ("mit-grant,", "MIT-like"),
    ("bsd-grant,bsd-source,bsd-binary,bsd-endorse,", "BSD-3-Clause"), ("bsd-grant,bsd-source,bsd-binary,", "BSD-2-Clause"),
    ("bsd-grant,", "BSD-like"), ("isc-grant,", "ISC"),
    ("apache-under,(apache-use,)?(apache-copy,)?", "Apache-2.0"),
    ("(gpl-free,)?gpl-2-later,", "GPL-2.0-or-later"), ("(gpl-free,)?gpl-3-later,", "GPL-3.0-or-later"),
    ("mpl-2-header,", "MPL-2.0"), ("unlicense,", "Unlicense"),
    *[(f"(under|spdx):{re.escape(x)},", x) for x in NAMES], *[(f"spdx:{re.escape(x)}-or-later,", f"{x}-or-later") for x in GNU],
    ("(copyright,)?reserved,", "All-rights-reserved"),
]


def normalised(sentence: str) -> str:
    """What ``_normalised`` makes of a sentence."""
    s = re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")
    return re.sub(r"^copyright (c )?[0-9]{4}.*$", COPYRIGHT, s)


def _normalised(col: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))
    return F.regexp_replace(s, "^copyright (c )?[0-9]{4}.*$", COPYRIGHT)


def known_sentences() -> dict[str, str]:
    """{normalised sentence: identifier}; notices are made of every opening and every name."""
    out = {normalised(f"{o}{name}"): f"under:{x}" for x, names in NAMES.items() for name in names for o in OPENINGS}
    out |= {normalised(f"{o}{name} license"): f"under:{x}" for x, names in NAMES.items() for name in names
            for o in OPENINGS if not name.endswith("License")}
    out |= {normalised(f"SPDX-License-Identifier {x}"): f"spdx:{name}" for x, name in ({x: x for x in NAMES} | TAGS).items()}
    out |= {normalised(s): x for x, s in SENTENCES.items()} | {COPYRIGHT: "copyright"}
    missed = [s for s in out if not any(c in s for c in CUES)]
    if missed:
        raise ValueError(f"sentences without a cue: {missed}")
    return out


_CUE = "(?i)" + "|".join(x.replace(" ", "[^a-z0-9]+") for x in CUES)
_TAG = "(?i)^[^a-z0-9]*spdx[^a-z0-9]+license[^a-z0-9]+identifier[^a-z0-9]"
_SPLIT = r"(?:(?<=[.!?:;])(?<!(?i:spdx-license-identifier):)\s+|\n\s*\n\s*)"


def _tagged(line: Column) -> Column:
    """A line as its sentences: a tag for each identifier of an SPDX expression, or else the line."""
    later = F.regexp_replace(line, r"(?i)\b([AL]?GPL-[0-9.]+)\+", "$1-or-later")
    names = F.split(F.regexp_replace(later, _TAG, ""), r"(?i)(?<=[\s)])(?:and|or|with)(?=[\s(])")
    return F.when(line.rlike(_TAG), F.transform(names, lambda x: F.concat(F.lit("SPDX-License-Identifier "), x))).otherwise(
        F.array(line))


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (comma-joined SPDX identifiers, in the order of the rules that matched), sentence_ids
    (comma-joined, in the text's order), n_sentences, n_unmatched (identifiers that no rule took), row_no: one
    row per input row."""
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(list(known_sentences().items()), "sentence string, sentence_id string"))
    rules = F.array(*[F.struct(F.lit(p).alias("run"), F.lit(x).alias("name")) for p, x in RULES])
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.select("row_no", "doc_id", F.posexplode_outer(
        F.when(F.col("text").rlike(_CUE), F.split("text", _SPLIT))).alias("at", "whole"))
    # a sentence of one line is line 0 with its tags; of several, it is line 0 as a whole
    lines = F.when(F.col("whole").rlike(_CUE), F.when(F.instr("whole", "\n") > 0, F.concat(
        F.array(F.array("whole")), F.transform(F.split("whole", r"\s*\n\s*"), _tagged))).otherwise(F.array(_tagged(F.col("whole")))))
    each = cut.select("row_no", "doc_id", "at", F.posexplode_outer(lines).alias("line", "parts"))
    each = each.select("row_no", "doc_id", "at", "line", F.posexplode_outer("parts").alias("place", "part"))
    each = each.select("row_no", "doc_id", "at", "line", "place", _normalised(F.col("part")).alias("sentence"))
    found = each.join(known, "sentence", "left").groupBy("row_no", "at").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.when(F.col("sentence_id").isNotNull(), F.struct("line", "place", "sentence_id")))).alias("f"))
    # the whole sentence (line 0) counts for all its lines
    found = found.withColumn("ids", F.when(F.get("f", F.lit(0))["line"] == 0, F.filter("f", lambda x: x["line"] == 0)["sentence_id"])
                             .otherwise(F.col("f.sentence_id")))
    per = found.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("ids") > 0, F.struct("at", "ids")))),
                              lambda x: x["ids"])).alias("ids"))
    start = F.struct(F.concat(F.array_join("ids", ","), F.when(F.size("ids") > 0, ",").otherwise("")).alias("left"),
                     F.array().cast("array<string>").alias("names"))
    done = F.aggregate(rules, start, lambda a, r: F.when(
        F.regexp_like(a["left"], F.concat(F.lit("(^|(?<=,))"), r["run"])),
        F.struct(F.regexp_replace(a["left"], F.concat(F.lit("(^|(?<=,))"), r["run"]), F.lit("")).alias("left"),
                 F.concat(a["names"], F.array(r["name"])).alias("names"))).otherwise(a))
    return (per.withColumn("done", done).select(
        "doc_id", F.array_join(F.array_distinct("done.names"), ",").alias("licenses"),
        F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"),
        F.regexp_count(F.col("done.left"), F.lit(",")).cast("long").alias("n_unmatched"), "row_no"))
