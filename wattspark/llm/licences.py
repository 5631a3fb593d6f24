"""License scans (operator 9): sentence-rule recognition.

A known licence sentence (lower case, runs of other characters as one space) that stands whole between two
ends becomes its identifier. Ends are line ends and sentence marks before white space. The sequence of
identifiers is matched against ordered rules; a rule that matches consumes its identifiers, so that a header is not
also reported as the shorter reference which it contains. What no rule consumes is reported as left.

A known sentence may run over line ends, blank ones too, so that wrapped texts and notices of one line are
read alike, wherever they stand in a text. It may run over a sentence mark only where the published text has one
(``MARKED``: "free software; you can"). Of several that start at one place, the longest counts.

``oracle`` is the same rule in DuckDB's SQL, whose patterns can't look around: there every end is written
twice, so that a sentence can take one end before and one behind it and leaves its neighbours theirs.

DataFrame functions only, no shuffle: the sentence table is a constant.

Defined results: a null or empty text, and one without a known sentence, gives no licence (empty
strings, 0); equal rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: published licence sentences, normalised, with the identifiers used here
SENTENCES = {
    "licensed under the apache license version 2 0": "ApacheRef",
    "licensed under the apache license version 2 0 the license": "ApacheHead",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiable",
    "this work is licensed under the gnu general public license version 3": "GPL3Ref",
    "licensed under the gnu general public license version 3": "GPL3Ref",
    "this work is licensed under the gnu general public license version 2": "GPL2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLWarranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDNames",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2Ref",
    "licensed under cc by nc 4 0": "CCBYNC4Ref",
    "licensed under cc by 4 0": "CCBY4Ref",
    "licensed under cc by sa 4 0": "CCBYSA4Ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4Ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CCBYNC4Ref",
    "all rights reserved": "AllRights",
}

#: ordered: the first rule takes its identifiers before the next is tried
RULES = [
    ("Apache-2.0", ["ApacheHead", "ApacheComply", "ApacheCopy", "ApacheUrl", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead", "ApacheComply"]),
    ("MIT", ["MITGrant", "MITNotice", "MITAsIs", "MITLiable"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDNames"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("GPL-3.0-or-later", ["GPL3Grant", "GPLWarranty"]),
    ("GPL-3.0-or-later", ["GPL3Grant"]),
    ("GPL-2.0-or-later", ["GPL2Grant", "GPLWarranty"]),
    ("GPL-2.0-or-later", ["GPL2Grant"]),
    ("ISC", ["ISCGrant"]),
    ("MPL-2.0", ["MPL2Ref"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("MIT", ["MITRef"]),
    ("GPL-3.0", ["GPL3Ref"]),
    ("GPL-2.0", ["GPL2Ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4Ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4Ref"]),
    ("CC-BY-4.0", ["CCBY4Ref"]),
    ("Proprietary", ["AllRights"]),
]

#: every known sentence has one of these inside a single word, which no line end or space can part: texts without them
#: need no cutting
WORDS = ["licens", "copyright", "warrant", "permission", "reserved", "redistribut"]

#: word pairs of known sentences with a sentence mark between them in the published text
MARKED = ["software you", "foundation either", "warranty without", "v 2"]
#: capitals are free in lower-case text: ``L`` is a line end, ``M`` a sentence mark
_MARKS = [("[.!?;:][ \\t\\r\\n]+", "M"), ("\\n", "L"), ("[^a-z0-9LM]+", " "), ("L[ L]*+", "L"), ("M[ LM]*+", "M"), (" ?L?M", "M"), (" L", "L")]


def _pattern() -> str:
    """A known sentence between two ends, the longest first."""
    def one(sentence):
        words = sentence.split()
        return words[0] + "".join(("[ LM]" if f"{a} {b}" in MARKED else "[ L]") + b for a, b in zip(words, words[1:]))

    return "(?<=[LM])(?:" + "|".join(one(s) for s in sorted(SENTENCES, key=len, reverse=True)) + ")(?=[LM])"


def _ids(text: Column) -> Column:
    """Identifiers of the known sentences of ``text`` in order, as ``<A><B>``."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    plain = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    for pattern, by in _MARKS:
        plain = F.regexp_replace(plain, pattern, by)
    found = F.regexp_extract_all(plain, F.lit(_pattern()), F.lit(0))
    return F.array_join(F.transform(found, lambda s: F.concat(F.lit("<"), F.element_at(known, F.translate(s, "LM", "  ")), F.lit(">"))), "")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_sentences, sentence_ids, licences, left_ids`` for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = F.lower(text)
    maybe = lower.contains(WORDS[0])
    for t in WORDS[1:]:
        maybe = maybe | lower.contains(t)
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit("<")))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.when(maybe, text).alias("text"))
    rows = rows.select("doc_id", F.coalesce(_ids(F.col("text")), F.lit("")).alias("ids"))
    rows = rows.withColumns({"rest": F.col("ids"), "found": F.lit("")})
    for name, ids in RULES:
        want = "".join(f"<{i}>" for i in ids)
        rows = rows.select("doc_id", "ids",
                           F.when(F.col("rest").contains(want), F.concat("found", F.lit(f"{name},"))).otherwise(F.col("found")).alias("found"),
                           F.replace(F.col("rest"), F.lit(want), F.lit("~")).alias("rest"))
    return rows.select("doc_id", count(F.col("ids")).cast("long").alias("n_sentences"), F.col("ids").alias("sentence_ids"),
                       F.array_join(F.array_distinct(F.filter(F.split("found", ","), lambda x: x != "")), ",").alias("licences"),
                       F.replace("rest", F.lit("~"), F.lit("")).alias("left_ids"))


def oracle() -> str:
    """DuckDB SQL for ``scan(documents)``."""
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
    plain = "chr(10) || lower(text) || chr(10)"
    for pattern, by in _MARKS:
        plain = f"regexp_replace({plain}, '{pattern.replace('*+', '*')}', '{by}', 'g')"
    plain = f"replace(replace({plain}, 'L', 'LL'), 'M', 'MM')"

    def one(sentence):
        words = sentence.split()
        return words[0] + "".join(("(?: |LL|MM)" if f"{a} {b}" in MARKED else "(?: |LL)") + b for a, b in zip(words, words[1:]))

    pattern = "[LM](" + "|".join(one(x) for x in sorted(SENTENCES, key=len, reverse=True)) + ")[LM]"
    count = lambda c: f"(length({c}) - length(replace({c}, '<', '')))"
    maybe = " OR ".join(f"contains(lower(coalesce(text, '')), '{t}')" for t in WORDS)
    sql = f"""WITH cand AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, ({maybe}) AS maybe FROM documents),
 hit AS MATERIALIZED (SELECT doc_id, regexp_extract_all({plain}, '{pattern}', 1) AS found FROM cand WHERE maybe),
 seq AS MATERIALIZED (SELECT doc_id, coalesce(array_to_string(list_transform(found, lambda s: '<' || {known}[replace(replace(s, 'LL', ' '), 'MM', ' ')] || '>'), ''), '') AS ids FROM hit
   UNION ALL SELECT doc_id, '' FROM cand WHERE NOT maybe),
 r0 AS (SELECT doc_id, ids, ids AS rest, '' AS found FROM seq)"""
    for k, (name, want) in enumerate(RULES):
        w = "".join(f"<{i}>" for i in want)
        sql += f",\n r{k + 1} AS (SELECT doc_id, ids, replace(rest, '{w}', '~') AS rest, CASE WHEN contains(rest, '{w}') THEN found || '{name},' ELSE found END AS found FROM r{k})"
    keep = "list_filter(string_split(found, ','), lambda x: x <> '')"
    return sql + f"""
SELECT doc_id, CAST({count('ids')} AS BIGINT) AS n_sentences, ids AS sentence_ids,
 coalesce(array_to_string(list_filter({keep}, lambda x, i: list_position({keep}, x) = i), ','), '') AS licences, replace(rest, '~', '') AS left_ids
FROM r{len(RULES)}"""
