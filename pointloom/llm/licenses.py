"""Licence scans by sentence identifiers and ordered rules.

A text is cut into pieces at sentence marks and line ends and normalised; runs of
whole pieces are looked up among known licence sentences, so that a known sentence
may hold such marks itself. What remains of a text is the sequence of identifiers.
A rule is an ordered list of identifiers: it matches if they occur in that order,
with anything between. Known sentences and rules are constants of the plan, so
there is no join and no shuffle; built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, UPPER

#: Sentences of public licence texts and notices, normalised (lower
#: case, letters and digits, single spaces), and the identifiers given to them.
SENTENCES = {
    "mit_ref": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit"),
    "apache2_ref": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "spdx license identifier apache 2 0"),
    "apache2_comply": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at",),
    "apache2_asis": ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",),
    "gpl3_ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only"),
    "gpl_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "gpl2_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",),
    "gpl_hope": ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl_copy": ("you should have received a copy of the gnu general public license along with this program",),
    "lgpl_ref": ("licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only"),
    "agpl_ref": ("licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"),
    "mpl2_ref": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"),
    "mpl2_copy": ("if a copy of the mpl was not distributed with this file you can obtain one at",),
    "cc_by_ref": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc_by_sa_ref": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc_by_nc_ref": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc0_ref": ("licensed under cc0 1 0", "released under cc0 1 0 universal"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mit_asis": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "isc_grant": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "isc_asis": ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",),
    "bsd_grant": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_names": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd_asis": ("this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",),
    "all_rights": ("all rights reserved",),
}

#: Licence and the identifiers that must follow one another.
RULES = (
    ("mit", ("mit_ref",)),
    ("mit", ("mit_grant", "mit_notice", "mit_asis")),
    ("isc", ("isc_grant", "isc_asis")),
    ("bsd-2-clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_asis")),
    ("bsd-3-clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_asis")),
    ("apache-2.0", ("apache2_ref",)),
    ("apache-2.0", ("apache2_comply", "apache2_copy", "apache2_asis")),
    ("gpl-3.0", ("gpl3_ref",)),
    ("gpl-3.0", ("gpl_free", "gpl_hope", "gpl_copy")),
    ("gpl-2.0", ("gpl2_free", "gpl_hope", "gpl_copy")),
    ("lgpl-3.0", ("lgpl_ref",)),
    ("agpl-3.0", ("agpl_ref",)),
    ("mpl-2.0", ("mpl2_ref",)),
    ("cc-by-4.0", ("cc_by_ref",)),
    ("cc-by-sa-4.0", ("cc_by_sa_ref",)),
    ("cc-by-nc-4.0", ("cc_by_nc_ref",)),
    ("cc0-1.0", ("cc0_ref",)),
    ("proprietary", ("all_rights",)),
)

#: Every known sentence holds one of these, so texts without any are not cut up.
MARKS = r"licen|spdx|permission|warranty|warranties|redistribut|disclaim|rights|mpl|endorse|compliance|cc0"
_END = r"([.!?;:])[ \t\r\f\x0b]+"  # of the SQL twin, which looks up single pieces
#: Ends of pieces, found in lower-cased text, become an S: a line's end with the next line's
#: indent and comment leader, or a sentence mark before blanks. Two S in a row are a blank line.
_MARK = (
    r"(?:[.!?;:][ \t\r\f\x0b]*+)?\n[^a-z0-9\n]*+(?:(?:rem|dnl)(?![a-z0-9]))?"
    r"|^[^a-z0-9\n]*+(?:rem|dnl)(?![a-z0-9])|[.!?;:][ \t\r\f\x0b]+"
)


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, UPPER, LOWER), "[^a-z0-9]+", " "))


def _known() -> dict[str, str]:
    return {s: k for k, ss in SENTENCES.items() for s in ss}


def _tree(sentences: list[list[str]]) -> str:
    """A pattern of the sentences, given as words, with at most one S between two words."""
    forms = []
    for w in sorted({s[0] for s in sentences}):
        rest = [s[1:] for s in sentences if s[0] == w]
        more = [s for s in rest if s]
        forms.append(w + (f"(?:(?: ?S ?| ){_tree(more)})" + ("?" if len(more) < len(rest) else "") if more else ""))
    return f"(?:{'|'.join(forms)})"


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licenses, has_license)`` for every
    row of ``docs``: how many sentences are known, their identifiers in order of
    occurrence and the licences whose rules match, each joined by commas.

    A piece ends at a line's end, or at one of ``. ! ? ; :`` before white space;
    a run of whole pieces is a known sentence if it equals one when lower-cased
    (A-Z) and reduced to a-z and 0-9. So sentences may be wrapped; comment leaders
    (signs, ``rem``, ``dnl``) are left out, and no run goes over a line without a
    letter or digit. Of runs that overlap the first and longest counts. Defined cases: null, empty and licence-free texts have 0, two
    empty strings and false; null doc_ids and repeated rows come back as they
    came; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pairs = [F.lit(x) for kv in _known().items() for x in kv]
    table = F.create_map(*pairs)
    plain = F.regexp_replace(F.regexp_replace(F.translate(F.col("t"), UPPER, LOWER), _MARK, "S"), "[^a-z0-9S]+", " ")
    runs = F.regexp_extract_all(plain, F.lit(f"(?:^|S) ?({_tree([k.split(' ') for k in _known()])})(?= ?(?:S|$))"), F.lit(1))
    found = F.transform(runs, lambda x: F.element_at(table, F.regexp_replace(x, "[ S]+", " ")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.when(F.col("t").rlike(f"(?i){MARKS}"), found).otherwise(F.array().cast("array<string>")).alias("ids"),
    )
    rows = rows.withColumn("line", F.array_join("ids", ","))
    names = list(dict.fromkeys(name for name, _ in RULES))
    hits = []
    for name in names:
        forms = ["(^|,)" + "(,.*)?,".join(ids) + "(,|$)" for n, ids in RULES if n == name]
        hits.append(F.when(F.col("line").rlike("|".join(forms)), F.lit(name)))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.col("line").alias("sentence_ids"),
        F.concat_ws(",", *hits).alias("licenses"),
        F.coalesce(*hits).isNotNull().alias("has_license"),
    )


def _sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for s, k in _known().items())
    names = list(dict.fromkeys(name for name, _ in RULES))
    forms = {n: "|".join("(^|,)" + "(,.*)?,".join(ids) + "(,|$)" for m, ids in RULES if m == n) for n in names}
    hits = ", ".join(f"CASE WHEN regexp_matches(line, '{forms[n]}') THEN '{n}' END" for n in names)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT r, unnest(s) AS s, generate_subscripts(s, 1) AS i
      FROM (SELECT r, string_split(regexp_replace(t, '{_END}', '\1' || chr(10), 'g'), chr(10)) AS s FROM t)),
n AS (SELECT r, i, trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s FROM p),
k(s, id) AS (VALUES {known}),
h AS (SELECT r, count(*) AS c, string_agg(id, ',' ORDER BY i) AS line FROM n JOIN k USING (s) GROUP BY r),
j AS (SELECT doc_id, coalesce(c, 0) AS c, coalesce(line, '') AS line FROM t LEFT JOIN h USING (r)),
l AS (SELECT doc_id, c, line, concat_ws(',', {hits}) AS licenses FROM j)
SELECT doc_id, CAST(c AS BIGINT) AS n_sentences, line AS sentence_ids, licenses, licenses <> '' AS has_license FROM l
"""


SQL = _sql()
