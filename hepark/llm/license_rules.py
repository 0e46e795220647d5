r"""Licence recognition by sentence rules (DataFrame functions only).

A text is cut into sentences, sentences are normalised (lower case, letters,
digits and single spaces), and those equal to a known licence sentence become
identifiers.  A sentence ends at . ! or ? before white space ("v." before a number
excepted), at a blank line (also one of comment marks) and at the text's end.  Line
ends, ; and : may end it or lie within, so wrapped and commented texts match; where
several known sentences begin at one place the longest counts.  Sentences that name a
licence ("this project is released under the X license") are one template with slots: a
subject, a verb, a name out of :func:`licence_names` and a closing; so are SPDX tags.  The sequence of a document's identifiers is matched against
ordered rules: a licence is found where all its sentences occur in order, other
known sentences between them allowed.

Edge cases: null or empty text and texts without known sentences give an empty
list; repeated sentences match once per rule; rows that share a doc_id are kept
apart; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hepark.llm.common import id_text

# Public licence sentences (as normalised) and their identifiers.
SENTENCES: dict[str, str] = {
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "this project is licensed under the mit license": "mit_ref",
    "the mit license": "mit_title",
    "mit license": "mit_title",
    "the mit license mit": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liability",
    "licensed under the apache license version 2 0": "apache2_ref",
    "licensed under the apache license version 2 0 the license": "apache2_head",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_limits",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 2": "gpl2_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_no_warranty",
    "see the gnu general public license for more details": "gpl_details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_name",
    "licensed under cc by nc 4 0": "cc_by_nc4_ref",
    "licensed under cc by 4 0": "cc_by4_ref",
    "licensed under cc by sa 4 0": "cc_by_sa4_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc_by4_ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc_by_nc4_ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc_by_sa4_ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_ref",
    "this is free and unencumbered software released into the public domain": "unlicense_grant",
}

# A licence and the ordered sentences of each way to recognise it.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is", "mit_liability")),
    ("Apache-2.0", ("apache2_ref",)),
    ("Apache-2.0", ("apache2_head", "apache2_comply", "apache2_as_is", "apache2_limits")),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL-3.0-or-later", ("gpl3_grant", "gpl_no_warranty", "gpl_details")),
    ("GPL-2.0", ("gpl2_ref",)),
    ("GPL-2.0-or-later", ("gpl2_grant", "gpl_no_warranty", "gpl_details")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_name")),
    ("CC-BY-NC-4.0", ("cc_by_nc4_ref",)),
    ("CC-BY-4.0", ("cc_by4_ref",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_ref",)),
    ("ISC", ("isc_grant",)),
    ("MPL-2.0", ("mpl2_ref",)),
    ("Unlicense", ("unlicense_grant",)),
]

# Names of licences (as normalised, without a last "license").
NAMES: dict[str, str] = {
    "mit": "MIT", "mit x11": "MIT", "expat": "MIT",
    "apache 2": "Apache-2.0", "apache 2 0": "Apache-2.0", "apache v2": "Apache-2.0", "apache v2 0": "Apache-2.0",
    "apache version 2 0": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0",
    "apache license version 2 0": "Apache-2.0", "apache software license 2 0": "Apache-2.0",
    "bsd 2 clause": "BSD-2-Clause", "2 clause bsd": "BSD-2-Clause", "simplified bsd": "BSD-2-Clause",
    "bsd 3 clause": "BSD-3-Clause", "3 clause bsd": "BSD-3-Clause", "new bsd": "BSD-3-Clause",
    "modified bsd": "BSD-3-Clause", "revised bsd": "BSD-3-Clause",
    "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", "wtfpl": "WTFPL", "0bsd": "0BSD",
    "mpl 2 0": "MPL-2.0", "mpl v2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0",
    "mozilla public license v2 0": "MPL-2.0", "mozilla public license v 2 0": "MPL-2.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "epl 2 0": "EPL-2.0", "eclipse public license 2 0": "EPL-2.0", "eclipse public license v 2 0": "EPL-2.0",
    "boost software license 1 0": "BSL-1.0", "boost software license version 1 0": "BSL-1.0", "bsl 1 0": "BSL-1.0",
    "cc0": "CC0-1.0", "cc0 1 0": "CC0-1.0", "cc0 1 0 universal": "CC0-1.0",
    "creative commons zero": "CC0-1.0", "creative commons zero v1 0 universal": "CC0-1.0",
    "creative commons cc0 1 0 universal": "CC0-1.0",
}
GNU = {"GPL": ("general", ("2.0", "3.0")), "LGPL": ("lesser general", ("2.1", "3.0")), "AGPL": ("affero general", ("3.0",))}
CC = {"BY": "attribution", "NC": "noncommercial", "SA": "sharealike", "ND": "noderivatives"}
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")


def licence_names() -> dict[str, str]:
    """Every form of a licence's name -> its SPDX identifier: the fixed names, and those of the
    GNU and Creative Commons families by rule (family x version x way to write both)."""
    out = dict(NAMES)
    for short, (kind, versions) in GNU.items():
        low = short.lower()
        names = (low, f"gnu {low}", f"{kind} public license", f"gnu {kind} public license")
        for name, version in product(names, versions):
            full = version.replace(".", " ")
            for number in {full, full.removesuffix(" 0")}:
                for form in (f"{name} {number}", f"{name} v{number}", f"{name}v{number}", f"{name} version {number}"):
                    out[form] = out[f"{form} only"] = f"{short}-{version}"
                    out |= {f"{form} {later}": f"{short}-{version}-or-later" for later in ("or later", "or any later version")}
    for kind, version in product(CC_KINDS, ("3.0", "4.0")):
        words = [CC[k] for k in kind.split("-")]
        number = version.replace(".", " ")
        apart = [{"noncommercial": "non commercial", "sharealike": "share alike", "noderivatives": "no derivatives"}.get(w, w)
                 for w in words]
        for name in (normalise(f"CC {kind}"), "creative commons " + " ".join(words), "creative commons " + " ".join(apart)):
            for place in ("", " international", " unported"):
                out[f"{name} {number}{place}"] = f"CC-{kind}-{version}"
    return out


def reference(names: str, gap: str) -> str:
    """The pattern of a sentence that names a licence: ``names`` is the slot, ``gap`` stands
    between words."""
    def alt(words: str) -> str:
        return "(?:" + "|".join(w.replace(" ", gap) for w in words.split("|")) + ")"

    subject = f"(?:{alt('this|the|all|our|its')}{gap})?(?:{alt('source code|project|software|code|work|program|library|package|repository|file|module|content|documentation|it')}{gap})?" \
              f"(?:{alt('is free software|is|are')}{gap})?"
    verb = f"{alt('licensed|licenced|released|distributed|made available|available|published|provided|shared|offered')}{gap}under" \
           f"(?:{gap}{alt('the|a|an')})?(?:{gap}terms(?:{gap}and{gap}conditions)?{gap}of(?:{gap}the)?)?"
    closing = f"(?:{gap}licen[sc]e)?(?:{gap}see(?:{gap}the)?{gap}licen[sc]e(?:{gap}{alt('file|md|txt')})*(?:{gap}for(?:{gap}more)?{gap}details)?)?"
    return f"(?:{subject}{verb}|spdx{gap}license{gap}identifier){gap}{names}{closing}"


def slot(names: dict[str, str], gap: str) -> str:
    return "|".join(n.replace(" ", gap) for n in sorted(names, key=lambda n: (-len(n), n)))


#: Steps on the lower-cased text.  Marks are capitals, which it lacks: H ends a
#: sentence, S (; and :) and N (a line end) may.
STEPS = (
    (r"\r\n?", "\n"),
    (r"(?<![^\n])[^a-z0-9\n]*+(?:dnl|rem)(?=[^a-z0-9])", " "),
    (r"(?<![a-z0-9])v\.(?=\s[^a-z0-9.!?]{0,40}+[0-9])", "v"),
    (r"[.!?](?=\s|$)", "H"),
    (r"[;:](?=\s|$)", "S"),
    (r"\n", "N"),
    (r"[^a-z0-9HSN]++", " "),
    (r"N(?=[ S]*+N)", "H"),
)


def normalise(sentence: str) -> str:
    """What the DataFrame expression does to one sentence (for tests and rules)."""
    return re.sub(r"[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip(" ")


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  sentences: dict[str, str] | None = None,
                  rules: list[tuple[str, tuple[str, ...]]] | None = None,
                  names: dict[str, str] | None = None) -> DataFrame:
    """doc_id, ``sentence_ids`` (in text order), ``licenses`` (sorted names).

    The tables are parameters of fixed size: literals of the plan."""
    sentences, names = sentences or SENTENCES, names or licence_names()
    rules = (rules or RULES) + [(name, (f"ref:{name}",)) for name in sorted(set(names.values()))]
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(f"ref:{i}") for i in names.values()]))
    known = F.map_from_arrays(F.array(*[F.lit(s) for s in sentences]),
                              F.array(*[F.lit(i) for i in sentences.values()]))
    # a text that holds none of the known sentences' first words has no match
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hints = sorted({w for s in sentences for w in s.split() if w in HINTS})
    covered = all(set(s.split()) & set(hints) for s in sentences)
    hint = F.lit(True)
    if covered:
        hint = F.regexp_like(F.col("lower"), F.lit("|".join([*hints, NAMING])))
    marked = F.col("lower")
    for pattern, mark in STEPS:
        marked = F.regexp_replace(marked, pattern, mark)
    ways = "|".join("[ SN]++".join(x.split()) for x in sorted(sentences, key=len, reverse=True))
    ways += "|" + reference(f"(?:{slot(names, '[ SN]++')})", "[ SN]++")
    found = F.transform(
        F.regexp_extract_all(F.concat(F.lit("H"), marked, F.lit("H")), F.lit(f"[HSN] ?({ways})(?= ?[HSN])"), F.lit(1)),
        lambda s: F.regexp_replace(s, "[ SN]+", " "))
    ids = F.transform(found, lambda s: F.coalesce(F.element_at(known, s), F.element_at(
        named, F.regexp_extract(s, f"^{reference(f'({slot(names, chr(32))})', ' ')}$", 1))))
    docs = id_text(docs, id_col, text_col).select("doc_id", lower.alias("lower")).select(
        "doc_id", F.when(hint, F.filter(ids, lambda i: i.isNotNull()))
        .otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    seq = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    hits = [F.when(F.regexp_like(seq, F.lit("(?s)" + ".*".join(f" {re.escape(i)} " for i in way))), F.lit(name))
            for name, way in rules]
    return docs.withColumn("licenses", F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>"))
                           .otherwise(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))))


#: Words of which every known sentence holds one; texts without them are skipped.
HINTS = {"license", "licensed", "permission", "copyright", "software", "redistribution", "warranties",
         "warranty", "redistributions", "licenses"}

#: How a sentence that names a licence shows, in texts without those words.
NAMING = r"(?:released|distributed|available|published|provided|shared|offered)[^a-z0-9]+under|licenced|spdx"


def query(docs: DataFrame) -> DataFrame:
    return find_licenses(docs).select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
                                      F.array_join("sentence_ids", ",").alias("sentence_ids"),
                                      F.array_join("licenses", ",").alias("licenses"))


def oracle() -> str:
    """The same in DuckDB SQL, from the same tables."""
    keys = ", ".join("'" + s + "'" for s in SENTENCES)
    vals = ", ".join("'" + i + "'" for i in SENTENCES.values())
    names = licence_names()
    forms, refs = ", ".join(f"'{n}'" for n in names), ", ".join(f"'ref:{i}'" for i in names.values())
    ref = f"^{reference(f'({slot(names, chr(32))})', ' ')}$"
    hits = ", ".join(f"CASE WHEN regexp_matches(seq, '{'.*'.join(f' {i} ' for i in way)}', 's') THEN '{name}' END"
                     for name, way in RULES + [(n, (f"ref:{n}",)) for n in sorted(set(names.values()))])
    return rf"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, list_filter(list_transform(
        list_transform(regexp_split_to_array(regexp_replace(regexp_replace(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            'spdx-license-identifier: ', 'spdx license identifier ', 'g'), '[\r\n]+|[.!?;:]+(\s|$)', chr(10), 'g'), '\n'),
            lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))),
        lambda x: coalesce(map([{keys}], [{vals}])[x], map([{forms}], [{refs}])[regexp_extract(x, '{ref}', 1)])),
        lambda x: x IS NOT NULL) AS ids FROM s),
q AS (SELECT doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS seq FROM c)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM q
"""
