"""Licence scan by sentence rules: sentences become identifiers, identifier sequences match ordered rules.

A text is split where a sentence ends, at lines without a word and at line breaks; each sentence is
normalised (lower case, letters and digits, single blanks) and looked up among known licence
sentences, which may run over ``;``, ``:`` and single line breaks, so wrapped ones and ones in
comments count. Known are notices of AGPL-3.0(-or-later), Apache-2.0, BSD-2-Clause, BSD-3-Clause,
BSL-1.0, CC-BY-4.0, CC-BY-NC-4.0, CC-BY-SA-4.0, CC0-1.0, EPL-2.0, GPL-2.0, GPL-3.0(-or-later), ISC,
LGPL-2.1(-or-later), LGPL-3.0(-or-later), MIT, MPL-2.0, Unlicense, Zlib and "all rights reserved";
others are not found. What is known, in
order, is the text's identifier sequence; a rule is a run of identifiers, and it matches where the
sequence holds that run. A rule within a longer matching rule does not count. Built-in expressions
only, so a scan is one pass without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in their normalised form, by identifier.
SENTENCES = {
    "mit_notice": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "the mit license mit", "mit license"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_keep": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "apache_notice": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
        "this work is licensed under the apache license version 2 0",
        "this project is licensed under the apache license version 2 0",
        "apache license version 2 0",
    ],
    "apache_comply": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at"],
    "apache_as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "gpl3_notice": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
        "this program is licensed under the gnu general public license version 3",
        "gnu general public license version 3",
    ],
    "gpl2_notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "gnu general public license version 2"],
    "gpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_details": ["see the gnu general public license for more details"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc_by_nc_notice": ["licensed under cc by nc 4 0", "released under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc_by_notice": ["licensed under cc by 4 0", "released under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc_by_sa_notice": ["licensed under cc by sa 4 0", "released under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0_notice": ["released under cc0 1 0", "licensed under cc0 1 0", "this work is released under the cc0 1 0 license"],
    "all_rights": ["all rights reserved"],
    "agpl_free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl_details": ["see the gnu affero general public license for more details"],
    "agpl3_notice": ["licensed under the gnu affero general public license version 3", "released under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3", "this program is licensed under the gnu affero general public license version 3"],
    "bsl_grant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
    ],
    "bsl_notice": ["distributed under the boost software license version 1 0", "licensed under the boost software license version 1 0"],
    "epl_notice": ["licensed under the eclipse public license 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc_as_is": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc_notice": ["licensed under the isc license", "released under the isc license", "this work is licensed under the isc license", "isc license"],
    "lgpl21_free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "lgpl3_free": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl_hope": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl_details": ["see the gnu lesser general public license for more details"],
    "lgpl21_notice": ["licensed under the gnu lesser general public license version 2 1", "released under the gnu lesser general public license version 2 1", "this work is licensed under the gnu lesser general public license version 2 1"],
    "lgpl3_notice": ["licensed under the gnu lesser general public license version 3", "released under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "mpl_terms": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl_copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"],
    "mpl_notice": ["licensed under the mozilla public license version 2 0", "released under the mozilla public license version 2 0", "this work is licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"],
    "unlicense_domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense_anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "zlib_as_is": ["this software is provided as is without any express or implied warranty"],
    "zlib_damages": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib_grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
}
# Rules as runs of identifiers, with the licence each stands for.
RULES = [
    ("Apache-2.0", ["apache_notice", "apache_comply", "apache_copy", "apache_as_is"]),
    ("Apache-2.0", ["apache_notice"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("CC-BY-4.0", ["cc_by_notice"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_notice"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_notice"]),
    ("CC0-1.0", ["cc0_notice"]),
    ("GPL-2.0", ["gpl2_notice"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_details"]),
    ("GPL-3.0", ["gpl3_notice"]),
    ("MIT", ["mit_grant", "mit_keep", "as_is"]),
    ("MIT", ["mit_notice"]),
    ("proprietary", ["all_rights"]),
    ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope", "agpl_details"]),
    ("AGPL-3.0", ["agpl3_notice"]),
    ("BSL-1.0", ["bsl_grant"]),
    ("BSL-1.0", ["bsl_notice"]),
    ("EPL-2.0", ["epl_notice"]),
    ("ISC", ["isc_grant", "isc_as_is"]),
    ("ISC", ["isc_notice"]),
    ("LGPL-2.1-or-later", ["lgpl21_free", "lgpl_hope", "lgpl_details"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "lgpl_hope", "lgpl_details"]),
    ("LGPL-2.1", ["lgpl21_notice"]),
    ("LGPL-3.0", ["lgpl3_notice"]),
    ("MPL-2.0", ["mpl_terms", "mpl_copy"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("Unlicense", ["unlicense_domain", "unlicense_anyone"]),
    ("Zlib", ["zlib_as_is", "zlib_damages", "zlib_grant"]),
]
#: Every known sentence holds one of these, so a text without any is not split.
MARKERS = ("licen", "permi", "redistribut", "warrant", "cc", "reserved", "mpl", "unencumbered", "anyone is free", "damages")
SPLIT = r"[\n\r]+|[.!?;:]+(\s+|$)"
#: Lines without a word, where ``;`` or ``:`` ends a part of a sentence, and where a sentence ends; they and single line breaks become the marks below.
BLANK, JOINT, END = r"\n[^a-z0-9]*\n", r"(?<![.!?;:])[;:]++(?:\s++|$)", r"(?<![.!?;:])[.!?;:]++(?:\s++|$)"
MARKS = "\x01\x02"
#: A known sentence begins and ends at any mark; between its words may be joints (the second mark), but no end.
KNOWN = (
    r"(?<=[\x01\x02] ?)(?:" + "|".join(s.replace(" ", r"[ \x02]+") for s in sorted({s for forms in SENTENCES.values() for s in forms}, key=lambda s: (-len(s), s))) + r")(?= ?[\x01\x02])"
)


def _run(identifiers: list[str]) -> str:
    return "," + ",".join(identifiers) + ","


def rule_tests(rules: list[tuple[str, list[str]]] = RULES) -> list[tuple[str, str, list[str]]]:
    """For each rule its licence, its run, and the runs of the longer rules that hold it."""
    return [(name, _run(ids), [_run(o) for _, o in rules if len(o) > len(ids) and _run(ids) in _run(o)]) for name, ids in rules]


def sentences_of(text: Column) -> Column:
    """The known sentences of a text in order, normalised; where two overlap the first, then the longest."""
    plain = F.lower(F.translate(text, MARKS, " " * len(MARKS)))
    parted = F.regexp_replace(plain, r"\r\n?", "\n")
    for pattern, mark in ((BLANK, "\x01"), (JOINT, "\x02"), (END, "\x01"), (r"\n", "\x02")):
        parted = F.regexp_replace(parted, pattern, mark)
    words = F.concat(F.lit("\x01"), F.regexp_replace(parted, r"[^a-z0-9\x01\x02]+", " "), F.lit("\x01"))
    return F.transform(F.regexp_extract_all(words, F.lit(KNOWN), F.lit(0)), lambda s: F.regexp_replace(s, r"[ \x02]+", " "))


def scan(df: DataFrame, text: str = "text", sentences: str = "licence_sentences", licences: str = "licences") -> DataFrame:
    """Add the identifiers of the text's licence sentences in order, and the sorted licences whose rules match; both are arrays.

    Null, empty and other texts without a known sentence get empty arrays. Repeated rows stay;
    other columns pass through, and those named as outputs are replaced.
    """
    raw = F.col(f"`{text}`").cast("string")
    table = F.create_map(*[F.lit(x) for i, forms in SENTENCES.items() for s in forms for x in (s, i)])
    found = F.transform(sentences_of(raw), lambda s: F.try_element_at(table, s))
    some = reduce(lambda a, b: a | b, [F.lower(raw).contains(m) for m in MARKERS])
    ids = F.coalesce(F.when(some, found), F.array().cast("array<string>"))
    out = df.withColumn(sentences, ids)
    run = F.concat(F.lit(","), F.array_join(F.col(f"`{sentences}`"), ","), F.lit(","))
    tests = [F.when(run.contains(own) & ~reduce(lambda a, b: a | b, [run.contains(x) for x in longer], F.lit(False)), F.lit(name)) for name, own, longer in rule_tests()]
    return out.withColumn(licences, F.array_sort(F.array_distinct(F.filter(F.array(*tests), lambda x: x.isNotNull()))))


def sql(table: str = "documents") -> str:
    """The scan in DuckDB's SQL: doc_id, n_sentences, sentence_ids and licences (joined by commas); it doesn't join a sentence's parts over ``;``, ``:`` and line breaks."""
    known = ", ".join(f"'{s}': '{i}'" for i, forms in SENTENCES.items() for s in forms)
    tests = ", ".join(f"CASE WHEN contains(run, '{own}')" + "".join(f" AND NOT contains(run, '{x}')" for x in longer) + f" THEN '{name}' END" for name, own, longer in rule_tests())
    return f"""
WITH split AS (
  SELECT doc_id, string_split_regex(coalesce(text, ''), '{SPLIT.replace("(", "(?:")}') AS parts FROM {table}
), known AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: MAP {{{known}}}[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda i: i IS NOT NULL) AS ids FROM split
), runs AS (
  SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS run FROM known
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(list_filter([{tests}], lambda x: x IS NOT NULL))), ',') AS licences
FROM runs
"""
