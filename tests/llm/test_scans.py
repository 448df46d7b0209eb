import random
import textwrap

import numpy as np
import pytest

from tessera.llm import decontam, licences
from tests.conftest import SF01
from tests.oracle import assert_same


def test_licence_query_equals_sql(spark):
    from tessera.llm.queries import op2_licences

    out = op2_licences(spark, SF01)
    assert_same(out, licences.sql(), SF01)
    assert {r.licences for r in out.where("n_sentences > 0").collect()} >= {"MIT", "GPL-3.0", "Apache-2.0", "CC-BY-NC-4.0"}


def test_every_known_sentence_has_a_marker():
    for forms in licences.SENTENCES.values():
        for s in forms:
            assert any(m in s for m in licences.MARKERS), s


def test_licence_edge_rows(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\x20of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    rows = [(1, None, "x"), (2, "", "x"), (3, mit, None), (4, "a. Licensed under CC BY-NC 4.0.\nReleased under the MIT License", None), (4, "mit license", None), (None, "x " * 100_000 + "\nAll rights reserved!", None), (5, "unlicensed", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = sorted((str(r.doc_id), r.licences, r.licence_sentences) for r in licences.scan(df).collect())
    assert got == [("1", [], []), ("2", [], []), ("3", ["MIT"], ["mit_grant", "mit_keep", "as_is"]), ("4", ["CC-BY-NC-4.0", "MIT"], ["cc_by_nc_notice", "mit_notice"]), ("4", ["MIT"], ["mit_notice"]), ("5", [], []), ("None", ["proprietary"], ["all_rights"])]
    assert licences.scan(df.where("false")).count() == 0


GPL3 = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
]
MIT = [
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
BSD2 = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
BSD3 = BSD2 + ["3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]
LGPL21 = [GPL3[0].replace("program", "library").replace("General", "Lesser General").replace("version 3", "version 2.1"), GPL3[1].replace("program", "library").replace("General", "Lesser General")]
AGPL = [GPL3[0].replace("General", "Affero General"), GPL3[1].replace("General", "Affero General")]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."]
ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.',
]
ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
]
UNLICENSE = ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."]
BOOST = [
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'
]
NOTICES = {"LGPL-2.1-or-later": LGPL21, "AGPL-3.0-or-later": AGPL, "MPL-2.0": MPL, "ISC": ISC, "Zlib": ZLIB, "Unlicense": UNLICENSE, "BSL-1.0": BOOST, "GPL-3.0-or-later": GPL3, "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3}


def licences_of(spark, texts):
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.licences for r in sorted(rows, key=lambda r: r.doc_id)]


def test_each_notice_matches_its_rule(spark):
    assert licences_of(spark, ["\n\n".join(n) for n in NOTICES.values()]) == [[k] for k in NOTICES]
    assert licences_of(spark, ["All. Rights reserved. All rights\n\nreserved", "x: MIT License; y"]) == [[], ["MIT"]]


def test_wrapped_notices_match_their_rules(spark):
    def wrapped(notice, first, width, end):
        return (end + first.rstrip() + end).join(end.join(textwrap.wrap(p, width, initial_indent=first, subsequent_indent=first)) for p in notice)

    for first, width, end in (("", 70, "\n"), (" * ", 76, "\n"), ("# ", 80, "\r\n"), ("// ", 40, "\r")):
        assert licences_of(spark, [wrapped(n, first, width, end) for n in NOTICES.values()]) == [[k] for k in NOTICES]
    apache = spark.createDataFrame([(1, wrapped(APACHE, "// ", 72, "\n"))], "doc_id long, text string")
    assert licences.scan(apache).first().licence_sentences == ["apache_notice", "apache_comply", "apache_copy", "apache_as_is"]
    # a line of its own counts beside other lines; a sentence doesn't run over a blank line
    assert licences_of(spark, ["words\nMIT License\nmore words", "all\nrights\nreserved", "all rights\n\nreserved", "all rights\n#\n# reserved"]) == [["MIT"], ["proprietary"], [], []]


def test_wand_equals_scoring_every_unit():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words[: rng.choice([10, 60])]) for _ in range(rng.randrange(1, 120)))) for i in range(40)]
    index = decontam.Index.build(items)
    for _ in range(300):
        terms = np.array(sorted(rng.sample(range(len(index.lists)), rng.randrange(1, 40))))
        share = rng.choice([0.1, 0.3, 0.5, 0.9])
        score = np.zeros(len(index.unit_item))
        for t in terms:
            at, impact = index.lists[t]
            score[at] += impact
        got = sorted(u for b in range(index.bounds.shape[1]) for u in index.wand(terms, share, b))
        assert set(np.flatnonzero(score >= share + 1e-9)) <= set(got) <= set(np.flatnonzero(score >= share - 1e-9))


def test_query_finds_exactly_the_documents_that_hold_items(spark):
    from tessera.llm.queries import op5_decontamination

    items = [(r.item_id, " ".join(decontam.words_of(r.text))) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    docs = {r.doc_id: " " + " ".join(decontam.words_of(r.text)) + " " for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    want = {i: {k for k, t in items if f" {t} " in d} for i, d in docs.items()}
    got = op5_decontamination(spark, SF01).collect()
    assert len(got) == len(docs) and sum(map(bool, want.values())) > 5
    for r in got:
        assert set(r.item_ids) >= want[r.doc_id] and r.contaminated == (r.n_items > 0)
        if not want[r.doc_id]:  # half of an item's word runs at least
            for k in r.item_ids:
                w = dict(items)[k].split()
                assert any(" ".join(w[j : j + 5]) in docs[r.doc_id] for j in range(len(w)))


def verified(index, text, share=0.5, gram=5):
    """Items whose question or answer the whole text holds by half of its grams, without an index."""
    words, out = decontam.words_of(text or ""), set()
    for k, (q, a) in enumerate(index.parts):
        for part in (q, a):
            n = min(gram, len(part))
            grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)} if n and n >= min(gram, len(q)) else set()
            if grams and len(grams & {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) >= share * len(grams):
                out.add(k)
    return out


def test_each_part_is_found_alone():
    parts = [(5, 20), (6, 11), (7, 32), (9, 5), (30, 6), (12, 7), (2, 9), (20, 3), (10, 0), (60, 70)]
    items = [(i, " ".join(f"q{i}w{j}" for j in range(q)) + ("\nanswer: " + " ".join(f"a{i}w{j}" for j in range(a)) if a else "")) for i, (q, a) in enumerate(parts)]
    index = decontam.Index.build(items)
    fill = [f"filler{i}" for i in range(70)]
    for k, (q, a) in enumerate(index.parts):
        for part in (q, a):
            for before in (0, 13, 24, 31):
                text = " ".join(fill[:before] + part + fill)
                got = {i for i, *_ in decontam.search(index, text, 64, 0.5, 0.5, 5)}
                assert got == verified(index, text) == ({k} if part and (part is q or len(a) >= min(5, len(q))) else set())


def test_query_equals_verifying_every_item(spark):
    from tessera.llm.queries import op5_decontamination

    items = sorted((r.item_id, r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect())
    index = decontam.Index.build(items)
    want = {r.doc_id: sorted(index.ids[k] for k in verified(index, r.text)) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert {r.doc_id: r.item_ids for r in op5_decontamination(spark, SF01).collect()} == want


def test_decontamination_edge_rows(spark):
    item = "which of these seven quiet rivers runs north past the old mill\nanswer: the long grey river under the bridge of stones"
    fill = " ".join(f"filler{i % 97} word{i % 89}" for i in range(30_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, item.upper(), None), (3, item.upper(), None), (None, fill + " " + item + " " + fill, None), (4, fill, None), (5, "the long grey river under the bridge of stones, so it says", None), (6, "which of these", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, leaks string")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "  ")] + [(i, f"item {i} about topic{i} and thing{i} of kind{i}") for i in range(20, 40)], "item_id long, text string")
    got = decontam.leaks(df, items).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append({x.item_id for x in r.leaks})
    assert by == {1: [set()], 2: [set()], 3: [{7}, {7}], None: [{7}], 4: [set()], 5: [{7}], 6: [set()]}
    assert decontam.leaks(df, items.where("false")).where("size(leaks) > 0").count() == 0
    # with both, a document that holds the answer alone keeps the item clean
    strict = {r.doc_id: [(x.item_id, x.question, x.answer) for x in r.leaks] for r in decontam.leaks(df, items, both=True).collect()}
    assert strict[5] == [] and strict[3] == [(7, 1.0, 1.0)] * 2


def test_columns_of_the_operators_own_names_keep_their_values(spark):
    df = spark.createDataFrame([(1, "mit license", "mine", "too")], "doc_id long, text string, __text string, __text_ string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert tuple(decontam.leaks(df, items).first())[:4] == (1, "mit license", "mine", "too")
    assert decontam.leaks(df.where("false"), items).count() == 0


def test_too_many_items_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_ITEMS", 2)
    items = spark.createDataFrame([(i, "a b c") for i in range(3)], "item_id long, text string")
    with pytest.raises(ValueError):
        decontam.leaks(items.withColumnRenamed("item_id", "doc_id"), items)
