"""Licence headers as they stand in files: wrapped, inside comments, among other text; the SQL agrees on all of them."""

import textwrap

import duckdb
import pytest

from millrace.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the rest."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
GNU = 'This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{stop} either version {n} of the License, or (at your option) any later version.\n\nThis {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.'
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."""
BSD3 = BSD2 + "\n\n3. Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."
HEADERS = [
    ("Apache-2.0", APACHE), ("MIT", MIT), ("ISC", ISC), ("MPL-2.0", MPL), ("Zlib", ZLIB), ("BSD-2-Clause", BSD2),
    ("BSD-3-Clause", BSD3.format("the copyright holder")), ("BSD-3-Clause", BSD3.format("Example Corp. Inc").replace("Corp.", "Corp")),
    ("GPL-2.0", GNU.format(what="program", mark=";", kind="", stop=";", n="2")), ("GPL-3.0", GNU.format(what="program", mark=":", kind="", stop=",", n="3")),
    ("LGPL-2.1", GNU.format(what="library", mark=";", kind="Lesser ", stop=";", n="2.1")), ("LGPL-3.0", GNU.format(what="library", mark=":", kind="Lesser ", stop=",", n="3")),
    ("AGPL-3.0", GNU.format(what="program", mark=":", kind="Affero ", stop=",", n="3")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at a site."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy."),
]


def wrapped(text: str, width: int, mark: str, end: str = "\n") -> str:
    lines = [line for part in text.split("\n\n") for line in [*textwrap.wrap(part, width), ""]]
    return end.join(["", mark.rstrip(), *[(mark + line).rstrip() for line in lines], "", "import os", "x = 1"])


def scanned(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    got = {r["doc_id"]: (r["n_sentences"], r["sentence_ids"], r["licenses"]) for r in licenses.scan(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    assert {r[0]: r[1:] for r in con.execute(licenses.sql()).fetchall()} == got
    return got


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * ", "-- ", ";; ", "    "])
def test_headers_in_files(spark, mark):
    rows, want = [], {}
    for name, text in HEADERS:
        for width, end in ((72, "\n"), (30, "\n"), (100_000, "\n"), (72, "\r\n")):
            want[len(rows)] = name
            rows.append((len(rows), "Copyright 2020 Some One" + wrapped(text, width, mark, end)))
    got = scanned(spark, rows)
    assert {k: v[2] for k, v in got.items()} == want


def test_not_a_licence(spark):
    texts = [
        "the mit license is one that many people like", "we went and were released. under the MIT license", "Licensed under the Apache License.\n\nVersion 2.0",
        "Redistributions of source code must retain the above copyright notice", "SPDX-License-Identifier: MITX", "released under the mit licenses", "", None, " \n\t\n", "|/ | / |",
    ]
    got = scanned(spark, list(enumerate(texts)))
    assert {k: v[2] for k, v in got.items()} == {k: "" for k in range(len(texts))}
    assert [got[k][:2] for k in (3, 6, 7)] == [(1, "18"), (0, ""), (0, "")]


def test_lines_and_their_order(spark):
    rows = [
        (1, "// SPDX-License-Identifier: GPL-2.0-or-later"), (2, "Notes\nReleased under the MIT license\nmore words"), (3, "License: (released under the\nMIT license)"),
        (4, "All rights reserved. Licensed under CC-BY-SA-4.0!"), (5, MIT + "\n\n" + APACHE), (6, "\n\n".join(reversed(MIT.split("\n\n")))), (7, "x " * 300_000 + ". released under the MIT license"),
    ]
    got = scanned(spark, rows)
    assert {k: v[2] for k, v in got.items()} == {1: "GPL-2.0", 2: "MIT", 3: "MIT", 4: "CC-BY-SA-4.0,Proprietary", 5: "Apache-2.0,MIT", 6: "", 7: "MIT"}


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "released under the mit license", "6", "x"), (1, "released under the mit license", "6", "x"), (2, None, None, None)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, sentence_ids string, licenses string"))
    assert sorted(out.collect()) == [(1, 1, "4", "MIT"), (1, 1, "4", "MIT"), (2, 0, "", "")]
    assert "Exchange" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Python" not in plan


def test_tables():
    assert len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES) and len(licenses.LICENSES) >= 25
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)
