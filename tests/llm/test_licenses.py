"""Licence recognition: standard headers and titles, wrapped and commented; the query and its SQL twin over one rule set."""

import duckdb
import pyarrow as pa
import pytest

from test_advice_r02 import APACHE, BSD, MIT, commented

from tarmac.llm import licenses

GPL = """This program is free software{a} you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation{b} either version {v} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright (c) 2020, Some One

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""
BSL = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)
"""
TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
"""


def gnu(name, v, a=";", b=";"):
    return GPL.format(name=name, v=v, a=a, b=b)


STANDARD = [
    (APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD-3-Clause"), (MPL, "MPL-2.0"), (ISC, "ISC"), (UNLICENSE, "Unlicense"),
    (ZLIB, "Zlib"), (EPL, "EPL-2.0"), (BSL, "BSL-1.0"), (TITLE, "GPL-3.0"),
    (gnu("General Public License", "2"), "GPL-2.0-or-later"), (gnu("General Public License", "3", ":", ","), "GPL-3.0-or-later"),
    (gnu("General Public License", "3", ";", ","), "GPL-3.0-or-later"), (gnu("General Public License", "2", ":", ";"), "GPL-2.0-or-later"),
    (gnu("Lesser General Public License", "2.1"), "LGPL-2.1-or-later"), (gnu("Affero General Public License", "3", ":", ","), "AGPL-3.0-or-later"),
    (ISC[:ISC.index(", provided")] + ".\n", "0BSD"),
]
LINES = [(f"// SPDX-License-Identifier: {name}\nint main() {{}}\n", name) for name, _ in licenses.SPDX]
OTHERS = [
    (None, ""), ("", ""), ("...", ""), (" \n\r\n\t", ""), ("the\nmit\n\nlicense", ""), ("a\x02b \x01 MIT License \x01 c", "MIT"),
    ("MIT License\nMIT License\nAll rights reserved", "MIT,MIT,proprietary"), ("K MIT Licenseİ", "MIT"),
    ("Licensed under CC BY-NC 4.0.\nMIT License", "CC-BY-NC-4.0,MIT"), ("word " * 100_000 + ".\nMIT License", "MIT"),
    (TITLE + "One. Two. " * 5 + gnu("General Public License", "3", ":", ","), "GPL-3.0,GPL-3.0-or-later"),
    (MIT + "\n" + APACHE, "MIT,Apache-2.0"), ("This program is free software; enjoy.", ""),
]


def cases():
    out = STANDARD + LINES + OTHERS
    out += [(commented(t), want) for t, want in STANDARD] + [(t.replace("\n", "\r\n"), want) for t, want in STANDARD]
    out += [("Some words before.\n\n" + t + "\nand after", want) for t, want in STANDARD if want != "GPL-3.0"]
    return out + out[:3]                                            # repeated rows


@pytest.fixture(scope="module")
def scanned(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(cases())], "doc_id long, text string, licenses string")
    return [r.asDict() for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_standard_texts_are_recognised(scanned):
    wrong = [(r["licenses"], want, text) for r, (text, want) in zip(scanned, cases()) if r["licenses"] != want]
    assert not wrong, wrong[:3]


def test_the_twin_gives_the_same_rows(scanned):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(scanned))), "text": [t for t, _ in cases()]}))
    cur = con.execute(licenses.ORACLE_SQL + " ORDER BY doc_id")
    names = [d[0] for d in cur.description]
    assert [dict(zip(names, row)) for row in cur.fetchall()] == scanned


def test_every_rule_can_fire(spark):
    """A text made of a rule's own sentences is matched whole by that rule or by an earlier one over all its places."""
    said = {}
    for sentence, mark in licenses.KNOWN.items():
        said.setdefault(mark, sentence)
    assert {m for _, _, seq in licenses.ORDERED for m in seq} <= set(said)
    docs = spark.createDataFrame([(i, ".\n\n".join(said[m] for m in seq)) for i, (_, _, seq) in enumerate(licenses.ORDERED)], "doc_id long, text string")
    rows = licenses.scan(docs).orderBy("doc_id").collect()
    assert [r.n_known for r in rows] == [len(seq) for _, _, seq in licenses.ORDERED]
    assert [(r.licenses, r.n_matches, r.restricted) for r in rows] == [(name, 1, not free) for name, free, _ in licenses.ORDERED]
