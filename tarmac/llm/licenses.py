"""Licence recognition by sentence rules.

A text is cut into sentences at line ends and after ``. ! ? ;`` followed by
white space; a sentence is normalised (lower case, everything but ASCII letters and digits
becomes one blank). A known sentence may be wrapped: it goes on over single
line ends, and is found between other lines too. Known licence sentences are mapped to
identifiers; the identifiers of a text, in order, form a sequence in which a
run of unknown sentences longer than GAP is a break; unknown lines that only
single line ends part count as one sentence there. Rules are ordered
sequences of identifiers; at every place the first rule of the ordered list
that fits wins, and matching goes on after it. All of it is built-in
expressions over whole texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

GAP = 3                    # unknown sentences allowed inside a rule

# Known sentences, normalised by the rule above (fixed values).
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-ref",
    "apache license version 2 0 january 2004": "apache-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "mit license": "mit-title",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertise",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "this work is licensed under the gnu general public license version 2": "gpl2-ref",
    "this program comes with absolutely no warranty": "gpl-warranty",
    "licensed under cc by nc 4 0": "ccbync-ref",
    "licensed under cc by 4 0": "ccby-ref",
    "licensed under cc by sa 4 0": "ccbysa-ref",
    "licensed under cc0 1 0": "cc0-ref",
    "cc0 1 0 universal": "cc0-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync-ref",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "mozilla public license version 2 0": "mpl2-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-disclaim",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-any",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl v20 html": "epl2-ref",
    "eclipse public license v 2 0": "epl2-ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-ref",
    "distributed under the boost software license version 1 0": "bsl1-ref",
    "boost software license version 1 0 august 17th 2003": "bsl1-ref",
    "all rights reserved": "reserved",
}

# GNU licences: short name, full name, version, date of the full text (fixed values).
GNU = (
    ("GPL", "gnu general public license", "2.0", "june 1991"),
    ("GPL", "gnu general public license", "3.0", "29 june 2007"),
    ("LGPL", "gnu library general public license", "2.0", "june 1991"),
    ("LGPL", "gnu lesser general public license", "2.1", "february 1999"),
    ("LGPL", "gnu lesser general public license", "3.0", "29 june 2007"),
    ("AGPL", "gnu affero general public license", "3.0", "19 november 2007"),
)

# Licences whose SPDX line is known, and whether use is open (fixed values).
SPDX = (
    ("0BSD", True), ("AGPL-3.0-only", True), ("AGPL-3.0-or-later", True), ("Apache-2.0", True), ("Apache-2.0 OR MIT", True),
    ("BSD-2-Clause", True), ("BSD-3-Clause", True), ("BSL-1.0", True), ("CC-BY-4.0", True), ("CC-BY-NC-4.0", False),
    ("CC-BY-SA-4.0", True), ("CC0-1.0", True), ("EPL-1.0", True), ("EPL-2.0", True), ("GPL-2.0", True),
    ("GPL-2.0-only", True), ("GPL-2.0-or-later", True), ("GPL-3.0", True), ("GPL-3.0-only", True),
    ("GPL-3.0-or-later", True), ("ISC", True), ("LGPL-2.1-only", True), ("LGPL-2.1-or-later", True), ("LGPL-3.0-only", True),
    ("LGPL-3.0-or-later", True), ("MIT", True), ("MIT OR Apache-2.0", True), ("MPL-2.0", True), ("Unlicense", True), ("Zlib", True),
)

# Ordered rules (first match wins): licence, whether use is open, sentence identifiers in order (fixed values).
RULES = (
    ("BSD-4-Clause", True, ("reserved", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-4-Clause", True, ("bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", True, ("reserved", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", True, ("reserved", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", True, ("bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", True, ("bsd-source", "bsd-binary")),
    ("Apache-2.0", True, ("apache-ref", "apache-comply", "apache-copy", "apache-see")),
    ("Apache-2.0", True, ("apache-comply", "apache-copy", "apache-see")),
    ("Apache-2.0", True, ("apache-comply", "apache-see")),
    ("Apache-2.0", True, ("apache-ref",)),
    ("MIT", True, ("mit-title", "reserved", "mit-notice", "as-is")),
    ("MIT", True, ("mit-title", "mit-notice", "as-is")),
    ("MIT", True, ("reserved", "mit-notice", "as-is")),
    ("MIT", True, ("mit-notice", "as-is")),
    ("MIT", True, ("mit-ref",)),
    ("MIT", True, ("mit-title",)),
    ("GPL-3.0", True, ("gpl3-ref", "gpl-warranty")),
    ("GPL-3.0", True, ("gpl3-ref",)),
    ("GPL-2.0", True, ("gpl2-ref",)),
    ("CC-BY-NC-4.0", False, ("ccbync-ref",)),
    ("CC-BY-SA-4.0", True, ("ccbysa-ref",)),
    ("CC-BY-4.0", True, ("ccby-ref",)),
    ("CC0-1.0", True, ("cc0-ref",)),
    ("MPL-2.0", True, ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", True, ("mpl2-copy",)),
    ("MPL-2.0", True, ("mpl2-title",)),
    ("ISC", True, ("isc-grant", "isc-disclaim")),
    ("ISC", True, ("isc-grant",)),
    ("0BSD", True, ("0bsd-grant", "isc-disclaim")),
    ("0BSD", True, ("0bsd-grant",)),
    ("Unlicense", True, ("unlicense-ref", "unlicense-any")),
    ("Unlicense", True, ("unlicense-ref",)),
    ("Zlib", True, ("zlib-origin", "zlib-altered", "zlib-notice")),
    ("EPL-2.0", True, ("reserved", "epl2-ref")),
    ("EPL-2.0", True, ("epl2-ref",)),
    ("EPL-1.0", True, ("reserved", "epl1-ref")),
    ("EPL-1.0", True, ("epl1-ref",)),
    ("BSL-1.0", True, ("bsl1-ref",)),
)
LAST_RULES = (("proprietary", False, ("reserved",)),)


def normal(sentence: str) -> str:
    """The form in which a sentence is known."""
    return " ".join(re.sub("[^a-z0-9]+", " ", sentence.lower()).split())


def gnu_family(table: tuple = GNU) -> tuple[dict[str, str], tuple]:
    """Sentences and rules of the GNU notices, the version as a parameter.

    A notice reads "<this program> is free software(: or ;) you can
    redistribute it and/or modify it under the terms of the <licence> as
    published by the Free Software Foundation(, or ;) either version <v> of
    the License, or (at your option) any later version". A semicolon ends a
    sentence, so the four ways of writing it are cut differently."""
    known, rules = {}, []
    for short, name, version, date in table:
        number = version.removesuffix(".0")
        v = normal(number)
        family, mark = normal(name).replace(" ", "-"), normal(f"{short} {version}").replace(" ", "-")   # identifiers hold no dots
        n = v.replace(" ", "-")
        terms = f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
        later, only = f"either version {v} of the license or at your option any later version", f"version {v} of the license"
        known |= {later: f"later-{n}", only: f"only-{n}", f"{name} version {v} {date}": f"{mark}-title", terms: f"{family}-terms",
                  f"{terms} {later}": f"{mark}-later", f"{terms} {only}": f"{mark}-only"}
        for subject in ("program", "library", "file", "software"):
            start = f"this {subject} is free software"
            known |= {f"{start} {terms}": f"{family}-terms", f"{start} {terms} {later}": f"{mark}-later", f"{start} {terms} {only}": f"{mark}-only"}
        rules += [(f"{short}-{version}-or-later", True, (f"{family}-terms", f"later-{n}")), (f"{short}-{version}-or-later", True, (f"{mark}-later",)),
                  (f"{short}-{version}-only", True, (f"{family}-terms", f"only-{n}")), (f"{short}-{version}-only", True, (f"{mark}-only",)),
                  (f"{short}-{version}", True, (f"{mark}-title",))]
    return known, tuple(rules)


def spdx_lines(table: tuple = SPDX) -> tuple[dict[str, str], tuple]:
    """Sentences and rules of the lines "SPDX-License-Identifier: <licence>".
    Of licences with one normal form the first is taken."""
    known = {}
    for name, _ in table:
        known.setdefault(normal(f"SPDX-License-Identifier: {name}"), f"spdx-{normal(name).replace(' ', '-')}")
    rules = {}
    for name, free in table:
        rules.setdefault((f"spdx-{normal(name).replace(' ', '-')}",), (name, free))
    return known, tuple((name, free, seq) for seq, (name, free) in rules.items())


_GNU_KNOWN, _GNU_RULES = gnu_family()
_SPDX_KNOWN, _SPDX_RULES = spdx_lines()
KNOWN = SENTENCES | _GNU_KNOWN | _SPDX_KNOWN
ORDERED = RULES + _GNU_RULES + _SPDX_RULES + LAST_RULES

SPACE = r"[\x20\x09-\x0D]"
STOP = rf"[.!?;]+{SPACE}+"                  # always ends a sentence
LINE = r"\x0D\x0A|[\x0A\x0D]"              # ends a sentence unless a known one goes on


# Everything but letters, digits and marks, unless it is one blank already: most blanks are left where they are.
OTHER = r" *[^A-Za-z0-9\x01\x02 ][^A-Za-z0-9\x01\x02]*| {2,}"


def rule_pattern(gap: int = GAP, rules: tuple = ORDERED) -> str:
    """One ordered alternation of all rules over a coded sequence: a known
    sentence is ``<identifier>``, an unknown one a dot."""
    return "(" + "|".join(("[.]{0,%d}" % gap).join(f"<{s}>" for s in seq) for _, _, seq in rules) + ")"


def rule_keys(rules: tuple = ORDERED) -> dict[str, tuple[str, bool]]:
    return {"".join(f"<{s}>" for s in seq): (name, free) for name, free, seq in rules}


def known_pattern(known: dict[str, str]) -> str:
    """A known sentence that fills whole lines, wrapped or not; the longest first."""
    return rf"(?<=[\x01\x02])(?:{_wrapped(known, r'[ \x02]')})(?=[\x01\x02])"


def _wrapped(known: dict[str, str], blank: str) -> str:
    """Alternatives by first word, each the longest first: a line is held against the sentences of its first word only."""
    by_word: dict[str, list[str]] = {}
    for k in sorted(known, key=lambda k: (-len(k), k)):
        word, _, rest = k.partition(" ")
        by_word.setdefault(word, []).append((blank + rest.replace(" ", blank)) if rest else "")
    return "|".join(f"{word}(?:{'|'.join(rests)})" for word, rests in by_word.items())


def sentences(text: Column, known: dict[str, str]) -> Column:
    """Normalised sentences of a text in runs that only single line ends part;
    a known sentence is a run of its own. Empty sentences and runs are left out."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\x02"), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(flat, STOP, "\x01"), LINE, "\x02")
    marked = F.lower(F.regexp_replace(marked, OTHER, " "))                         # ASCII only from here
    marked = F.regexp_replace(marked, r"\x02(?: ?\x02)+", "\x01")                # an empty line
    marked = F.regexp_replace(F.concat(F.lit("\x01"), marked, F.lit("\x01")), r" ?([\x01\x02]) ?", "$1")
    marked = F.regexp_replace(marked, known_pattern(known), "\x01$0\x01")
    table = _lookup(known)

    def lines(run: Column) -> Column:
        whole = F.translate(run, "\x02", " ")
        cut = F.filter(F.transform(F.split(run, "\x02"), lambda s: F.trim(s)), lambda s: s != "")
        return F.when(F.try_element_at(table, whole).isNotNull(), F.array(whole)).otherwise(cut)

    return F.filter(F.transform(F.split(marked, "\x01"), lines), lambda r: F.size(r) > 0)


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """(doc_id, n_sentences, n_known, sequence, licenses, n_matches, restricted),
    one row per input row.

    ``sequence``: known sentences as ``<identifier>``, unknown ones as dots, a
    run of more than ``gap`` unknown ones as one underscore; empty if nothing
    is known. ``licenses``: the matched rules' licences in order of place,
    joined by commas; ``restricted``: a matched licence does not allow open
    use. NULL and empty texts have no sentence; repeated rows are judged one
    by one; only doc_id and text are read.
    """
    known, rules = KNOWN, ORDERED
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentences(F.col("text"), known).alias("s"))
    table = _lookup(known)
    code = F.transform("s", lambda r: F.transform(r, lambda s: F.coalesce(F.concat(F.lit("<"), F.try_element_at(table, s), F.lit(">")), F.lit("."))))
    rows = rows.select("doc_id", code.alias("r"))
    # Unknown lines of a run are one sentence for the rules' gaps.
    runs = F.transform("r", lambda r: F.regexp_replace(F.array_join(r, ""), "[.]+", "."))
    rows = rows.select("doc_id", F.flatten("r").alias("c"), F.array_join(runs, "").alias("short"))
    rows = rows.select("doc_id", F.size("c").cast("long").alias("n_sentences"),
                       F.size(F.filter("c", lambda x: x != ".")).cast("long").alias("n_known"),
                       F.array_join("c", "").alias("line"), "short")
    seq = F.when(F.col("n_known") > 0, F.regexp_replace("line", "[.]{%d,}" % (gap + 1), "_")).otherwise(F.lit(""))
    rows = rows.select("doc_id", "n_sentences", "n_known", seq.alias("sequence"), "short")
    found = F.transform(F.regexp_extract_all("short", F.lit(rule_pattern(gap, rules)), F.lit(1)), lambda m: F.translate(m, ".", ""))
    names = _lookup({k: n for k, (n, _) in rule_keys(rules).items()})
    free = _lookup({k: f for k, (_, f) in rule_keys(rules).items()})
    return rows.withColumn("m", found).select(
        "doc_id", "n_sentences", "n_known", "sequence",
        F.array_join(F.transform("m", lambda k: F.element_at(names, k)), ",").alias("licenses"),
        F.size("m").cast("long").alias("n_matches"),
        F.exists("m", lambda k: ~F.element_at(free, k)).alias("restricted"))


# Marks are doubled, so that a sentence may take the marks beside it and leave its neighbours theirs.
ORACLE_SQL = r"""
WITH flat AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(2), 'abcdefghijklmnopqrstuvwxyz ') AS t FROM documents),
cut AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '{stop}', chr(1), 'g'), '\x0D\x0A|[\x0A\x0D]', chr(2), 'g'),
    '[^a-z0-9\x01\x02]+', ' ', 'g') AS t FROM flat),
bare AS (
  SELECT doc_id, regexp_replace(chr(1) || regexp_replace(t, '\x02( ?\x02)+', chr(1), 'g') || chr(1), ' ?([\x01\x02]) ?', '\1\1', 'g') AS t
  FROM cut),
marked AS (SELECT doc_id, regexp_replace(t, '([\x01\x02])({words})([\x01\x02])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g') AS t FROM bare),
runs AS (
  SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda r:
    CASE WHEN replace(r, chr(2) || chr(2), ' ') IN ({sentences}) THEN [replace(r, chr(2) || chr(2), ' ')]
         ELSE list_filter(list_transform(string_split(r, chr(2)), lambda s: trim(s)), lambda s: s <> '') END), lambda r: len(r) > 0) AS r
  FROM marked),
coded AS (
  SELECT doc_id, list_transform(r, lambda x: list_transform(x, lambda s: coalesce('<' || MAP {{{known}}}[s] || '>', '.'))) AS r FROM runs),
lines AS (
  SELECT doc_id, flatten(r) AS c,
    array_to_string(list_transform(r, lambda x: regexp_replace(array_to_string(x, ''), '[.]+', '.', 'g')), '') AS short FROM coded),
matched AS (
  SELECT doc_id, c, list_filter(c, lambda x: x <> '.') AS found,
    list_transform(regexp_extract_all(short, '{rules}', 1), lambda x: replace(x, '.', '')) AS m FROM lines)
SELECT doc_id, CAST(len(c) AS BIGINT) AS n_sentences, CAST(len(found) AS BIGINT) AS n_known,
  CASE WHEN len(found) > 0 THEN regexp_replace(array_to_string(c, ''), '[.]{{{over},}}', '_', 'g') ELSE '' END AS sequence,
  array_to_string(list_transform(m, lambda k: MAP {{{names}}}[k]), ',') AS licenses,
  CAST(len(m) AS BIGINT) AS n_matches,
  len(list_filter(m, lambda k: NOT MAP {{{free}}}[k])) > 0 AS restricted
FROM matched""".format(
    stop=STOP, over=GAP + 1, rules=rule_pattern(), words=_wrapped(KNOWN, r"(?: |\x02\x02)"),
    sentences=", ".join(f"'{k}'" for k in KNOWN),
    known=", ".join(f"'{k}': '{v}'" for k, v in KNOWN.items()),
    names=", ".join(f"'{k}': '{n}'" for k, (n, _) in rule_keys().items()),
    free=", ".join(f"'{k}': {str(f).lower()}" for k, (_, f) in rule_keys().items()))
