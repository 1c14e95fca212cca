"""Licence recognition by sentences and rules, in DataFrame functions only.

A text is cut in pieces, at line feeds, behind . : or ; before a blank, and at . or ; between a small and a
capital letter. Operands of an SPDX expression become lines of their own. A piece is
normalised: lower case, runs of anything but a-z and 0-9 become one space, `licence` is `license`, a comment mark of
letters at its start goes. A piece without words (a blank line) ends a paragraph. A known sentence
is found where its words are those of a run of whole pieces of one paragraph, so
hard-wrapped and commented texts are found as those on one line are. Runs are taken from the
left, the longest first, and share no piece. Some sentences vary: what says that something is "distributed under"
a licence, up to eight words before it in the same piece, and the holder in the third condition and
the disclaimer of BSD texts, a gap of up to twelve words; runs are brought to the table's form before they
are looked up (`tidy`). The identifiers found, in text order, are the document's sequence. Rules
are ordered identifier sequences: they are tried in turn, each takes every place
where its identifiers stand next to one another, and what a rule has taken no later
rule sees (so three conditions are BSD-3-Clause, not BSD-2-Clause and a rest). "All rights reserved" stands in the
notices of most licences and counts only if no licence is found.

Every known sentence holds one of the trigger words, so texts without them skip the
splitting; nothing is lost by that.

Everything is a projection: no shuffle, no Python on the executors.

Defined results: null and empty texts, and texts without known sentences, have
empty sequences and no licences; an identifier that no rule takes is listed in the sequence only; a licence is
listed once, in rule order, however often it is found; an empty table gives an empty
table; extra columns are kept if named in `keep`, and a result column replaces a kept
column of the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences by identifier (public licence texts and notices).
SENTENCES: dict[str, list[str]] = {
    "apache2-line": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")", "Licensed under the Apache License 2.0", "Licensed under the Apache 2.0 License", "Licensed under Apache 2.0"],
    "apache2-comply": ["you may not use this file except in compliance with the License"],
    "apache2-title": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "apache2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache2-asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-line": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License", "The MIT License", "MIT License", "The MIT License (MIT)", "Licensed under MIT"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-asis": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "isc-line": ["Licensed under the ISC License", "Released under the ISC License", "ISC License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsd-asis": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"],
    "bsd2-line": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "BSD 2-Clause License", "Licensed under the 2-Clause BSD License", "Licensed under the Simplified BSD License"],
    "bsd3-line": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "BSD 3-Clause License", "Licensed under the 3-Clause BSD License", "Licensed under the New BSD License"],
    "gpl2-line": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "GNU General Public License, version 2"],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-title": ["GNU General Public License Version 2, June 1991"],
    "gpl3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "lgpl21-line": ["Licensed under the GNU Lesser General Public License, version 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"],
    "lgpl3-line": ["Licensed under the GNU Lesser General Public License, version 3", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-line": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "lgpl21-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "lgpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl-details": ["See the GNU Lesser General Public License for more details"],
    "agpl3-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-details": ["See the GNU Affero General Public License for more details"],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "mpl2-terms": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0", "Licensed under the Mozilla Public License 2.0"],
    "ccbync4-line": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "ccbyncsa4-line": ["Licensed under CC BY-NC-SA 4.0", "This work is licensed under CC BY-NC-SA 4.0"],
    "ccbynd4-line": ["Licensed under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0"],
    "ccbysa4-line": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "ccby4-line": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0-line": ["Licensed under CC0 1.0", "Released under the CC0 1.0 Universal License"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "all-rights": ["All rights reserved"],
    "spdx-apache2": ["SPDX-License-Identifier: Apache-2.0"],
    "spdx-mit": ["SPDX-License-Identifier: MIT"],
    "spdx-bsd2": ["SPDX-License-Identifier: BSD-2-Clause"],
    "spdx-bsd3": ["SPDX-License-Identifier: BSD-3-Clause"],
    "spdx-isc": ["SPDX-License-Identifier: ISC"],
    "spdx-gpl2": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "spdx-gpl2-later": ["SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0+"],
    "spdx-gpl3": ["SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0"],
    "spdx-gpl3-later": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "spdx-lgpl21": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1"],
    "spdx-lgpl21-later": ["SPDX-License-Identifier: LGPL-2.1-or-later"],
    "spdx-lgpl3": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0"],
    "spdx-lgpl3-later": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
    "spdx-agpl3": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0"],
    "spdx-agpl3-later": ["SPDX-License-Identifier: AGPL-3.0-or-later"],
    "spdx-mpl2": ["SPDX-License-Identifier: MPL-2.0"],
    "spdx-cc0": ["SPDX-License-Identifier: CC0-1.0"],
    "spdx-unlicense": ["SPDX-License-Identifier: Unlicense"],
}

# Rules in the order in which they are tried.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache2-comply", "apache2-copy", "apache2-asis", "apache2-see"]),
    ("Apache-2.0", ["apache2-line", "apache2-comply"]),
    ("Apache-2.0", ["apache2-comply"]),
    ("Apache-2.0", ["apache2-line"]),
    ("Apache-2.0", ["apache2-title"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("MIT", ["mit-line", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-line"]),
    ("MIT", ["spdx-mit"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-asis"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", ["bsd3-line"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-asis"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd2-line"]),
    ("BSD-2-Clause", ["spdx-bsd2"]),
    ("ISC", ["isc-grant", "isc-asis"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-line"]),
    ("ISC", ["spdx-isc"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-warranty", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("AGPL-3.0", ["agpl3-line"]),
    ("AGPL-3.0", ["agpl3-title"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-warranty", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("LGPL-3.0", ["lgpl3-line"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-2.1", ["lgpl21-line"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0", ["gpl3-line"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("GPL-3.0-or-later", ["spdx-gpl3-later"]),
    ("GPL-2.0-or-later", ["spdx-gpl2-later"]),
    ("GPL-2.0", ["spdx-gpl2"]),
    ("LGPL-2.1", ["spdx-lgpl21"]),
    ("LGPL-2.1-or-later", ["spdx-lgpl21-later"]),
    ("LGPL-3.0", ["spdx-lgpl3"]),
    ("LGPL-3.0-or-later", ["spdx-lgpl3-later"]),
    ("AGPL-3.0", ["spdx-agpl3"]),
    ("AGPL-3.0-or-later", ["spdx-agpl3-later"]),
    ("GPL-2.0", ["gpl2-line"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("MPL-2.0", ["mpl2-terms", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("MPL-2.0", ["spdx-mpl2"]),
    ("CC-BY-NC-SA-4.0", ["ccbyncsa4-line"]),
    ("CC-BY-NC-4.0", ["ccbync4-line"]),
    ("CC-BY-ND-4.0", ["ccbynd4-line"]),
    ("CC-BY-SA-4.0", ["ccbysa4-line"]),
    ("CC-BY-4.0", ["ccby4-line"]),
    ("CC0-1.0", ["cc0-line"]),
    ("CC0-1.0", ["spdx-cc0"]),
    ("Unlicense", ["unlicense-free"]),
    ("Unlicense", ["spdx-unlicense"]),
    ("Proprietary", ["all-rights"]),
]
#: Only where no other licence is found.
RESERVED = "Proprietary"

#: Where a line is cut in pieces: behind a mark that may end a sentence, before a blank.
STOP = r"[.:;][^a-zA-Z0-9\s]*[ \t]+"
#: Words of which each known sentence, normalised, holds one; the letters may have anything but letters and digits, and a comment mark, between words.
TRIGGER = r"(?i)licen[sc]|redistribut|permission|warrant|mozilla|public[^a-z0-9]+((dnl|rem)[^a-z0-9]+)?domain|rights[^a-z0-9]+((dnl|rem)[^a-z0-9]+)?reserved|copyright|holder|advertising|(released|distributed|available|provided|published|offered|covered)[^a-z0-9]+under"
#: Comment marks made of letters, at the start of a normalised line.
MARKS = "^(dnl|rem) "


#: Where a sentence ends without a blank behind it.
RUN_ON = r"([a-z])[.;]([A-Z])"
SPDX = "SPDX-License-Identifier:"
#: Exceptions of an SPDX expression, and what stands between its operands.
SPDX_EXCEPT, SPDX_NEXT = r"[ \t]+(?i:with)[ \t]+[A-Za-z0-9.-]+", r"[ \t]+(?i:or|and)[ \t]+\(*"
#: What says at a piece's start that something is under a licence.
LEAD = "^(?:[a-z0-9]+ ){0,8}?(?:licensed|released|distributed|available|provided|published|offered|covered) under\\b"
#: Varying parts of a run, and what the table has for them.
VARIES: list[tuple[str, str]] = [
    ("^licensed under (?:the |terms of )+", "licensed under "),
    ("^neither the names? of (?:[a-z0-9]+ ){1,12}?nor the names? of (?:(?:its|the|any|other) ){0,3}contributors", "neither the name of the copyright holder nor the names of its contributors"),
    ("^the names? of (?:[a-z0-9]+ ){1,12}?may not be used", "the name of the author may not be used"),
    ("^this software is provided by (?:[a-z0-9]+ ){1,12}?as is\\b", "this software is provided by the copyright holders and contributors as is"),
]
#: Runs that end within a varying part.
OPEN = "^(?:licensed under(?: the| terms| of)*|neither the names? of(?: [a-z0-9]+){0,20}|the names? of(?: [a-z0-9]+){0,15}|this software is provided by(?: [a-z0-9]+){0,13})$"
#: How a run begins that varies.
VARIED = ("licensed under", "neither the name", "the name", "this software is provided by")
#: Words of a gap, of a lead and of what else varies.
VARYING_WORDS = 24


def normalized(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip().replace("licence", "license")


def canonical(run: str) -> str:
    """A normalised run in the table's form."""
    run = re.sub(LEAD, "licensed under", run)
    for pattern, form in VARIES:
        run = re.sub(pattern, form, run)
    return run


def known() -> dict[str, str]:
    """Normalised sentence in the table's form -> identifier."""
    return {canonical(normalized(part)): name for name, texts in SENTENCES.items() for part in texts}


def most_words() -> int:
    """Of a run that can be a known sentence."""
    return max(len(s.split()) for s in known()) + VARYING_WORDS


def prepared(text: Column) -> Column:
    """The text with a line feed where a sentence ends, and behind each operand of an SPDX expression."""
    cut = F.regexp_replace(text, RUN_ON, "$1\n$2")
    line = lambda x: F.regexp_replace(F.regexp_replace(x, SPDX_EXCEPT, ""), SPDX_NEXT, f"\n{SPDX} ")
    lines = F.transform(F.split(cut, "\n"), lambda x: F.when(F.contains(x, F.lit(SPDX)), line(x)).otherwise(x))
    spdx = F.when(F.contains(text, F.lit(SPDX)), F.array_join(lines, "\n")).otherwise(cut)
    return F.regexp_replace(spdx, STOP, "\n")


def sequence(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    names = known()
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    listed = F.lit("|" + "|".join(names) + "|")
    most = most_words()  # a piece that is not blank has a word
    words = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    plain = lambda s: F.replace(F.regexp_replace(words(s), MARKS, ""), F.lit("licence"), F.lit("license"))
    hit = lambda name, n: F.struct(name.alias("id"), n.cast("int").alias("n"))

    def tidy(s: Column) -> Column:
        out = s
        for (pattern, form), start in zip(VARIES, VARIED, strict=True):
            out = F.when(F.startswith(s, F.lit(start)), F.regexp_replace(s, pattern, form)).otherwise(out)
        return out

    led = lambda s: F.when(F.contains(s, F.lit(" under")), F.regexp_replace(s, LEAD, "licensed under")).otherwise(s)
    begins = lambda s: F.contains(listed, F.concat(F.lit("|"), s, F.lit(" "))) | s.rlike(OPEN)

    def longest(pieces: Column, first: Column, i: Column) -> Column:
        """The longest known sentence of whole pieces from piece i on, and its number of pieces."""
        name = F.try_element_at(table, first)
        start = F.struct(first.alias("s"), F.lit(1).alias("n"), begins(first).alias("open"), name.alias("id"), F.lit(1).alias("upto"))

        def extend(state: Column, piece: Column) -> Column:
            # a blank piece ends the paragraph; the array of one is there to tidy once
            grown = F.transform(F.array(tidy(F.concat(state["s"], F.lit(" "), piece))), lambda s: F.struct(s.alias("s"), begins(s).alias("open"), F.try_element_at(table, s).alias("id")))
            longer = F.element_at(
                F.transform(
                    grown,
                    lambda g: F.struct(
                        g["s"].alias("s"), (state["n"] + 1).alias("n"), g["open"].alias("open"),
                        F.coalesce(g["id"], state["id"]).alias("id"), F.when(g["id"].isNotNull(), state["n"] + 1).otherwise(state["upto"]).alias("upto"),
                    ),
                ), 1
            )
            ended = F.struct(state["s"].alias("s"), state["n"].alias("n"), F.lit(False).alias("open"), state["id"].alias("id"), state["upto"].alias("upto"))
            return F.when(~state["open"], state).when(piece == "", ended).otherwise(longer)

        folded = F.aggregate(F.slice(pieces, i + 2, most - 1), start, extend, lambda state: F.when(state["id"].isNotNull(), hit(state["id"], state["upto"])))
        return F.when(begins(first), folded).otherwise(F.when(name.isNotNull(), hit(name, F.lit(1))))

    def found(cut: Column) -> Column:
        at = F.transform(cut["firsts"], lambda s, i: F.when(s != "", longest(cut["pieces"], s, i)))
        placed = F.filter(F.transform(at, lambda x, i: F.when(x.isNotNull(), F.struct(x["id"].alias("id"), i.alias("first"), (i + x["n"]).alias("end")))), lambda x: x.isNotNull())
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("ids"))
        take = lambda state, x: F.when(x["first"] < state["end"], state).otherwise(F.struct(x["end"].alias("end"), F.array_append(state["ids"], x["id"]).alias("ids")))
        return F.aggregate(placed, start, take, lambda state: state["ids"])

    # the arrays of one are there to split once
    pieces = F.transform(F.split(prepared(text), "\n"), plain)
    both = F.transform(F.array(pieces), lambda p: F.struct(p.alias("pieces"), F.transform(p, lambda s: tidy(led(s))).alias("firsts")))
    ids = F.element_at(F.transform(both, found), 1)
    return F.when(F.coalesce(text.rlike(TRIGGER), F.lit(False)), ids).otherwise(F.array().cast("array<string>"))


def scan(documents: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add sentence_ids and licences, both array<string>."""
    new = ("sentence_ids", "licences")
    kept = [c for c in (documents.columns if keep is None else keep) if c.lower() not in new]
    out = documents.select(*[f"`{c}`" for c in kept], sequence(F.col(f"`{text_col}`")).alias("sentence_ids"))
    # identifiers each between bars, doubled between neighbours so that matches may stand side by side
    bars = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    rules = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit("|" + "||".join(ids) + "|").alias("mark")) for licence, ids in RULES])
    start = F.struct(bars.alias("rest"), F.array().cast("array<string>").alias("found"))

    def take(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["mark"])
        found = F.when(hit, F.array_append(state["found"], rule["licence"])).otherwise(state["found"])
        return F.struct(F.replace(state["rest"], rule["mark"], F.lit("#")).alias("rest"), found.alias("found"))

    named = F.array_distinct(F.aggregate(rules, start, take, lambda state: state["found"]))
    matched = F.element_at(F.transform(F.array(named), lambda n: F.when(F.size(n) > 1, F.array_remove(n, RESERVED)).otherwise(n)), 1)
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, matched).otherwise(F.array().cast("array<string>")))
