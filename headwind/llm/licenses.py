"""Licence scans by sentence rules.

A text is cut into sentences twice: line by line, and with wrapped lines joined. Sentences are normalised (ASCII
punctuation and white space to single spaces, lower case) and mapped to the identifiers of known licence sentences; a
run of sentences that are not known becomes one ``?``. A known sentence that the scan cuts in several is found where all
its parts follow one another, and counts once. Ordered rules then match sequences of identifiers: each rule replaces its
sequence by the name of a licence, so what a rule has used no later rule sees. Other text between two sentences breaks a
sequence, unless the rule itself has a ``?`` there; blank sentences and bare list marks (a number up to 99, a letter)
are passed over. Identifiers that no rule used are told as left over. Rules run on both cuts; a document's licences are
those of either.

Known are whole notices and the characteristic sentences of licence bodies, the titles of the longer bodies, short notices
("Licensed under the ...") and SPDX tags for every licence of ``NAMES``; file notices of the GPL family are put together
from their parts (``gnu_notices``). A body that quotes a notice (the GPL's appendix) gives the licence of that notice too.

All of it is built-in column functions inside the row: no join, no shuffle, whatever the size of a text or the copies of
a row. ``scan_sql`` is made from the same sentences and rules. Defined cases: a null or empty text has no sentences and no
licences (empty strings); repeated rows each give a row; a null id stays null; licences are listed once each, in
alphabetical order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and the identifiers given to them here.
SENTENCES = {
    "ApacheShort": "Licensed under the Apache License, Version 2.0.",
    "ApacheHead": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "ApacheUse": "you may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheAsIs": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "MitShort": "Released under the MIT License.",
    "MitUnder": "Licensed under the MIT License.",
    "MitGrant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MitAsIs": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "MitLiable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BsdEndorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Gpl3Work": "This work is licensed under the GNU General Public License, version 3.",
    "GplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Gpl2Free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "GplEven": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GplSee": "See the GNU General Public License for more details.",
    "MplHead": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MplCopy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CcByNc4": "Licensed under CC BY-NC 4.0.",
    "CcBy4": "Licensed under CC BY 4.0.",
    "CcBySa4": "Licensed under CC BY-SA 4.0.",
    "CcByWork": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Cc0": "This work is dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AllRights": "All rights reserved.",
    "BsdAsIs": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BsdLiable": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BsdAdvert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "IscAsIs": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "ZeroBsdGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibLiable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BoostGrant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "BoostUnder": "Distributed under the Boost Software License, Version 1.0.",
    "EplTerms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EplTerms1": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "WtfplTitle": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "WtfplGrant": "You just DO WHAT THE FUCK YOU WANT TO.",
    "PostgresGrant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "LibraryHope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "LesserSee": "See the GNU Lesser General Public License for more details.",
    "LibrarySee": "See the GNU Library General Public License for more details.",
    "AfferoSee": "See the GNU Affero General Public License for more details.",
    "MplTitle": "Mozilla Public License Version 2.0",
    "ApacheTitle": "Apache License",
    "ApacheDate": "Version 2.0, January 2004",
    "MitTitle": "MIT License",
    "GplTitle": "GNU GENERAL PUBLIC LICENSE",
    "LesserTitle": "GNU LESSER GENERAL PUBLIC LICENSE",
    "AfferoTitle": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "Gpl1Date": "Version 1, February 1989",
    "Gpl2Date": "Version 2, June 1991",
    "Lesser21Date": "Version 2.1, February 1999",
    "Gpl3Date": "Version 3, 29 June 2007",
    "AfferoDate": "Version 3, 19 November 2007",
    "EplTitle": "Eclipse Public License - v 2.0",
    "EplTitle1": "Eclipse Public License - v 1.0",
    "BoostTitle": "Boost Software License - Version 1.0 - August 17th, 2003",
    "CddlTitle": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "ArtisticTitle": "The Artistic License 2.0",
}

# Licences by their SPDX identifier and the names that short notices give them.
NAMES = {
    "0BSD": ["BSD Zero Clause License"],
    "AFL-3.0": ["Academic Free License version 3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "AGPLv3"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License v3.0 or later", "AGPLv3+"],
    "Apache-1.1": ["Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 license"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BlueOak-1.0.0": ["Blue Oak Model License 1.0.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"],
    "CDDL-1.1": ["Common Development and Distribution License 1.1", "CDDL 1.1"],
    "CECILL-2.1": ["CeCILL license version 2.1"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2", "EUPL 1.2"],
    "GFDL-1.3-only": ["GNU Free Documentation License 1.3"],
    "GPL-2.0-only": ["GNU General Public License v2.0", "GNU General Public License, version 2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License v2.0 or later", "GPLv2+"],
    "GPL-3.0-only": ["GNU General Public License v3.0", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License v3.0 or later", "GPLv3+"],
    "ISC": ["ISC License"],
    "LGPL-2.1-only": ["GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License v2.1 or later", "LGPLv2.1+"],
    "LGPL-3.0-only": ["GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "LGPLv3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License v3.0 or later", "LGPLv3+"],
    "MIT": ["MIT License"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License v1.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "OSL-3.0": ["Open Software License version 3.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2"],
    "Unlicense": ["Unlicense"],
    "UPL-1.0": ["Universal Permissive License v1.0"],
    "WTFPL": ["WTFPL"],
    "Zlib": ["zlib License"],
    "ZPL-2.1": ["Zope Public License 2.1"],
}
# How short notices begin.
FORMS = ["Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under"]

# Rules in the order in which they apply, longer sequences before their parts.
RULES = [
    ("Apache-2.0", "ApacheTitle ApacheDate"),
    ("Apache-2.0", "ApacheHead ApacheUse ApacheCopy ApacheAsIs ApacheSee"),
    ("Apache-2.0", "ApacheHead ApacheUse ? ApacheAsIs ApacheSee"),
    ("Apache-2.0", "ApacheHead ApacheUse ApacheAsIs ApacheSee"),
    ("Apache-2.0", "ApacheHead ApacheUse"),
    ("Apache-2.0", "ApacheShort"),
    ("MIT", "MitTitle MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitTitle ? MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitTitle AllRights MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitGrant MitNotice MitAsIs MitLiable"),
    ("MIT", "MitGrant MitNotice MitAsIs"),
    ("MIT", "MitGrant MitNotice"),
    ("MIT", "MitShort"),
    ("MIT", "MitUnder"),
    ("ISC", "IscGrant IscAsIs"),
    ("ISC", "IscGrant"),
    ("Zlib", "ZlibAsIs ZlibLiable ZlibGrant"),
    ("Zlib", "ZlibGrant"),
    ("BSL-1.0", "BoostTitle BoostGrant"),
    ("BSL-1.0", "BoostTitle ? BoostGrant"),
    ("BSL-1.0", "BoostGrant"),
    ("BSL-1.0", "BoostTitle"),
    ("BSL-1.0", "BoostUnder"),
    ("PostgreSQL", "PostgresGrant"),
    ("0BSD", "ZeroBsdGrant IscAsIs"),
    ("0BSD", "ZeroBsdGrant"),
    ("BSD-4-Clause", "BsdGrant BsdSource BsdBinary BsdAdvert"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs BsdLiable"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary ? BsdAsIs BsdLiable"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdAsIs BsdLiable"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary"),
    ("BSD-1-Clause", "BsdGrant BsdSource"),
    ("GPL-3.0", "Gpl3Work"),
    ("GPL-3.0-or-later", "GplFree GplHope GplEven GplSee"),
    ("GPL-3.0-or-later", "GplFree"),
    ("MPL-2.0", "MplHead MplCopy"),
    ("MPL-2.0", "MplHead"),
    ("MPL-2.0", "MplTitle"),
    ("EPL-2.0", "EplTerms"),
    ("EPL-1.0", "EplTerms1"),
    ("EPL-2.0", "EplTitle"),
    ("EPL-1.0", "EplTitle1"),
    ("WTFPL", "WtfplTitle ? WtfplGrant"),
    ("WTFPL", "WtfplTitle"),
    ("WTFPL", "WtfplGrant"),
    ("GPL-1.0", "GplTitle Gpl1Date"),
    ("GPL-2.0", "GplTitle Gpl2Date"),
    ("GPL-3.0", "GplTitle Gpl3Date"),
    ("LGPL-2.1", "LesserTitle Lesser21Date"),
    ("LGPL-3.0", "LesserTitle Gpl3Date"),
    ("AGPL-3.0", "AfferoTitle AfferoDate"),
    ("CDDL-1.0", "CddlTitle"),
    ("Artistic-2.0", "ArtisticTitle"),
    ("CC-BY-NC-4.0", "CcByNc4"),
    ("CC-BY-SA-4.0", "CcBySa4"),
    ("CC-BY-4.0", "CcBy4"),
    ("CC-BY-4.0", "CcByWork"),
    ("CC0-1.0", "Cc0"),
    ("Unlicense", "Unlicense"),
    ("All-Rights-Reserved", "AllRights"),
]

# Rules that come before the others.
NOTICES = [
    ("GPL-2.0-or-later", "Gpl2Free GplHope GplEven GplSee"),
    ("GPL-2.0-or-later", "Gpl2Free"),
]

# Families of the GNU licences, the name inside the notice, their versions.
FAMILIES = [("GPL", "", ("1", "2", "3")), ("LGPL", "Library ", ("2",)), ("LGPL", "Lesser ", ("2.1", "3")), ("AGPL", "Affero ", ("3",))]

BREAK = "\x01"
OTHER = "?"  # stands for a run of sentences that are not known
CUT = "|"  # between the two cuts of a text
BLANK = "[ \\t\\r\\n\\f]"
NOISE = "[^A-Za-z0-9\\x{80}-\\x{10FFFF}]+"
MARK = "([0-9]{1,2}|[a-z])?"  # blank sentences and list marks
_NOISE = re.compile("[^A-Za-z0-9\x80-\U0010ffff]+")

Rules = list[tuple[str, str]]


def normalised(sentence: str) -> str:
    """A known sentence as the scan sees it."""
    return _NOISE.sub(" ", sentence).strip().lower()


def parts_of(sentence: str) -> tuple[str, ...]:
    """The normalised parts in which the scan sees a known sentence."""
    parts = (normalised(p) for p in re.sub("([.!?;:])[ \t\r\n\f]+", "\\1" + BREAK, sentence).split(BREAK))
    return tuple(p for p in parts if not re.fullmatch(MARK, p))


def whole(sentences: dict[str, str] = SENTENCES) -> dict[tuple[str, ...], str]:
    """The parts of each known sentence and its identifier; no two sentences may look the same to the scan."""
    out: dict[tuple[str, ...], str] = {}
    for name, sentence in sentences.items():
        parts = parts_of(sentence)
        if not parts or parts in out:
            raise ValueError(f"{name} has no words" if not parts else f"{name} and {out[parts]} have one normalised form")
        out[parts] = name
    return out


def gnu_notices() -> tuple[dict[str, str], Rules]:
    """The opening sentences of the file notices of the GNU licences, with their rules."""
    sentences, rules = {}, []
    ends = {"only": ("version {} of the License.", "version {} only."), "or-later": ("either version {} of the License, or (at your option) any later version.",)}
    for family, inner, versions in FAMILIES:
        for version in versions:
            for kind, endings in ends.items():
                for subject in ("program", "library"):
                    for mark in (",", ";"):
                        for k, end in enumerate(endings):
                            name = f"{family}{version}{inner.strip()}{kind.title().replace('-', '')}{subject.title()}{'Comma' if mark == ',' else 'Semicolon'}{k}"
                            sentences[name] = (
                                f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the GNU {inner}General Public License"
                                f" as published by the Free Software Foundation{mark} {end.format(version)}"
                            )
                            hope = "LibraryHope" if subject == "library" else "GplHope"
                            see = {"": "GplSee", "Library ": "LibrarySee", "Lesser ": "LesserSee", "Affero ": "AfferoSee"}[inner]
                            licence = f"{family}-{version if '.' in version else version + '.0'}-{kind}"
                            rules += [(licence, f"{name} {hope} GplEven {see}"), (licence, name)]
    return sentences, rules


def catalogue() -> tuple[dict[str, str], Rules]:
    """All known sentences and ordered rules: those listed above, GNU notices, short notices and SPDX tags.

    A sentence that has the form of one before it is left out with its rule, as the earlier one has rules of its own.
    """
    sentences, rules, taken = dict(SENTENCES), NOTICES + RULES, set(whole(SENTENCES))
    notices, notice_rules = gnu_notices()
    short, short_rules = {}, []
    for licence, names in NAMES.items():
        key = "".join(c if c.isalnum() else "_" for c in licence)
        forms = [f"{form} {the}{name}." for name in names for form in FORMS for the in ("the ", "")] + [f"SPDX-License-Identifier: {licence}"]
        for k, sentence in enumerate(forms):
            short[f"Short_{key}_{k}"] = sentence
            short_rules.append((licence, f"Short_{key}_{k}"))
    added = set()
    for name, sentence in (notices | short).items():
        if parts_of(sentence) not in taken:
            taken.add(parts_of(sentence))
            sentences[name] = sentence
            added.add(name)
    more = [(licence, parts) for licence, parts in notice_rules + short_rules if parts.split()[0] in added]
    return sentences, sorted(rules + more, key=lambda r: -len(r[1].split()))  # stable: longer sequences before their parts


class Scanner:
    """Sentences and rules as the replacements that both the columns and the SQL apply.

    ``parts`` gives every normalised part a mark: that of its sentence where it is one by itself, else a number.
    ``steps`` put sentences of several parts together, longest first. ``rules`` replace sequences; rules of one sentence,
    which come after them, are a lookup (``single``).
    """

    def __init__(self, sentences: dict[str, str], rules: Rules):
        found = whole(sentences)
        self.parts = {parts[0]: name for parts, name in found.items() if len(parts) == 1}
        several = sorted((parts for parts in found if len(parts) > 1), key=len, reverse=True)
        for parts in several:
            for part in parts:
                self.parts.setdefault(part, f"#{len(self.parts)}")
        self.steps = [("".join(f"<{self.parts[p]}>" for p in parts), f"<{found[parts]}>") for parts in several]
        single: dict[str, str] = {}
        self.rules = []
        for licence, parts in rules:
            names = parts.split()
            if unknown := [n for n in names if n != OTHER and n not in sentences]:
                raise ValueError(f"no sentence {unknown[0]} for {licence}")
            if len(names) > 1:
                if any(n in single for n in names):
                    raise ValueError(f"a rule of one sentence comes before {parts}")
                self.rules.append(("".join(f"<{n}>" for n in names), f"[{licence}]"))
            else:
                single.setdefault(parts, licence)
        self.single = single


@lru_cache
def default() -> Scanner:
    return Scanner(*catalogue())


def sentences_of(text: Column, joined: bool) -> Column:
    """The sentences of a text, by lines or with the lines of a paragraph joined."""
    if joined:
        text = F.regexp_replace(text, f"\\n{BLANK}*\\n", BREAK)
        text = F.translate(text, "\n", " ")
    else:
        text = F.translate(text, "\n", BREAK)
    return F.split(F.regexp_replace(text, f"([.!?;:]){BLANK}+", "$1" + BREAK), BREAK)


def lookup(pairs: dict[str, str]) -> Column:
    """A constant map, given as one expression; thousands of single literals take seconds to send to the JVM."""
    def quoted(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in pairs.items()) + ")")


def marks(text: Column, scanner: Scanner, joined: bool) -> Column:
    """The marks of a text's sentences in order, each in angle brackets."""
    table = lookup({part: f"<{name}>" for part, name in scanner.parts.items()})
    found = F.transform(sentences_of(text, joined), lambda s: F.lower(F.trim(F.regexp_replace(s, NOISE, " "))))
    found = F.filter(found, lambda s: (F.length(s) > 2) | ~s.rlike(f"^{MARK}\\z"))
    return F.array_join(F.transform(found, lambda s: F.when(s.isin(*scanner.parts), table[s]).otherwise(F.lit(f"<{OTHER}>"))), "")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: Rules | None = None
) -> DataFrame:
    """``doc_id, n_sentences, identifiers, joined_identifiers, licenses, left_over`` for every row.

    ``n_sentences`` counts the known sentences of the cut by lines; without ``sentences`` the built-in catalogue is used.
    """
    scanner = default() if sentences is None and rules is None else Scanner(SENTENCES if sentences is None else sentences, (rules or []) if sentences else (rules or NOTICES + RULES))
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = F.concat(marks(text, scanner, False), F.lit(CUT), marks(text, scanner, True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(both, f"(<[{OTHER}]>)+", f"<{OTHER}>").alias("seen"))
    told = F.col("seen")
    for parts, name in scanner.steps:
        told = F.replace(told, F.lit(parts), F.lit(name))
    told = F.regexp_replace(F.regexp_replace(told, "<#[0-9]+>", f"<{OTHER}>"), f"(<[{OTHER}]>)+", f"<{OTHER}>")
    rows = rows.select("doc_id", told.alias("told"))
    used = F.col("told")
    for parts, name in scanner.rules:
        used = F.replace(used, F.lit(parts), F.lit(name))
    rows = rows.select("doc_id", F.split("told", f"[{CUT}]").alias("cuts"), used.alias("used"))
    names = F.lit("<([^>?]+)>")
    rows = rows.select(
        "doc_id", F.regexp_extract_all(F.col("cuts")[0], names, F.lit(1)).alias("lines"), F.regexp_extract_all(F.col("cuts")[1], names, F.lit(1)).alias("flow"),
        F.regexp_extract_all("used", F.lit("\\[([^\\]]+)\\]"), F.lit(1)).alias("several"), F.regexp_extract_all("used", names, F.lit(1)).alias("alone"),
    )
    table = lookup(scanner.single or {"": ""})
    single = F.filter(F.transform("alone", lambda s: table[s]), lambda s: s.isNotNull())
    left = F.filter("alone", lambda s: table[s].isNull())
    return rows.select(
        "doc_id", F.size("lines").cast("long").alias("n_sentences"), F.array_join("lines", " ").alias("identifiers"), F.array_join("flow", " ").alias("joined_identifiers"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("several", single))), ",").alias("licenses"),
        F.array_join(F.array_sort(F.array_distinct(left)), ",").alias("left_over"),
    )


def scan_sql(scanner: Scanner | None = None) -> str:
    """The same in SQL, from the same sentences and rules."""
    scanner = scanner or default()

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def table(pairs: dict[str, str]) -> str:
        return "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs.items()) + "}"

    def replaced(column: str, steps: list[tuple[str, str]]) -> str:
        for parts, name in steps:
            column = f"replace({column}, {quoted(parts)}, {quoted(name)})"
        return column

    cut = "string_split(regexp_replace({}, '([.!?;:])[ \\t\\r\\n\\f]+', '\\1' || chr(1), 'g'), chr(1))"
    lines = cut.format("replace(coalesce(text, ''), chr(10), chr(1))")
    flow = cut.format("replace(regexp_replace(coalesce(text, ''), '\\n[ \\t\\r\\n\\f]*\\n', chr(1), 'g'), chr(10), ' ')")
    norm = "list_transform({}, lambda s: lower(trim(regexp_replace(s, '[^A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))))"
    run = f"regexp_replace({{}}, '(<[{OTHER}]>)+', '<{OTHER}>', 'g')"
    known = ", ".join(f"({quoted(k)}, {quoted(f'<{v}>')})" for k, v in scanner.parts.items())
    single, listed = table(scanner.single), ", ".join(map(quoted, scanner.single))
    return f"""
with marks(s, m) as (values {known}),
t as (select row_number() over () as r, doc_id, {norm.format(lines)} as l, {norm.format(flow)} as f from documents),
p as (select r, 1 as cut, unnest(l) as s, generate_subscripts(l, 1) as k from t union all select r, 2, unnest(f), generate_subscripts(f, 1) from t),
q as (select r, cut, string_agg(coalesce(m, '<{OTHER}>'), '' order by k) as s from p left join marks using (s) where not regexp_matches(p.s, '^{MARK}\\z') group by r, cut),
j as (select r, max(s) filter (where cut = 1) as l, max(s) filter (where cut = 2) as f from q group by r),
a as (select doc_id, {run.format(f"coalesce(j.l, '') || '{CUT}' || coalesce(j.f, '')")} as seen from t left join j using (r)),
b as (select doc_id, {run.format(f"regexp_replace({replaced('seen', scanner.steps)}, '<#[0-9]+>', '<{OTHER}>', 'g')")} as told from a),
c as (select doc_id, string_split(told, '{CUT}') as cuts, {replaced('told', scanner.rules)} as used from b),
d as (select doc_id, regexp_extract_all(cuts[1], '<([^>?]+)>', 1) as lines, regexp_extract_all(cuts[2], '<([^>?]+)>', 1) as flow,
  regexp_extract_all(used, '\\[([^\\]]+)\\]', 1) as several, regexp_extract_all(used, '<([^>?]+)>', 1) as alone from c)
select doc_id, len(lines)::bigint as n_sentences, array_to_string(lines, ' ') as identifiers, array_to_string(flow, ' ') as joined_identifiers,
  array_to_string(list_sort(list_distinct(list_concat(several, list_transform(list_filter(alone, lambda s: s in ({listed})), lambda s: {single}[s])))), ',') as licenses,
  array_to_string(list_sort(list_distinct(list_filter(alone, lambda s: s not in ({listed})))), ',') as left_over
from d"""
