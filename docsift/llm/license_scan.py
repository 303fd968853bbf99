"""License scans by sentence rules.

A text is cut into sentences, which are normalised and looked up among known licence
sentences. What is found becomes a sequence of identifiers, in which each licence's rules,
ordered sequences of identifiers, are looked for. Signs that mark comments and list items
are taken from the lines first, and a sentence may run on over lines that had them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.arrays import releasing
from docsift.llm.shared import small_batches

#: Known sentences, by identifier. Fixed values, from the public licences and notices.
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: "Released under the MIT License",
    3: "This work is licensed under the GNU General Public License, version 3",
    4: "Licensed under CC BY-NC 4.0",
    5: "Licensed under the MIT License",
    6: "SPDX-License-Identifier: MIT",
    7: "SPDX-License-Identifier: Apache-2.0",
    8: "SPDX-License-Identifier: GPL-3.0-or-later",
    9: 'Licensed under the Apache License, Version 2.0 (the "License")',
    10: "you may not use this file except in compliance with the License",
    11: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    12: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    13: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    14: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    15: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    16: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    17: "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

#: Licences and the sequences that stand for them. Fixed values.
RULES = (
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (7,)),
    ("Apache-2.0", (9, 10)),
    ("BSD-2-Clause", (13, 14, 15)),
    ("CC-BY-4.0", (17,)),
    ("CC-BY-NC-4.0", (4,)),
    ("GPL-3.0-only", (3,)),
    ("GPL-3.0-or-later", (8,)),
    ("GPL-3.0-or-later", (16,)),
    ("MIT", (2,)),
    ("MIT", (5,)),
    ("MIT", (6,)),
    ("MIT", (11, 12)),
)

#: Further sentences. GPL notices with semicolons are found in parts, as sentences end there.
ADDED_SENTENCES = {
    18: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    19: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    20: "All advertising materials mentioning features or use of this software must display the following acknowledgment:",
    21: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    22: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    23: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    24: "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    25: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    26: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    27: "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    28: "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    29: "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    30: "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    31: "either version 2 of the License, or (at your option) any later version",
    32: "either version 2.1 of the License, or (at your option) any later version",
    33: "either version 3 of the License, or (at your option) any later version",
    34: "version 2 of the License",
    35: "This is free and unencumbered software released into the public domain",
    36: "Distributed under the Boost Software License, Version 1.0",
    37: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    38: "Licensed under the BSD 2-Clause License",
    39: "Licensed under the BSD 3-Clause License",
    40: "GNU GENERAL PUBLIC LICENSE",
    41: "GNU LESSER GENERAL PUBLIC LICENSE",
    42: "GNU AFFERO GENERAL PUBLIC LICENSE",
    43: "Version 2, June 1991",
    44: "Version 3, 29 June 2007",
    45: "Version 2.1, February 1999",
    46: "Version 3, 19 November 2007",
    47: "Apache License",
    48: "Version 2.0, January 2004",
    49: "MIT License",
    50: "The MIT License",
    51: "The MIT License (MIT)",
    52: "Mozilla Public License Version 2.0",
    53: "Boost Software License - Version 1.0 - August 17th, 2003",
    54: "Eclipse Public License - v 2.0",
    55: "ISC License",
    56: "BSD 2-Clause License",
    57: "BSD 3-Clause License",
    58: "CC0 1.0 Universal",
    59: "Attribution 4.0 International",
    60: "Attribution-ShareAlike 4.0 International",
    61: "Attribution-NonCommercial 4.0 International",
    62: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    63: "Licensed under the GNU General Public License, version 3",
    64: "Licensed under the Mozilla Public License, version 2.0",
    65: "Licensed under the ISC License",
    66: "Licensed under CC BY 4.0",
    67: "Licensed under CC BY-SA 4.0",
    68: "Version 2.0, January 2004 http://www.apache.org/licenses/",
}

ADDED_RULES = (
    ("0BSD", (23,)),
    ("AGPL-3.0-or-later", (26,)),
    ("BSD-2-Clause", (38,)),
    ("BSD-3-Clause", (13, 14, 15, 18)),
    ("BSD-3-Clause", (39,)),
    ("BSD-4-Clause", (13, 14, 15, 19, 18)),
    ("BSD-4-Clause", (13, 14, 15, 20, 18)),
    ("BSL-1.0", (36,)),
    ("GPL-2.0-only", (27, 34)),
    ("GPL-2.0-only", (30,)),
    ("GPL-2.0-or-later", (27, 31)),
    ("GPL-3.0-or-later", (27, 33)),
    ("ISC", (21,)),
    ("ISC", (22,)),
    ("LGPL-2.0-or-later", (29, 31)),
    ("LGPL-2.1-or-later", (28, 32)),
    ("LGPL-3.0-or-later", (25,)),
    ("LGPL-3.0-or-later", (28, 33)),
    ("MPL-2.0", (24,)),
    ("Unlicense", (35,)),
    ("Zlib", (37,)),
    ("AGPL-3.0-only", (42, 46)),
    ("Apache-2.0", (47, 48)),
    ("Apache-2.0", (47, 68)),
    ("BSD-2-Clause", (56,)),
    ("BSD-3-Clause", (57,)),
    ("BSL-1.0", (53,)),
    ("CC-BY-4.0", (59,)),
    ("CC-BY-4.0", (66,)),
    ("CC-BY-NC-4.0", (61,)),
    ("CC-BY-SA-4.0", (60,)),
    ("CC-BY-SA-4.0", (62,)),
    ("CC-BY-SA-4.0", (67,)),
    ("CC0-1.0", (58,)),
    ("EPL-2.0", (54,)),
    ("GPL-2.0-only", (40, 43)),
    ("GPL-3.0-only", (40, 44)),
    ("GPL-3.0-only", (63,)),
    ("ISC", (55,)),
    ("ISC", (65,)),
    ("LGPL-2.1-only", (41, 45)),
    ("LGPL-3.0-only", (41, 44)),
    ("MIT", (49,)),
    ("MIT", (50,)),
    ("MIT", (51,)),
    ("MPL-2.0", (52,)),
    ("MPL-2.0", (64,)),
)

#: What SPDX tags name beside the tags above, and the older names of the same licences.
TAGS = {name: name for name in ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MPL-2.0", "Unlicense", "Zlib")}
TAGS |= {old + sign: f"{old}-{kind}" for old in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for sign, kind in (("", "only"), ("+", "or-later"))}

ALL_SENTENCES = SENTENCES | ADDED_SENTENCES | {100 + k: f"SPDX-License-Identifier: {tag}" for k, tag in enumerate(TAGS)}
ALL_RULES = RULES + ADDED_RULES + tuple((name, (100 + k,)) for k, name in enumerate(TAGS.values()))

#: The clause on names, which names the holder, by the known sentence that it stands for.
NAMED = {18: re.compile(r"(?:neither the names? of .{1,2000} nor the names? of .{1,1000} may|the names? of .{1,2000} may not) be used to endorse or promote products derived from this software without specific prior written permission")}
NAMED_START, NAMED_CHARS = ("neither the name", "the name"), 4000

WRAPPED = r"([^.!?;:\s])[ \t\r]*\n[ \t]*([a-z(])"
ENDS = r"(?<![.!?;])[.!?;]++[ \t\r\n]+"  # from the start of a run only, so that long runs cost no more than short ones
OTHER = r"[^A-Za-z0-9.+/\n-]+"
GOES_ON = "\0"  # before a line that is not joined to the one before, as it had a mark, follows one, or starts with no small letter
MARKS = re.compile(r"^[ \t]*(?:(?://[/!]*|/\*+!?|\*+/?|#+|--+>?|-(?=[ \t])|;+|%+|!+|>+|'|<!--|\(\*|dnl\b|@?REM\b|@rem\b)[ \t]*)+", re.M)
CLOSES = re.compile(r"(?:\*/|-->|\*\))[ \t\r]*$", re.M)
AFTER_MARKED = re.compile(r"(^\0[^\n]*\n)(?=[^\0\n])", re.M)


def sentences(text: str) -> list[str]:
    """Normalised sentences: wrapped lines joined, other signs than letters, digits and . + / - made blanks, lower case."""
    text = re.sub(WRAPPED, r"\1 \2", text)
    text = re.sub(ENDS, "\n", text + "\n")
    return [s.strip(" ") for s in re.sub(OTHER, " ", text).lower().split("\n")]


def pieces(text: str) -> list[str]:
    """Sentences as by ``sentences``, of lines without marks; those that may go on from the line before start with GOES_ON."""
    text = text.replace(GOES_ON, " ")
    if MARKS.search(text):
        text = AFTER_MARKED.sub(r"\1" + GOES_ON, CLOSES.sub("\n", MARKS.sub(GOES_ON, text)))
    text = re.sub(WRAPPED, r"\1 \2", text)
    text = re.sub(r"\n(?![\n\0])", "\n" + GOES_ON, text)
    text = re.sub(ENDS[:-2] + GOES_ON + "]+", "\n", text + "\n")
    return [GOES_ON * s.startswith(GOES_ON) + re.sub(OTHER, " ", s).lower().strip(" ") for s in text.split("\n")]


#: A tag with an expression: names between OR and AND, each perhaps with an exception after WITH.
TAG = "spdx-license-identifier "
BETWEEN, EXCEPT = ("or", "and"), "with"


class Lookup:
    """Identifiers of known sentences, whole or over several pieces."""

    def __init__(self, known: dict[int, str]):
        self.ids = {sentences(text)[0]: i for i, text in known.items()}
        self.named = {i: clause for i, clause in NAMED.items() if i in known}
        words = [s.split(" ") for s in self.ids]
        self.starts = {" ".join(w[:k]) for w in words for k in range(1, len(w) + 1)}

    def known(self, s: str) -> int | None:
        found = self.ids.get(s)
        if found is None and s.startswith(NAMED_START) and len(s) <= NAMED_CHARS:
            found = next((i for i, clause in self.named.items() if clause.fullmatch(s)), None)
        return found

    def tagged(self, s: str) -> list[int]:
        """Identifiers of the tags that an expression names, in order."""
        names, words = [], s[len(TAG) :].split(" ")
        for at, word in enumerate(words):
            if at == 0 or words[at - 1] in BETWEEN:
                names.append(word)
            elif word not in BETWEEN and word != EXCEPT and words[at - 1] != EXCEPT:
                break  # what follows is no part of the expression
        return [self.ids[TAG + name] for name in names if TAG + name in self.ids]

    def clause(self, parts: list[str], at: int, s: str) -> tuple[int | None, int]:
        """(identifier, end) of a clause with a name, which may have full stops, as "Inc." does, and so goes on over what looks like ends."""
        while at < len(parts) and len(s) <= NAMED_CHARS:
            s += " " + parts[at].lstrip(GOES_ON)
            at += 1
            if (found := self.known(s)) is not None:
                return found, at
        return None, at

    def starting(self, s: str) -> bool:
        return s in self.starts or (s.startswith(NAMED_START) and len(s) <= NAMED_CHARS)

    def find(self, text: str) -> list[int]:
        """Identifiers in order; of sentences that start with one piece, the longest."""
        parts, out, at = pieces(text), [], 0
        while at < len(parts):
            s = parts[at].lstrip(GOES_ON)
            found, end, after = self.known(s), at + 1, at + 1
            while after < len(parts) and parts[after].startswith(GOES_ON) and len(parts[after]) > 1 and self.starting(s):
                s += " " + parts[after][1:]
                after += 1
                if (longer := self.known(s)) is not None:
                    found, end = longer, after
            if found is None and parts[at].lstrip(GOES_ON).startswith(NAMED_START):
                found, over = self.clause(parts, after, s)
                end = over if found is not None else end
            if found is not None:
                out.append(found)
            elif parts[at].lstrip(GOES_ON).startswith(TAG):
                out += self.tagged(parts[at].lstrip(GOES_ON))
            at = end
        return out


def licenses(found: list[int], rules: tuple) -> list[str]:
    """Names of the rules met; one that lies within a longer rule's place is not met there."""
    places = [(at, at + len(rule), name) for name, rule in rules for at in range(len(found) - len(rule) + 1) if tuple(found[at : at + len(rule)]) == rule]
    return sorted({name for a, b, name in places if not any(c <= a and b <= d and d - c > b - a for c, d, _ in places)})


def license_scan(docs: DataFrame, known: dict[int, str] = ALL_SENTENCES, rules: tuple = ALL_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row by row: id, sentence_ids, licenses, n_licenses; of whole texts.

    sentence_ids are those found, in order, joined by commas; licenses those with a rule whose
    sentences follow each other among them, by name, joined by commas; where a longer rule
    holds, those within it (BSD-2-Clause in BSD-3-Clause) do not. A null or empty text
    has none. Null ids and repeated rows are scanned like others, very long texts whole. Other
    columns are ignored. An empty table gives an empty result.
    """
    lookup = Lookup(known)

    def run(batches):
        for batch in batches:
            ids, names, counts = [], [], []
            for k in range(batch.num_rows):
                found = lookup.find(batch.column(1)[k].as_py() or "")
                held = licenses(found, rules)
                ids.append(",".join(map(str, found)))
                names.append(",".join(held))
                counts.append(len(held))
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(counts, pa.int32())], [id_col, "sentence_ids", "licenses", "n_licenses"])

    small_batches(docs.sparkSession)
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return frame.mapInArrow(releasing(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, sentence_ids string, licenses string, n_licenses int")
