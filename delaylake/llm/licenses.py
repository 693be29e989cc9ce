"""License scans by sentence rules.

A text is cut into pieces (line ends and ``.!?;`` before white space or the end), each is
normalised (ASCII letters and digits in lower case, one blank between runs; comment marks go with
that, ``dnl`` and ``rem`` at the start of a line too). A run of neighbouring pieces that no sentence
mark and no blank line parts, wrapped lines or one line, is looked up in a table of known sentences;
the leftmost and then longest run counts, by the number of its first piece. Blank lines may stand
before the address in a sentence, and a known sentence with a mark inside (``v. 2.0``) is the pieces
that it yields, each after the other. This gives the text a sequence of sentence identifiers; unknown
sentences leave no identifier. The sequence is matched from the left against the ordered rules,
those of more identifiers first, without overlap: a rule is a licence and the identifiers that must follow
each other. The table is fixed and small, so it is part of the plan; the main path is DataFrame
functions only.

A null text has no sentences. Repeated rows are matched alike. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delaylake.llm._common import private, text_or_empty

#: Identifier and sentence, as the licences and their usual notices word them.
SENTENCES = (
    ("A", "Released under the MIT License"),
    ("B", "Licensed under the MIT License"),
    ("C", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("D", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("E", "Licensed under the Apache License, Version 2.0"),
    ("F", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("G", "you may not use this file except in compliance with the License"),
    ("H", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("I", "This work is licensed under the GNU General Public License, version 3"),
    ("J", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("K", "You should have received a copy of the GNU General Public License along with this program"),
    ("L", "Licensed under CC BY-NC 4.0"),
    ("M", "Licensed under CC BY 4.0"),
    ("N", "Licensed under CC BY-SA 4.0"),
    ("O", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("P", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Q", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("R", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("S", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("MIT0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("NCSA", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC2", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD4", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("PG", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("APL", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("V2", "either version 2 of the License, or (at your option) any later version"),
    ("V21", "either version 2.1 of the License, or (at your option) any later version"),
    ("GPL2", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("LGPL3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL2T", "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users"),
    ("GPL3T", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("AGPL3T", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"),
    ("LGPL3T", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"),
    ("MPL11", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"),
    ("EPL1", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CDDL", "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")"),
    ("UNL", "This is free and unencumbered software released into the public domain"),
    ("UNL2", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("CC0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("CCSA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CCNC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CCND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("ZLIB", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BSLN", "Distributed under the Boost Software License, Version 1.0"),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("OFL", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("EUPL", "This European Union Public Licence (the 'EUPL') applies to the Work (as defined below) which is provided under the terms of this Licence"),
    ("ART2", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed"),
    ("MSPL", "This license governs use of the accompanying software"),
)
#: Licence and the identifiers that must follow each other, set apart by blanks.
RULES = (
    ("MIT", "C D"), ("MIT", "A"), ("MIT", "B"), ("Apache-2.0", "F G H"), ("Apache-2.0", "E G H"), ("Apache-2.0", "E"), ("Apache-2.0", "APL"),
    ("GPL-3.0-or-later", "J K"), ("GPL-3.0-or-later", "J"), ("GPL-3.0-only", "I"), ("CC-BY-NC-4.0", "L"), ("CC-BY-4.0", "M"),
    ("CC-BY-SA-4.0", "N"), ("CC-BY-4.0", "O"), ("BSD-3-Clause", "P Q"), ("BSD-2-Clause", "P"), ("MPL-2.0", "R S"), ("MPL-2.0", "R"),
    ("MIT-0", "MIT0"), ("NCSA", "NCSA"), ("ISC", "ISC"), ("ISC", "ISC2"), ("0BSD", "0BSD"), ("BSD-4-Clause", "P BSD4 Q"), ("BSD-4-Clause", "P BSD4"), ("PostgreSQL", "PG"),
    ("GPL-2.0-or-later", "GPL V2"), ("GPL-2.0-only", "GPL2"), ("LGPL-2.1-or-later", "LGPL V21"), ("LGPL-2.0-or-later", "LGPL V2"),
    ("LGPL-3.0-or-later", "LGPL3"), ("AGPL-3.0-or-later", "AGPL3"), ("GPL-2.0-only", "GPL2T"), ("GPL-3.0-only", "GPL3T"), ("AGPL-3.0-only", "AGPL3T"), ("LGPL-3.0-only", "LGPL3T"),
    ("MPL-1.1", "MPL11"), ("EPL-1.0", "EPL1"), ("EPL-2.0", "EPL2"), ("CDDL-1.0", "CDDL"), ("Unlicense", "UNL UNL2"), ("Unlicense", "UNL"), ("CC0-1.0", "CC0"),
    ("CC-BY-SA-4.0", "CCSA"), ("CC-BY-NC-4.0", "CCNC"), ("CC-BY-ND-4.0", "CCND"), ("Zlib", "ZLIB"), ("BSL-1.0", "BSL"), ("BSL-1.0", "BSLN"), ("WTFPL", "WTFPL"),
    ("OFL-1.1", "OFL"), ("EUPL-1.2", "EUPL"), ("Artistic-2.0", "ART2"), ("MS-PL", "MSPL"),
)
#: Every known sentence holds one of these, so a text without them has none.
MARKS = ("licen", "permission", "redistribut", "copyright", "you ", "mozilla", "public domain", "anyone is free", "advertising materials")
END, GAP = r"[.!?;]+([ \t\n\x0B\f\r]|\z)", "[^A-Za-z0-9]+"
#: Comment prefixes that are words.
WORD_COMMENT = r"(?im)^[ \t]*(?:dnl|rem)(?=[ \t]|$)"


def _cut(sentence: str) -> list[str]:
    """The normalised pieces that a known sentence yields where it stands in a text."""
    parts = re.split(END.replace(r"\z", r"\Z").replace("(", "(?:"), sentence)
    return [n for p in parts if (n := re.sub(GAP, " ", p).strip(" ").lower())]


def normalised(sentence: str) -> str:
    """The first piece of a sentence; all of one that holds no sentence mark before white space."""
    return next(iter(_cut(sentence)), "")


def _pieces(text: Column) -> Column:
    """The normalised pieces, a line each; a full stop ends those that a sentence mark ends."""
    cut = F.split(F.regexp_replace(F.regexp_replace(text, WORD_COMMENT, ""), END, ".\n"), "\n")
    return F.array_join(F.transform(cut, lambda s: F.concat(F.lower(F.trim(F.regexp_replace(s, GAP, " "))), F.when(s.endswith("."), ".").otherwise(""))), "\n")


def _pattern(sentences) -> str:
    """Every known sentence over the lines of ``_pieces``, longer ones first."""
    keys = sorted({tuple(_cut(s)) for _, s in sentences}, key=lambda k: (-len(" ".join(k)), k))
    return r"(?<![^\n])(?:" + "|".join(r"\.\n\n?".join(map(_wrapped, k)) for k in keys) + r")(?![^.\n])"


def _wrapped(piece: str) -> str:
    """One line end or blank between words; before an address also blank lines."""
    words = piece.split(" ")
    return words[0] + "".join((r"[ \n]+" if w in ("http", "https") else r"[ \n]") + w for w in words[1:])


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences=SENTENCES, rules=RULES) -> DataFrame:
    """One row per document: doc_id, sentences (number and identifier of the known ones), sequence, rules and licences matched."""
    known = F.create_map(*[F.lit(x) for name, s in sentences for x in (" ".join(_cut(s)), name)])
    licences = F.create_map(*[F.lit(x) for licence, rule in rules for x in (marked_off(rule), licence)])
    rows = private(docs, doc_id=F.col(doc_id), text=text_or_empty(text))
    marked = F.rlike("text", F.lit("(?i:" + "|".join(MARKS) + ")"))
    rows = rows.select("doc_id", F.when(marked, _pieces(F.col("text"))).otherwise("").alias("pieces"))
    pattern = F.lit(_pattern(sentences))
    rows = rows.withColumn("found", F.regexp_extract_all("pieces", pattern, F.lit(0)))
    ids = F.transform("found", lambda x: known[F.regexp_replace(x, r"[^a-z0-9]+", " ")])
    # the number of a sentence is that of the line ends before it: those of the gaps and of the sentences so far
    ends = lambda x: F.regexp_count(x, F.lit(r"\n"))
    gaps = F.transform(F.split("pieces", _pattern(sentences)), ends)
    steps = F.zip_with(F.slice(gaps, 1, F.size("found")), F.concat(F.array(F.lit(0)), F.transform("found", ends)), lambda g, f: g + f)
    steps = F.slice(steps, 1, F.size("found"))
    numbers = F.aggregate(steps, F.array().cast("array<int>"), lambda out, n: F.concat(out, F.array(n + F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)))))
    rows = rows.select("doc_id", F.zip_with(numbers, ids, lambda n, i: F.struct(n.alias("number"), i.alias("id"))).alias("sentences"), F.array_join(ids, " ").alias("sequence"))
    # each identifier between marks of its own, so that a rule meets whole identifiers only
    apart = F.concat(F.lit("<"), F.replace("sequence", F.lit(" "), F.lit("><")), F.lit(">"))
    rows = rows.withColumn("met", F.regexp_extract_all(apart, F.lit(ordered(rules)), 0))
    plain = F.transform("met", lambda r: F.regexp_replace(F.regexp_replace(r, "><", " "), "[<>]", ""))
    return rows.select("doc_id", "sentences", "sequence", plain.alias("rules"), F.transform("met", lambda r: licences[r]).alias("licences"))


def marked_off(rule: str) -> str:
    return "<" + rule.replace(" ", "><") + ">"


def ordered(rules) -> str:
    """A pattern of all rules over marked-off identifiers, those of more identifiers first."""
    return "|".join(marked_off(r) for _, r in sorted(rules, key=lambda r: -len(r[1].split())))
